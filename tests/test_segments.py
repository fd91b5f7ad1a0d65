"""Segments from chunk rows against the segments of texts that were put together."""

import random

from pyspark.sql import functions as F

from cargolens.operators import chunking, segments

LOCATORS = ["Page 1", "Sheet A", "", None, "x" * 181, "a]b", "Document, part 3"]


def _rows(seed, documents):
    rng = random.Random(seed)
    rows = []
    for d in range(documents):
        for p in range(1, rng.randint(1, 25) + 1):
            words = [rng.choice(["case", "net", "\n[Page 2]\nkg", "[no]", "\r[z]\nq", "end\n\n[Other]\n", "long" * rng.randint(1, 12)]) for _ in range(rng.randint(1, 9))]
            rows.append((d, p, rng.choice(LOCATORS[: 1 + seed % 7]) if p > 1 or rng.random() < 0.5 else "Page 1", " ".join(words).strip() or "x"))
    return rows


def _both(spark, rows, target, limit):
    chunks = spark.createDataFrame(rows, "doc long, position int, locator string, text string")
    texts = chunking.assemble(chunks, "doc", ["position"])
    want, many = chunking.segments(texts, "doc", target=target, limit=limit)
    got, rejects = segments.chunk_segments(chunks, "doc", target=target, limit=limit)
    plain = lambda df: sorted(map(tuple, df.collect()))
    return plain(got), plain(want), plain(rejects), plain(many)


def test_same_segments_as_of_assembled_texts(spark):
    for seed, target, limit in ((0, 60, None), (6, 60, 5), (4, 150, None)):
        got, want, rejects, many = _both(spark, _rows(seed, 25), target, limit)
        assert got == want and rejects == many, (seed, target)
        assert (limit is None) == (not rejects)


def test_windows_where_no_locator_makes_a_section(spark):
    rows = [(1, p, None, f"piece {p} " + "w" * (p % 40)) for p in range(1, 60)] + [(2, 1, "", "short")]
    got, want, rejects, many = _both(spark, rows, 100, None)
    assert got == want and rejects == many == [] and len(got) > 10


def test_sections_count_from_one(spark):
    rows = [(1, 1, "Page 1", "a\n[Page 2]\nb"), (1, 2, "", "goes on"), (1, 3, "Page 3", "c"), (2, 1, None, "alone")]
    chunks = spark.createDataFrame(rows, "doc long, position int, locator string, text string")
    got = sorted(map(tuple, segments.section_rows(chunks, "doc").collect()))
    assert got == [(1, 1, "[Page 1]\na"), (1, 2, "[Page 2]\nb\n\n[]\ngoes on"), (1, 3, "[Page 3]\nc"), (2, 1, "[]\nalone")]


def test_no_chunks(spark):
    chunks = spark.createDataFrame([], "doc long, position int, locator string, text string")
    got, rejects = segments.chunk_segments(chunks, "doc")
    assert got.isEmpty() and rejects.isEmpty()


def test_a_document_of_a_hundred_thousand_chunks(spark):
    n, target = 100_000, 1000
    chunks = spark.range(1, n + 1).select(
        F.lit(1).alias("doc"), F.col("id").cast("int").alias("position"), F.format_string("Page %d", "id").alias("locator"),
        F.repeat(F.lit("x"), (F.col("id") % 97 + 1).cast("int")).alias("text"),
    )
    got, _ = segments.chunk_segments(chunks, "doc", target=target, limit=None)
    ends, open_, size = [], 0, 0
    for i in range(1, n + 1):
        own = len(f"[Page {i}]\n") + i % 97 + 1
        if open_ and size + own + 2 > target:
            ends.append((open_, size))
            open_, size = 0, 0
        size = size + own + 2 if open_ else own
        open_ += 1
    ends.append((open_, size))
    found = got.select("segment_no", (F.size(F.split("text", "\n\n"))).alias("k"), F.length("text").alias("size")).orderBy("segment_no").collect()
    assert [(r.k, r["size"]) for r in found] == ends
    assert [r.segment_no for r in found] == list(range(1, len(ends) + 1))


def test_documents_over_a_limit_are_not_put_together(spark):
    rows = [(1, 1, "Page 1", "a" * 30), (1, 2, "Page 2", "b" * 30), (2, 1, "Page 1", "c")] + [(3, p, f"Page {p}", "d") for p in range(1, 5)]
    chunks = spark.createDataFrame(rows, "doc long, position int, locator string, text string")
    texts, rejects = chunking.assemble_checked(chunks, "doc", ["position"], max_chars=50, max_pages=3)
    assert [tuple(r) for r in texts.collect()] == [(2, "[Page 1]\nc")]
    assert sorted((r.doc, r.reason) for r in rejects.collect()) == [(1, "too many characters"), (3, "too many pages")]
