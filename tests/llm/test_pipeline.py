import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from llm_rows import ordered
from pyspark.sql import functions as F
from test_decontamination import brute as brute_contamination
from test_near_dup import brute as brute_copies
from test_perplexity import plain_measures
from tokenizers import Tokenizer

import corpus_pipeline
from cargolens.llm import perplexity, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def corpus():
    """Clean texts, toxic ones, junk, copies, near copies and benchmark passages, with what each is."""
    rng = random.Random(8)
    syllables = ["the", "an", "er", "in", "on", "re", "st", "ti", "al", "de"]

    def prose(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows, kind, doc = [], {}, 0
    items = [(k, prose(30)) for k in range(3)]

    def add(text, what):
        nonlocal doc
        rows.append((doc, text, "en", f"src{doc % 3}", len(text or "")))
        kind[doc] = what
        doc += 1

    for _ in range(150):
        add(prose(rng.randint(60, 150)), "clean")
    for _ in range(220):
        w = prose(80).split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["scum", "loser", "moron"]))
        add(" ".join(w), "toxic")
    add("too short", "junk")
    add("buy now " * 60, "junk")
    add(" ".join("".join(chr(rng.randint(33, 126)) for _ in range(9)) for _ in range(90)), "junk")
    add(None, "junk")
    add(rows[3][1], "copy")
    add(rows[4][1] + " onlyhere", "copy")
    add(items[0][1] + " " + prose(50), "contaminated")
    add(prose(400) + " " + " ".join(items[1][1].split()[:14]), "clean")
    return rows, kind, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, kind, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(d, 1, int(k == "toxic")) for d, k in kind.items() if k in ("clean", "toxic")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def plain_pipeline(spark, rows, items, folder):
    """The stages over Python lists; only the trained scores come from the operators."""
    docs = spark.createDataFrame(rows, SCHEMA)
    score = toxicity.scorer(spark, toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    kept = {r.doc_id for r in docs.select("doc_id", score("text").alias("s")).collect() if r.s < 0.5}
    rows = [r for r in rows if r[0] in kept]
    band = {r.doc_id: r.kept for r in perplexity.ruled(spark.createDataFrame(rows, SCHEMA)).collect()}
    rows = [r for r in rows if not ((m := plain_measures(r[1]))[0] < 50 or 100 * m[4] > 50 * m[0]) and band[r[0]]]
    one = {d for d, _, _, k in brute_copies([r[:2] for r in rows]) if k}
    rows = [r for r in rows if r[0] in one]
    bad = {d for d, *_, c in brute_contamination([r[:2] for r in rows], items) if c}
    rows = [r for r in rows if r[0] not in bad]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    out = []
    for r, e in zip(rows, lib.encode_batch([r[1] for r in rows], add_special_tokens=False)):
        shown = lib.decode(e.ids, skip_special_tokens=False)
        out.append((r[0], len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest(), e.ids))
    return out


def test_pipeline_equals_plain_stages_and_keeps_clean_texts(spark, folder):
    rows, kind, items = corpus()
    got = corpus_pipeline.run(spark, folder).collect()
    assert ordered(got) == ordered(plain_pipeline(spark, rows, items, folder))
    kept = {r.doc_id for r in got}
    held = {d for d in kind if zlib.crc32(str(d).encode()) % 5 == 0}
    assert {d for d, k in kind.items() if k == "clean"} <= kept
    assert {kind[d] for d in kept if kind[d] in ("junk", "copy", "contaminated")} == set()
    assert not {d for d, k in kind.items() if k == "toxic" and d in held} & kept


def test_stages_take_odd_rows_and_empty_tables(spark, folder, clashing, empty):
    docs = clashing
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = corpus_pipeline.written(out, "stage")
        else:
            assert out.count() == docs.count()
        nothing = stage(spark, empty, folder)
        assert nothing.count() == 0
        assert k == len(corpus_pipeline.STAGES) - 1 or nothing.columns == empty.columns


def test_one_row_of_each_copy_stays(spark, folder, odd):
    kept = corpus_pipeline.keep_one_of_each(spark, odd, folder).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 105 not in ids and 0 in ids
    assert sum(r.doc_id is None for r in kept) == odd.where(F.col("doc_id").isNull()).count()


def test_copies_with_an_edited_block_go(spark, folder):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    short, long = rng.sample(words, 100), rng.sample(words, 1000)
    added, replaced = short + [f"new{i}" for i in range(20)], long[:300] + [f"other{i}" for i in range(100)] + long[400:]
    rows = [(i, " ".join(w)) for i, w in enumerate([short, added, long, replaced, rng.sample(words, 100)])]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], SCHEMA)
    kept = [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, folder).collect()]
    assert sorted(kept) == [d for d, _, _, k in brute_copies(rows, 5, 80) if k] == [0, 2, 4]


def test_texts_under_one_id_are_judged_each_for_itself(spark, folder):
    rows, _, items = corpus()
    a, b, c = (rows[i][1] for i in range(3))
    passage = items[0][1]

    def left(stage, pairs):
        docs = spark.createDataFrame([(d, t, "en", "src", len(t)) for d, t in pairs], SCHEMA)
        return ordered((r.doc_id, r.text) for r in stage(spark, docs, folder).collect())

    # b is a copy under 7, c is not; of the two near copies under 9 one stays
    got = left(corpus_pipeline.keep_one_of_each, [(1, a), (2, b), (7, b), (7, c), (7, c)])
    assert got == ordered([(1, a), (2, b), (7, c)])
    assert len(left(corpus_pipeline.keep_one_of_each, [(9, a), (9, a + " onlyhere"), (9, b)])) == 2
    got = left(corpus_pipeline.drop_contaminated, [(None, passage), (None, a), (5, passage), (5, b), (5, b)])
    assert got == ordered([(None, a), (5, b), (5, b)])
