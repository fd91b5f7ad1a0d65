import hashlib
import re

import pytest
from llm_rows import ordered

from cargolens.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for name, item in items:
            t = words(item)
            if name is None or not t:
                continue
            k = min(13, len(t))
            windows = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
            at = [i for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in windows]
            if at:
                found.add(str(name))
                hit |= {i + j for i in at for j in range(k)}
        names = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog while seven green rivers run under the old stone bridge at night"),
    (2, "short item"),
    (3, "a a a a a a a a a a a a a a a"),
    (4, "nowhere words zyx that no document has at all in any order of thirteen or more"),
    (5, None),
    (6, " .,- "),
    (None, "the quick brown fox"),
    (2, "short item"),
    (2, "second text of this item"),
    (7, "Größe ÄÖ"),
]
PASSAGE = ITEMS[0][1]


def planted():
    filler = " ".join(f"fill{k}" for k in range(400))
    cut = " ".join(PASSAGE.split()[3:17])
    return [
        (1, filler + " " + PASSAGE.upper() + ", " + filler),
        (2, "x " + cut + " y"),
        (3, " ".join(PASSAGE.split()[:12])),
        (4, "short, item; SHORT item short"),
        (5, "a " * 40),
        (6, filler + " short item " + filler),
        (7, cut + " " + cut + " second text of this item"),
        (8, "größe ÄÖ and größe äö"),
        (9, " ".join(PASSAGE.split()[:6] + ["other"] + PASSAGE.split()[6:])),
    ]


@pytest.mark.parametrize("limit", [D.BLOCK_WORDS, 10])
def test_equals_brute_force(spark, monkeypatch, limit):
    # ten words a block: the items are worked off in many blocks
    monkeypatch.setattr(D.item_blocks, "__defaults__", (limit,))
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(planted(), "doc_id long, text string")
    assert ordered(D.contamination(docs, benchmark).collect()) == ordered(brute(planted(), ITEMS))


def test_odd_rows_and_empty_tables(spark, clashing, empty):
    items = ITEMS + [(20 + i, r.text) for i, r in enumerate(clashing.where("doc_id < 4").collect())]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [tuple(r) for r in clashing.select("doc_id", "text").collect()]
    got = D.contamination(clashing, benchmark)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert ordered(got.collect()) == ordered(brute(rows, items))
    assert D.contamination(empty, benchmark).count() == 0
    assert ordered(D.contamination(clashing, benchmark.limit(0)).collect()) == ordered(brute(rows, []))


def test_proximity(spark):
    benchmark = spark.createDataFrame([(1, "river stone bridge")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "the bridge of stone by the river"), (2, "river " + "far " * 60 + "stone bridge"), (3, "river stone")], "doc_id long, text string"
    )
    got = D.near(docs, benchmark, within=10).collect()
    assert [(r.doc_id, r.item_id, r.start, r.end) for r in got] == [(1, "1", 1, 7)]
