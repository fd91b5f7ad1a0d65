import random
import zlib

import numpy as np
import pytest
from llm_rows import ordered

from cargolens.llm import compression, toxicity

BAD = ["scum", "trash", "moronic", "moronly"]


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 0


def toxic_rows(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(rng.randint(20, 90))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    held = [r for r in rows if held_out(r[0])]
    assert all(got[r[0]].held_out == held_out(r[0]) for r in rows)
    assert sum(got[r[0]].predicted == r[2] for r in held) / len(held) > 0.95
    assert all(got[r[0]].predicted == int(got[r[0]].score >= 0.5) for r in rows)


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    rows = toxic_rows(200)
    docs = spark.createDataFrame([(d, t, "x" * (d % 7)) for d, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    turned = spark.createDataFrame([(d, 1 - y if held_out(d) else y) for d, _, y in rows], "doc_id long, toxic int")
    assert ordered(toxicity.scored(docs, labels).collect()) == ordered(toxicity.scored(docs.drop("lang"), turned).collect())


def test_ftrl_leaves_unused_weights_at_nought():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.3).astype(float)
    rows = [np.unique(np.concatenate([rng.integers(10, 1000, 8), [3] if t else [4]])).astype(np.uint32) for t in y]
    w, _ = toxicity.fit_ftrl(rows, y, bits=10)
    assert w[3] > 0 > w[4] and (w != 0).sum() < 30


def quality_rows(n=300, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.3
        w = ["".join(rng.choice(["th", "er", "an", "on", "in", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(30, 200))]
        out.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w), int(not bad)))
    return out


def test_quality_on_held_out_rows(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in compression.scored(docs, labels).collect()}
    held = [r for r in rows if held_out(r[0])]
    assert sum(got[r[0]].predicted == r[2] for r in held) / len(held) > 0.95
    assert all(got[r[0]].predicted == int(got[r[0]].score >= 0.3) for r in rows)


@pytest.mark.parametrize("operator", [toxicity, compression])
def test_odd_rows(operator, clashing, empty, labels, no_labels):
    rows = clashing.select("doc_id", "text").collect()
    got = operator.scored(clashing, labels).collect()
    assert [c for c in got[0].asDict()] == ["doc_id", "held_out", "score", "predicted"]
    assert ordered((r.doc_id, r.held_out) for r in got) == ordered((r.doc_id, held_out(r.doc_id)) for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    plain = operator.scored(clashing, no_labels).collect()
    assert len(plain) == len(rows) and all(0 <= r.score <= 1 for r in plain)
    assert operator.scored(empty, labels).count() == 0


@pytest.mark.parametrize("content", [b"", b"short", b"ab" * 5000])
def test_raw_dictionaries(content):
    packers = compression.Packers(compression.dictionary([content]), b"")
    assert packers.difference(b"") == 0
    assert isinstance(packers.difference(b"some text " * 100), float)
