import math
import random

import numpy as np
import pytest
from llm_rows import CLASHING, ordered
from pyspark.sql import functions as F

from cargolens.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchors=lambda i: i % 100 == 0, k=5, percent=80):
    kept = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a, label, v in kept:
        if not anchors(a):
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in kept]
        alike = sorted((s, i) for s, i, other in scores if other == label and i != a)[:k]
        for s, p in alike:
            inside = sorted((t, i) for t, i, other in scores if other != label and percent * -s <= 100 * -t <= 100 * -s)
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(inside[:k], 1)]
    return out


def clouds(n, width, labels=4, seed=0, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(i, (centres[rng.integers(6)] + spread * rng.normal(size=width)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("part, turn, sample", [(8192, 1024, 4096), (17, 2, 60)])
def test_equals_a_search_of_everything(spark, monkeypatch, part, turn, sample):
    # small parts, turns and samples: leaves are dealt over tasks, anchors come in turns
    monkeypatch.setattr(H, "LEAF_PART", part)
    monkeypatch.setattr(H, "TURN", turn)
    rows = clouds(700, 12)
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), sample=sample)
    want = brute(rows)
    assert len(want) > 50
    assert ordered(got.collect()) == ordered(want)


def test_odd_rows(spark):
    rows = clouds(250, 5, seed=2, labels=2)
    same = rows[7][1]
    rows += [(300 + i, same, i % 2) for i in range(40)]  # equal vectors: ties
    rows += [(400, None, 1), (500, [1.0, None, 2.0, 0.0, 0.0], 1), (600, [float("nan")] * 5, 0), (700, [float("inf")] * 5, 0), (800, same, None), (None, same, 1)]
    rows += [(900, [], 0), (1000, same[:3], 1), (1100, same + [2.5], 0), (100, same, 1), rows[3], rows[3], (1200, [3e9, -3e9, 1.0, 0.0, 0.0], 0), (1300, [-x for x in same], 0)]
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in [*CLASHING, "row", "grp", "v", "id", "leaf", "part", "turn"]}))
    assert ordered(got.collect()) == ordered(brute(rows))


def test_nothing_to_mine(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = H.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (1, None, 1)], SCHEMA))
    assert alone.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert alone.count() == 0
    assert H.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2)], SCHEMA)).count() == 1


def test_scores_beyond_doubles():
    rng = random.Random(1)
    a = [[rng.randint(-(10**8), 10**8) for _ in range(20)] for _ in range(3)]
    b = [[rng.randint(-(10**8), 10**8) for _ in range(20)] for _ in range(4)]
    want = [[sum(x * y for x, y in zip(p, q)) for q in b] for p in a]
    assert H.products(np.array(a, dtype=float), np.array(b, dtype=float)).tolist() == want


def test_ranges_leave_leaves_out(spark):
    # six tight clouds: a narrow window must not meet every leaf, and must meet all leaves that hold rows of it
    rows = clouds(3000, 8, seed=5, spread=0.05)
    frame = H.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label").cache()
    vectors = np.array([r["v"] for r in frame.orderBy("id").collect()])
    plain = spark.sparkContext.broadcast(H.grown(vectors[::5]))
    nodes = H.ranges(frame, plain, 8)
    leaves = H.leaf_of(plain.value, vectors)
    met = []
    for a in vectors[::300]:
        score = vectors @ a
        for low in (score.max() * 0.95, np.median(score)):
            found = set(H.meeting(nodes, a, [low], [low + 0.05 * score.max()]))
            inside = (score >= low) & (score <= low + 0.05 * score.max())
            assert set(leaves[inside].tolist()) <= found
            met.append(len(found) / (leaves.max() + 1))
    assert np.mean(met) < 0.5
