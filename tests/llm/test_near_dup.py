import random
import re

import numpy as np
import pytest
from llm_rows import ordered

from cargolens.llm import near_dup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, size=3, percent=85):
    """(doc_id, n, component, kept) of every row, from all pairs of texts."""
    sets = []
    for doc, text in rows:
        w = WORD.findall(ascii_lower(text))
        sets.append((doc, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    classes = {}
    for doc, s in sets:
        if s and doc is not None:
            classes.setdefault(frozenset(s), set()).add(doc)
    names = list(classes)
    root = {s: s for s in names}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if 100 * len(a & b) >= percent * len(a | b):
                root[top(a)] = top(b)
    least = {}
    for s in names:
        least[top(s)] = min(least.get(top(s), min(classes[s])), min(classes[s]))
    out = []
    for doc, s in sets:
        component = doc if not s or doc is None else least[top(frozenset(s))]
        out.append((doc, len(s), component, doc is None or doc == component))
    return out


def families(seed=0):
    rng = random.Random(seed)
    rows, next_id = [], 1000
    common = [f"shared{k}" for k in range(60)]
    for f in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([30, 80, 200]))]
        if f % 3 == 0:
            base += common
        for c in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = f"new{rng.randint(0, 10**6)}"
            rows.append((next_id, " ".join(own)))
            next_id += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [1000, 3])
def test_components_equal_all_pairs(spark, monkeypatch, part):
    # parts of three members: every list of some length is dealt over several tasks
    monkeypatch.setattr(N, "PART", part)
    rows = families()
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ordered(got.collect()) == ordered(brute(rows))


def test_five_words_and_eighty_percent(spark):
    rows = families(4)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80)
    assert ordered(got.collect()) == ordered(brute(rows, 5, 80))


def test_odd_rows(clashing, empty):
    rows = [tuple(r) for r in clashing.select("doc_id", "text").collect()]
    got = N.near_duplicates(clashing)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert ordered(got.collect()) == ordered(brute(rows))
    assert N.near_duplicates(empty).count() == 0


def test_a_chain_is_one_component(spark):
    edges = [(bytes([k]), bytes([k + 1])) for k in range(40)] + [(b"\xf0", b"\xf1"), (b"\xf1", b"\xf0"), (b"\xf5", b"\xf5")]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert {bytes(k): bytes(v) for k, v in got.items()} == {bytes([k]): b"\0" for k in range(41)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    errors = []
    for share in (0.3, 0.6, 0.85, 0.95):
        b = np.unique(np.concatenate([a[: int(len(a) * share)], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
        s = N.signature([a, b])
        errors.append(abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
    assert max(errors) < 0.2
    assert N.needed_matches(85) <= 41
