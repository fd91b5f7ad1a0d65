import random
import re
from collections import Counter

import pytest
from llm_rows import ordered
from pyspark.sql import functions as F

from cargolens.llm import collocations as C


def runs(text, longest):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
        w = re.findall(r"[^\x20\x09]+", piece)
        for size in range(1, longest + 1):
            for i in range(len(w) - size + 1):
                yield tuple(w[i : i + size])


def brute(rows, longest=3, least=10, inside=50, most=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for run in runs(text, longest):
            own[run] += 1
            n[lang] += len(run) == 1
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        longer, kept = Counter(), []
        for q, b in found.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    longer[q[i : i + size]] = max(longer[q[i : i + size]], b)
        for p, a in found.items():
            if 100 * longer[p] >= inside * a:
                continue
            score, k = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1)]
    return out


def prose(n=120, seed=0):
    rng = random.Random(seed)
    words = ["the", "River", "bank", "of", "new", "york", "city", "große", "漢", "a", "b-c", "run"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(["new york city", "new  york", "the\triver bank", rng.choice(words), rng.choice(words)])
            text += rng.choice([" ", " ", " ", "\t", ". ", ", ", "\n", "\x0b", "! ? "])
        rows.append((i, text, rng.choice(["en", "de", None, ""])))
    return rows


SCHEMA = "doc_id long, text string, lang string"


@pytest.mark.parametrize("longest, least", [(3, 10), (2, 3), (4, 6)])
def test_equals_counting_phrases(spark, longest, least):
    rows = prose()
    got = C.collocations(spark.createDataFrame(rows, SCHEMA), longest=longest, least=least)
    want = brute([r[1:] for r in rows], longest, least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert len(want) > 20 and ordered(got.collect()) == ordered(want)


def test_fingerprints_that_collide_are_counted_by_phrase(spark):
    # ten bits: nearly every fingerprint stands for several phrases
    rows = prose(80, 4)
    got = C.collocations(spark.createDataFrame(rows, SCHEMA), bits=10)
    assert ordered(got.collect()) == ordered(brute([r[1:] for r in rows]))


def test_pointers_lead_to_the_phrases(spark):
    # full fingerprints: no phrase has to be counted a second time
    texts = C._texts(spark.createDataFrame(prose(90, 2), SCHEMA).repartition(5))
    sizes = {1: C.gram_counts(texts, 1, 5, None, 64), 2: C.gram_counts(texts, 2, 5, None, 64)}
    found = C.materialised(texts, sizes, 64).collect()
    assert len(found) == sum(rows.count() for rows in sizes.values()) > 20
    assert all(r.clean and r.phrase.count(" ") == r.size - 1 for r in found)


def test_first_rows_of_each_language(spark):
    rows = prose(seed=7)
    got = C.collocations(spark.createDataFrame(rows, SCHEMA), least=2, most=7).collect()
    assert ordered(got) == ordered(brute([r[1:] for r in rows], least=2, most=7))


def test_odd_rows(clashing, empty):
    rows = [(r.text, r.lang) for r in clashing.collect()]
    got = C.collocations(clashing.withColumns({c: F.lit(1) for c in ("fp", "at", "phrase", "lang_key", "a", "words")}), least=2)
    assert ordered(got.collect()) == ordered(brute(rows, least=2))
    assert C.collocations(empty).count() == 0


def test_scores_pass_64_bits(spark):
    big = 10**14
    rows = [(1, "en", "x", 3 * big), (1, "en", "y", 2 * big), (2, "en", "x y", big)]
    got = C.scored_phrases(spark.createDataFrame(rows, "size int, lang string, phrase string, n long")).first()
    assert (got.score, got.l, got.r) == (1000000 * big * big // (6 * big * big), 3 * big, 2 * big)
