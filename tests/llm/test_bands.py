import random

from test_perplexity import mixed_corpus

from cargolens.llm import perplexity as P


def test_a_text_six_spreads_off_is_outside(spark):
    values = [(10 + k / 100, False) for k in range(-50, 51)] + [(14.0, True)] * 200
    frame = spark.createDataFrame([("en", x, failed) for x, failed in values], "lang string, log_perplexity double, base_failed boolean")
    (band,) = P.bands(frame).collect()
    spread = 0.5 / 1.349
    assert 10 + 4 * spread < band.high < 10 + 6 * spread
    assert 10 - 6 * spread < band.low < 10 - 4 * spread


def test_separators_hide_no_invented_words(spark):
    """Words of no letter or digit are not scored: the same words with and without them are as likely."""
    rng = random.Random(12)
    rows = [r for r in mixed_corpus() if r[0] < 300]
    rows += [(300 + i, t.replace(" ", " | "), lang) for i, t, lang in rows[:4]]
    invented = ["".join(rng.choice(["the", "an", "er", "in", "on"]) for _ in range(rng.randint(5, 9))) for _ in range(400)]
    rows += [(500 + i, " | ".join(invented[80 * i : 80 * i + 80]), "en") for i in range(5)]
    got = {r.doc_id: r for r in P.ruled(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(abs(got[300 + i].log_perplexity - got[i].log_perplexity) < 1e-4 for i in range(4))
    assert all(got[500 + i].n_words == 159 and not got[500 + i].base_failed and not got[500 + i].kept for i in range(5))
    assert [d for d, r in got.items() if d < 300 and not r.kept] == []
