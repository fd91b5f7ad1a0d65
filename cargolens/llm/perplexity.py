"""Quality rules: plain counts of a text, and bands of n-gram perplexity for each language.

The model is modified Kneser-Ney in two parts. Words come first: a word counts
once in every text of a language that has it, and a text is scored by the
counts of all other texts, so that no text is told by itself. Every language
weighs the same in a word's probability; a clean text in two languages is not
surprising, one of invented or marked words is. What the discounts leave goes
to the spelling of the word in the text's language: n-grams of the symbols of
words. A word without a letter or digit, as a separator, is not scored: many equal
ones would hide how unlikely the words between them are.

Spark counts both over all documents. The commonest words travel to every task
with their probabilities, as sorted arrays of hashes with a number beside each
hash; the others lie in a table by hash and are joined to the words of the
texts. A symbol has 6 bits; a letter is one symbol, any other byte two, so every
byte is told apart and a language still has at most 64 ** ORDER n-grams of
symbols however large the corpus is: one language is estimated in one task, and
its part of the model has a proven size. Languages that together pass
MODEL_BYTES are scored in several passes, each with some of them.

A text outside its language's band, a few robust spreads to either side of the
median log perplexity of all texts that pass the plain rules, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import BLANKS, Words, as_bytes, batch_column, blocks, chained, commonest, mixed, narrow_batches, separators, written

ORDER, BITS = 4, 6
#: N-grams of two symbols or more that occur less often than this are not kept.
LEAST_COUNT = 3
#: Model bytes that go to the tasks in one pass.
MODEL_BYTES = 64 << 20
#: (language, word) pairs that travel to every task, and pairs a task sums before it hands them on.
COMMON, HELD = 1 << 18, 2_000_000
#: A band reaches so many robust spreads (quartile distance / 1.349) to either side of the median.
SPREADS = 5.0
LEAST_WORDS, REPEAT_PERCENT = 50, 50

_TABLE = separators(BLANKS, lower=False)
_WORD_STARTS = np.array([not 0x80 <= b <= 0xBF for b in range(256)])
_SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each byte, and which byte of that symbol it is: 0 for letters, which have a symbol of their own.

    Symbol 0 marks both ends of a word. No two bytes share both numbers.
    """
    out = np.zeros(256, dtype=np.uint32)
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            out[b] = 1 + b - ord("a")
        elif "A" <= c <= "Z":
            out[b] = 27 + b - ord("A")
        elif c.isascii() and c.isdigit():
            out[b] = 53
        elif c in ".,;:!?'\"()-":
            out[b] = 54
        elif b < 0x80:
            out[b] = 55
        else:
            out[b] = 56 + b % 8
    which = np.array([1 + np.count_nonzero(out[:b] == out[b]) for b in range(256)], dtype=np.uint32)
    return out, np.where(out < 53, np.uint32(0), which)


_CLASS, _WHICH = _classes()


def word_symbols(block: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of the chosen words, a symbol and the ORDER - 1 before it, and each word's number of them.

    A letter is one symbol; any other byte is two, its class and then which of that class it is.
    """
    data = np.frombuffer(block.data, dtype=np.uint8)
    starts, sizes = block.starts[chosen], block.ends[chosen] - block.starts[chosen]
    pad = ORDER - 1
    firsts = np.cumsum(sizes) - sizes
    own = data[np.repeat(starts - firsts, sizes) + np.arange(int(sizes.sum()))]
    second = _WHICH[own]
    place = np.concatenate([[0], np.cumsum(1 + (second > 0))])
    lengths = place[firsts + sizes] - place[firsts]
    room = lengths + pad + 1
    begins = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()), dtype=np.uint32)
    at = np.repeat(begins + pad - place[firsts], sizes) + place[:-1]
    flat[at] = _CLASS[own]
    flat[at[second > 0] + 1] = second[second > 0]
    code = np.zeros(len(flat), dtype=np.uint32)
    for k in range(ORDER):
        code[k:] |= flat[: len(flat) - k] << np.uint32(BITS * k)
    real = np.ones(len(flat), dtype=bool)
    for k in range(pad):
        real[begins + k] = False
    return code[real], lengths + 1


def _by_language(batch) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    langs, texts = batch_column(batch, "lang"), [as_bytes(t) for t in batch_column(batch, "text")]
    names = np.array(["" if x is None else x for x in langs], dtype=object)
    for name in sorted(set(names)):
        rows = np.flatnonzero(names == name)
        for start, part in blocks([texts[i] for i in rows]):
            yield name, rows[start : start + len(part)], part


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n): counts of the highest order over all documents; a null language is ''."""

    def counted(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for lang, _, part in _by_language(batch):
                block = Words(part, _TABLE)
                if not len(block.hashes):
                    continue
                _, first, times = np.unique(block.hashes, return_index=True, return_counts=True)
                codes, sizes = word_symbols(block, first)
                own = held.setdefault(lang, [])
                own.append(_summed(codes, np.repeat(times, sizes)))
                if len(own) > 16:
                    held[lang] = [_summed(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]))]
        for lang, own in held.items():
            codes, counts = _summed(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]))
            yield pa.record_batch({"lang": pa.array([lang] * len(codes), pa.string()), "code": pa.array(codes.astype(np.int64)), "n": pa.array(counts)})

    return docs.select("lang", "text").mapInArrow(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, langs): a word's hash and an array of (lang, n), in how many texts of the language it stands.

    One shuffle, by word; the array is as long as there are languages, at most.
    """

    def counted(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out():
            for lang, own in held.items():
                keys, counts = _summed(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]))
                yield pa.record_batch({"lang": pa.array([lang] * len(keys), pa.string()), "word": pa.array(keys.view(np.int64)), "n": pa.array(counts)})
            held.clear()

        size = 0
        for batch in batches:
            for lang, _, part in _by_language(batch):
                own = [np.unique(w) for w in Words(part, _TABLE).each() if len(w)]
                if not own:
                    continue
                held.setdefault(lang, []).append(np.unique(np.concatenate(own), return_counts=True))
                size += len(held[lang][-1][0])
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    summed = docs.select("lang", "text").mapInArrow(counted, "lang string, word long, n long").repartition("word").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    return summed.groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("langs"))


def word_masses(counts: DataFrame) -> tuple[DataFrame, float]:
    """(lang, word, n, mass) of the words that stand in two texts or more, and the mass left to spelling.

    The mass is what the word has by modified Kneser-Ney in the mean of all
    languages, without one of the texts of its own language.
    """
    each = counts.select(F.explode("langs").alias("x")).select("x.lang", "x.n")
    often = each.groupBy("lang").agg(F.sum("n").alias("total"), F.count("n").alias("words"), *(F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)))
    off, left = {}, 0.0
    for r in often.toLocalIterator():  # a row a language
        d = _from_counts([0, r["n1"], r["n2"], r["n3"], r["n4"]]).tolist()
        off[r["lang"]] = [float(r["total"]), *d[1:]]
        left += (d[1] * r["n1"] + d[2] * r["n2"] + d[3] * (r["words"] - r["n1"] - r["n2"])) / r["total"]
    if not off:
        return counts.sparkSession.createDataFrame([], "lang string, word long, n long, mass double"), 1.0
    stats = F.create_map(*(x for lang, own in off.items() for x in (F.lit(lang), F.array(*map(F.lit, own)))))

    def mass(lang, n):
        own = stats[lang]
        return F.when(n == 0, 0.0).when(n == 1, 1 - own[1]).when(n == 2, 2 - own[2]).otherwise(n - own[3]) / own[0]

    def valued(x):
        return F.struct(x["lang"].alias("lang"), x["n"].alias("n"), mass(x["lang"], x["n"]).alias("own"), mass(x["lang"], x["n"] - 1).alias("less"))

    again = counts.where((F.size("langs") > 1) | (F.col("langs")[0]["n"] > 1)).select("word", F.transform("langs", valued).alias("langs"))
    whole = again.withColumn("all", F.aggregate("langs", F.lit(0.0), lambda held, x: held + x["own"]))
    known = whole.select("word", "all", F.explode("langs").alias("x")).select("x.*", "word", "all")
    mean = F.greatest(F.col("all") - F.col("own") + F.col("less"), F.lit(0.0)) / len(off)
    return written(known.select("lang", "word", "n", mean.alias("mass")), "word-masses"), left / len(off)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from the counts of counts; fixed ones where those don't give any."""
    return _from_counts([0, *(np.count_nonzero(counts == k) for k in range(1, 5))])


def _from_counts(often: list[int]) -> np.ndarray:
    n = np.array(often, dtype=float)
    if n[1:].min() > 0:
        y = n[1] / (n[1] + 2 * n[2])
        out = np.array([0.0, *(k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3))])
        if all(0 < out[k] < k for k in (1, 2, 3)):
            return out
    return np.array([0.0, 0.5, 1.0, 1.5])


def hashed(order: int, code: np.ndarray) -> np.ndarray:
    return mixed(code.astype(np.uint64) | np.uint64(order + 1) << np.uint64(40))


def estimate(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes and log probabilities of all n-grams seen, sorted hashes and log weights of all contexts seen."""
    order = np.argsort(codes)
    plain = counts[order].astype(np.int64)
    levels = {ORDER: (codes[order].astype(np.int64), plain, plain)}
    for k in range(ORDER - 1, 0, -1):
        upper, _, plain = levels[k + 1]
        code, at = np.unique(upper & ((1 << BITS * k) - 1), return_inverse=True)
        plain, kinds = np.bincount(at, weights=plain, minlength=len(code)).astype(np.int64), np.bincount(at, minlength=len(code))
        # n-grams at a word's beginning have one possible symbol before them: their plain counts hold
        levels[k] = code, np.where((code >> BITS * (k - 1) == 0) & (k > 1), plain, kinds), plain
    p = np.full(1 << BITS, 1.0 / (1 << BITS))
    below = np.arange(1 << BITS)
    keys, logs, contexts, weights = [], [], [], []
    for k in range(1, ORDER + 1):
        code, c, plain = levels[k]
        # what is too rare gives all it has to the order below, so that a text is not told by itself
        rare = (plain < LEAST_COUNT) & (k > 1)
        d = np.where(rare, c, discounts(c)[np.minimum(c, 3)])
        context, at = np.unique(code >> BITS, return_inverse=True)
        total = np.bincount(at, weights=c)
        left = np.bincount(at, weights=d) / total
        suffix = code & ((1 << BITS * (k - 1)) - 1) if k > 1 else code
        lower = p[np.searchsorted(below, suffix)]
        now = (c - d) / total[at] + left[at] * lower
        if k == 1:  # every symbol has a probability
            whole = left[0] * p
            whole[code] = now
            code, now = np.arange(1 << BITS), whole
            rare = np.zeros(1 << BITS, dtype=bool)
        p, below = now, code
        keys.append(hashed(k, code[~rare]))
        logs.append(np.log(now[~rare]))
        contexts.append(hashed(k - 1, context))
        weights.append(np.log(np.maximum(left, 1e-12)))
    key, log, context, weight = map(np.concatenate, (keys, logs, contexts, weights))
    a, b = np.argsort(key), np.argsort(context)
    return key[a], log[a].astype(np.float32), context[b], weight[b].astype(np.float32)


def log_probabilities(model: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """Log probability of each code's last symbol after those before it, by backing off from the highest order seen."""
    key, log, context, weight = model
    out = np.zeros(len(codes))
    open_ = np.arange(len(codes))
    for k in range(ORDER, 0, -1):
        code = codes[open_] & np.uint32((1 << BITS * k) - 1)
        wanted = hashed(k, code)
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        seen = key[at] == wanted
        out[open_[seen]] += log[at[seen]]
        open_, code = open_[~seen], code[~seen]
        if not len(open_):
            break
        wanted = hashed(k - 1, code >> np.uint32(BITS))
        at = np.minimum(np.searchsorted(context, wanted), len(context) - 1)
        out[open_] += np.where(context[at] == wanted, weight[at], 0.0)
    return out


def train(docs: DataFrame) -> DataFrame:
    """(lang, key, log, context, weight): a row a language, the four arrays as bytes; written."""

    def one_language(key, pdf):
        arrays = estimate(pdf["code"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({"lang": [key[0]], **{n: [a.tobytes()] for n, a in zip(("key", "log", "context", "weight"), arrays)}})

    return written(ngram_counts(docs).groupBy("lang").applyInPandas(one_language, "lang string, key binary, log binary, context binary, weight binary"), "kneser-ney")


def passes(models: DataFrame) -> list[list[str]]:
    """The languages, as many at a time as fit MODEL_BYTES with their models, one at least."""
    sizes = models.select("lang", F.expr("length(key) + length(log) + length(context) + length(weight)").alias("bytes")).orderBy("lang")
    groups: list[list[str]] = [[]]
    held = 0
    for r in sizes.toLocalIterator():
        if groups[-1] and held + r["bytes"] > MODEL_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(r["lang"])
        held += r["bytes"]
    return groups


def loaded(models: DataFrame, langs: list[str]) -> dict[str, tuple[np.ndarray, ...]]:
    rows = models.where(F.col("lang").isin(langs)).toLocalIterator() if langs else ()
    return {
        r["lang"]: (np.frombuffer(r["key"], np.uint64), np.frombuffer(r["log"], np.float32), np.frombuffer(r["context"], np.uint64), np.frombuffer(r["weight"], np.float32))
        for r in rows
    }


def repeated_words(words: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    grams = chained(chained(words[:-2], words[1:-1]), words[2:])
    _, at, times = np.unique(grams, return_inverse=True, return_counts=True)
    again = times[at] > 1
    if not again.any():
        return 0
    hit = np.zeros(len(words), dtype=bool)
    for k in range(3):
        hit[k : len(words) - 2 + k] |= again
    return int(hit.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


class Model:
    """What the texts of one language are scored by: the symbols' arrays, hashes and masses of common words, mass of spelling."""

    def __init__(self, symbols: tuple[np.ndarray, ...], words: np.ndarray, masses: np.ndarray, left: float):
        order = np.argsort(words)
        self.symbols, self.words, self.masses, self.left = symbols, words[order], np.log(np.maximum(masses[order], 1e-300)), float(np.log(left))

    def common(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are held, and the log masses of those."""
        if not len(self.words):
            return np.zeros(len(words), dtype=bool), np.zeros(0)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        held = self.words[at] == words
        return held, self.masses[at[held]]


def block_measures(part: list[bytes], model: Model | None) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """Per text: words, code points in words, symbols, repeated lines, repeated words, words with a letter or digit, log probability of the common ones of these;
    then hash, times and log probability by spelling of the others of these, an array each."""
    block = Words(part, _TABLE)
    data = np.frombuffer(block.data, dtype=np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[edges])

    n_words = np.diff(block.bounds)
    letters = np.concatenate([[0], np.cumsum(_LETTERS[data], dtype=np.int64)])
    lettered = letters[block.ends] > letters[block.starts]
    n_scored = np.diff(np.concatenate([[0], np.cumsum(lettered, dtype=np.int64)])[block.bounds])
    likely = np.zeros(len(part))
    others = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)]
    cuts = np.zeros(max(0, len(part) - 1), dtype=np.int64)
    if len(block.hashes) and model is not None:
        words, first, at = np.unique(block.hashes, return_index=True, return_inverse=True)
        codes, sizes = word_symbols(block, first)
        ends = np.cumsum(sizes)
        logs = np.concatenate([[0.0], np.cumsum(log_probabilities(model.symbols, codes))])
        spelled = model.left + logs[ends] - logs[ends - sizes]
        held, masses = model.common(words)
        own = np.zeros(len(words))
        own[held] = np.logaddexp(masses, spelled[held])
        own[~lettered[first]] = 0.0
        likely = np.diff(np.concatenate([[0.0], np.cumsum(own[at])])[block.bounds])
        place = np.flatnonzero(~held[at] & lettered)
        text = np.searchsorted(block.bounds, place, side="right") - 1
        pair, times = np.unique(text * len(words) + at[place], return_counts=True)
        which = pair % len(words)
        others = [words[which].view(np.int64), times.astype(np.int32), spelled[which].astype(np.float32)]
        cuts = np.searchsorted(pair // len(words), np.arange(1, len(part)))
    return [
        n_words,
        per_text((data != 32) & _WORD_STARTS[data]),
        per_text(_SYMBOLS[data]),
        np.array([repeated_lines(t) for t in part]),
        np.array([repeated_words(w) for w in block.each()]),
        n_scored,
        likely,
    ], [np.split(x, cuts) for x in others]


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ", ".join(f"{c} long" for c in COUNTS) + ", n_scored long, likely double, word array<long>, times array<int>, spelled array<float>"


def measures(spark, models: dict[str, Model]):
    """A column function of (text, lang): the measures of each whole text."""
    shared = spark.sparkContext.broadcast(models)

    @F.pandas_udf(MEASURES)
    def measured(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        size = len(texts)
        out = [np.zeros(size, dtype=np.int64) for _ in [*COUNTS, "n_scored"]] + [np.zeros(size)]
        lists = [np.empty(size, dtype=object) for _ in range(3)]
        batch = pa.record_batch({"text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string())})
        for lang, rows, part in _by_language(batch):
            found, others = block_measures(part, shared.value.get(lang))
            for column, values in zip(out, found):
                column[rows] = values
            for column, values in zip(lists, others):
                for row, own in zip(rows, values):
                    column[row] = own
        names = [m.split()[0] for m in MEASURES.split(", ")]
        return pd.DataFrame(dict(zip(names, out + lists)), index=texts.index)

    return measured


def _failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def bands(measured: DataFrame) -> DataFrame:
    """(lang, low, high) of the log perplexity, from all rows that pass the plain rules."""
    # the upper quartile is counted from above, as the lower one from below: of eight texts the seventh and the second
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.5], 10_000).alias("q"), (-F.percentile_approx(-F.col("log_perplexity"), 0.25, 10_000)).alias("upper")
    middle = measured.where(~F.col("base_failed")).groupBy("lang").agg(*quartiles)
    spread = SPREADS * (F.col("upper") - F.col("q")[0]) / 1.349
    return middle.select("lang", (F.col("q")[1] - spread).alias("low"), (F.col("q")[1] + spread).alias("high"))


def measured(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(row, d, lang, m): a number of its own for each row, a struct of its columns, the language ('' for null), the measures; written.

    Then (row, rest): the log probability of the row's words that do not travel
    with the model. A language without any word has no model.
    """
    spark, found = docs.sparkSession, None
    narrow_batches(spark)
    own_columns = F.struct(*(F.col(f"`{c}`") for c in columns))
    named = docs.select(own_columns.alias("d"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("text").alias("text"))
    models = train(docs)
    masses, left = word_masses(written(word_counts(docs), "word-counts"))
    common = commonest(masses, COMMON).select("lang", "word", "mass").toPandas()
    groups = passes(models)
    for i, langs in enumerate(groups):
        own = F.col("lang").isin(langs) if i else ~F.col("lang").isin([x for g in groups[1:] for x in g])
        rows = named.where(own) if len(groups) > 1 else named
        held = {}
        for lang, symbols in loaded(models, langs).items():
            part = common[common["lang"] == lang]
            held[lang] = Model(symbols, part["word"].to_numpy(dtype=np.int64).view(np.uint64), part["mass"].to_numpy(dtype=float), left)
        rows = rows.select("d", "lang", measures(spark, held)(F.col("text"), F.col("lang")).alias("m"))
        found = rows if found is None else found.unionByName(rows)
    rows = written(found.select(F.monotonically_increasing_id().alias("row"), "d", "lang", "m"), "measures")

    # words that do not travel with the model meet their masses by hash
    other = rows.select("row", "lang", F.explode(F.arrays_zip("m.word", "m.times", "m.spelled")).alias("w")).select("row", "lang", "w.*")
    met = other.join(masses.where("mass > 0").drop("n"), ["lang", "word"], "left")
    log = F.when(F.col("mass").isNull(), F.col("spelled").cast("double")).otherwise(F.log(F.col("mass") + F.exp(F.col("spelled").cast("double"))))
    sums = met.groupBy("row").agg(F.sum(F.col("times") * log).alias("rest"))
    return rows, sums


def judged(docs: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, d) with the columns of docs, or those named, in the struct d; and (row, counts, base_failed, kept, log_perplexity).

    Null and empty texts have no words and so fail the plain rules; a null
    language counts as ''; repeated rows get equal results, and each counts as
    a text of its own. A language all of whose rows fail has no band, and none
    of its rows stay. Columns of docs may have any names. An empty table gives
    an empty result.
    """
    rows, sums = measured(docs, columns or docs.columns)
    named = rows.select("row", "lang", *(F.col(f"m.{c}") for c in COUNTS), F.col("m.n_scored").alias("n_scored"), F.col("m.likely").alias("likely")).join(sums, "row", "left")
    mean = -(F.col("likely") + F.coalesce("rest", F.lit(0.0))) / F.greatest(F.col("n_scored"), F.lit(1))
    # sums come in any order: what is compared is rounded
    named = named.select("row", "lang", *COUNTS, _failed().alias("base_failed"), F.round(mean, 6).alias("log_perplexity"))
    named = written(named, "perplexities")
    joined = named.join(bands(named), "lang", "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.select("row", "d"), joined.select("row", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_perplexity")


def passed(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs. Texts are not moved where few enough rows go."""
    rows, verdicts = judged(docs)
    gone = written(verdicts.where(~F.col("kept")).select("row"), "rejected")
    return rows.join(gone, "row", "left_anti").select("d.*")


def ruled(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity) of every row."""
    rows, verdicts = judged(docs, ["doc_id"])
    return rows.join(verdicts, "row").select("d.doc_id", *COUNTS, "base_failed", "kept", "log_perplexity")
