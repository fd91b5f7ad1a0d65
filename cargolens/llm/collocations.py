"""Phrases whose words occur together, mined by Rabin-Karp fingerprints.

1. Prefix polynomials over the word hashes of a block of texts give the
   fingerprint of every n-gram inside a piece, as one numpy array for each size.
   The language is part of the fingerprint.
2. A task counts its fingerprints, keeps a pointer to one occurrence of each,
   and a shuffle adds the counts up. Size by size: an n-gram can only be
   frequent if its first and its last size - 1 words are, so only such ones are
   counted (told by a bitmap of fixed size; what it lets through beyond them is
   counted and falls out again).
3. Frequent fingerprints are checked against the texts: the shuffle also adds
   up a second, independent hash of the text of every occurrence, and the sum
   must be the count times the hash of the phrase at the pointer. Only there a
   phrase is materialised. Fingerprints that stand for several phrases fail, and
   are counted again by phrase.
4. Cuts, scores, contained phrases and ranks are joins of the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.common import FILTER_BUCKETS, MASK, STEP, Words, _powers, batch_column, chained, key_bits, mixed, narrow_batches, separators, text_blocks, written

#: Words are runs of anything but these bytes and those that part pieces.
INSIDE = [(0x20, 0x20), (0x09, 0x09)]
#: . , ; : ! ? and line ends part pieces.
PARTING = [(0x2E, 0x2E), (0x2C, 0x2C), (0x3B, 0x3B), (0x3A, 0x3A), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D)]
#: n-grams that a task holds before it counts them.
HELD = 1 << 21
#: Second hashes are added up modulo this prime.
PRIME = (1 << 31) - 1
#: Low bits of a pointer: the word's place in its text. The others come from a hash of the row.
PLACE_BITS = 24
_TABLE = separators([*INSIDE, *PARTING])
_PARTS = bytes(1 if any(a <= i <= b for a, b in PARTING) else 0 for i in range(256))
_SECOND = np.random.default_rng(61).integers(0, MASK, 256, dtype=np.uint64, endpoint=True)


class Pieces(Words):
    """Words of a block of texts, with the text and the piece each is in, and prefix polynomials over their hashes."""

    __slots__ = ("_prefix", "doc", "piece", "place")

    def __init__(self, texts: list[bytes]):
        super().__init__(texts, _TABLE)
        parts = np.frombuffer(b" ".join([*texts, b""]).translate(_PARTS), dtype=np.uint8)
        self.piece = np.cumsum(parts)[self.starts] if len(self.starts) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.place = np.arange(len(self.doc)) - np.repeat(self.bounds[:-1], sizes)
        with np.errstate(over="ignore"):
            self._prefix = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * _powers(len(self.hashes))[0][: len(self.hashes)], dtype=np.uint64)])

    def grams(self, size: int, langs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints of all runs of `size` words, whether each lies in one piece of one text); langs has a number for each text."""
        n = max(0, len(self.hashes) - size + 1)
        last = slice(size - 1, size - 1 + n)
        whole = (self.doc[:n] == self.doc[last]) & (self.piece[:n] == self.piece[last])
        with np.errstate(over="ignore"):
            spans = (self._prefix[size : size + n] - self._prefix[:n]) * _powers(n)[1][:n]
            return mixed(spans + langs[self.doc[:n]] * STEP) >> np.uint64(64 - bits), whole

    def checks(self, size: int) -> np.ndarray:
        """A second hash below PRIME of all runs of `size` words, from sums over bytes that have nothing in common with the first."""
        data = np.frombuffer(self.data, dtype=np.uint8)
        with np.errstate(over="ignore"):
            values = _SECOND[data]
            plain = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
            rising = np.concatenate([[np.uint64(0)], np.cumsum(values * np.arange(1, len(data) + 1, dtype=np.uint64), dtype=np.uint64)])
            start = self.starts.astype(np.uint64)
            words = mixed(rising[self.ends] - rising[self.starts] - start * (plain[self.ends] - plain[self.starts]))
            n = max(0, len(words) - size + 1)
            out = words[:n]
            for k in range(1, size):
                out = chained(out, words[k : k + n])
        return (out >> np.uint64(33)) % np.uint64(PRIME)

    def phrase(self, i: int, size: int) -> str:
        return b" ".join(self.data[a:b] for a, b in zip(self.starts[i : i + size], self.ends[i : i + size])).decode("utf-8", "surrogatepass")


def _texts(docs: DataFrame) -> DataFrame:
    """(lang, lang_key, mark, text): what every pass reads."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.xxhash64("doc_id", "text").alias("mark"), "text")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[Pieces, np.ndarray, np.ndarray, list[str]]]:
    """(pieces, language numbers, row hashes, languages) of runs of rows of a batch of _texts()."""
    keys, marks = batch.column(1).to_numpy().astype(np.uint64), batch.column(2).to_numpy().astype(np.uint64)
    langs = batch_column(batch, "lang")
    for start, part in text_blocks(batch):
        own = slice(start, start + len(part))
        yield Pieces(part), keys[own], marks[own], langs[own]


def _pointers(pieces: Pieces, marks: np.ndarray, n: int) -> np.ndarray:
    """One number for the row and the place of each word."""
    places = pieces.place[:n].astype(np.uint64) & np.uint64((1 << PLACE_BITS) - 1)
    return (marks[pieces.doc[:n]] << np.uint64(PLACE_BITS) | places).view(np.int64)


def bitmap(rows: DataFrame, key: Column) -> np.ndarray:
    """key_bits() as one array, for held()."""
    out = np.zeros((FILTER_BUCKETS + 1) * 4096, dtype=np.uint8)
    for bucket, bits in key_bits(rows, key).items():
        out[bucket * 4096 : bucket * 4096 + len(bits)] = bits
    return out


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are marked in a bitmap()."""
    at = keys & (FILTER_BUCKETS * 32768 - 1)
    # as the built-in functions count: bit 0 lies in bucket 0, from 1 on buckets count up
    at = np.where(at > 0, at + 32767, 0)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _keys(at):
    """Two numbers that spread pointers over a bitmap; for columns and arrays alike."""
    place = (1 << PLACE_BITS) - 1
    if isinstance(at, Column):
        low = at.bitwiseAND(F.lit(place).cast("long"))
        return F.shiftrightunsigned(at, PLACE_BITS).bitwiseXOR(low), F.shiftrightunsigned(at, PLACE_BITS + 14).bitwiseXOR(F.shiftleft(low, 2))
    number = at.view(np.uint64)
    low = at & place
    return (number >> np.uint64(PLACE_BITS)).view(np.int64) ^ low, (number >> np.uint64(PLACE_BITS + 14)).view(np.int64) ^ (low << 2)


def gram_counts(texts: DataFrame, size: int, least: int, smaller, bits: int) -> DataFrame:
    """(fp, n, at, total): fingerprints of runs of `size` words that occur `least` times or more; written.

    at is the least pointer to an occurrence, total the sum of the second
    hashes of all, modulo PRIME. smaller is a broadcast bitmap of the frequent
    runs of one word less.
    """

    def counted(batches):
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        entries = 0

        def flushed() -> pa.RecordBatch:
            fp, at, check = (np.concatenate(c) for c in zip(*taken))
            taken.clear()
            order = np.argsort(fp, kind="stable")
            fp = fp[order]
            first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            n = np.diff(np.append(first, len(fp)))
            total = np.add.reduceat(check[order].astype(np.int64), first) % PRIME
            least_at = np.minimum.reduceat(at[order], first)
            return pa.record_batch({"fp": pa.array(fp[first].view(np.int64)), "n": pa.array(n.astype(np.int64)), "at": pa.array(least_at), "total": pa.array(total)})

        for batch in batches:
            for pieces, langs, marks, _ in _blocks(batch):
                fp, whole = pieces.grams(size, langs, bits)
                if smaller is not None and len(fp):
                    shorter = held(smaller.value, pieces.grams(size - 1, langs, bits)[0].view(np.int64))
                    whole &= shorter[:-1] & shorter[1:]
                taken.append((fp[whole], _pointers(pieces, marks, len(fp))[whole], pieces.checks(size)[whole]))
                entries += len(taken[-1][0])
                if entries >= HELD:
                    yield flushed()
                    entries = 0
        if entries:
            yield flushed()

    rows = texts.mapInArrow(counted, "fp long, n long, at long, total long")
    rows = rows.groupBy("fp").agg(F.sum("n").alias("n"), F.min("at").alias("at"), F.pmod(F.sum("total"), F.lit(PRIME)).alias("total"))
    return written(rows.where(F.col("n") >= least), f"grams-{size}")


def word_totals(texts: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences of each language."""

    def counted(batches):
        for batch in batches:
            words: dict[str, int] = {}
            for pieces, _, _, langs in _blocks(batch):
                for lang, n in zip(langs, np.diff(pieces.bounds).tolist()):
                    words[lang] = words.get(lang, 0) + n
            yield pa.record_batch({"lang": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    return texts.mapInArrow(counted, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def materialised(texts: DataFrame, sizes: dict[int, DataFrame], bits: int) -> DataFrame:
    """(size, fp, n, lang, phrase, clean): each frequent fingerprint with the phrase at its pointer, and whether all its occurrences are that phrase; written."""
    spark = texts.sparkSession
    frequent = None
    for size, own in sizes.items():
        own = own.select(F.lit(size).alias("size"), "fp", "n", "at", "total")
        frequent = own if frequent is None else frequent.unionByName(own)
    pointed = spark.sparkContext.broadcast([bitmap(frequent, key) for key in _keys(F.col("at"))])

    def seen(batches):
        for batch in batches:
            for pieces, langs, marks, names in _blocks(batch):
                at = _pointers(pieces, marks, len(pieces.doc))
                there = np.logical_and(*(held(b, key) for b, key in zip(pointed.value, _keys(at))))
                for size in sizes_of:
                    fp, whole = pieces.grams(size, langs, bits)
                    place = np.flatnonzero(whole & there[: len(fp)])
                    if not len(place):
                        continue
                    own = [names[d] for d in pieces.doc[place].tolist()]
                    phrases = [pieces.phrase(i, size) for i in place.tolist()]
                    columns = [pa.array(np.full(len(place), size, dtype=np.int32)), *map(pa.array, (fp[place].view(np.int64), at[place], pieces.checks(size)[place].astype(np.int64)))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.string()), pa.array(phrases, pa.string())], names=["size", "fp", "at", "check", "lang", "phrase"])

    sizes_of = list(sizes)
    rows = texts.mapInArrow(seen, "size int, fp long, at long, check long, lang string, phrase string")
    rows = rows.join(frequent.select("size", "fp", "at"), ["size", "fp", "at"], "left_semi").dropDuplicates(["size", "fp", "at"])
    # both factors have 31 bits
    expected = F.pmod(F.pmod("n", F.lit(PRIME)) * F.col("check"), F.lit(PRIME))
    found = frequent.join(rows, ["size", "fp", "at"], "left")
    return written(found.select("size", "fp", "n", "lang", "phrase", F.coalesce(expected == F.col("total"), F.lit(False)).alias("clean")), "materialised")


def counted_again(texts: DataFrame, doubtful: DataFrame, sizes: list[int], least: int, bits: int) -> DataFrame:
    """(size, n, lang, phrase): the phrases behind the fingerprints (size, fp) that stand for several, each with its own count."""
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast({size: bitmap(doubtful.where(F.col("size") == size), F.col("fp")) for size in sizes})

    def seen(batches):
        for batch in batches:
            counts: dict[tuple[int, int, str, str], int] = {}
            for pieces, langs, _, names in _blocks(batch):
                for size in sizes:
                    fp, whole = pieces.grams(size, langs, bits)
                    place = np.flatnonzero(whole)
                    place = place[held(known.value[size], fp[place].view(np.int64))]
                    for i in place.tolist():
                        key = (size, int(fp[i].view(np.int64)), names[pieces.doc[i]], pieces.phrase(i, size))
                        counts[key] = counts.get(key, 0) + 1
            if counts:
                columns = zip(*((*key, n) for key, n in counts.items()))
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["size", "fp", "lang", "phrase", "n"])

    rows = texts.mapInArrow(seen, "size int, fp long, lang string, phrase string, n long").join(doubtful, ["size", "fp"], "left_semi")
    return rows.groupBy("size", "lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, bits: int = 64) -> DataFrame:
    """(size, lang, phrase, n): all runs of 1 to `longest` words of a piece that occur `least` times or more in a language; written.

    Exact for any width of the fingerprints: those that stand for several
    phrases are found by the check against the texts and counted by phrase.
    """
    spark = docs.sparkSession
    texts = _texts(docs)
    sizes: dict[int, DataFrame] = {}
    smaller = None
    for size in range(1, longest + 1):
        sizes[size] = gram_counts(texts, size, least, smaller, bits)
        smaller = spark.sparkContext.broadcast(bitmap(sizes[size], F.col("fp")))
    found = materialised(texts, sizes, bits)
    out = found.where("clean").select("size", "lang", "phrase", "n")
    doubtful = written(found.where("not clean").select("size", "fp"), "doubtful")
    if not doubtful.isEmpty():
        out = out.unionByName(counted_again(texts, doubtful, list(sizes), least, bits).select("size", "lang", "phrase", "n"))
    return written(out, "phrases")


def _run(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def scored_phrases(phrases: DataFrame, longest: int = 3, inside_percent: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score, dropped) of the phrases of two words and more among frequent_phrases().

    The score is floor(1000000 * a * a / (l * r)) of the cut with the lowest,
    the first such cut; dropped: inside a longer phrase that has inside_percent
    of its count.
    """
    words = F.split("phrase", " ")
    held = phrases.where("size > 1").withColumn("words", words)
    cuts = held.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", _run(F.lit(1), F.col("k")).alias("left"), _run(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    # a is at most l and r, so the quotient fits; the products have 38 digits
    cuts = cuts.withColumns({f"_{c}": v for c, v in exact.items()}).withColumn("score", F.expr("(cast(1000000 as decimal(7,0)) * (_a * _a)) div (_l * _r)"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    within = held.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    within = within.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    longer = within.select("lang", _run(F.col("i"), F.col("m")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    dropped = F.coalesce(F.col("longer") * 100 >= F.col("a") * inside_percent, F.lit(False))
    return lowest.join(longer, ["lang", "phrase"], "left").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", dropped.alias("dropped"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside_percent: int = 50, most: int = 2000, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` phrases of each language.

    Null texts are empty, a null lang is `und`; an empty lang is a language of
    its own. Repeated rows count as often as they come. Languages without a
    phrase have no rows, an empty table gives none; columns but doc_id, text and
    lang are not looked at, and doc_id only names rows for pointers.
    """
    narrow_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    phrases = frequent_phrases(docs, longest, least, bits)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = scored_phrases(phrases, longest, inside_percent).where(~F.col("dropped")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    totals = word_totals(_texts(docs))
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
