"""What the operators share: written tables, labelled rows, block-wise word hashes."""

from __future__ import annotations

import uuid
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cargolens.session import work_dir

MASK = 0xFFFFFFFFFFFFFFFF
#: Bytes of text hashed at once; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 18
MIX_1, MIX_2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between Spark and Python. Rows here hold whole texts, so ten thousand rows would be a lot.
ARROW_BYTES = 8 << 20


def narrow_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ARROW_BYTES; every operator calls it before it reads texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own for every call, in the folder all executors share."""
    return f"{work_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int = 5) -> DataFrame:
    """(doc_id, text, y) of the rows that may be learned from: labelled and not in fold 0.

    Null texts count as empty, rows without id or label are left out, and an
    id that is labelled twice counts with its larger label.
    """
    own = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("y"))
        .where("doc_id is not null and y is not null")
        .where(crc_mod("doc_id", folds) != 0)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(own, "doc_id")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def chained(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its beginning and that of its last word."""
    return mixed(left * STEP + right)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, MASK, 256, dtype=np.uint64, endpoint=True)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        base = 0xD6E8FEB86659FD93
        with np.errstate(over="ignore"):
            for name, x in (("up", base), ("down", pow(base, -1, 1 << 64))):
                steps = np.full(max(n, BLOCK_BYTES) + 1, x, dtype=np.uint64)
                steps[0] = 1
                _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def separators(ranges: list[tuple[int, int]], lower: bool = True) -> bytes:
    """A byte table that turns bytes in the ranges to blanks, and A-Z to a-z when asked."""
    out = bytearray(range(256))
    for i in range(256):
        if any(a <= i <= b for a, b in ranges):
            out[i] = 32
        elif lower and 65 <= i <= 90:
            out[i] = i + 32
    return bytes(out)


#: Words are runs of anything but these bytes.
BLANKS = [(0x20, 0x20), (0x09, 0x0D)]
#: Words are runs of ASCII letters and digits and of all other code points from 0x80 on.
SIGNS = [(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class Words:
    """Word hashes of a block of texts: `hashes` in order, text i owns bounds[i]:bounds[i + 1].

    starts and ends are byte positions in `data`, the texts after the byte
    table, with one blank behind each text.
    """

    __slots__ = ("_down", "_total", "bounds", "data", "ends", "hashes", "starts")

    def __init__(self, texts: list[bytes], byte_table: bytes):
        joined = b" ".join([*texts, b""]).translate(byte_table)
        data = np.frombuffer(joined, dtype=np.uint8)
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = data != 32
        edges = np.diff(inside)
        self.data, self.starts, self.ends = joined, np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.bounds = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        up, self._down = _powers(len(data))
        with np.errstate(over="ignore"):
            values = _byte_values()[data]
            values *= up[: len(data)]
            self._total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(values, out=self._total[1:])
        self.hashes = self._spans(self.ends)

    def _spans(self, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self._total[ends] - self._total[self.starts]) * self._down[self.starts])

    def heads(self, size: int) -> np.ndarray:
        """Hashes of the words' first `size` bytes."""
        return self._spans(np.minimum(self.ends, self.starts + size))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def each(self) -> Iterator[np.ndarray]:
        for a, b in zip(self.bounds[:-1], self.bounds[1:]):
            yield self.hashes[a:b]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts of about `limit` bytes, with the place of their first."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, texts[start:]


def text_blocks(batch, limit: int = BLOCK_BYTES, column: str = "text") -> Iterator[tuple[int, list[bytes]]]:
    """The texts of an Arrow batch as bytes in runs of about `limit` bytes, with the place of their first; nulls are empty.

    Few rows at a time leave Arrow's memory, so a large batch is not held twice.
    """
    values = batch.column(batch.schema.get_field_index(column))
    start, size, held = 0, 0, []
    for a in range(0, len(values), 256):
        for text in values.slice(a, 256).cast("binary").to_pylist():
            text = text or b""
            if held and size + len(text) > limit:
                yield start, held
                start, size, held = start + len(held), 0, []
            held.append(text)
            size += len(text) + 1
    if held:
        yield start, held
    pa.default_memory_pool().release_unused()


def batch_column(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: Buckets of a key filter, each a bitmap of 4 KB: 8 MB in all.
FILTER_BUCKETS = 2048


def key_bits(rows: DataFrame, key: Column) -> dict[int, np.ndarray]:
    """A bitmap of fixed size in which every 64-bit key that occurs in rows is marked, and few others are.

    With more keys it marks more others, so a join must still follow.
    """
    bits = F.pmod(key, F.lit(FILTER_BUCKETS * 32768))
    maps = rows.select(bits.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    return {r["bucket"]: np.frombuffer(bytes(r["bits"]), dtype=np.uint8) for r in maps.toLocalIterator()}


def marked(bits: dict[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Which keys are marked in key_bits()."""
    at = np.mod(keys, FILTER_BUCKETS * 32768)
    # as the built-in functions count: bit 0 lies in bucket 0, from 1 on buckets count up
    bucket, place = np.where(at > 0, 1 + (at - 1) // 32768, 0), np.where(at > 0, (at - 1) % 32768, 0)
    out = np.zeros(len(at), dtype=bool)
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    for b, own in zip(names.tolist(), np.split(order, starts[1:])):
        if (held := bits.get(b)) is not None:
            out[own] = held[place[own] // 8] >> (place[own] % 8) & 1 == 1
    return out


def key_filter(rows: DataFrame, key: Column):
    """A column function that is true for every 64-bit key that occurs in rows, and for few others."""
    shared = rows.sparkSession.sparkContext.broadcast(key_bits(rows, key))

    @F.pandas_udf(BooleanType())
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(marked(shared.value, keys.to_numpy(dtype=np.int64)), index=keys.index)

    return maybe


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (a column n, above 0) with the largest n, `most` of them at the most.

    Decided on a histogram in steps of a thirty-second of a doubling, so rows
    of like counts go or stay together and no task sorts or sends more than is kept.
    """
    step = F.floor(F.log2("n") * 32)
    found = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).toPandas()
    kept = found["step"][found["count"].cumsum() <= most]
    return counts.where(step >= F.lit(int(kept.min()) if len(kept) else 1 << 20))


def hashed_share(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows, those whose key has the smallest MD5; all when there are no more than that."""
    total = rows.count()
    place = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("double")
    return rows if total <= most else rows.where(place < F.lit(most / total * 2.0**32))
