"""Quality by compression: which of two zstandard dictionaries packs a text better.

One dictionary is trained on a bounded sample of good labelled texts, one on
bad ones (about `max_rows` of each, those with the smallest hashes of doc_id). A text is cut
into pieces of equal size, all of it, and each piece is packed with either
dictionary; the difference of the packed sizes over the text's length is one
number that does not depend on how long the text is. A logistic curve fitted to
labelled rows that no dictionary has seen turns it into a probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cargolens.llm.common import as_bytes, crc_mod, hashed_share, labelled, narrow_batches

#: About so many labelled rows of each class at most that go into a dictionary, and as many again that calibrate.
MAX_ROWS = 1000
DICTIONARY_BYTES = 112 * 1024
#: Bytes of a piece, and the compression level.
PIECE, LEVEL = 256, 3
#: Fewer sample bytes than this and a dictionary is the samples themselves.
LEAST_BYTES = 1 << 20


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary for texts of this kind; of few texts it is their own bytes."""
    samples = [p for t in texts for p in pieces(t)]
    if sum(map(len, samples)) >= LEAST_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            pass  # too uniform to train on
    return b"".join(samples)[-DICTIONARY_BYTES:]


class Packers:
    """The two compressors; a raw or empty dictionary serves as well as a trained one."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = self._packer(good), self._packer(bad)

    @staticmethod
    def _packer(content: bytes) -> zstandard.ZstdCompressor:
        plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        if len(content) < 8:
            return zstandard.ZstdCompressor(**plain)
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(LEVEL)
        return zstandard.ZstdCompressor(dict_data=held, **plain)

    def difference(self, text: bytes) -> float:
        """Packed size under the bad dictionary less that under the good one, over the length; 0 for empty texts."""
        good, bad = self.good.compress, self.bad.compress
        return sum(len(bad(p)) - len(good(p)) for p in pieces(text)) / max(1, len(text))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Centre, slope and intercept of a logistic curve by Newton's method with a weak prior; one class alone gives its smoothed share."""
    centre = float(x.mean()) if len(x) else 0.0
    if len(set(y)) < 2:
        return centre, 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    scale = float(x.std()) or 1.0
    design = np.stack([(x - centre) / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        gradient = design.T @ (p - y) + 0.1 * beta
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), gradient)
        beta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return centre, float(beta[0]) / scale, float(beta[1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[bytes, bytes, tuple[float, float, float]]:
    """Two dictionaries and the curve, from about 2 * max_rows good and as many bad rows outside fold 0.

    Of each class, every second row by the hash of its id goes into the
    dictionary and the others calibrate. The curve is weighted back to the
    classes' true shares.
    """
    narrow_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(crc_mod("doc_id", 5) != 0).dropDuplicates(["doc_id"])
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = [hashed_share(known.where(F.col("quality") == v), "doc_id", 2 * max_rows) for v in (1.0, 0.0)]
    sample = labelled(docs, F.broadcast(chosen[0].unionAll(chosen[1])), "quality")
    rows = sorted((r["y"], r["doc_id"], as_bytes(r["text"])) for r in sample.toLocalIterator())
    side = {v: [t for y, _, t in rows if y == v] for v in (1.0, 0.0)}
    good, bad = dictionary(side[1.0][::2]), dictionary(side[0.0][::2])
    packers = Packers(good, bad)
    fresh = {v: side[v][1::2] for v in side}
    x = np.array([packers.difference(t) for v in (1.0, 0.0) for t in fresh[v]])
    y = np.array([v for v in (1.0, 0.0) for _ in fresh[v]])
    centre, slope, bias = fit_curve(x, y)
    if slope:
        bias += np.log(shares[1.0] / shares[0.0]) - np.log(len(fresh[1.0]) / len(fresh[0.0]))
    return good, bad, (centre, slope, bias)


def scorer(spark: SparkSession, model: tuple[bytes, bytes, tuple[float, float, float]]):
    """A column function: the probability that a text is good. The model is two dictionaries of 112 KB at most."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def quality(texts: pd.Series) -> pd.Series:
        good, bad, (centre, slope, bias) = shared.value
        packers = Packers(good, bad)
        x = np.array([packers.difference(as_bytes(t)) for t in texts], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * (x - centre) + bias, -35, 35))), index=texts.index)

    return quality


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts differ by nothing and get the curve's value at 0;
    repeated rows equal scores; a null doc_id is scored like any other. Only
    `text` enters a score. An empty table gives an empty result.
    """
    quality = scorer(docs.sparkSession, train(docs, labels))
    rows = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), quality("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
