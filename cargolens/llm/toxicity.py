"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every word, word beginning, pair of neighbours and pair with one word between
them is a binary feature in a fixed space of hash slots; beginnings stand for
the stems of words that take many endings. Training reads a bounded sample of
labelled rows (about `max_rows`, those with the smallest hashes of doc_id), each coordinate with
a learning rate of its own; the L1 term leaves most weights at nought. The
weights that remain go to all tasks: at most `2 ** bits` of them, so the
broadcast has a proven size.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from cargolens.llm.common import MIX_1, SIGNS, Words, as_bytes, blocks, chained, crc_mod, hashed_share, labelled, mixed, narrow_batches, separators

#: Hash slots are 2 ** BITS; 4 MB as 32-bit weights.
BITS = 20
#: About the largest number of labelled rows that training reads.
MAX_ROWS = 20_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 6.0, 1.0, 3
#: Bytes of the word beginnings that are features.
HEADS = (4, 6)

_TABLE = separators(SIGNS)


def slots_of(block: Words, bits: int = BITS) -> Iterator[np.ndarray]:
    """For each text of a block the distinct hash slots of its words, beginnings, pairs and skip-pairs."""
    heads = [mixed(block.heads(k) + np.uint64(k)) for k in HEADS]
    for a, b in zip(block.bounds[:-1], block.bounds[1:]):
        words = block.hashes[a:b]
        grams = [words, *(h[a:b] for h in heads), chained(words[:-1], words[1:]), chained(words[:-2] * MIX_1, words[2:])]
        yield np.unique((np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.uint32))


def _texts(series: pd.Series) -> list[bytes]:
    return [as_bytes(t) for t in series]


@F.pandas_udf(BinaryType())
def text_slots(texts: pd.Series) -> pd.Series:
    out = []
    for _, part in blocks(_texts(texts)):
        out += [s.tobytes() for s in slots_of(Words(part, _TABLE))]
    return pd.Series(out, index=texts.index, dtype=object)


def fit_ftrl(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights by slot and the intercept (not penalised) from binary rows, in the order given."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = np.zeros(2)  # z and n of the intercept

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for x, target in zip(rows, y):
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            b = -bias[0] * alpha / (beta + np.sqrt(bias[1]))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - target
            grown = np.sqrt(ni + g * g)
            z[x] = zi + g - (grown - np.sqrt(ni)) / alpha * w
            n[x] = ni + g * g
            step = (np.sqrt(bias[1] + g * g) - np.sqrt(bias[1])) / alpha
            bias += (g - step * b, g * g)
    return weights(z, n), float(-bias[0] * alpha / (beta + np.sqrt(bias[1])))


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Weights and intercept from about max_rows labelled rows outside fold 0, or all when there are fewer.

    Without labelled rows, or with one class only, all weights are nought and
    the intercept is that of the smoothed share of toxic rows.
    """
    narrow_batches(docs.sparkSession)
    known = labels.select("doc_id", "toxic").where((crc_mod("doc_id", 5) != 0) & F.col("doc_id").isNotNull())
    found = labelled(docs, F.broadcast(hashed_share(known, "doc_id", max_rows)), "toxic")

    def one_task(groups):
        parts = list(groups)
        pdf = pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "y": [], "slots": []})
        pdf = pdf.sort_values("doc_id", kind="stable")
        y = pdf["y"].to_numpy(dtype=float)
        rows = [np.frombuffer(b, dtype=np.uint32) for b in pdf["slots"]]
        if len(set(y)) < 2:
            w, b = np.zeros(0), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        else:
            order = np.random.default_rng(5).permutation(len(y))
            w, b = fit_ftrl([rows[i] for i in order], y[order], bits)
        kept = np.flatnonzero(w)
        yield pd.DataFrame({"slot": np.concatenate([[-1], kept]), "weight": np.concatenate([[b], w[kept]])})

    learned = found.select("doc_id", "y", text_slots("text").alias("slots")).repartition(1).mapInPandas(one_task, "slot long, weight double").toPandas()
    weights = np.zeros(1 << bits, dtype=np.float32)
    own = learned[learned.slot >= 0]
    weights[own.slot.to_numpy(dtype=np.int64)] = own.weight.to_numpy()
    return weights, float(learned[learned.slot < 0].weight.sum())


def scorer(spark: SparkSession, model: tuple[np.ndarray, float], bits: int = BITS):
    """A column function: the probability that a text is toxic; null and empty texts have the intercept's."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def toxicity(texts: pd.Series) -> pd.Series:
        weights, bias = shared.value
        out = np.zeros(len(texts))
        for start, part in blocks(_texts(texts)):
            for i, slots in enumerate(slots_of(Words(part, _TABLE), bits)):
                out[start + i] = weights[slots].sum(dtype=np.float64) + bias
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))), index=texts.index)

    return toxicity


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts get the score of the intercept; repeated rows equal
    scores; a null doc_id is scored like any other. Only `text` enters a score.
    An empty table gives an empty result.
    """
    toxicity = scorer(docs.sparkSession, train(docs, labels))
    rows = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), toxicity("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
