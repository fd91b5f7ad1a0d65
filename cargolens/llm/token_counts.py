"""Token counts without token ids: pieces once per distinct pre-token, joined to the pre-tokens' frequencies.

1. Every task counts the pre-tokens of its documents; their sums over the
   corpus are the distinct pre-tokens.
2. Each distinct pre-token is encoded once and only its number of pieces kept.
3. A document's pre-tokens with their frequencies meet those numbers. The
   commonest pre-tokens, a bounded number of them, travel to every task: they
   are the hot keys of the join and the larger part of its rows. All others
   are joined by hash, so no key holds many rows, and summed per document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.bpe import TOGETHER, opened
from cargolens.llm.common import batch_column, blocks, commonest, mixed, narrow_batches, written

#: The most pre-tokens that travel to every task; about 8 MB.
COMMON = 1 << 18
#: Distinct pre-tokens a task counts before it hands them on.
HELD = 400_000


def _split(path: str, texts: list[str]) -> Iterator[list[list[str]]]:
    own = opened(path)
    for start, part in blocks([t.encode("utf-8", "surrogatepass") for t in texts], TOGETHER):
        yield [own.split(t) for t in texts[start : start + len(part)]]


def frequencies(texts: DataFrame, path: str) -> DataFrame:
    """(piece, n): the distinct pre-tokens of all texts and how often each occurs."""

    def counted(batches):
        held: Counter[str] = Counter()

        def out():
            return pa.record_batch({"piece": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for split in _split(path, batch_column(batch, "text")):
                for tokens in split:
                    held.update(tokens)
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return texts.mapInArrow(counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _key(piece: str) -> int:
    return xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass")) - (1 << 63)


def piece_counts(pieces: DataFrame, path: str) -> DataFrame:
    """(key, piece, n, pieces): each distinct pre-token encoded once."""

    def encoded(batches):
        own = opened(path)
        for batch in batches:
            texts = batch_column(batch, "piece")
            plain = [t for t in texts if not t.startswith("\0") or t[1:] not in own.special]
            sizes = dict(zip(plain, map(len, own.merges.encode([t.encode("utf-8", "surrogatepass") for t in plain]))))
            yield pa.record_batch(
                {
                    "key": pa.array([_key(t) for t in texts], pa.int64()),
                    "piece": batch.column(0),
                    "n": batch.column(1),
                    "pieces": pa.array([sizes.get(t, 1) for t in texts], pa.int64()),
                }
            )

    return pieces.mapInArrow(encoded, "key long, piece string, n long, pieces long")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row.

    Null and empty texts have no bytes and no tokens. A repeated row is
    counted once and given back as often as it came; rows of one doc_id with
    different texts stay apart; a null doc_id is kept. An empty table gives an
    empty result; columns but doc_id and text are not looked at.
    """
    narrow_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = written(piece_counts(frequencies(texts.select("text"), path), path), "pieces")
    common = commonest(known, COMMON).select("piece", "pieces").toPandas()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(common["piece"], common["pieces"].tolist())))

    def by_document(batches):
        for batch in batches:
            table, place = shared.value, 0
            texts = batch_column(batch, "text")
            marks = batch.column(2).to_numpy().view(np.uint64)
            for split in _split(path, texts):
                doc, key, times, sums = [], [], [], []
                for i, tokens in enumerate(split, place):
                    total = 0
                    for t, n in Counter(tokens).items():
                        if (p := table.get(t)) is not None:
                            total += n * p
                        else:
                            doc.append(i)
                            key.append(_key(t))
                            times.append(n)
                    sums.append(total)
                mine = pa.array(np.arange(place, place + len(split)))
                rows = len(split)
                rare = pa.array(doc, pa.int64())
                take = pa.concat_arrays([mine, rare])
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).take(take),
                        "mark": batch.column(2).take(take),
                        "key": pa.concat_arrays([pa.array(mixed(np.arange(place, place + rows, dtype=np.uint64) + marks[place : place + rows]).view(np.int64)), pa.array(key, pa.int64())]),
                        "n": pa.concat_arrays([pa.array(sums, pa.int64()), pa.array(times, pa.int64())]),
                        "n_bytes": pa.concat_arrays([pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts[place : place + rows]], pa.int64()), pa.nulls(len(doc), pa.int64())]),
                    }
                )
                place += rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(by_document, f"doc_id {kind}, mark long, key long, n long, n_bytes long")
    joined = rows.join(known.select("key", "pieces"), "key", "left")
    # rows with bytes stand for a document and its common pre-tokens, under keys that only spread them; the others are rare pre-tokens
    summed = joined.groupBy("doc_id", "mark").agg(
        F.sum(F.col("n") * F.when(F.col("n_bytes").isNotNull(), 1).otherwise(F.col("pieces"))).alias("tokens"),
        F.max("n_bytes").alias("n_bytes"),
        F.count("n_bytes").alias("times"),
    )
    # a row that came m times was summed m times
    whole = summed.select("doc_id", "n_bytes", F.expr("tokens div times").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    return whole.drop("nth")


def over_limit(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; over_limit: more than `limit` tokens."""
    return token_counts(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
