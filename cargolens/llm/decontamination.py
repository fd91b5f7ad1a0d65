"""Benchmark passages in documents, by a positional inverted index.

The test items are taken in blocks of bounded size. For each block

1. the corpus frequencies of its terms are counted over all documents;
2. of every window of an item the ANCHORS rarest terms are chosen, and the
   postings of those terms are stored: (document, term, positions), beside
   each document's length;
3. the lists are intersected: a posting less the term's offset in its item is
   a shift, and a shift on which enough anchors of an item agree is a place
   where the item may stand;
4. each such place is compared word by word with the item. Runs of equal words
   as long as a window are phrase matches, to the last word.

Documents that hold no such place are not read again beyond a filter of fixed
size over their keys.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cargolens.llm.common import SIGNS, Words, as_bytes, batch_column, blocks, key_filter, narrow_batches, separators, text_blocks, written

WINDOW, ANCHORS = 13, 3
#: Words of the test items that are worked on together; their terms and anchors go to all tasks.
BLOCK_WORDS = 1_000_000

_TABLE = separators(SIGNS)


@dataclass
class Items:
    """A block of test items: ids, word hashes end to end with bounds, and the distinct terms, sorted."""

    ids: list[str]
    words: np.ndarray
    bounds: np.ndarray
    terms: np.ndarray

    def item(self, i: int) -> np.ndarray:
        return self.words[self.bounds[i] : self.bounds[i + 1]]


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS):
    """The items in blocks of about `limit` words; items without id or words are left out."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(total // (4 * limit)) + 1
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        if own:
            found = [(r["item_id"], w) for _, part in blocks([as_bytes(r["text"]) for r in own], 1 << 30) for r, w in zip(own, Words(part, _TABLE).each()) if len(w)]
            if found:
                words = [w for _, w in found]
                yield Items([i for i, _ in found], np.concatenate(words), np.cumsum([0, *map(len, words)]), np.unique(np.concatenate(words)))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): mark tells texts of one id apart; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))


def _places(words: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """For each word its place among the sorted terms, -1 for other words."""
    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    return np.where(terms[at] == words, at, -1)


def term_frequencies(docs: DataFrame, items: Items) -> np.ndarray:
    """How often each term of the block occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items.terms)

    def counted(batches):
        held = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for _, part in text_blocks(batch):
                at = _places(Words(part, _TABLE).hashes, shared.value)
                held += np.bincount(at[at >= 0], minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.record_batch({"term": pa.array(some, pa.int64()), "n": pa.array(held[some])})

    rows = docs.select("text").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(items.terms), dtype=np.int64)
    out[rows["term"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def anchors(items: Items, frequency: np.ndarray, window: int = WINDOW, each: int = ANCHORS) -> pd.DataFrame:
    """(term, item, at, need): the rarest terms of every window that can occur, and how many of an item's anchors must agree."""
    out = []
    for i in range(len(items.ids)):
        words = items.item(i)
        size = min(window, len(words))
        often = frequency[np.searchsorted(items.terms, words)]
        order = np.lexsort((np.arange(len(words)), often))
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        chosen: set[int] = set()
        for start in range(len(words) - size + 1):
            if often[start : start + size].min() > 0:
                chosen.update((start + np.argsort(rank[start : start + size], kind="stable")[: min(each, size)]).tolist())
        out += [(int(np.searchsorted(items.terms, words[at])), i, at, min(each, size)) for at in sorted(chosen)]
    return pd.DataFrame(out, columns=["term", "item", "at", "need"])


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, mark, term, positions): the index of `terms` (sorted hashes) over keyed documents.

    term is the place among `terms`. Under term -1 every document, words or
    none, has one row with its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def listed(batches):
        for batch in batches:
            for start, part in text_blocks(batch):
                block = Words(part, _TABLE)
                at = _places(block.hashes, shared.value) if len(shared.value) else np.full(len(block.hashes), -1)
                hit = np.flatnonzero(at >= 0)
                doc = np.searchsorted(block.bounds, hit, side="right") - 1
                order = np.lexsort((hit, at[hit], doc))
                hit, doc = hit[order], doc[order]
                term, position = at[hit], hit - block.bounds[doc]
                new = np.ones(len(hit), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
                starts = np.flatnonzero(new)
                docs_of = np.concatenate([np.arange(len(part)), doc[starts]])
                lengths = np.diff(block.bounds)
                offsets = np.concatenate([np.arange(len(part) + 1), len(part) + np.concatenate([starts[1:], [len(hit)]]) if len(starts) else []]).astype(np.int32)
                take = pa.array(start + docs_of)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).take(take),
                        "mark": batch.column(1).take(take),
                        "term": pa.array(np.concatenate([np.full(len(part), -1), term[starts]]).astype(np.int32)),
                        "positions": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([lengths, position]).astype(np.int32))),
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(listed, f"doc_id {kind}, mark long, term int, positions array<int>")


def shifts(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, mark, item, shift) on which enough anchors agree. chosen is bounded by the block and goes to all tasks."""
    met = index.where("term >= 0").join(F.broadcast(chosen), "term")
    moved = met.select("doc_id", "mark", "item", "at", "need", F.explode("positions").alias("position")).withColumn("shift", F.col("position") - F.col("at"))
    agreed = moved.groupBy("doc_id", "mark", "item", "shift").agg(F.size(F.collect_set("at")).alias("n"), F.max("need").alias("need"))
    return agreed.where("n >= need").select("doc_id", "mark", "item", "shift")


def matched_spans(document: np.ndarray, item: np.ndarray, shift: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of the document, end excluded, where it has a window of the item at this shift."""
    size = min(window, len(item))
    low, high = max(0, shift), min(len(document), shift + len(item))
    if high - low < size:
        return []
    same = np.concatenate([[0], (document[low:high] == item[low - shift : high - shift]).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(same))
    return [(int(low + a), int(low + b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= size]


def _verified(places: DataFrame, docs: DataFrame, items: Items, window: int) -> DataFrame:
    """(doc_id, mark, item_id, spans) of the places that hold."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    by_doc = places.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("item", "shift")).alias("places"))
    wanted = docs.where(key_filter(places, F.col("mark"))(F.col("mark")))
    # joined after a shuffle of what the filter leaves, so that no task runs two Python functions at once
    both = wanted.join(by_doc.hint("merge"), wanted["doc_id"].eqNullSafe(by_doc["doc_id"]) & (wanted["mark"] == by_doc["mark"])).select(wanted["doc_id"], wanted["mark"], "text", "places")

    def compared(batches):
        own = shared.value
        for batch in batches:
            rows, ids, spans = [], [], []
            found = batch_column(batch, "places")
            for start, part in text_blocks(batch):
                for i, words in enumerate(Words(part, _TABLE).each(), start):
                    by_item: dict[str, list[tuple[int, int]]] = {}
                    for place in found[i]:
                        if held := matched_spans(words, own.item(place["item"]), place["shift"], window):
                            by_item.setdefault(own.ids[place["item"]], []).extend(held)
                    for name, held in by_item.items():
                        rows.append(i)
                        ids.append(name)
                        spans.append([{"start": a, "end": b} for a, b in sorted(set(held))])
            take = pa.array(rows, pa.int64())
            yield pa.record_batch({"doc_id": batch.column(0).take(take), "mark": batch.column(1).take(take), "item_id": pa.array(ids, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(compared, f"doc_id {kind}, mark long, item_id string, spans array<struct<start:int,end:int>>")


def phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Exact matches (doc_id, mark, item_id, spans), and every document's length (doc_id, mark, n_words). docs: keyed()."""
    hits = lengths = None
    for items in item_blocks(benchmark):
        chosen = anchors(items, term_frequencies(docs, items), window)
        used = np.unique(chosen["term"].to_numpy(dtype=np.int64))
        index = written(postings(docs, items.terms[used]), "postings")
        if lengths is None:
            lengths = index
        if len(chosen):
            rows = docs.sparkSession.createDataFrame(chosen.assign(term=np.searchsorted(used, chosen["term"])).astype("int32"), "term int, item int, at int, need int")
            found = _verified(written(shifts(index, rows), "shifts"), docs, items, window)
            hits = found if hits is None else hits.unionByName(found)
    if lengths is None:
        lengths = postings(docs, np.zeros(0, dtype=np.uint64))
    if hits is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        hits = docs.sparkSession.createDataFrame([], f"doc_id {kind}, mark long, item_id string, spans array<struct<start:int,end:int>>")
    return hits, lengths.where("term = -1").select("doc_id", "mark", F.col("positions")[0].cast("long").alias("n_words"))


def smallest_cover(lists: list[np.ndarray], first: int) -> tuple[int, int]:
    """Of the spans from `first` on that hold a position of every list, the shortest; end before start when there is none."""
    after = [x[i] if (i := np.searchsorted(x, first)) < len(x) else -1 for x in lists]
    return (first, int(max(after))) if min(after) >= 0 else (first, first - 1)


def _near_spans(shared, within: int):
    def spans(key, pdf):
        ids, windows = shared.value
        lists = {int(t): np.sort(np.concatenate(list(p))) for t, p in pdf.groupby("term")["positions"]}
        out = set()
        for i, at, terms in windows:
            if terms and all(t in lists for t in terms):
                own = [lists[t] for t in terms]
                # a shortest span begins at a position of one of the terms
                for first in np.unique(np.concatenate(own)).tolist():
                    start, end = smallest_cover(own, first)
                    if start <= end < start + within:
                        out.add((key[0], ids[i], at, start, end + 1))
        # spans that hold a shorter one of the same window say nothing more
        kept = [x for x in out if not any(y != x and y[1:3] == x[1:3] and x[3] <= y[3] and y[4] <= x[4] for y in out)]
        return pd.DataFrame(sorted(kept), columns=["doc_id", "item_id", "at", "start", "end"])

    return spans


def near(docs: DataFrame, benchmark: DataFrame, within: int = 2 * WINDOW, window: int = WINDOW) -> DataFrame:
    """Proximity matches (doc_id, item_id, at, start, end): shortest spans, of at most `within` words, that hold all anchors of the item's window at offset `at`, in any order."""
    narrow_batches(docs.sparkSession)
    docs, found = keyed(docs), None
    for items in item_blocks(benchmark):
        chosen = anchors(items, term_frequencies(docs, items), window)
        used = np.unique(chosen["term"].to_numpy(dtype=np.int64))
        of_window = [
            (i, start, sorted({int(np.searchsorted(used, t)) for t in chosen[(chosen["item"] == i) & chosen["at"].between(start, start + window - 1)]["term"]}))
            for i in sorted(set(chosen["item"]))
            for start in range(max(1, len(items.item(i)) - window + 1))
        ]
        spans = _near_spans(docs.sparkSession.sparkContext.broadcast((items.ids, of_window)), within)
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = written(postings(docs, items.terms[used]), "postings").where("term >= 0").groupBy("doc_id", "mark").applyInPandas(spans, f"doc_id {kind}, item_id string, at int, start int, end int")
        found = rows if found is None else found.unionByName(rows)
    return found


@F.pandas_udf(LongType())
def _covered(spans: pd.Series) -> pd.Series:
    """Words inside at least one of the spans."""
    out = []
    for own in spans:
        n, reached = 0, -1
        for a, b in sorted((s["start"], s["end"]) for s in own):
            n += max(0, b - max(a, reached))
            reached = max(reached, b)
        out.append(n)
    return pd.Series(out, index=spans.index, dtype="int64")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """marked_contamination() without the mark: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    return marked_contamination(docs, benchmark).drop("mark")


def marked_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated) of every row.

    Null and empty texts have no words and no hits; repeated rows get equal
    results; a null doc_id is kept. Items that share an id count as one; items
    without id or words are not looked for. An empty benchmark hits nothing,
    an empty table of documents gives an empty result. Columns but doc_id and
    text are not looked at.
    """
    narrow_batches(docs.sparkSession)
    rows = keyed(docs)
    hits, lengths = phrases(rows, benchmark)
    by_doc = hits.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    by_doc = by_doc.select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), _covered("spans").alias("hit"), F.size("items").alias("found"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("sha"))
    both = lengths.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")), "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return both.select(
        "doc_id",
        "mark",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("found", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
