"""Near-duplicate documents by a join of MinHash signatures, coordinate by coordinate.

1. Every document becomes the set of hashes of its word shingles; equal sets
   are one class from here on, however many copies there are.
2. A class has COORDINATES minimum hashes. Two classes at the similarity
   wanted agree in at least `needed` of them but for a chance of about one in
   a million, so they share one of the COORDINATES - needed + 1 coordinate
   values that are rarest in a common order: only those are posted. A fixed
   table of counts tells which values are common.
3. Classes that share a posted value meet there. Within such a list the equal
   coordinates of each pair are counted, and a pair goes on from the list of
   its first shared value only, so it goes on once. A long list is dealt over
   several tasks, each of which holds two parts of it.
4. Pairs with enough equal coordinates are checked on their full sets. Each
   list gives links enough to connect what is linked in it, not all pairs.
5. Linked classes are joined to components; the smallest doc_id names one.

No pair at or above the similarity is skipped by a cap: long lists are split,
never cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import BLANKS, STEP, Words, batch_column, chained, key_bits, marked, mixed, narrow_batches, separators, text_blocks, written

COORDINATES = 64
#: Slots of the table of counts, and members of a list that one task compares among themselves.
COUNT_SLOTS, PART = 1 << 16, 1000
_TABLE = separators(BLANKS)
_FACTORS = np.random.default_rng(77).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def needed_matches(percent: int) -> int:
    """Equal coordinates that all but about a millionth of the pairs at this similarity have."""
    s = percent / 100
    return max(1, math.floor(COORDINATES * s - 4.75 * math.sqrt(COORDINATES * s * (1 - s))))


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; with fewer words the one hash of them all."""
    block = Words(texts, _TABLE)
    for words in block.each():
        grams = words[: max(1, len(words) - size + 1)] if len(words) else words
        for k in range(1, min(size, len(words))):
            grams = chained(grams, words[k : k + len(grams)])
        yield np.unique(grams)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minimum hashes of each set; none may be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat((flat * factor) >> np.uint64(32), starts)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, mark, n, fp, sig) of every row: hash of the text, size of the set, its fingerprint and minimum hashes; both null for an empty set."""

    def made(batches):
        for batch in batches:
            for start, part in text_blocks(batch):
                sets = list(shingle_sets(part, size))
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signature([sets[i] for i in full]) if full else []
                fps: list[bytes | None] = [None] * len(part)
                sigs: list[bytes | None] = [None] * len(part)
                for i, s in zip(full, sig):
                    fps[i], sigs[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), s.tobytes()
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(start, len(part)),
                        "mark": batch.column(1).slice(start, len(part)),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "fp": pa.array(fps, pa.binary()),
                        "sig": pa.array(sigs, pa.binary()),
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(made, f"doc_id {kind}, mark long, n long, fp binary, sig binary")


def _tokens(sig: np.ndarray) -> np.ndarray:
    """One number for each coordinate and its value."""
    return mixed(sig.astype(np.uint64) | np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(48)).astype(np.int64) % COUNT_SLOTS


def _ranks(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of each token in the common order, rare ones first."""
    often = np.minimum(counts[_slots(tokens)], (1 << 24) - 1).astype(np.uint64)
    return often << np.uint64(40) | (tokens * STEP) >> np.uint64(24)


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(len(sigs), COORDINATES)


def value_counts(classes: DataFrame) -> np.ndarray:
    """How often coordinate values fall into each slot of a table of fixed size."""

    def counted(batches):
        held = np.zeros(COUNT_SLOTS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                held += np.bincount(_slots(_tokens(_matrix(batch_column(batch, "sig")))).ravel(), minlength=COUNT_SLOTS)
        some = np.flatnonzero(held)
        yield pa.record_batch({"slot": pa.array(some, pa.int64()), "n": pa.array(held[some])})

    rows = classes.select("sig").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNT_SLOTS, dtype=np.int64)
    out[rows["slot"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def _prefix(sig: np.ndarray, counts: np.ndarray, posted: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and their ranks, with the greatest number for those that aren't posted."""
    tokens = _tokens(sig)
    ranks = _ranks(tokens, counts)
    limit = np.partition(ranks, posted - 1, axis=1)[:, posted - 1 : posted]
    return tokens, np.where(ranks <= limit, ranks, np.uint64(0xFFFFFFFFFFFFFFFF))


def postings(classes: DataFrame, counts: np.ndarray, posted: int) -> DataFrame:
    """(token, fp, n, sig): each class under the posted values that another class has as well."""
    spark = classes.sparkSession
    shared_counts = spark.sparkContext.broadcast(counts)

    def tokens_only(batches):
        for batch in batches:
            if batch.num_rows:
                tokens, ranks = _prefix(_matrix(batch_column(batch, "sig")), shared_counts.value, posted)
                yield pa.record_batch({"token": pa.array(tokens[ranks != np.uint64(0xFFFFFFFFFFFFFFFF)].view(np.int64))})

    lists = written(classes.select("sig").mapInArrow(tokens_only, "token long").groupBy("token").count().where("count > 1"), "lists")
    shared_bits = spark.sparkContext.broadcast(key_bits(lists, F.col("token")))

    def full(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                tokens, ranks = _prefix(_matrix(batch_column(part, "sig")), shared_counts.value, posted)
                row, column = np.nonzero(ranks != np.uint64(0xFFFFFFFFFFFFFFFF))
                own = tokens[row, column].view(np.int64)
                kept = marked(shared_bits.value, own)
                take = pa.array(row[kept])
                yield pa.record_batch({"token": pa.array(own[kept]), **{c: part.column(part.schema.get_field_index(c)).take(take) for c in ("fp", "n", "sig")}})

    rows = classes.select("fp", "n", "sig").mapInArrow(full, "token long, fp binary, n long, sig binary")
    long = written(lists.where(F.col("count") > PART).select("token", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "long-lists")
    dealt = rows.join(long, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # a list of several parts goes to one task for each two of them
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("token", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "fp", "n", "sig").withColumn("grp", F.xxhash64("token", "low", "high"))


def grouped(batches, key: str, handle: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Runs `handle` over the rows of each key; rows come sorted by key, a key's rows may lie in several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != int(keys[a]):
                if (out := handle(pa.Table.from_batches(held))) is not None:
                    yield out
                held = []
            held.append(batch.slice(a, b - a))
    if held and (out := handle(pa.Table.from_batches(held))) is not None:
        yield out


def candidate_pairs(sig: np.ndarray, n: np.ndarray, part: np.ndarray, token: np.int64, counts: np.ndarray, posted: int, needed: int, percent: int, across: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each member the later members with enough equal coordinates, a like size, and this value as the first they share."""
    tokens, ranks = _prefix(sig, counts, posted)
    mine = np.uint64(ranks[tokens.view(np.int64) == token].min())
    for i in range(len(sig) - 1):
        rest = slice(i + 1, None)
        like = 100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest])
        if across:
            like &= part[rest] != part[i]
        near = i + 1 + np.flatnonzero(like)
        equal = sig[near] == sig[i]
        enough = equal.sum(axis=1) >= needed
        near, equal = near[enough], equal[enough]
        if len(near):
            first = np.where(equal, np.maximum(ranks[near], ranks[i]), np.uint64(0xFFFFFFFFFFFFFFFF)).min(axis=1)
            near = near[first == mine]
            if len(near):
                yield i, near


def candidates(dealt: DataFrame, counts: np.ndarray, posted: int, needed: int, percent: int) -> DataFrame:
    """(grp, fp, others): every class that has a candidate in its list, with those of them that it is compared to."""
    shared = dealt.sparkSession.sparkContext.broadcast(counts)

    def one(rows: pa.Table) -> pa.RecordBatch | None:
        # a class that came twice counts once
        fps = rows.column("fp").to_pylist()
        place = sorted({fp: i for i, fp in enumerate(fps)}.values())
        if len(place) < 2:
            return None
        rows, fps = rows.take(place), [fps[i] for i in place]
        n, part = rows.column("n").to_numpy(), rows.column("part").to_numpy()
        across = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
        token = np.int64(rows.column("token")[0].as_py())
        found = dict(candidate_pairs(_matrix(rows.column("sig").to_pylist()), n, part, token, shared.value, posted, needed, percent, across))
        if not found:
            return None
        own = sorted({i for i in found} | {int(j) for js in found.values() for j in js})
        return pa.record_batch(
            {
                "grp": pa.array([rows.column("grp")[0].as_py()] * len(own), pa.int64()),
                "fp": pa.array([fps[i] for i in own], pa.binary()),
                "others": pa.array([[fps[j] for j in found.get(i, ())] for i in own], pa.list_(pa.binary())),
            }
        )

    lists = dealt.repartition("grp").sortWithinPartitions("grp", "fp")
    return lists.mapInArrow(lambda batches: grouped(batches, "grp", one), "grp long, fp binary, others array<binary>")


def linked_pairs(sets: list[np.ndarray], others: list[list[int]], percent: int) -> list[tuple[int, int]]:
    """Pairs at the similarity, enough of them to connect all that are linked."""
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, js in enumerate(others):
        js = [j for j in js if top(i) != top(j)]
        if not js:
            continue
        own, sizes = sets[i], [len(sets[j]) for j in js]
        flat = np.concatenate([sets[j] for j in js])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        shared = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum([0, *sizes[:-1]]))
        for j, size, both in zip(js, sizes, shared.tolist()):
            if 100 * both >= percent * (len(own) + size - both) and top(i) != top(j):
                root[top(i)] = top(j)
                out.append((i, j))
    return out


def links(found: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): fingerprints of linked classes, from the candidates checked on their full sets."""
    wanted = classes.join(found.select("fp").distinct(), "fp", "left_semi").select("id")
    shared = docs.sparkSession.sparkContext.broadcast(key_bits(wanted, F.xxhash64("id")))

    def full(batches):
        # the filter runs here and not as a function of its own, which would take a second Python process a task
        for batch in batches:
            own = marked(shared.value, batch.column(0).to_numpy())
            for _, part in text_blocks(batch.filter(pa.array(own)).select(["text"])):
                sets = [s for s in shingle_sets(part, size) if len(s)]
                yield pa.record_batch({"fp": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), "members": pa.array([s.tobytes() for s in sets], pa.binary())})

    sets = docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(full, "fp binary, members binary")

    def one(rows: pa.Table) -> pa.RecordBatch | None:
        fps = rows.column("fp").to_pylist()
        place = {fp: i for i, fp in enumerate(fps)}
        names = sorted(place)
        at = {fp: k for k, fp in enumerate(names)}
        members, others = rows.column("members"), rows.column("others")
        found = linked_pairs([np.frombuffer(members[place[fp]].as_py(), dtype=np.uint64) for fp in names], [[at[o] for o in others[place[fp]].as_py()] for fp in names], percent)
        return pa.record_batch({"a": pa.array([names[i] for i, _ in found], pa.binary()), "b": pa.array([names[j] for _, j in found], pa.binary())})

    both = found.join(sets, "fp").repartition("grp").sortWithinPartitions("grp", "fp")
    return both.mapInArrow(lambda batches: grouped(batches, "grp", one), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the edges (a, b); written.

    In turns every node's larger neighbours, then its smaller ones, are hung on
    its smallest neighbour, until nothing moves.
    """
    edges = written(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low <> high").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high"))).withColumnsRenamed({"low": "node", "high": "next"})
        least = both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("least"))
        # larger neighbours go to the smallest node around
        large = both.join(least, "node").where("next > node").select(F.col("least").alias("low"), F.col("next").alias("high")).where("low <> high").distinct()
        large = written(large, "edges")
        # then a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        moved = large.join(least, "high")
        small = moved.select(F.col("least").alias("low"), F.col("low").alias("high")).unionByName(moved.select(F.col("least").alias("low"), "high")).where("low <> high").distinct()
        edges = written(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """marked_duplicates() without mark and linked: (doc_id, n_shingles, component_id, kept) of every row."""
    return marked_duplicates(docs, size, percent).drop("mark", "linked")


def marked_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, mark, linked, n_shingles, component_id, kept) of every row.

    mark is xxhash64 of the text. linked is the same for all texts that are
    linked, and differs where a component_id stands for two texts under one id;
    it is null without shingles or doc_id.
    Texts are linked when 100 * shared shingles >= percent * all shingles of
    both. Null and empty texts have no shingles and are linked with nothing; so
    are rows without doc_id, which have no component_id and are kept. Repeated
    rows get equal results; texts under one id stand for themselves, each with
    the smallest doc_id that its own links reach. An empty table gives an empty
    result; columns but doc_id and text are not looked at.
    """
    narrow_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    needed = needed_matches(percent)
    posted = COORDINATES - needed + 1
    rows = written(signatures(docs, size), "signatures")
    classes = written(rows.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("sig").alias("sig")), "classes")
    counts = value_counts(classes)
    found = written(candidates(postings(classes, counts, posted), counts, posted, needed, percent), "candidates")
    joined = components(links(found, docs, classes, size, percent))
    own = classes.select("fp", "id").join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    least = own.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    named = written(own.join(least, "root", "left").select("fp", F.coalesce("root", "fp").alias("linked"), F.coalesce("least", "id").alias("component")), "components")
    out = rows.select("doc_id", "mark", "n", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(named, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "mark", "linked", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
