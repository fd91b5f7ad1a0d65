"""Hard negatives of embeddings, searched in a multiway hyperplane tree with sibling ranges.

The tree (after GNAT) has WAYS split points a node; a row goes on to the
nearest one, so siblings are parted by hyperplanes. For every split point and
every sibling subtree it keeps the smallest and largest distance from the point
to the subtree's rows, and for every subtree the smallest and largest squared
length. A window of inner products [low, high] with an anchor is a range of
distances, an annulus: d^2 = |a|^2 + |x|^2 - 2 a.x. A subtree whose range from
any split point does not meet that annulus, moved by the anchor's own distance
from the point, holds no row of the window and is left out.

1. Split points come from a sample of at most `sample` rows, by hash; the
   ranges and the leaves hold all rows.
2. Positives: anchors look into their own leaf for a first bound on the fifth
   best score, then into every leaf that may hold a better one.
3. Negatives: each positive is a window of scores; the anchor's own leaf may
   raise its lower end, then every leaf that meets a window is looked into.
4. Leaves are exact: scores are integers, one matrix product for the anchors of
   a part of a leaf, and only the first rows of every window leave it.

A leaf is dealt over tasks by the hash of vec_id and its anchors in turns, so
equal vectors in any number do no harm. No row is left out, so results equal a
search of everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.common import batch_column, hashed_share, narrow_batches, written
from cargolens.llm.near_dup import grouped

#: Children of a node, rows of the sample that a node must have to be split, and levels.
WAYS, SPLIT_ROWS, LEVELS = 8, 64, 3
#: Rows of the sample that the split points are chosen from.
SAMPLE = 4096
#: Rows of a leaf, and anchors, that one task takes at a time.
LEAF_PART, TURN = 8192, 1024
#: Allowance for rounding of distances, as a share and plain.
SLACK = 1e-9
WINDOWS = "array<struct<pos:long,pos_score:long,low:long,high:long>>"


def usable(rows: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """(row, id, label, v) of the rows that take part, one of each: v are the components as floor(256 * x), row names the row."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    kept = rows.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
    # from 2^53 on a double is a whole number, and its floor may not fit a long
    times = lambda x: x.cast("double") * 256
    whole = F.transform(vector, lambda x: F.when(F.abs(times(x)) < 2.0**53, F.floor(times(x)).cast("double")).otherwise(times(x)))
    kept = kept.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v")).distinct()
    return kept.select(F.xxhash64("id", "label", "v").alias("row"), "id", "label", "v")


@dataclass
class Node:
    """Split points of a node, and for each child the number of the next node (or of a leaf, as -1 - leaf)."""

    points: np.ndarray
    children: list[int]
    #: [i, j]: distances of point i from the rows of child j; [j]: their squared lengths. Filled in by ranges().
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    least: np.ndarray | None = None
    most: np.ndarray | None = None


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :] - 2 * (rows @ points.T)
    return np.sqrt(np.maximum(square, 0))


def split_points(rows: np.ndarray, ways: int) -> np.ndarray:
    """Different rows far from one another: each next one is the farthest from those chosen."""
    chosen = [0]
    near = distances(rows, rows[:1])[:, 0]
    while len(chosen) < ways and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def grown(sample: np.ndarray) -> list[Node]:
    """The nodes of a tree over the sample, root first; with too few different rows the root is one leaf."""
    nodes: list[Node] = []
    leaves = 0

    def grow(rows: np.ndarray, level: int) -> int:
        nonlocal leaves
        points = split_points(rows, WAYS) if level == 0 or (level < LEVELS and len(rows) >= SPLIT_ROWS) else rows[:1]
        if level and len(points) < 2:
            leaves += 1
            return -leaves
        node = Node(points, [])
        nodes.append(node)
        place = len(nodes) - 1
        nearest = distances(rows, points).argmin(axis=1)
        node.children = [grow(rows[nearest == j], level + 1) for j in range(len(points))]
        return place

    grow(sample, 0)
    return nodes


def descend(nodes: list[Node], rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(node, child, places of the rows that go there, their distances from the node's points), from the root on."""
    open_ = [(0, np.arange(len(rows)))]
    while open_:
        at, own = open_.pop()
        far = distances(rows[own], nodes[at].points)
        nearest = far.argmin(axis=1)
        for j, child in enumerate(nodes[at].children):
            there = nearest == j
            yield at, j, own[there], far[there]
            if child >= 0 and there.any():
                open_.append((child, own[there]))


def leaf_of(nodes: list[Node], rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.int32)
    for at, j, own, _ in descend(nodes, rows):
        if nodes[at].children[j] < 0:
            out[own] = -1 - nodes[at].children[j]
    return out


def _matrix(vectors: list[list[float]], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def placed(rows: DataFrame, nodes, width: int) -> DataFrame:
    """(row, id, label, v, leaf) of every row."""

    def made(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = leaf_of(nodes.value, _matrix(batch_column(batch, "v"), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return rows.select("row", "id", "label", "v").mapInArrow(made, "row long, id long, label long, v array<double>, leaf int")


def ranges(rows: DataFrame, nodes, width: int) -> list[Node]:
    """The nodes with the ranges of all rows: a few numbers for each pair of siblings, gathered from every task."""

    def made(batches):
        held: dict[tuple[int, int], list[np.ndarray | float]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch_column(batch, "v"), width)
            square = (m**2).sum(axis=1)
            for at, j, own, far in descend(nodes.value, m):
                if len(own):
                    new = [far.min(axis=0), far.max(axis=0), square[own].min(), square[own].max()]
                    old = held.get((at, j), new)
                    held[at, j] = [f(a, b) for f, a, b in zip((np.minimum, np.maximum) * 2, old, new)]
        for (at, j), (low, high, least, most) in held.items():
            n = len(low)
            yield pa.record_batch({"node": [at] * n, "child": [j] * n, "point": list(range(n)), "low": low, "high": high, "least": [least] * n, "most": [most] * n})

    found = rows.mapInArrow(made, "node long, child long, point long, low double, high double, least double, most double")
    found = found.groupBy("node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"))
    out = [Node(n.points, n.children) for n in nodes.value]
    for node in out:
        n = len(node.points)
        # a child without rows is met by nothing
        node.low, node.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        node.least, node.most = np.full(n, np.inf), np.full(n, -np.inf)
    for r in found.collect():
        node = out[r["node"]]
        node.low[r["point"], r["child"]], node.high[r["point"], r["child"]] = r["low"], r["high"]
        node.least[r["child"]], node.most[r["child"]] = r["least"], r["most"]
    return out


def meeting(nodes: list[Node], anchor: np.ndarray, lows: list[float], highs: list[float]) -> set[int]:
    """The leaves that may hold rows with an inner product from a low to its high with the anchor."""
    out, open_ = set(), [(0, np.arange(len(lows)))]
    own = float((anchor**2).sum())
    lows, highs = np.array(lows, dtype=float)[:, None], np.array(highs, dtype=float)[:, None]
    while open_:
        at, asking = open_.pop()
        node, low, high = nodes[at], lows[asking], highs[asking]
        far = distances(anchor[None, :], node.points)[0][:, None]
        held = node.least <= node.most
        least, most = np.where(held, node.least, 0), np.where(held, node.most, 0)
        # no inner product is beyond the product of the lengths
        reach, room = np.sqrt(own * most), SLACK * (1 + own + most)
        outer = np.sqrt(np.maximum(0, own + most - 2 * np.maximum(low, -reach)) + room)
        inner = np.sqrt(np.maximum(0, own + least - 2 * np.minimum(high, reach) - room))
        meets = held & (low <= reach + room) & (high >= -reach - room)
        # [window, point, child]: the ranges of all points must meet the annulus
        slack = SLACK * (1 + far)
        nearest = np.maximum(far - outer[:, None, :], inner[:, None, :] - far) - slack
        meets &= ((node.high >= nearest) & (node.low <= far + outer[:, None, :] + slack)).all(axis=1)
        for j, child in enumerate(node.children):
            if (on := asking[meets[:, j]]).size:
                if child < 0:
                    out.add(-1 - child)
                else:
                    open_.append((child, on))
    return out


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as 64-bit integers; what does not fit is the nearest that does."""
    largest = max(np.abs(anchors).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * max(anchors.shape[1], 1)
    if largest < 2.0**53:
        return (anchors @ rows.T).astype(np.int64)
    as_int = np.frompyfunc(int, 1, 1)
    full = as_int(anchors).dot(as_int(rows).T)
    return np.clip(full, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def asked(asks: DataFrame, nodes, width: int, home: bool) -> DataFrame:
    """The anchors (row, id, label, v, leaf, windows) once for every leaf that meets one of their windows: their own leaf, or all the others."""

    def made(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m, windows, own = _matrix(batch_column(batch, "v"), width), batch_column(batch, "windows"), batch_column(batch, "leaf")
            place, leaves = [], []
            for i in range(len(m)):
                found = {own[i]} if home else meeting(nodes.value, m[i], [w["low"] for w in windows[i]], [w["high"] for w in windows[i]]) - {own[i]}
                place += [i] * len(found)
                leaves += sorted(found)
            if place:
                rows = batch.take(pa.array(place))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(leaves, pa.int32())], names=[*rows.schema.names, "asked"])

    # the search of the tree takes time rather than bytes
    asks = asks.select("row", "id", "label", "v", "leaf", "windows").repartition(int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")
    return asks.mapInArrow(made, f"row long, id long, label long, v array<double>, leaf int, windows {WINDOWS}, asked int")


def searched(index: DataFrame, parts: DataFrame, asks: DataFrame, turns: int, k: int, alike: bool, width: int) -> DataFrame:
    """(row, anchor_id, pos, pos_score, id, score): of each window the k best rows of each part of a leaf that is asked.

    alike: rows of the anchor's label and another id; else rows of other labels.
    """
    asks = written(asks, "asks")
    busy = parts.join(asks.select(F.col("asked").alias("leaf")).distinct(), "leaf", "left_semi")
    hosts = index.join(busy, "leaf").withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts"))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    hosts = hosts.select(F.xxhash64("leaf", "part", "turn").alias("grp"), F.lit(0).alias("guest"), "row", "id", "label", "v")
    guests = asks.join(busy.withColumnRenamed("leaf", "asked"), "asked").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    guests = guests.withColumn("turn", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(turns)).cast("int"))
    guests = guests.select(F.xxhash64("asked", "part", "turn").alias("grp"), F.lit(1).alias("guest"), "row", "id", "label", "v", "windows")
    both = guests.unionByName(hosts.withColumn("windows", F.lit(None).cast(WINDOWS)))
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def one(found: pa.Table) -> pa.RecordBatch | None:
        guest = found.column("guest").to_numpy()
        home, away = np.flatnonzero(guest == 0), np.flatnonzero(guest == 1)
        if not len(home) or not len(away):
            return None
        rows, ids, labels = (found.column(c).to_numpy() for c in ("row", "id", "label"))
        vectors, windows = found.column("v").to_pylist(), found.column("windows").to_pylist()
        m = _matrix([vectors[i] for i in home], width)
        own_ids, own_labels = ids[home], labels[home]
        out: list[tuple] = []
        for start in range(0, len(away), 128):
            some = away[start : start + 128]
            for i, scores in zip(some, products(_matrix([vectors[i] for i in some], width), m)):
                fits = (own_labels == labels[i]) & (own_ids != ids[i]) if alike else own_labels != labels[i]
                for w in windows[i]:
                    inside = np.flatnonzero(fits & (scores >= w["low"]) & (scores <= w["high"]))
                    best = inside[first(scores[inside], own_ids[inside], k)]
                    out += [(int(rows[i]), int(ids[i]), w["pos"], w["pos_score"], int(own_ids[j]), int(scores[j])) for j in best]
        return pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*out)], names=["row", "anchor_id", "pos", "pos_score", "id", "score"]) if out else None

    both = both.repartition(tasks, "grp").sortWithinPartitions("grp", "guest")
    return both.mapInArrow(lambda batches: grouped(batches, "grp", one), "row long, anchor_id long, pos long, pos_score long, id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of every window, with their rank."""
    order = Window.partitionBy("row", "pos").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _asks(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """Anchors with the windows (row, pos, pos_score, low, high) they ask for, a few each."""
    own = windows.groupBy("row").agg(F.collect_list(F.struct("pos", "pos_score", "low", "high")).alias("windows"))
    return anchors.join(own, "row")


def hard_negatives(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    anchors: str = "vec_id % 100 = 0",
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    sample: int = SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, positive and hard negative.

    Rows without id, label or vector, or with a null or non-finite component,
    take no part; an empty vector has no components and scores 0. Equal rows
    count once; rows that differ under one id each stand for themselves, as
    anchors too (their results come under one anchor_id, each ranked from 1), and
    a row is never a positive of its own id. Vectors of different lengths count
    as filled up with zeros. A score beyond 64 bits counts as the nearest number
    that fits. Without anchors, positives or rows in the window there are no
    result rows; columns but the three named are not looked at. `anchors` is a
    condition on id_column; the tree is grown from some `sample` rows, twice
    that at the most.
    """
    spark = rows.sparkSession
    narrow_batches(spark)
    wanted = rows.where(anchors).select(F.col(id_column).cast("long").alias("id")).distinct()
    own = written(usable(rows.select(id_column, vector, label), id_column, vector, label), "vectors")
    width = own.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    some = hashed_share(own, "id", sample).limit(2 * sample).select("v").collect()
    plain = spark.sparkContext.broadcast(grown(_matrix([r["v"] for r in some], width)))
    index = written(placed(own, plain, width), "leaves")
    nodes = spark.sparkContext.broadcast(ranges(own, plain, width))
    parts = written(index.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF_PART).alias("parts")), "leaf-parts")
    chosen = written(index.join(wanted, "id", "left_semi"), "anchors")
    turns = max(1, math.ceil(chosen.count() / TURN))

    def look(windows: DataFrame, k: int, alike: bool) -> DataFrame:
        """The k best rows of every window: the anchor's own leaf may raise the lower end, then all leaves that meet the window."""
        at_home = written(searched(index, parts, asked(_asks(chosen, windows), nodes, width, True), turns, k, alike, width), "found")
        full = best(at_home, k).where(F.col("rank") == k).select("row", "pos", F.col("score").alias("bound"))
        narrow = windows.join(full, (windows["row"] == full["row"]) & windows["pos"].eqNullSafe(full["pos"]), "left").select(windows["row"], windows["pos"], "pos_score", F.greatest("low", "bound").alias("low"), "high")
        away = searched(index, parts, asked(_asks(chosen, narrow), nodes, width, False), turns, k, alike, width)
        return written(best(at_home.unionByName(away), k), "best")

    none, least, most = (F.lit(x).cast("long") for x in (None, -(1 << 63), (1 << 63) - 1))
    found = look(chosen.select("row", none.alias("pos"), none.alias("pos_score"), least.alias("low"), most.alias("high")), positives, True)
    # 100 * negative >= least_percent * positive
    low = F.ceil(F.col("score").cast("decimal(20,0)") * least_percent / 100).cast("decimal(38,0)").cast("long")
    windows = written(found.select("row", F.col("id").alias("pos"), F.col("score").alias("pos_score"), low.alias("low"), F.col("score").alias("high")).where("low <= high"), "windows")
    found = look(windows, negatives, False)
    return found.select("anchor_id", F.col("pos").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("pos_score").alias("positive_score"), F.col("score").alias("negative_score"))
