"""Row numbers and first occurrences that stay even when one group holds most rows.

A window over a group sorts the whole group in one task. Here a group is cut
into pieces by an expression that rises with the order, the pieces are counted
with map-side combine, and only the small table of piece counts is summed up
per group. Every detail row is then numbered inside its piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one piece when the order is a dense number.
PIECE_ROWS = 65536


def piece_of(ordinal: Column) -> Column:
    return F.floor(ordinal / PIECE_ROWS)


def of_several_pieces(cut: DataFrame, keys: list[str], begins: Column | int = 0) -> DataFrame:
    """Rows of the groups that reach beyond the piece they begin in, along a dense number.

    Groups follow each other in a document, so one at most reaches over each
    end of a piece: their list is short and travels to every task.
    """
    several = cut.filter(F.col("_piece") != begins).select(*keys).distinct()
    return cut.join(F.broadcast(several), keys, "left_semi")


def numbered_along(df: DataFrame, keys: list[str], order: str, name: str, begin: str | None = None) -> DataFrame:
    """As ``numbered`` along a dense number of the document, or some of its numbers: rows move once.

    ``begin`` names the number a group begins at when it is a part of a document.
    """
    cut = df.dropna(subset=[*keys, order]).withColumn("_piece", piece_of(F.col(order)))
    several = of_several_pieces(cut, keys, piece_of(F.col(begin)) if begin else 0)
    counts = several.groupBy(*keys, "_piece").agg(F.count("*").alias("_in_piece"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_piece", F.sum("_in_piece").over(before).alias("_so_far"))
    inside = Window.partitionBy(*keys, "_piece").orderBy(order)
    return (
        cut.join(F.broadcast(offsets), [*keys, "_piece"], "left")
        .withColumn(name, F.coalesce("_so_far", F.lit(0)) + F.row_number().over(inside))
        .drop("_piece", "_so_far")
    )


def numbered(
    df: DataFrame, keys: list[str], pieces: dict[str, Column], order: list, name: str
) -> DataFrame:
    """Add ``name``: 1, 2, … inside each group, in (pieces, order) order.

    ``pieces`` are named expressions that never fall along the order, so all
    rows of a piece come before all rows of the next one. Rows without a key or
    piece are dropped; those without a piece count, as the first ones.
    """
    marks = list(pieces)
    cut = df.withColumns(pieces).dropna(subset=keys)
    # a group of at most PIECE_ROWS rows is sorted as it is; of the larger ones there are few, so their list travels
    large = F.broadcast(cut.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > PIECE_ROWS).select(*keys))
    whole = Window.partitionBy(*keys).orderBy(*marks, *order)
    small = cut.join(large, keys, "left_anti").withColumn(name, F.row_number().over(whole).cast("bigint")).dropna(subset=marks)
    cut = cut.join(large, keys, "left_semi")
    counts = cut.groupBy(*keys, *marks).agg(F.count("*").alias("_in_piece"))
    before = Window.partitionBy(*keys).orderBy(*marks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *marks, F.coalesce(F.sum("_in_piece").over(before), F.lit(0)).alias("_so_far"))
    inside = Window.partitionBy(*keys, *marks).orderBy(*order)
    pieced = cut.join(offsets, [*keys, *marks]).withColumn(name, F.col("_so_far") + F.row_number().over(inside))
    return small.drop(*marks).unionByName(pieced.drop(*marks, "_so_far"))


def running_total_before(df: DataFrame, keys: list[str], order: str, amount: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over earlier rows of the group; ``order`` is a dense number."""
    cut = df.withColumn("_piece", piece_of(F.col(order)))
    totals = cut.groupBy(*keys, "_piece").agg(F.sum(amount).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_piece", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_so_far"))
    inside = Window.partitionBy(*keys, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(offsets, [*keys, "_piece"])
        .withColumn(name, F.col("_so_far") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("_piece", "_so_far")
    )


def mark_first(df: DataFrame, group: list[str], row_key: list[str], order: str, name: str) -> DataFrame:
    """Add ``name``: true on the first row of each group whose keys are all known.

    The first row of a group is found by an aggregate; the answer comes back by
    a join on the row key, which is unique, so a large group does not pile up.
    """
    known = df.dropna(subset=group)
    firsts = (
        known.groupBy(*group)
        .agg(F.min(F.struct(order, *[k for k in row_key if k not in group and k != order])).alias("_first"))
        .select(*[_key(k, group) for k in row_key], F.lit(True).alias(name))
    )
    return df.join(firsts, row_key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def _key(name: str, group: list[str]) -> Column:
    return F.col(name) if name in group else F.col(f"_first.{name}").alias(name)
