"""Which strings hold which: an index of short grams for containment, and of comma prefixes for locators.

Both are equality joins on distinct strings, so no pair is looked at that
shares nothing, and a string that comes a million times is compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
# Strings of a group that are compared with all others, and parts the others are dealt in.
FEW, DEALS = 16, 8


def _grams(text: Column, size: int) -> Column:
    """All distinct pieces of `size` characters, none for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>")
    )


def _needle_grams(needle: Column) -> Column:
    """Its pieces of GRAM characters; a shorter needle is its own piece, the empty one included."""
    return F.when(F.length(needle) >= GRAM, _grams(needle, GRAM)).otherwise(F.array(needle))


def _hay_grams(hay: Column) -> Column:
    return F.concat(F.array(F.lit("")), *[_grams(hay, size) for size in range(1, GRAM + 1)])


def contained(needles: DataFrame, hays: DataFrame, on: list[str]) -> DataFrame:
    """(on..., needle, hay): distinct pairs where hay contains needle and the columns `on` are equal.

    Hays are posted under their grams, those that some needle has. A needle is
    looked up under its rarest gram only, by the counts of all hays, and what it
    meets is checked in full. A gram that most hays share is thus met by needles
    that have no rarer one, and those it meets are mostly answers. Null strings
    hold nothing and are held by nothing; the empty needle is in every hay.
    """
    asked = needles.select(*on, "needle").where(F.col("needle").isNotNull()).distinct()
    held = hays.select(*on, "hay").where(F.col("hay").isNotNull()).distinct()
    parts = asked.withColumn("gram", F.explode(_needle_grams(F.col("needle"))))
    posted = held.withColumn("gram", F.explode(_hay_grams(F.col("hay"))))
    posted = posted.join(parts.select(*on, "gram").distinct(), [*on, "gram"], "left_semi")
    counts = posted.groupBy(*on, "gram").agg(F.count("*").alias("n"))
    # a needle with a gram that no hay has is in none
    anchors = (
        parts.join(counts, [*on, "gram"], "left")
        .groupBy(*on, "needle")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
        .where("least.n > 0")
        .select(*on, "needle", F.col("least.gram").alias("gram"))
    )
    return posted.join(anchors, [*on, "gram"]).where(F.contains("hay", "needle")).select(*on, "needle", "hay")


def comma_prefixes(locator: Column) -> Column:
    """All that is left of a locator before one of its commas."""
    parts = F.split(locator, ",")
    ends = F.sequence(F.lit(1), F.size(parts) - 1)
    return F.when(F.size(parts) > 1, F.transform(ends, lambda k: F.array_join(F.slice(parts, 1, k), ","))).otherwise(
        F.array().cast("array<string>")
    )


def extending(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(on..., left, right, tier): equal strings (0), and those of which one is the other plus a comma and more (1)."""
    some = left.select(*on, "left").where(F.col("left").isNotNull()).distinct()
    others = right.select(*on, "right").where(F.col("right").isNotNull()).distinct()
    equal = some.join(others.withColumn("left", F.col("right")), [*on, "left"]).withColumn("tier", F.lit(0))
    longer = some.withColumn("_at", F.explode(comma_prefixes(F.col("left")))).join(others.withColumn("_at", F.col("right")), [*on, "_at"])
    shorter = others.withColumn("_at", F.explode(comma_prefixes(F.col("right")))).join(some.withColumn("_at", F.col("left")), [*on, "_at"])
    columns = [*on, "left", "right", "tier"]
    both = [x.withColumn("tier", F.lit(1)).select(*columns) for x in (longer, shorter)]
    return equal.select(*columns).unionByName(both[0]).unionByName(both[1])


def graded(left: DataFrame, right: DataFrame, on: list[str], key=lambda text: text) -> DataFrame:
    """(on..., left, right, tier): each pair that belongs together with its best tier: equal, extending, or containing (2).

    key folds strings before they are compared for containment. The first FEW
    strings of the right side of a group are compared with all of the left, as
    their grams would be more rows than these pairs; the others go by grams.
    """
    some, others = left.select(*on, "left").distinct(), right.select(*on, "right").distinct()
    folded_left = some.withColumn("_l", key(F.col("left")))
    folded_right = others.withColumn("_r", key(F.col("right")))
    if not on:
        return _graded_by_grams(folded_left, folded_right, on)
    place = F.row_number().over(Window.partitionBy(*on).orderBy("right"))
    placed = folded_right.filter(F.col("right").isNotNull()).withColumn("_place", place)
    # the large side of a group is dealt by its strings, the few and the names of the groups go to every deal
    dealt = folded_left.filter(F.col("left").isNotNull()).withColumn("_deal", F.pmod(F.hash("left"), F.lit(DEALS)))
    every = F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("_deal")
    few = placed.filter(F.col("_place") <= FEW).select(*on, "right", "_r", every)
    more = placed.filter(F.col("_place") > FEW).drop("_place")
    one, other = F.col("left"), F.col("right")
    starts = F.startswith(one, F.concat(other, F.lit(","))) | F.startswith(other, F.concat(one, F.lit(",")))
    holds = F.contains("_l", "_r") | F.contains("_r", "_l")
    tier = F.when(one == other, 0).when(starts, 1).when(holds, 2)
    near = dealt.join(few, [*on, "_deal"]).select(*on, "left", "right", tier.alias("tier")).filter(F.col("tier").isNotNull())
    asked = more.select(*on).distinct().select(*on, every)
    large = dealt.join(asked, [*on, "_deal"], "left_semi").drop("_deal")
    return near.unionByName(_graded_by_grams(large, more, on))


def _graded_by_grams(folded_left: DataFrame, folded_right: DataFrame, on: list[str]) -> DataFrame:
    left_keys, right_keys = folded_left.select(*on, "_l").distinct(), folded_right.select(*on, "_r").distinct()
    inside = contained(left_keys.withColumnRenamed("_l", "needle"), right_keys.withColumnRenamed("_r", "hay"), on)
    around = contained(right_keys.withColumnRenamed("_r", "needle"), left_keys.withColumnRenamed("_l", "hay"), on)
    keys = inside.select(*on, F.col("needle").alias("_l"), F.col("hay").alias("_r")).unionByName(
        around.select(*on, F.col("hay").alias("_l"), F.col("needle").alias("_r"))
    )
    pairs = keys.distinct().join(folded_left, [*on, "_l"]).join(folded_right, [*on, "_r"])
    held = pairs.select(*on, "left", "right", F.lit(2).alias("tier"))
    return extending(folded_left, folded_right, on).unionByName(held).groupBy(*on, "left", "right").agg(F.min("tier").alias("tier"))
