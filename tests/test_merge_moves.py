"""Merges and scores move each record once: winners are ordinals, values follow."""

import random

from pyspark.sql import functions as F

from cargolens.functions.values import lift
from cargolens.operators import merge, scoring

ROWS = "job_id long, segment_no int, pkg_ord long, c string, v string, s string, dim_unit string"
ITEM = ["item_number", "description"]


def frame(spark, seed):
    rng = random.Random(seed)
    rows = []
    for job in range(40):
        segment = 1
        for at in range(1, rng.randint(2, 9)):
            segment = rng.randint(segment, segment + 1)
            rows.append((
                job, segment, at, rng.choice(["A", " A ", "B", "", None]), rng.choice(["1", "2", "", None]),
                rng.choice([*merge.STATUS_RANK, "ODD", None]), rng.choice(["cm", "MM", "", None]),
            ))
    return spark.createDataFrame(rows, ROWS)


def wide(df, fields):
    return df.select("job_id", "segment_no", "pkg_ord", "dim_unit", *[c.alias(n) for n, c in fields.items()])


def plan_of(df):
    """The executed plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def same_rows(left, right):
    show = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert show(left) == show(right) and show(left)


def test_segments_merge_the_same_with_fields_made_after_the_move(spark):
    df = frame(spark, 5)
    fields = {n: merge.mapped(F.col(c), status=F.col("s"), raw=F.col(c)) for n, c in (("case_number", "c"), ("gross_weight", "v"))}
    narrow = merge.merge_segments(df, fields)
    same_rows(narrow, merge.merge_segments(wide(df, fields), list(fields)))
    assert "max_by" not in plan_of(narrow)


def test_continuations_merge_the_same_with_fields_made_after_the_move(spark):
    df = frame(spark, 6)
    fields = {"case_number": lift(F.col("c")), "gross_weight": lift(F.col("v"))}
    narrow = merge.merge_continuations(df, fields)
    same_rows(narrow, merge.merge_continuations(wide(df, fields), list(fields)))
    assert "min_by" not in plan_of(narrow)


def test_item_keys_are_made_before_the_items_move(spark):
    items = spark.createDataFrame(
        [(1, 1, 1, "a", "x"), (1, 2, 1, "a", "x"), (1, 2, 2, "b", None)],
        "job_id long, pkg_ord long, item_ord long, item_number string, description string",
    )
    targets = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "job_id long, pkg_ord long, target_ord long")
    kept = merge.merge_items(items, targets, ITEM, lambda c: c).select("job_id", "target_ord", "pkg_ord", "item_ord")
    assert sorted(map(tuple, kept.collect())) == [(1, 1, 1, 1), (1, 1, 2, 2)]
    top = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(top) if "Join" in line]
    assert not any("sha2" in line for line in top[: joins[-1]])


def test_field_scores_travel_as_one_list_a_package(spark):
    want = spark.createDataFrame(
        [("d", "A", "w", "1", "float"), ("d", "A", "u", "x", "string"), ("d", "A", "v", "y", "string"), ("d", "B", "w", "1", "float")],
        "name string, case_number string, field string, value string, value_kind string",
    )
    have = spark.createDataFrame(
        [("d", 1, "w", "1.0", "float"), ("d", 1, "w", "2", "float"), ("d", 1, "u", None, "string")],
        "name string, pkg_ord long, field string, value string, value_kind string",
    )
    actual = spark.createDataFrame([("d", 1, "A")], "name string, pkg_ord long, case_number string")
    scores = scoring.field_scores(want, have, actual)
    # w meets two values, one of them right; u is null, v is not there; case B has no package
    assert [tuple(r) for r in scores.collect()] == [("d", 1, 4)]
    assert "collect_list" in plan_of(scores)


def test_conflicts_are_the_same_with_fields_made_after_the_move(spark):
    df = frame(spark, 7)
    fields = {n: merge.mapped(F.col(c), status=F.col("s")) for n, c in (("case_number", "c"), ("gross_weight", "v"))}
    narrow = merge.segment_conflicts(df, fields)
    same_rows(narrow, merge.segment_conflicts(wide(df, fields), list(fields)))


def test_continuation_conflicts_look_at_repeated_cases_only(spark):
    df = frame(spark, 8)
    lifted = wide(df, {"case_number": lift(F.col("c")), "gross_weight": lift(F.col("v"))})
    found = merge.continuation_conflicts(lifted, ["case_number", "gross_weight"])
    assert found.count() and "LeftSemi" in plan_of(found)
