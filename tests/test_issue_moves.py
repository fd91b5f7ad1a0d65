"""Issues are found where a record stands; only keys and cases move."""

from pyspark.sql import functions as F

from cargolens.functions.values import lift
from cargolens.operators import fields, knowledge, rules
from cargolens.session import EXCLUDED_RULE, tune

PACKAGE = "job_id long, pkg_ord long, c string, g string, n string, dim_unit string"
ITEM = "job_id long, pkg_ord long, item_ord long, q string, u string"


def packages(spark):
    rows = [(1, 1, "A", "5", "4", None), (1, 2, " A", "x", "4", None), (1, 3, None, "", "9", None), (2, 1, "A", "3", "4", None)]
    return spark.createDataFrame(rows, PACKAGE).select(
        "job_id", "pkg_ord", "dim_unit", lift(F.col("c")).alias("case_number"),
        lift(F.col("g"), F.lit("KG")).alias("gross_weight"), lift(F.col("n"), F.lit("KG")).alias("net_weight"),
    )


def test_weights_are_checked_without_a_join(spark):
    found = rules.package_issues(packages(spark))
    assert sorted((r.job_id, r.pkg_ord, r.code, r.case_number) for r in found.collect()) == [
        (1, 2, "CASE_NUMBER_DUPLICATE", "A"),
        (1, 2, "GROSS_WEIGHT_INVALID", "A"),
        (1, 3, "CASE_NUMBER_MISSING", None),
        (1, 3, "GROSS_WEIGHT_MISSING", None),
        (2, 1, "GROSS_BELOW_NET", "A"),
    ]
    others = rules.package_issues(packages(spark), {"CASE_NUMBER_MISSING", "GROSS_BELOW_NET"})
    assert "Join" not in others._jdf.queryExecution().optimizedPlan().toString()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.index("Union") < plan.index("Join")


def test_item_issues_meet_the_cases_afterwards(spark):
    items = spark.createDataFrame([(1, 1, 1, "x", "PC"), (1, 2, 1, "3", None), (1, 3, 1, "3", "PC"), (9, 1, 1, "x", "PC")], ITEM).select(
        "job_id", "pkg_ord", "item_ord", lift(F.col("q")).alias("quantity"), lift(F.col("u")).alias("uom")
    )
    found = rules.item_issues(items, rules.package_cases(packages(spark)))
    assert sorted((r.job_id, r.pkg_ord, r.code, r.case_number) for r in found.collect()) == [
        (1, 1, "ITEM_QUANTITY_INVALID", "A"), (1, 2, "ITEM_UOM_MISSING", "A"), (9, 1, "ITEM_QUANTITY_INVALID", None),
    ]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert any("Generate" in line for line in lines[join:])


def test_merged_rules_end_the_lineage_of_their_blocks(spark):
    docs = spark.createDataFrame([("a.md", '~~~r-json\n{"a": {"b": 1}}\n~~~\n~~~r-json\n{"a": {"b": 2}, "c": {}}\n~~~\n')], "path string, text string")
    merged = knowledge.merged_rules(knowledge.rule_entries(knowledge.rule_blocks(docs, "r")))
    assert sorted((tuple(r.keys_), r.value) for r in merged.withColumnRenamed("keys", "keys_").collect())[0] == (("a", "b"), "2")
    assert "Python" not in merged._jdf.queryExecution().optimizedPlan().toString()


def records(spark):
    lines = spark.createDataFrame([(1, 1, "A", "5", "AMBIGUOUS"), (1, 2, None, "x", "SUPPORTED"), (2, 1, "B", None, "AMBIGUOUS")], "job_id long, pkg_ord long, c string, g string, s string")
    own = {"case_number": lift(F.col("c"), None, F.col("s"), F.lit("Page 1")), "gross_weight": lift(F.col("g"), F.lit("KG"), F.col("s"))}
    return fields.package_records(lines, own)


def test_ambiguous_fields_of_records_equal_those_of_field_rows(spark):
    part = records(spark)
    found = rules.ambiguity_record_issues([part])
    whole = rules.ambiguity_issues(part.field_rows(part.rows))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert sorted((r.job_id, r.field_path, r.case_number) for r in found.collect()) == [
        (1, "packages[0].case_number", "A"), (2, "packages[0].case_number", "B"),
    ]


def test_issues_are_worked_out_once(spark):
    """An array of issues is neither made again to see that it has entries nor held by a function that is not compiled."""
    for found in (rules.package_issues(packages(spark), {"GROSS_BELOW_NET", "CASE_NUMBER_MISSING"}), rules.ambiguity_record_issues([records(spark)])):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "size(array(" not in plan and "filter(array(" not in plan and "size(filter(" not in plan


def test_rules_left_out_of_a_session_stay_out(spark):
    name, other = "spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.LikeSimplification"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, other)
        tune(tune(spark))
        assert spark.conf.get(name).split(",") == [other, EXCLUDED_RULE]
    finally:
        spark.conf.set(name, before)
