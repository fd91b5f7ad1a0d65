"""Output rows are made where the record is, and gates are worked out once."""

from pyspark.sql import functions as F

from cargolens.functions.values import lift
from cargolens.operators import context as C
from cargolens.sources import bridge, publish


def _records(spark):
    rows = [(1, 1, 1, " C-0 ", "10"), (1, 2, 2, None, "20"), (2, 1, 1, "C-1", None), (2, 1, 1, "C-1", None), (None, 1, 1, "C-0", "5")]
    rec = spark.createDataFrame(rows, "job_id long, pkg_ord long, segment_no int, case_value string, gross_value string")
    texts = {n: F.lit("7") for n in ("net_value", "length_value", "width_value", "height_value")}
    return rec.withColumns(texts | {"weight_unit": F.lit("KG"), "dim_unit": F.lit("MM"), "status": F.lit("SUPPORTED")})


def _scopes(spark):
    jobs = spark.createDataFrame([(1, 7), (2, None), (3, 7)], "job_id long, project_id long").select(
        "*", lift(F.lit("PO-1")).alias("purchase_order"), lift(F.lit("10")).alias("purchase_order_position")
    )
    struct = lambda value: bridge._struct(C.CASE_FIELDS, {"remarks": F.lit(value)})
    contexts = spark.createDataFrame([(7,), (None,)], "project_id long").select("*", struct("all").alias("defaults"))
    overrides = spark.createDataFrame([(7, "C-0"), (7, "C-0"), (8, "C-1")], "project_id long, case_number string")
    return jobs, contexts, overrides.select("*", struct("one").alias("override"))


def test_fields_made_after_the_joins_give_the_same_rows(spark):
    rec, scopes = _records(spark), _scopes(spark)
    wide = C.output_rows(C.with_context(bridge.package_fields(rec), *scopes, "project_id"))
    moved = C.with_context(rec, *scopes, "project_id", lift(F.col("case_value"), required=True))
    more = ["project_id", "_po", "_po_position", "case_text", "defaults", "override"]
    narrow = C.output_rows(bridge.package_fields(moved, *more))
    shown = lambda df: sorted(str(r) for r in df.withColumn("origins", F.to_json("origins")).collect())
    assert shown(narrow) == shown(wide) and narrow.count() == 5


def test_gates_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(blocks):
        for block in blocks:
            seen.add(block.num_rows)
            yield block

    gates = spark.createDataFrame([(7, 0), (8, 1)], "project_id long, blocking long").mapInArrow(count, "project_id long, blocking long")
    rows = C.output_rows(
        C.with_context(bridge.package_fields(_records(spark)), *_scopes(spark), "project_id")
    ).withColumn("excel_row", F.col("pkg_ord") + 22)
    headers = spark.createDataFrame([(7, "E9", "EUR", False)], "project_id long, ref string, value string, numeric boolean")
    told = {r.project_id: r.status for r in publish.publish(rows.filter("project_id = 7 and pkg_ord = 2"), headers, gates, str(tmp_path)).collect()}
    assert told == {7: "completed", 8: "refused"}
    assert seen.value == 2
