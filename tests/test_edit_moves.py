"""Edits over narrow records give what edits over the long table of fields give, and no field row moves."""

import random

from pyspark.sql import functions as F

from cargolens.functions.values import lift
from cargolens.operators import edits as E
from cargolens.operators import fields as FL

NAMES = {"case_number": "c", "gross_weight": "g", "length": "l"}


def _given(spark, seed=3):
    rng = random.Random(seed)
    rows = [(j, p, f"C-{p}", rng.choice(["10", "2.5", None]), rng.choice(["KG", None]), "7") for j in range(12) for p in (1, 2)]
    rows += [rows[0], (None, 1, "C", "1", "KG", "1"), (3, None, "C", "1", "KG", "1")]
    rec = spark.createDataFrame(rows, "job_id long, pkg_ord long, c string, g string, u string, l string")
    kinds = F.when(F.col("job_id") % 3 == 0, "int").when(F.col("job_id") % 3 == 1, "float")
    fields = {
        "case_number": lift(F.col("c")),
        "gross_weight": lift(F.col("g"), F.col("u"), kind=kinds),
        "length": lift(F.col("l"), kind=F.lit("bool")),
    }
    # some fields were changed before, some have no working side
    changed = (F.col("job_id") % 4 == 1) & (F.col("pkg_ord") == 1)
    moved = F.when(changed, fields["length"].withField("modified", F.lit(True))).otherwise(fields["length"])
    fields["length"] = F.when(F.col("job_id") % 4 == 2, moved.withField("working", F.lit(None).cast("struct<value:string,value_kind:string,unit:string,origin:string,modified_by:string,reason:string>"))).otherwise(moved)
    paths = [f"packages[{p}].{n}" for p in (0, 1, 2) for n in ("case_number", "gross_weight", "dimensions.length", "gross_weight_x")] + ["order.sales_order", "bad(path", None]
    changes = []
    for n in range(400):
        op = rng.choice(["set"] * 5 + ["revert", "revert_package", "revert_job"])
        path = {"revert_package": f"packages[{rng.randint(0, 1)}]", "revert_job": None}.get(op, rng.choice(paths))
        changes.append((rng.choice([*range(13), None]), n, op, path, rng.choice(["12", "1.5", "yes", " ", None, "oops"]), rng.choice([None, "LB"])))
    edits = spark.createDataFrame(changes, "job_id long, edit_ord long, op string, path string, value string, unit string")
    edits = edits.withColumns({"actor": F.lit("me"), "reason": F.lit(" as seen ")})
    wide = rec.select("job_id", "pkg_ord", *[f.alias(n) for n, f in fields.items()])
    return FL.package_fields_long(wide, list(fields)), [FL.package_records(rec, fields)], edits


def _rows(df):
    return sorted(str(r) for r in df.collect())


def test_record_edits_equal_field_edits(spark):
    fields, parts, edits = _given(spark)
    assert _rows(E.apply_record_edits(parts, edits)) == _rows(E.apply_edits(fields, edits).select("job_id", "root", "pkg_ord", "item_ord", "case_number", "path", "name", "field"))


def test_record_log_equals_field_log(spark):
    fields, parts, edits = _given(spark, 4)
    edits = edits.filter("not (job_id = 0 and path like 'packages[0].%')")  # repeated records tie in the order of edits
    log = _rows(E.record_change_log(parts, edits))
    assert log == _rows(E.change_log(fields, edits)) and len(log) > 50


def test_record_proposals_equal_field_proposals(spark):
    fields, parts, edits = _given(spark, 5)
    changes = edits.select("job_id", F.col("edit_ord").alias("change_ord"), (F.col("edit_ord") % 50).alias("proposal_id"), "path", "value", "unit", "reason")
    told = _rows(E.checked_record_proposals(parts, changes))
    assert told == _rows(E.checked_proposals(fields, changes)) and len(told) > 50
