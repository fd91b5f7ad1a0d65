"""The shipping model read from the star-schema tables.

Job = order, project = customer, package record = order line, item = the same
line. Missing, blank and non-numeric values, odd units, repeated cases and
ambiguous status come from the columns of the line and its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.functions.values import lift
from cargolens.operators.ordinals import numbered
from cargolens.session import staged

PACKAGE_FIELDS = ["case_number", "gross_weight", "net_weight", "length", "width", "height"]
ITEM_FIELDS = ["sequence", "item_number", "description", "quantity", "uom"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, *, ordered: bool = True, sized: bool = True) -> DataFrame:
    """One row per package record.

    ``ordered`` records carry their ordinal in the job. They are loaded once
    per application into a staged table, as every later step reads them.
    Without an order the lines are read directly; ``sized`` then adds what
    needs the part.
    """
    if ordered:
        return staged(spark, f"records:{sf_dir}", lambda: load_records(spark, sf_dir))
    return load_records(spark, sf_dir, ordered=False, sized=sized)


def load_records(spark: SparkSession, sf_dir: str, *, ordered: bool = True, sized: bool = True) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    whole = F.col("l_quantity").cast("int")
    if sized:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
        line = line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    if ordered:
        line = numbered(
            line,
            ["l_orderkey"],
            {"_line": F.col("l_linenumber"), "_part": F.floor(F.col("l_partkey") / 4096)},
            ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"],
            "pkg_ord",
        )
    columns = {
        "job_id": F.col("l_orderkey"),
        "segment_no": F.col("l_linenumber"),
        "case_value": F.when(F.col("l_partkey") % 50 == 0, None).otherwise(
            F.concat(F.lit(" C-"), (F.col("l_partkey") % 3).cast("string"), F.lit(" "))
        ),
        "gross_value": F.when(F.col("l_partkey") % 19 == 0, None)
        .when(F.col("l_partkey") % 23 == 0, "n/a")
        .when(F.col("l_quantity") >= 40, F.concat(F.lit("1,"), (100 + whole).cast("string")))
        .otherwise((whole * 10).cast("string")),
        "net_value": F.when(F.col("l_suppkey") % 17 == 0, "").otherwise(
            (whole * (8 + (F.col("l_suppkey") % 4).cast("int"))).cast("string")
        ),
        "weight_unit": F.when(F.col("l_returnflag") == "A", "KG")
        .when(F.col("l_returnflag") == "N", "lb.")
        .when(F.col("l_linestatus") == "F", "")
        .otherwise("Stone"),
        "dim_unit": F.when(F.col("l_returnflag") == "A", "MM")
        .when(F.col("l_returnflag") == "N", "cm")
        .otherwise("in."),
        "status": F.when(F.col("l_linestatus") == "F", "CONFIRMED")
        .when(F.col("l_partkey") % 5 == 0, "AMBIGUOUS")
        .otherwise("SUPPORTED"),
        "item_seq": F.col("l_linenumber"),
        "item_number": F.col("l_partkey").cast("string"),
        "item_quantity": whole.cast("string"),
        "item_uom": F.when(F.col("l_suppkey") % 13 == 0, None).otherwise("PC"),
        "returnflag": F.col("l_returnflag"),
        "linestatus": F.col("l_linestatus"),
    }
    if sized:
        size = F.col("p_size")
        columns["length_value"] = F.when(size % 11 == 0, None).otherwise((size * 10).cast("string"))
        columns["width_value"] = (size * 5).cast("string")
        columns["height_value"] = F.when(size % 13 == 0, "-1").otherwise(size.cast("string"))
        columns["item_description"] = F.col("p_name")
    if ordered:
        columns["pkg_ord"] = F.col("pkg_ord")
    return line.select(*[c.alias(n) for n, c in columns.items()])


def packages(spark: SparkSession, sf_dir: str, *, ordered: bool = True, sized: bool = True) -> DataFrame:
    """Package records with their fields lifted to source and working values."""
    rec = records(spark, sf_dir, ordered=ordered, sized=sized)
    return package_fields(rec, ordered=ordered, sized=sized)


def package_columns(*, sized: bool = True) -> dict[str, Column]:
    """The fields of a package over its record."""
    locator = F.concat(F.lit("Page "), F.col("segment_no").cast("string"))
    status = F.col("status")

    def field(value: str, unit: str | None = None, required: bool = False):
        unit_col = F.col(unit) if unit else None
        return lift(F.col(value), unit_col, status, locator, F.col(value), required=required)

    out = {
        "case_number": field("case_value", required=True),
        "gross_weight": field("gross_value", "weight_unit", True),
        "net_weight": field("net_value", "weight_unit", True),
    }
    if sized:
        for side in ("length", "width", "height"):
            out[side] = field(f"{side}_value")
    return out


def package_fields(rec: DataFrame, *more: str, ordered: bool = True, sized: bool = True) -> DataFrame:
    """Packages with their fields, and further columns of the records."""
    keys = ["job_id", *(["pkg_ord"] if ordered else [])]
    out = package_columns(sized=sized)
    return rec.select(
        *keys, "segment_no", "status", "dim_unit", *[c.alias(n) for n, c in out.items()], *more
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_fields(records(spark, sf_dir))


def item_columns() -> dict[str, Column]:
    """The fields of an item over its record."""
    locator = F.concat(F.lit("Page "), F.col("segment_no").cast("string"))

    def field(value, kind=None):
        value = value.cast("string")
        return lift(value, None, F.col("status"), locator, value, kind=kind)

    return {
        "sequence": field(F.col("item_seq"), F.lit("int")),
        "item_number": field(F.col("item_number")),
        "description": field(F.col("item_description")),
        "quantity": field(F.col("item_quantity")),
        "uom": field(F.col("item_uom")),
    }


def item_fields(rec: DataFrame, *more: Column) -> DataFrame:
    """Items with their fields, and further columns of the records."""
    return rec.select(
        "job_id",
        "pkg_ord",
        F.lit(1).cast("bigint").alias("item_ord"),
        "segment_no",
        "status",
        *[c.alias(n) for n, c in item_columns().items()],
        *more,
    )


def job_columns() -> dict[str, Column]:
    """The document-level fields of a job over its order."""
    status = F.col("o_orderstatus")
    purchase_order = F.when(status != "O", F.concat(F.lit("PO-"), F.col("o_custkey").cast("string")))
    supplier = F.when(status == "F", F.concat(F.lit("Supplier "), F.substring("o_orderpriority", 1, 1)))
    return {
        "purchase_order": lift(purchase_order),
        "purchase_order_position": lift(F.when(status == "P", F.lit("10"))),
        "supplier_name": lift(supplier),
    }


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its project, status and document-level fields."""
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("project_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        status.alias("order_status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("created_at"),
        *[c.alias(n) for n, c in job_columns().items()],
    )


def project_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of each project with their ordinal, from 0, in order of the job number; loaded once."""
    return staged(spark, f"project_jobs:{sf_dir}", lambda: load_project_jobs(spark, sf_dir))


def load_project_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("job_id")
    )
    ranked = numbered(
        link, ["project_id"], {"_piece": F.floor(F.col("job_id") / 65536)}, ["job_id"], "ordinal"
    )
    return ranked.withColumn("ordinal", F.col("ordinal") - 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def knowledge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge files: the path is source and number, the title the first line."""
    doc = documents(spark, sf_dir)
    return doc.select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        "text",
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("job_id"),
        "event_type",
        F.col("props").alias("payload"),
        F.col("ts").alias("created_at"),
    )


# ---- contexts ------------------------------------------------------------


def _struct(names: list[str], given: dict):
    from cargolens.operators.context import NUMERIC_CONTEXT

    return F.struct(
        *[
            given.get(n, F.lit(None)).cast("double" if n in NUMERIC_CONTEXT else "string").alias(n)
            for n in names
        ]
    )


def project_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and case defaults of every project, from its customer."""
    from cargolens.operators.context import CASE_FIELDS, HEADER_FIELDS

    c = table(spark, sf_dir, "customer")
    segment, balance, nation = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey")
    header = {
        "currency": F.when(segment == "BUILDING", "EUR").otherwise("USD"),
        "supplier_name": F.when(balance >= 0, F.concat(F.lit("Supplier of "), F.col("c_name"))),
        "project_name": F.col("c_name"),
        "delivery_location": F.when(nation % 5 != 0, F.concat(F.lit("Nation "), nation.cast("string"))),
        "other_remarks": F.lit(""),
    }
    defaults = {
        "content_description": segment,
        "equipment_group": F.when(balance >= 0, "EQ"),
        "border_crossing_value": balance,
        "declare_as": F.when(segment == "BUILDING", "System")
        .when(segment == "MACHINERY", "Loose Parts")
        .when(segment == "HOUSEHOLD", "Parts"),
        "purchase_order": F.when(segment == "FURNITURE", "PRJ-PO"),
        "storage_requirement": F.lit("Indoor"),
        "packaging_material": F.when(nation % 7 == 0, "CARDBOARD").otherwise("PALLET"),
        "stackability": F.lit("Not stackable"),
        "dangerous_goods": F.lit("N"),
        "remarks": F.lit(""),
    }
    return c.select(
        F.col("c_custkey").alias("project_id"),
        _struct(HEADER_FIELDS, header).alias("header"),
        _struct(CASE_FIELDS, defaults).alias("defaults"),
    )


def project_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargolens.operators.context import CASE_FIELDS

    c = table(spark, sf_dir, "customer")
    first = _struct(
        CASE_FIELDS,
        {"equipment_group": F.lit("EQ-0"), "packaging_material": F.lit("DRUM"), "remarks": F.lit("fragile")},
    )
    second = _struct(CASE_FIELDS, {"declare_as": F.lit(""), "dangerous_goods": F.lit("Y")})
    entry = lambda case, values: F.struct(F.lit(case).alias("case_number"), values.alias("override"))
    rows = F.array(
        F.when(F.col("c_acctbal") < 0, entry("C-0", first)),
        F.when(F.col("c_mktsegment") == "BUILDING", entry("C-2", second)),
    )
    return c.select(F.col("c_custkey").alias("project_id"), F.explode(rows).alias("_o")).filter(
        F.col("_o").isNotNull()
    ).select("project_id", "_o.case_number", "_o.override")


def job_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and defaults set on the job itself, for orders that are not open."""
    from cargolens.operators.context import CASE_FIELDS, HEADER_FIELDS

    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "O")
    priority = F.col("o_orderpriority")
    header = {"currency": F.when(priority == "1-URGENT", "CHF"), "supplier_reference": priority}
    defaults = {
        "remarks": F.when(F.col("o_orderstatus") == "P", priority),
        "border_crossing_value": F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")),
        "storage_requirement": F.lit(""),
    }
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        _struct(HEADER_FIELDS, header).alias("header"),
        _struct(CASE_FIELDS, defaults).alias("defaults"),
    )


def job_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargolens.operators.context import CASE_FIELDS

    o = table(spark, sf_dir, "orders")
    first = _struct(CASE_FIELDS, {"packaging_material": F.lit("WOODEN_BOX")})
    second = _struct(CASE_FIELDS, {"remarks": F.lit("by hand"), "packaging_material": F.lit("")})
    entry = lambda case, values: F.struct(F.lit(case).alias("case_number"), values.alias("override"))
    rows = F.array(
        F.when(F.col("o_orderstatus") == "F", entry("C-1", first)),
        F.when(F.col("o_orderpriority") == "2-HIGH", entry("C-0", second)),
    )
    return o.select(F.col("o_orderkey").alias("job_id"), F.explode(rows).alias("_o")).filter(
        F.col("_o").isNotNull()
    ).select("job_id", "_o.case_number", "_o.override")
