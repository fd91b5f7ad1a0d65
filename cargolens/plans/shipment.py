"""Registered queries: typed questions, predicates and scalar functions on packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions import values as V
from cargolens.operators import queries as Q
from cargolens.plans import sql as S
from cargolens.plans.validation import ISSUES, issue_rows
from cargolens.sources import bridge

WEIGHT_LIMIT = 300.0


def _packages(spark, sf, sized=False, ordered=True):
    return bridge.packages(spark, sf, sized=sized, ordered=ordered)


# ---- scalar functions ----------------------------------------------------


def f1_current_value(spark, sf):
    """Working value hides the source value, even when null: here lines of open status lose theirs."""
    df = _packages(spark, sf)
    cleared = F.struct(
        F.lit(None).cast("string").alias("value"),
        F.lit("null").alias("value_kind"),
        F.col("gross_weight.working.unit").alias("unit"),
        F.lit("user_edit").alias("origin"),
        F.lit("user").alias("modified_by"),
        F.lit(None).cast("string").alias("reason"),
    )
    working = (
        F.when(F.col("status") == "AMBIGUOUS", cleared.cast(V.WORKING))
        .when(F.col("status") == "CONFIRMED", F.lit(None).cast(V.WORKING))
        .otherwise(F.col("gross_weight.working"))
    )
    field = F.col("gross_weight").withField("working", working)
    return df.select("job_id", "pkg_ord", V.current_value(field).alias("value"))


F1_SQL = S.with_(S.REC) + (
    "SELECT job_id, pkg_ord, CASE WHEN status = 'AMBIGUOUS' THEN NULL ELSE gross_value END AS value FROM rec"
)


def _unit_case(df):
    """A field whose working unit is blank while its source has one."""
    blank = F.when(F.col("status") == "SUPPORTED", F.lit("")).otherwise(F.col("gross_weight.working.unit"))
    return F.col("gross_weight").withField("working.unit", blank)


def f2_checked_unit(spark, sf):
    df = _packages(spark, sf)
    return df.select("job_id", "pkg_ord", V.checked_unit(_unit_case(df)).alias("unit"))


F2_SQL = S.with_(S.REC) + f"SELECT job_id, pkg_ord, {S.unit('weight_unit')} AS unit FROM rec"


def f3_output_unit(spark, sf):
    df = _packages(spark, sf)
    return df.select("job_id", "pkg_ord", V.output_unit(_unit_case(df)).alias("unit"))


F3_SQL = S.with_(S.REC) + (
    f"SELECT job_id, pkg_ord, CASE WHEN status = 'SUPPORTED' THEN '' ELSE {S.unit('weight_unit')} END AS unit FROM rec"
)


def f4_normal_unit(spark, sf):
    return (
        _packages(spark, sf, sized=True, ordered=False)
        .select(V.normal_unit(F.col("dim_unit")).alias("unit"))
        .groupBy("unit")
        .agg(F.count("*").alias("packages"))
    )


F4_SQL = S.with_(S.REC) + (
    f"SELECT {S.unit('dim_unit')} AS unit, count(*) AS packages FROM rec GROUP BY 1"
)


def f5_number(spark, sf):
    df = _packages(spark, sf)
    return df.select("job_id", "pkg_ord", V.field_number(F.col("gross_weight")).alias("value"))


F5_SQL = S.with_(S.REC) + f"SELECT job_id, pkg_ord, {S.num('gross_value')} AS value FROM rec"


def f6_missing(spark, sf):
    df = _packages(spark, sf)
    miss = lambda n: V.is_missing(V.current_value(F.col(n))).alias(f"{n}_missing")
    return df.select("job_id", "pkg_ord", miss("case_number"), miss("gross_weight"), miss("net_weight"))


F6_SQL = S.with_(S.REC) + """SELECT job_id, pkg_ord, coalesce(case_value, '') = '' AS case_number_missing,
 coalesce(gross_value, '') = '' AS gross_weight_missing, coalesce(net_value, '') = '' AS net_weight_missing FROM rec"""


def f7_case_number(spark, sf):
    df = _packages(spark, sf)
    return df.select(
        "job_id",
        "pkg_ord",
        V.case_text(F.col("case_number")).alias("case_number"),
        V.case_label(F.col("case_number")).alias("case_label"),
    )


F7_SQL = S.with_(S.REC) + (
    f"SELECT job_id, pkg_ord, {S.case()} AS case_number, {S.label()} AS case_label FROM rec"
)


def f8_length_cm(spark, sf):
    value, origin = V.length_cm(F.col("length"), F.col("dim_unit"))
    return _packages(spark, sf, sized=True).select(
        "job_id", "pkg_ord", F.round(value, 6).alias("length_cm"), origin.alias("origin")
    )


def _cm_sql(value: str) -> str:
    return f"CASE du WHEN 'CM' THEN {value} WHEN 'MM' THEN {value} / 10.0 ELSE {value} * 2.54 END"


F8_SQL = S.with_(S.PK) + f"""SELECT job_id, pkg_ord, round({_cm_sql('len')}, 6) AS length_cm,
 CASE WHEN len IS NULL THEN NULL WHEN du = 'CM' THEN 'source' WHEN du = 'MM' THEN 'converted_mm_to_cm'
 ELSE 'converted_in_to_cm' END AS origin FROM pk"""


def f9_weight_kg(spark, sf):
    value, origin = V.weight_kg(F.col("gross_weight"))
    return _packages(spark, sf).select(
        "job_id", "pkg_ord", F.round(value, 6).alias("gross_kg"), origin.alias("origin")
    )


F9_SQL = S.with_(S.PK) + """SELECT job_id, pkg_ord,
 round(CASE wu WHEN 'LB' THEN gross * 0.45359237 WHEN 'STONE' THEN NULL ELSE gross END, 6) AS gross_kg,
 CASE WHEN gross IS NULL THEN NULL WHEN wu = 'KG' THEN 'source' WHEN wu = '' THEN 'assumed_kg'
 WHEN wu = 'LB' THEN 'converted_lb_to_kg' ELSE 'unsupported_weight_unit:' || wu END AS origin FROM pk"""


def f10_volume(spark, sf):
    sides = [V.length_cm(F.col(s), F.col("dim_unit"))[0] for s in ("length", "width", "height")]
    value, origin = V.volume_m3(*sides)
    return _packages(spark, sf, sized=True).select(
        "job_id", "pkg_ord", F.round(value, 6).alias("volume_m3"), origin.alias("origin")
    )


F10_SQL = S.with_(S.PK) + f"""SELECT job_id, pkg_ord,
 round({_cm_sql('len')} * {_cm_sql('wid')} * {_cm_sql('hei')} / 1000000, 6) AS volume_m3,
 CASE WHEN len IS NOT NULL AND wid IS NOT NULL AND hei IS NOT NULL
 THEN 'calculated_preview_template_formula' ELSE 'template_formula' END AS origin FROM pk"""


def f11_package_metrics(spark, sf):
    """The six metrics of every package as rows (metric, value, unit)."""
    rec = bridge.records(spark, sf)
    df = bridge.package_fields(rec).withColumn("item_count", F.lit(1))
    rows = []
    for name in Q.METRICS:
        value, unit = Q.metric(name)
        rows.append(F.struct(F.lit(name).alias("metric"), value.alias("value"), unit.alias("unit")))
    return df.select("job_id", "pkg_ord", F.inline(F.array(*rows)))


F11_SQL = S.with_(S.PK) + "\nUNION ALL\n".join(
    f"SELECT job_id, pkg_ord, '{name}' AS metric, {value} AS value, {unit} AS unit FROM pk"
    for name, value, unit in [
        ("gross_weight", "gross", "nullif(wu, '')"),
        ("net_weight", "net", "nullif(wu, '')"),
        ("length", "len", "nullif(du, '')"),
        ("width", "wid", "nullif(du, '')"),
        ("height", "hei", "nullif(du, '')"),
        ("item_count", "CAST(1 AS DOUBLE)", "CAST(NULL AS VARCHAR)"),
    ]
)


def f27_short_number(spark, sf):
    """Numbers as messages show them: quantity scaled over nine powers of ten."""
    line = bridge.table(spark, sf, "lineitem")
    value = F.col("l_quantity") * F.pow(F.lit(10.0), (F.col("l_linenumber") - 2).cast("double"))
    return (
        line.select(F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("scale"), value.alias("v"))
        .distinct()
        .select("quantity", "scale", V.short_number(F.col("v")).alias("shown"))
    )


F27_SQL = """SELECT DISTINCT l_quantity AS quantity, l_linenumber AS scale,
 regexp_replace(CASE WHEN l_quantity * pow(10, l_linenumber - 2) >= 1e6
   THEN printf('%.5e', l_quantity * pow(10, l_linenumber - 2))
   ELSE printf('%.5f', l_quantity * pow(10, l_linenumber - 2)) END,
   '\\.?0+(e|$)', '\\1') AS shown FROM lineitem"""


def f28_field_lift(spark, sf):
    df = _packages(spark, sf)
    f = F.col("gross_weight")
    return df.select(
        "job_id",
        "pkg_ord",
        f["source"]["value"].alias("source_value"),
        f["working"]["value"].alias("working_value"),
        f["working"]["origin"].alias("origin"),
        F.size(f["source"]["evidence"]).alias("evidence_count"),
        f["source"]["evidence"][0]["locator"].alias("locator"),
        f["source"]["evidence"][0]["status"].alias("evidence_status"),
        f["required"].alias("required"),
        f["modified"].alias("modified"),
    )


F28_SQL = S.with_(S.REC) + """SELECT job_id, pkg_ord, gross_value AS source_value, gross_value AS working_value,
 'source' AS origin, CAST(1 AS INT) AS evidence_count, 'Page ' || CAST(segment_no AS VARCHAR) AS locator,
 status AS evidence_status, true AS required, false AS modified FROM rec"""


# ---- questions -----------------------------------------------------------


def q1_count_packages(spark, sf):
    return Q.count_packages(bridge.jobs(spark, sf), _packages(spark, sf, ordered=False))


Q1_SQL = """SELECT o_orderkey AS job_id, count(l_orderkey) AS package_count
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""


def q2_filter_packages(spark, sf):
    return Q.filter_packages(_packages(spark, sf), "gross_weight", "gt", WEIGHT_LIMIT, "KG")


Q2_SQL = S.with_(S.PK) + """SELECT job_id, pkg_ord, case_label AS case_number, gross AS value, wu AS unit
 FROM pk WHERE gross > 300 AND wu = 'KG'"""


def q2_skipped_units(spark, sf):
    return Q.skipped_units(_packages(spark, sf), "gross_weight", "gt", WEIGHT_LIMIT, "kg.")


Q2_SKIPPED_SQL = S.with_(S.PK) + """SELECT DISTINCT job_id,
 CASE wu WHEN '' THEN '(missing)' ELSE wu END AS unit FROM pk WHERE gross IS NOT NULL AND wu <> 'KG'"""


def q2_missing_cases(spark, sf):
    return Q.missing_cases(_packages(spark, sf), "gross_weight")


Q2_MISSING_SQL = S.with_(S.PK) + "SELECT job_id, pkg_ord, case_label AS case_number FROM pk WHERE gross IS NULL"


def p1_comparators(spark, sf):
    """How many packages meet each comparator against the same length."""
    df = _packages(spark, sf, sized=True, ordered=False)
    value, _ = Q.metric("length")
    counts = [F.count_if(V.ordered(value, op, F.lit(250.0))).alias(op) for op in Q.COMPARATORS]
    return df.agg(*counts)


P1_SQL = S.with_(S.PK) + """SELECT count(*) FILTER (len > 250) AS gt, count(*) FILTER (len >= 250) AS gte,
 count(*) FILTER (len < 250) AS lt, count(*) FILTER (len <= 250) AS lte, count(*) FILTER (len = 250) AS eq FROM pk"""


def p2_filter_outcomes(spark, sf):
    """Match, no match, skipped for the unit, missing: how many packages of each kind, per unit."""
    df = bridge.package_fields(bridge.records(spark, sf, ordered=False), ordered=False)
    labelled = Q.classify_packages(
        df.withColumn("pkg_ord", F.lit(None).cast("bigint")), "length", "gte", 250, "cm"
    )
    return labelled.groupBy("outcome", "unit").agg(F.count("*").alias("packages"))


P2_SQL = S.with_(S.PK) + """SELECT CASE WHEN len IS NULL THEN 'missing' WHEN du <> 'CM' THEN 'skipped_unit'
 WHEN len >= 250 THEN 'match' ELSE 'no_match' END AS outcome, du AS unit, count(*) AS packages FROM pk GROUP BY 1, 2"""


def p4_known_units(spark, sf):
    unit = V.checked_unit(F.col("gross_weight"))
    df = _packages(spark, sf, ordered=False)
    return (
        df.select(unit.alias("unit"), unit.isin(V.WEIGHT_UNITS).alias("known"))
        .groupBy("unit", "known")
        .agg(F.count("*").alias("packages"))
    )


P4_SQL = S.with_(S.PK) + (
    "SELECT wu AS unit, wu IN ('KG', 'LB') AS known, count(*) AS packages FROM pk GROUP BY 1, 2"
)


def q3_sum_by_unit(spark, sf):
    return Q.sum_by_unit(_packages(spark, sf, ordered=False), "gross_weight", ["job_id"])


Q3_SQL = S.with_(S.PK) + """SELECT job_id, CASE wu WHEN '' THEN '(unitless)' ELSE wu END AS unit,
 sum(gross) AS total, count(*) AS packages FROM pk WHERE gross IS NOT NULL GROUP BY 1, 2"""


def q3_sum_by_unit_all(spark, sf):
    return Q.sum_by_unit(_packages(spark, sf, ordered=False), "gross_weight", [])


Q3_ALL_SQL = S.with_(S.PK) + """SELECT CASE wu WHEN '' THEN '(unitless)' ELSE wu END AS unit,
 sum(gross) AS total, count(*) AS packages FROM pk WHERE gross IS NOT NULL GROUP BY 1"""


def q6_batch(spark, sf):
    """A batch of typed queries over the same tables: rows of each result, or why the query was refused."""
    pk = bridge.package_fields(bridge.records(spark, sf))
    issues = issue_rows(spark, sf)
    batch = [
        {"operation": "count_packages"},
        {"operation": "filter_packages", "field": "gross_weight", "comparator": "gte", "value": 400, "unit": "KG"},
        {"operation": "filter_packages", "field": "width", "comparator": "lt", "value": 100},
        {"operation": "sum_package_field", "field": "net_weight"},
        {"operation": "list_issues", "severity": "BLOCKING"},
        {"operation": "list_issues"},
        {"operation": "count_packages"},
    ]
    results = Q.answer(pk, issues, bridge.jobs(spark, sf), batch)
    out = None
    for number, result in enumerate(results, start=1):
        part = result.agg(F.count("*").alias("result_rows")).select(
            F.lit(number).alias("query_no"), "result_rows", F.lit(None).cast("string").alias("refused")
        )
        out = part if out is None else out.unionByName(part)
    return out.unionByName(Q.refused(spark, batch))


Q6_SQL = S.with_(ISSUES) + f"""SELECT 1 AS query_no, count(*) AS result_rows, CAST(NULL AS VARCHAR) AS refused FROM orders
UNION ALL SELECT 2, count(*), NULL FROM pk WHERE gross >= 400 AND wu = 'KG'
UNION ALL SELECT 3, count(*), NULL FROM pk WHERE wid < 100
UNION ALL SELECT 4, count(*), NULL FROM (SELECT DISTINCT job_id, wu FROM pk WHERE net IS NOT NULL)
UNION ALL SELECT 5, count(*), NULL FROM iss WHERE severity = 'BLOCKING'
UNION ALL SELECT 6, count(*), NULL FROM iss
UNION ALL SELECT 7, NULL, 'a batch holds {Q.MAX_QUERIES} queries'"""


def q7_total_lines(spark, sf):
    return Q.total_lines(Q.sum_by_unit(_packages(spark, sf, ordered=False), "gross_weight", ["job_id"]), "gross_weight")


Q7_TOTAL_SQL = S.with_(S.PK, """tot AS (SELECT job_id, CASE wu WHEN '' THEN '(unitless)' ELSE wu END AS unit,
 sum(gross) AS total FROM pk WHERE gross IS NOT NULL GROUP BY 1, 2)""") + """SELECT job_id, unit,
 'Total gross weight: ' || CAST(CAST(total AS BIGINT) AS VARCHAR)
 || CASE unit WHEN '(unitless)' THEN '' ELSE ' ' || unit END AS line FROM tot"""


def q7_match_lines(spark, sf):
    return Q.match_lines(Q.filter_packages(_packages(spark, sf), "gross_weight", "gt", WEIGHT_LIMIT, "KG"))


Q7_MATCH_SQL = S.with_(S.PK) + """SELECT job_id, pkg_ord,
 case_label || ' (' || CAST(CAST(gross AS BIGINT) AS VARCHAR) || ' KG)' AS line FROM pk WHERE gross > 300 AND wu = 'KG'"""


def q8_package_summary(spark, sf):
    rec = bridge.records(spark, sf)
    return Q.package_summary(bridge.package_fields(rec), bridge.item_fields(rec))


Q8_SQL = S.with_(S.PK) + """SELECT job_id, n AS package_index, case_value AS case_number, gross_value AS gross_weight,
 weight_unit AS gross_weight_unit, net_value AS net_weight, weight_unit AS net_weight_unit, length_value AS length,
 width_value AS width, height_value AS height, dim_unit AS dimension_unit, CAST(1 AS BIGINT) AS item_count FROM pk"""


QUERIES = {
    "f1_current_value": (f1_current_value, F1_SQL),
    "f2_checked_unit": (f2_checked_unit, F2_SQL),
    "f3_output_unit": (f3_output_unit, F3_SQL),
    "f4_normal_unit": (f4_normal_unit, F4_SQL),
    "f5_number": (f5_number, F5_SQL),
    "f6_missing": (f6_missing, F6_SQL),
    "f7_case_number": (f7_case_number, F7_SQL),
    "f8_length_cm": (f8_length_cm, F8_SQL),
    "f9_weight_kg": (f9_weight_kg, F9_SQL),
    "f10_volume": (f10_volume, F10_SQL),
    "f11_package_metrics": (f11_package_metrics, F11_SQL),
    "f27_short_number": (f27_short_number, F27_SQL),
    "f28_field_lift": (f28_field_lift, F28_SQL),
    "p1_comparators": (p1_comparators, P1_SQL),
    "p2_filter_outcomes": (p2_filter_outcomes, P2_SQL),
    "p4_known_units": (p4_known_units, P4_SQL),
    "q1_count_packages": (q1_count_packages, Q1_SQL),
    "q2_filter_packages": (q2_filter_packages, Q2_SQL),
    "q2_skipped_units": (q2_skipped_units, Q2_SKIPPED_SQL),
    "q2_missing_cases": (q2_missing_cases, Q2_MISSING_SQL),
    "q3_sum_by_unit": (q3_sum_by_unit, Q3_SQL),
    "q3_sum_by_unit_all": (q3_sum_by_unit_all, Q3_ALL_SQL),
    "q6_batch": (q6_batch, Q6_SQL),
    "q7_total_lines": (q7_total_lines, Q7_TOTAL_SQL),
    "q7_match_lines": (q7_match_lines, Q7_MATCH_SQL),
    "q8_package_summary": (q8_package_summary, Q8_SQL),
}
