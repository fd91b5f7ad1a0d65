"""Registered queries: validation rules, issue counts, fingerprints, acknowledgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions.values import case_text, lift
from cargolens.operators import fields as FL
from cargolens.operators import queries as Q
from cargolens.operators import rules as R
from cargolens.plans import sql as S
from cargolens.session import staged
from cargolens.sources import bridge

SHOWN = ["job_id", "code", "severity", "message", "case_number", "field_path"]


def _swapped(pk):
    """Variants in which the rarer faults occur: net weight read from the gross text, sides in weight units."""
    sided = [F.col(s).withField("working.unit", F.col("gross_weight.working.unit")).alias(s) for s in FL.SIDES]
    rest = [c for c in pk.columns if c not in (*FL.SIDES, "net_weight", "dim_unit")]
    return pk.select(
        *rest,
        *sided,
        F.col("gross_weight").alias("net_weight"),
        F.lit(None).cast("string").alias("dim_unit"),
    )


def _rule(code: str, swapped: bool = False, sized: bool = True):
    def build(spark, sf):
        pk = bridge.packages(spark, sf, sized=sized)
        if swapped:
            pk = _swapped(pk)
        return R.package_issues(pk, {code}).select(*SHOWN)

    build.__name__ = code.lower()
    build.__doc__ = f"Issues of rule {code}."
    return build


def _path(name: str) -> str:
    tail = f".dimensions.{name}" if name in FL.SIDES else f".{name}"
    return f"'packages[' || CAST(n AS VARCHAR) || ']{tail}'"


def _item_path(name: str) -> str:
    return f"'packages[' || CAST(n AS VARCHAR) || '].items[0].{name}'"


def _row(code: str, severity: str, where: str, message: str, path: str, source: str = "pk", case: str = "case_no") -> str:
    return (
        f"SELECT job_id, '{code}' AS code, '{severity}' AS severity, {message} AS message, "
        f"{case} AS case_number, {path} AS field_path FROM {source} WHERE {where}"
    )


def _weight_sql(prefix: str, text: str, value: str) -> dict[str, str]:
    label, path = prefix.title(), _path(f"{prefix.lower()}_weight")
    here = f"coalesce({text}, '') <> ''"
    return {
        f"{prefix}_WEIGHT_MISSING": _row(
            f"{prefix}_WEIGHT_MISSING", "WARNING", f"coalesce({text}, '') = ''", f"'{label} weight is missing.'", path
        ),
        f"{prefix}_WEIGHT_INVALID": _row(
            f"{prefix}_WEIGHT_INVALID", "BLOCKING", f"{here} AND {value} IS NULL", f"'{label} weight is not numeric.'", path
        ),
        f"{prefix}_WEIGHT_UNIT_MISSING": _row(
            f"{prefix}_WEIGHT_UNIT_MISSING",
            "WARNING",
            f"{here} AND {value} IS NOT NULL AND wu = ''",
            f"'{label} weight has no source/working unit.'",
            path,
        ),
        f"{prefix}_WEIGHT_UNIT_UNKNOWN": _row(
            f"{prefix}_WEIGHT_UNIT_UNKNOWN",
            "WARNING",
            f"{here} AND {value} IS NOT NULL AND wu NOT IN ('', 'KG', 'LB')",
            f"'{label} weight unit ''' || wu || ''' is not recognised.'",
            path,
        ),
    }


def _side_sql(code: str, severity: str, where: str, message: str) -> str:
    parts = []
    for side, text, value in (
        ("length", "length_value", "len"),
        ("width", "width_value", "wid"),
        ("height", "height_value", "hei"),
    ):
        parts.append(
            _row(
                code,
                severity,
                where.format(text=text, value=value),
                message.format(label=side.title()),
                _path(side),
            )
        )
    return "\nUNION ALL\n".join(parts)


PRESENT = " + ".join(f"CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE 1 END" for t in ("length_value", "width_value", "height_value"))
RULE_SQL: dict[str, str] = {
    "NO_PACKAGES": (
        "SELECT o_orderkey AS job_id, 'NO_PACKAGES' AS code, 'BLOCKING' AS severity, "
        "'No packages/cases were mapped from the source document.' AS message, CAST(NULL AS VARCHAR) AS case_number, "
        "CAST(NULL AS VARCHAR) AS field_path FROM orders WHERE NOT EXISTS "
        "(SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"
    ),
    "CASE_NUMBER_MISSING": _row(
        "CASE_NUMBER_MISSING",
        "BLOCKING",
        "case_no IS NULL",
        "'Package ' || CAST(pkg_ord AS VARCHAR) || ' has no case/package identifier.'",
        _path("case_number"),
    ),
    "CASE_NUMBER_DUPLICATE": _row(
        "CASE_NUMBER_DUPLICATE",
        "BLOCKING",
        "case_no IS NOT NULL AND use_no > 1",
        "'Case ' || case_no || ' appears more than once after mapping. "
        "Continuation pages should normally be merged.'",
        _path("case_number"),
        "(SELECT *, row_number() OVER (PARTITION BY job_id, case_no ORDER BY pkg_ord) AS use_no FROM pk)",
    ),
    **_weight_sql("GROSS", "gross_value", "gross"),
    **_weight_sql("NET", "net_value", "net"),
    "GROSS_BELOW_NET": _row(
        "GROSS_BELOW_NET",
        "WARNING",
        "gross < net",
        "'Gross weight (' || CAST(CAST(gross AS BIGINT) AS VARCHAR) || ') is lower than net weight (' "
        "|| CAST(CAST(net AS BIGINT) AS VARCHAR) || ').'",
        _path("gross_weight"),
    ),
    "DIMENSIONS_INCOMPLETE": _row(
        "DIMENSIONS_INCOMPLETE",
        "WARNING",
        f"({PRESENT}) IN (1, 2)",
        "'Only part of the L/W/H dimensions were mapped.'",
        "'packages[' || CAST(n AS VARCHAR) || '].dimensions'",
    ),
    "DIMENSION_INVALID": _side_sql(
        "DIMENSION_INVALID",
        "BLOCKING",
        "coalesce({text}, '') <> '' AND ({value} IS NULL OR {value} < 0)",
        "'{label} must be a non-negative number.'",
    ),
    "ITEM_UOM_MISSING": _row(
        "ITEM_UOM_MISSING",
        "WARNING",
        "coalesce(item_uom, '') = ''",
        "'Item 1 has a quantity but no unit of measure.'",
        _item_path("uom"),
    ),
    "MAPPING_AMBIGUOUS": "\nUNION ALL\n".join(
        _row(
            "MAPPING_AMBIGUOUS",
            "WARNING",
            "status = 'AMBIGUOUS'",
            "'The source mapper marked this field as ambiguous. Confirm or edit the working value.'",
            _path(n) if n in bridge.PACKAGE_FIELDS else _item_path(n),
        )
        for n in (*bridge.PACKAGE_FIELDS, *bridge.ITEM_FIELDS)
    ),
}
# Rules whose fault the plain model does not hold, on the swapped variant.
SWAPPED_SQL = {
    "NET_WEIGHT_INVALID": _weight_sql("NET", "gross_value", "gross")["NET_WEIGHT_INVALID"],
    "DIMENSION_UNIT_MISSING": _side_sql(
        "DIMENSION_UNIT_MISSING",
        "WARNING",
        "{value} >= 0 AND wu = ''",
        "'{label} has no source/working dimension unit.'",
    ),
    "DIMENSION_UNIT_UNKNOWN": _side_sql(
        "DIMENSION_UNIT_UNKNOWN",
        "WARNING",
        "{value} >= 0 AND wu <> ''",
        "'{label} unit ''' || wu || ''' is not recognised.'",
    ),
    "ITEM_QUANTITY_INVALID": _row(
        "ITEM_QUANTITY_INVALID",
        "WARNING",
        "coalesce(gross_value, '') <> '' AND gross IS NULL",
        "'Item 1 quantity is not numeric.'",
        _item_path("quantity"),
    ),
}
ISSUES = S.PK + ",\niss AS (" + "\nUNION ALL\n".join(RULE_SQL.values()) + ")"


def v1_no_packages(spark, sf):
    pk = bridge.packages(spark, sf, ordered=False, sized=False)
    return R.missing_package_issues(bridge.jobs(spark, sf), pk).select(*SHOWN)


def _items(spark, sf, quantity_from_gross=False):
    rec = bridge.records(spark, sf)
    pk, items = bridge.package_fields(rec), bridge.item_fields(rec)
    if quantity_from_gross:
        items = bridge.item_fields(rec.withColumn("item_quantity", F.col("gross_value")))
    return items, R.package_cases(pk)


def v17_item_quantity_invalid(spark, sf):
    items, cases = _items(spark, sf, quantity_from_gross=True)
    return R.item_issues(items, cases, {"ITEM_QUANTITY_INVALID"}).select(*SHOWN)


def v18_item_uom_missing(spark, sf):
    items, cases = _items(spark, sf)
    return R.item_issues(items, cases, {"ITEM_UOM_MISSING"}).select(*SHOWN)


def long_fields(spark, sf):
    """Every field of packages, items, orders and shipments with its path."""
    rec = bridge.records(spark, sf)
    pk = bridge.package_fields(rec)
    # an item stands on the same line as its package, so the case needs no join here
    with_case = bridge.item_fields(rec, case_text(lift(F.col("case_value"), required=True)).alias("case_number"))
    item_rows = FL._long(
        with_case,
        bridge.ITEM_FIELDS,
        FL.item_path,
        "packages",
        [F.col("pkg_ord"), F.col("item_ord"), F.col("case_number")],
    )
    jobs = FL.job_fields_long(
        bridge.jobs(spark, sf),
        {"purchase_order": "order", "purchase_order_position": "order", "supplier_name": "shipment"},
    )
    return FL.package_fields_long(pk, bridge.PACKAGE_FIELDS).unionByName(item_rows).unionByName(jobs)


def field_records(spark, sf):
    """The fields of ``long_fields`` as columns over the records and orders they come from."""
    rec = bridge.records(spark, sf)
    case = case_text(lift(F.col("case_value"), required=True))
    orders = bridge.table(spark, sf, "orders").withColumn("job_id", F.col("o_orderkey"))
    own = bridge.job_columns()
    return [
        FL.package_records(rec, bridge.package_columns()),
        FL.item_records(rec.withColumn("item_ord", F.lit(1).cast("bigint")), bridge.item_columns(), case),
        FL.job_records(orders, {n: own[n] for n in ("purchase_order", "purchase_order_position")}, "order"),
        FL.job_records(orders, {"supplier_name": own["supplier_name"]}, "shipment"),
    ]


def v19_mapping_ambiguous(spark, sf):
    return R.ambiguity_record_issues(field_records(spark, sf)).select(*SHOWN)


def n1_field_paths(spark, sf):
    """Nested records as one long table: path, case and current value of every field."""
    from cargolens.functions.values import current_value

    return long_fields(spark, sf).select(
        "job_id", "path", "root", "case_number", current_value(F.col("field")).alias("value")
    )


def _n1_rows() -> str:
    texts = {
        "case_number": "case_value", "gross_weight": "gross_value", "net_weight": "net_value",
        "length": "length_value", "width": "width_value", "height": "height_value",
        "sequence": "CAST(item_seq AS VARCHAR)", "item_number": "item_number", "description": "item_description",
        "quantity": "item_quantity", "uom": "item_uom",
    }
    rows = [
        f"SELECT job_id, {_path(n) if n in bridge.PACKAGE_FIELDS else _item_path(n)} AS path, 'packages' AS root, "
        f"case_no AS case_number, {t} AS value FROM pk"
        for n, t in texts.items()
    ]
    for name, root in (("purchase_order", "order"), ("purchase_order_position", "order"), ("supplier_name", "shipment")):
        rows.append(
            f"SELECT job_id, '{root}.{name}' AS path, '{root}' AS root, CAST(NULL AS VARCHAR) AS case_number, "
            f"{name} AS value FROM jobs"
        )
    return "\nUNION ALL\n".join(rows)


def n2_records_from_fields(spark, sf):
    """Long fields put together again as package records."""
    from cargolens.functions.values import current_value

    pk = bridge.packages(spark, sf)
    long = FL.package_fields_long(pk, bridge.PACKAGE_FIELDS)
    wide = FL.to_records(long, ["job_id", "pkg_ord"], bridge.PACKAGE_FIELDS)
    return wide.select("job_id", "pkg_ord", *[current_value(F.col(n)).alias(n) for n in bridge.PACKAGE_FIELDS])


N2_SQL = S.with_(S.REC) + """SELECT job_id, pkg_ord, case_value AS case_number, gross_value AS gross_weight,
 net_value AS net_weight, length_value AS length, width_value AS width, height_value AS height FROM rec"""


def f29_field_snapshot(spark, sf):
    pk = bridge.packages(spark, sf, sized=False)
    snap = FL.snapshot(FL.package_fields_long(pk, ["gross_weight", "net_weight"]))
    first = F.get("evidence", F.lit(0))
    return snap.select(
        *[c for c in snap.columns if c != "evidence"],
        first["locator"].alias("first_locator"),
        first["raw_text"].alias("first_raw"),
        first["status"].alias("first_status"),
    )


F29_SQL = S.with_(S.PK) + "\nUNION ALL\n".join(
    f"SELECT job_id, {_path(n)} AS path, {t} AS source_value, weight_unit AS source_unit, {t} AS working_value, "
    f"weight_unit AS working_unit, 'source' AS working_origin, false AS modified, "
    f"'Page ' || CAST(segment_no AS VARCHAR) AS first_locator, {t} AS first_raw, status AS first_status FROM pk"
    for n, t in (("gross_weight", "gross_value"), ("net_weight", "net_value"))
)


def a12_evidence_locators(spark, sf):
    """Distinct evidence locators of every job."""
    long = FL.package_fields_long(bridge.packages(spark, sf, sized=False), ["case_number", "gross_weight"])
    return FL.evidence_locators(long, ["job_id"])


A12_SQL = "SELECT DISTINCT l_orderkey AS job_id, 'Page ' || CAST(l_linenumber AS VARCHAR) AS locator FROM lineitem"


def f13_field_path(spark, sf):
    """Paths from document words: which are allowed, and which of them exist in the model."""
    words = bridge.documents(spark, sf).select(F.explode(F.split("text", r"\s+")).alias("word"))
    from cargolens.functions.values import path_allowed

    probe = F.concat(F.lit("packages[0]."), F.lower("word"))
    return (
        words.filter(F.col("word") != "")
        .groupBy("word")
        .agg(F.count("*").alias("uses"))
        .select("word", "uses", path_allowed(probe).alias("allowed"), path_allowed(F.lower("word")).alias("as_root"))
    )


F13_SQL = """SELECT word, count(*) AS uses,
 regexp_full_match('packages[0].' || lower(word), '(order|shipment|packages)(\\[[0-9]+\\])?([.][a-zA-Z][a-zA-Z0-9_]*(\\[[0-9]+\\])?)*')
  AND NOT regexp_matches(lower(word), '__|[(){};]') AS allowed,
 regexp_full_match(lower(word), '(order|shipment|packages)(\\[[0-9]+\\])?([.][a-zA-Z][a-zA-Z0-9_]*(\\[[0-9]+\\])?)*') AS as_root
 FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word"""


# ---- issue lists ---------------------------------------------------------


def all_issues(spark, sf):
    rec = bridge.records(spark, sf)
    pk, items = bridge.package_fields(rec), bridge.item_fields(rec)
    return R.validate(bridge.jobs(spark, sf), pk, items, field_records(spark, sf))


def issue_rows(spark, sf):
    """The issues of all rules, written once: lists, counts and acknowledgements all read them."""
    return staged(spark, f"issues:{sf}", lambda: all_issues(spark, sf))


def v_issue_totals(spark, sf):
    """The whole rule set in one run: issues per code and severity."""
    return all_issues(spark, sf).groupBy("code", "severity").agg(F.count("*").alias("issues"))


V_TOTALS_SQL = S.with_(ISSUES) + "SELECT code, severity, count(*) AS issues FROM iss GROUP BY 1, 2"


def q5_list_issues(spark, sf):
    return Q.list_issues(issue_rows(spark, sf), "BLOCKING").select(*SHOWN)


def a3_issue_counts(spark, sf):
    return R.issue_counts(bridge.jobs(spark, sf), issue_rows(spark, sf))


A3_SQL = S.with_(ISSUES) + """SELECT o_orderkey AS job_id, CAST(0 AS BIGINT) AS info,
 count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'BLOCKING') AS blocking
 FROM orders LEFT JOIN iss ON iss.job_id = o_orderkey GROUP BY 1"""


def q7_issue_lines(spark, sf):
    return Q.issue_lines(issue_rows(spark, sf))


Q7_ISSUE_SQL = S.with_(ISSUES) + """SELECT job_id, code, field_path, severity || ' ' || code || ': ' || message
 || CASE WHEN coalesce(case_number, '') = '' THEN '' ELSE ' (Case ' || case_number || ')' END AS line FROM iss"""


def f21_issue_fingerprint(spark, sf):
    return R.with_fingerprint(issue_rows(spark, sf)).select("job_id", "code", "field_path", "fingerprint")


def _json(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN 'null' ELSE '\"' || {name} || '\"' END"


FINGERPRINT = (
    "sha256('{\"case_number\":' || " + _json("case_number") + " || ',\"code\":' || " + _json("code")
    + " || ',\"field_path\":' || " + _json("field_path") + " || ',\"message\":' || " + _json("message")
    + " || ',\"severity\":' || " + _json("severity") + " || '}')"
)
F21_SQL = S.with_(ISSUES) + f"SELECT job_id, code, field_path, {FINGERPRINT} AS fingerprint FROM iss"


def ack_actions(spark, sf, issues):
    """Ordered actions on issues: acknowledged in finished and pending orders, taken back in pending ones."""
    jobs = bridge.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("order_status")
    )
    rows = R.with_fingerprint(issues).join(jobs, "job_id")
    step = lambda n, action: F.struct(
        F.lit(n).alias("action_ord"),
        F.lit(action).alias("action"),
        F.lit("clerk").alias("actor"),
        F.lit(" checked ").alias("reason"),
    )
    steps = F.when(F.col("order_status") == "F", F.array(step(1, "acknowledge"))).when(
        F.col("order_status") == "P", F.array(step(1, "acknowledge"), step(2, "revoke"))
    )
    return rows.select("job_id", "fingerprint", "severity", F.inline(steps))


def v22_acknowledgements(spark, sf):
    """State of every acknowledgement after all actions: only warnings have one."""
    issues = issue_rows(spark, sf)
    return R.acknowledgement_state(ack_actions(spark, sf, issues))


V22_SQL = S.with_(ISSUES) + f"""SELECT DISTINCT job_id, {FINGERPRINT} AS fingerprint,
 CASE o_orderstatus WHEN 'F' THEN 'active' ELSE 'revoked' END AS status, 'clerk' AS acknowledged_by,
 'checked' AS reason, CASE o_orderstatus WHEN 'P' THEN 'clerk' END AS revoked_by
 FROM iss JOIN orders ON o_orderkey = job_id WHERE severity = 'WARNING' AND o_orderstatus IN ('F', 'P')"""


def acknowledged(spark, sf):
    issues = issue_rows(spark, sf)
    acks = R.acknowledgement_state(ack_actions(spark, sf, issues))
    return R.apply_acknowledgements(issues, acks)


def j8_resolved_issues(spark, sf):
    return acknowledged(spark, sf).select("job_id", "code", "field_path", "resolved")


J8_SQL = S.with_(ISSUES) + """SELECT job_id, code, field_path,
 severity = 'WARNING' AND o_orderstatus = 'F' AS resolved FROM iss JOIN orders ON o_orderkey = job_id"""


def a4_resolved_warnings(spark, sf):
    return R.resolved_warnings(acknowledged(spark, sf))


A4_SQL = S.with_(ISSUES) + """SELECT job_id,
 count(*) FILTER (severity = 'WARNING' AND o_orderstatus = 'F') AS resolved_warnings
 FROM iss JOIN orders ON o_orderkey = job_id GROUP BY 1"""


def p6_unresolved_warnings(spark, sf):
    return Q.list_issues(acknowledged(spark, sf), "WARNING").select("job_id", "code", "field_path")


P6_SQL = S.with_(ISSUES) + """SELECT job_id, code, field_path FROM iss JOIN orders ON o_orderkey = job_id
 WHERE severity = 'WARNING' AND o_orderstatus <> 'F'"""


def w3_case_use(spark, sf):
    """First and later uses of a case number inside a document."""
    from cargolens.operators.ordinals import mark_first

    pk = bridge.packages(spark, sf, sized=False).select(
        "job_id", "pkg_ord", case_text(F.col("case_number")).alias("case_number")
    )
    return mark_first(pk, ["job_id", "case_number"], ["job_id", "pkg_ord"], "pkg_ord", "first_use")


W3_SQL = S.with_(S.PK) + """SELECT job_id, pkg_ord, case_no AS case_number, case_no IS NOT NULL AND
 row_number() OVER (PARTITION BY job_id, case_no ORDER BY pkg_ord) = 1 AS first_use FROM pk"""


def p7_ambiguous_fields(spark, sf):
    """Ambiguous fields per path name after lines of status A were decided by hand."""
    pk = bridge.packages(spark, sf, sized=False)
    edited = F.when(F.col("gross_weight.working.unit") == "KG", "user_edit").otherwise("source")
    pk = pk.withColumn("gross_weight", F.col("gross_weight").withField("working.origin", edited))
    rows = R.ambiguity_issues(FL.package_fields_long(pk, ["case_number", "gross_weight"]))
    return rows.select("job_id", "field_path")


P7_SQL = S.with_(S.PK) + f"""SELECT job_id, {_path('case_number')} AS field_path FROM pk WHERE status = 'AMBIGUOUS'
UNION ALL SELECT job_id, {_path('gross_weight')} FROM pk WHERE status = 'AMBIGUOUS' AND weight_unit <> 'KG'"""


def _checked(code: str, table: dict | None = None) -> str:
    return S.with_(S.PK) + (table or RULE_SQL)[code]


QUERIES = {
    "v1_no_packages": (v1_no_packages, _checked("NO_PACKAGES")),
    "v2_case_number_missing": (_rule("CASE_NUMBER_MISSING", sized=False), _checked("CASE_NUMBER_MISSING")),
    "v3_case_number_duplicate": (_rule("CASE_NUMBER_DUPLICATE", sized=False), _checked("CASE_NUMBER_DUPLICATE")),
    "v4_gross_weight_missing": (_rule("GROSS_WEIGHT_MISSING", sized=False), _checked("GROSS_WEIGHT_MISSING")),
    "v5_gross_weight_invalid": (_rule("GROSS_WEIGHT_INVALID", sized=False), _checked("GROSS_WEIGHT_INVALID")),
    "v6_gross_weight_unit_missing": (
        _rule("GROSS_WEIGHT_UNIT_MISSING", sized=False),
        _checked("GROSS_WEIGHT_UNIT_MISSING"),
    ),
    "v7_gross_weight_unit_unknown": (
        _rule("GROSS_WEIGHT_UNIT_UNKNOWN", sized=False),
        _checked("GROSS_WEIGHT_UNIT_UNKNOWN"),
    ),
    "v8_net_weight_missing": (_rule("NET_WEIGHT_MISSING", sized=False), _checked("NET_WEIGHT_MISSING")),
    "v9_net_weight_invalid": (_rule("NET_WEIGHT_INVALID", swapped=True), _checked("NET_WEIGHT_INVALID", SWAPPED_SQL)),
    "v10_net_weight_unit_missing": (
        _rule("NET_WEIGHT_UNIT_MISSING", sized=False),
        _checked("NET_WEIGHT_UNIT_MISSING"),
    ),
    "v11_net_weight_unit_unknown": (
        _rule("NET_WEIGHT_UNIT_UNKNOWN", sized=False),
        _checked("NET_WEIGHT_UNIT_UNKNOWN"),
    ),
    "v12_gross_below_net": (_rule("GROSS_BELOW_NET", sized=False), _checked("GROSS_BELOW_NET")),
    "v13_dimensions_incomplete": (_rule("DIMENSIONS_INCOMPLETE"), _checked("DIMENSIONS_INCOMPLETE")),
    "v14_dimension_invalid": (_rule("DIMENSION_INVALID"), _checked("DIMENSION_INVALID")),
    "v15_dimension_unit_missing": (
        _rule("DIMENSION_UNIT_MISSING", swapped=True),
        _checked("DIMENSION_UNIT_MISSING", SWAPPED_SQL),
    ),
    "v16_dimension_unit_unknown": (
        _rule("DIMENSION_UNIT_UNKNOWN", swapped=True),
        _checked("DIMENSION_UNIT_UNKNOWN", SWAPPED_SQL),
    ),
    "v17_item_quantity_invalid": (v17_item_quantity_invalid, _checked("ITEM_QUANTITY_INVALID", SWAPPED_SQL)),
    "v18_item_uom_missing": (v18_item_uom_missing, _checked("ITEM_UOM_MISSING")),
    "v19_mapping_ambiguous": (v19_mapping_ambiguous, _checked("MAPPING_AMBIGUOUS")),
    "v22_acknowledgements": (v22_acknowledgements, V22_SQL),
    "v_issue_totals": (v_issue_totals, V_TOTALS_SQL),
    "q5_list_issues": (
        q5_list_issues,
        S.with_(ISSUES) + f"SELECT {', '.join(SHOWN)} FROM iss WHERE severity = 'BLOCKING'",
    ),
    "q7_issue_lines": (q7_issue_lines, Q7_ISSUE_SQL),
    "a3_issue_counts": (a3_issue_counts, A3_SQL),
    "a4_resolved_warnings": (a4_resolved_warnings, A4_SQL),
    "a12_evidence_locators": (a12_evidence_locators, A12_SQL),
    "f13_field_path": (f13_field_path, F13_SQL),
    "f21_issue_fingerprint": (f21_issue_fingerprint, F21_SQL),
    "f29_field_snapshot": (f29_field_snapshot, F29_SQL),
    "j8_resolved_issues": (j8_resolved_issues, J8_SQL),
    "n1_field_paths": (n1_field_paths, S.with_(S.PK, S.JOBS) + _n1_rows()),
    "n2_records_from_fields": (n2_records_from_fields, N2_SQL),
    "p6_unresolved_warnings": (p6_unresolved_warnings, P6_SQL),
    "p7_ambiguous_fields": (p7_ambiguous_fields, P7_SQL),
    "w3_case_use": (w3_case_use, W3_SQL),
}
