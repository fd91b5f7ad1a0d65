"""Registered queries: segment merge, continuation merge, their conflicts and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions.values import current_value, strip
from cargolens.operators import merge as M
from cargolens.operators import rules as R
from cargolens.plans import sql as S
from cargolens.session import staged
from cargolens.sources import bridge

# The text of every package field: case, nine further fields, three sides.
TEXTS = {
    "case_number": "case_value", "internal_reference": "item_number", "volume": "item_quantity",
    "gross_weight": "gross_value", "net_weight": "net_value", "package_type": "returnflag",
    "package_description": "item_description", "status": "linestatus", "packed_by": "item_uom",
    "pack_date": "CAST(segment_no AS STRING)",
    "length": "length_value", "width": "width_value", "height": "height_value",
}
FIELDS = ["case_number", *M.CONTINUED_FIELDS, *M.SIDES]
# The text of every order and shipment field in a segment.
DOCUMENT_TEXTS = {
    "order.sales_order": "'SO-' || CAST(job_id AS STRING)", "order.customer_order_number": "item_number",
    "order.position": "CAST(segment_no AS STRING)", "order.project": "CASE WHEN returnflag = 'A' THEN linestatus END",
    "order.customer_project": "case_value", "order.purchase_order": "gross_value",
    "order.purchase_order_position": "item_quantity", "shipment.product_type": "returnflag",
    "shipment.description": "item_description", "shipment.country_of_origin": "CASE WHEN linestatus = 'F' THEN 'DE' ELSE '' END",
    "shipment.hs_code": "length_value", "shipment.supplier_name": "weight_unit",
}
ITEM_TEXTS = {
    "sequence": "CAST(item_seq AS VARCHAR)", "item_number": "item_number", "description": "item_description",
    "quantity": "item_quantity", "uom": "item_uom",
}


def mapped_fields():
    """Mapped values of a package record as the extraction step gives them, as columns over the records."""
    locator = F.concat(F.lit("Page "), F.col("segment_no").cast("string"))
    unit = {"gross_weight": F.col("weight_unit"), "net_weight": F.col("weight_unit")}
    return {
        n: M.mapped(F.expr(t), unit=unit.get(n), raw=F.expr(t), locator=locator, status=F.col("status"))
        for n, t in TEXTS.items()
    }


def mapped_packages(spark, sf):
    """Package records with one mapped value per field."""
    fields = mapped_fields()
    return bridge.records(spark, sf).select(
        "job_id", "segment_no", "pkg_ord", "dim_unit", *[c.alias(n) for n, c in fields.items()]
    )


REQUIRED = {"case_number", "gross_weight", "net_weight"}


def whole_fields():
    """The same with working values."""
    mapped = mapped_fields()
    return {n: M.lift_mapped(mapped[n], n in REQUIRED) for n in FIELDS}


def whole_packages(spark, sf):
    """The same records with working values."""
    return mapped_packages(spark, sf).select(
        "job_id", "pkg_ord", *[M.lift_mapped(F.col(n), n in REQUIRED).alias(n) for n in FIELDS], "dim_unit"
    )


def document_fields():
    """Order and shipment fields of a segment as columns over the records."""
    return {n.replace(".", "_"): M.mapped(F.expr(t), status=F.col("status")) for n, t in DOCUMENT_TEXTS.items()}


def document_segments(spark, sf):
    """Order and shipment fields of every segment, here one per order line."""
    return bridge.records(spark, sf).select(
        "job_id", "pkg_ord", F.col("pkg_ord").alias("segment_no"), *[c.alias(n) for n, c in document_fields().items()]
    )


TARGET = f"""{S.PK},
home AS (SELECT job_id, case_no, coalesce(max(pkg_ord) FILTER (segment_no = 1), min(pkg_ord)) AS home
 FROM pk WHERE case_no IS NOT NULL GROUP BY 1, 2),
tg AS (SELECT pk.*, CASE WHEN pk.case_no IS NULL OR segment_no = 1 THEN pkg_ord ELSE home END AS target,
 CASE status WHEN 'CONFIRMED' THEN 3 WHEN 'SUPPORTED' THEN 2 WHEN 'AMBIGUOUS' THEN 1 ELSE 0 END AS srank
 FROM pk LEFT JOIN home ON home.job_id = pk.job_id AND home.case_no = pk.case_no)"""
KEY = "(3 - srank) * 1000000000 + pkg_ord"


def _winner(text: str, what: str) -> str:
    return (
        f"CASE WHEN count(*) FILTER (coalesce({text}, '') <> '') > 0 "
        f"THEN arg_min_null({what}, {KEY}) FILTER (coalesce({text}, '') <> '') "
        f"ELSE arg_max_null({what}, pkg_ord) END"
    )


def m2_segment_merge(spark, sf):
    merged = M.merge_segments(bridge.records(spark, sf), mapped_fields())
    return merged.select(
        "job_id",
        "pkg_ord",
        *[F.col(f"{n}.value").alias(n) for n in FIELDS],
        F.col("gross_weight.status").alias("gross_status"),
        F.col("gross_weight.unit").alias("gross_unit"),
        F.col("length.locator").alias("length_locator"),
        "dim_unit",
    )


M2_SQL = S.with_(TARGET) + "SELECT job_id, target AS pkg_ord, " + ", ".join(
    [f"{_winner(t, t)} AS {n}" for n, t in TEXTS.items()]
    + [
        f"{_winner('gross_value', 'status')} AS gross_status",
        f"{_winner('gross_value', 'weight_unit')} AS gross_unit",
        _winner("length_value", "'Page ' || CAST(segment_no AS VARCHAR)") + " AS length_locator",
        "arg_min(dim_unit, pkg_ord) AS dim_unit",
    ]
) + " FROM tg GROUP BY 1, 2"


def m5_package_identity(spark, sf):
    """Which package every record ends up in; records without a case stay alone (also M10)."""
    return M.segment_targets(mapped_packages(spark, sf))


M5_SQL = S.with_(TARGET) + "SELECT job_id, pkg_ord, target AS target_ord FROM tg"


def printed_items(rec):
    """Items of every record; the next record of the job prints them once more."""
    own = bridge.item_fields(rec).withColumns(
        {n: M.lift_mapped(M.mapped(F.lit(None))) for n in M.ITEM_KEY if n not in bridge.ITEM_FIELDS}
    )
    places = rec.select("job_id", "pkg_ord")
    again = own.withColumns({"pkg_ord": F.col("pkg_ord") + 1, "item_ord": F.lit(2).cast("bigint")})
    return own.unionByName(again.join(places, ["job_id", "pkg_ord"], "left_semi"))


def _kept_items(kept):
    return kept.select(
        "job_id", "target_ord", "pkg_ord", "item_ord", current_value(F.col("item_number")).alias("item_number")
    )


def m4_merged_items(spark, sf):
    rec = bridge.records(spark, sf)
    targets = M.segment_targets(mapped_packages(spark, sf))
    return _kept_items(M.merge_items(printed_items(rec), targets, M.ITEM_KEY, lambda f: M.typed_text(f["source"])))


def _items_sql(target_cte: str, relation: str, more: str = "") -> str:
    key = " || '|' || ".join(f"coalesce({t}, '~')" for t in ITEM_TEXTS.values())
    return S.with_(target_cte) + (
        f"SELECT job_id, target AS target_ord, pkg_ord, item_ord, item_number{more} FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY job_id, target, item_key ORDER BY pkg_ord, item_ord) AS use_no FROM ("
        f"SELECT job_id, target, pkg_ord, 1 AS item_ord, item_number, {key} AS item_key, pkg_ord AS src FROM {relation} "
        f"UNION ALL SELECT n.job_id, n.target, n.pkg_ord, 2, p.item_number, p.item_key, p.pkg_ord FROM {relation} n "
        f"JOIN (SELECT job_id, pkg_ord, item_number, {key} AS item_key FROM {relation}) p "
        f"ON p.job_id = n.job_id AND p.pkg_ord + 1 = n.pkg_ord)) "
        f"WHERE pkg_ord = target OR use_no = 1"
    )


def m3_document_fields(spark, sf):
    """The 7 order and 5 shipment fields of every job after the merge of its segments."""
    return M.merge_document_fields(document_segments(spark, sf))


def _m3() -> str:
    return S.with_(TARGET) + "\nUNION ALL\n".join(
        f"SELECT job_id, '{n}' AS path, {_winner(t, t)} AS value, {_winner(t, 'status')} AS status FROM tg GROUP BY 1"
        for n, t in DOCUMENT_TEXTS.items()
    )


def m6_document_conflicts(spark, sf):
    """Conflicting order and shipment values of the segments."""
    conflicts = M.document_conflicts(bridge.records(spark, sf), document_fields(), segment="pkg_ord")
    return conflicts.select("job_id", "pkg_ord", "label", "left_value", "right_value", "kept_value", "kept_status")


def m6_segment_conflicts(spark, sf):
    conflicts = M.segment_conflicts(bridge.records(spark, sf), mapped_fields())
    return conflicts.select("job_id", "pkg_ord", "label", "left_value", "right_value", "kept_value", "kept_status")


def _m6(document: bool = False) -> str:
    parts = []
    for n, t in (DOCUMENT_TEXTS if document else TEXTS).items():
        tail = f".dimensions.{n}" if n in M.SIDES else f".{n}"
        label = f"'{n}'" if document else f"'case ' || case_no || '{tail}'"
        group = "job_id" if document else "job_id, target"
        frame = f"OVER (PARTITION BY {group} ORDER BY pkg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        here = f"coalesce({t}, '') <> ''"
        parts.append(
            f"SELECT job_id, pkg_ord, {label} AS label, held AS left_value, val AS right_value, "
            f"CASE WHEN srank > held_rank THEN val ELSE held END AS kept_value, "
            f"CASE WHEN srank > held_rank THEN status ELSE held_status END AS kept_status FROM ("
            f"SELECT *, {t} AS val, arg_min({t}, {KEY}) FILTER ({here}) {frame} AS held, "
            f"arg_min(srank, {KEY}) FILTER ({here}) {frame} AS held_rank, "
            f"arg_min(status, {KEY}) FILTER ({here}) {frame} AS held_status FROM tg WHERE {'true' if document else 'case_no IS NOT NULL'}) "
            f"WHERE coalesce(val, '') <> '' AND held IS NOT NULL AND held <> val"
        )
    return S.with_(TARGET) + "\nUNION ALL\n".join(parts)


def v21_chunk_merge_conflict(spark, sf):
    issues = M.segment_conflict_issues(M.segment_conflicts(mapped_packages(spark, sf), ["gross_weight"]))
    return issues.select("job_id", "pkg_ord", "code", "severity", "message")


def _v21() -> str:
    inner = _m6().split("\nUNION ALL\n")
    gross = next(part for part in inner if "gross_value AS val" in part)
    head = S.with_(TARGET)
    gross = gross.removeprefix(head)
    return head + (
        "SELECT job_id, pkg_ord, 'CHUNK_MERGE_CONFLICT' AS code, 'WARNING' AS severity, label || "
        "' had conflicting segment values ''' || left_value || ''' and ''' || right_value || '''; kept ''' || "
        f"kept_value || ''' (' || kept_status || ').' AS message FROM ({gross})"
    )


# ---- continuation pages --------------------------------------------------

GROUP = f"""{S.PK}, cg AS (SELECT *, coalesce(case_no, '#' || CAST(pkg_ord AS VARCHAR)) AS grp,
 min(pkg_ord) OVER (PARTITION BY job_id, coalesce(case_no, '#' || CAST(pkg_ord AS VARCHAR))) AS target FROM pk)"""
CONTINUED = [n for n in FIELDS if n != "case_number"]


def _first(t: str) -> str:
    return (
        f"coalesce(arg_min({t}, pkg_ord) FILTER (coalesce({t}, '') <> ''), arg_min_null({t}, pkg_ord))"
    )


def m7_continuation_merge(spark, sf):
    merged = M.merge_continuations(bridge.records(spark, sf), whole_fields())
    return merged.select(
        "job_id", "pkg_ord", *[current_value(F.col(n)).alias(n) for n in FIELDS], "dim_unit"
    )


M7_SQL = S.with_(GROUP) + "SELECT job_id, min(pkg_ord) AS pkg_ord, " + ", ".join(
    [f"{_first(t)} AS {n}" for n, t in TEXTS.items() if n != "case_number"]
    + ["arg_min_null(case_value, pkg_ord) AS case_number", "arg_min(dim_unit, pkg_ord) AS dim_unit"]
) + " FROM cg GROUP BY job_id, grp"


def a5_continuation_merges(spark, sf):
    return M.continuation_merges(bridge.packages(spark, sf, sized=False, ordered=False))


A5_SQL = S.with_(S.PK) + (
    "SELECT job_id, count(case_no) - count(DISTINCT case_no) AS merges FROM pk GROUP BY 1"
)


def w7_continued_items(spark, sf):
    """Items after the continuation merge, compared as stripped text."""
    rec = bridge.records(spark, sf)
    targets = M.continuation_targets(bridge.package_fields(rec))
    return _kept_items(M.merge_items(printed_items(rec), targets, M.ITEM_KEY, lambda f: strip(current_value(f))))


def v20_continuation_conflicts(spark, sf):
    conflicts = M.continuation_conflicts(whole_packages(spark, sf), FIELDS)
    return M.continuation_issues(conflicts).select("job_id", "pkg_ord", "code", "message", "case_number", "field_path")


def _v20() -> str:
    parts = []
    for n, t in [(n, TEXTS[n]) for n in CONTINUED] + [("unit", "dim_unit")]:
        path = f"package.dimensions.{n}" if n in M.SIDES or n == "unit" else f"package.{n}"
        unit = n == "unit"
        code = "CONTINUATION_UNIT_CONFLICT" if unit else "CONTINUATION_FIELD_CONFLICT"
        end = "''.'" if unit else "''. The first mapped value was retained.'"
        subject = "the dimension unit" if unit else path
        parts.append(
            f"SELECT job_id, pkg_ord, '{code}' AS code, 'Continuation pages for case ' || case_no || ' disagree on "
            f"{subject}: ''' || held || ''' vs ''' || val || '{end} AS message, case_no AS case_number, "
            f"'{path}' AS field_path FROM (SELECT *, {t} AS val, arg_min({t}, pkg_ord) FILTER (coalesce({t}, '') <> '') "
            f"OVER (PARTITION BY job_id, grp) AS held FROM cg WHERE case_no IS NOT NULL) "
            f"WHERE coalesce(val, '') <> '' AND held <> val"
        )
    return S.with_(GROUP) + "\nUNION ALL\n".join(parts)


# ---- document level ------------------------------------------------------


def _segments(spark, sf):
    """Document-level texts of each segment, here one per order line."""
    rec = bridge.records(spark, sf)
    return rec.select(
        "job_id",
        F.col("pkg_ord").alias("segment_no"),
        F.when(F.col("linestatus") == "F", F.col("item_description")).otherwise("").alias("vendor"),
        F.when(F.col("weight_unit") == "KG", F.col("item_number")).alias("document_reference"),
        F.when(F.col("returnflag") == "R", F.col("item_quantity")).alias("document_profile"),
        F.when(F.col("dim_unit") == "cm", F.col("gross_value")).alias("document_date"),
        F.when(F.col("returnflag") == "A", "packing_list")
        .when(F.col("returnflag") == "N", "delivery_note")
        .otherwise("")
        .alias("document_type"),
        F.concat("returnflag", "linestatus").alias("note"),
    )


def m1_document_scalars(spark, sf):
    return M.document_scalars(_segments(spark, sf), ["vendor", "document_profile", "document_reference", "document_date"])


M1_SQL = S.with_(S.REC, """seg AS (SELECT job_id, pkg_ord,
 CASE WHEN linestatus = 'F' THEN item_description ELSE '' END AS vendor,
 CASE WHEN weight_unit = 'KG' THEN item_number END AS ref, CASE WHEN returnflag = 'R' THEN item_quantity END AS profile,
 CASE WHEN dim_unit = 'cm' THEN gross_value END AS day,
 CASE returnflag WHEN 'A' THEN 'packing_list' WHEN 'N' THEN 'delivery_note' ELSE '' END AS kind FROM rec)""") + """
SELECT job_id, arg_min(vendor, pkg_ord) FILTER (vendor <> '') AS vendor,
 arg_min(ref, pkg_ord) FILTER (ref <> '') AS document_reference,
 arg_min(profile, pkg_ord) FILTER (profile <> '') AS document_profile,
 arg_min(day, pkg_ord) FILTER (day <> '') AS document_date,
 CASE WHEN arg_min(kind, pkg_ord) <> 'packing_list' THEN arg_min(kind, pkg_ord)
  ELSE coalesce(arg_min(kind, pkg_ord) FILTER (kind NOT IN ('', 'packing_list')), 'packing_list') END AS document_type
FROM seg GROUP BY 1"""


def d3_merged_notes(spark, sf):
    notes = _segments(spark, sf).withColumn("note_ord", F.col("segment_no"))
    return M.merged_notes(notes).select("job_id", "note_ord", "note")


D3_SQL = S.with_(S.REC) + """SELECT job_id, min(pkg_ord) AS note_ord, returnflag || linestatus AS note
 FROM rec GROUP BY job_id, returnflag || linestatus"""


def m9_merged_documents(spark, sf):
    """Segments merged, lifted, continuation pages merged, then validated; merge conflicts come last."""
    merged = M.merge_segments(bridge.records(spark, sf), mapped_fields())
    lifted = staged(
        spark,
        f"merged:{sf}",
        lambda: merged.select(
            "job_id", "pkg_ord", *[M.lift_mapped(F.col(n), n in REQUIRED).alias(n) for n in FIELDS], "dim_unit"
        ),
    )
    whole = M.merge_continuations(lifted, FIELDS)
    issues = (
        R.package_issues(whole)
        .unionByName(M.continuation_issues(M.continuation_conflicts(lifted, FIELDS)))
        .unionByName(M.segment_conflict_issues(M.segment_conflicts(bridge.records(spark, sf), mapped_fields())))
    )
    return issues.groupBy("code", "severity").agg(F.count("*").alias("issues"))


QUERIES = {
    "m1_document_scalars": (m1_document_scalars, M1_SQL),
    "m2_segment_merge": (m2_segment_merge, M2_SQL),
    "m3_document_fields": (m3_document_fields, _m3()),
    "m4_merged_items": (m4_merged_items, _items_sql(TARGET, "tg")),
    "m5_package_identity": (m5_package_identity, M5_SQL),
    "m6_segment_conflicts": (m6_segment_conflicts, _m6()),
    "m6_document_conflicts": (m6_document_conflicts, _m6(document=True)),
    "m7_continuation_merge": (m7_continuation_merge, M7_SQL),
    "m9_merged_documents": (m9_merged_documents, None),
    "a5_continuation_merges": (a5_continuation_merges, A5_SQL),
    "d3_merged_notes": (d3_merged_notes, D3_SQL),
    "v20_continuation_conflicts": (v20_continuation_conflicts, _v20()),
    "v21_chunk_merge_conflict": (v21_chunk_merge_conflict, _v21()),
    "w7_continued_items": (w7_continued_items, _items_sql(GROUP, "cg")),
}
