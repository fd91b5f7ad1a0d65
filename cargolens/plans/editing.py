"""Registered queries: edits, reverts, change log, proposals, mapping again."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions import values as V
from cargolens.operators import edits as E
from cargolens.operators import fields as FL
from cargolens.operators import rules as R
from cargolens.plans import sql as S
from cargolens.plans.validation import field_records, long_fields
from cargolens.sources import bridge

PATH = "'packages[' || CAST(pkg_ord - 1 AS VARCHAR) || '].gross_weight'"
NET = PATH.replace("gross", "net")
COUNT = PATH.replace("gross_weight", "items[0].quantity")


def base_fields(spark, sf):
    """All fields of packages, items, orders and shipments as editable fields."""
    return long_fields(spark, sf)


def edit_rows(spark, sf):
    """Edits of weights, quantities and order fields, with reverts of single fields, of packages and of whole jobs."""
    rec = bridge.records(spark, sf)
    path = FL.package_path("gross_weight")
    null = F.lit(None).cast("string")

    def edit(step, op, path, value=null, unit=null):
        return F.struct(
            (F.col("pkg_ord") * 10 + step).alias("edit_ord"),
            F.lit(op).alias("op"),
            path.alias("path"),
            value.cast("string").alias("value"),
            unit.alias("unit"),
        )

    open_, flag = F.col("linestatus") == "O", F.col("returnflag")
    package = F.concat(F.lit("packages["), (F.col("pkg_ord") - 1).cast("string"), F.lit("]"))
    first = F.when(flag == "R", "abc").otherwise(F.concat(F.lit(" 1,"), (100 + F.col("item_seq")).cast("string")))
    rows = F.array(
        edit(1, E.SET, path, first),
        F.when(open_, edit(2, E.REVERT, path)),
        F.when(F.col("status") == "SUPPORTED", edit(3, E.SET, path, F.lit(" "), F.lit("KG"))),
        F.when((flag == "N") & ~open_, edit(4, E.REVERT_PACKAGE, package)),
        F.when(flag == "N", edit(5, E.SET, path, F.col("gross_value"), F.lit("G"))),
        F.when(flag == "A", edit(6, E.SET, F.concat(path, F.lit("_x")), F.lit("5"))),
        F.when(flag == "A", edit(7, E.SET, FL.package_path("net_weight"), F.lit("55"), F.lit("LB"))),
        F.when(open_, edit(8, E.SET, F.concat(package, F.lit(".items[0].quantity")), F.lit("3"))),
    )
    orders = bridge.table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    order_edits = F.array(
        F.struct(F.lit(5).alias("n"), F.lit(E.SET).alias("op"), F.lit("order.purchase_order").alias("path"), F.lit("PO-X").alias("value")),
        F.when(
            status == "P", F.struct(F.lit(20).alias("n"), F.lit(E.REVERT_JOB).alias("op"), null.alias("path"), null.alias("value"))
        ),
        F.when(
            status == "P",
            F.struct(F.lit(30).alias("n"), F.lit(E.SET).alias("op"), F.lit("shipment.supplier_name").alias("path"), F.lit(" Maker ").alias("value")),
        ),
    )
    jobs = orders.select(
        F.col("o_orderkey").alias("job_id"), F.inline(F.filter(order_edits, lambda r: r.isNotNull()))
    ).select("job_id", F.col("n").cast("bigint").alias("edit_ord"), "op", "path", "value", null.alias("unit"))
    single = rec.select("job_id", F.inline(F.filter(rows, lambda r: r.isNotNull())))
    return single.unionByName(jobs).withColumns({"actor": F.lit("clerk"), "reason": F.lit(" seen ")})


def _field_rows() -> str:
    """Every field with its source value and unit."""
    texts = {
        "case_number": "case_value", "gross_weight": "gross_value", "net_weight": "net_value",
        "length": "length_value", "width": "width_value", "height": "height_value",
    }
    items = {
        "sequence": "CAST(item_seq AS VARCHAR)", "item_number": "item_number", "description": "item_description",
        "quantity": "item_quantity", "uom": "item_uom",
    }
    head = "SELECT job_id, pkg_ord, 'packages[' || CAST(pkg_ord - 1 AS VARCHAR) || ']"
    rows = []
    for n, t in texts.items():
        tail = f".dimensions.{n}" if n in FL.SIDES else f".{n}"
        unit = "weight_unit" if n.endswith("weight") else "CAST(NULL AS VARCHAR)"
        rows.append(f"{head}{tail}' AS path, {t} AS src, {unit} AS src_unit FROM pk")
    rows += [f"{head}.items[0].{n}', {t}, NULL FROM pk" for n, t in items.items()]
    for n, root in (("purchase_order", "order"), ("purchase_order_position", "order"), ("supplier_name", "shipment")):
        rows.append(f"SELECT job_id, NULL, '{root}.{n}', {n}, NULL FROM jobs")
    return "\nUNION ALL\n".join(rows)


# The same edits: single settings and reverts that can be applied, then what holds after the last revert.
FOLD = f"""{S.PK}, {S.JOBS}, fl AS ({_field_rows()}),
ed AS (SELECT *, {PATH} AS path, {NET} AS net_path, {COUNT} AS count_path,
 returnflag <> 'R' AS s1, linestatus = 'O' AS r2, status = 'SUPPORTED' AS s3, returnflag = 'N' AND linestatus = 'F' AS r4,
 returnflag = 'N' AND (gross IS NOT NULL OR coalesce(gross_value, '') = '') AS s5, '1' || CAST(100 + item_seq AS VARCHAR) AS v1,
 replace(gross_value, ',', '') AS v5 FROM pk),
ev AS (SELECT job_id, path, pkg_ord * 10 + 1 AS ord, 'set' AS op, v1 AS val, CAST(NULL AS VARCHAR) AS u FROM ed WHERE s1
 UNION ALL SELECT job_id, path, pkg_ord * 10 + 2, 'revert', gross_value, weight_unit FROM ed WHERE r2
 UNION ALL SELECT job_id, path, pkg_ord * 10 + 3, 'set', NULL, 'KG' FROM ed WHERE s3
 UNION ALL SELECT job_id, path, pkg_ord * 10 + 5, 'set', v5, 'G' FROM ed WHERE s5
 UNION ALL SELECT job_id, net_path, pkg_ord * 10 + 7, 'set', '55', 'LB' FROM ed WHERE returnflag = 'A'
 UNION ALL SELECT job_id, count_path, pkg_ord * 10 + 8, 'set', '3', NULL FROM ed WHERE r2
 UNION ALL SELECT job_id, 'order.purchase_order', 5, 'set', 'PO-X', NULL FROM jobs
 UNION ALL SELECT job_id, 'shipment.supplier_name', 30, 'set', 'Maker', NULL FROM jobs WHERE order_status = 'P'),
ag AS (SELECT job_id, path, max(ord) FILTER (op = 'set') AS last_set, arg_max_null(val, ord) FILTER (op = 'set') AS set_value,
 max(ord) FILTER (op = 'set' AND u IS NOT NULL) AS last_unit, arg_max(u, ord) FILTER (op = 'set' AND u IS NOT NULL) AS set_unit,
 max(ord) FILTER (op = 'revert') AS field_back FROM ev GROUP BY 1, 2),
pos AS (SELECT fl.*, last_set, set_value, last_unit, set_unit, field_back, greatest(field_back,
  (CASE WHEN ed.r4 THEN ed.pkg_ord * 10 + 4 END), CASE WHEN order_status = 'P' THEN 20 END) AS back FROM fl
 LEFT JOIN ag ON ag.job_id = fl.job_id AND ag.path = fl.path LEFT JOIN ed ON ed.job_id = fl.job_id AND ed.pkg_ord = fl.pkg_ord
 LEFT JOIN jobs ON jobs.job_id = fl.job_id),
st AS (SELECT *, coalesce(last_set > coalesce(back, -1), false) AS touched,
 CASE WHEN coalesce(last_unit > coalesce(back, -1), false) THEN set_unit ELSE src_unit END AS unit FROM pos),
fin AS (SELECT *, CASE WHEN touched THEN set_value ELSE src END AS value,
 touched AND NOT (set_value IS NULL AND src IS NULL AND unit IS NOT DISTINCT FROM src_unit) AS modified FROM st)"""


def u1_edited_fields(spark, sf):
    after = E.apply_record_edits(field_records(spark, sf), edit_rows(spark, sf))
    f = F.col("field")
    return after.select(
        "job_id",
        "path",
        f["working"]["value"].alias("value"),
        f["working"]["unit"].alias("unit"),
        f["working"]["origin"].alias("origin"),
        f["working"]["modified_by"].alias("modified_by"),
        f["working"]["reason"].alias("reason"),
        f["modified"].alias("modified"),
        f["source"]["value"].alias("source_value"),
    )


U1_SQL = S.with_(FOLD) + """SELECT job_id, path, value, CASE WHEN touched THEN unit ELSE src_unit END AS unit,
 CASE WHEN modified THEN 'user_edit' ELSE 'source' END AS origin, CASE WHEN modified THEN 'clerk' END AS modified_by,
 CASE WHEN modified THEN 'seen' END AS reason, modified, src AS source_value FROM fin"""


def u1_edit_errors(spark, sf):
    """Edits that cannot be applied: unknown paths and texts that are no numbers."""
    bad = E.checked_edits(base_fields(spark, sf), edit_rows(spark, sf)).filter(F.col("error").isNotNull())
    return bad.select("job_id", "edit_ord", "path", "error")


U1_ERRORS_SQL = S.with_(FOLD) + """SELECT job_id, pkg_ord * 10 + 1 AS edit_ord, path, 'Enter a numeric value.' AS error
 FROM ed WHERE returnflag = 'R'
UNION ALL SELECT job_id, pkg_ord * 10 + 5, path, 'Enter a numeric value.' FROM ed WHERE returnflag = 'N' AND NOT s5
UNION ALL SELECT job_id, pkg_ord * 10 + 6, path || '_x', 'no field at this path'
 FROM ed WHERE returnflag = 'A'"""


def u4_job_status(spark, sf):
    return E.job_status(E.apply_record_edits(field_records(spark, sf), edit_rows(spark, sf))).select("job_id", "status")


U4_SQL = S.with_(FOLD) + (
    "SELECT job_id, CASE WHEN bool_or(modified) THEN 'edited' ELSE 'mapped' END AS status FROM fin GROUP BY 1"
)


def a11_modified_flags(spark, sf):
    after = E.apply_record_edits(field_records(spark, sf), edit_rows(spark, sf))
    return FL.modified_flags(after, ["job_id", "pkg_ord"])


A11_SQL = S.with_(FOLD) + "SELECT job_id, pkg_ord, bool_or(modified) AS modified FROM fin GROUP BY 1, 2"


def q4_modified_fields(spark, sf):
    from cargolens.operators.queries import modified_fields

    return modified_fields(E.apply_record_edits(field_records(spark, sf), edit_rows(spark, sf)))


Q4_SQL = S.with_(FOLD) + f"""SELECT job_id, path, src AS source_value, value AS working_value,
 nullif({S.unit("CASE WHEN coalesce(unit, '') = '' THEN src_unit ELSE unit END")}, '') AS unit, 'seen' AS reason
 FROM fin WHERE modified"""


def q7_change_lines(spark, sf):
    from cargolens.operators.queries import change_lines

    return change_lines(q4_modified_fields(spark, sf))


Q7_SQL = f"SELECT job_id, path, path || ': ' || coalesce(source_value, 'None') || ' -> ' || coalesce(working_value, 'None') " \
    f"|| coalesce(' ' || unit, '') AS line FROM ({Q4_SQL})"


def u3_reverted_counts(spark, sf):
    """Fields a revert of every pending order and of every package of it would reset."""
    edits = edit_rows(spark, sf).filter(F.col("op").isin(E.SET, E.REVERT))
    after = E.apply_record_edits(field_records(spark, sf), edits)
    jobs = bridge.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    whole = jobs.select(
        F.col("o_orderkey").alias("job_id"), F.lit(E.REVERT_JOB).alias("op"), F.lit(None).cast("string").alias("path")
    )
    package = E.package_of(F.col("path"))
    single = after.filter(package.isNotNull()).select(
        "job_id", F.lit(E.REVERT_PACKAGE).alias("op"), package.alias("path")
    ).distinct()
    return E.reverted_counts(after, whole.unionByName(single))


SOLO = f"""{FOLD}, solo AS (SELECT *, coalesce(last_set > coalesce(field_back, -1), false)
 AND NOT (set_value IS NULL AND src IS NULL AND
  CASE WHEN coalesce(last_unit > coalesce(field_back, -1), false) THEN set_unit ELSE src_unit END
  IS NOT DISTINCT FROM src_unit) AS changed FROM pos)"""
U3_SQL = S.with_(SOLO) + """SELECT job_id, 'revert_package' AS op, 'packages[' || CAST(pkg_ord - 1 AS VARCHAR) || ']' AS path,
 CAST(count(*) FILTER (changed) AS BIGINT) AS changed FROM solo WHERE pkg_ord IS NOT NULL GROUP BY job_id, pkg_ord
UNION ALL SELECT o_orderkey, 'revert_job', NULL, coalesce(CAST(count(*) FILTER (changed) AS BIGINT), 0)
 FROM orders LEFT JOIN solo ON job_id = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1"""


def u11_change_log(spark, sf):
    return E.record_change_log(field_records(spark, sf), edit_rows(spark, sf))


U11_SQL = S.with_(FOLD) + """,
lg AS (SELECT ev.*, src, src_unit, row_number() OVER w AS k, lag(val) OVER w AS prev,
 last_value(u IGNORE NULLS) OVER (PARTITION BY ev.job_id, ev.path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pu
 FROM ev JOIN fl ON fl.job_id = ev.job_id AND fl.path = ev.path WINDOW w AS (PARTITION BY ev.job_id, ev.path ORDER BY ord))
SELECT job_id, ord AS edit_ord, path, op, CASE WHEN k = 1 THEN src ELSE prev END AS before_value,
 coalesce(pu, src_unit) AS before_unit, val AS after_value, coalesce(u, pu, src_unit) AS after_unit FROM lg"""


def n9_change_records(spark, sf):
    """Before and after of every edit as one JSON payload each, as the audit keeps them."""
    log = E.record_change_log(field_records(spark, sf), edit_rows(spark, sf))
    side = lambda s: F.struct(F.col(f"{s}_value").alias("value"), F.col(f"{s}_unit").alias("unit"))
    body = F.to_json(
        F.struct("path", side("before").alias("before"), side("after").alias("after")), {"ignoreNullFields": "false"}
    )
    return log.select("job_id", "edit_ord", body.alias("payload"))


def _js(x: str) -> str:
    return f"coalesce('\"' || {x} || '\"', 'null')"


N9_SQL = "SELECT job_id, edit_ord, '{\"path\":\"' || path || '\",\"before\":{\"value\":' || " + _js("before_value") + \
    " || ',\"unit\":' || " + _js("before_unit") + " || '},\"after\":{\"value\":' || " + _js("after_value") + \
    " || ',\"unit\":' || " + _js("after_unit") + f" || '}}}}' AS payload FROM ({U11_SQL})"


def f12_edit_coercion(spark, sf):
    """Texts as new values of a number field that holds a whole number, a decimal, a flag, and of a text field."""
    words = bridge.records(spark, sf, ordered=False, sized=False).select(
        F.coalesce("gross_value", F.concat(F.lit(" "), F.col("item_quantity"), F.lit(".5 "))).alias("text")
    )
    words = words.unionByName(
        bridge.documents(spark, sf).select(F.explode(F.split("text", " ")).alias("text"))
    ).groupBy("text").agg(F.count("*").alias("uses"))
    parts = []
    for kind, path in (("int", "items[0].quantity"), ("float", "packages[0].gross_weight"),
                       ("bool", "packages[0].volume"), ("string", "packages[0].status")):
        value, _, error = V.coerced(F.lit(path), F.lit(kind), F.col("text"))
        parts += [value.alias(f"as_{kind}"), error.isNotNull().alias(f"{kind}_refused")]
    return words.select("text", "uses", *parts)


_T = "trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
_B = f"trim(replace({_T}, ',', ''))"
_NUM = r"'[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))'"
F12_SQL = f"""SELECT text, uses, CASE WHEN i THEN b END AS as_int, t <> '' AND NOT i AS int_refused,
 CASE WHEN n THEN b END AS as_float, t <> '' AND NOT n AS float_refused,
 CASE WHEN y THEN 'true' WHEN z THEN 'false' END AS as_bool, t <> '' AND NOT y AND NOT z AS bool_refused,
 nullif(t, '') AS as_string, false AS string_refused FROM (SELECT text, count(*) AS uses, {_T} AS t, {_B} AS b,
 regexp_full_match({_B}, '[+-]?[0-9]+') AS i, regexp_full_match({_B}, {_NUM}) AS n,
 lower({_T}) IN ('1', 'true', 'yes', 'on') AS y, lower({_T}) IN ('0', 'false', 'no', 'off') AS z FROM (
 SELECT CASE WHEN l_partkey % 19 = 0 THEN ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.5 '
  WHEN l_partkey % 23 = 0 THEN 'n/a' WHEN l_quantity >= 40 THEN '1,' || CAST(100 + CAST(l_quantity AS INT) AS VARCHAR)
  ELSE CAST(CAST(l_quantity AS INT) * 10 AS VARCHAR) END AS text FROM lineitem
 UNION ALL SELECT unnest(string_split(text, ' ')) FROM documents) GROUP BY text)"""


# ---- proposals -----------------------------------------------------------


def proposal_changes(spark, sf):
    """One proposal per job with changes of every weight; some hold no number, some change the source."""
    rec = bridge.records(spark, sf)
    path, net = FL.package_path("gross_weight"), FL.package_path("net_weight")
    change = lambda step, path, value: F.struct(
        (F.col("pkg_ord") * 10 + step).alias("change_ord"), path.alias("path"), value.alias("value")
    )
    rows = F.array(
        change(1, path, F.when(F.col("returnflag") == "R", "many").otherwise("77")),
        change(2, F.concat(F.lit(" "), path), F.lit("88")),
        change(3, F.concat(path, F.lit(".source")), F.lit("99")),
        change(4, net, F.lit("66")),
    )
    flat = rec.select("job_id", F.col("job_id").alias("proposal_id"), F.inline(rows))
    return flat.withColumns({"unit": F.lit(None).cast("string"), "reason": F.lit("as weighed")})


def u5_checked_changes(spark, sf):
    checked = E.checked_record_proposals(field_records(spark, sf), proposal_changes(spark, sf))
    return checked.select("job_id", "proposal_id", "path", "change_ord", "new_value")


U5_SQL = S.with_(FOLD) + """SELECT job_id, job_id AS proposal_id, path,
 pkg_ord * 10 + CASE WHEN returnflag = 'R' THEN 2 ELSE 1 END AS change_ord,
 CASE WHEN returnflag = 'R' THEN '88' ELSE '77' END AS new_value FROM ed
UNION ALL SELECT job_id, job_id, net_path, pkg_ord * 10 + 4, '66' FROM ed"""


def _proposals(spark, sf):
    return bridge.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("proposal_id"),
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderstatus") == "O", "rejected").otherwise("pending").alias("status"),
    )


def _stored_changes(spark, sf):
    """What a proposal keeps: its checked changes."""
    checked = E.checked_record_proposals(field_records(spark, sf), proposal_changes(spark, sf))
    return checked.select("job_id", "proposal_id", "change_ord", "path", F.col("new_value").alias("value"), "unit", "reason")


def _fields_now(spark, sf):
    """The fields when proposals are decided: of partly shipped orders the net weights are gone."""
    pending = bridge.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("job_id"), F.lit("net_weight").alias("name")
    )
    return base_fields(spark, sf).join(pending, ["job_id", "name"], "left_anti")


def u6_applied_proposals(spark, sf):
    """Decisions: a proposal applies when all of its changes still fit the fields."""
    return E.proposal_decisions(_fields_now(spark, sf), _proposals(spark, sf), _stored_changes(spark, sf))


U6_SQL = """SELECT o_orderkey AS proposal_id, o_orderkey AS job_id, coalesce(2 * n, 0) AS changes,
 CASE WHEN o_orderstatus = 'O' THEN 'rejected' WHEN n > 0 AND o_orderstatus = 'F' THEN 'applied' ELSE 'pending' END AS status,
 CASE WHEN o_orderstatus = 'O' THEN 'Proposal is already rejected.' WHEN NOT (coalesce(n, 0) > 0 AND o_orderstatus = 'F')
  THEN 'A proposed change can not be applied.' END AS problem
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


def u6_fields_after(spark, sf):
    """All fields with the changes of the applied proposals in place."""
    fields, changes = _fields_now(spark, sf), _stored_changes(spark, sf)
    after = E.apply_proposals(fields, E.proposal_decisions(fields, _proposals(spark, sf), changes), changes, "user")
    f = F.col("field")
    return after.select("job_id", "path", V.current_value(f).alias("value"), f["modified"].alias("modified"), f["working"]["modified_by"].alias("modified_by"))


U6_FIELDS_SQL = S.with_(FOLD) + """SELECT fl.job_id, fl.path, CASE WHEN changed IS NULL THEN src ELSE changed END AS value,
 changed IS NOT NULL AS modified, CASE WHEN changed IS NOT NULL THEN 'user' END AS modified_by FROM fl JOIN jobs ON jobs.job_id = fl.job_id
 LEFT JOIN (SELECT ed.job_id, path, CASE WHEN returnflag = 'R' THEN '88' ELSE '77' END AS changed FROM ed
  JOIN jobs ON jobs.job_id = ed.job_id WHERE order_status = 'F'
  UNION ALL SELECT ed.job_id, net_path, '66' FROM ed JOIN jobs ON jobs.job_id = ed.job_id WHERE order_status = 'F') c
  ON c.job_id = fl.job_id AND c.path = fl.path
 WHERE NOT (order_status = 'P' AND fl.path LIKE '%.net_weight')"""


def _proposals_in_turn(spark, sf):
    """Three proposals a job: all gross weights; all again, some no number; those of every second package."""
    rec = bridge.records(spark, sf)
    path = FL.package_path("gross_weight")
    value = lambda k, v: F.struct((F.col("job_id") * 3 + k).alias("proposal_id"), F.lit(v).alias("value"))
    several = F.when(F.col("returnflag") == "R", F.struct((F.col("job_id") * 3 + 1).alias("proposal_id"), F.lit("many").alias("value")))
    offered = F.array(value(2, "70"), several.otherwise(value(1, "60")), value(0, "50"))
    offered = F.when(F.col("pkg_ord") % 2 == 0, offered).otherwise(F.slice(offered, 2, 2))
    changes = rec.select("job_id", F.col("pkg_ord").alias("change_ord"), path.alias("path"), F.inline(offered))
    changes = changes.withColumns({"unit": F.lit(None).cast("string"), "reason": F.lit("in turn")})
    proposals = changes.select("proposal_id", "job_id").distinct().withColumn("status", F.lit("pending"))
    return proposals, changes


def u6_proposals_in_turn(spark, sf):
    """Gross weights after several proposals of a job: the last one that applies wins."""
    fields = base_fields(spark, sf)
    proposals, changes = _proposals_in_turn(spark, sf)
    after = E.apply_proposals(fields, E.proposal_decisions(fields, proposals, changes), changes, "user")
    return after.filter(F.col("name") == "gross_weight").select("job_id", "path", V.current_value(F.col("field")).alias("value"))


U6_TURN_SQL = S.with_(FOLD) + """SELECT ed.job_id, path, CASE WHEN pkg_ord % 2 = 0 THEN '70' WHEN refused THEN '50' ELSE '60' END AS value
 FROM ed JOIN (SELECT job_id, bool_or(returnflag = 'R') AS refused FROM ed GROUP BY 1) r ON r.job_id = ed.job_id"""


def u7_rejected_proposals(spark, sf):
    return E.rejected(_proposals(spark, sf))


U7_SQL = "SELECT o_orderkey AS proposal_id, o_orderkey AS job_id, 'rejected' AS status FROM orders"


# ---- mapping again -------------------------------------------------------


def _mapped_again(rec):
    return rec.filter(F.col("linestatus") == "O").withColumn("gross_value", F.col("net_value"))


def _again(spark, sf):
    """Every job mapped again: the lines of status O kept, their weights as net weights; requests for all packages."""
    rec = bridge.records(spark, sf)
    packages = bridge.package_fields(rec)
    new = bridge.package_fields(_mapped_again(rec))
    changed = rec.select("job_id", "pkg_ord", (F.col("returnflag") == "A").alias("modified"))
    requests = rec.select("job_id", "pkg_ord", (F.col("status") == "CONFIRMED").alias("discard"))
    case = V.case_text(F.col("case_number")).alias("case_number")
    return packages, new, E.package_replacements(
        packages.select("job_id", "pkg_ord", case), changed, new.select("job_id", "pkg_ord", case), requests
    )


AGAIN = f"""{S.PK}, nw AS (SELECT * FROM pk WHERE linestatus = 'O'),
same AS (SELECT job_id, case_no, min(pkg_ord) AS m FROM nw WHERE case_no IS NOT NULL GROUP BY 1, 2),
alone AS (SELECT job_id, min(pkg_ord) AS m FROM nw GROUP BY 1 HAVING count(*) = 1),
repl AS (SELECT pk.job_id, pk.pkg_ord, pk.case_no AS case_number, returnflag = 'A' AND status <> 'CONFIRMED' AS locked,
 coalesce(same.m, alone.m) AS target FROM pk LEFT JOIN same ON same.job_id = pk.job_id AND same.case_no = pk.case_no
 LEFT JOIN alone ON alone.job_id = pk.job_id)"""


def u8_package_replacements(spark, sf):
    return _again(spark, sf)[2]


U8_SQL = S.with_(AGAIN) + """SELECT job_id, pkg_ord, case_number, CASE WHEN NOT locked THEN target END AS mapped_ord,
 CASE WHEN locked THEN 'case was edited by hand'
 WHEN target IS NULL THEN 'new mapping has no single match' END AS problem FROM repl"""


def u8_replaced_packages(spark, sf):
    """Records take their new place, the fields are made over them once they moved."""
    rec = bridge.records(spark, sf)
    texts = ["segment_no", "status", "dim_unit", "case_value", "gross_value", "weight_unit", "net_value"]
    new = _mapped_again(rec).select("job_id", "pkg_ord", *texts)
    after = E.replace_packages(rec, new, _again(spark, sf)[2], texts)
    gross = bridge.package_columns(sized=False)["gross_weight"]
    return after.select("job_id", "pkg_ord", V.current_value(gross).alias("gross_weight"))


U8_REPLACED_SQL = S.with_(AGAIN) + """SELECT r.job_id, r.pkg_ord,
 CASE WHEN NOT locked AND target IS NOT NULL THEN nw.net_value ELSE pk.gross_value END AS gross_weight
 FROM repl r JOIN pk ON pk.job_id = r.job_id AND pk.pkg_ord = r.pkg_ord
 LEFT JOIN nw ON nw.job_id = r.job_id AND nw.pkg_ord = r.target"""


def u9_replaced_fields(spark, sf):
    packages, new, replacements = _again(spark, sf)
    fields = FL.package_fields_long(packages, ["gross_weight"])
    asked = fields.select("job_id", "pkg_ord", "path")
    after = E.replace_fields(fields, FL.package_fields_long(new, ["gross_weight"]), replacements, asked)
    return after.select("job_id", "path", V.current_value(F.col("field")).alias("value"))


U9_SQL = f"SELECT job_id, {PATH} AS path, gross_weight AS value FROM ({U8_REPLACED_SQL})"


def u10_jobs_with_changes(spark, sf):
    return E.jobs_with_changes(E.apply_record_edits(field_records(spark, sf), edit_rows(spark, sf)))


U10_SQL = S.with_(FOLD) + "SELECT job_id, bool_or(modified) AS needs_confirmation FROM fin GROUP BY 1"

QUERIES = {
    "u1_edited_fields": (u1_edited_fields, U1_SQL),
    "u1_edit_errors": (u1_edit_errors, U1_ERRORS_SQL),
    "u3_reverted_counts": (u3_reverted_counts, U3_SQL),
    "u4_job_status": (u4_job_status, U4_SQL),
    "u5_checked_changes": (u5_checked_changes, U5_SQL),
    "u6_applied_proposals": (u6_applied_proposals, U6_SQL),
    "u6_proposals_in_turn": (u6_proposals_in_turn, U6_TURN_SQL),
    "u6_fields_after": (u6_fields_after, U6_FIELDS_SQL),
    "u7_rejected_proposals": (u7_rejected_proposals, U7_SQL),
    "u8_package_replacements": (u8_package_replacements, U8_SQL),
    "u8_replaced_packages": (u8_replaced_packages, U8_REPLACED_SQL),
    "u9_replaced_fields": (u9_replaced_fields, U9_SQL),
    "u10_jobs_with_changes": (u10_jobs_with_changes, U10_SQL),
    "u11_change_log": (u11_change_log, U11_SQL),
    "a11_modified_flags": (a11_modified_flags, A11_SQL),
    "f12_edit_coercion": (f12_edit_coercion, F12_SQL),
    "n9_change_records": (n9_change_records, N9_SQL),
    "q4_modified_fields": (q4_modified_fields, Q4_SQL),
    "q7_change_lines": (q7_change_lines, Q7_SQL),
}
