"""SQL text shared by the check queries: the shipping model as views over the given tables."""

from __future__ import annotations

REC = """rec AS (
SELECT l.l_orderkey AS job_id,
 row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
  l.l_quantity, l.l_extendedprice, l.l_shipdate) AS pkg_ord,
 l.l_linenumber AS segment_no,
 CASE WHEN l.l_partkey % 50 = 0 THEN NULL ELSE concat(' C-', CAST(l.l_partkey % 3 AS VARCHAR), ' ') END AS case_value,
 CASE WHEN l.l_partkey % 19 = 0 THEN NULL WHEN l.l_partkey % 23 = 0 THEN 'n/a'
      WHEN l.l_quantity >= 40 THEN concat('1,', CAST(100 + CAST(l.l_quantity AS INT) AS VARCHAR))
      ELSE CAST(CAST(l.l_quantity AS INT) * 10 AS VARCHAR) END AS gross_value,
 CASE WHEN l.l_suppkey % 17 = 0 THEN ''
      ELSE CAST(CAST(l.l_quantity AS INT) * (8 + CAST(l.l_suppkey % 4 AS INT)) AS VARCHAR) END AS net_value,
 CASE WHEN l.l_returnflag = 'A' THEN 'KG' WHEN l.l_returnflag = 'N' THEN 'lb.'
      WHEN l.l_linestatus = 'F' THEN '' ELSE 'Stone' END AS weight_unit,
 CASE WHEN p.p_size % 11 = 0 THEN NULL ELSE CAST(p.p_size * 10 AS VARCHAR) END AS length_value,
 CAST(p.p_size * 5 AS VARCHAR) AS width_value,
 CASE WHEN p.p_size % 13 = 0 THEN '-1' ELSE CAST(p.p_size AS VARCHAR) END AS height_value,
 CASE WHEN l.l_returnflag = 'A' THEN 'MM' WHEN l.l_returnflag = 'N' THEN 'cm' ELSE 'in.' END AS dim_unit,
 CASE l.l_linestatus WHEN 'F' THEN 'CONFIRMED'
      ELSE CASE WHEN l.l_partkey % 5 = 0 THEN 'AMBIGUOUS' ELSE 'SUPPORTED' END END AS status,
 l.l_linenumber AS item_seq, CAST(l.l_partkey AS VARCHAR) AS item_number, p.p_name AS item_description,
 CAST(CAST(l.l_quantity AS INT) AS VARCHAR) AS item_quantity,
 CASE WHEN l.l_suppkey % 13 = 0 THEN NULL ELSE 'PC' END AS item_uom,
 l.l_returnflag AS returnflag, l.l_linestatus AS linestatus
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""


def num(value: str) -> str:
    return f"TRY_CAST(replace({value}, ',', '') AS DOUBLE)"


def unit(value: str) -> str:
    return f"replace(upper(trim(coalesce({value}, ''))), '.', '')"


def case(value: str = "case_value") -> str:
    return f"nullif(trim({value}), '')"


def label(value: str = "case_value") -> str:
    return f"CASE WHEN coalesce({value}, '') = '' THEN '(missing case number)' ELSE trim({value}) END"


# Packages with parsed numbers and normalised units.
PK = f"""{REC},
pk AS (SELECT *, pkg_ord - 1 AS n, {case()} AS case_no, {label()} AS case_label,
 {num('gross_value')} AS gross, {num('net_value')} AS net,
 {num('length_value')} AS len, {num('width_value')} AS wid, {num('height_value')} AS hei,
 {unit('weight_unit')} AS wu, {unit('dim_unit')} AS du FROM rec)"""

JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS project_id, o_orderstatus AS order_status,
 'Order ' || CAST(o_orderkey AS VARCHAR) AS title, o_orderdate AS created_at,
 CASE WHEN o_orderstatus <> 'O' THEN 'PO-' || CAST(o_custkey AS VARCHAR) END AS purchase_order,
 CASE WHEN o_orderstatus = 'P' THEN '10' END AS purchase_order_position,
 CASE WHEN o_orderstatus = 'F' THEN 'Supplier ' || substr(o_orderpriority, 1, 1) END AS supplier_name
FROM orders)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
