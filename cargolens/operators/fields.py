"""Between wide package and item records and the long table of fields with paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.values import FIELD, case_text, current_value

SIDES = ["length", "width", "height"]


def package_path(name: str) -> Column:
    """packages[0].gross_weight, packages[0].dimensions.length"""
    tail = f".dimensions.{name}" if name in SIDES else f".{name}"
    return F.concat(F.lit("packages["), (F.col("pkg_ord") - 1).cast("string"), F.lit("]" + tail))


def item_path(name: str) -> Column:
    return F.concat(
        F.lit("packages["),
        (F.col("pkg_ord") - 1).cast("string"),
        F.lit("].items["),
        (F.col("item_ord") - 1).cast("string"),
        F.lit(f"].{name}"),
    )


def _long(df: DataFrame, names: list[str], path, root: str, extra: list[Column]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                path(n).alias("path"),
                F.lit(n).alias("name"),
                F.col(n).cast(FIELD).alias("field"),
            )
            for n in names
        ]
    )
    return df.select("job_id", F.lit(root).alias("root"), *extra, F.inline(rows))


@dataclass
class Listed:
    """Fields as columns over narrow rows, one row a record: the fields are made where they are needed.

    ``record`` names the record as paths do (packages[0], packages[0].items[0],
    order, shipment); every path is that name, a dot and the rest. ``more``
    are the columns that each field row carries besides.
    """

    rows: DataFrame
    record: Column
    paths: dict[str, Column]
    fields: dict[str, Column]
    more: list[Column]
    named: str  # pattern of the records' names

    def own(self, record: Column) -> Column:
        """Whether a record of that name can be one of these."""
        return record.rlike(self.named)

    def field_rows(self, rows: DataFrame, *also: Column, beside=None) -> DataFrame:
        """One row per field of ``rows``: job_id, the further columns, path, name, field, and what ``beside`` gives for its path."""
        listed = [
            F.struct(
                self.paths[n].alias("path"), F.lit(n).alias("name"), f.cast(FIELD).alias("field"),
                *([beside(self.paths[n])] if beside else []),
            )
            for n, f in self.fields.items()
        ]
        return rows.select("job_id", *self.more, *also, F.inline(F.array(*listed)))


def record_of(path: Column) -> Column:
    """The record a path lies in: a package, an item, the order or the shipment; '' for none."""
    return F.regexp_extract(path, r"^(packages\[[0-9]+\](?:[.]items\[[0-9]+\])?|order|shipment)[.]", 1)


def _record(rows: DataFrame, fields: dict[str, Column], path, root: str, named: str, extra: list[Column]) -> Listed:
    paths = {n: path(n) for n in fields}
    record = F.regexp_replace(path("x"), r"[.]x$", "")
    return Listed(rows, record, paths, fields, [F.lit(root).alias("root"), *extra], named)


def package_records(rows: DataFrame, fields: dict[str, Column]) -> Listed:
    """As ``package_fields_long`` over narrow rows (job_id, pkg_ord and what ``fields`` read)."""
    null = F.lit(None).cast("bigint")
    case = case_text(fields["case_number"]).alias("case_number")
    return _record(rows, fields, package_path, "packages", r"^packages\[[0-9]+\]$", [F.col("pkg_ord"), null.alias("item_ord"), case])


def item_records(rows: DataFrame, fields: dict[str, Column], case: Column) -> Listed:
    """As ``item_fields_long`` over narrow rows (job_id, pkg_ord, item_ord and what ``fields`` and ``case`` read)."""
    more = [F.col("pkg_ord"), F.col("item_ord"), case.alias("case_number")]
    return _record(rows, fields, item_path, "packages", r"[.]items\[[0-9]+\]$", more)


def job_records(rows: DataFrame, fields: dict[str, Column], root: str) -> Listed:
    """As ``job_fields_long`` for one root."""
    null = F.lit(None).cast("bigint")
    more = [null.alias("pkg_ord"), null.alias("item_ord"), F.lit(None).cast("string").alias("case_number")]
    return _record(rows, fields, lambda n: F.lit(f"{root}.{n}"), root, f"^{root}$", more)


def package_fields_long(packages: DataFrame, names: list[str]) -> DataFrame:
    null = F.lit(None).cast("bigint")
    return _long(
        packages,
        names,
        package_path,
        "packages",
        [F.col("pkg_ord"), null.alias("item_ord"), case_text(F.col("case_number")).alias("case_number")],
    )


def item_fields_long(items: DataFrame, names: list[str], cases: DataFrame | None = None) -> DataFrame:
    """Item fields; ``cases`` (job_id, pkg_ord, case_number) names the case of their package."""
    if cases is not None:
        items = items.join(cases, ["job_id", "pkg_ord"], "left")
        case = F.col("case_number")
    else:
        case = F.lit(None).cast("string")
    return _long(
        items, names, item_path, "packages", [F.col("pkg_ord"), F.col("item_ord"), case.alias("case_number")]
    )


def job_fields_long(jobs: DataFrame, roots: dict[str, str]) -> DataFrame:
    """Order and shipment fields; ``roots`` maps a column to order or shipment."""
    null = F.lit(None).cast("bigint")
    out = None
    for root in sorted(set(roots.values())):
        names = [n for n, r in roots.items() if r == root]
        part = _long(
            jobs,
            names,
            lambda n, root=root: F.lit(f"{root}.{n}"),
            root,
            [null.alias("pkg_ord"), null.alias("item_ord"), F.lit(None).cast("string").alias("case_number")],
        )
        out = part if out is None else out.unionByName(part)
    return out


def to_records(fields: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Long fields back to one wide record per key; a record has a fixed number of fields."""
    picks = [F.max_by("field", F.when(F.col("name") == n, 1)).alias(n) for n in names]
    return fields.groupBy(*keys).agg(*picks)


def snapshot(fields: DataFrame) -> DataFrame:
    """Source and working side of every field with its first three evidence entries."""
    f = F.col("field")
    return fields.select(
        "job_id",
        "path",
        f["source"]["value"].alias("source_value"),
        f["source"]["unit"].alias("source_unit"),
        f["working"]["value"].alias("working_value"),
        f["working"]["unit"].alias("working_unit"),
        f["working"]["origin"].alias("working_origin"),
        f["modified"].alias("modified"),
        F.slice(f["source"]["evidence"], 1, 3).alias("evidence"),
    )


def modified_flags(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any field of a job or package was changed."""
    return fields.groupBy(*keys).agg(F.bool_or(F.col("field.modified")).alias("modified"))


def evidence_locators(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct evidence locators per job, package or field."""
    return (
        fields.select(*keys, F.explode("field.source.evidence").alias("e"))
        .select(*keys, F.col("e.locator").alias("locator"))
        .filter(F.col("locator").isNotNull() & (F.col("locator") != ""))
        .distinct()
    )


def current(fields: DataFrame) -> DataFrame:
    return fields.select("job_id", "path", current_value(F.col("field")).alias("value"))
