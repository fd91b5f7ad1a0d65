"""Typed questions on packages: counts, unit-aware filters, sums by unit, changes, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.functions.values import (
    blank_to_null,
    case_label,
    checked_unit,
    current_value,
    field_number,
    normal_unit,
    ordered,
    short_number,
)

METRICS = ["gross_weight", "net_weight", "length", "width", "height", "item_count"]
COMPARATORS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "="}
UNITLESS = "(unitless)"


def metric(name: str) -> tuple[Column, Column]:
    """(number, unit or null) of one package metric; sides fall back on the package unit."""
    if name == "item_count":
        return F.col("item_count").cast("double"), F.lit(None).cast("string")
    field = F.col(name)
    fallback = F.col("dim_unit") if name in ("length", "width", "height") else None
    return field_number(field), blank_to_null(checked_unit(field, fallback))


def with_item_count(packages: DataFrame, items: DataFrame) -> DataFrame:
    """Packages with their number of items, 0 kept."""
    counts = items.groupBy("job_id", "pkg_ord").agg(F.count("*").alias("item_count"))
    return packages.join(counts, ["job_id", "pkg_ord"], "left").fillna(0, ["item_count"])


def count_packages(jobs: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages of every job; a job without packages counts 0."""
    counts = packages.groupBy("job_id").agg(F.count("*").alias("package_count"))
    return jobs.select("job_id").join(counts, "job_id", "left").fillna(0, ["package_count"])


def classify_packages(packages: DataFrame, name: str, op: str, value: float, unit: str | None = None) -> DataFrame:
    """Label every package: match, no_match, skipped_unit or missing.

    A unit that was asked for is compared after normalising and never converted.
    """
    if name not in METRICS or op not in COMPARATORS or value is None:
        raise ValueError("a package filter needs a metric, a comparator and a value")
    amount, own_unit = metric(name)
    rows = packages.withColumns({"value": amount, "unit": own_unit})
    wanted = normal_unit(F.lit(unit)) if unit else F.lit("")
    asked = wanted != ""
    other = asked & F.col("unit").isNotNull() & (F.col("unit") != wanted)
    without = asked & F.col("unit").isNull() & F.lit(name != "item_count")
    label = (
        F.when(F.col("value").isNull(), "missing")
        .when(other | without, "skipped_unit")
        .when(ordered(F.col("value"), op, F.lit(float(value))), "match")
        .otherwise("no_match")
    )
    return rows.select(
        "job_id",
        "pkg_ord",
        case_label(F.col("case_number")).alias("case_number"),
        "value",
        "unit",
        label.alias("outcome"),
    )


def filter_packages(packages: DataFrame, name: str, op: str, value: float, unit: str | None = None) -> DataFrame:
    labelled = classify_packages(packages, name, op, value, unit)
    return labelled.filter(F.col("outcome") == "match").drop("outcome")


def skipped_units(packages: DataFrame, name: str, op: str, value: float, unit: str) -> DataFrame:
    """Units of a job that were not compared, each once."""
    labelled = classify_packages(packages, name, op, value, unit)
    return (
        labelled.filter(F.col("outcome") == "skipped_unit")
        .select("job_id", F.coalesce("unit", F.lit("(missing)")).alias("unit"))
        .distinct()
    )


def missing_cases(packages: DataFrame, name: str) -> DataFrame:
    """Packages whose metric is not a number, as rows in package order."""
    amount, _ = metric(name)
    return packages.filter(amount.isNull()).select(
        "job_id", "pkg_ord", case_label(F.col("case_number")).alias("case_number")
    )


def sum_by_unit(packages: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Total of a metric per normalised unit; units are never converted or mixed."""
    if name not in METRICS:
        raise ValueError("a sum needs a numeric package metric")
    amount, unit = metric(name)
    return (
        packages.select(*keys, amount.alias("value"), F.coalesce(unit, F.lit(UNITLESS)).alias("unit"))
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "unit")
        .agg(F.sum("value").alias("total"), F.count("*").alias("packages"))
    )


def modified_fields(fields: DataFrame) -> DataFrame:
    """Changed fields with source value, working value, unit and reason."""
    field = F.col("field")
    return fields.filter(field["modified"]).select(
        "job_id",
        "path",
        field["source"]["value"].alias("source_value"),
        field["working"]["value"].alias("working_value"),
        blank_to_null(checked_unit(field)).alias("unit"),
        field["working"]["reason"].alias("reason"),
    )


def list_issues(issues: DataFrame, severity: str | None = None) -> DataFrame:
    """Unresolved issues, of one severity when asked."""
    rows = issues.filter(~F.col("resolved"))
    return rows if severity is None else rows.filter(F.col("severity") == severity)


MAX_QUERIES = 6


def answer(packages: DataFrame, issues: DataFrame, jobs: DataFrame, queries: list[dict]) -> list[DataFrame]:
    """Results of a batch of typed queries; a batch holds at most six, ``refused`` names later ones."""
    out = []
    for query in queries[:MAX_QUERIES]:
        kind = query["operation"]
        if kind == "count_packages":
            out.append(count_packages(jobs, packages))
        elif kind == "filter_packages":
            out.append(
                filter_packages(packages, query["field"], query["comparator"], query["value"], query.get("unit"))
            )
        elif kind == "sum_package_field":
            out.append(sum_by_unit(packages, query["field"], ["job_id"]))
        elif kind == "list_issues":
            out.append(list_issues(issues, query.get("severity")))
        else:
            raise ValueError(f"unsupported operation {kind}")
    return out


def refused(spark: SparkSession, queries: list[dict]) -> DataFrame:
    """One row for each query beyond the six of a batch."""
    rows = [(n, None, f"a batch holds {MAX_QUERIES} queries") for n in range(MAX_QUERIES + 1, len(queries) + 1)]
    return spark.createDataFrame(rows, "query_no int, result_rows bigint, refused string")


# ---- answers as text lines -----------------------------------------------
# A job may have any number of matches, so an answer is a table of lines and
# not one text per job.


def count_lines(counts: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Package count: "), F.col("package_count").cast("string"), F.lit("."))
    return counts.select("job_id", text.alias("line"))


def match_lines(matches: DataFrame) -> DataFrame:
    """'C-1 (1600 KG)' per match."""
    shown = F.concat(
        F.col("case_number"),
        F.lit(" ("),
        short_number(F.col("value")),
        F.coalesce(F.concat(F.lit(" "), F.col("unit")), F.lit("")),
        F.lit(")"),
    )
    return matches.select("job_id", "pkg_ord", shown.alias("line"))


def match_heading(name: str, op: str, value: float, unit: str | None, found: bool) -> Column:
    """Sentence above the matches, or the sentence that there are none."""
    shown = short_number(F.lit(float(value)))
    tail = f" {unit}" if unit else ""
    words = f"{name.replace('_', ' ')} {COMPARATORS[op]} "
    if found:
        return F.concat(F.lit(f"Cases with {words}"), shown, F.lit(f"{tail}:"))
    return F.concat(F.lit(f"No cases have {words}"), shown, F.lit(f"{tail} in the current working data."))


def total_lines(totals: DataFrame, name: str) -> DataFrame:
    """'Total gross weight: 100 KG' per job and unit."""
    unit = F.when(F.col("unit") == UNITLESS, "").otherwise(F.concat(F.lit(" "), F.col("unit")))
    text = F.concat(F.lit(f"Total {name.replace('_', ' ')}: "), short_number(F.col("total")), unit)
    return totals.select("job_id", "unit", text.alias("line"))


def change_lines(changes: DataFrame) -> DataFrame:
    none = F.lit("None")
    text = F.concat(
        F.col("path"),
        F.lit(": "),
        F.coalesce("source_value", none),
        F.lit(" -> "),
        F.coalesce("working_value", none),
        F.coalesce(F.concat(F.lit(" "), F.col("unit")), F.lit("")),
    )
    return changes.select("job_id", "path", text.alias("line"))


def issue_lines(issues: DataFrame) -> DataFrame:
    text = F.concat(
        F.col("severity"),
        F.lit(" "),
        F.col("code"),
        F.lit(": "),
        F.col("message"),
        F.coalesce(F.concat(F.lit(" (Case "), blank_to_null(F.col("case_number")), F.lit(")")), F.lit("")),
    )
    return issues.select("job_id", "code", "field_path", text.alias("line"))


def package_summary(packages: DataFrame, items: DataFrame) -> DataFrame:
    """One short row per package: case, weights with their working units, sides, item count."""
    value = lambda name: current_value(F.col(name)).alias(name)
    return with_item_count(packages, items).select(
        "job_id",
        (F.col("pkg_ord") - 1).alias("package_index"),
        value("case_number"),
        value("gross_weight"),
        F.col("gross_weight.working.unit").alias("gross_weight_unit"),
        value("net_weight"),
        F.col("net_weight.working.unit").alias("net_weight_unit"),
        value("length"),
        value("width"),
        value("height"),
        F.col("dim_unit").alias("dimension_unit"),
        "item_count",
    )
