"""Sinks: cell comparison, score report, audit append; output datasets are released by ``publish``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.values import number


def refused_cells(cells: DataFrame) -> DataFrame:
    """Numeric cells whose value is not a finite number."""
    value = F.nullif(F.col("value"), F.lit(""))
    amount = number(value)
    bad = amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf"))
    return cells.filter(F.col("numeric") & value.isNotNull() & bad)


def cell_differences(written: DataFrame, read: DataFrame) -> DataFrame:
    """Cells that differ after the read-back: null equals '', numbers compare as numbers."""

    def shaped(df: DataFrame, name: str) -> DataFrame:
        value = F.nullif(F.col("value"), F.lit(""))
        as_number = F.when(F.col("numeric"), value.try_cast("double"))
        as_text = F.when(~F.col("numeric"), value)
        return df.select("project_id", "ref", F.struct(as_number.alias("n"), as_text.alias("t")).alias(name))

    left, right = shaped(written, "written"), shaped(read, "read")
    return left.join(right, ["project_id", "ref"], "full_outer").filter(
        ~F.col("written").eqNullSafe(F.col("read"))
    )


def write_score_report(aggregate: DataFrame, cases: DataFrame, path: str) -> None:
    """Score report as JSON: one folder for the aggregate, one for the documents."""
    aggregate.write.mode("overwrite").json(f"{path}/aggregate")
    cases.write.mode("overwrite").json(f"{path}/cases")


def audit_rows(changes: DataFrame, event_type: str, summary: str, payload: list[str], actor: str) -> DataFrame:
    """One audit row per change, with the named columns as its JSON payload."""
    return changes.select(
        "job_id",
        F.lit(event_type).alias("event_type"),
        F.lit(summary).alias("summary"),
        F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload"),
        F.lit(actor).alias("actor"),
        F.current_timestamp().alias("created_at"),
    )


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
