"""Output datasets that readers see only after every cell was read back.

A run writes its rows and header cells below folders of its own, reads them
again, and compares them with what it was given. Its outcome per project is a
manifest that one rename puts in place; readers go by the newest manifest
alone. Projects with blocking messages are refused before anything is written,
projects with a cell that differs or is no number are discarded, and both keep
what an earlier run had released. A run that dies before its rename has
changed nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cargolens.functions.values import number
from cargolens.operators.context import ROW_COLUMNS, row_cells
from cargolens.session import written

# Fixed value: mismatches that a report shows.
SHOWN_MISMATCHES = 10

MANIFEST = (
    "project_id {id}, status string, blocking long, rows_written long, cells_written long, filled_cells long, refused_cells long, "
    "mismatches long, first_mismatches array<string>, fingerprint decimal(38,0), released_run string"
)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest_manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """Number and rows of the newest manifest; (0, None) before the first run."""
    _, at, fs = _files(spark, f"{path}/manifest")
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(at)] if fs.exists(at) else []
    return (max(numbers), spark.read.parquet(f"{path}/manifest/{max(numbers):012d}")) if numbers else (0, None)


def _commit(spark: SparkSession, staged: str, path: str, next_number: int) -> None:
    """Rename the staged manifest into place; another run that took the number is an error."""
    jvm, target, fs = _files(spark, f"{path}/manifest/{next_number:012d}")
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), target):
        raise RuntimeError(f"manifest {next_number} is there already: another run was faster")


def _as_written(cells: DataFrame) -> DataFrame:
    """What counts of a cell: '' is null, numbers compare as numbers, all else as text."""
    value = F.nullif(F.col("value"), F.lit(""))
    as_number = F.when(F.col("numeric"), number(value))
    bad = F.col("numeric") & value.isNotNull() & (as_number.isNull() | F.isnan(as_number) | (F.abs(as_number) == float("inf")))
    return cells.select(
        "project_id", "ref", F.struct(as_number.alias("n"), F.when(~F.col("numeric") | bad, value).alias("t")).alias("cell"), bad.alias("bad")
    )


def cell_outcomes(expected: DataFrame, read: DataFrame) -> DataFrame:
    """Per project: cells read, filled, refused and different, the first that differ, and a fingerprint free of order.

    Equal (project_id, ref) rows on one side are compared with each of the other's.
    """
    left = _as_written(expected).withColumn("_want", F.lit(True))
    right = _as_written(read).select("project_id", "ref", F.col("cell").alias("again"), F.lit(True).alias("_got"))
    both = left.join(right, ["project_id", "ref"], "full_outer")
    differs = F.col("_want").isNull() | F.col("_got").isNull() | ~F.col("cell").eqNullSafe(F.col("again"))
    both = both.select("project_id", "ref", "again", "bad", "_got", differs.alias("_differs"))
    filled = F.col("again.n").isNotNull() | F.col("again.t").isNotNull()
    # numbers to six places, so that the fingerprint does not hang on how they print
    shown = F.coalesce(F.round(F.col("again.n") * 1_000_000).cast("decimal(38,0)").cast("string"), F.col("again.t"))
    mark = F.md5(F.concat_ws("|", F.col("project_id").cast("string"), "ref", shown).cast("binary"))
    mark = F.conv(F.substring(mark, 1, 8), 16, 10).cast("decimal(20,0)")
    totals = both.groupBy("project_id").agg(
        F.count("_got").alias("cells_written"),
        F.count_if(filled).alias("filled_cells"),
        F.count_if("bad").alias("refused_cells"),
        F.count_if("_differs").alias("mismatches"),
        F.sum(F.when(filled, mark)).cast("decimal(38,0)").alias("fingerprint"),
    )
    order = Window.partitionBy("project_id").orderBy("ref")
    wrong = both.filter("_differs").withColumn("_no", F.row_number().over(order)).filter(F.col("_no") <= SHOWN_MISMATCHES)
    wrong = wrong.groupBy("project_id").agg(F.array_sort(F.collect_list("ref")).alias("first_mismatches"))
    return totals.join(wrong, "project_id", "left")


def publish(rows: DataFrame, headers: DataFrame, blocking: DataFrame, path: str) -> DataFrame:
    """Write, read back and release the output of every project in ``blocking`` (project_id, blocking); the manifest.

    status is refused (blocking messages, or a null count), discarded (a cell
    differs or is no finite number, or there are no rows) or completed.
    Projects that ``blocking`` does not name are not written. released_run is
    the run whose rows readers see of a project, null for none.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    known, before = latest_manifest(spark, path)
    asked = blocking.groupBy("project_id").agg(F.max(F.coalesce("blocking", F.lit(1))).cast("long").alias("blocking"))
    asked = written(asked, "asked-projects")  # gates may stand at the end of long work, and are read four times
    free = asked.filter("blocking = 0").select("project_id")
    columns = ["project_id", "job_id", "excel_row", *ROW_COLUMNS]
    rows = rows.select(*columns).join(free, "project_id", "left_semi")
    headers = headers.select("project_id", "ref", "value", "numeric").join(free, "project_id", "left_semi")
    rows.write.parquet(f"{path}/rows/run={run}")
    headers.write.parquet(f"{path}/headers/run={run}")

    rows_again = spark.read.schema(rows.schema).parquet(f"{path}/rows/run={run}")
    headers_again = spark.read.schema(headers.schema).parquet(f"{path}/headers/run={run}")
    outcome = cell_outcomes(row_cells(rows).unionByName(headers), row_cells(rows_again).unionByName(headers_again))
    count = rows_again.groupBy("project_id").agg(F.count("*").alias("rows_written"))
    whole = asked.join(count, "project_id", "left").join(outcome, "project_id", "left")
    whole = whole.fillna(0, ["rows_written", "cells_written", "filled_cells", "refused_cells", "mismatches"])
    clean = (F.col("rows_written") > 0) & (F.col("refused_cells") == 0) & (F.col("mismatches") == 0)
    whole = whole.withColumn("status", F.when(F.col("blocking") > 0, "refused").when(clean, "completed").otherwise("discarded"))

    earlier = before.select("project_id", F.col("released_run").alias("_earlier")) if before is not None else None
    own = F.when(F.col("status") == "completed", run)
    if earlier is None:
        whole = whole.withColumn("released_run", own)
    else:  # projects that this run was not asked for stay as they are
        whole = whole.join(earlier, "project_id", "full_outer").withColumn("released_run", F.coalesce(own, "_earlier"))
        whole = whole.withColumn("status", F.coalesce("status", F.lit("kept")))
    kind = rows.schema["project_id"].dataType.simpleString()
    names = StructType.fromDDL(MANIFEST.format(id=kind)).names
    staged = f"{path}/staging/{run}"
    whole.select(*names).to(StructType.fromDDL(MANIFEST.format(id=kind))).write.parquet(staged)
    _commit(spark, staged, path, known + 1)
    return spark.read.parquet(f"{path}/manifest/{known + 1:012d}")


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The released rows of all projects by the newest manifest; None before the first run."""
    _, manifest = latest_manifest(spark, path)
    if manifest is None:
        return None
    released = manifest.filter("released_run is not null").select("project_id", F.col("released_run").alias("run"))
    return spark.read.parquet(f"{path}/rows").join(released, ["project_id", "run"], "left_semi")
