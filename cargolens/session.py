"""Session settings shared by tests, the bench and the registered queries."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans rely on. Skewed join partitions are split by
# AQE even when that costs one more exchange, because one key may hold a third
# of all rows. The JVM never compiles a method of more than 8,000 bytes; a stage
# that would be one runs operator by operator, whose expressions are split.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Rows made from an array column: this rule works out the whole array once more, only to see that it is not empty.
EXCLUDED_RULE = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built; rules it leaves out stay out."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    left_out = spark.conf.get("spark.sql.optimizer.excludedRules", None)
    rules = [r.strip() for r in (left_out or "").split(",") if r.strip()]
    if EXCLUDED_RULE not in rules:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join([*rules, EXCLUDED_RULE]))
    return spark


def local_session(app: str, cores: str = "8", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_LOCAL_DIRS: dict[str, str] = {}
_STAGED: dict[tuple[str, str, str], str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder for staged tables of this application, below the shared folder in ``spark.checkpoint.dir``.

    Where that is unset, a fresh folder serves in a session whose tasks all run
    in this process (``local[...]``, as in tests); on a cluster it is an error.
    """
    context = spark.sparkContext
    app = context.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/cargolens/{app}"
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="cargolens-")
    return _LOCAL_DIRS[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of their own in the shared folder: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def content_mark(spark: SparkSession, path: str) -> str:
    """Changes when a file of the folder, or of a folder in it, is written anew."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(top):
        return ""
    seen, open_ = [], [top]
    while open_:
        for s in files.listStatus(open_.pop()):
            seen.append(f"{s.getPath()} {s.getModificationTime()} {s.getLen()}")
            if s.isDirectory():
                open_.append(s.getPath())
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def staged(spark: SparkSession, key: str, build) -> DataFrame:
    """A table written once and read back: cuts lineage and survives lost executors.

    ``key`` is a name and, after a colon, the input folder; a changed input
    makes a new table.
    """
    mark = content_mark(spark, key.partition(":")[2])
    slot = (spark.sparkContext.applicationId, key, mark)
    if slot not in _STAGED:
        name = hashlib.sha256(f"{key} {mark}".encode()).hexdigest()[:16]
        path = f"{work_dir(spark)}/{name}"
        build().write.mode("overwrite").parquet(path)
        _STAGED[slot] = path
    return spark.read.parquet(_STAGED[slot])
