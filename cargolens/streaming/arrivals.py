"""What arrives over time: files in a folder, audit events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cargolens.operators.chunking import assemble_checked
from cargolens.operators.knowledge import match_profiles
from cargolens.sources.files import chunk_files, file_columns, upload_status

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Files of a folder as a stream of register rows."""
    return file_columns(
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )


def ingest(
    files: DataFrame, out: str, checkpoint: str, profiles: DataFrame | None = None, once: bool = True
) -> StreamingQuery:
    """Register, extract, chunk and match every arriving file.

    Each batch writes its own folder, so a batch that is run again after a
    failure replaces what it had written. A file seen before is a new job.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        chunks, rejects = chunk_files(batch)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch_id={number}")
        spark = batch.sparkSession
        written = spark.read.schema(chunks.schema).parquet(f"{out}/chunks/batch_id={number}")
        status = upload_status(batch.drop("content"), written, rejects)
        status.write.mode("overwrite").parquet(f"{out}/status/batch_id={number}")
        if profiles is not None:
            texts = assemble_checked(written, "path", ["position"])[0].withColumnRenamed("path", "file_path")
            matched = match_profiles(texts, profiles, "file_path")
            matched.write.mode("overwrite").parquet(f"{out}/profiles/batch_id={number}")

    writer = files.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_status(events: DataFrame) -> DataFrame:
    """Latest event of every job, kept up to date; events have no time bound, so there is no watermark."""
    return events.groupBy("job_id").agg(F.max(F.struct("id", "event_type", "payload")).alias("_last"))


def follow_status(events: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the changed jobs of each batch; a repeated batch replaces its folder."""

    def one_batch(batch: DataFrame, number: int) -> None:
        batch.select("job_id", "_last.*").write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    writer = (
        latest_status(events)
        .writeStream.outputMode("update")
        .foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_status(spark: SparkSession, out: str) -> DataFrame:
    """Current status per job from the written batches."""
    rows = spark.read.parquet(out)
    return rows.groupBy("job_id").agg(F.max_by(F.struct("id", "event_type", "payload"), "batch_id").alias("_l")).select(
        "job_id", "_l.*"
    )
