"""Jobs over time: newest lists, last events and messages, progress, retention, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
DELETABLE = ["failed", "mapping_failed"]
PROGRESS_EVENTS = [
    "profile_matched", "profile_not_matched", "mapping_started", "mapping_progress",
    "mapping_completed", "mapping_failed",
]
LAST_EVENTS = 30
LAST_PROGRESS = 8
LAST_MESSAGES = 20
NEWEST_JOBS = 20


def newest(df: DataFrame, time: str, key: str, limit: int = NEWEST_JOBS) -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(limit)


def last_of_group(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The last rows of each group; Spark keeps only that many per group before the shuffle."""
    latest = Window.partitionBy(group).orderBy(F.col(order).desc())
    return df.withColumn("_place", F.row_number().over(latest)).filter(F.col("_place") <= limit).drop("_place")


def last_progress(events: DataFrame) -> DataFrame:
    return last_of_group(events.filter(F.col("event_type").isin(PROGRESS_EVENTS)), "job_id", "id", LAST_PROGRESS)


def last_model(events: DataFrame) -> DataFrame:
    """Model name in the payload of the latest finished mapping of each job."""
    done = events.filter(F.col("event_type") == "mapping_completed")
    return done.groupBy("job_id").agg(F.max_by("payload", "id").alias("_payload")).select(
        "job_id", F.get_json_object("_payload", "$.model").alias("model")
    )


def percent(status: Column, event_type: Column, payload: Column) -> Column:
    """Progress of a job from its status and its latest progress event."""
    stage = F.get_json_object(payload, "$.stage")
    given = F.coalesce(F.get_json_object(payload, "$.total").try_cast("double"), F.lit(0.0))
    total = F.greatest(F.lit(1.0), F.when(given == 0, 1.0).otherwise(given))
    current = F.coalesce(F.get_json_object(payload, "$.current").try_cast("double"), F.lit(0.0))
    part = F.greatest(F.lit(0.0), F.least(total, current))
    mapping = F.floor(10 + part / total * 65 + 0.5).cast("int")
    return (
        F.when(status.isin("mapped", "mapping_failed", "failed"), 100)
        .when(event_type.isNull(), F.when(status == "processing", 8).otherwise(0))
        .when(event_type.isin("profile_matched", "profile_not_matched"), 5)
        .when(event_type == "mapping_started", 8)
        .when((event_type == "mapping_progress") & (stage == "mapping"), mapping)
        .when((event_type == "mapping_progress") & (stage == "merging"), 82)
        .when((event_type == "mapping_progress") & (stage == "validating"), 92)
        .when(event_type.isin("mapping_completed", "mapping_failed"), 100)
        .otherwise(8)
    )


def progress(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Percent of every job."""
    latest = (
        events.filter(F.col("event_type").isin(PROGRESS_EVENTS))
        .groupBy("job_id")
        .agg(F.max_by(F.struct("event_type", "payload"), "id").alias("_e"))
    )
    joined = jobs.join(latest, "job_id", "left")
    return joined.select("job_id", percent(F.col("status"), F.col("_e.event_type"), F.col("_e.payload")).alias("percent"))


def learning_recommended(jobs: DataFrame, events: DataFrame, known: DataFrame) -> DataFrame:
    """Mapped jobs without a profile document for which no profile had matched."""
    unmatched = events.filter(F.col("event_type") == "profile_not_matched").select("job_id").distinct()
    return jobs.join(unmatched, "job_id", "left_semi").join(known.select("job_id").distinct(), "job_id", "left_anti")


def removable_jobs(jobs: DataFrame, links: DataFrame) -> DataFrame:
    """Failed jobs that are attached to no project."""
    return jobs.filter(F.col("status").isin(DELETABLE)).join(links.select("job_id"), "job_id", "left_anti")


def without_jobs(children: DataFrame, removed: DataFrame) -> DataFrame:
    return children.join(removed.select("job_id").distinct(), "job_id", "left_anti")


def detached_proposals(proposals: DataFrame, removed: DataFrame) -> DataFrame:
    """Knowledge proposals outlive their job: its number is cleared."""
    gone = removed.select("job_id", F.lit(True).alias("_gone")).distinct()
    return (
        proposals.join(gone, "job_id", "left")
        .withColumn("job_id", F.when(F.col("_gone").isNull(), F.col("job_id")))
        .drop("_gone")
    )


def older_than(entries: DataFrame, days: int, now: Column, time: str = "modified_at") -> DataFrame:
    """Entries changed more than ``days`` days ago, with their whole age in days; none when days is not positive."""
    if days <= 0:
        return entries.limit(0).withColumn("age_days", F.lit(0).cast("bigint"))
    seconds = F.unix_micros(now) - F.unix_micros(F.col(time).cast("timestamp"))
    day = 86_400_000_000
    old = entries.filter(seconds > days * day)
    return old.withColumn("age_days", F.greatest(F.floor(seconds / day), F.lit(0)))


def retention_list(entries: DataFrame, days: int, now: Column) -> DataFrame:
    return older_than(entries, days, now).orderBy("kind", "name")


def backups_to_prune(files: DataFrame, days: int, now: Column) -> DataFrame:
    return older_than(files.filter(F.col("name").endswith(".zip")), days, now)
