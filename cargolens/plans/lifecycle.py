"""Registered queries: lists, last events and messages, progress, retention, removal, streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from cargolens.functions import hashing as H
from cargolens.operators import lifecycle as L
from cargolens.plans import sql as S
from cargolens.session import staged, work_dir
from cargolens.sources import bridge, sinks
from cargolens.streaming import arrivals

NOW = "2000-01-01 00:00:00"
RETENTION_DAYS = 900

# The audit events behind the given events, with a payload that carries stage and model.
KINDS = {
    "view": "profile_matched", "signup": "profile_not_matched", "click": "mapping_started",
    "error": "mapping_progress", "purchase": "mapping_completed",
}
STAGES = {0: "mapping", 1: "merging", 2: "validating", 3: "waiting"}


def audit(spark, sf):
    e = bridge.audit_events(spark, sf)
    k = F.get_json_object("payload", "$.k").cast("int")
    kind = F.col("event_type")
    for name, audit_name in KINDS.items():
        kind = F.when(F.col("event_type") == name, audit_name).otherwise(kind)
    stage = F.lit("mapping")
    for code, name in STAGES.items():
        stage = F.when(k % 4 == code, name).otherwise(stage)
    payload = F.concat(
        F.lit('{"stage":"'), stage, F.lit('","current":'), k.cast("string"),
        F.lit(',"total":90,"model":"m'), (k % 7).cast("string"), F.lit('"}'),
    )
    return e.select("id", "job_id", kind.alias("event_type"), payload.alias("payload"), "created_at")


_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
AUDIT = f"""ev AS (SELECT event_id AS id, user_id AS job_id, {_KIND} AS kind,
 CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
au AS (SELECT *, '{{"stage":"' || CASE k % 4 WHEN 0 THEN 'mapping' WHEN 1 THEN 'merging' WHEN 2 THEN 'validating' ELSE 'waiting' END
 || '","current":' || CAST(k AS VARCHAR) || ',"total":90,"model":"m' || CAST(k % 7 AS VARCHAR) || '"}}' AS payload FROM ev)"""


def _jobs(spark, sf):
    """Orders as jobs with a status."""
    o = bridge.table(spark, sf, "orders")
    status = F.when(F.col("o_orderpriority") == "5-LOW", "failed").when(
        F.col("o_orderpriority") == "4-NOT SPECIFIED", "mapping_failed"
    ).otherwise("mapped")
    return o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), "o_orderstatus", "o_orderdate")


def l1_newest_jobs(spark, sf):
    jobs = _jobs(spark, sf).select("job_id", "status", F.col("o_orderdate").alias("created_at"))
    return L.newest(jobs, "created_at", "job_id")


L1_SQL = """SELECT o_orderkey AS job_id, CASE o_orderpriority WHEN '5-LOW' THEN 'failed' WHEN '4-NOT SPECIFIED'
 THEN 'mapping_failed' ELSE 'mapped' END AS status, o_orderdate AS created_at FROM orders
 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"""


def l2_last_events(spark, sf):
    return L.last_of_group(audit(spark, sf), "job_id", "id", L.LAST_EVENTS).select("job_id", "id", "event_type")


L2_SQL = S.with_(AUDIT) + """SELECT job_id, id, kind AS event_type FROM au
 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY id DESC) <= 30"""


def l3_last_progress(spark, sf):
    return L.last_progress(audit(spark, sf)).select("job_id", "id", "event_type", "payload")


L3_SQL = S.with_(AUDIT) + """SELECT job_id, id, kind AS event_type, payload FROM au
 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY id DESC) <= 8"""


def l4_last_model(spark, sf):
    return L.last_model(audit(spark, sf))


L4_SQL = S.with_(AUDIT) + """SELECT job_id, 'm' || CAST(arg_max(k, id) % 7 AS VARCHAR) AS model FROM au
 WHERE kind = 'mapping_completed' GROUP BY 1"""


def l5_last_messages(spark, sf):
    """The last messages of every conversation."""
    talk = bridge.table(spark, sf, "conversations")
    last = L.last_of_group(talk, "conv_id", "turn", L.LAST_MESSAGES)
    return last.select("conv_id", "turn", "role", H.content_hash(F.col("text")).alias("sha256"))


L5_SQL = f"""SELECT conv_id, turn, role, sha256(text) AS sha256 FROM conversations
 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {L.LAST_MESSAGES}"""


def y1_removable_jobs(spark, sf):
    jobs = _jobs(spark, sf)
    return L.removable_jobs(jobs, jobs.filter(F.col("o_orderstatus") == "F")).select("job_id", "status")


Y1_SQL = """SELECT o_orderkey AS job_id, CASE o_orderpriority WHEN '5-LOW' THEN 'failed' ELSE 'mapping_failed' END AS status
 FROM orders WHERE o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') AND o_orderstatus <> 'F'"""


def y1_remaining_rows(spark, sf):
    """Dependent rows left, and proposals kept without their job, after failed jobs are removed."""
    jobs = _jobs(spark, sf)
    gone = L.removable_jobs(jobs, jobs.filter(F.col("o_orderstatus") == "F"))
    rows = bridge.records(spark, sf, ordered=False, sized=False).select("job_id")
    left = L.without_jobs(rows, gone).groupBy("job_id").agg(F.count("*").alias("rows"))
    proposals = L.detached_proposals(jobs.select("job_id", F.col("job_id").alias("proposal_id")), gone)
    return proposals.join(left.withColumnRenamed("job_id", "proposal_id"), "proposal_id", "left").select(
        "proposal_id", "job_id", F.coalesce("rows", F.lit(0)).alias("rows")
    )


Y1_ROWS_SQL = """SELECT o_orderkey AS proposal_id, CASE WHEN NOT gone THEN o_orderkey END AS job_id,
 CASE WHEN gone THEN 0 ELSE coalesce(n, 0) END AS rows FROM (SELECT *, o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED')
 AND o_orderstatus <> 'F' AS gone FROM orders) LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
 ON l_orderkey = o_orderkey"""


def y2_retention(spark, sf):
    entries = _jobs(spark, sf).select(
        F.lit("job").alias("kind"), F.col("job_id").cast("string").alias("name"), F.col("o_orderdate").alias("modified_at")
    )
    return L.retention_list(entries, RETENTION_DAYS, F.lit(NOW).cast("timestamp")).select("kind", "name", "age_days")


Y2_SQL = f"""SELECT 'job' AS kind, CAST(o_orderkey AS VARCHAR) AS name,
 CAST(floor(epoch(TIMESTAMP '{NOW}' - o_orderdate) / 86400) AS BIGINT) AS age_days FROM orders
 WHERE o_orderdate < TIMESTAMP '{NOW}' - INTERVAL {RETENTION_DAYS} DAY"""


def y3_backups_to_prune(spark, sf):
    backups = _jobs(spark, sf).select(
        F.concat(F.col("job_id").cast("string"), F.when(F.col("o_orderstatus") == "O", ".tmp").otherwise(".zip")).alias("name"),
        F.col("o_orderdate").alias("modified_at"),
    )
    return L.backups_to_prune(backups, RETENTION_DAYS, F.lit(NOW).cast("timestamp")).select("name", "age_days")


Y3_SQL = f"""SELECT CAST(o_orderkey AS VARCHAR) || '.zip' AS name,
 CAST(floor(epoch(TIMESTAMP '{NOW}' - o_orderdate) / 86400) AS BIGINT) AS age_days FROM orders
 WHERE o_orderdate < TIMESTAMP '{NOW}' - INTERVAL {RETENTION_DAYS} DAY AND o_orderstatus <> 'O'"""


def y4_learning_recommended(spark, sf):
    events = audit(spark, sf)
    known = bridge.table(spark, sf, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("job_id"))
    return L.learning_recommended(events.select("job_id").distinct(), events, known)


Y4_SQL = S.with_(AUDIT) + """SELECT DISTINCT job_id FROM au WHERE kind = 'profile_not_matched'
 AND job_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""


def y7_progress(spark, sf):
    events = audit(spark, sf)
    late = events.groupBy("job_id").agg(F.max("id").alias("_last"))
    jobs = late.select("job_id", F.when(F.col("_last") >= 0, "processing").alias("status"))
    # every event but the finished mappings, so that all stages are seen
    return L.progress(jobs, events.filter(F.col("event_type") != "mapping_completed"))


Y7_SQL = S.with_(AUDIT) + """SELECT job_id, CAST(CASE kind WHEN 'profile_matched' THEN 5 WHEN 'profile_not_matched' THEN 5
 WHEN 'mapping_started' THEN 8 ELSE CASE k % 4 WHEN 0 THEN floor(10 + least(k, 90) / 90.0 * 65 + 0.5) WHEN 1 THEN 82 WHEN 2 THEN 92
 ELSE 8 END END AS INT) AS percent FROM (SELECT job_id, arg_max(kind, id) AS kind, arg_max(k, id) AS k FROM au
 WHERE kind <> 'mapping_completed' GROUP BY 1)"""


def n8_payload_values(spark, sf):
    """Values read out of the JSON payload of every event."""
    rows = audit(spark, sf)
    return rows.select(
        "id",
        F.get_json_object("payload", "$.stage").alias("stage"),
        F.get_json_object("payload", "$.current").cast("int").alias("current"),
    )


N8_SQL = S.with_(AUDIT) + (
    "SELECT id, json_extract_string(payload, '$.stage') AS stage, CAST(json_extract_string(payload, '$.current') AS INT) AS current FROM au"
)


def s12_audit_rows(spark, sf):
    """Audit rows of a change of every job, appended to a table and read back."""
    path = f"{work_dir(spark)}/audit-{hashlib.sha256(sf.encode()).hexdigest()[:12]}"

    def build():
        changes = _jobs(spark, sf).select("job_id", "status", F.col("o_orderstatus").alias("order_status"))
        rows = sinks.audit_rows(changes, "status_set", "Status was set", ["status", "order_status"], "user")
        sinks.append_audit(rows, path)
        return spark.read.parquet(path)

    back = staged(spark, f"audit:{sf}", build)
    return back.select("job_id", "event_type", "summary", "payload", "actor")


S12_SQL = """SELECT o_orderkey AS job_id, 'status_set' AS event_type, 'Status was set' AS summary,
 '{"status":"' || CASE o_orderpriority WHEN '5-LOW' THEN 'failed' WHEN '4-NOT SPECIFIED' THEN 'mapping_failed' ELSE 'mapped' END
 || '","order_status":"' || o_orderstatus || '"}' AS payload, 'user' AS actor FROM orders"""


# ---- streams -------------------------------------------------------------


def st1_arrival_ingest(spark, sf):
    """Documents dropped as text files, by source, taken in as a stream: files read and their bytes."""
    base = f"{work_dir(spark)}/arrivals-{hashlib.sha256(sf.encode()).hexdigest()[:12]}"

    def build():
        drop = f"{base}/drop"
        (
            bridge.documents(spark, sf)
            .select("source", "text")
            .write.mode("overwrite")
            .option("maxRecordsPerFile", 200)
            .partitionBy("source")
            .text(drop)
        )
        query = arrivals.ingest(arrivals.arriving_files(spark, drop), f"{base}/out", f"{base}/checkpoint")
        query.awaitTermination()
        status = spark.read.parquet(f"{base}/out/status")
        sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(drop).select("path", "length")
        return status.join(sizes, "path")

    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    return (
        staged(spark, f"arrivals:{sf}", build)
        .groupBy(source.alias("source"), "status")
        .agg(F.sum("length").alias("bytes"))
    )


ST1_SQL = """SELECT source, 'extracted' AS status, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes
 FROM documents GROUP BY 1"""


def st2_latest_status(spark, sf):
    """The latest event of every job, followed as a stream over the event table."""
    base = f"{work_dir(spark)}/status-{hashlib.sha256(sf.encode()).hexdigest()[:12]}"

    def build():
        schema = bridge.table(spark, sf, "events").schema
        rows = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), "event_type", F.col("props").alias("payload")
        )
        arrivals.follow_status(rows, f"{base}/out", f"{base}/checkpoint").awaitTermination()
        return arrivals.read_status(spark, f"{base}/out")

    return staged(spark, f"status:{sf}", build)


ST2_SQL = """SELECT user_id AS job_id, max(event_id) AS id, arg_max(event_type, event_id) AS event_type,
 arg_max(props, event_id) AS payload FROM events GROUP BY 1"""

QUERIES = {
    "l1_newest_jobs": (l1_newest_jobs, L1_SQL),
    "l2_last_events": (l2_last_events, L2_SQL),
    "l3_last_progress": (l3_last_progress, L3_SQL),
    "l4_last_model": (l4_last_model, L4_SQL),
    "l5_last_messages": (l5_last_messages, L5_SQL),
    "n8_payload_values": (n8_payload_values, N8_SQL),
    "s12_audit_rows": (s12_audit_rows, S12_SQL),
    "st1_arrival_ingest": (st1_arrival_ingest, ST1_SQL),
    "st2_latest_status": (st2_latest_status, ST2_SQL),
    "y1_removable_jobs": (y1_removable_jobs, Y1_SQL),
    "y1_remaining_rows": (y1_remaining_rows, Y1_ROWS_SQL),
    "y2_retention": (y2_retention, Y2_SQL),
    "y3_backups_to_prune": (y3_backups_to_prune, Y3_SQL),
    "y4_learning_recommended": (y4_learning_recommended, Y4_SQL),
    "y7_progress": (y7_progress, Y7_SQL),
}
