"""Source evidence: chunks that belong to a locator, text for locators, excerpts for a case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.text import folded
from cargolens.functions.values import strip
from cargolens.operators.chunking import assemble
from cargolens.operators.containment import extending, graded

# Limits of the answers.
MAX_EVIDENCE = 20
MAX_EXCERPTS = 8
EXCERPT_CHARS = 3500
FALLBACK_EXCERPTS = 3


CHUNK_KEY = ["job_id", "document_id", "position"]


def _first(rows: DataFrame, per: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each group; Spark cuts to them before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def find_evidence(chunks: DataFrame, requests: DataFrame, limit: int = 5) -> DataFrame:
    """Chunks for each request (request_id, job_id, locator): equal, then extending, then containing locators.

    Distinct locators of a job are matched through their prefixes and grams.
    Equal requests are answered once; of each locator only the first chunks can
    be in an answer, and texts are fetched for the answers alone. Chunks are
    told apart by job, document and position. Requests without a locator have
    no answer.
    """
    keep = min(max(1, limit), MAX_EVIDENCE)
    asked = requests.select("request_id", "job_id", folded(strip(F.col("locator"))).alias("right"))
    asked = asked.filter(F.coalesce("right", F.lit("")) != "")
    named = chunks.select(*CHUNK_KEY, folded(strip(F.coalesce(F.col("locator"), F.lit("")))).alias("left"))
    pairs = graded(named, asked, ["job_id"])
    heads = _first(named, ["job_id", "left"], ["position", "document_id"], keep).drop("place")
    best = pairs.join(heads, ["job_id", "left"]).withColumnRenamed("tier", "rank")
    best = _first(best, ["job_id", "right"], ["rank", "position", "document_id"], keep).drop("left")
    return asked.join(best, ["job_id", "right"]).drop("right").join(chunks, CHUNK_KEY)


def chunks_for_locators(chunks: DataFrame, locators: DataFrame) -> DataFrame:
    """Chunks whose locator equals or extends one of the job's locators, or is extended by one; each once."""
    named = chunks.withColumn("_left", F.coalesce(F.col("locator"), F.lit("")))
    found = extending(named.select("job_id", F.col("_left").alias("left")), locators.select("job_id", F.col("locator").alias("right")), ["job_id"])
    found = found.select("job_id", F.col("left").alias("_left")).distinct()
    return named.join(found, ["job_id", "_left"], "left_semi").select(*chunks.columns)


def text_for_locators(chunks: DataFrame, locators: DataFrame) -> DataFrame:
    """Assembled text of the matched chunks; jobs without a match have no row."""
    return assemble(chunks_for_locators(chunks, locators), "job_id", ["position", "document_id"])


def jobs_without_text(chunks: DataFrame, locators: DataFrame) -> DataFrame:
    found = chunks_for_locators(chunks, locators).select("job_id").distinct()
    return (
        locators.select("job_id")
        .distinct()
        .join(found, "job_id", "left_anti")
        .withColumn("reason", F.lit("no stored text for these locators"))
    )


def excerpts(chunks: DataFrame, locators: DataFrame) -> DataFrame:
    """At most eight cut chunks per job: by locator, equal before extending before containing.

    Jobs without a hit show their first three chunks. Texts are fetched for the
    chunks that are shown.
    """
    named = chunks.select(*CHUNK_KEY, F.coalesce(F.col("locator"), F.lit("")).alias("left"))
    pairs = graded(named, locators.select("job_id", F.col("locator").alias("right")), ["job_id"], folded)
    best = pairs.groupBy("job_id", "left").agg(F.min(F.struct("right", "tier")).alias("_at"))
    hits = named.distinct().join(best, ["job_id", "left"])
    shown = _first(hits, ["job_id"], ["_at", "document_id", "position"], MAX_EXCERPTS).select(*CHUNK_KEY, "place")
    others = named.distinct().join(best.select("job_id").distinct(), "job_id", "left_anti")
    shown = shown.unionByName(_first(others, ["job_id"], ["document_id", "position"], FALLBACK_EXCERPTS).select(*CHUNK_KEY, "place"))
    return (
        chunks.select(*CHUNK_KEY, "locator", F.left("text", F.lit(EXCERPT_CHARS)).alias("text"))
        .join(shown, CHUNK_KEY)
        .dropDuplicates([*CHUNK_KEY, "place"])
    )
