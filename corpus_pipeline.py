"""From documents to tokens: toxicity, quality rules, near copies, benchmark passages, encoding.

Every stage works on what the stage before kept, all of it; all but the last
return the columns of documents. Columns beside those come through unchanged.
Rows that repeat a doc_id with an equal text count as copies: the stage on near
copies keeps one of them. An empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm import bpe, decontamination, near_dup, perplexity, toxicity
from cargolens.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below one half. The model learns from the labelled rows of docs."""
    score = toxicity.scorer(spark, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) < 0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the plain rules and lie inside their language's perplexity band."""
    return perplexity.passed(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row with the smallest doc_id of each group of near copies (five-word shingles, 80 per cent); rows without doc_id stay.

    Texts under one id are judged each for itself. Of those that are linked with one another one stays.
    """
    judged = near_dup.marked_duplicates(docs, size=5, percent=80).where("kept and doc_id is not null")
    alike = F.coalesce("linked", F.col("mark").cast("string").cast("binary"))
    kept = judged.groupBy(F.col("doc_id").alias("__doc"), alike.alias("__linked")).agg(F.min("mark").alias("__mark"))
    kept = written(kept.select("__doc", "__mark"), "kept")
    named = docs.where("doc_id is not null").withColumn("__own", F.xxhash64("text"))
    named = named.join(kept, (F.col("doc_id") == F.col("__doc")) & (F.col("__own") == F.col("__mark")), "left_semi")
    named = named.dropDuplicates(["doc_id", "__own"]).drop("__own")
    return named.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lie in benchmark passages."""
    found = decontamination.marked_contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    bad = written(found.select(F.col("doc_id").alias("__bad"), F.col("mark").alias("__mark")).distinct(), "contaminated")
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]) & (own == F.col("__mark")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row left."""
    return bpe.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("near copies", keep_one_of_each),
    ("benchmark passages", drop_contaminated),
    ("encoding", encode),
]

#: SQL cannot train the stages' models; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
