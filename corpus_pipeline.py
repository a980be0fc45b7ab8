"""A corpus pipeline: quality rules, toxicity, n-gram Jaccard join, personal data, packing.

Each stage takes what the one before kept, whole, and its decisions take effect: documents that quality rules or the
classifier reject go, one document of each group of near copies stays, personal data is replaced by its kind, and what is
left is packed. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave.llm import ngram_join, packing, pii, quality, toxicity
from bandweave.llm.common import aside, table, written
from bandweave.llm.queries import vocabulary

#: Up to so many failed hosts are broadcast; more are joined with salts.
FEW_HOSTS = 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail a base rule or whose source fails one as a host."""
    named, called = aside(docs, *quality.MADE)
    rows = written(quality.features(named), "features")  # a filter on what isn't written would be worked out many times over
    verdicts = written(quality.host_verdicts(rows), "hosts")
    failed = verdicts.filter("host_failed")
    if failed.count() <= FEW_HOSTS:
        kept = rows.filter("not base_failed").join(F.broadcast(failed.select(F.col("host").alias("source"))), "source", "left_anti")
    else:
        kept = quality.judged(rows, verdicts).filter("kept")
    return kept.select(*[F.col(called.get(c, c)).alias(c) for c in docs.columns])


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that a classifier, fitted on the labelled ones among them, predicts to be toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    named, called = aside(docs, "score", "predicted")
    kept = toxicity.score(named, model).filter("predicted = 0")
    return kept.select(*[F.col(called.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group that the n-gram Jaccard join links."""
    return ngram_join.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, disguised or not, by its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences: one row per piece, as of query op1_packing."""
    return packing.pack(docs, vocabulary(), derive={"ids_crc32": F.crc32("ids")})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("packing", packed),
]

#: SQL can't express the classifier, the join or the encoding; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
