"""A training-data pipeline of five of the operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; what it
returns is written as Parquet and read again.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import decontamination, language, packing, secret_scan, similarity
from quadrille.llm.spans import redacted
from quadrille.llm.storage import fresh, materialize, read_table


BATCH = 8 << 20  # bytes of an Arrow batch, about; a task holds a batch several times, in the JVM and in Python

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_batches(stage: Stage) -> Stage:
    """The stage with Arrow batches of bounded size; the bound stays set, as what is returned runs later."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return bounded


@in_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter, no text, or a cosine below the floor of the closest language."""
    prototypes = language.learn(language.fold(docs.select("doc_id", "text", "lang")).where("not held_out"))
    return language.accepted(docs, prototypes)


@in_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least doc_id stays."""
    return similarity.one_of_each(docs)


@in_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontamination.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    k = fresh(docs, "_k")
    hit = found.where("contaminated").select(F.col("k").alias(k)).distinct()
    return docs.withColumn(k, F.xxhash64("doc_id", "text")).join(hit, k, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


@in_batches
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; all documents stay."""
    return redacted(docs, secret_scan.finder(secret_scan.learn(docs)))


@in_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(packing.tokenized_pieces(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Trained models and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
