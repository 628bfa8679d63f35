"""Token counts from an exact histogram of encoded lengths.

One row for each length that occurs; running sums from either end answer totals,
quantiles and what is left after truncation for every context limit.

Defined results: a null text is empty; the end id counts; repeated rows count each; very long texts are encoded
whole; documents of one length are one row; other columns, whatever their names, are passed by; an empty table has an
empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.storage import materialize
from quadrille.llm.tokens import encoder, tokenizer_path

BLOCK = 1024  # lengths whose running sums one task makes


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs), written once; each task sends its counts, not its documents."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.concatenate([np.diff(at) + 1 for _, _, _, at in encoder(path).encode(b.column(0))] or [np.empty(0, np.int64)])
            length, n = np.unique(sizes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(n, pa.int64())], names=["n_tokens", "n_docs"])

    counted = docs.select("text").mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    return materialize(counted, "token-lengths")


def limits(histogram: DataFrame) -> DataFrame:
    """For each length L: documents and tokens up to it and above it, and tokens left if cut to L."""
    rows = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    up, down = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sums = blocks.select("block", zero(F.sum("d").over(up)).alias("d_before"), zero(F.sum("t").over(up)).alias("t_before"), zero(F.sum("d").over(down)).alias("d_after"))
    inside = Window.partitionBy("block").orderBy("n_tokens")
    to, above = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(1, Window.unboundedFollowing)
    out = rows.join(sums, "block").select(
        "n_tokens", "n_docs",
        (F.col("d_before") + F.sum("n_docs").over(to)).alias("docs_within"),
        (F.col("t_before") + F.sum("tokens").over(to)).alias("tokens_within"),
        (F.col("d_after") + zero(F.sum("n_docs").over(above))).alias("docs_over"),
    )
    return out.withColumn("tokens_truncated", F.col("tokens_within") + F.col("n_tokens") * F.col("docs_over")).withColumn("quantile", F.col("docs_within") / (F.col("docs_within") + F.col("docs_over")))


def at_limit(table: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: documents that fit, total tokens, and tokens left after truncation."""
    return table.agg(
        F.coalesce(F.max(F.when(F.col("n_tokens") <= limit, F.col("docs_within"))), F.lit(0)).alias("docs_fit"),
        F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens_truncated"),
    )


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The least length that a share ``q`` of the documents does not exceed."""
    return table.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
