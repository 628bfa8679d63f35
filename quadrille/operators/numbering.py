"""Numbering rows in a total order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.session import cut, written


def number_rows(df: DataFrame, order: list[str], name: str = "row", first: int = 1, stretches: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add consecutive numbers in the order of ``order``; null comes first, equal rows stand in any order.

    Rows are dealt by ranges of all these columns, as many as Spark shuffles or ``stretches``, sorted there and written once;
    each is numbered by its place in its range and shifted by what stands before, so only counts of ranges are ordered in one task.  With ``keep`` only these columns are left, and written as Parquet.
    """
    columns = [F.col(c) for c in order]
    dealt = df.repartitionByRange(stretches, *columns) if stretches else df.repartitionByRange(*columns)
    in_order, numbered = dealt.sortWithinPartitions(*columns), F.monotonically_increasing_id().alias("_id")
    placed = cut(in_order).select("*", numbered) if keep is None else written(in_order.select(*keep, numbered))
    at = placed.withColumn("_stretch", F.shiftright("_id", 33).cast("int")).withColumn("_within", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = at.groupBy("_stretch").agg(F.count("*").alias("_n"))
    before = sizes.select("_stretch", F.coalesce(F.sum("_n").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(before), "_stretch").withColumn(name, (F.col("_before") + F.col("_within") + first).cast("long")).drop("_id", "_stretch", "_within", "_before")
