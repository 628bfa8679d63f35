"""Profiles of columns and rows of cells, and cells that don't fit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC, DATES = ("integer", "number", "percentage"), ("datetime", "date", "time")


def _majority(axis: str, typed: DataFrame) -> DataFrame:
    counts = typed.groupBy(axis, "ctype").agg(F.count("*").alias("n"))
    held = F.when(F.col("ctype") != "empty", F.col("n"))
    of = lambda kinds: F.coalesce(F.sum(F.when(F.col("ctype").isin(*kinds), F.col("n"))), F.lit(0))
    return counts.groupBy(axis).agg(F.sum("n").alias("n_cells"), F.coalesce(F.sum(held), F.lit(0)).alias("n_filled"), of(NUMERIC).alias("n_numeric"), of(DATES).alias("n_dates"), F.max(held).alias("n_most"), F.min(F.struct((-F.coalesce(held, F.lit(-1))).alias("n"), "ctype")).alias("first"))


def column_type() -> Column:
    """number or datetime from 80 % on, else the most frequent from 65 % on (of equals the first by name), else mixed; empty if nothing is filled."""
    share = lambda c: F.col(c) / F.col("n_filled")
    return F.when(F.col("n_filled") == 0, "empty").when(share("n_numeric") >= 0.8, "number").when(share("n_dates") >= 0.8, "datetime").when(share("n_most") >= 0.65, F.col("first.ctype")).otherwise("mixed")


def column_confidence() -> Column:
    share = lambda c: F.col(c) / F.col("n_filled")
    return F.when(F.col("n_filled") == 0, 1.0).when(share("n_numeric") >= 0.8, share("n_numeric")).when(share("n_dates") >= 0.8, share("n_dates")).otherwise(share("n_most"))


def axis_profile(typed: DataFrame, axis: str = "col") -> DataFrame:
    """For each column (or row): cells, filled cells, share missing, type and its share."""
    m = _majority(axis, typed)
    return m.select(axis, "n_cells", "n_filled", (1 - F.col("n_filled") / F.col("n_cells")).alias("missing_rate"), column_type().alias("data_type"), column_confidence().alias("confidence"))


def type_counts(typed: DataFrame) -> DataFrame:
    return typed.groupBy("col", "ctype").agg(F.count("*").alias("n"))


def examples(typed: DataFrame, k: int = 3) -> DataFrame:
    """The first k filled cells of each column."""
    order = Window.partitionBy("col").orderBy("row")
    return typed.where("ctype != 'empty'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("col", "place", "row", "raw")


def anomalies(typed: DataFrame, least: float = 0.85) -> DataFrame:
    """Filled cells that are of another type than their column: any number or date column, others from a share of ``least`` on."""
    profile = axis_profile(typed).where(F.col("data_type").isin("number", "datetime") | ((F.col("confidence") >= least) & ~F.col("data_type").isin("mixed", "empty")))
    fits = (F.col("ctype") == F.col("data_type")) | ((F.col("data_type") == "number") & F.col("ctype").isin(*NUMERIC)) | ((F.col("data_type") == "datetime") & F.col("ctype").isin(*DATES))
    return typed.where("ctype != 'empty'").join(F.broadcast(profile.select("col", "data_type")), "col").where(~fits).select("row", "col", "raw", "ctype", "data_type")


def header_scores(typed: DataFrame, rows: int = 3) -> DataFrame:
    """How much each of the first rows looks like a header: text, distinct texts, filled, and numbers below."""
    top = typed.where(F.col("row") <= rows)
    filled = F.count(F.when(F.col("ctype") != "empty", 1))
    text = F.count_if(F.col("ctype") == "string")
    per = top.groupBy("row").agg(F.count("*").alias("n"), filled.alias("filled"), text.alias("text"), F.countDistinct(F.when(F.col("ctype") != "empty", F.col("raw"))).alias("different"))
    below = axis_profile(typed.where(F.col("row") > rows)).agg(F.avg(F.when(F.col("data_type").isin("mixed", "empty"), 0.0).otherwise(F.col("confidence"))).alias("steady"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    score = 0.3 * share("text", "filled") + 0.2 * share("different", "filled") + 0.2 * share("filled", "n") + 0.3 * F.coalesce("steady", F.lit(0.0))
    return per.crossJoin(F.broadcast(below)).select("row", "filled", "text", "different", score.alias("score"))


def index_scores(typed: DataFrame, cols: int = 3) -> DataFrame:
    """How much each of the first columns looks like an index: text, distinct, filled, less for numbers."""
    left = typed.where(F.col("col") <= cols)
    per = left.groupBy("col").agg(F.count("*").alias("n"), F.count(F.when(F.col("ctype") != "empty", 1)).alias("filled"), F.count_if(F.col("ctype") == "string").alias("text"), F.count_if(F.col("ctype").isin(*NUMERIC)).alias("numbers"), F.countDistinct(F.when(F.col("ctype") != "empty", F.col("raw"))).alias("different"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    score = 0.35 * share("text", "filled") + 0.35 * share("different", "filled") + 0.3 * share("filled", "n") - 0.75 * share("numbers", "filled")
    return per.select("col", "filled", "text", "numbers", "different", score.alias("score"))
