"""Grouped aggregate whose other columns come from the earliest row of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headers that name a time, in order of preference.
TIME_HEADERS = ("Cdate", "檢驗日")
TIME_WORDS = ("time", "date", "日期", "時間", "日")


def time_columns(names: list[str]) -> list[str]:
    """Columns whose header names a time: the preferred ones, else all that hold a time's word."""
    first = [n for n in TIME_HEADERS if n in names]
    return first or [n for n in names if any(w in n.lower() for w in TIME_WORDS)]


def group_aggregate(df: DataFrame, keys: list[str], value: str, times: list[Column], order: str, keep: list[str]) -> DataFrame:
    """Mean and sample deviation of ``value``, row count, and the earliest row's ``keep`` columns.

    The earliest row has the least of its parseable times; rows without one come last, ties go by ``order``.
    One partial and one final aggregate: no group is gathered.
    """
    moment = F.least(*times) if len(times) > 1 else times[0] if times else F.lit(None).cast("timestamp")
    number = F.col(value).cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    place = F.struct(moment.isNull().alias("no"), moment.alias("t"), F.col(order).alias("o"))
    out = df.groupBy(*keys).agg(
        F.avg(number).alias(f"{value}_mean"), F.stddev_samp(number).alias(f"{value}_std"), F.count(F.lit(1)).alias("row_count"),
        F.min_by(F.struct(*keep), place).alias("_first"), F.min(order).alias("_seen"))
    return out.select(*keys, f"{value}_mean", f"{value}_std", "row_count", *(F.col(f"_first.{k}").alias(k) for k in keep), F.col("_seen").alias("first_seen"))
