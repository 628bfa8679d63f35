"""How queries are kept: a function over the given tables and, where SQL can say the same, that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.cells import to_cells, typed
from quadrille.operators.numbering import number_rows

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

LINES_SQL = f"li as (select *, row_number() over (order by {', '.join(LINE_ORDER)}) as row from lineitem)"
EVENTS_SQL = "ev as (select *, row_number() over (order by event_id) as row from events)"


def line_sheet(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    return number_rows(table(spark, sf_dir, "lineitem"), LINE_ORDER, keep=keep)


def event_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["event_id"])


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a typed sheet; one price in 97 is replaced by its priority's text."""
    mixed = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string"))
    wide = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_custkey").cast("string").alias("a"), mixed.alias("b"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("c"), "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("e"))
    return typed(to_cells(wide, ["a", "b", "c", "o_orderstatus", "e"]))


ORDER_CELLS_SQL = """oc as (
  select row, col, raw, case when raw is null or trim(raw) = '' then 'empty'
      when regexp_matches(raw, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') then case when cast(raw as double) = floor(cast(raw as double)) then 'integer' else 'number' end
      when regexp_matches(raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then 'date' else 'string' end as ctype
  from (
    select o_orderkey as row, 1 as col, cast(o_custkey as varchar) as raw from orders
    union all select o_orderkey, 2, case when o_orderkey % 97 = 0 then o_orderpriority else cast(o_totalprice as varchar) end from orders
    union all select o_orderkey, 3, strftime(o_orderdate, '%Y-%m-%d') from orders
    union all select o_orderkey, 4, o_orderstatus from orders
    union all select o_orderkey, 5, case when o_orderkey % 3 = 0 then '' else o_orderpriority end from orders))"""
