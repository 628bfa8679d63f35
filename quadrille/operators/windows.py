"""Two-dimensional windows over numeric sheets.

A sheet here is wide: (row, and numeric columns in order), rows numbered from 1.  Windows are
cut within blocks of rows that overlap by a window's height, so a long sheet needs no task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def scan(df: DataFrame, columns: list[str], height: int, width: int, step_rows: int = 1, step_cols: int = 1, row: str = "row", name: str | None = None, block: int = BLOCK, around: tuple[int, int] | None = None) -> DataFrame:
    """(start_row, start_col, row_name, values, filled, numbers): all windows in range, values row by row, places 0-based.

    With ``around`` each block of rows also has the windows that start so many rows before and after it, and a column block tells
    them apart: what concerns a block's own rows is then found without a shuffle.
    A width of -1 takes all columns; sizes beyond the sheet's are cut to it (height by whoever knows it).
    """
    width = len(columns) if width == -1 else min(width, len(columns))
    cells = F.array(*(F.col(c).cast("double") for c in columns))
    at = F.col(row) - 1
    base = df.select(at.alias("r"), cells.alias("v"), (F.col(name).cast("string") if name else F.lit(None).cast("string")).alias("row_name"))
    before, after = around or (0, 0)
    homes = F.sequence(F.floor((F.col("r") - (height - 1) - after) / block), F.floor((F.col("r") + before) / block))
    spread = base.withColumn("b", F.explode(homes))
    order = Window.partitionBy("b").orderBy("r")
    rows = spread.withColumn("rows", F.collect_list("v").over(order.rowsBetween(0, height - 1)))
    own = (F.col("r") >= F.col("b") * block - before) & (F.col("r") < (F.col("b") + 1) * block + after)
    whole = rows.where(own & (F.size("rows") == height) & (F.col("r") % step_rows == 0))
    starts = F.array(*(F.lit(c) for c in range(0, len(columns) - width + 1, step_cols)))
    each = whole.withColumn("c", F.explode(starts))
    values = F.flatten(F.transform("rows", lambda x: F.slice(x, F.col("c") + 1, width)))
    out = each.select(F.col("r").cast("long").alias("start_row"), F.col("c").cast("int").alias("start_col"), "row_name", values.alias("values"), *([F.col("b").alias("block")] if around else []))
    filled = F.size(F.filter("values", lambda x: x.isNotNull()))
    return out.withColumn("filled", filled.cast("long"))


def valid(windows: DataFrame, height: int, width: int) -> DataFrame:
    """Windows at least half filled."""
    return windows.where(F.col("filled") * 2 >= height * width)


def has_numbers(windows: DataFrame, least: int = 2) -> DataFrame:
    return windows.where(F.col("filled") >= least)


def axis_windows(df: DataFrame, columns: list[str], size: int, row: str = "row") -> DataFrame:
    """(row, start_col, values, ok) of each run of ``size`` columns of a row; ok where all are numbers."""
    starts = F.array(*(F.lit(c) for c in range(len(columns) - size + 1)))
    v = F.array(*(F.col(c).cast("double") for c in columns))
    out = df.select(F.col(row).alias("row"), v.alias("v"), F.explode(starts).alias("start_col"))
    part = F.slice("v", F.col("start_col") + 1, size)
    return out.select("row", "start_col", part.alias("values"), (F.size(F.filter(part, lambda x: x.isNull())) == 0).alias("ok"))


def tiles(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Tumbling tiles of numeric cells (row, col from 1, num): counts and sums, ragged edges kept."""
    place = [F.floor((F.col("row") - 1) / height).alias("tile_row"), F.floor((F.col("col") - 1) / width).alias("tile_col")]
    return cells.groupBy(*place).agg(F.count("*").alias("n_cells"), F.count("num").alias("n_numbers"), F.sum("num").alias("total"))


def axis_statistics(cells: DataFrame, axis: str) -> DataFrame:
    """Least, greatest, range and mean of the numbers of each row, or column."""
    return cells.where("num is not null").groupBy(axis).agg(F.min("num").alias("low"), F.max("num").alias("high"), (F.max("num") - F.min("num")).alias("spread"), F.avg("num").alias("mean"), F.count("*").alias("n"))


def transpose_equation(text):
    """Swap rows and columns of all cells in an equation."""
    return F.regexp_replace(text, r"\$\((-?[0-9]+),(-?[0-9]+)\)", r"\$($2,$1)")


def sample_per_group(windows: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """At most k windows of each group, by a seeded hash of their place."""
    order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), "start_row", "start_col"), "start_row", "start_col")
    return windows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
