"""Sheets as long cells (sheet, row, col, raw), and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import a1
from quadrille.functions.coerce import cell_type, is_blank, window_number


def to_cells(df: DataFrame, columns: list[str], row: str = "row", sheet: str = "sheet") -> DataFrame:
    """Unpivot columns, in their order, into cells; one pass, no shuffle."""
    each = F.array(*(F.struct(F.lit(i + 1).alias("col"), F.col(c).cast("string").alias("raw")) for i, c in enumerate(columns)))
    name = F.col(sheet) if sheet in df.columns else F.lit(sheet)
    return df.select(name.alias("sheet"), F.col(row).cast("long").alias("row"), F.explode(each).alias("x")).select("sheet", "row", "x.col", "x.raw")


def typed(cells: DataFrame) -> DataFrame:
    """Add ``num`` and ``ctype``."""
    return cells.withColumn("num", window_number(F.col("raw"))).withColumn("ctype", cell_type(F.col("raw")))


def in_area(cells: DataFrame, area: str) -> DataFrame:
    """Cells of an address such as B4:L39."""
    top, left, bottom, right = a1.parse_area(area)
    return cells.where(F.col("row").between(top, bottom) & F.col("col").between(left, right))


def matrix(cells: DataFrame) -> DataFrame:
    """(sheet, row, values) of rows with any cell; values in the order of columns."""
    ordered = F.array_sort(F.collect_list(F.struct("col", "raw")))
    return cells.groupBy("sheet", "row").agg(F.transform(ordered, lambda x: x["raw"]).alias("values"))


def used_range(cells: DataFrame) -> DataFrame:
    """Bounds of the cells that are not null, and their address; A1:A1 where a sheet has none."""
    held = F.col("raw").isNotNull()
    bound = lambda f, c: F.coalesce(f(F.when(held, F.col(c))), F.lit(1)).cast("long")
    out = cells.groupBy("sheet").agg(bound(F.min, "row").alias("top"), bound(F.min, "col").alias("left"), bound(F.max, "row").alias("bottom"), bound(F.max, "col").alias("right"))
    return out.withColumn("address", a1.area(F.col("top"), F.col("left"), F.col("bottom"), F.col("right")))


def trim(cells: DataFrame) -> DataFrame:
    """Cells within the bounds of those that aren't blank, moved to begin at row 1 and column 1."""
    filled = F.when(~is_blank(F.col("raw")), True)
    bounds = cells.groupBy("sheet").agg(*(f(F.when(filled, F.col(c))).alias(f"{n}_{c}") for c in ("row", "col") for f, n in ((F.min, "min"), (F.max, "max"))))
    inside = cells.join(bounds, "sheet").where("row between min_row and max_row and col between min_col and max_col")
    return inside.select("sheet", (F.col("row") - F.col("min_row") + 1).alias("row"), (F.col("col") - F.col("min_col") + 1).alias("col"), "raw")


def prune_blank(cells: DataFrame) -> DataFrame:
    """Cells of rows and columns that hold anything; places stay as they are."""
    filled = cells.where(~is_blank(F.col("raw")))
    rows, cols = filled.select("sheet", "row").distinct(), filled.select("sheet", "col").distinct()
    return cells.join(rows, ["sheet", "row"], "left_semi").join(cols, ["sheet", "col"], "left_semi").select("sheet", "row", "col", "raw")


def header_names(values: list[str | None]) -> list[str]:
    """Names of columns from a header's texts: column_i for blanks, _2, _3 for repeats."""
    seen: dict[str, int] = {}
    out = []
    for i, x in enumerate(values, 1):
        name = (x or "").strip() or f"column_{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def records(cells: DataFrame, names: list[str], header_row: int = 1, include_empty: bool = False) -> DataFrame:
    """Rows below the header as columns of those names; rows without a value go unless asked for."""
    body = cells.where(F.col("row") > header_row)
    wide = body.groupBy("sheet", "row").agg(*(F.max(F.when(F.col("col") == i, F.col("raw"))).alias(n) for i, n in enumerate(names, 1)))
    any_value = F.coalesce(*(F.when(F.col(f"`{n}`") != "", F.lit(True)) for n in names), F.lit(False))
    return wide if include_empty else wide.where(any_value)


def drop_empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value that is neither null nor the empty text."""
    return df.where(F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns)).isNotNull())


def crop(cells: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """Cells between 1-based places among the rows and columns that exist, numbered densely; ends are clamped."""
    rows = cells.select("sheet", "row").distinct().withColumn("r", F.row_number().over(Window.partitionBy("sheet").orderBy("row")))
    cols = cells.select("sheet", "col").distinct().withColumn("c", F.row_number().over(Window.partitionBy("sheet").orderBy("col")))
    return cells.join(rows.where(F.col("r").between(top, bottom)), ["sheet", "row"]).join(cols.where(F.col("c").between(left, right)), ["sheet", "col"]).select("sheet", "row", "col", "raw")


def overwrite(cells: DataFrame, new: DataFrame) -> DataFrame:
    """The cells with those of ``new`` in place of theirs."""
    return cells.join(new, ["sheet", "row", "col"], "left_anti").unionByName(new)


def insert_lines(cells: DataFrame, axis: str, at: int, n: int) -> DataFrame:
    """Move cells from row (or col) ``at`` on by n."""
    return cells.withColumn(axis, F.when(F.col(axis) >= at, F.col(axis) + n).otherwise(F.col(axis)))


def delete_lines(cells: DataFrame, axis: str, at: int, n: int) -> DataFrame:
    """Drop n rows (or columns) from ``at`` on, and close the gap."""
    kept = cells.where(~F.col(axis).between(at, at + n - 1))
    return kept.withColumn(axis, F.when(F.col(axis) >= at + n, F.col(axis) - n).otherwise(F.col(axis)))


def append_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Put cells (sheet, row from 1, col, raw) below the last used row of their sheet."""
    last = cells.where("raw is not null").groupBy("sheet").agg(F.max("row").alias("last"))
    moved = rows.join(last, "sheet", "left").withColumn("row", F.col("row") + F.coalesce("last", F.lit(0))).drop("last")
    return cells.unionByName(moved)


def formulas(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("raw").startswith("=")).withColumn("address", a1.cell(F.col("row"), F.col("col")))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select("sheet", F.col("col").cast("long").alias("row"), F.col("row").cast("long").alias("col"), "raw")
