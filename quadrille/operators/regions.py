"""Table regions: connected groups of filled cells.

Cells are gathered in runs by window functions on (sheet, row) and (sheet, col), and runs that share a cell are linked; components
of those links are found by stars, in few rounds however a region winds.  A sheet is never held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.coerce import is_blank
from quadrille.operators.components import connected
from quadrille.session import cut


def filled_mask(cells: DataFrame) -> DataFrame:
    return cells.where(~is_blank(F.col("raw"))).select("sheet", "row", "col")


def bridge_gaps(mask: DataFrame, gap: int = 1) -> DataFrame:
    """The mask with blank runs of up to ``gap`` between filled cells of a row, or of a column, filled; both read the mask as it was."""
    def along(axis: str, other: str) -> DataFrame:
        w = Window.partitionBy("sheet", other).orderBy(axis)
        near = mask.withColumn("before", F.lag(axis).over(w)).where((F.col(axis) - F.col("before") > 1) & (F.col(axis) - F.col("before") - 1 <= gap))
        return near.withColumn(axis, F.explode(F.sequence(F.col("before") + 1, F.col(axis) - 1))).select("sheet", "row", "col")

    return mask.unionByName(along("col", "row")).unionByName(along("row", "col")).distinct()


def _first_of_run(mask: DataFrame, axis: str, other: str, name: str) -> DataFrame:
    """Give each cell the place where its unbroken run along an axis begins."""
    keyed = mask.withColumn("_run", F.col(axis) - F.row_number().over(Window.partitionBy("sheet", other).orderBy(axis)))
    start = F.min(axis).over(Window.partitionBy("sheet", other, "_run"))
    place = {axis: start, other: F.col(other)}
    return keyed.withColumn(name, F.struct("sheet", place["row"].alias("row"), place["col"].alias("col"))).drop("_run")


def components(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """(sheet, row, col, label): the label is the least place, in reading order, of the component.

    Runs of rows are linked with the runs of columns that cross them, and with runs of rows at a corner where corners touch.  A run
    goes by its first cell, which all runs that begin there share and belong to.
    """
    runs = cut(_first_of_run(_first_of_run(mask, "col", "row", "across"), "row", "col", "down"))
    links = runs.select(F.col("across").alias("a"), F.col("down").alias("b")).distinct()
    if diagonal:
        steps = F.explode(F.array(F.lit(-1), F.lit(1))).alias("s")
        corner = runs.select("sheet", F.col("across").alias("a"), "row", "col", steps).select("sheet", "a", (F.col("row") + 1).alias("row"), (F.col("col") + F.col("s")).alias("col"))
        links = links.unionByName(corner.join(runs.select("sheet", "row", "col", F.col("across").alias("b")), ["sheet", "row", "col"]).select("a", "b").distinct())
    found = connected(links).select(F.col("id").alias("across"), F.struct("component.row", "component.col").alias("label"))
    return runs.join(found, "across").select("sheet", "row", "col", "label")


def tables(cells: DataFrame, gap: int = 1, least: int = 4, density: float = 0.12, diagonal: bool = False) -> DataFrame:
    """(sheet, table_id, top, left, bottom, right, non_empty, density, confidence) of regions that are large and dense enough.

    Filled cells are counted before gaps are bridged; ids follow the reading order of the first cell.
    """
    mask = filled_mask(cells)
    labelled = components(bridge_gaps(mask, gap) if gap else mask, diagonal)
    boxes = labelled.groupBy("sheet", "label").agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"))
    counts = labelled.join(mask, ["sheet", "row", "col"], "left_semi").groupBy("sheet", "label").agg(F.count("*").alias("non_empty"))
    size = (F.col("bottom") - F.col("top") + 1) * (F.col("right") - F.col("left") + 1)
    out = boxes.join(counts, ["sheet", "label"]).withColumn("density", F.col("non_empty") / size).where((F.col("non_empty") >= least) & (F.col("density") >= density))
    out = out.withColumn("confidence", F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.least(F.lit(1.0), F.col("density") * 2) * F.least(F.lit(1.0), F.col("non_empty") / 20))))
    out = out.withColumn("table_id", F.row_number().over(Window.partitionBy("sheet").orderBy("label")))
    return out.select("sheet", "table_id", "top", "left", "bottom", "right", "non_empty", "density", "confidence")


def numeric_regions(typed: DataFrame, height: int = 3, width: int = 3) -> DataFrame:
    """Regions of numeric cells, corners touching, of at least that size."""
    mask = typed.where("num is not null").select("sheet", "row", "col")
    boxes = components(mask, diagonal=True).groupBy("sheet", "label").agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"), F.count("*").alias("non_empty"))
    kept = boxes.where((F.col("bottom") - F.col("top") + 1 >= height) & (F.col("right") - F.col("left") + 1 >= width))
    return kept.withColumn("table_id", F.row_number().over(Window.partitionBy("sheet").orderBy("label"))).drop("label")


def within(points: DataFrame, boxes: DataFrame, cell: int = 256) -> DataFrame:
    """Points (sheet, row, col, ...) joined with the boxes (sheet, table_id, top, left, bottom, right) that hold them.

    An equi-join on grid squares that boxes cover, then the exact test.
    """
    squares = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
    spread = boxes.withColumn("gr", F.explode(squares("top", "bottom"))).withColumn("gc", F.explode(squares("left", "right")))
    keyed = points.withColumn("gr", F.floor(F.col("row") / cell)).withColumn("gc", F.floor(F.col("col") / cell))
    return keyed.join(spread, ["sheet", "gr", "gc"]).where("row between top and bottom and col between left and right").drop("gr", "gc")


def outside(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points that no box holds."""
    held = within(points.select("sheet", "row", "col").distinct(), boxes).select("sheet", "row", "col").distinct()
    return points.join(held, ["sheet", "row", "col"], "left_anti")
