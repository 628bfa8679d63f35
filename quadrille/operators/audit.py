"""Rules checked on windows: checks, metrics, failed windows, suspect cells.

All rules are compiled into one projection of the windows; no rule meets a window
by a join, and no Python runs on rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import a1
from quadrille.operators.windows import BLOCK
from quadrille.plans import equation as E


@dataclass(frozen=True)
class Rule:
    equation: str
    row_name: str | None = None

    @property
    def key(self) -> str:
        return E.normalize(self.equation)


BITS = 63  # of a number that tells rules, or cells, apart
NAMED = "array<struct<r:int,c:int,bit:bigint>>"


def _cells(equation: str) -> list[tuple[int, int]]:
    """All cells of a known equation, repeats kept."""
    return [(int(r), int(c)) for r, c in re.findall(r"\$\((-?[0-9]+),(-?[0-9]+)\)", E.normalize(equation))]


def reach(rules: list[Rule]) -> tuple[int, int] | None:
    """How many rows above and below a cell the windows start that name it: ``around`` of ``windows.scan``; null beyond a block."""
    rows = [r for x in rules for r, _ in _cells(x.equation)]
    before, after = max([0, *rows]), max([0, *(-r for r in rows)])
    return (before, after) if before + after <= BLOCK else None


def _named(rules: list[Rule]) -> list[list[Column]]:
    """For each rule the literals cells and, unless there are more rules or places of cells than bits, rule_bit."""
    keys, places = ({x: i for i, x in enumerate(dict.fromkeys(xs))} for xs in ([r.key for r in rules], [c for r in rules for c in _cells(r.equation)]))
    few = max(len(keys), len(places)) <= BITS
    bit = lambda i: F.lit(1 << i if few else None).cast("bigint")
    cell = lambda c: F.struct(F.lit(c[0]).alias("r"), F.lit(c[1]).alias("c"), bit(places[c]).alias("bit"))
    return [[F.array(*map(cell, _cells(r.equation))).cast(NAMED).alias("cells"), *([bit(keys[r.key]).alias("rule_bit")] if few else [])] for r in rules]


def checks(windows: DataFrame, rules: list[Rule], height: int, width: int, tolerance: float = E.TOLERANCE, strict: bool = False, only_row: str | None = None, named: bool = False) -> DataFrame:
    """A row for each window and rule that concerns it: left and right sides, difference, ok; if ``named`` also the cells that it names,
    with bits that tell cells and equations apart.  A column block of the windows is kept.

    Rules without a row name concern all windows.  A window that no rule names is checked by
    all of them, unless ``strict``.  ``only_row`` takes that row's windows and all rules.
    """
    if only_row is not None:
        windows = windows.where(F.col("row_name").eqNullSafe(F.lit(only_row)))
    cell = E.in_window(F.col("values"), height, width)
    names = sorted({r.row_name for r in rules if r.row_name})
    everywhere = any(not r.row_name for r in rules)
    orphan = F.lit(False) if strict or everywhere else ~F.coalesce(F.col("row_name").isin(names), F.lit(False)) if names else F.lit(True)
    made, more = [], _named(rules) if named else [[]] * len(rules)
    place = ["start_row", "start_col", "row_name", *(c for c in windows.columns if c == "block")]
    for i, r in enumerate(rules):
        both = E.sides(r.equation)
        c = E.compile_sides(*both, cell, tolerance) if both else E.compile_sides("", "", cell)
        wanted = F.lit(True) if only_row is not None or not r.row_name else (F.coalesce(F.col("row_name") == r.row_name, F.lit(False)) | orphan)
        made.append(F.when(wanted, F.struct(F.lit(i).alias("rule_id"), F.lit(r.key).alias("equation"), c.left.alias("lhs"), c.right.alias("rhs"), c.difference.alias("difference"), c.ok.alias("ok"), *more[i])))
    if not made:
        return windows.select(*place, F.explode(F.array().cast("array<struct<rule_id:int,equation:string,lhs:double,rhs:double,difference:double,ok:boolean" + (f",cells:{NAMED},rule_bit:bigint" if named else "") + ">>")).alias("x")).select(*place, "x.*")
    each = windows.select(*place, F.explode(F.array_compact(F.array(*made))).alias("x"))
    return each.select(*place, "x.*")


def metrics(checked: DataFrame) -> DataFrame:
    """One row: checks, windows that were checked, windows with a failure, passed, failed, pass rate (0 when empty)."""
    per = checked.groupBy("start_row", "start_col").agg(F.count("*").alias("n"), F.count_if("ok").alias("p"))
    n, p = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("p"), F.lit(0))
    return per.agg(n.alias("total_checks"), F.count("*").alias("matched_windows"), F.count_if(F.col("p") < F.col("n")).alias("failed_windows"), p.alias("passed"), (n - p).alias("failed"), F.coalesce(F.try_divide(p, n), F.lit(0.0)).alias("pass_rate"))


def row_statistics(checked: DataFrame) -> DataFrame:
    """For each row name (null: unknown): windows, checks, passed, failed, pass rate."""
    per = checked.groupBy(F.coalesce(F.nullif("row_name", F.lit("")), F.lit("unknown")).alias("row_name"), "start_row", "start_col").agg(F.count("*").alias("n"), F.count_if("ok").alias("p"))
    out = per.groupBy("row_name").agg(F.count("*").alias("windows"), F.sum("n").alias("checks"), F.sum("p").alias("passed"), (F.sum("n") - F.sum("p")).alias("failed"))
    return out.withColumn("pass_rate", F.col("passed") / F.col("checks"))


def failed_windows(checked: DataFrame) -> DataFrame:
    """Windows with a failure, and how many rules failed there."""
    return checked.where("not ok").groupBy("start_row", "start_col", "row_name").agg(F.count("*").alias("failed_rules"), F.array_sort(F.collect_set("equation")).alias("equations"))


def suspect_cells(checked: DataFrame, top: int = 1, left: int = 1, top_k: int = 0, width: int | None = None, block: int = BLOCK) -> DataFrame:
    """Cells of failed rules: how often named (repeats count), in how many windows and by how many rules.

    ``top`` and ``left`` place the sheet's first value; with ``width`` cells outside a window are left out; ``top_k``
    of 0 or less returns all.  Where windows came with their blocks (of ``block`` rows, with those around that reach them), each block
    counts its own cells and nothing is shuffled.  Windows of a cell are told apart by its place in them, equations by their bits.
    """
    cells = F.col("cells") if "cells" in checked.columns else E.operands(F.col("equation"))
    failed = checked.where("not ok").withColumn("cell", F.explode(cells))
    if width is not None:
        failed = failed.where(F.col("cell.c") < width)
    by = ["block"] if "block" in checked.columns else []
    if by:
        failed = failed.where(F.floor((F.col("start_row") + F.col("cell.r")) / block) == F.col("block"))
    at = [(F.col("start_row") + F.col("cell.r") + top).alias("row"), (F.col("start_col") + F.col("cell.c") + left).cast("long").alias("col")]
    if "rule_bit" in checked.columns:
        placed = failed.select(*by, *at, F.col("cell.bit").alias("bit"), "rule_bit")
        out = placed.groupBy(*by, "row", "col").agg(F.count("*").alias("occurrences"), F.bit_count(F.bit_or("bit")).cast("long").alias("windows"), F.bit_count(F.bit_or("rule_bit")).cast("long").alias("rules")).drop(*by)
    else:
        per = failed.select(*by, *at, "start_row", "start_col", "equation").groupBy(*by, "row", "col", "start_row", "start_col", "equation").agg(F.count("*").alias("n"))
        out = per.groupBy(*by, "row", "col").agg(F.sum("n").alias("occurrences"), F.countDistinct("start_row", "start_col").alias("windows"), F.countDistinct("equation").alias("rules")).drop(*by)
    out = out.withColumn("address", a1.cell(F.col("row"), F.col("col")))
    return out.orderBy(F.desc("occurrences"), F.desc("windows"), "row", "col").limit(top_k) if top_k > 0 else out


def consistency(checked: DataFrame) -> DataFrame:
    """For each row name and equation: windows where it holds, windows, and the share."""
    return checked.groupBy("row_name", "equation").agg(F.count_if("ok").alias("valid_windows"), F.count("*").alias("total_windows"), F.avg(F.col("ok").cast("int")).alias("consistency_rate"))
