"""Rule discovery: propose equations, check them on every window of a group.

The proposer is replaceable; the one here lists templates over the cells of a window.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.audit import Rule, checks, consistency
from quadrille.operators.windows import sample_per_group
from quadrille.plans import equation as E

LEAST = 0.8
AGGREGATES = 100


def templates(height: int, width: int) -> list[str]:
    """x = y, x + y = z, x - y = z, x * y = z, x / y = z over distinct cells, sums and products once."""
    cells = [f"$({r},{c})" for r in range(height) for c in range(width)]
    out = [f"{a}={b}" for a, b in combinations(cells, 2)]
    for z in cells:
        rest = [c for c in cells if c != z]
        out += [f"{a}{sign}{b}={z}" for a, b in combinations(rest, 2) for sign in "+*"]
        out += [f"{a}{sign}{b}={z}" for a, b in permutations(rest, 2) for sign in "-/"]
    return [e for e in out if E.degenerate(e) is None]


def discover(windows: DataFrame, height: int, width: int, propose=templates, least: float = LEAST, sampled: int | None = None, seed: int = 0) -> DataFrame:
    """(row_name, equation, valid_windows, total_windows, consistency_rate) of rules that hold in most windows of their group.

    All candidates are checked on all windows.  ``sampled``, for proposers whose candidates come from some windows anyway, keeps those
    that hold in one of so many windows of a group.
    """
    proposed = [Rule(e) for e in propose(height, width)]
    if sampled is not None:
        some = checks(sample_per_group(windows, "row_name", sampled, seed), proposed, height, width)
        proposed = [Rule(r["equation"]) for r in some.where("ok").select("equation").distinct().orderBy("equation").collect()]  # at most the proposed
    return measured(windows, proposed, height, width).where(F.col("consistency_rate") >= least)


def measured(windows: DataFrame, rules: list[Rule], height: int, width: int) -> DataFrame:
    """What ``consistency`` says of rules for all windows, as conditional counts of one aggregate for each ``AGGREGATES`` rules."""
    cell, out = E.in_window(F.col("values"), height, width), None
    for k in range(0, max(len(rules), 1), AGGREGATES):
        some = list(dict.fromkeys(r.key for r in rules))[k : k + AGGREGATES]
        counts = [F.count_if(E.compile_sides(*(E.sides(e) or ("", "")), cell).ok).alias(f"v{i}") for i, e in enumerate(some)]
        one = windows.groupBy("row_name").agg(F.count("*").alias("total_windows"), *counts)
        told = F.explode(F.array(*(F.struct(F.lit(e).alias("equation"), F.col(f"v{i}").alias("valid_windows")) for i, e in enumerate(some))).cast("array<struct<equation:string,valid_windows:bigint>>"))
        part = one.select("row_name", "total_windows", told.alias("x")).select("row_name", "x.equation", "x.valid_windows", "total_windows", (F.col("x.valid_windows") / F.col("total_windows")).alias("consistency_rate"))
        out = part if out is None else out.unionByName(part)
    return out


def retrospective(windows: DataFrame, rules: list[Rule], height: int, width: int, least: float = LEAST) -> DataFrame:
    """Share of each group's windows in which each rule holds, from ``least`` on."""
    return consistency(checks(windows, rules, height, width)).where(F.col("consistency_rate") >= least)


def not_analysed(windows: DataFrame, done: DataFrame) -> DataFrame:
    """Windows whose place isn't among those done."""
    return windows.join(done.select("start_row", "start_col"), ["start_row", "start_col"], "left_anti")
