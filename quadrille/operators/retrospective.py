"""Rules that some window of a group names, checked on every window: the group's own, and those of all other groups.

Distinct equations meet windows once, whatever the number of groups that name them, and are counted by group; groups meet groups
only where such a count isn't zero.  So the work is equations times windows, and never groups times groups times windows.

Defined results: rules are compared as ``summaries.spaced`` writes them, and those without text are none; a null name is a group of its own; repeated
rows of ``named`` count once; an equation that can't be read holds nowhere; a group without windows has no own row; no windows or no rules, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators import ruletable
from quadrille.operators.summaries import spaced
from quadrille.plans import equation as E
from quadrille.plans import postfix as P
from quadrille.session import cut


COMPILED = 128  # distinct equations that a plan may hold


def _group(name: str = "row_name") -> Column:
    """The key of a group: a struct, so that a null name is a key like any other."""
    return F.struct(F.col(name).alias("row_name")).alias("group")


def _compiled(windows: DataFrame, equations: list[str], height: int, width: int, tolerance: float) -> DataFrame:
    """The counts of ``_met`` for equations that the driver holds: one aggregate with a count for each."""
    cell = E.in_window(F.col("values"), height, width)
    sides = {e: E.sides(e) for e in equations}
    fine = {e: E.compile_sides(*both, cell, tolerance).ok for e, both in sides.items() if both}
    if not fine:
        return windows.select(_group(), F.lit("").alias("equation"), F.lit(0).cast("long").alias("valid")).where(F.lit(False))
    counted = windows.select(_group(), "values").groupBy("group").agg(*(F.count_if(ok).alias(f"n{i}") for i, ok in enumerate(fine.values())))
    told = F.explode(F.array(*(F.struct(F.lit(e).alias("equation"), F.col(f"n{i}").alias("valid")) for i, e in enumerate(fine)))).alias("x")
    return counted.select("group", told).select("group", "x.*").where("valid > 0")


def _met(windows: DataFrame, equations: DataFrame, height: int, width: int, tolerance: float, compiled: int) -> DataFrame:
    """(group, equation, valid) counts of windows where each equation holds; none where it holds in no window."""
    few = [r["equation"] for r in equations.limit(compiled + 1).collect()]
    if len(few) <= compiled:
        return _compiled(windows, sorted(few), height, width, tolerance)
    read = ruletable.read(equations.select(F.col("equation").alias("rule_id"), "equation", F.lit(None).cast("string").alias("row_name")))
    met = ruletable.everywhere(windows.select(_group(), "values"), read.select("rule_id", "equation", "left", "right"))
    cell = P.in_window(F.col("values"), height, width)
    kept = F.filter("rules", lambda r: P.holds(r["left"], r["right"], cell, tolerance))
    fine = met.select("group", F.explode(F.transform(kept, lambda r: r["rule_id"])).alias("equation"))
    return fine.groupBy("group", "equation").agg(F.count("*").alias("valid"))


def matrix(windows: DataFrame, named: DataFrame, height: int, width: int, tolerance: float = E.TOLERANCE, compiled: int = COMPILED) -> DataFrame:
    """(rule_group, window_group, own, equation, valid_windows, invalid_windows, total_windows, consistency_rate).

    ``windows`` has row_name and values, ``named`` row_name and equation.  Pairs of two groups are there only where the rule holds in some window;
    a group's rules on its own windows are all there, be they valid nowhere.  Up to ``compiled`` distinct equations are compiled into one
    aggregate; more of them stay rows and are worked out with a stack, to the same counts.
    """
    rules = cut(named.select(_group(), spaced(F.col("equation")).alias("equation")).where("equation <> ''").distinct())
    sizes = windows.groupBy("row_name").agg(F.count("*").alias("total")).select(_group(), "total")
    counts = cut(_met(windows, rules.select("equation").distinct(), height, width, tolerance, compiled))
    own = rules.join(counts, ["group", "equation"], "left").select(F.col("group").alias("rule_group"), "group", "equation", F.coalesce("valid", F.lit(0).cast("long")).alias("valid"))
    others = rules.withColumnRenamed("group", "rule_group").join(counts, "equation").where("rule_group <> group").select("rule_group", "group", "equation", "valid")
    told = own.unionByName(others).join(sizes, "group")
    return told.select(
        F.col("rule_group.row_name").alias("rule_group"), F.col("group.row_name").alias("window_group"), F.col("rule_group").eqNullSafe(F.col("group")).alias("own"),
        "equation", F.col("valid").alias("valid_windows"), (F.col("total") - F.col("valid")).alias("invalid_windows"), F.col("total").alias("total_windows"), (F.col("valid") / F.col("total")).alias("consistency_rate"))


def by_group(found: DataFrame) -> DataFrame:
    """(row_name, window_count, total_rules, mean_rate, carried): of each group its rules, their mean rate on its windows, and how many hold in some other group."""
    mine = found.where("own").select(_group("rule_group"), "equation", "total_windows", "consistency_rate")
    far = found.where("not own").select(_group("rule_group"), "equation").distinct().withColumn("far", F.lit(True))
    both = mine.join(far, ["group", "equation"], "left")
    out = both.groupBy("group").agg(F.max("total_windows").alias("window_count"), F.count("*").alias("total_rules"), F.avg("consistency_rate").alias("mean_rate"), F.count("far").alias("carried"))
    return out.select("group.row_name", "window_count", "total_rules", "mean_rate", "carried")
