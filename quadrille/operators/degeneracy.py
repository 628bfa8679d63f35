"""Rules that hold without saying anything: by their form, and by the values that their cells have in a group's windows.

Defined results: an empty or null equation isn't rejected by its form, and one without cells is; a cell outside the windows, or without a number in
any, has no numeric value; of several cells that fail the first one in the equation is named; a null row name is a group of its own; a group
without windows has no values, so rules that name cells are rejected; no rules, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.plans import equation as E

#: The fewest values that aren't zero, and distinct ones among them, that each cell needs; what counts as zero; places of a value.
LEAST_NONZERO, LEAST_DISTINCT = 1, 1
ZERO, PLACES = 1e-12, 12
CELL = r"\$\(-?[0-9]+,-?[0-9]+\)"


def structural(equation: Column) -> Column:
    """Why an equation's form says nothing, or null."""
    text = E.normalized(equation)
    at = F.instr(text, "=")
    left, right = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))
    two = (at > 1) & (at < F.length(text))
    one = lambda x: x.rlike(f"^{CELL}$")
    rest = F.length(left) - F.length(right) - 1
    before, after = F.substring(left, F.lit(1), rest), F.substring(left, F.length(right) + 2, rest)
    lone = two & one(right)
    return (
        F.when(text == "", None)
        .when(~text.rlike(CELL), "no_operands")
        .when(two & (left == right), "identity_equation")
        .when(lone & left.endswith(F.concat(F.lit("+"), right)) & one(before), "add_forced_zero_trailing")
        .when(lone & left.startswith(F.concat(right, F.lit("+"))) & one(after), "add_forced_zero_leading")
        .when(lone & left.startswith(F.concat(right, F.lit("-"))) & one(after), "sub_minuend_eq_rhs_forces_subtrahend_zero"))


def _values(windows: DataFrame, width: int, distinct: bool) -> DataFrame:
    """(group, r, c, numeric, nonzero, different) of each place of a group's windows; ``different`` is counted where it is asked for."""
    v = F.col("v")
    cells = windows.select(F.struct("row_name").alias("group"), F.posexplode("values").alias("at", "v")).where(v.isNotNull() & ~F.isnan(v))
    live = F.when(F.abs(v) > ZERO, F.round(v, PLACES))
    if distinct:
        each = cells.groupBy("group", "at", live.alias("live")).agg(F.count("*").alias("n"))
        out = each.groupBy("group", "at").agg(F.sum("n").alias("numeric"), F.coalesce(F.sum(F.when(F.col("live").isNotNull(), F.col("n"))), F.lit(0)).alias("nonzero"), F.count("live").alias("different"))
    else:
        out = cells.groupBy("group", "at").agg(F.count("*").alias("numeric"), F.count(live).alias("nonzero"), F.least(F.count(live), F.lit(1)).alias("different"))
    return out.select("group", F.floor(F.col("at") / width).cast("int").alias("r"), (F.col("at") % width).alias("c"), "numeric", "nonzero", "different")


def rejections(rules: DataFrame, windows: DataFrame, width: int, least_nonzero: int = LEAST_NONZERO, least_distinct: int = LEAST_DISTINCT) -> DataFrame:
    """``rules`` (row_name, equation) with ``reason``, null for those that say something; ``windows`` has row_name and values, row by row."""
    group = F.struct("row_name").alias("group")
    named = rules.select(group, F.col("equation")).where("equation is not null").distinct()
    asked = named.select("group", "equation", F.posexplode(F.array_distinct(E.operands(F.col("equation")))).alias("place", "x")).select("group", "equation", "place", "x.r", "x.c")
    met = asked.join(_values(windows, width, least_distinct > 1), ["group", "r", "c"], "left")
    why = F.when(F.coalesce("numeric", F.lit(0)) == 0, "operand_no_numeric").when(F.col("nonzero") < least_nonzero, "operand_nonzero_insufficient").when(F.col("different") < least_distinct, "operand_distinct_insufficient")
    said = F.concat(why, F.format_string(":$(%d,%d)", "r", "c"))
    first = met.where(why.isNotNull()).groupBy("group", "equation").agg(F.min_by(said, "place").alias("_why"))
    keyed = rules.withColumn("_group", F.struct("row_name"))
    named_first = first.select(F.col("group").alias("_of"), F.col("equation").alias("_equation"), "_why")
    joined = keyed.join(named_first, (F.col("_group") == F.col("_of")) & (F.col("equation") == F.col("_equation")), "left")
    return joined.withColumn("reason", F.coalesce(structural(F.col("equation")), "_why")).drop("_group", "_of", "_equation", "_why")
