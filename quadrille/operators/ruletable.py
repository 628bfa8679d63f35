"""Rules that are rows of a table: audits by rule tables of any size, and equations between literal numbers.

Rules are packed by the row name they concern, some dozens to a row, and meet windows by a join on that name; rules for all
windows are packed in numbered blocks, and each window looks up every block.  So neither the driver nor a plan grows with
the rules.

Defined results: an equation that can't be read, or has no two sides, fails with null values; a null equation is an empty one;
rules of equal text are checked one by one; a null or empty row name concerns all windows; no rules or no windows, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.plans import equation as E
from quadrille.plans import postfix as P

PACK = 64  # rules of a row
#: What marks a side as a name of a field: CJK letters, and these words.
FIELD_WORDS = ("重", "量", "後", "前", "電鍍", "磨光", "研磨", "AC", "NPS", "銘板", "膠套")
CJK = "[一-鿿]"
FLOAT = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
WORDS = r"(?i)^[+-]?(inf|infinity|nan)$"
#: What an expression of literals may hold at all.
PLAIN = r"^[0-9.+*/()\s-]+$"
#: A whole number with zeros before it is none, unless it is zero.
PADDED = r"(^|[^0-9.])0[0-9]*[1-9][0-9]*($|[^0-9.])"


def read(rules: DataFrame) -> DataFrame:
    """(rule_id, equation, row_name, left, right): the normal equation, and both sides in postfix order (null if they can't be read)."""
    text = E.normalized(F.coalesce("equation", F.lit("")))
    at = F.instr(F.col("equation"), "=")
    side = lambda x: F.when((at > 1) & (at < F.length("equation")), P.postfix(x))
    named = rules.select("rule_id", text.alias("equation"), F.nullif("row_name", F.lit("")).alias("row_name"))
    return named.select("*", side(F.substring("equation", F.lit(1), at - 1)).alias("left"), side(F.substring("equation", at + 1, F.length("equation"))).alias("right"))


def _packed(rules: DataFrame, *by: str, n: Column) -> DataFrame:
    """Rules in lists of about PACK each, by ``by`` and a number below n / PACK."""
    blocks = F.ceil(n / PACK)
    dealt = rules.withColumn("block", F.pmod(F.xxhash64("rule_id", "equation"), F.greatest(F.lit(1), blocks)).cast("int"))
    return dealt.groupBy(*by, "block").agg(F.collect_list(F.struct("rule_id", "equation", "left", "right")).alias("rules"))


def everywhere(windows: DataFrame, rules: DataFrame) -> DataFrame:
    """Windows with each pack of the rules (rule_id, equation, left, right), as ``read`` gives them."""
    n = rules.count()
    if not n:
        return windows.withColumn("rules", F.array().cast(f"array<struct<rule_id:{rules.schema['rule_id'].dataType.simpleString()},equation:string,left:array<{P.TOKEN}>,right:array<{P.TOKEN}>>>")).where(F.lit(False))
    blocks = -(-n // PACK)
    return windows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(_packed(rules, n=F.lit(n)), "block").drop("block")


def checks(windows: DataFrame, rules: DataFrame, height: int, width: int, tolerance: float = E.TOLERANCE, strict: bool = False, only_row: str | None = None) -> DataFrame:
    """A row for each window and rule that concerns it, as ``audit.checks`` gives: (start_row, start_col, row_name, rule_id, equation, lhs, rhs, difference, ok).

    ``rules`` has rule_id, equation and row_name.  Rules without a row name concern all windows.  A window that no rule names is
    checked by all of them, unless ``strict`` or some rules concern all windows.  ``only_row`` takes that row's windows and all rules.
    """
    rules = read(rules)
    windows = windows.select("start_row", "start_col", "row_name", "values")
    if only_row is not None:
        met = everywhere(windows.where(F.col("row_name").eqNullSafe(F.lit(only_row))), rules)
    else:
        named, free = rules.where("row_name is not null"), rules.where("row_name is null")
        size = F.count("*").over(Window.partitionBy("row_name"))
        packed = _packed(named.withColumn("n", size), "row_name", "n", n=F.col("n")).drop("n", "block")
        met = windows.join(packed.hint("merge"), "row_name")  # Spark takes the packs for small, as it doesn't know that each rule becomes tokens; they would pass through the driver
        rest = everywhere(windows, free)
        if not strict and free.isEmpty():
            rest = everywhere(windows.join(named.select("row_name").distinct(), "row_name", "left_anti"), named)
        met = met.unionByName(rest)
    cell = P.in_window(F.col("values"), height, width)
    each = met.select("start_row", "start_col", "row_name", "values", F.explode("rules").alias("r"))
    checked = each.withColumn("c", P.check(F.col("r.left"), F.col("r.right"), cell, tolerance))
    return checked.select("start_row", "start_col", "row_name", "r.rule_id", "r.equation", "c.lhs", "c.rhs", "c.difference", "c.ok")


def by_rule(checked: DataFrame) -> DataFrame:
    """(rule_id, equation, checks, passed, consistency_rate) of each rule that was checked at all."""
    return checked.groupBy("rule_id", "equation").agg(F.count("*").alias("checks"), F.count_if("ok").alias("passed"), F.avg(F.col("ok").cast("int")).alias("consistency_rate"))


def validation(checked: DataFrame) -> DataFrame:
    """(start_row, start_col, total_rules, valid_rules, success_rate) of each window."""
    told = checked.groupBy("start_row", "start_col").agg(F.count("*").alias("total_rules"), F.count_if("ok").alias("valid_rules"))
    return told.withColumn("success_rate", F.col("valid_rules") / F.col("total_rules"))


def _literal(text: Column) -> Column:
    """The value of a side: a number as written, or an expression of numbers; null if it is neither."""
    number = F.regexp_replace(text, "(?<=[0-9])_(?=[0-9])", "").try_cast("double")
    word = F.when(text.rlike("(?i)nan$"), F.lit(float("nan"))).when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    made = F.when(text.rlike(PLAIN) & ~text.rlike(PADDED), P.evaluate(P.postfix(text)))
    finite = F.get(F.filter(F.array(made), lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(0))  # a list, so that it is worked out once
    return F.when(text.rlike(FLOAT), number).when(text.rlike(WORDS), word).otherwise(finite)


def literal_equations(df: DataFrame, text: str = "equation", tolerance: float = E.TOLERANCE) -> DataFrame:
    """``df`` with left_value, right_value, is_correct and status of equations between numbers, such as ``7.0 = 2.5 - 224.4``.

    status: no_sign, format (more than one equals sign), left or right (a side can't be worked out), field_names (the right side names
    fields; taken as correct), differs, ok.
    """
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "=")
    left, right = (F.trim(F.regexp_replace(F.get(parts, F.lit(i)), r"^\s+|\s+$", "")) for i in (0, 1))
    two = F.size(parts) == 2
    x, y = F.when(two, _literal(left)), F.when(two, _literal(right))
    names = right.rlike("|".join((CJK, *FIELD_WORDS)))
    read = df.withColumns({"left_value": x, "right_value": y, "status": F.when(F.size(parts) < 2, "no_sign").when(~two, "format").when(names, "field_names")})
    differs = ~F.coalesce(~F.isnan("left_value") & ~F.isnan("right_value") & (F.abs(F.col("left_value") - F.col("right_value")) < tolerance), F.lit(False))
    fields = F.col("status") == "field_names"
    status = F.when(F.col("status").isin("no_sign", "format"), F.col("status")).when(F.col("left_value").isNull(), "left").when(fields & F.col("right_value").isNull(), "field_names").when(F.col("right_value").isNull(), "right").when(differs, "differs").otherwise("ok")
    return read.withColumn("status", status).withColumn("is_correct", F.col("status").isin("ok", "field_names"))
