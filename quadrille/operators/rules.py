"""Rule books: reading, comparison, quality, degeneracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.plans import equation as E

BOOK = (
    "map<string, struct<start_loc_row_name:string, window_count:int, passed_rules:array<struct<rule:string, description:string, equation:string, equation_sides:array<string>, "
    "valid_windows:int, total_windows:int, consistency_rate:string>>>>"
)
#: Words within an equation that stand for a side nobody wrote.
PLACEHOLDERS = ("左邊", "右邊", "left", "right")


def from_book(json: DataFrame, column: str = "json", row_key: str | None = None, least: float | None = None) -> DataFrame:
    """(row_key, row_name, window_count, equation, consistency_rate) of a book's passed rules.

    Rates that are no numbers drop the rule once a least rate is asked for.
    """
    groups = json.select(F.explode(F.from_json(column, BOOK)))
    rules = groups.select(F.col("key").alias("row_key"), F.col("value.start_loc_row_name").alias("row_name"), F.col("value.window_count").alias("window_count"), F.explode("value.passed_rules").alias("r"))
    out = rules.select("row_key", "row_name", "window_count", identity(F.col("r")).alias("equation"), F.col("r.consistency_rate").try_cast("double").alias("consistency_rate"))
    if row_key is not None:
        out = out.where(F.col("row_key") == row_key)
    return out.where(F.col("consistency_rate") >= least) if least is not None else out


def identity(rule: Column) -> Column:
    """A rule's normal equation: its sides if both are there, else its equation, rule text or description."""
    side = rule["equation_sides"]
    joined = F.when(F.size(side) == 2, F.concat_ws("=", side[0], side[1]))
    return E.normalized(F.coalesce(joined, F.nullif(rule["equation"], F.lit("")), F.nullif(rule["rule"], F.lit("")), rule["description"]))


def to_book(rules: DataFrame) -> DataFrame:
    """One row with a book's JSON from (row_key, row_name, window_count, equation, valid_windows, total_windows, consistency_rate)."""
    rule = F.struct("equation", "valid_windows", "total_windows", "consistency_rate")
    groups = rules.groupBy("row_key").agg(F.struct(F.first("row_name").alias("start_loc_row_name"), F.first("window_count").alias("window_count"), F.array_sort(F.collect_list(rule)).alias("passed_rules")).alias("g"))
    return groups.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("row_key", "g"))))).alias("json"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(equation, status, n_a, n_b, sample_a, sample_b) over the normal equations of both sets."""
    def side(df: DataFrame, x: str) -> DataFrame:
        return df.groupBy(E.normalized(F.col("equation")).alias("equation_key")).agg(F.count("*").alias(f"n_{x}"), F.min("equation").alias(f"sample_{x}"))

    both = side(a, "a").join(side(b, "b"), "equation_key", "full")
    status = F.when(F.col("n_b").isNull(), "only_a").when(F.col("n_a").isNull(), "only_b").otherwise("both")
    return both.select("equation_key", status.alias("status"), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), "sample_a", "sample_b")


def quality(rules: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """(equation, issue, window_id, row, col): sides that aren't two texts, a placeholder, or a cell outside a supporting window.

    ``rules`` has equation, and where known equation_sides (array of text) and windows (array of window ids that support it);
    ``shapes`` has window_id, height and width.
    """
    for name, kind in (("equation_sides", "array<string>"), ("windows", "array<long>")):
        rules = rules if name in rules.columns else rules.withColumn(name, F.lit(None).cast(kind))
    equation, side = F.coalesce("equation", F.lit("")), F.col("equation_sides")
    two = F.coalesce((F.size(side) == 2) & F.forall(side, lambda x: x.isNotNull() & (F.trim(x) != "")), F.lit(False))
    holder = F.lit(False)
    for word in PLACEHOLDERS:
        holder = holder | F.lower(equation).contains(word)
    none = (F.lit(None).cast("long").alias("window_id"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"))
    found = rules.select("equation", F.explode(F.array_compact(F.array(F.when(~two, "equation_sides_null"), F.when(holder, "placeholder_tokens")))).alias("issue"), *none)
    if shapes is None:
        return found
    text = F.when(two, F.concat_ws("=", side[0], side[1])).otherwise(equation)
    written = rules.select("equation", text.alias("_text"), F.explode("windows").alias("window_id")).join(shapes, "window_id")
    placed = written.select("equation", "window_id", "height", "width", F.explode(F.array_distinct(E.operands(F.col("_text")))).alias("x"))
    outside = placed.where((F.col("x.r") < 0) | (F.col("x.c") < 0) | (F.col("x.r") >= F.col("height")) | (F.col("x.c") >= F.col("width")))
    return found.unionByName(outside.select("equation", F.lit("index_out_of_range").alias("issue"), "window_id", F.col("x.r").alias("row"), F.col("x.c").alias("col")))


def support(windows: DataFrame, equation: str, width: int) -> DataFrame:
    """For each cell of an equation: windows where it isn't zero, and distinct values there (to 12 places)."""
    trees = [E.parse(s) for s in E.sides(equation) or ()]
    cells = list(dict.fromkeys(c for t in trees for c in E.cells_of(t)))
    each = F.array(*(F.struct(F.lit(f"$({c.row},{c.col})").alias("cell"), F.get(F.col("values"), c.row * width + c.col).alias("v")) for c in cells))
    long = windows.select(F.explode(each).alias("x")).select("x.*")
    live = F.when(F.abs("v") > 1e-12, F.round("v", 12))
    return long.groupBy("cell").agg(F.count(live).alias("nonzero"), F.countDistinct(live).alias("distinct_nonzero"))


def most_frequent(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The most frequent text of each key; of equals the one seen first."""
    counted = df.groupBy(key, text).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.col(text), F.struct(F.col("n"), (-F.col("first")).alias("f")))
    return counted.groupBy(key).agg(best.alias(text), F.max("n").alias("n"))
