"""What discovery says of its rules: groups, occurrences, verdicts kept and renewed, windows left out, anomalies.

Verdicts are rows (row_name, start_row, start_col, equation, ok), as ``audit.checks`` gives them or as they were stored.
Null row names are a group of their own, equations without text count for nothing, and an empty table gives an
empty result (``overall`` one row of zeros).  Repeated rows count as often as they stand, but where a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators import degeneracy
from quadrille.operators.relations import Relation
from quadrille.plans import equation as E

LEAST = 0.8
WINDOW = ["start_row", "start_col"]
#: The fewest occurrences of a rule that a group agrees on.
FEWEST = 2


def spaced(text: Column) -> Column:
    """Whitespace runs as one blank, none at the ends; rules are compared in this form where no normal form is asked for."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _written(found: DataFrame) -> DataFrame:
    return found.withColumn("equation", spaced(F.col("equation"))).where("equation != ''")


def group_summary(rates: DataFrame, least: float = LEAST) -> DataFrame:
    """(row_name, window_count, rules_found, rules_passed, passed_rate, is_valid) of (row_name, equation, total_windows, consistency_rate).

    Rules whose form says nothing don't pass, nor those with a ``reason``, if ``degeneracy.rejections`` has given them that column.
    """
    passed = (F.col("consistency_rate") >= least) & degeneracy.structural(F.col("equation")).isNull()
    if "reason" in rates.columns:
        passed = passed & F.col("reason").isNull()
    out = rates.groupBy("row_name").agg(F.max("total_windows").alias("window_count"), F.count("*").alias("rules_found"), F.count_if(passed).alias("rules_passed"))
    return out.select("*", (F.col("rules_passed") / F.col("rules_found")).alias("passed_rate"), (F.col("rules_passed") > 0).alias("is_valid"))


def overall(groups: DataFrame) -> DataFrame:
    """One row (groups, valid_groups, success_rate) of a group summary."""
    return groups.agg(F.count("*").alias("groups"), F.count_if("is_valid").alias("valid_groups"), F.coalesce(F.avg(F.col("is_valid").cast("int")), F.lit(0.0)).alias("success_rate"))


def rule_statistics(found: DataFrame, least: float = LEAST, windows: DataFrame | None = None) -> DataFrame:
    """(equation, validations, valid_count, valid_ratio, consistency_rate, passes): rules of all windows.

    The rate is the mean, over groups of two windows or more, of the share of windows that name the rule; ``found`` has a
    row for each window and rule it names.  ``windows`` (row_name, start_row, start_col) are all that were looked at, also those that name
    no rule; without it those of ``found`` are.  Sorted by the ratio, greatest first, ties by equation.
    """
    written = _written(found)
    windows = (found if windows is None else windows).groupBy("row_name").agg(F.countDistinct(*WINDOW).alias("windows")).where(F.col("windows") >= 2)
    named = written.groupBy("row_name", "equation").agg(F.count("*").alias("n"), F.count_if("ok").alias("p"), F.countDistinct(*WINDOW).alias("in_windows"))
    joined = named.join(windows.withColumnRenamed("row_name", "_name"), F.col("row_name").eqNullSafe(F.col("_name")), "left")
    sums = joined.groupBy("equation").agg(F.sum("n").alias("validations"), F.sum("p").alias("valid_count"), F.sum(F.try_divide("in_windows", "windows")).alias("shares"))
    groups = windows.agg(F.count("*").alias("groups"))
    rate = F.coalesce(F.try_divide("shares", "groups"), F.lit(0.0))
    out = sums.crossJoin(F.broadcast(groups)).select("equation", "validations", "valid_count", (F.col("valid_count") / F.col("validations")).alias("valid_ratio"), rate.alias("consistency_rate"))
    return out.withColumn("passes", F.col("consistency_rate") >= least).orderBy(F.desc("valid_ratio"), "equation")


def totals(statistics: DataFrame) -> DataFrame:
    """One row of a rule statistic: rules found and passed, validations, and their shares."""
    n, p = F.count("*"), F.count_if("passes")
    all_, valid, kept = (F.coalesce(x, F.lit(0)) for x in (F.sum("validations"), F.sum("valid_count"), F.sum(F.when(F.col("passes"), F.col("valid_count")))))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return statistics.agg(n.alias("rules_found"), p.alias("rules_passed"), all_.alias("validations"), valid.alias("valid"), kept.alias("valid_of_passed"), share(p, n).alias("pass_rate"), share(valid, all_).alias("valid_ratio"), share(kept, all_).alias("passed_ratio"))


def example_windows(found: DataFrame, k: int = 3) -> DataFrame:
    """(equation, place, start_row, start_col, row_name, ok): the first k windows that name each rule."""
    order = Window.partitionBy("equation").orderBy(*WINDOW)
    return _written(found).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("equation", "place", *WINDOW, "row_name", "ok")


def agreed_rules(found: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """(row_name, start_row, start_col, equation, description): of each window the first rule that its group agrees on.

    ``found`` has description and ``order``, the rule's place in its window.  A group agrees on a rule that half of its windows, and two
    at least, name; the description is the group's most frequent one for it (of equals the first by window).  A group of one window keeps all its rules.
    ``windows`` (row_name, start_row, start_col) are all that were looked at; without it those of ``found`` are.
    """
    written = _written(found)
    sizes = (found if windows is None else windows).groupBy(F.col("row_name").alias("_name")).agg(F.countDistinct(*WINDOW).alias("windows"))
    said = written.groupBy("row_name", "equation", "description").agg(F.count("*").alias("n"), F.min(F.struct(*WINDOW)).alias("first"))
    most = F.max_by("description", F.struct(F.col("n"), (-F.col("first.start_row")).alias("r"), (-F.col("first.start_col")).alias("c")))
    rules = said.groupBy("row_name", "equation").agg(F.sum("n").alias("n"), most.alias("said"))
    sized = rules.join(sizes, F.col("row_name").eqNullSafe(F.col("_name")))
    good = sized.where((F.col("windows") < 2) | (F.col("n") >= F.greatest(F.lit(FEWEST), F.floor(F.col("windows") / 2)))).select(F.col("row_name").alias("_name"), F.col("equation").alias("_equation"), "said", "windows")
    held = written.join(good, F.col("row_name").eqNullSafe(F.col("_name")) & (F.col("equation") == F.col("_equation")))
    single = held.where("windows < 2").select("row_name", *WINDOW, "equation", "description")
    first = held.where("windows >= 2").groupBy("row_name", *WINDOW).agg(F.min_by(F.struct("equation", "said"), "order").alias("x"))
    return single.unionByName(first.select("row_name", *WINDOW, "x.equation", F.col("x.said").alias("description")))


def revalidated(wanted: DataFrame, stored: DataFrame, stale: str = "ok") -> DataFrame:
    """Add valid and status to (window, equation, ok): a stored verdict on the rule, spaces aside, else the present check.

    ``stored`` is (start_row, start_col, equation, ok); of several verdicts on one rule in one window the first by its place ``order`` counts.
    """
    known = stored.groupBy(*WINDOW, spaced(F.col("equation")).alias("_key")).agg(F.min_by("ok", "order").alias("_was"))
    joined = wanted.withColumn("_key", spaced(F.col("equation"))).join(known, [*WINDOW, "_key"], "left")
    now = F.coalesce(F.col(stale), F.lit(False))
    status = F.when(F.col("_was").isNull(), F.when(now, "revalidated_valid").otherwise("revalidated_invalid")).when(F.col("_was"), "existing_valid").otherwise("existing_invalid")
    return joined.withColumn("valid", F.coalesce("_was", now)).withColumn("status", status).drop("_key", "_was")


def fingerprints(found: DataFrame) -> DataFrame:
    """(row_name, equation_key) of rules that hold somewhere, in normal form, each once."""
    return found.where("ok").select("row_name", E.normalized(F.col("equation")).alias("equation_key")).where("equation_key != ''").distinct()


def without_repeats(found: DataFrame, known: DataFrame) -> DataFrame:
    """(row_name, start_row, start_col, kept) of each window: dropped where its valid rules are all known by then.

    Windows come in order; a kept one adds to what its group knows, beginning with ``known`` (row_name, equation_key).  A dropped one
    adds nothing new, so a window stays if it is the first of its group with some rule that ``known`` lacks, or has no valid rule.
    """
    place = F.struct(*WINDOW)
    valid = found.where("ok").withColumn("equation_key", E.normalized(F.col("equation"))).where("equation_key != ''")
    named = F.coalesce("row_name", F.lit("")), F.col("row_name").isNull()
    marked = valid.select(named[0].alias("_name"), named[1].alias("_none"), "equation_key", *WINDOW)
    old = known.select(F.coalesce("row_name", F.lit("")).alias("_name"), F.col("row_name").isNull().alias("_none"), "equation_key").distinct()
    new = marked.join(old, ["_name", "_none", "equation_key"], "left_anti")
    first = new.groupBy("_name", "_none", "equation_key").agg(F.min(place).alias("w")).select("_name", "_none", "w.*").distinct().withColumn("_first", F.lit(True))
    windows = found.groupBy("row_name", *WINDOW).agg(F.count_if(F.col("ok") & (E.normalized(F.col("equation")) != "")).alias("n")).withColumn("_name", named[0]).withColumn("_none", named[1])
    return windows.join(first, ["_name", "_none", *WINDOW], "left").select("row_name", *WINDOW, ((F.col("n") == 0) | F.col("_first").isNotNull()).alias("kept"))


def similar(a: Column, b: Column, shared: int = 2) -> Column:
    """Whether two rule texts share so many words that hold a letter; nulls share none."""
    words = lambda x: F.filter(F.split(F.trim(x), r"\s+"), lambda w: w.rlike(r"\p{L}"))
    return F.coalesce(F.size(F.array_intersect(words(a), words(b))) >= shared, F.lit(False))


def valid_rules(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, equation, start_row, start_col): distinct equations that hold somewhere, by the window that names them first; ``by`` splits them, as by centre row."""
    keys = by or []
    return found.where("ok and equation != ''").groupBy(*keys, "equation").agg(F.min(F.struct(*WINDOW)).alias("first")).select(*keys, "equation", F.col("first.start_row").alias("start_row"), F.col("first.start_col").alias("start_col"))


def compliance(found: DataFrame) -> DataFrame:
    """One row (rules, valid, ratio) over all verdicts; the ratio is 0 where there are none."""
    return found.agg(F.count("*").alias("rules"), F.count_if("ok").alias("valid"), F.coalesce(F.avg(F.coalesce(F.col("ok").cast("int"), F.lit(0))), F.lit(0.0)).alias("ratio"))


def true_consistency(found: DataFrame) -> DataFrame:
    """(equation, valid_windows, invalid_windows, consistency_rate) over all windows that were looked at, named by the rule or not."""
    windows = found.select(*WINDOW).distinct().agg(F.count("*").alias("windows"))
    per = found.groupBy("equation").agg(F.count_if("ok").alias("valid_windows"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("invalid_windows"))
    return per.crossJoin(F.broadcast(windows)).select("equation", "valid_windows", "invalid_windows", (F.col("valid_windows") / F.col("windows")).alias("consistency_rate"))


def distinct_anomalies(found: DataFrame, order: str) -> DataFrame:
    """(location, rule, description) of each location's first anomaly."""
    return found.groupBy("location").agg(F.min_by(F.struct("rule", "description"), order).alias("x")).select("location", "x.*")


def violation_summary(anomalies: DataFrame) -> DataFrame:
    """(rule, description, violations) of rules numbered from 1; 0 names none.  The description is the least one."""
    return anomalies.where("rule > 0").groupBy("rule").agg(F.min("description").alias("description"), F.count("*").alias("violations"))


def best_of_formula(relations: DataFrame, order: str) -> DataFrame:
    """Of relations with one axis and formula that of greatest confidence; of equals the first by ``order``."""
    columns = relations.columns
    best = F.max_by(F.struct(*columns), F.struct(F.col("confidence"), (-F.col(order)).alias("o")))
    return relations.groupBy("axis", "formula").agg(best.alias("x")).select("x.*")


#: Words that tell what a column holds, and the rules that such columns suggest.
MEANINGS = {
    "qty": ("數量", "qty", "quantity"), "price": ("單價", "價格", "price", "unitprice"), "amount": ("金額", "amount", "total", "小計"),
    "input": ("投入", "input", "進料"), "good": ("良品", "good", "ok"), "bad": ("不良", "ng", "defect"), "rate": ("良率", "yield"), "defect_rate": ("不良率", "defectrate", "ngrate"),
    "balance": ("結存", "庫存", "餘額", "balance", "stock"), "inbound": ("入庫", "收入", "增加", "inbound", "in"), "outbound": ("出庫", "支出", "減少", "outbound", "out"),
}
SUGGESTED = (
    ("amount_equals_qty_times_price", "amount", "qty", "*", "price"), ("input_equals_good_plus_bad", "input", "good", "+", "bad"),
    ("yield_equals_good_div_input", "rate", "good", "/", "input"), ("defect_rate_equals_bad_div_input", "defect_rate", "bad", "/", "input"),
)
#: What is proposed, but not tested, where columns of a balance, of what comes in and of what goes out are named.
CONTINUITY = ("balance", "inbound", "outbound"), "balance_continuity", "本期結存 = 前期結存 + 入庫 - 出庫"


def _named(labels: list[str]) -> dict[str, str | None]:
    """The first label with each meaning, blanks and case aside."""
    plain = {"".join(x.lower().split()): x for x in labels if x}
    return {m: next((raw for k, raw in plain.items() if any(w in k for w in words)), None) for m, words in MEANINGS.items()}


def suggested(labels: list[str]) -> list[tuple[str, Relation]]:
    """(rule name, relation) that labels suggest; of several labels with a meaning the first counts, blanks and case aside."""
    named = _named(labels)
    return [(rule, Relation(sign, named[a], named[b], named[t])) for rule, t, a, sign, b in SUGGESTED if named[t] and named[a] and named[b]]


def confirmed(labels: list[str], relations: DataFrame) -> DataFrame:
    """(rule_name, expected_formula, tested, support_rate, status) of what the labels suggest, met with the column relations that were found; a running balance is a candidate only.

    Labels are as many as a table has columns, so the suggestions are few and are broadcast.
    """
    spark = relations.sparkSession
    rows = [(name, r.formula) for name, r in suggested(labels)]
    wanted = spark.createDataFrame(rows, "rule_name string, expected_formula string")
    key = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    found = relations.where("axis = 'column'").groupBy(key(F.col("formula")).alias("_key")).agg(F.max("support_rate").alias("support_rate"))
    joined = found.join(F.broadcast(wanted.withColumn("_key", key(F.col("expected_formula")))), "_key", "right")
    tested = F.col("support_rate").isNotNull()
    told = joined.select("rule_name", "expected_formula", tested.alias("tested"), "support_rate", F.when(tested, "passed").otherwise("not_confirmed").alias("status"))
    needed, name, formula = CONTINUITY
    if not all(map(_named(labels).get, needed)):
        return told
    return told.unionByName(spark.createDataFrame([(name, formula, False, None, "candidate_only")], "rule_name string, expected_formula string, tested boolean, support_rate double, status string"))


def preview(df: DataFrame, order: list[str], limit: int = 10) -> DataFrame:
    """The first rows in order; a limit of 0 gives none, a negative one is an error."""
    if limit < 0:
        raise ValueError("the limit of a preview must be 0 or more")
    return df.orderBy(*order).limit(limit)


def ordered_columns(headers: list[str], keys: list[str], times: list[str], value: str) -> list[str]:
    """Columns of a grouped aggregate: keys, times, the value with its mean, deviation and count, then the other headers; each once."""
    return [c for c in dict.fromkeys([*keys, *times, value, f"{value}_mean", f"{value}_std", "row_count", *headers]) if c]
