"""Rules that say nothing, windows that name no rule, and the running balance, by hand."""

from pyspark.sql import functions as F

from quadrille.operators import degeneracy, summaries


def test_forms(spark):
    want = {
        "$0 = $0": "identity_equation", "1 = 2": "no_operands", "": None, "words": "no_operands", "$0 + $1 = $1": "add_forced_zero_trailing", "$1 + $0 = $1": "add_forced_zero_leading",
        "$1 - $0 = $1": "sub_minuend_eq_rhs_forces_subtrahend_zero", "$0 + $1 = $2": None, "$1 = $0 + $1": None, "$0*$1 + $2 = $2": None, "$(11,0)+$(1,0)=$(1,0)": "add_forced_zero_trailing", "$(1,0)": None}
    df = spark.createDataFrame([(x,) for x in want], "e string")
    assert {r[0]: r[1] for r in df.select("e", degeneracy.structural(F.col("e"))).collect()} == want


def test_values_reject(spark):
    windows = spark.createDataFrame([("a", [1.0, 0.0, None]), ("a", [1.0, 0.0, None]), (None, [1.0, 2.0, 3.0]), (None, [2.0, 2.0, float("nan")])], "row_name string, values array<double>")
    rules = spark.createDataFrame([("a", "$0=$(0,1)"), ("a", "$(0,2)=$0"), ("a", "$0*2=2"), (None, "$(0,2)=$(0,1)*$0"), (None, "$0=$(0,1)"), ("gone", "$0=1"), ("a", None)], "row_name string, equation string")
    told = lambda **more: [r["reason"] for r in degeneracy.rejections(rules.coalesce(1), windows, 3, **more).orderBy("row_name", "equation").collect()]
    assert told() == [None, None, None, "operand_no_numeric:$(0,2)", None, "operand_nonzero_insufficient:$(0,1)", "operand_no_numeric:$(0,0)"]
    assert told(least_distinct=2)[:2] == ["operand_distinct_insufficient:$(0,2)", "operand_distinct_insufficient:$(0,1)"]


def test_windows_without_rules_count(spark):
    found = spark.createDataFrame([("g", r, 0, "e", True, "d", 0) for r in range(2)], "row_name string, start_row long, start_col int, equation string, ok boolean, description string, `order` int")
    windows = spark.range(6).select(F.lit("g").alias("row_name"), F.col("id").alias("start_row"), F.lit(0).alias("start_col"))
    assert summaries.agreed_rules(found).count() == 2 and summaries.agreed_rules(found, windows).count() == 0
    assert summaries.rule_statistics(found).first()["consistency_rate"] == 1.0
    assert summaries.rule_statistics(found, windows=windows).first()["consistency_rate"] == 2 / 6


def test_running_balance_is_a_candidate(spark):
    none = spark.createDataFrame([], "axis string, formula string, support_rate double")
    rows = summaries.confirmed(["期末庫存", "入庫", "出庫"], none).collect()
    assert [tuple(r) for r in rows] == [("balance_continuity", "本期結存 = 前期結存 + 入庫 - 出庫", False, None, "candidate_only")]
