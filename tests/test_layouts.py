"""Header rows, index columns, numeric areas and summaries of rules, with rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions.coerce import cell_type
from quadrille.operators import headers, summaries

TABLE = [
    ["Region", "2023", "2023", ""],
    ["name", "qty", "price", ""],
    ["north", "4", "4", ""],
    ["south", "7", "2", None],
    ["east", "1", "5", "x"],
]


@pytest.fixture(scope="module")
def inside(spark):
    rows = [("s", 1, r + 10, r, c, raw) for r, line in enumerate(TABLE, 1) for c, raw in enumerate(line, 1)]
    return spark.createDataFrame(rows, "sheet string, table_id int, row int, r int, c int, raw string").withColumn("ctype", cell_type(F.col("raw")))


@pytest.fixture(scope="module")
def boxes(spark):
    return spark.createDataFrame([("s", 1, 11, 1, 15, 4)], "sheet string, table_id int, top int, left int, bottom int, right int")


def test_scores_of_rows(inside, boxes):
    """Row 1: 1 of 3 texts, 2 of 3 distinct, 3 of 4 filled, below it columns of texts (one kind), and of 3 numbers in 4 twice."""
    found = {x.r: round(x.score, 6) for x in headers.header_row_scores(inside, boxes).collect()}
    assert found[1] == round(0.3 / 3 + 0.2 * 2 / 3 + 0.2 * 3 / 4 + 0.3, 6)
    assert found[2] == round(0.3 + 0.2 + 0.2 * 3 / 4 + 0.3, 6)
    assert found[5] == round(0.3 / 2 + 0.2 + 0.2, 6)


def test_two_header_rows_and_an_index(inside, boxes):
    found = headers.infer(inside, boxes)
    row = found.first()
    assert (row.header_rows, row.index_cols, row.data_top, row.data_left, row.data_bottom, row.data_right) == (2, 1, 13, 2, 15, 4)
    assert {(x.c, x.label) for x in headers.labels(inside, boxes, found).collect()} == {(2, "2023 / qty"), (3, "2023 / price"), (4, "col_4")}
    assert [x.header for x in headers.guessed_headers(inside, boxes).orderBy("c").collect()] == ["Region", "2023", "2023", "col_4"]


def test_signals(inside, boxes):
    """Row: 3/4 filled, 1/3 texts, 2/3 distinct, all of 4 filled below; column: all, all, all, and 2, 2, 2, 2, 3 of 3."""
    row = headers.header_signals(inside, boxes).first()
    assert row.row_score == round((3 / 4 + 1 / 3 + 2 / 3 + 1) / 4, 3) and row.col_score == round((3 + 11 / 15) / 4, 3)
    assert row.index_row and row.index_col


def test_empty_tables_give_nothing(inside, boxes):
    none = boxes.where("false")
    assert headers.infer(inside, none).count() == headers.labels(inside, none, headers.infer(inside, none)).count() == 0
    assert headers.header_signals(inside.where("false"), boxes).first().index_row is False


def test_sequential(spark):
    rows = [("a", x) for x in ("3", " 1", "2")] + [("b", x) for x in ("1", "2", "2")] + [("c", "1"), ("c", "2")] + [("d", x) for x in ("1", "2", "x", None)]
    found = headers.sequential(spark.createDataFrame(rows, "k string, t string"), ["k"], "t")
    assert {x.k: x.sequential for x in found.collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_numeric_areas_and_tables(spark):
    cells = spark.createDataFrame([("s", 1, 1, "1,000"), ("s", 1, 2, "± 3"), ("s", 2, 1, "nan"), ("s", 2, 2, "SS 4"), ("s", 3, 1, None), ("s", 3, 2, "5"), ("s", 4, 1, "x"), ("s", 4, 2, "±a")], "sheet string, row int, col int, raw string")
    strict = headers.numeric_areas(cells, 2, 2).orderBy("tile_row").collect()
    assert [(x.n_filled, x.n_numbers, x.n_text, x.is_data) for x in strict] == [(4, 3, 3, False), (3, 1, 2, False)]
    assert [x.is_data for x in headers.numeric_areas(cells, 2, 2, strict=False).orderBy("tile_row").collect()] == [True, False]
    assert headers.numeric_tables(cells).first().asDict() == {"sheet": "s", "is_numeric": True, "missing_ratio": 1 / 8}


def test_blocks(spark):
    boxes = spark.createDataFrame([("s", 1, 2, 25, 130, 41)], "sheet string, table_id int, top int, left int, bottom int, right int")
    assert [x.address for x in headers.blocks(boxes).orderBy("block").collect()] == ["Y2:AM101", "AN2:AO101", "Y102:AM130", "AN102:AO130"]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [("a", 1, 0, "x = y", True, "p", 0), ("a", 1, 0, "u = v", True, "p", 1), ("a", 2, 0, "x  = y", False, "q", 0), ("a", 3, 0, " x = y", True, "q", 0), ("b", 4, 0, "u = v", True, "r", 0), (None, 5, 0, "u = v", False, None, 0), (None, 6, 0, None, None, None, 0)]
    return spark.createDataFrame(rows, "row_name string, start_row int, start_col int, equation string, ok boolean, description string, `order` int")


def test_statistics_of_rules(verdicts):
    """x = y is in all three windows of group a; u = v in one of three, in one of two without a name, and in b, which has one window only."""
    found = {x.equation: (x.validations, x.valid_count, round(x.consistency_rate, 6)) for x in summaries.rule_statistics(verdicts).collect()}
    assert found == {"x = y": (3, 2, 0.5), "u = v": (3, 2, round((1 / 3 + 1 / 2) / 2, 6))}


def test_agreed_rules(verdicts):
    """In a, x = y is named thrice, mostly as q; u = v once, too seldom; b has one window and keeps its rule."""
    found = {(x.row_name, x.start_row, x.equation, x.description) for x in summaries.agreed_rules(verdicts).collect()}
    assert found == {("a", 1, "x = y", "q"), ("a", 2, "x = y", "q"), ("a", 3, "x = y", "q"), ("b", 4, "u = v", "r")}


def test_windows_without_repeats(verdicts):
    """Window 3 has only x = y, known from window 1; 2, 5 and 6 have no valid rule."""
    none = summaries.fingerprints(verdicts.where("false"))
    assert {x.start_row: x.kept for x in summaries.without_repeats(verdicts, none).collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}
    known = summaries.fingerprints(verdicts.where("start_row = 1"))
    assert {x.start_row for x in summaries.without_repeats(verdicts, known).where("not kept").collect()} == {1, 3}


def test_revalidation(spark, verdicts):
    stored = spark.createDataFrame([(1, 0, "x =  y", False, 0), (1, 0, "x = y", True, 1)], "start_row int, start_col int, equation string, ok boolean, `order` int")
    found = summaries.revalidated(verdicts.where("start_row in (1, 6)"), stored)
    assert {(x.equation, x.valid, x.status) for x in found.collect()} == {("x = y", False, "existing_invalid"), ("u = v", True, "revalidated_valid"), (None, False, "revalidated_invalid")}


def test_group_summary(spark):
    rates = spark.createDataFrame([("a", "$(0,0)=$(1,0)", 5, 0.9), ("a", "$(0,0)=$(0,0)", 5, 1.0), ("b", "$(0,0)=$(1,0)", 2, 0.1)], "row_name string, equation string, total_windows int, consistency_rate double")
    groups = summaries.group_summary(rates)
    assert {tuple(x) for x in groups.collect()} == {("a", 5, 2, 1, 0.5, True), ("b", 2, 1, 0, 0.0, False)}
    assert tuple(summaries.overall(groups).first()) == (2, 1, 0.5)
    assert tuple(summaries.overall(groups.where("false")).first()) == (0, 0, 0.0)


def test_suggested_formulas(spark):
    found = spark.createDataFrame([("column", "Total = Qty * Unit Price", 0.9), ("row", "x", 1.0)], "axis string, formula string, support_rate double")
    rows = summaries.confirmed(["Qty", "Unit Price", "Total", "投入", "良品數", "不良數"], found).collect()
    assert {(x.rule_name, x.status, x.support_rate) for x in rows} == {("amount_equals_qty_times_price", "passed", 0.9), ("input_equals_good_plus_bad", "not_confirmed", None)}


def test_similar_preview_and_order(spark):
    pair = spark.createDataFrame([("sum of a 1", "sum a 1"), ("sum 1 2", "sum 1 2"), (None, "a b")], "a string, b string")
    assert [x[0] for x in pair.select(summaries.similar(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert summaries.preview(pair, ["a"], 0).count() == 0
    with pytest.raises(ValueError):
        summaries.preview(pair, ["a"], -1)
    assert summaries.ordered_columns(["v", "k", "t", "z"], ["k"], ["t"], "v") == ["k", "t", "v", "v_mean", "v_std", "row_count", "z"]
