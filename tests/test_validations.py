"""Drop-down lists by hand."""

from pyspark.sql import functions as F

from quadrille.operators import validations as V

FIELDS = "sheet string, rank int, type string, sqref string, formula1 string"


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), "sheet string, row int, col int, raw string")


def test_options_of_lists(spark):
    rows = [("s", 1, "list", "A1", '"a, b ,,""c"'), ("s", 2, " LIST ", "A1", "=$B$2:$A$1"), ("s", 3, "list", "A1", "='my sheet'!A1"), ("s", 4, "list", "A1", "=unknown!A1"), ("s", 5, "list", "A1", "=names"), ("s", 6, "whole", "A1", "1"), ("s", 7, None, "A1", None), ("s", 8, "list", "A1", None)]
    given = cells(spark, ("s", 1, 1, " x "), ("s", 1, 2, ""), ("s", 2, 1, "y"), ("s", 2, 2, None), ("my sheet", 1, 1, "z"))
    got = {r["rank"]: (r["options"], r["options_source"]) for r in V.resolved(spark.createDataFrame(rows, FIELDS), given).collect()}
    assert got == {1: (["a", "b", "c"], "inline_list"), 2: (["x", "y"], "formula_ref"), 3: (["z"], "formula_ref"), 4: (["x"], "formula_ref"), 5: ([], "formula_ref_unresolved"), 6: ([], None), 7: ([], None), 8: ([], "inline_list")}


def test_cells_of_areas(spark):
    rows = [("s", 1, "list", "b2:A1 C9", "x"), ("s", 2, "list", "A1 nothing $A$5 AA10:AA11", "y"), ("s", 3, "list", None, "z"), ("t", 4, "whole", "", "z")]
    found = V.by_cell(V.resolved(spark.createDataFrame(rows, FIELDS), cells(spark)))
    got = {(r["row"], r["col"]): (r["formula1"], r["place"]["rank"]) for r in found.collect()}
    assert got == {(1, 1): ("y", 1), (1, 2): ("x", 1), (2, 1): ("x", 1), (2, 2): ("x", 1), (9, 3): ("x", 1), (10, 27): ("y", 2), (11, 27): ("y", 2)}


def test_clusters_and_their_lines(spark):
    rows = [("s", 1, "list", "A1:C1 A5:A7", '"a,b"'), ("s", 2, "list", "D2", "=x"), ("s", 3, "list", "E2", '"c"'), ("s", 4, "list", "G8", "=x"), ("s", 5, "list", "G9", '"c"'), ("s", 6, "list", "K20", "=x"), ("s", 7, "whole", "K1:K9", "1")]
    given = cells(spark, ("s", 1, 1, "a"), ("s", 1, 2, "a"), ("s", 5, 1, "b|"), ("s", 6, 1, "a]"), ("s", 2, 4, "q"))
    found = V.clustered(V.by_cell(V.resolved(spark.createDataFrame(rows, FIELDS), given)))
    lines = {(r["kind"], r["number"]): r["line"] for r in V.annotations(found, given).collect()}
    assert lines == {
        ("row_uniform", 1): "[下拉選單|list|row=1|range=A1:C1|option_count=2|cells=3|selected=a] 全列共用選項: a、b；目前皆為「a」",
        ("col_uniform", 1): "[下拉選單|list|col=1|range=A5:A7|option_count=2|cells=3|selected=b/] 全欄共用選項: a、b；目前選值: b/、a)",
        ("row_mixed", 2): "[下拉選單|list|row=2|pattern=mixed|cells=2] 例: D2(0項,選「q」); E2(1項)",
        ("col_mixed", 7): "[下拉選單|list|col=7|pattern=mixed|cells=2] 例: G8(0項); G9(1項)",
        ("scattered", None): "[下拉選單|list|anchor=K20|option_count=0] 選項: (公式參照未解析, options_source=formula_ref_unresolved)",
    }
    assert V.clustered(V.by_cell(V.resolved(spark.createDataFrame([], FIELDS), given))).count() == 0


def test_annotations_go(spark):
    text = "a\n[下拉選單|list|row=1] x\n## 下拉選單\n[圖像說明|1] y\nb\n [圖像說明|2] stays\n"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = [tuple(r) for r in df.select(V.without_annotations(F.col("t")), V.without_annotations(F.col("t"), choices=False)).collect()]
    assert got == [("a\nb\n [圖像說明|2] stays", "a\n[下拉選單|list|row=1] x\n## 下拉選單\nb\n [圖像說明|2] stays"), ("", "")]
