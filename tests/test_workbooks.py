"""Workbooks, the inspector, and more work on texts."""

import pytest
from pyspark.sql import functions as F

from quadrille.operators import inspector, textwork, workbook
from quadrille.operators.workbook import CommandError, Workbook


def cells(spark, grid, sheet="s"):
    return spark.createDataFrame([(sheet, r, c, x) for r, row in enumerate(grid, 1) for c, x in enumerate(row, 1) if x is not None], "sheet string, row long, col int, raw string")


def values(df):
    return {(r["row"], r["col"]): r["raw"] for r in df.collect()}


def test_workbook_commands(spark):
    book = Workbook.of(cells(spark, [["Name", "Dept", "Score"], ["a", "x", "1"], ["b", "y", "2"]]))
    assert not book.dirty and book.used_range() == "A1:C3"
    book.write_range("B2", [["z", None]])
    assert values(book.read_range("A2:C2")) == {(2, 1): "a", (2, 2): "z"}
    book.append_rows([["c", "w", "3"]])
    book.shift("row", 2, 1)
    assert book.used_range() == "A1:C5"
    book.shift("row", 2, -1)
    book.set_formula("D2", "C2*$C$3")
    book.fill_formula("D2", "D3:D4")
    assert values(book.read_range("D3:D4")) == {(3, 4): "=C3*$C$3", (4, 4): "=C4*$C$3"}
    book.clear_range("A1:A9")
    assert book.read_range("A1:A9").count() == 0
    book.copy_sheet("s", "t")
    book.rename_sheet("s", "u")
    book.move_sheet("t", 0)
    assert list(book.sheets) == ["t", "u"] and book.active == "u"
    book.delete_sheet("t")
    for bad in (lambda: book.delete_sheet("u"), lambda: book.sheet("none"), lambda: book.add_sheet("u"), lambda: book.fill_formula("B2", "B3:B4")):
        with pytest.raises(CommandError):
            bad()
    book.set_choices("B2:B4", ["y", "w"])
    assert values(book.broken_choices()) == {(2, 2): "z"}
    book.create_table("T", "A1:C3")
    book.set_filter("A1:C3")
    book.clear_filter()
    assert book.dirty and book.audit_log(1).count() == 1 and book.audit_log().count() == len(book.log)


def test_translation_leaves_texts_and_functions():
    assert workbook.translate('=SUM(A1:$B$2)&"A1"&LOG10(A1)', 1, 1) == '=SUM(B2:$B$2)&"A1"&LOG10(B2)'


def test_inspector_finds_header_types_and_relation(spark):
    rows = [["qty", "price", "amount", "when"]] + [[str(i), "2.5", str(i * 2.5 if i != 7 else 1.0), f"2024-01-{i:02d}"] for i in range(1, 21)]
    found = inspector.inspect(cells(spark, rows))
    assert found["layout"].first()["has_header"]
    assert {(r["c"], r["data_type"]) for r in found["types"].collect()} == {(1, "number"), (2, "number"), (3, "number"), (4, "datetime")}
    best = {(r["a"], r["sign"], r["b"], r["t"]): (r["valid"], r["support"], r["confidence"]) for r in found["relations"].where("axis = 'column'").collect()}
    assert best[1, "*", 2, 3] == (20, 19, 0.9025)
    rules = [(r["rule_id"], r["kind"], r["text"]) for r in inspector.export_rules(found).orderBy("rule_id").collect()]
    assert rules[0] == ("R0001", "region", "rows 1 to 21, columns 1 to 4") and ("relation", "amount = qty * price") in {x[1:] for x in rules}
    assert found["too_wide"].count() == 0 and inspector.totals(cells(spark, rows), found).first()["tables"] == 1
    narrow = inspector.inspect(cells(spark, rows), most=2)
    assert {(r["axis"], r["width"]) for r in narrow["too_wide"].collect()} == {("column", 3), ("row", 21)} and narrow["relations"].count() == 0
    nothing = cells(spark, rows).limit(0)
    assert inspector.inspect(nothing)["relations"].count() == 0 and tuple(inspector.totals(nothing, inspector.inspect(nothing)).first()) == (0, 0, 0)


def test_inspector_takes_all_header_rows(spark):
    rows = [["item", "first half", "second half"], ["name", "January", "February"]] + [[str(i)] * 3 for i in range(1, 21)]
    found = inspector.inspect(cells(spark, rows), full_headers=True)
    assert found["layout"].first()["header_rows"] == 2
    assert {r["c"]: r["label"] for r in found["labels"].collect()} == {1: "item / name", 2: "first half / January", 3: "second half / February"}
    assert {r["c"]: (r["data_type"], r["confidence"]) for r in found["types"].collect()} == {1: ("number", 1.0), 2: ("number", 1.0), 3: ("number", 1.0)}
    assert ("header", "the first 2 rows name the columns") in {(r["kind"], r["text"]) for r in inspector.export_rules(found).collect()}


def test_split_text_keeps_every_part(spark):
    text = "\n\n".join(["a" * 30, "b" * 30, "c" * 120])
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = [r["content"] for r in textwork.split_text(docs, limit=70, overlap=5).orderBy("chunk").collect()]
    assert all(len(x) <= 70 for x in got) and "".join(got).count("c") == 120 + 5 and got[0] == "a" * 30 + "\n" + "b" * 30


def test_keyword_replies(spark):
    assert textwork.keyword_list('```json\n["A", "b", "a"]\n```') == ["A", "b"]
    assert textwork.keyword_list('{"keywords": ["x"]}') == ["x"]
    assert textwork.keyword_list("1. one, two\n- Two") == ["one", "two"] and textwork.keyword_list(None) == []
    df = spark.createDataFrame([("a, b",), (None,)], "reply string")
    assert sorted(len(r["keywords"]) for r in textwork.parsed_keywords(df).collect()) == [0, 2]


def test_repair_and_cleanup(spark):
    docs = spark.createDataFrame([(1, "é à".encode().decode("latin-1")), (2, "fine é"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in textwork.repaired(docs).collect()} == {1: "é à", 2: "fine é", 3: None}
    one = spark.createDataFrame([(r"{\rtf1 Hello\par World}",)], "t string").select(textwork.rtf_cleaned(F.col("t"))).first()[0]
    assert one == "Hello\nWorld" or one.split() == ["Hello", "World"]


def test_names_slices_and_terms(spark):
    names = spark.createDataFrame([("supplied wieght",), ("zzz",)], "name string")
    known = spark.createDataFrame([("supplied weight",), ("ring weight",), ("computed height",)], "known string")
    assert [(r["name"], r["match"]) for r in textwork.fuzzy_names(names, known).collect()] == [("supplied wieght", "supplied weight")]
    c = cells(spark, [["品名:", "AB-123"], ["Weight", "20 kg"], ["x", "y"]])
    slices = spark.createDataFrame([("s", 2, 99)], "sheet string, first long, last long")
    assert textwork.row_slices(c, slices, strict=True).agg(F.min("row")).first()[0] == 2
    with pytest.raises(ValueError):
        textwork.row_slices(c, spark.createDataFrame([("s", 9, 99)], "sheet string, first long, last long"), strict=True)
    assert {(r["key"], r["value"]) for r in textwork.key_values(c).collect()} == {("品名", "AB-123")}
    assert {"AB-123", "20 kg", "Weight"} <= set(textwork.sheet_keywords(c).first()["keywords"])
    assert c.withColumn("f", F.lit("f.xlsx")).withColumn("t", F.array("raw")).select(textwork.hierarchy_keys(c, "f", "sheet", "t").alias("k")).first()["k"][0].startswith("f.xlsx::s::")
