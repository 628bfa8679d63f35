"""Text operators, sources and streams."""

import json

from pyspark.sql import functions as F

from quadrille.functions import text as T
from quadrille.operators import documents, textwork
from quadrille.sources import export, inline, xlsx
from quadrille.streaming import events

MARKDOWN = "# One\ntext\n## Two\n```\n# not a heading\n```\n\nThree\n=====\nend"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_headings_and_paths(spark):
    got = documents.headings(docs(spark, MARKDOWN, None, "")).orderBy("line_no").collect()
    assert [(r["kind"], r["level"], r["heading"]) for r in got] == [("markdown", 1, "One"), ("markdown", 2, "Two"), ("setext", 1, "Three")]
    path = {r["line_no"]: r["path"] for r in documents.heading_path(docs(spark, MARKDOWN)).collect()}
    assert path[5] == ["One", "Two"] and path[9] == ["Three"]
    assert documents.structured_segments(docs(spark, MARKDOWN), least=0).count() == 3


def test_log_and_code_segments(spark):
    log = "2024-01-01 10:00:00 ERROR a\n  more\n2024-01-01 10:00:01 INFO b\n2024-01-01 10:00:02 INFO c"
    assert documents.log_segments(docs(spark, log)).count() == 3
    assert docs(spark, log, "plain").select(T.document_pattern(F.col("text"))).collect() == [("log",), ("plain_text",)]
    assert documents.code_segments(docs(spark, "import x\ndef f():\n  pass\nclass A:\n  y = 1"), least=0).count() == 3


def test_breaks_late_in_long_texts(spark):
    texts = ("x" * 600 + "\n\ny", "x" * 600 + "\r\ny", "x" * 600 + "\r\n\r\ny", "x" * 600 + "\ny", "x" * 600, None, "a\nb")
    assert [r[0] for r in docs(spark, *texts).orderBy("doc_id").select(T.line_break(F.col("text"))).collect()] == ["lf2", "lf", "crlf2", "lf", "lf", "lf2", "lf2"]


def test_pattern_scores_by_hand(spark):
    long = "x " * 2000
    texts = {
        long + "import x\ndef f(a):\n  return a\nclass B:\n  pass": (0.8, 0.0, 0.0, 0.0, "code"),
        long + "\n2024-01-01 10:00:00 ERROR a": (0.0, 0.8, 0.3, 0.0, "log"),
        "From: a\nTo: b@c\nRe: x": (0.0, 0.0, 1.0, 0.0, "communication"),
        "subject: only": (0.0, 0.0, 0.4, 0.0, "plain_text"),
        "# One\n- a\n\n\n`b`": (0.2, 0.0, 0.0, 1.0, "structured_doc"),
        "[a] b\n[c]: d": (0.2, 0.0, 0.3, 0.0, "plain_text"),
        "same\n" * 8: (0.0, 0.2, 0.0, 0.0, "plain_text"),
        long: (0.0, 0.0, 0.0, 0.0, "plain_text"),
    }
    t = F.col("text")
    got = docs(spark, *texts).orderBy("doc_id").select(*(F.round(c, 6) for c in T.pattern_scores(t).values()), T.document_pattern(t)).collect()
    assert [tuple(r) for r in got] == list(texts.values())


def test_structure_by_hand(spark):
    texts = {
        "[co] Ann\n[co] Bob\n\n[co] Eve": ("contacts", "line"), "a = 1\nb: 2\n[part]\nrest": ("config", "line"), "|a|b|\n|---|:-:|\n|1|2|\ntext": ("table", "paragraph"),
        "# One\n|a|b|\ntext\n\nmore": ("mixed", "paragraph"), "# One\ntext": ("structured", "semantic"), "\n".join(["short"] * 11): ("short_items", "line"),
        "one two\n\nthree\n\nfour\n\nfive": ("paragraphs", "paragraph"), "one two three": ("general", "paragraph"), " \n ": (None, "paragraph"), "": (None, "paragraph"),
    }
    got = documents.structure(docs(spark, *texts)).orderBy("doc_id").collect()
    assert [(r["kind"], r["strategy"]) for r in got] == list(texts.values())


def test_heading_forms_by_hand(spark):
    lines = {
        "## Two ": ("markdown", 2, "Two"), "第三節 範圍": ("cn_chapter", 2, "範圍"), "一、總則": ("cn_numeral", 1, "總則"), "2.1.3 Scope": ("decimal", 3, "Scope"), "4) Four": ("decimal_simple", 1, "Four"), "5、五": ("decimal_simple", 1, "五"),
        "[1-2] Ref": ("bracket_num", 1, "Ref"), "【3】圖": ("bracket_num_fw", 1, "圖"), "1-2-3 Deep": ("hyphen", 3, "Deep"), "iv. Small": ("roman", 1, "Small"), "b) Letter": ("alpha", 1, "Letter"),
    }
    other = ["plain", " [4] indented", "12 no mark", "| a | b |", "[7] return x;", "----"]
    got = documents.headings(docs(spark, "\n\n".join([*lines, *other]), "Title\n---\nUnder\n==\nx", "1. a\n===")).orderBy("doc_id", "line_no").collect()
    assert [(r["kind"], r["level"], r["heading"]) for r in got] == [*lines.values(), ("setext", 2, "Title"), ("decimal_simple", 1, "a")]


def test_sender_segments_by_hand(spark):
    text = "lost line\nFrom: ann\nhello there\n\n  more of it\nFrom: ann\n[bob]: hi\nok\n" + "y" * 30 + "\n" + "z" * 30
    got = documents.sender_segments(docs(spark, text, None, "plain text only", "short"), most=40, least=9).orderBy("doc_id", "segment").collect()
    assert [(r["doc_id"], r["sender"], r["content"]) for r in got] == [
        (0, None, "lost line"), (0, "From:", "From: ann\nhello there\nmore of it\nFrom: ann"), (0, "[bob]:", "[bob]: hi\nok"), (0, "[bob]:", "y" * 30), (0, "[bob]:", "z" * 30), (2, None, "plain text only"),
    ]


def test_terms_of_sheets_by_hand(spark):
    rows = [("s", r, 1, v) for r, v in enumerate(["Alpha", "beta", "BETA", "x", "12", "=A1", "col_3", "Group Ltd", "common", "common", "common", "com", "com", "com"], 1)] + [("one", 1, 1, "alone")]
    cells = spark.createDataFrame(rows, "sheet string, row int, col int, raw string")
    got = documents.distinctive_terms(cells, 8).orderBy("chunk", "place").collect()
    assert [(r["chunk"], r["term"], r["n"]) for r in got] == [(0, "Alpha", 1), (0, "beta", 1), (1, "common", 3)]
    labels = [("s", 1, 1, "品名：  Club"), ("s", 1, 2, "規格:"), ("s", 1, 3, "5"), ("s", 1, 4, "AB1234-X"), ("s", 2, 1, "other"), ("s", 2, 2, "版本"), ("s", 2, 3, "標準")]
    kv = textwork.key_values(spark.createDataFrame(labels, "sheet string, row int, col int, raw string")).orderBy("row", "col").collect()
    assert [(r["row"], r["key"], r["value"]) for r in kv] == [(1, "品名", "Club"), (1, "規格", "AB1234-X")]


def test_part_codes_and_measures_by_hand(spark):
    text = "AB1234-X CD12 (Z-9) and QQ12, 12.5 mm ± 0.3 or 45度, 3 kg; ±7 1234"
    row = docs(spark, text).select(F.regexp_extract_all("text", F.lit(T.PART_CODE), F.lit(0)), F.regexp_extract_all("text", F.lit(T.MEASURE), F.lit(0))).first()
    assert row[0] == ["AB1234-X CD12 (Z-9)"] and [x.strip() for x in row[1]] == ["12.5 mm", "± 0.3", "45度", "3 kg", "±7"]


def test_merge_by_length_against_a_loop(spark):
    text = "\n".join("x" * n for n in (5, 6, 30, 1, 1, 12, 9, 8))
    sizes, chunk, used, expected = [5, 6, 30, 1, 1, 12, 9, 8], 0, 0, []
    for n in sizes:
        if used and used + n > 20:
            chunk, used = chunk + 1, 0
        used += n
        expected.append(chunk)
    got = {r["chunk"]: r["n_parts"] for r in documents.merge_by_length(docs(spark, text), 20).collect()}
    assert got == {c: expected.count(c) for c in set(expected)}


def test_merge_by_hierarchy(spark):
    rows = [(1, 0, 1, "A"), (1, 1, 2, "a" * 10), (1, 2, 2, "b" * 10), (1, 3, 1, "B" * 50)]
    got = documents.merge_by_hierarchy(spark.createDataFrame(rows, "doc_id long, order int, level int, content string"), 30).orderBy("chunk").collect()
    assert [r["first_order"] for r in got] == [0, 3]


def test_keywords_keep_first_form(spark):
    got = {r["doc_id"]: r["keywords"] for r in documents.keywords(docs(spark, "Alpha beta ALPHA x gamma-ray Beta", "", None), 2).collect()}
    assert got == {0: ["Alpha", "beta"], 1: [], 2: []}


def test_decoding(spark):
    files = spark.createDataFrame([("a", bytearray("中文".encode("big5"))), ("b", bytearray("é".encode()))], "path string, content binary")
    got = {r["path"]: (r["codec"], r["text"]) for r in documents.decoded(files).collect()}
    assert got == {"a": ("cp950", "中文"), "b": ("utf-8-sig", "é")}


def test_inline_tables_agree(spark):
    texts = ['[["a", "b"], ["1", "x"]]', '{"table": [["a", "b"], ["1", "x"]]}', "| a | b |\n|---|---|\n| 1 | x |", "a\tb\n1\tx", 'a,b\n1,"x"']
    df = spark.createDataFrame(list(enumerate(texts)), "sheet int, text string")
    rows = inline.cells(df).groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("row", "col", "raw"))).alias("x")).collect()
    assert len({str(r["x"]) for r in rows}) == 1 and len(rows) == 5
    assert inline.separator_of("a;b\n1;2") == ";"


def test_workbook_round_trip(spark, tmp_path):
    book = xlsx.workbook({"One": [["Name", "Dept", "Score"], ["a<b", None, 1.5], [True, "=A1+1", 3]], "Two": [["x"]]}, {("One", 2, 3)})
    (tmp_path / "b.xlsx").write_bytes(book)
    got = {(r["sheet"], r["row"], r["col"]): r["raw"] for r in xlsx.read(spark, str(tmp_path)).collect()}
    assert got == {("One", 1, 1): "Name", ("One", 1, 2): "Dept", ("One", 1, 3): "Score", ("One", 2, 1): "a<b", ("One", 2, 3): "1.5", ("One", 3, 1): "TRUE", ("One", 3, 2): "=A1+1", ("One", 3, 3): "3", ("Two", 1, 1): "x"}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 2)], "x string, y int")
    export.csv(df.coalesce(1), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    export.json_records(df.coalesce(1), str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("part*") for x in p.read_text().splitlines()]
    assert {"x": "a", "y": None} in lines


def test_streams_agree_with_batches(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    source = events.source(spark, str(tmp_path / "in"))
    q = events.tumbling(source).writeStream.outputMode("complete").format("memory").queryName("tumbling_out").start()
    q.processAllAvailable()
    q.stop()
    expected = {(r["window_start"], r["event_type"]): r["n"] for r in events.tumbling(batch).collect()}
    assert {(r["window_start"], r["event_type"]): r["n"] for r in spark.table("tumbling_out").collect()} == expected
    once = events.first_of_each(source).writeStream.outputMode("append").format("memory").queryName("once_out").start()
    once.processAllAvailable()
    once.stop()
    assert spark.table("once_out").count() == batch.select("event_id").distinct().count()


def test_small_text_helpers(spark):
    row = spark.createDataFrame([("a\nb" * 30, ["home", "v1.2", "Report", "x", "12345a", "f.tmp", "~$a", "Node_Modules", "7", "a.SWP", "data"])], "t string, tags array<string>").select(T.display(F.col("t"), 20), T.tags_kept(F.col("tags")), T.looks_corrupt(F.lit("what??")), T.without_controls(F.lit("a\x00b"))).first()
    assert len(row[0]) == 20 and row[1] == ["Report", "data"] and row[2] and row[3] == "ab"
