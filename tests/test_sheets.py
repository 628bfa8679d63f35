"""Sheet operators on small sheets with known answers."""

import random

from pyspark.sql import functions as F

from quadrille.functions import a1, coerce
from quadrille.operators import audit, cells, discover, grouped, inspector, numbering, profile, regions, relations, rules, summaries, windows
from quadrille.operators.audit import Rule

PLANTED = [(i, float(100 + i), float(90 + i), float(100 + i), 10.0) for i in range(1, 41)]


def sheet(spark, rows=None):
    return spark.createDataFrame(rows or PLANTED, "row long, a double, b double, c double, d double")


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("x")).repartition(7)
    got = numbering.number_rows(df, ["x"], stretches=16)
    assert got.where("row != x + 1").count() == 0 and got.count() == 5000
    assert numbering.number_rows(df.limit(0), ["x"]).count() == 0


def test_windows_across_blocks(spark):
    found = windows.scan(sheet(spark), ["a"], 3, 1, block=4).orderBy("start_row").collect()
    assert [r["start_row"] for r in found] == list(range(38))
    assert all(list(r["values"]) == [101.0 + r["start_row"] + k for k in range(3)] for r in found)
    assert windows.scan(sheet(spark), ["a", "b"], 2, -1, block=4).count() == 39


def test_planted_error_is_found(spark):
    bad = [(r, a, b, 500.0 if r == 17 else c, d) for r, a, b, c, d in PLANTED]
    found = windows.scan(sheet(spark, bad), ["a", "b", "c", "d"], 1, 4)
    checked = audit.checks(found, [Rule("$(0,1) + $(0,3) = $(0,2)"), Rule("$(0,0) = $(0,2)")], 1, 4)
    m = audit.metrics(checked).first()
    assert (m["total_checks"], m["failed"], m["failed_windows"]) == (80, 2, 1)
    suspects = audit.suspect_cells(checked, top=2, left=2).collect()
    assert max(suspects, key=lambda r: r["occurrences"])["address"] == "D18"
    assert audit.metrics(checked.limit(0)).first()["pass_rate"] == 0.0


def test_rules_found_and_transposed(spark):
    found = windows.scan(sheet(spark).withColumn("n", F.lit("x")), ["a", "b", "d"], 1, 3, name="n")
    got = {r["equation"] for r in discover.discover(found, 1, 3).collect()}
    assert "$(0,1)+$(0,2)=$(0,0)" in got and "$(0,0)*$(0,1)=$(0,2)" not in got
    text = spark.createDataFrame([("$(0,1)+$(2,3)=$(4,0)",)], "e string")
    assert text.select(windows.transpose_equation(F.col("e"))).first()[0] == "$(1,0)+$(3,2)=$(0,4)"


def test_rows_without_rules_get_all_unless_strict(spark):
    df = sheet(spark).withColumn("n", F.when(F.col("row") <= 10, "x").otherwise("y"))
    found = windows.scan(df, ["a", "b"], 1, 2, name="n")
    rule = [Rule("$(0,0) = $(0,1)", "x")]
    assert audit.checks(found, rule, 1, 2).count() == 40
    assert audit.checks(found, rule, 1, 2, strict=True).count() == 10
    assert audit.checks(found, [], 1, 2).count() == 0
    assert audit.checks(found, rule, 1, 2, only_row="y").count() == 30


def test_group_aggregate(spark):
    rows = [("A", "2024/01/02", "10", "late", 1), ("A", "2024-01-01", "14", "early", 2), ("B", None, "x", "text", 3), ("C", "20240103", "5", "single", 4)]
    df = spark.createDataFrame(rows, "lot string, Cdate string, PGA string, note string, o int").withColumn("value", coerce.aggregate_number(F.col("PGA")))
    got = {r["lot"]: r for r in grouped.group_aggregate(df, ["lot"], "value", [coerce.datetime_of(F.col("Cdate"))], "o", ["note"]).collect()}
    assert got["A"]["note"] == "early" and got["A"]["value_mean"] == 12 and round(got["A"]["value_std"], 6) == 2.828427 and got["A"]["row_count"] == 2
    assert got["B"]["value_mean"] is None and got["C"]["value_std"] is None and got["C"]["value_mean"] == 5
    assert grouped.time_columns(["lot", "Cdate", "other date"]) == ["Cdate"]


def test_coercions(spark):
    df = spark.createDataFrame([(x,) for x in ("1,234", "5%", "±3", "TRUE", "1d", "", None, "2024-01-05", "12:30", "=A1", "text", "1e3")], "raw string")
    c = F.col("raw")
    got = {r[0]: r[1:] for r in df.select("raw", coerce.cell_type(c), coerce.inspector_number(c), coerce.window_number(c), coerce.aggregate_number(c), coerce.region_is_data(c)).collect()}
    assert got["1,234"] == ("integer", 1234.0, 1234.0, None, True)
    assert got["5%"] == ("percentage", 0.05, None, None, False)
    assert got["±3"] == ("string", None, None, None, True)
    assert got["TRUE"] == ("boolean", None, 1.0, 1.0, False)
    assert got["1d"][0] == "string" and got["1d"][2] is None
    assert [got[x][0] for x in ("", None, "2024-01-05", "12:30", "=A1", "text", "1e3")] == ["empty", "empty", "date", "time", "formula", "string", "integer"]


def test_addresses(spark):
    n = spark.range(1, 16385).select(F.col("id").alias("n"), a1.column_name(F.col("id")).alias("s"))
    assert n.where(a1.column_number(F.col("s")) != F.col("n")).count() == 0
    assert [r["s"] for r in n.where("n in (1, 26, 27, 702, 703, 16384)").orderBy("n").collect()] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert a1.parse_area("L39:B4") == (4, 2, 39, 12) and a1.parse_area("C7") == (7, 3, 7, 3)


def long(spark, grid):
    return spark.createDataFrame([("s", r, c, x) for r, row in enumerate(grid, 1) for c, x in enumerate(row, 1)], "sheet string, row long, col int, raw string")


def test_regions_against_flood_fill(spark):
    rng = random.Random(3)
    filled = {(r, c) for r in range(14) for c in range(14) if rng.random() < 0.5}
    df = spark.createDataFrame([("s", r, c) for r, c in filled], "sheet string, row long, col long")
    for diagonal in (False, True):
        seen, groups = set(), set()
        for start in sorted(filled):
            if start in seen:
                continue
            stack, group = [start], {start}
            while stack:
                r, c = stack.pop()
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        p = (r + dr, c + dc)
                        if p in filled and p not in group and (diagonal or abs(dr) + abs(dc) == 1):
                            group.add(p)
                            stack.append(p)
            seen |= group
            groups.add(frozenset(group))
        got = {}
        for x in regions.components(df, diagonal).collect():
            got.setdefault(tuple(x["label"]), set()).add((x["row"], x["col"]))
        assert {frozenset(g) for g in got.values()} == groups


def test_table_detection_bridges_one_gap(spark):
    grid = [["x", "x", None, "x", None, None, "y"], ["x", "x", None, "x", None, None, "y"], ["x", "x", None, "x", None, None, "y"], ["x", "x", None, "x", None, None, "y"]]
    got = regions.tables(long(spark, grid)).orderBy("table_id").select("left", "right", "non_empty").collect()
    assert [tuple(x) for x in got] == [(1, 4, 12), (7, 7, 4)]


def test_relations_and_labels(spark):
    rows = [(i, float(i), 2.5, (i * 2.5 if i != 7 else 1.0)) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "row long, qty double, price double, amount double")
    got = {r["formula"]: r for r in relations.detect(df, ["qty", "price", "amount"]).collect()}
    r = got["amount = qty * price"]
    assert (r["support"], r["valid"], r["confidence"]) == (19, 20, 0.9025)
    assert [x["row"] for x in relations.violations(df, relations.Relation("*", "qty", "price", "amount")).collect()] == [7]
    assert [(n, x.formula) for n, x in summaries.suggested(["Qty", "Unit price", "Total amount"])] == [("amount_equals_qty_times_price", "Total amount = Qty * Unit price")]
    assert relations.coefficient_rule(df, ["qty"], [1.0, 2.0]).where("ok").count() == 0


def test_cells_edit_and_records(spark):
    c = long(spark, [["h", "k"], ["1", None], [None, None], ["2", "x"]])
    assert cells.used_range(c).first()["address"] == "A1:B4"
    assert cells.prune_blank(c).count() == 6
    assert cells.insert_lines(c, "row", 2, 2).agg(F.max("row")).first()[0] == 6
    assert cells.delete_lines(c, "row", 2, 2).agg(F.max("row")).first()[0] == 2
    names = cells.header_names(["h", "h", "", None])
    assert names == ["h", "h_2", "column_3", "column_4"]
    assert cells.records(c, ["h", "k"]).count() == 2 and cells.records(c, ["h", "k"], include_empty=True).count() == 3
    assert cells.transpose(cells.transpose(c)).exceptAll(c.select("sheet", "row", F.col("col").cast("long"), "raw")).count() == 0
    assert cells.crop(c, 1, 1, 2, 1).count() == 2
    assert cells.append_rows(c, c.where("row = 1")).agg(F.max("row")).first()[0] == 5
    assert profile.axis_profile(cells.typed(c)).count() == 2


def test_rule_book_round_trip(spark):
    rows = spark.createDataFrame([("3", "n", 4, "$(0,0)=$(1,0)", 4, 4, 1.0), ("3", "n", 4, "$(0,0)+$(1,0)=$(2,0)", 3, 4, 0.75)], "row_key string, row_name string, window_count int, equation string, valid_windows long, total_windows long, consistency_rate double")
    book = rules.to_book(rows)
    assert rules.from_book(book).count() == 2 and rules.from_book(book, least=0.8).count() == 1
    both = rules.compare(rows, rows.where("consistency_rate = 1.0"))
    assert {r["equation_key"]: r["status"] for r in both.collect()} == {"$(0,0)=$(1,0)": "both", "$(0,0)+$(1,0)=$(2,0)": "only_a"}


def test_tables_too_wide_for_relations_are_reported(spark):
    """Three columns, the third the sum of the others, and a bound of two: reported, and found without the bound."""
    rows = [("s", 1, r, c, float(v)) for r in range(1, 21) for c, v in ((1, r), (2, 2 * r + 1), (3, 3 * r + 1))]
    inside = spark.createDataFrame(rows, "sheet string, table_id int, r int, c int, num double")
    assert inspector.relations(inside, most=2).count() == 0 and inspector.too_wide(inside, most=2).first()["width"] == 3
    assert {(x.a, x.sign, x.b, x.t) for x in inspector.relations(inside, most=None).where("sign = '+'").collect()} == {(1, "+", 2, 3)}
    assert inspector.too_wide(inside).count() == 0
