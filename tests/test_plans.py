"""Plans that hold for any shape: winding regions, numbering with one hot value, components, counts instead of rows."""

import random

from pyspark.sql import functions as F

from quadrille.operators import audit, components, discover, numbering, regions, windows


def spiral(n):
    """Filled cells of a square spiral with one blank ring between its turns."""
    grid = [[0] * n for _ in range(n)]
    r, c, dr, dc = 0, 0, 0, 1
    grid[0][0] = 1
    while True:
        free = lambda y, x: 0 <= y < n and 0 <= x < n and not grid[y][x]
        ahead = 0 <= r + 2 * dr < n and 0 <= c + 2 * dc < n and grid[r + 2 * dr][c + 2 * dc]
        if not free(r + dr, c + dc) or ahead:
            dr, dc = dc, -dr
            if not free(r + dr, c + dc) or (0 <= r + 2 * dr < n and 0 <= c + 2 * dc < n and grid[r + 2 * dr][c + 2 * dc]):
                return [(i, j) for i in range(n) for j in range(n) if grid[i][j]]
        r, c = r + dr, c + dc
        grid[r][c] = 1


def test_a_spiral_is_one_region(spark):
    cells = spiral(120)
    mask = spark.createDataFrame([("s", r, c) for r, c in cells] + [("t", 0, 0), ("t", 5, 5)], "sheet string, row long, col long")
    got = regions.components(mask).groupBy("sheet", "label").count().collect()
    assert sorted((r["sheet"], tuple(r["label"]), r["count"]) for r in got) == [("s", (0, 0), len(cells)), ("t", (0, 0), 1), ("t", (5, 5), 1)]


def test_components_of_any_ids(spark):
    rng = random.Random(1)
    links = [(f"n{rng.randint(0, 300):03}", f"n{rng.randint(0, 300):03}") for _ in range(230)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(90)] + [("alone", "alone")]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = dict(map(tuple, components.connected(spark.createDataFrame(links, "a string, b string")).collect()))
    assert got == {x: root(x) for x in parent}
    assert components.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_numbers_where_one_value_leads(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", "z", None]), rng.randint(0, 50), rng.random()) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, n int, x double").repartition(7)
    got = {r["x"]: r["row"] for r in numbering.number_rows(df, ["k", "n", "x"], first=5, stretches=16).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert got == {r[2]: i + 5 for i, r in enumerate(want)}
    tied = numbering.number_rows(spark.range(100).select(F.lit(1).alias("k")), ["k"], stretches=8)
    assert sorted(r["row"] for r in tied.collect()) == list(range(1, 101))


def test_counts_are_those_of_all_checks(spark):
    rng = random.Random(3)
    rows = [(i, 0, rng.choice(["a", "b", None]), [rng.choice([1.0, 2.0, 3.0, None]) for _ in range(4)]) for i in range(60)]
    windows = spark.createDataFrame(rows, "start_row long, start_col int, row_name string, values array<double>")
    rules = [audit.Rule(e) for e in discover.templates(2, 2)] + [audit.Rule("no equation"), audit.Rule("$(0,0)=$(0,1)")]
    want = audit.consistency(audit.checks(windows, list({r.key: r for r in rules}.values()), 2, 2))
    assert sorted(map(repr, discover.measured(windows, rules, 2, 2).select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    rare = discover.discover(windows.withColumn("values", F.when(F.col("start_row") < 49, F.array(*(F.lit(float(x)) for x in (1, 2, 3, 4)))).otherwise(F.array(*(F.lit(float(x)) for x in (5, 6, 7, 7))))), 2, 2, propose=lambda h, w: ["$(0,0)+$(0,1)=$(1,0)"])
    assert {r["equation"] for r in rare.collect()} == {"$(0,0)+$(0,1)=$(1,0)"}
    assert discover.measured(windows, [], 2, 2).count() == 0


def test_named_cells_are_those_of_the_text(spark):
    windows = spark.createDataFrame([(i, 0, "a", [1.0, 2.0, float(i), 4.0]) for i in range(6)], "start_row long, start_col int, row_name string, values array<double>")
    rules = [audit.Rule("$(0,0) + (0,0) = $(1,1)"), audit.Rule("$1 = $(0,1) * $(0,1)"), audit.Rule("nothing")]
    both = [sorted(map(repr, audit.suspect_cells(audit.checks(windows, rules, 2, 2, named=n)).collect())) for n in (False, True)]
    assert both[0] == both[1] and both[0]
    assert audit.checks(windows, [], 2, 2, named=True).count() == 0


def test_suspects_are_counted_within_blocks(spark, capsys):
    rng = random.Random(5)
    df = spark.createDataFrame([(i + 1, *(rng.choice([1.0, 2.0, 3.0, None]) for _ in range(3))) for i in range(50)], "row long, a double, b double, c double")
    rules = [audit.Rule(e) for e in ("$(0,0) = $(1,1)", "$(2,0) + $(0,0) = $(5,1)", "$(-3,0) = $(0,1) * $(0,1)", "$(0,0) = $(1,1)", "(1,0) - $(2,1) = $(1,1)")]
    many = [*rules, *(audit.Rule(f"$(0,0) = $(1,1) + {i}") for i in range(70))]
    assert audit.reach(rules) == (5, 3) and audit.reach([audit.Rule("$(9999,0) = 1")]) is None
    for some in (many, rules):
        plain = audit.checks(windows.scan(df, ["a", "b", "c"], 3, 2, block=4), some, 3, 2)
        found = audit.checks(windows.scan(df, ["a", "b", "c"], 3, 2, block=8, around=(5, 3)), some, 3, 2, named=True)
        assert sorted(map(repr, audit.suspect_cells(found, block=8).collect())) == sorted(map(repr, audit.suspect_cells(plain).collect()))
        tops = [audit.suspect_cells(x, top_k=7, block=8) for x in (found, plain)]
        assert [list(x.collect()) for x in tops][0] == tops[1].collect()
    capsys.readouterr()
    audit.suspect_cells(found, block=8).explain()
    assert capsys.readouterr().out.count("Exchange") == 1  # the rows by their blocks


def test_numbered_rows_keep_what_is_wanted(spark):
    df = spark.range(500).select(((F.col("id") * 79) % 500).alias("x"), (F.col("id") % 3).alias("y"))
    got = numbering.number_rows(df, ["x"], stretches=16, keep=["y"])
    assert got.columns == ["y", "row"]
    assert sorted((r["row"], r["y"]) for r in got.collect()) == [(r["x"] + 1, r["y"]) for r in df.orderBy("x").collect()]
