"""Outlines by hand: headings against their surroundings, tags, chunks along the tree."""

from pyspark.sql import functions as F

from quadrille.operators import documents, outline


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.lit("other"))


def judged(spark, text):
    return [(r["line_no"], r["kind"], r["denied"], r["consistent"]) for r in outline.judged_headings(documents.lines(docs(spark, text))).orderBy("line_no").collect()]


def test_headings_that_are_denied(spark):
    text = "# 版本號 1\n誤判風險\na\n# under\n# far\n第2條為 x\n1-1-1-ABC\nA. B. C. x\n一、二、三\n# 只是清單\n# fine"
    assert [x[:3] for x in judged(spark, text)] == [(0, "markdown", "phrase"), (3, "markdown", "warned"), (4, "markdown", "warned"), (5, "cn_chapter", "form"), (6, "hyphen", "form"), (7, "alpha", "form"), (8, "cn_numeral", "form"), (9, "markdown", "phrase"), (10, "markdown", None)]


def test_numbers_need_a_parent_nearby(spark):
    text = "1. one\n1.1 a\n1.1.1 b\n2.1 c\nx\nx\nx\nx\nx\n1.1 too far\n第3章\n3.1 d\n3-1 e\n3-1-1 f\n9-9-9 g"
    assert [(x[0], x[3]) for x in judged(spark, text)] == [(0, True), (1, True), (2, True), (3, False), (9, False), (10, True), (11, True), (12, True), (13, True), (14, False)]
    kept = outline.filtered_headings(documents.lines(docs(spark, text)), serial=True)
    assert sorted(r["line_no"] for r in kept.collect()) == [0, 1, 2, 10, 11, 12]  # three parts with hyphens look like a product


def test_headings_found_in_units(spark):
    units = spark.createDataFrame([(1, 0, "# A", None), (1, 1, "# B", ["heading"]), (1, 2, "1.\r\nx", ["bold"]), (1, 3, "# C", ["table"]), (1, 4, "Title", []), (1, 5, "===", []), (1, 6, None, None)], "doc_id long, order int, text string, structure array<string>")
    got = {r["order"]: (r["level"], r["structure"]) for r in outline.heading_fallback(units).collect()}
    assert got == {0: (1, ["heading"]), 1: (None, ["heading"]), 2: (1, ["bold", "heading"]), 3: (None, ["table"]), 4: (1, ["heading"]), 5: (None, []), 6: (None, None)}


TEXT = "before\n# Alpha\none\n## Beta\ntwo words here\n### Gamma\nthree\n# Delta\n### Epsilon\nfour"


def test_segments_and_tags(spark):
    found = outline.segments(docs(spark, TEXT, None, "", "plain")).withColumn("path", F.lit("/usr/Reports/2024/test/a-file.md"))
    rows = {(r["doc_id"], r["segment"]): r for r in outline.tagged(found, "path").collect()}
    assert [(k, r["first_line"], r["level"], r["heading"]) for k, r in sorted(rows.items())] == [((0, 0), 0, 0, None), ((0, 1), 1, 1, "Alpha"), ((0, 2), 3, 2, "Beta"), ((0, 3), 5, 3, "Gamma"), ((0, 4), 7, 1, "Delta"), ((0, 5), 8, 3, "Epsilon"), ((3, 0), 0, 0, None)]
    assert rows[0, 3]["ancestors"] == ["Alpha", "Beta"] and rows[0, 5]["ancestors"] == ["Delta"]
    assert rows[0, 3]["struc_tags"] == ["Beta", "Alpha", "Gamma"]
    assert rows[0, 5]["struc_tags"] == ["Beta", "Delta", "Epsilon"]  # the last heading of a level counts, wherever it stands
    assert rows[0, 2]["os_tags"] == ["Reports", "a-file.md"] and rows[0, 2]["contextual_tags"] == ["Reports", "a-file.md", "Alpha", "Beta"]
    assert rows[0, 2]["content_tags"] == ["Beta", "two"] and rows[3, 0]["content_tags"] == []


def test_chunks_follow_the_tree(spark):
    text = "# A\n" + "a" * 40 + "\n## B\n" + "b" * 30 + "\n### C\nc\n### D\nd\n## E\n" + "e" * 20 + "\n### F\nf\n# G\ng\n### H\nh\n# I\ni"
    found = outline.segments(docs(spark, text))
    rows = outline.chunks_by_tree(found, 60).orderBy("chunk").collect()
    assert not rows[0]["by_length"]
    assert [(r["heading"], r["n_segments"], r["struc_tags"]) for r in rows] == [("A", 1, ["A"]), ("B", 3, ["B", "C", "D"]), ("E", 2, ["E", "F"]), ("G", 3, ["G", "I", "H"])]
    assert rows[3]["content"] == "# G\ng\n\n### H\nh\n\n# I\ni" and rows[3]["level"] == 1 and all(len(r["content"]) <= 60 for r in rows)
    whole = outline.chunks_by_tree(found, 10_000).collect()
    assert len(whole) == 1 and whole[0]["n_segments"] == 9


def test_chunks_where_levels_say_little(spark):
    rows = outline.chunks_by_tree(outline.segments(docs(spark, TEXT)), 30).orderBy("chunk").collect()  # two segments at the deepest level
    assert rows[0]["by_length"] and [r["n_segments"] for r in rows] == [2, 1, 2, 1]
    assert outline.chunks_by_tree(outline.segments(docs(spark, None, ""))).count() == 0


def test_prompts(spark):
    df = spark.createDataFrame([(" H ", ["a"], ["b"], "c"), ("", ["a", "b", "c", "d"], [], "c"), (None, [], ["x", "y"], "c"), (None, [], [], "z" * 60), (None, None, None, None)], "h string, s array<string>, c array<string>, t string")
    got = [r[0] for r in df.select(outline.fallback_prompt(F.col("h"), F.col("s"), F.col("c"), F.col("t"))).collect()]
    assert got == ["H", "a | b | c", "x | y", "z" * 50, ""]
