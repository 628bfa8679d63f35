"""Placeholders by hand: side by side, repeated, unknown, and lines that are there already."""

from quadrille.operators import placeholders


def test_splicing(spark):
    p = "[IMAGE_PLACEHOLDER_{}]".format
    analyses = spark.createDataFrame([(1, " one \n", "ab", None, None), (2, "two", " ", "supplemental_object", None), (3, "three", None, None, "failed"), (4, "", None, None, None), (5, "[圖像說明失敗]", "x", None, None), (7, "has " + p(1), None, None, None), (8, None, None, None, None)], "image_id long, summary string, image_hash string, annotation_type string, error string")
    one, two, seven = "[圖像說明|id=1|hash=ab] one\n", "[補充物件內容|id=2] two\n", "[圖像說明|id=7] has " + p(1) + "\n"
    texts = {1: (f"a{p(1)}{p(2)}b{p(1)}", f"a{one}{two}b{one}", [1, 2]), 2: (f"{p(3)}{p(4)}{p(99)}{p('01')}{p(8)}", None, []), 3: (f"{p(5)}.", "[圖像說明失敗].", [5]), 4: (f"{one}{p(1)}", None, []), 5: ("", "", []), 6: (None, None, []), 7: (p(7), seven, [7]), 8: ("$1 \\ plain", None, [])}
    rows = spark.createDataFrame([(k, t[0], "kept") for k, t in texts.items()], "doc_id long, text string, line string")
    got = {r["doc_id"]: (r["text"], r["image_ids"], r["line"]) for r in placeholders.spliced(rows, analyses).collect()}
    assert got == {k: (t[0] if t[1] is None else t[1], t[2], "kept") for k, t in texts.items()}
    assert placeholders.spliced(rows.limit(0), analyses).count() == 0
