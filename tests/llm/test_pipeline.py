"""The pipeline's stages on the smallest tables, each against what its operator says of its own input."""

from quadrille.llm import decontamination, language, secret_scan, similarity
from quadrille.llm.storage import materialize, read_table


def test_stages_take_effect(spark, sf):
    import corpus_pipeline as p

    assert [name for name, _ in p.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    docs = read_table(spark, sf, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in p.STAGES:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        kept.append(docs)
    assert all(d.columns == columns for d in kept[:-1])
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[3] == ids[4] == ids[5]

    letters = {r["doc_id"] for r in kept[0].collect() if any(c.isalpha() for c in r["text"] or "")}
    assert ids[1] == letters
    found = similarity.similar_components(kept[1]).collect()
    assert ids[2] == {r["component_id"] for r in found if r["n_shingles"]} | {r["doc_id"] for r in found if not r["n_shingles"]}
    hit = {r["doc_id"] for r in decontamination.contamination(kept[2], read_table(spark, sf, "benchmark")).where("contaminated").collect()}
    assert hit and ids[3] == ids[2] - hit
    assert not any(secret_scan.base_spans(r["text"] or "") for r in kept[4].collect())
    assert kept[4].where("length(text) != n_chars").count() == 0
    packed = kept[5].groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in packed) <= 1024 and language.UNKNOWN == "und"


def test_empty_and_null_documents(spark, sf):
    import corpus_pipeline as p

    start = read_table(spark, sf, "documents")
    for docs in (start.limit(0), start.limit(20).selectExpr("doc_id", "cast(null as string) text", "cast(null as string) lang", "source", "n_chars", "1 as _k", "'x' as _language")):
        for name, stage in p.STAGES:
            docs = materialize(stage(spark, docs, sf), f"test-{name}")
        assert docs.count() == 0


def test_language_stage_rejects_by_score(spark):
    import random

    import corpus_pipeline as p

    r = random.Random(3)
    words = "the of and to in that was his with which this from there were would their people after".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(80, 160))), "en") for i in range(600)]
    odd = {1001: "$%&# " * 120 + "x", 1002: " ".join("".join(r.choice("абвгдежзиклмнопрст") for _ in range(5)) for _ in range(100)), 1003: "1234 " * 100}
    rows += [(i, x, None) for i, x in odd.items()] + [(1004, odd[1002][::-1], "en"), (1005, "Go.", None), (1006, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {x["doc_id"] for x in p.identify_language(spark, docs, "").collect()}
    assert kept == {*range(600), 1005, 1006}
