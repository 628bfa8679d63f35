"""Small tables between steps are few files, whatever the number of shuffle partitions."""

import importlib

from tests.llm.brute import frame


def files(df):
    return len(df.inputFiles())


def watched(module, monkeypatch, seen):
    def run(df, name, *a, real=module.materialize):
        out = real(df, name, *a)
        seen.setdefault(name, []).append(files(out))
        return out

    monkeypatch.setattr(module, "materialize", run)


def test_links_and_names_are_few_files(spark, monkeypatch):
    seen = {}
    components, similarity = (importlib.import_module(f"quadrille.llm.{x}") for x in ("components", "similarity"))
    watched(components, monkeypatch, seen)
    watched(similarity, monkeypatch, seen)
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = [(d, " ".join(f"w{d % 20}x{i}" for i in range(40)) + (" end" if d % 2 else "")) for d in range(80)]
        got = similarity.similar_components(frame(spark, docs)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, d % 20) for d in range(80)}
    assert set(seen["components"]) == set(seen["similarity-links"]) == set(seen["similarity-names"]) == set(seen["similarity-rows"]) == {1}
