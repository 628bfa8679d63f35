"""What the workers of the pipeline hold, in a batch and when a task is over."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quadrille.llm import arrow, language, similarity


def test_trigram_vectors_are_not_held():
    letters = np.arange(97, 125)
    grams = np.stack(np.meshgrid(letters, letters, letters), -1).reshape(-1, 3)[:15_000]
    counts = np.ones((1, len(grams)), np.float32)
    language.bundled(counts[:, :1], grams[:1], 2048)
    tracemalloc.start()
    try:
        got = language.bundled(counts, grams, 2048)
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 5 << 20  # 30 MB with all vectors held
    a, b, c = (language.letter_vector(x, 2048).astype(int) for x in grams[777].tolist())
    one = np.roll(a, 2) * np.roll(b, 1) * c
    assert (language.gram_vectors(grams, 2048)[777] == one).all() and (language.bundled(counts[:, :1], grams[777:778], 2048)[0] == one).all()
    assert got[0].tolist() == language.gram_vectors(grams, 2048).sum(0, dtype=int).tolist()


def test_tasks_give_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(arrow, "give_back", lambda: given.append(1))
    sets = [np.arange(9), np.arange(9), np.arange(50, 90)]
    rows = pa.RecordBatch.from_arrays([pa.array([1] * 3), pa.array([0] * 3), pa.array([0] * 3), pa.array([0] * 3), pa.array([5, 6, 7]), pa.array([5, 6, 7]), pa.array(sets, pa.list_(pa.int64()))], names=["tree", "i", "j", "block", "sid", "label", "tokens"])
    assert [b.to_pylist() for b in similarity._link(iter([rows]))] == [[{"a": 5, "b": 6}]] and len(given) == 1
    task = similarity._mark(iter([]))
    assert not list(task) and len(given) == 2


def test_batches_are_bounded(spark):
    import corpus_pipeline as p

    @p.in_batches
    def sizes(spark, docs, sf_dir):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

        return docs.mapInArrow(run, "rows long, bytes long")

    got = sizes(spark, spark.range(400).coalesce(1).selectExpr("id", "repeat('x', 100000) as text"), "").collect()
    assert sum(r["rows"] for r in got) == 400 and max(r["bytes"] for r in got) < 2 * p.BATCH and len(got) > 2
    assert all(hasattr(stage, "__wrapped__") for _, stage in p.STAGES)
