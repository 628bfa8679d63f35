"""Near duplicates by bottom-k sketches, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import bottomk
from tests.llm.brute import BLANK, components_of, frame, low, odd_documents


def sets_of(docs, k):
    out = []
    for _, t in docs:
        w = re.findall(BLANK, low(t))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def texts(rng):
    letters = [f"w{i}" for i in range(500)]
    base = [[rng.choice(letters) for _ in range(rng.choice([2, 3, 4, 8, 20, 60, 99, 110, 130, 400]))] for _ in range(20)]
    passage = [f"p{i}" for i in range(300)]
    docs = []
    for d in range(20, 260):
        w = list(rng.choice(base)) if d % 3 else passage + [rng.choice(letters) for _ in range(rng.choice([5, 40, 60, 200]))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            i, o = rng.randrange(len(w)), rng.random()
            w[i : i + 1] = [rng.choice(letters)] if o < 0.5 else [w[i], rng.choice(letters)]
        docs.append((d, rng.choice([" ", "\n"]).join(x.upper() if rng.random() < 0.05 else x for x in w)))
    return docs


@pytest.mark.parametrize(("block", "often"), [(bottomk.BLOCK, bottomk.OFTEN), (900, 4)])
def test_near_duplicates_against_brute_force(spark, block, often):
    docs = [x for x in odd_documents() if len(x[1] or "") < 1000] + texts(random.Random(5))
    sets = sets_of(docs, 3)
    expected = components_of(docs, sets, lambda a, b, both: 100 * both >= 85 * (a + b - both))
    got = bottomk.near_duplicates(frame(spark, docs), block=block, often=often).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(repr, expected))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for d, n, c in expected if n > 300}) < sum(n > 300 for _, n, _ in expected)  # sets beyond a sketch are linked too


def test_no_rows_give_no_rows(spark):
    assert bottomk.near_duplicates(frame(spark, []), often=1).count() == 0


def test_bounds_of_sketches_hold(spark):
    need = dict(spark.range(1, 400).select("id", bottomk.needed(F.col("id").cast("int")).alias("need")).collect())
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        both = np.unique(rng.integers(0, 1 << 62, n))
        size = len(both)
        extra = int(size * 15 / 85)
        own = int(rng.integers(0, extra + 1))
        a = np.sort(np.append(both, rng.integers(0, 1 << 62, own)))
        b = np.sort(np.append(both, rng.integers(0, 1 << 62, extra - own)))
        a, b = sorted((a, b), key=len)
        assert 100 * size >= 85 * (len(a) + len(b) - size)
        shared = len(np.intersect1d(a[: bottomk.SKETCH], b[: bottomk.SKETCH]))
        assert shared >= max(need[len(a)], need[len(b)])
        sketches = bottomk.Sketches([x[: bottomk.SKETCH].astype(np.uint64) for x in (a, b)], np.array([len(a), len(b)]))
        assert sketches.last[0] == 2 and len(sketches.likely(0, np.array([1]))) == 1


def test_the_estimate_is_that_of_the_union():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 62, 500)).astype(np.uint64)
    for share in (0.3, 0.6, 0.75, 0.9):
        b = np.unique(np.append(a[rng.random(len(a)) < share], rng.integers(0, 1 << 62, int(500 * (1 - share))).astype(np.uint64)))
        first, second = sorted((a, b), key=len)
        union = np.union1d(a, b)[: bottomk.SKETCH]
        real = int((np.isin(union, a) & np.isin(union, b)).sum())
        sketches = bottomk.Sketches([x[: bottomk.SKETCH] for x in (first, second)], np.array([len(first), len(second)]))
        assert (len(sketches.likely(0, np.array([1]))) == 1) == (real >= bottomk.LEAST)


def test_hot_values_are_bounded(spark):
    sets = spark.createDataFrame([(i, [1, 2, 3, 100 + i]) for i in range(64)], "sid long, sketch array<long>").repartition(2)
    assert sorted(r["value"] for r in bottomk.hot_values(sets, often=8).collect()) == [1, 2, 3]
    assert bottomk.hot_values(sets, often=8, most=2).count() == 0
