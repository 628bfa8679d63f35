"""Ranked search, against scoring every document; bounds and orders of trees by themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quadrille.llm import balltree
from tests.llm.brute import frame, low, odd_documents

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def by_scoring_all(docs, items, best=20):
    counted = [Counter(re.findall(TERM, low(t))) for _, t in docs]
    n = [sum(c.values()) for c in counted]
    n_docs, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counted for t in c)
    out = []
    for item, text in set(items):
        q, found = Counter(re.findall(TERM, low(text))), []
        for (d, _), c, size in zip(docs, counted, n, strict=True):
            if size:
                m = 100 - 25 + (25 * size * n_docs) // total
                s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in q.items() if t in c)
                if s > 0:
                    found.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:best])]
    return sorted(map(repr, out))


def random_documents(rng, n=400):
    topics = [[f"{c}{i}" for i in range(60)] for c in "abcdé"]
    docs = [(d, " ".join(rng.choice(rng.choice(topics) if rng.random() < 0.1 else topics[d % 5]) for _ in range(rng.choice([0, 3, 20, 90])))) for d in range(20, 20 + n)]
    return docs + [(rng.randint(0, 900), rng.choice(docs)[1]) for _ in range(60)], topics


@pytest.mark.parametrize("tree", [balltree.TREE, 70])
def test_ranks_against_scoring_all(spark, tree):
    rng = random.Random(2)
    docs, topics = random_documents(rng)
    docs += odd_documents()
    items = [(None, "a1 b2 b2"), (1, None), (2, "..."), (3, "A1 a1 unknown é7"), (3, "A1 a1 unknown é7"), (3, "alpha1 beta2"), (4, "nowhere"), *((i, " ".join(rng.choice(rng.choice(topics)) for _ in range(rng.choice([1, 4, 30])))) for i in range(5, 30))]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 as ik", "2 as terms")
    got = balltree.ranked(frame(spark, docs), table, tree=tree).collect()
    assert sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in got) == by_scoring_all(docs, items)


def test_many_equal_scores_rank_by_id(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(None, "same words here")] + [(i, "others") for i in range(400, 700)]
    items = [(1, "words"), (2, "words"), (2, "here same")]
    got = balltree.ranked(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), tree=64).collect()
    assert sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in got) == by_scoring_all(docs, items)
    assert {r["doc_id"] for r in got} == set(range(1, 21))


def test_blocks_of_items_are_bounded_and_change_nothing(spark, monkeypatch):
    docs, topics = random_documents(random.Random(3), 100)
    items = [(i, " ".join(topics[i % 5][i : i + 8])) for i in range(30)]
    monkeypatch.setattr(balltree, "BLOCK_TERMS", 40)
    table = spark.createDataFrame(items, "item_id long, text string")
    dealt, blocks = balltree.blocks_of(balltree.item_terms(table).cache())
    assert blocks > 4 and max(r["count"] for r in dealt.groupBy("block").count().collect()) <= 5
    got = balltree.ranked(frame(spark, docs), table).collect()
    assert sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in got) == by_scoring_all(docs, items)


def test_nothing_to_rank(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert balltree.ranked(frame(spark, []), items).count() == 0
    assert balltree.ranked(frame(spark, [(1, "a")]), items.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    for n in (1, 5, 33, 700):
        topic = rng.integers(0, 4, n)
        parts = [np.unique(rng.integers(0, 50, rng.integers(1, 30)) + 40 * t) for t in topic]
        at, terms = np.append(0, np.cumsum([len(p) for p in parts])), np.concatenate(parts)
        rows = balltree.Rows(at, terms, rng.integers(1, 10**6, len(terms)) * np.float64(3.7))
        order = balltree.tree_order(rows, 200, leaf=8)
        assert sorted(order.tolist()) == list(range(n))
        rows = rows.take(order)
        tree = balltree.BallTree(rows, leaf=8)
        closed = 0
        for _ in range(20):
            q = np.unique(rng.integers(0, 60, 6)) + 40 * rng.integers(0, 4)
            values = rng.integers(1, 9, len(q)) * 1.3
            dense = np.zeros(400)
            dense[q] = values
            real, bound = rows.dot(dense), tree.bounds(q, values)
            for level, starts in enumerate(tree.starts):
                for i, (a, z) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                    assert z > a and real[a:z].max() <= bound[(1 << level) - 1 + i]
            seen = []
            found, scores = balltree._best_first(tree, bound, lambda a, z: seen.append(a) or real[a:z].astype(np.int64), np.arange(n), 1, 5, False)  # noqa: B023
            assert sorted(scores.tolist(), reverse=True) == sorted((int(x) for x in real if int(x) >= 1), reverse=True)[:5]
            closed += len(tree.starts[-1]) - 1 - len(seen)
        assert closed or n < 700
