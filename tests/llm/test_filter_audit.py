"""The audit of filters, against a loop over all orders; tries and borders by themselves."""

import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from quadrille.llm import filter_audit
from tests.llm.brute import BLANK, frame, odd_documents


def failed(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = re.findall(BLANK, t)
        low = [x for x, y in docs if (y or "") == t and x is not None]
        marks = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and any(x < d for x in low)]
        out.append("".join(f for f, m in zip("ABCDE", marks, strict=True) if m))
    return out


def by_loop(docs, sources, labels):
    marks, out = failed(docs), {}
    for part in {s or "" for s in sources}:
        rows = [(d, f) for (d, _), s, f in zip(docs, sources, marks, strict=True) if (s or "") == part]
        removed_of = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                gone = [bool(set(f) & set(order[:k])) for _, f in rows]
                here = [d for (d, f), g in zip(rows, gone, strict=True) if x in f and not g]
                removed_of[x] += len(here)
                kept = sum(x not in f and not g for (_, f), g in zip(rows, gone, strict=True))
                redundant = sum(x in f and g for (_, f), g in zip(rows, gone, strict=True))
                good, toxic = (sum(any(y[c] == 1 for y in labels if y[0] == d and d is not None) for d in here) for c in (1, 2))
                out[part, order, k + 1] = [kept, len(here), redundant, sum(f == x for _, f in rows), good, toxic]
        for key in [k for k in out if k[0] == part]:
            out[key].append(removed_of[key[1][key[2] - 1]])
    return out


def documents():
    rng = random.Random(4)
    docs = [x for x in odd_documents() if len(x[1] or "") < 1000]
    start = "the same opening of many texts " * 20
    for d in range(20, 140):
        w = [rng.choice(["Alpha", "beta", "gamma", "é", "x#"]) + str(rng.randint(0, rng.choice([3, 400]))) for _ in range(rng.choice([3, 49, 50, 60, 90]))]
        docs.append((d, start + " ".join(w[:9]) if d % 3 else " ".join(w)))
    return docs + [(rng.randint(0, 200), rng.choice(docs)[1]) for _ in range(60)]


def test_audit_against_a_loop(spark, monkeypatch):
    docs = documents()
    sources = [None if d is None else ("", "a", "b")[d % 3] for d, _ in docs]
    labels = [(d, d % 2, (d // 2) % 2) for d in range(0, 120)] + [(None, 1, 1), (5, 0, 1), (6, None, None)]
    table = frame(spark, docs).withColumn("source", F.when(F.col("doc_id").isNotNull(), F.element_at(F.array(F.lit(""), F.lit("a"), F.lit("b")), (F.col("doc_id") % 3 + 1).cast("int"))))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(filter_audit, "FEWEST", 2)  # so that borders go deep
    assert max(len(x) for x in filter_audit.borders(table, 16)) > filter_audit.DEPTH
    got = {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in filter_audit.audit(table.repartition(5), told).collect()}
    assert got == by_loop(docs, sources, labels)


def test_masks_of_very_long_texts(spark):
    docs = [*odd_documents(), (20, odd_documents()[-1][1])]
    got = Counter((r["doc_id"], r["mask"]) for r in filter_audit.masks(frame(spark, docs).withColumn("source", F.lit("s"))).collect())
    assert got == Counter((d, sum(1 << "ABCDE".index(x) for x in f)) for (d, _), f in zip(docs, failed(docs), strict=True))


def test_no_documents_no_rows(spark):
    none = frame(spark, []).withColumn("source", F.lit("s"))
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_trie_holds_texts_and_least_ids():
    rng = random.Random(1)
    for _ in range(30):
        trie, least = filter_audit.RadixTrie(), {}
        for _ in range(200):
            text, d = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 7))), rng.choice([None, *range(50)])
            end = trie.insert(text, d)
            known = least.get(text)
            least[text] = d if known is None else known if d is None else min(known, d)
            assert end[2] == least[text]
        assert dict(trie.terminals()) == least


def test_masks_do_not_rest_on_borders(spark):
    docs = documents()
    table = frame(spark, docs).withColumn("source", F.lit("s"))
    found = [sorted(map(repr, filter_audit.masks(table.repartition(n)).collect())) for n in (1, 7)]
    assert found[0] == found[1]
