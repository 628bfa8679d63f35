"""What several tests of operators share: odd documents, and components by comparing all pairs."""

import random
import re

from pyspark.sql import functions as F

BLANK = r"[^\x20\x09-\x0D]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, docs):
    """With more columns, some named like ones that the operators make."""
    names = ("k", "Sid", "n", "tree", "sketch", "score", "rank", "mask", "part", "pid", "E", "terms", "label")
    return spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", "text", *(F.lit(n).alias(n) for n in names))


def odd_documents():
    """Nulls, empty texts, ties, repeated rows, a very long text and a long word."""
    rng = random.Random(0)
    long = " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randint(0, 999)) for _ in range(30_000))
    return [(None, None), (None, "null id"), (1, ""), (2, None), (3, " \n\t"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b c d e f"), (6, long), (7, "x" * 70_000), (8, "\x00 \U0001f600 é"), (9, long + " more")]


def components_of(docs, sets, alike):
    """(doc_id, size, least id of the component) of each document; ``alike`` judges two sizes and the size of the intersection."""
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and alike(len(sets[i]), len(sets[j]), len(sets[i] & sets[j])):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]
