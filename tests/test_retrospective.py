"""Rules of each group on the windows of all groups, against a loop."""

import itertools

import pytest

from quadrille.operators import retrospective

WINDOWS = [("a", [1.0, 2.0, 3.0]), ("a", [1.0, 2.0, 4.0]), ("b", [2.0, 2.0, 4.0]), ("b", [0.0, None, 5.0]), (None, [5.0, 5.0, 10.0]), ("empty", [1.0, 1.0, 1.0])]
NAMED = [("a", "$(0,0)+$(0,1) = $(0,2)"), ("a", " $(0,0)+$(0,1)  = $(0,2) "), ("b", "$(0,0) = $(0,1)"), (None, "$(0,0) = $(0,1)"), ("a", "no rule"), ("b", ""), ("b", None), ("gone", "$(0,0)*2 = $(0,2)")]
HOLD = {"$(0,0)+$(0,1) = $(0,2)": lambda a, b, c: b is not None and a + b == c, "$(0,0) = $(0,1)": lambda a, b, c: a == b, "no rule": lambda *v: False, "$(0,0)*2 = $(0,2)": lambda a, b, c: a * 2 == c}


@pytest.mark.parametrize("compiled", [retrospective.COMPILED, 0])
def test_matrix_is_the_loop(spark, compiled):
    windows = spark.createDataFrame(WINDOWS, "row_name string, values array<double>")
    named = spark.createDataFrame(NAMED, "row_name string, equation string")
    rules = {(g, " ".join(e.split())) for g, e in NAMED if e}
    want = set()
    for (g, e), of in itertools.product(rules, {g for g, _ in WINDOWS}):
        mine = [v for n, v in WINDOWS if n == of]
        valid = sum(HOLD[e](*v) for v in mine)
        if valid or g == of:
            want.add((g, of, g == of, e, valid, len(mine) - valid, len(mine), valid / len(mine)))
    found = retrospective.matrix(windows, named, 1, 3, compiled=compiled)
    assert sorted(map(repr, {tuple(r) for r in found.collect()})) == sorted(map(repr, want)) and found.count() == len(want)
    groups = {r["row_name"]: (r["window_count"], r["total_rules"], r["mean_rate"], r["carried"]) for r in retrospective.by_group(found).collect()}
    assert groups == {"a": (2, 2, 0.25, 1), "b": (2, 1, 0.5, 1), None: (1, 1, 1.0, 1)}


def test_nothing_gives_nothing(spark):
    windows = spark.createDataFrame(WINDOWS, "row_name string, values array<double>")
    named = spark.createDataFrame(NAMED, "row_name string, equation string")
    assert retrospective.matrix(windows.limit(0), named, 1, 3).count() == 0
    assert retrospective.matrix(windows, named.limit(0), 1, 3).count() == 0
    assert retrospective.matrix(windows, named.limit(0), 1, 3, compiled=-1).count() == 0
