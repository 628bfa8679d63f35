"""The equation language: vectors with known answers, and random expressions against Python's own arithmetic."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.plans import equation as E

COLUMN = [238.8, 237.6, 238.8, 1.2, 237.6]
VECTORS = [
    (COLUMN, "$0", "$2", True), (COLUMN, "$1", "$4", True), (COLUMN, "$0 - $1", "$3", True), (COLUMN, "$0 - $1", "$1", False), (COLUMN, "$0 + $2", "$1", False), (COLUMN, "$0 - $3 + $2", "$4", False),
    ([100.0, 50.0, 50.0], "$0 - $1", "$2", True), ([237.6, 238.8, 1.2], "$0 + $2", "$1", True), ([237.6, 238.8, 1.2], "$0 - $2", "$1", False),
    ([-3.0, 9.0], "$0**2", "$1", False), ([-3.0, -9.0], "$0**2", "$1", True), ([-3.0, 9.0], "($0)**2", "$1", True), ([0.00001, 0.00001], "$0", "$1", False), ([1.0, 0.0, 5.0], "$0 / $1", "$2", False), ([1.0, None], "$0", "$1", False), ([7.0, 2.0, 3.0], "$0 // $1", "$2", True),
]


@pytest.mark.parametrize(("values", "left", "right", "expected"), VECTORS)
def test_vectors(spark, values, left, right, expected):
    df = spark.createDataFrame([(values,)], "values array<double>")
    c = E.compile_sides(left, right, E.in_window(F.col("values"), len(values), 1))
    assert df.select(c.ok).first()[0] is expected


def test_tolerances_differ_at_the_edge(spark):
    df = spark.createDataFrame([([1.0, 1.5],)], "values array<double>")
    cell = E.in_window(F.col("values"), 2, 1)
    row = df.select(E.compile_sides("$0", "$1", cell, 0.5).ok, E.compile_sides("$0", "$1", cell, 0.5, strict=True).ok).first()
    assert tuple(row) == (True, False)


def _random(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["$(0,0)", "$(1,0)", "$(2,0)", "2", "0.5", "10"])
    a, b = _random(rng, depth - 1), _random(rng, depth - 1)
    return rng.choice([f"({a}) + {b}", f"({a}) * ({b})", f"({a}) - ({b})", f"({a}) / ({b})", f"-({a})"])


def test_random_expressions_against_python(spark):
    rng = random.Random(5)
    values = [3.25, -2.0, 0.75]
    texts = [_random(rng, 3) for _ in range(80)]
    df = spark.createDataFrame([(values,)], "values array<double>")
    cell = E.in_window(F.col("values"), 3, 1)
    got = df.select(*(E.value(E.parse(t), cell).alias(f"c{i}") for i, t in enumerate(texts))).first()
    for t, x in zip(texts, got, strict=True):
        plain = t
        for i, v in enumerate(values):
            plain = plain.replace(f"$({i},0)", repr(v))
        try:
            expected = eval(plain)  # noqa: S307  our own text
        except ZeroDivisionError:
            assert x is None
            continue
        assert x == pytest.approx(expected)


def test_normal_form_agrees_in_both_languages(spark):
    texts = ["$0 - $1 = $2", "`$ (0, 1) + (1,0) ＝ $3`", "(0,0)+(1,0)=$ (2,0)", "no rule", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", E.normalized(F.col("t"))).collect()
    assert all(E.normalize(t) == n for t, n in rows)


def test_bad_equations_fail_without_error(spark):
    for bad in ("2$(0,0)", "$0 +", "import os", "$(0,0) $(1,0)", "(", "$0 @ $1"):
        with pytest.raises(E.BadEquation):
            E.parse(bad)
    df = spark.createDataFrame([([1.0],)], "values array<double>")
    assert df.select(E.compile_sides("2$0", "$0", E.in_window(F.col("values"), 1, 1)).ok).first()[0] is False


def test_degenerate():
    assert E.degenerate("$0 = $0") == "same sides"
    assert E.degenerate("1 = 2") == "no cells"
    assert E.degenerate("$0 + $1 = $1") == "a cell must be zero"
    assert E.degenerate("$1 - $0 = $1") == "a cell must be zero"
    assert E.degenerate("words") == "no sides"
    assert E.degenerate("$0 + $1 = $2") is None
