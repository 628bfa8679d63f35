"""Arithmetic relations among columns (or rows): which two give a third, row by row.

All candidates are conditional sums of one aggregate, in batches that stay within
generated code; the table is read once a batch and never joined with itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SUPPORT, MIN_RATE, TOP = 3, 0.75, 200
AGGREGATES = 200


@dataclass(frozen=True)
class Relation:
    sign: str
    left: str
    right: str
    target: str

    @property
    def formula(self) -> str:
        return f"{self.target} = {self.left} {self.sign} {self.right}"

    def expected(self) -> Column:
        a, b = (F.col(f"`{x}`").cast("double") for x in (self.left, self.right))
        return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[self.sign]


def approx_equal(actual: Column, expected: Column) -> Column:
    return F.abs(actual - expected) <= F.greatest(F.lit(1e-6), F.abs(expected) * 1e-4)


def candidates(columns: list[str], lag: int | None = None) -> list[Relation]:
    """Every pair of columns, both ways where order matters, against every other; ``lag`` keeps columns so far apart."""
    out = []
    for a, b in combinations(columns, 2):
        for t in columns:
            if t in (a, b):
                continue
            if lag is not None and (columns.index(b) - columns.index(a) != lag or columns.index(t) - columns.index(b) != lag):
                continue
            out += [Relation("+", a, b, t), Relation("-", a, b, t), Relation("-", b, a, t), Relation("*", a, b, t), Relation("/", a, b, t), Relation("/", b, a, t)]
    return out


def measure(df: DataFrame, relations: list[Relation]) -> DataFrame:
    """(formula, valid, support) of each relation: rows where all three are there, and rows where it holds."""
    parts = []
    for k in range(0, len(relations), AGGREGATES // 2):
        some = relations[k : k + AGGREGATES // 2]
        sums = []
        for i, r in enumerate(some):
            e, actual = r.expected(), F.col(f"`{r.target}`").cast("double")
            sums += [F.count(F.when(e.isNotNull() & actual.isNotNull(), 1)).alias(f"v{i}"), F.count_if(approx_equal(actual, e)).alias(f"s{i}")]
        one = df.agg(*sums)
        parts.append(one.select(F.explode(F.array(*(F.struct(F.lit(r.formula).alias("formula"), F.lit(r.sign).alias("sign"), F.col(f"v{i}").alias("valid"), F.col(f"s{i}").alias("support")) for i, r in enumerate(some)))).alias("x")).select("x.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detect(df: DataFrame, columns: list[str], axis: str = "column", lag: int | None = None, least: float = MIN_RATE, top: int | None = TOP) -> DataFrame:
    """Relations that hold in most rows, best first: (axis, formula, valid, support, support_rate, confidence)."""
    found = measure(df, candidates(columns, lag)).where((F.col("valid") >= MIN_SUPPORT) & (F.col("support") / F.col("valid") >= least))
    rate = F.col("support") / F.col("valid")
    out = found.select(F.lit(axis).alias("axis"), "formula", "sign", "valid", "support", F.round(rate, 4).alias("support_rate"), F.round(F.least(F.lit(0.99), rate * F.least(F.lit(1.0), F.col("support") / 20)), 4).alias("confidence"))
    return out.orderBy(F.desc("confidence"), F.desc("support_rate"), "axis", "formula").limit(top) if top else out


def violations(df: DataFrame, relation: Relation, order: str = "row", first: int | None = 20) -> DataFrame:
    """Rows where the relation does not hold, in order."""
    e, actual = relation.expected(), F.col(f"`{relation.target}`").cast("double")
    out = df.where(e.isNotNull() & actual.isNotNull() & ~approx_equal(actual, e)).select(F.col(order), e.alias("expected"), actual.alias("actual"), (actual - e).alias("difference"))
    return out.orderBy(order).limit(first) if first else out


def coefficient_rule(df: DataFrame, columns: list[str], coefficients: list[float], tolerance: float = 0.01) -> DataFrame:
    """Add residual and ok: whether the weighted sum of the columns is about zero; nulls and lists of other length never are."""
    if len(columns) != len(coefficients):
        return df.withColumn("residual", F.lit(float("inf"))).withColumn("ok", F.lit(False))
    values = F.array(*(F.col(c).cast("double") for c in columns))
    weights = F.array(*(F.lit(float(x)) for x in coefficients))
    total = F.abs(F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x))
    return df.withColumn("residual", F.coalesce(total, F.lit(float("inf")))).withColumn("ok", F.coalesce(total < tolerance, F.lit(False)))
