"""Connected components of links between long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.storage import few_files, materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in ``links`` (a, b).

    Each round hangs all neighbours of an id on the least of them, once for greater and
    once for smaller ones; it ends when the links no longer change.
    """
    mark = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    now = materialize(few_files(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), links.count()), "components")
    known = now.agg(*mark).first()
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(few_files(small.unionByName(root.select("u", F.col("m").alias("v"))).where("u != v").distinct(), known["n"]), "components")
        before, known = known, new.agg(*mark).first()
        now, done = new, known == before
        if done:
            roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"links still change after {rounds} rounds")
