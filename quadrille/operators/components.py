"""Connected components of links between ids of any ordered type, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import cut


def connected(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for each id in ``links`` (a, b); an id linked with itself is one.

    Each round hangs all neighbours of an id on the least of them, once for greater and once for smaller ones.  Paths shrink by
    half and more, so rounds are few whatever the shape; it ends when the links no longer change.
    """
    ids = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    seen = now.agg(*mark).first()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(root.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        before, seen = seen, now.agg(*mark).first()
        if before == seen:
            return ids.join(now.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
