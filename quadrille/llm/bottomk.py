"""Near duplicates by bottom-k sketches of one hash function.

A set's sketch is its ``SKETCH`` least shingle hashes.  Of two sets of similarity ``PERCENT`` or more, the sketches share
``needed(n)`` values, whatever their sizes: for sets that the sketch holds whole that is certain; beyond, the number of shared
values among the least ``SKETCH`` of the union is hypergeometric, and fewer than ``LEAST`` have a chance below 4e-11 at exactly the
threshold and less above it.

Retained values are posted in inverted lists.  A value that stands in one list alone can't be shared, so a set with fewer than
``needed`` recurring values is done with; of the others only the rarest ``recurring - needed + 1`` are looked at, as sets that share
``needed`` values share one of those.  Sets of one such list and range of sizes meet under the least of them.  There the
estimate from the union's sketch comes first, and the exact similarity of whole sets decides; sets that are linked by then are not
compared, so a group of copies costs about one comparison for each.

Values that thousands of sets hold come last, in order of a count by partial sums; their rows don't meet for it.  Sets under one least
set that don't fit a task are cut in blocks: each block by itself, then pairs of blocks that aren't linked throughout.

Defined results: equal sets are one set; null and empty texts have no set, no links and n_shingles 0; a text with
fewer words than a shingle is one shingle; very long texts are read whole; repeated rows are rows of one set and equal ids
tie; a null doc_id takes the least id of what it is linked with, null if there is none, and is kept where that is null; other
columns, whatever their names, are passed by; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.components import components
from quadrille.llm.similarity import _groups, _identities, _listed, perhaps, shingle_sets, whole_sets
from quadrille.llm.storage import materialize, materialize_at, remove

SHINGLE, PERCENT = 3, 85
SKETCH, LEAST = 96, 53
OFTEN = 1 << 10  # a value that recurs so often within runs of sets is a hot one
HOT = 1 << 18  # most hot values; they are broadcast
BLOCK = 1 << 21  # shingles of sets that meet in one task
NONE = np.iinfo(np.int64).max  # fills sketches of small sets


def needed(n: Column) -> Column:
    """How many values a set's sketch shares at least with that of a set it is linked with."""
    lost = F.greatest(F.lit(0), F.floor(n * 100 / PERCENT).cast("int") - SKETCH)  # of a larger partner, beyond its sketch
    return F.when(n <= SKETCH, F.ceil(n * PERCENT / 100).cast("int") - lost).otherwise(LEAST)


def scan(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(k, doc_id, sid, n, sketch) of each row; sid is null without a set, k finds the row again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets, at in shingle_sets(b.column(2), k):
                n = np.diff(at)
                sketch = _listed([sets[x : min(y, x + SKETCH)] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                columns = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(_identities(sets, at), mask=n == 0), pa.array(n, pa.int32()), sketch]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "doc_id", "sid", "n", "sketch"])

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(run, "k long, doc_id long, sid long, n int, sketch array<long>")


def hot_values(sets: DataFrame, often: int = OFTEN, most: int = HOT) -> DataFrame:
    """(value, level): values that recur ``often`` within batches of sketches, ``most`` at most, the most frequent powers of two of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, n = np.unique(b.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value[n > 1]), pa.array(n[n > 1])], names=["value", "n"])

    counted = sets.select("sketch").mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= often)
    counted = materialize(counted.select("value", F.floor(F.log2("n")).cast("int").alias("level")), "bottomk-hot")
    least, total = 63, 0
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counted.where(F.col("level") >= least)


def lists(sets: DataFrame, often: int = OFTEN) -> DataFrame:
    """(tree, sid, n): sets (sid, n, sketch) that share one of their rarest recurring values and a range of sizes, under the least of them.

    A set is in the range of its size and in the next, so that sets close enough to be linked share one.
    """
    posted = sets.select("sid", F.explode("sketch").alias("value"))
    known = F.broadcast(hot_values(sets, often))
    marked = posted.join(known, "value", "left").withColumn("own", F.when(F.col("level").isNotNull(), F.col("sid")))  # rows of hot values don't meet
    told = marked.withColumn("df", F.count("*").over(Window.partitionBy("value", "own"))).where("level is not null or df > 1")
    order = F.struct(F.coalesce(F.col("level") + 1, F.lit(0)).alias("level"), "df", "value")  # one for all sets; hot values last
    recurring = told.groupBy("sid").agg(F.sort_array(F.collect_list(order)).alias("at"))  # at most SKETCH a set
    spare = F.size("at") - needed(F.col("n")) + 1
    size = F.floor(F.log(F.col("n")) / F.lit(1.000001 * math.log(100 / PERCENT))).cast("int")
    looked = recurring.join(sets.select("sid", "n"), "sid").where(spare > 0).select("sid", "n", F.explode(F.slice("at", 1, spare)).alias("at"))
    looked = materialize(looked.select("sid", "n", F.col("at.value").alias("value"), F.explode(F.array(size, size + 1)).alias("size")), "bottomk-lists")
    least = looked.groupBy("value", "size").agg(F.min("sid").alias("tree"), F.max("sid").alias("last")).where("tree < last").drop("last")
    return looked.join(least, ["value", "size"]).select("tree", "sid", "n").distinct()


class Sketches:
    """Sketches of some sets that meet, as rows of equal length, in order of size."""

    def __init__(self, sketches: list[np.ndarray], n: np.ndarray) -> None:
        self.n, self.rows = n, np.full((len(n), SKETCH), NONE, np.uint64)
        for row, s in zip(self.rows, sketches, strict=True):
            row[: len(s)] = s
        self.last = np.searchsorted(n, n * 100 // PERCENT, "right")  # larger sets are too large

    def likely(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that the sketch of the union with set i doesn't rule out."""
        mine, theirs = self.rows[i], self.rows[others]
        own = mine[: min(int(self.n[i]), SKETCH)]
        place = np.searchsorted(own, theirs)
        same = (own[np.minimum(place, len(own) - 1)] == theirs) & (np.arange(SKETCH) < self.n[others, None])
        both = np.cumsum(same, 1)
        rank = place + np.arange(1, SKETCH + 1) - both + same  # of each of their values in the union, from 1
        shared = (same & (rank <= SKETCH)).sum(1)
        whole = (self.n[others] <= SKETCH) & (self.n[i] <= SKETCH)
        exact = 100 * both[:, -1] >= PERCENT * (self.n[i] + self.n[others] - both[:, -1])
        return others[np.where(whole, exact, shared >= LEAST)]


def marked(sketches: Sketches) -> np.ndarray:
    """Which sets may have a partner; sets that are marked already are not compared with each other."""
    mark = np.zeros(len(sketches.n), bool)
    for i, last in enumerate(sketches.last.tolist()):
        others = np.arange(i + 1, last)
        if mark[i]:
            others = others[~mark[i + 1 : last]]
        if len(others) and len(found := sketches.likely(i, others)):
            mark[i] = mark[found] = True
    return mark


def linked(sets: list[np.ndarray], label: np.ndarray, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of sets in order of size; sets of equal label are linked already, sets of equal block aren't compared."""
    n, label, links = np.array([len(s) for s in sets], np.int64), label.copy(), []
    sketches = Sketches([s[:SKETCH] for s in sets], n)
    for i, last in enumerate(sketches.last.tolist()):
        others = np.arange(i + 1, last)
        apart = label[others] != label[i]
        if block is not None:
            apart &= block[others] != block[i]
        others = others[apart]
        if not len(others):
            continue
        mine = sets[i]
        for j in sketches.likely(i, others).tolist():
            if label[j] == label[i]:
                continue
            shared = int((mine[np.minimum(np.searchsorted(mine, sets[j]), len(mine) - 1)] == sets[j]).sum())
            if 100 * shared >= PERCENT * (len(mine) + len(sets[j]) - shared):
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, sid, n, sketch): (tree, sid) of those that may have a partner there."""
    for rows in _groups(batches, 1):
        if len(rows) < 2:
            continue
        rows = rows.take(np.argsort(rows.column(2).to_numpy(), kind="stable"))
        found = marked(Sketches([x.values.to_numpy().view(np.uint64) for x in rows.column(3)], rows.column(2).to_numpy().astype(np.int64)))
        yield from rows.select([0, 1]).filter(pa.array(found)).combine_chunks().to_batches()


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, i, j, block, sid, label, tokens): links (a, b)."""
    for rows in _groups(batches, 3):
        if len(rows) < 2:
            continue
        sets = [x.values.to_numpy().view(np.uint64) for x in rows.column(6)]
        order = np.argsort([len(s) for s in sets], kind="stable")
        block, sid, label = (rows.column(c).to_numpy()[order] for c in (3, 4, 5))
        across = rows.column(1)[0].as_py() != rows.column(2)[0].as_py()
        p, q = np.array(linked([sets[r] for r in order.tolist()], label, block if across else None), np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[p], sid[q])), pa.array(np.maximum(sid[p], sid[q]))], names=["a", "b"])


def _links(placed: DataFrame, whole: DataFrame) -> DataFrame:
    """Links within groups (tree, i, j) of rows (tree, i, j, block, sid, label)."""
    ready = placed.join(whole, "sid").select("tree", "i", "j", "block", "sid", "label", "tokens")
    return ready.repartition("tree", "i", "j").sortWithinPartitions("tree", "i", "j").mapInArrow(_link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, block: int = BLOCK, often: int = OFTEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; one document of each component is kept."""
    spark = docs.sparkSession
    scanned, scan_path = materialize_at(scan(docs, k), "bottomk-scan")
    sets, sets_path = materialize_at(scanned.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("k", "n", "sketch"))), "bottomk-sets")
    scanned = materialize(scanned.select("doc_id", "sid", "n"), "bottomk-rows")
    remove(spark, scan_path)
    hung = materialize(lists(sets, often), "bottomk-hung")
    sketched = perhaps(sets.select("sid", "sketch"), hung)
    hung = hung.join(hung.groupBy("tree").agg(F.sum("n").alias("total")), "tree")
    fit, blocks = F.col("total") <= block, F.ceil(F.col("total") / block).cast("int").alias("blocks")
    small = hung.where(fit).join(sketched, "sid").select("tree", "sid", "n", "sketch").repartition("tree").sortWithinPartitions("tree").mapInArrow(_mark, "tree long, sid long")
    left = materialize(small.withColumn("blocks", F.lit(1)).unionByName(hung.where(~fit).select("tree", "sid", blocks)), "bottomk-left")
    sets = materialize(sets.select("sid", "least", "k"), "bottomk-names")
    remove(spark, sets_path)  # sketches are no longer needed

    def whole(of: DataFrame) -> DataFrame:
        return whole_sets(docs, of.select("sid").distinct().join(sets.select("sid", "k"), "sid"), k)

    placed = left.withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    alone = placed.select("tree", F.col("block").alias("i"), F.col("block").alias("j"), "block", "sid", F.col("sid").alias("label"))
    links = materialize(_links(alone, whole(alone)), "bottomk-links")
    parts = components(links)

    several = placed.where("blocks > 1")
    if not several.isEmpty():
        known = several.join(parts.withColumnRenamed("id", "sid"), "sid", "left").select("tree", "block", "sid", F.coalesce("component", "sid").alias("label"))
        known = materialize(known, "bottomk-blocks")
        range_of = known.groupBy("tree", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        p, q = (range_of.select("tree", F.col("block").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ij")
        mixed = p.join(q, "tree").where("i < j").where(F.least("low_i", "low_j") != F.greatest("high_i", "high_j"))
        sides = mixed.select("tree", "i", "j", F.explode(F.array("i", "j")).alias("block"))
        later = _links(sides.join(known, ["tree", "block"]).select("tree", "i", "j", "block", "sid", "label"), whole(known))
        parts = components(links.unionByName(materialize(later, "bottomk-links")))

    joined = sets.join(parts.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("component"))
    of_set = joined.join(joined.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("sid", "component_id")
    told = scanned.join(of_set, "sid", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return told.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
