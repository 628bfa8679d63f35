"""Ranked lexical search with sparse ball trees: the documents of greatest inner product with each item, exactly.

Items are taken in blocks of bounded numbers of terms.  Every document becomes a sparse vector over a block's terms;
vectors are dealt by ranges of their leading term and length, so that those of one language and size lie together, and every
``TREE`` of them are halved again and again, between two that lie far apart, into a ball tree of its own.  A node has the centroid
of its vectors and the radius that holds them all.

Of the part of an item that a node's vectors can meet at all, inner product with the centroid plus length times radius is at
least every score below; it is rounded up, by more than the arithmetic can be wrong.  First each tree gives its most promising leaf for
each item, which bounds the score of the last rank from below for all trees.  Then every tree is searched best-first until no
open node can reach that score or the tree's own last rank.  Scores at leaves are sums of integers.

Defined results: null and empty texts, and texts without a term, match nothing; terms are compared by 64-bit hashes; very long
texts are read whole; equal scores rank by ascending doc_id, a null doc_id last; repeated documents are ranked each; equal
items (item_id and text) are one item, items of one id and several texts are ranked each; a null item_id is an id; items without
a match have no rows; other columns, whatever their names, are passed by; without documents or items there are no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import words as W
from quadrille.llm.arrow import chunks, lists, ranges
from quadrille.llm.storage import materialize, materialize_at, remove

BEST = 20
TREE, LEAF = 4096, 32  # vectors of a tree, and of a leaf at most
BLOCK_TERMS, BLOCK_ITEMS = 1 << 18, 1 << 12  # of items that are searched at once
SLACK = 1e-9  # relative, far beyond the rounding of sums of doubles
LAST = np.iinfo(np.int64).max  # a null doc_id, where ids are compared


def _counted(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text, their occurrences, and where each text's begin (one more at the end)."""
    parts = [np.unique(words.hash[a:b], return_counts=True) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
    terms, n = (np.concatenate([np.empty(0, kind), *(p[c] for p in parts)]) for c, kind in enumerate((np.uint64, np.int64)))
    return terms, n, np.append(0, np.cumsum([len(p[0]) for p in parts], dtype=np.int64))


def item_terms(items: DataFrame) -> DataFrame:
    """(ik, item_id, terms, n) of each distinct item with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in chunks(b.column(2)):
                terms, n, at = _counted(W.split(data, off, W.ALNUM))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), lists(W.signed(terms), at, pa.int64()), lists(n, at, pa.int64())], names=["ik", "item_id", "terms", "n"])

    kind = items.schema["item_id"].dataType.simpleString()
    keyed = items.select("item_id", "text").distinct().select(F.xxhash64("item_id", "text").alias("ik"), "item_id", "text")
    return keyed.mapInArrow(run, f"ik long, item_id {kind}, terms array<long>, n array<long>").where(F.size("terms") > 0)


def blocks_of(terms: DataFrame) -> tuple[DataFrame, int]:
    """Items with a block each, by hash; blocks are more until each has few items and terms, or one item."""
    size, n = terms.agg(F.sum(F.size("terms")), F.count("*")).first()
    blocks = max(1, -(-(size or 0) * 2 // BLOCK_TERMS), -(-n * 2 // BLOCK_ITEMS))
    while True:
        dealt = terms.withColumn("block", F.pmod(F.xxhash64("ik"), F.lit(blocks)))
        large = dealt.groupBy("block").agg(F.sum(F.size("terms")).alias("t"), F.count("*").alias("n")).where((F.col("n") > 1) & ((F.col("t") > BLOCK_TERMS) | (F.col("n") > BLOCK_ITEMS)))
        if large.isEmpty():
            return dealt, blocks
        blocks *= 2


VECTORS = "doc_id long, n long, lead int, terms array<int>, tf array<int>"


def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Of each row its number of terms, and places and occurrences of those in the sorted ``vocabulary``; lead is the most frequent."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in chunks(b.column(1)):
                words = W.split(data, off, W.ALNUM)
                place = np.minimum(np.searchsorted(known.value, words.hash), len(known.value) - 1)
                hit = known.value[place] == words.hash
                place, first = place[hit].astype(np.uint64), np.append(0, np.cumsum(hit))[words.first]
                terms, tf, at = _counted(W.Words(first, first, place, first))
                lead = [int(terms[x + np.argmax(tf[x:y])]) if y > x else -1 for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [b.column(0).slice(i, j - i), pa.array(words.counts, pa.int64()), pa.array(lead, pa.int32()), lists(terms.astype(np.int32), at, pa.int32()), lists(tf.astype(np.int32), at, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in VECTORS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VECTORS)


def term_weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What an occurrence counts in documents of n terms, of ``n_docs`` with ``total`` terms."""
    m = 75 + 25 * n * n_docs // total
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Rows:
    """Sparse vectors in some order: terms and values of row i from at[i] to at[i + 1]."""

    def __init__(self, at: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        self.at, self.terms, self.values = at, terms, values

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.at)[rows]
        inner = ranges(self.at[:-1][rows], sizes)
        return Rows(np.append(0, np.cumsum(sizes)), self.terms[inner], self.values[inner])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Products with a vector; no row is empty."""
        return np.add.reduceat(self.values * dense[self.terms], self.at[:-1])

    def dense(self, row: int, width: int) -> np.ndarray:
        out = np.zeros(width)
        out[self.terms[self.at[row] : self.at[row + 1]]] = self.values[self.at[row] : self.at[row + 1]]
        return out


def tree_order(rows: Rows, width: int, leaf: int = LEAF) -> np.ndarray:
    """Rows so ordered that every halving parts them between two that lie far apart."""
    n = len(rows.at) - 1
    if n <= leaf:
        return np.arange(n)
    length = np.add.reduceat(rows.values**2, rows.at[:-1])
    centre = np.bincount(rows.terms, rows.values, width) / n
    a = rows.dense(int(np.argmax(length - 2 * rows.dot(centre))), width)
    b = rows.dense(int(np.argmax(length - 2 * rows.dot(a))), width)
    order = np.argsort(rows.dot(a - b), kind="stable")
    halves = order[: n // 2], order[n // 2 :]
    return np.concatenate([h[tree_order(rows.take(h), width, leaf)] for h in halves])


class BallTree:
    """Nodes over vectors in tree order: node 2**l - 1 + i is the i-th of the 2**l halvings of level l."""

    def __init__(self, rows: Rows, leaf: int = LEAF) -> None:
        self.n = n = len(rows.at) - 1
        self.depth = 0
        while n >> self.depth > leaf or -(-n // (1 << self.depth)) > leaf:
            self.depth += 1
        self.starts = [[0, n]]
        for _ in range(self.depth):  # as tree_order halves
            old = self.starts[-1]
            self.starts.append([x for a, b in zip(old[:-1], old[1:], strict=True) for x in (a, a + (b - a) // 2)] + [n])
        width, row = int(rows.terms.max()) + 1, np.repeat(np.arange(n), np.diff(rows.at))
        length = np.add.reduceat(rows.values**2, rows.at[:-1])
        nodes, terms, centres, self.radius = [], [], [], []
        for level, starts in enumerate(self.starts):
            of = np.searchsorted(starts, np.arange(n), "right") - 1  # node of each row
            key, inverse = np.unique(of[row] * width + rows.terms, return_inverse=True)
            size = np.diff(starts)
            node = key // width
            centre = np.bincount(inverse, rows.values) / size[node]
            square = np.bincount(node, centre**2, len(size))
            product = np.add.reduceat(rows.values * centre[inverse], rows.at[:-1])
            away = np.maximum(length - 2 * product + square[of], 0) + SLACK * (length + square[of])
            self.radius.append(np.sqrt(np.maximum.reduceat(away, starts[:-1])) * (1 + SLACK))
            nodes.append(node + (1 << level) - 1)
            terms.append(key % width)
            centres.append(centre)
        order = np.argsort(np.concatenate(terms), kind="stable")
        self.nodes, self.centres = np.concatenate(nodes)[order], np.concatenate(centres)[order]
        self.at = np.searchsorted(np.concatenate(terms)[order], np.arange(width + 1))
        self.radius = np.concatenate(self.radius)

    def bounds(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of each node, what no inner product below it exceeds; 0 where none of the terms occurs."""
        ok = terms < len(self.at) - 1
        terms, values = terms[ok], values[ok]
        sizes = self.at[terms + 1] - self.at[terms]
        inner, q = ranges(self.at[terms], sizes), np.repeat(values, sizes)
        met = np.bincount(self.nodes[inner], q * q, len(self.radius))
        most = np.bincount(self.nodes[inner], q * self.centres[inner], len(self.radius)) + np.sqrt(met) * self.radius
        return np.where(met > 0, most * (1 + SLACK) + 1, 0)

    def leaves(self) -> int:
        return (1 << self.depth) - 1

    def span(self, leaf: int) -> tuple[int, int]:
        i = leaf - self.leaves()
        return self.starts[-1][i], self.starts[-1][i + 1]


class Items:
    """A block of items: places of their terms among the block's, and what each term counts."""

    def __init__(self, keys: list[int], terms: list[np.ndarray], n: list[np.ndarray], weight: np.ndarray) -> None:
        self.keys, self.terms = keys, terms
        self.scores = [c * weight[t] for t, c in zip(terms, n, strict=True)]
        self.scale = np.sqrt(weight.astype(np.float64))  # of a term's axis in the balls
        self.scaled = [c * self.scale[t] for t, c in zip(terms, n, strict=True)]
        self.width = len(weight)


def grow(vectors: DataFrame, block: Items, n_docs: int, total: int, tree: int = TREE) -> DataFrame:
    """(ids, at, terms, impacts) of each tree: its vectors in tree order."""
    shared = vectors.sparkSession.sparkContext.broadcast(block.scale)

    def of(batch: pa.Table) -> pa.RecordBatch:
        terms, tf = (np.concatenate([x.flatten().to_numpy() for x in batch.column(c).chunks]) for c in (3, 4))
        sizes = np.concatenate([pc.list_value_length(x).to_numpy() for x in batch.column(3).chunks])
        n = batch.column(1).to_numpy()
        impacts = impact(tf.astype(np.int64), np.repeat(n, sizes), n_docs, total)
        local, place = np.unique(terms, return_inverse=True)
        rows = Rows(np.append(0, np.cumsum(sizes)), place, impacts * shared.value[terms])
        order = tree_order(rows, len(local))
        ids = batch.column(0).combine_chunks().take(pa.array(order))
        sorted_rows = Rows(rows.at, terms, impacts).take(order)
        one = [pa.array([x], t) for x, t in ((sorted_rows.at.astype(np.int32), pa.list_(pa.int32())), (sorted_rows.terms.astype(np.int32), pa.list_(pa.int32())), (sorted_rows.values.astype(np.int32), pa.list_(pa.int32())))]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *one], names=["ids", "at", "terms", "impacts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                some = b.slice(0, tree - n)
                held.append(some)
                n, b = n + some.num_rows, b.slice(some.num_rows)
                if n == tree:
                    yield of(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield of(pa.Table.from_batches(held))

    return vectors.mapInArrow(run, "ids array<long>, at array<int>, terms array<int>, impacts array<int>")


def search(trees: DataFrame, block: Items, floor: dict[int, int] | None, best: int = BEST) -> DataFrame:
    """(ik, doc_id, score): of each tree at most ``best`` rows an item, of at least the item's floor; without floors of one leaf only."""
    shared = trees.sparkSession.sparkContext.broadcast((block, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = shared.value
        for b in batches:
            for r in range(b.num_rows):
                ids, at, terms, impacts = (b.column(c)[r].values for c in range(4))
                id_of = pc.fill_null(ids, LAST).to_numpy()
                at, terms, impacts = at.to_numpy().astype(np.int64), terms.to_numpy(), impacts.to_numpy().astype(np.int64)
                local, place = np.unique(terms, return_inverse=True)
                tree = BallTree(Rows(at, place, impacts * items.scale[terms]))
                where = np.full(items.width, len(local))
                where[local] = np.arange(len(local))
                weight = np.zeros(len(local), np.int64)
                out: list[tuple] = []
                for key, q, score, scaled in zip(items.keys, items.terms, items.scores, items.scaled, strict=True):
                    here = where[q]
                    known = here < len(local)
                    if not known.any():
                        continue
                    bound = tree.bounds(here, scaled)
                    weight[here[known]] = score[known]
                    rows, scores = _best_first(tree, bound, lambda a, z: np.add.reduceat(impacts[at[a] : at[z]] * weight[place[at[a] : at[z]]], at[a:z] - at[a]), id_of, 1 if least is None else least.get(key, 1), best, least is None)  # noqa: B023
                    weight[here[known]] = 0
                    out.append((np.full(len(rows), key), rows, scores))
                if out:
                    keys, rows, scores = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids.take(pa.array(rows)), pa.array(scores, pa.int64())], names=["ik", "doc_id", "score"])

    return trees.mapInArrow(run, "ik long, doc_id long, score long")


def _best_first(tree: BallTree, bound: np.ndarray, score, ids: np.ndarray, least: int, best: int, one_leaf: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows of greatest score, ties by id, that reach ``least``; leaves are scored from the most promising on."""
    rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    heap = [(-bound[0], 0)]
    while heap and -heap[0][0] >= least:
        node = heapq.heappop(heap)[1]
        if node < tree.leaves():
            for below in (2 * node + 1, 2 * node + 2):
                if bound[below] >= least:
                    heapq.heappush(heap, (-bound[below], below))
            continue
        a, z = tree.span(node)
        found = score(a, z)
        ok = np.flatnonzero(found >= least)
        rows, scores = np.append(rows, ok + a), np.append(scores, found[ok])
        if len(rows) >= best:
            order = np.lexsort((ids[rows], -scores))[:best]
            rows, scores = rows[order], scores[order]
            least = max(least, int(scores[-1]))
        if one_leaf:
            break
    return rows, scores


def _search_block(docs: DataFrame, rows: list, best: int, tree: int) -> DataFrame:
    """(ik, doc_id, score, rank) for a block of items, as rows (ik, terms, n) in the driver."""
    spark = docs.sparkSession
    vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in rows]).view(np.uint64))
    found, vectors_path = materialize_at(vectors(docs, vocabulary), "balltree-vectors")
    n_docs, total = found.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many rows as terms
        df[r["term"]] = r["count"]
    places = [np.searchsorted(vocabulary, np.array(r["terms"], np.int64).view(np.uint64)) for r in rows]
    block = Items([r["ik"] for r in rows], places, [np.array(r["n"], np.int64) for r in rows], term_weight(n_docs, df))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs // (4 * tree))
    dealt = found.where("lead >= 0").repartitionByRange(tasks, "lead", "n", "doc_id").sortWithinPartitions("lead", "n")
    trees = materialize(grow(dealt, block, n_docs, total, tree), "balltree-trees")
    remove(spark, vectors_path)
    by_score = Window.partitionBy("ik").orderBy(F.desc("score"))
    seeds = search(trees, block, None, best).select("ik", "score", F.row_number().over(by_score).alias("rank")).where(F.col("rank") <= best)
    floors = {r["ik"]: r["score"] for r in seeds.where(F.col("rank") == best).collect()}  # one row an item
    order = Window.partitionBy("ik").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return search(trees, block, floors, best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, tree: int = TREE) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item, of all whose score is above 0."""
    terms = materialize(item_terms(items), "balltree-items")
    dealt, blocks = blocks_of(terms)
    found = None
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).select("ik", "terms", "n").collect()  # of bounded size
        if rows:
            part = _search_block(docs, rows, best, tree)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return terms.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    return found.join(terms.select("ik", "item_id"), "ik").select("item_id", "rank", "doc_id", "score")
