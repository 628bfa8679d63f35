"""Exact Jaccard join of word-shingle sets with a forest of signature trees.

Shingles have one order for all: those of a table of frequent ones last, by frequency, then by hash.  Two sets
of enough similarity share a shingle among the first ``n - ceil(0.8 n) + 1`` of either, whatever their sizes,
so the sets that share such a shingle hang in one tree, named after the least of them; a link can't be lost.

In a tree, nodes hold the OR of their sets' token bitmaps and their range of sizes, and the tree is traversed
against itself from the top: a pair of nodes goes if no sets below them can overlap enough.  The first traversal has
small bitmaps only and marks sets that may have a partner (pairs of nodes whose sets are all marked go too).
The second has the whole sets of those that are left; it decides each pair that no bound rules out on the
whole sets, and leaves out pairs of nodes whose sets are all linked already, so a group of copies costs about one comparison
for each.  A tree whose sets don't fit a task is cut in blocks: each block by itself first, then pairs of blocks that
are not yet linked throughout.

Defined results: equal sets are one set; null and empty texts have no set, no links and n_shingles 0; a text with
fewer words than a shingle is one shingle; very long texts are read whole; repeated rows are rows of one set; ties of
ids are one group's; a null doc_id takes the least id of what it is linked with; other columns, whatever their names, are
passed by; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import words as W
from quadrille.llm.arrow import chunks, giving_back, lists
from quadrille.llm.components import components
from quadrille.llm.storage import few_files, fresh, materialize, materialize_at, remove

SHINGLE, PERCENT = 5, 80
FREQUENT = 1 << 18  # most shingles in the table of frequent ones; it orders, so results don't rest on it
HOT = 10  # shingles of this level and more have their sets' least id found by partial sums
FANOUT = 16
BLOCK = 1 << 21  # shingles of a tree that one task holds; a tree of more is cut in blocks
TREE_BYTES = 1 << 26  # bitmaps of a tree
SIEVE = 23  # 2**23 bits of the table that saves rereading sets without a partner
PAIRS = 256  # pairs of nodes that are opened at once


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, sorted distinct shingle hashes, offsets by row) of runs of texts."""
    for i, j, data, off in chunks(column):
        words = W.split(data, off, W.LOWER)
        h, first = W.run_hashes(words, k)
        sets = [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        spans = W.Spans(words.hash)
        for r in np.flatnonzero((words.counts > 0) & (words.counts < k)).tolist():
            sets[r] = W.mix(spans.hash(words.first[r : r + 1], words.first[r + 1 : r + 2]))
        yield i, j, np.concatenate(sets) if sets else h, np.append(0, np.cumsum([len(s) for s in sets]))


def frequent_shingles(docs: DataFrame, k: int = SHINGLE, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that recur within runs of texts, and the binary logarithm of how often: ``most`` at most.

    All documents are counted; a shingle that a run holds once isn't, so that what is counted stays small.
    """

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, sets, _ in shingle_sets(b.column(0), k):
                token, n = np.unique(sets, return_counts=True)
                again = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(token[again])), pa.array(n[again])], names=["token", "n"])

    counted = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("level"))
    counted = materialize(counted, "similarity-frequent")
    levels = {r["level"]: r["count"] for r in counted.groupBy("level").count().collect()}
    least, total = 1 + max(levels, default=0), 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > most:
            break
        least = level
    rows = counted.where(F.col("level") >= least).toPandas()
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], rows["level"].to_numpy(np.uint8)[order]


def levels_of(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 for shingles outside the table."""
    known, level = frequent
    if not len(known):
        return np.zeros(len(tokens), np.uint8)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, level[at], 0)


def prefix_size(n: int) -> int:
    return n - -(-n * PERCENT // 100) + 1


def prefix(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order."""
    size = prefix_size(len(tokens))
    rare = tokens[level == 0][:size]
    return rare if len(rare) == size else tokens[np.lexsort((tokens, level))[:size]]


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of this size."""
    return 1 << max(6, (4 * n - 1).bit_length())


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    """A bit for each token, in 64-bit words."""
    bits = np.zeros(width, bool)
    bits[(tokens >> np.uint64(7)) & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def resized(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap folded or repeated to a number of words; what it says of tokens stays true."""
    if len(bits) > words:
        return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)
    return np.tile(bits, words // len(bits))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")


SETS = "k long, doc_id long, sid long, n_shingles int, keys array<long>, hot array<long>, bits binary"


def _identities(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(W.mix(sets ^ W.BASE), dtype=np.uint64))
    return W.signed(W.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)))


def _listed(parts: list[np.ndarray]) -> pa.ListArray:
    return lists(W.signed(np.concatenate([np.empty(0, np.uint64), *parts])), np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64)), pa.int64())


def scan(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], k: int = SHINGLE) -> DataFrame:
    """Of each row the set's identity, size, first shingles and bitmap."""
    table = docs.sparkSession.sparkContext.broadcast(frequent)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets, at in shingle_sets(b.column(2), k):
                n = np.diff(at)
                level = levels_of(sets, table.value)
                keys, hot, bits = [], [], []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    first = prefix(sets[x:y], level[x:y]) if y > x else sets[:0]
                    often = levels_of(first, table.value) >= HOT
                    keys.append(first[~often])
                    hot.append(first[often])
                    bits.append(bitmap(sets[x:y], width_of(y - x)).tobytes() if y > x else None)
                columns = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(_identities(sets, at), mask=n == 0), pa.array(n, pa.int32()), _listed(keys), _listed(hot), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SETS.split(", ")])

    return _keyed(docs).mapInArrow(run, SETS)


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bit for each leading part of a key: a table of fixed size, at most 2**SIEVE / 64 rows to the driver."""
    rows = keys.select(F.expr(f"shiftrightunsigned(k, {64 - SIEVE + 6})").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(k, {64 - SIEVE}) & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << SIEVE - 6, np.int64)
    table[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table.view(np.uint64)


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(sid, tokens) of the wanted sets (sid, k), each once: of equal sets one row's text is read again."""
    table = docs.sparkSession.sparkContext.broadcast(_sieve(wanted))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - SIEVE)
            ok = table.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)
            for _, _, sets, at in shingle_sets(b.column(1).take(pa.array(np.flatnonzero(ok))), k):
                sid, rows = _identities(sets, at), np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(sid[rows]), _listed([sets[at[r] : at[r + 1]] for r in rows.tolist()])], names=["sid", "tokens"])

    found = _keyed(docs).select("k", "text").mapInArrow(run, "sid long, tokens array<long>")
    return found.join(wanted, "sid", "left_semi").dropDuplicates(["sid"])


def perhaps(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose sid is wanted, and of the others those that a table of 2**SIEVE bits can't tell from them; the table is broadcast."""
    word, bit = F.expr(f"shiftrightunsigned(sid, {64 - SIEVE + 6})"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(sid, {64 - SIEVE}) & 63 as int))")
    table = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumn("word", word).join(F.broadcast(table), "word").where(F.col("bits").bitwiseAND(bit) != 0).select(*rows.columns)


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b that share so many are linked."""
    return 100 * shared >= PERCENT * (a + b - shared)


class SignatureTree:
    """Levels of nodes over sets that are in order; each node has up to FANOUT children below it."""

    def __init__(self, bits: np.ndarray, n: np.ndarray) -> None:
        spare = n - np.minimum(n, np.bitwise_count(bits).sum(1, dtype=np.int64))  # at most so many tokens share a bit with another
        self.levels = [(bits, n, n, spare)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, spare = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))

    def up(self, values: np.ndarray, combine: np.ufunc) -> list[np.ndarray]:
        """What ``combine`` makes of the sets' values, by node of each level."""
        out = [values]
        for level in self.levels[1:]:
            out.append(combine.reduceat(out[-1], np.arange(0, len(out[-1]), FANOUT)))
        return out

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sets below nodes i and j may overlap enough."""
        bits, low, high, spare = self.levels[level]
        ok = (high[i] * 100 >= low[j] * PERCENT) & (high[j] * 100 >= low[i] * PERCENT)
        at = np.flatnonzero(ok)
        step = max(1, (1 << 21) // bits.shape[1])
        for k in range(0, len(at), step):
            some = at[k : k + step]
            p, q = i[some], j[some]
            most = np.bitwise_count(bits[p] & bits[q]).sum(1, dtype=np.int64) + np.minimum(spare[p], spare[q])
            most = np.minimum(most, np.minimum(high[p], high[q]))
            ok[some] = most * (100 + PERCENT) >= PERCENT * (low[p] + low[q])
        return ok

    def heads(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By level, pairs of the first set of each node and the first sets of its other children, if they may overlap enough."""
        size, step = len(self.levels[0][0]), 1
        while step < size:
            other = np.arange(0, size, step)
            other = other[other % (step * FANOUT) > 0]
            first = other - other % (step * FANOUT)
            ok = self.possible(0, first, other)
            yield first[ok], other[ok]
            step *= FANOUT

    def traverse(self, closed: Callable[[int, np.ndarray, np.ndarray], np.ndarray], visit: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Visits pairs of sets that no bound rules out, from the top down, without nodes that are closed by then."""
        work = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        step = np.arange(FANOUT)
        while work:
            level, i, j = work.pop()
            if len(i) > PAIRS and level:
                work += [(level, i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS)]
                continue
            ok = ~closed(level, i, j)
            i, j = i[ok], j[ok]
            ok = self.possible(level, i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if not level:
                apart = i != j
                visit(i[apart], j[apart])
                continue
            p = np.repeat(i[:, None] * FANOUT + step, FANOUT, axis=1).ravel()
            q = np.tile(j[:, None] * FANOUT + step, (1, FANOUT)).ravel()
            size = len(self.levels[level - 1][0])
            fits = (p < size) & (q < size) & ((p < q) | ((p == q) & (level > 1)))
            work.append((level - 1, p[fits], q[fits]))


def marked(bits: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Which sets may have a partner among the others, judged by bitmaps."""
    words = min(max(len(b) for b in bits), 1 << max(0, (TREE_BYTES // 8 // len(bits)).bit_length() - 1))
    tree = SignatureTree(np.stack([resized(b, words) for b in bits]), n)
    mark = np.zeros(len(n), bool)
    for p, q in tree.heads():
        mark[p] = mark[q] = True
    whole = tree.up(mark, np.logical_and)

    def visit(p: np.ndarray, q: np.ndarray) -> None:
        mark[p] = mark[q] = True
        whole[:] = tree.up(mark, np.logical_and)

    tree.traverse(lambda level, i, j: whole[level][i] & whole[level][j], visit)
    return mark


class Linker:
    """Links the sets of one tree; sets of equal label are linked already, sets of equal block aren't compared."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray, block: np.ndarray | None = None) -> None:
        self.sets, self.n, self.block = sets, np.array([len(s) for s in sets], np.int64), block
        width = 1 << max(6, (16 * int(np.median(self.n)) - 1).bit_length())
        width = min(width, 1 << max(6, (TREE_BYTES * 8 // len(sets)).bit_length() - 1))
        self.tree = SignatureTree(np.stack([bitmap(s, width) for s in sets]), self.n)
        self.label, self.links = np.unique(label, return_inverse=True)[1], []
        self._lift()

    def _lift(self) -> None:
        self.low, self.high = self.tree.up(self.label, np.minimum), self.tree.up(self.label, np.maximum)

    def shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many tokens the pairs of sets share; pairs of equal p stand together."""
        out, at = np.empty(len(p), np.int64), np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        for a, z in zip(at.tolist(), np.append(at[1:], len(p)).tolist(), strict=True):
            mine, others = self.sets[p[a]], [self.sets[x] for x in q[a:z].tolist()]
            every = np.concatenate(others)
            same = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            out[a:z] = np.add.reduceat(same, np.append(0, np.cumsum([len(o) for o in others])[:-1]), dtype=np.int64)
        return out

    def decide(self, p: np.ndarray, q: np.ndarray) -> None:
        """Links those of the pairs that are similar, but for pairs that are linked by then."""
        if self.block is not None:
            ok = self.block[p] != self.block[q]
            p, q = p[ok], q[ok]
        each = 1
        while True:
            ok = self.label[p] != self.label[q]
            p, q = p[ok], q[ok]
            if not len(p):
                return
            a, b = np.minimum(self.label[p], self.label[q]), np.maximum(self.label[p], self.label[q])
            order = np.lexsort((q, p, b, a))
            new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
            rank = np.arange(len(p)) - np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
            some = np.zeros(len(p), bool)
            some[order[rank < each]] = True
            x, y = p[some], q[some]
            by = np.argsort(x, kind="stable")
            x, y = x[by], y[by]
            good = similar(self.shared(x, y), self.n[x], self.n[y])
            for u, v in zip(x[good].tolist(), y[good].tolist(), strict=True):
                if self.label[u] != self.label[v]:
                    self.links.append((u, v))
                    self.label[self.label == max(self.label[u], self.label[v])] = min(self.label[u], self.label[v])
            if good.any():
                self._lift()
            p, q, each = p[~some], q[~some], each * 4

    def run(self) -> list[tuple[int, int]]:
        for p, q in self.tree.heads():
            self.decide(p, q)
        self.tree.traverse(lambda level, i, j: np.minimum(self.low[level][i], self.low[level][j]) == np.maximum(self.high[level][i], self.high[level][j]) if level else self.label[i] == self.label[j], self.decide)
        return self.links


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree in the first columns, which are sorted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        values = np.stack([b.column(c).to_numpy() for c in range(keys)], 1)
        cut = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        for x, y in zip(np.append(0, cut).tolist(), np.append(cut, len(values)).tolist(), strict=True):
            if held and [c[0].as_py() for c in held[0].columns[:keys]] != values[x].tolist():
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


@giving_back
def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, sid, n, bits): (tree, sid) of those that may have a partner in the tree."""
    for rows in _groups(batches, 1):
        if len(rows) < 2:
            continue
        rows = rows.take(np.argsort(rows.column(2).to_numpy(), kind="stable"))
        bits = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column(3)]
        kept = rows.select([0, 1]).filter(pa.array(marked(bits, rows.column(2).to_numpy().astype(np.int64)))).combine_chunks()
        yield from kept.to_batches()


@giving_back
def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, i, j, block, sid, label, tokens): links (a, b)."""
    for rows in _groups(batches, 3):
        if len(rows) < 2:
            continue
        sets = [x.values.to_numpy().view(np.uint64) for c in rows.column(6).chunks for x in c]
        order = np.array(sorted(range(len(sets)), key=lambda r: (sets[r][0], len(sets[r]))))
        block, sid, label = (rows.column(c).to_numpy()[order] for c in (3, 4, 5))
        across = rows.column(1)[0].as_py() != rows.column(2)[0].as_py()
        links = Linker([sets[r] for r in order.tolist()], label, block if across else None).run()
        p, q = np.array(links, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[p], sid[q])), pa.array(np.maximum(sid[p], sid[q]))], names=["a", "b"])


def forest(sets: DataFrame) -> DataFrame:
    """(tree, sid, n): sets that share one of their first shingles and a range of sizes hang in the tree of the least of them.

    A set is in the range of its size and in the next, so that sets close enough to be linked share one.  The rows of a
    shingle are shuffled once, but for hot shingles: their trees are as few as their table, found by partial sums and broadcast.
    """
    size = F.floor(F.log(F.col("n")) / F.lit(1.000001 * math.log(100 / PERCENT))).cast("int")

    def least(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.min("sid").alias("tree"), F.max("sid").alias("last")).where("tree < last").drop("last")

    def ranged(rows: DataFrame) -> DataFrame:
        return rows.select("sid", "n", "key", F.explode(F.array(size, size + 1)).alias("size"))

    rare = sets.select("sid", "n", F.explode("keys").alias("key")).repartition("key")
    rare = ranged(rare.join(least(rare, "key").select("key").hint("merge"), "key"))
    alike = Window.partitionBy("key", "size")  # rows of a key lie together already
    rare = rare.withColumn("tree", F.min("sid").over(alike)).withColumn("last", F.max("sid").over(alike)).where("tree < last")
    hot = ranged(sets.select("sid", "n", F.explode("hot").alias("key")))
    hot = hot.join(F.broadcast(least(hot, "key", "size")), ["key", "size"])
    return rare.select("tree", "sid", "n").unionByName(hot.select("tree", "sid", "n")).distinct()


def _linked(placed: DataFrame, whole: DataFrame) -> DataFrame:
    """Links within groups (tree, i, j) of rows (tree, i, j, block, sid, label)."""
    ready = placed.join(whole, "sid").select("tree", "i", "j", "block", "sid", "label", "tokens")
    return ready.repartition("tree", "i", "j").sortWithinPartitions("tree", "i", "j").mapInArrow(_link, "a long, b long").distinct()


def similar_components(docs: DataFrame, k: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(k, doc_id, n_shingles, component, component_id) of each row; k is a hash of the row's id and text, component of linked sets."""
    spark = docs.sparkSession
    scanned, scan_path = materialize_at(scan(docs, frequent_shingles(docs, k), k), "similarity-scan")
    picked = {"least": F.min("doc_id"), "k": F.first("k"), "n": F.first("n_shingles"), "keys": F.first("keys"), "hot": F.first("hot"), "bits": F.first("bits")}
    sets, sets_path = materialize_at(scanned.where("sid is not null").groupBy("sid").agg(*(c.alias(name) for name, c in picked.items())), "similarity-sets")
    rows = scanned.count()
    scanned = materialize(few_files(scanned.select("k", "doc_id", "sid", "n_shingles"), rows), "similarity-rows")
    remove(spark, scan_path)  # shingles and bitmaps are in the sets now
    hung = materialize(forest(sets), "similarity-forest")
    hung = hung.join(hung.groupBy("tree").agg(F.sum("n").alias("total")), "tree")
    fit, blocks = F.col("total") <= block, F.ceil(F.col("total") / block).cast("int").alias("blocks")
    small = hung.where(fit).join(sets.select("sid", "bits").hint("merge"), "sid").select("tree", "sid", "n", "bits").repartition("tree").sortWithinPartitions("tree").mapInArrow(_mark, "tree long, sid long")
    left = materialize(small.withColumn("blocks", F.lit(1)).unionByName(hung.where(~fit).select("tree", "sid", blocks)), "similarity-left")

    sets = materialize(few_files(sets.select("sid", "least", "k"), rows), "similarity-names")
    remove(spark, sets_path)

    def whole(of: DataFrame) -> DataFrame:
        return whole_sets(docs, of.select("sid").distinct().join(sets.select("sid", "k"), "sid"), k)

    placed = left.withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    alone = placed.select("tree", F.col("block").alias("i"), F.col("block").alias("j"), "block", "sid", F.col("sid").alias("label"))
    links = materialize(few_files(_linked(alone, whole(alone)), rows), "similarity-links")
    parts = components(links)

    several = placed.where("blocks > 1")
    if not several.isEmpty():
        known = several.join(parts.withColumnRenamed("id", "sid"), "sid", "left").select("tree", "block", "sid", F.coalesce("component", "sid").alias("label"))
        known = materialize(known, "similarity-blocks")
        range_of = known.groupBy("tree", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        p, q = (range_of.select("tree", F.col("block").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ij")
        mixed = p.join(q, "tree").where("i < j").where(F.least("low_i", "low_j") != F.greatest("high_i", "high_j"))
        sides = mixed.select("tree", "i", "j", F.explode(F.array("i", "j")).alias("block"))
        later = _linked(sides.join(known, ["tree", "block"]).select("tree", "i", "j", "block", "sid", "label"), whole(known))
        parts = components(links.unionByName(materialize(later, "similarity-links")))

    joined = sets.select("sid", "least").join(parts.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = joined.join(smallest, "component").select("sid", "component", "component_id")
    told = scanned.select("k", "doc_id", "sid", "n_shingles").join(of_set, "sid", "left")
    return told.select("k", "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` but for all of a component save the one of least id; rows without a set stay."""
    found = similar_components(docs, shingle)
    k, once, n = fresh(docs, "_k"), fresh(docs, "_once"), fresh(docs, "_n")
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "k")).alias("first")).select(F.col("first.k").alias(k), F.lit(True).alias(once))
    rest = found.where("component is null").select(F.col("k").alias(k), F.lit(False).alias(once)).distinct()
    kept = docs.withColumn(k, F.xxhash64("doc_id", "text")).join(first.unionByName(rest), k)
    numbered = kept.withColumn(n, F.row_number().over(Window.partitionBy(k).orderBy(k)))
    return numbered.where((F.col(n) == 1) | ~F.col(once)).select(*(F.col(f"`{c}`") for c in docs.columns))
