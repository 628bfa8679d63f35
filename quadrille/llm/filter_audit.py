"""How filters of documents interact, in every order; exact duplicates by compressed tries of whole texts.

Texts are dealt to tasks by ranges whose borders are text prefixes: 16 characters deep, and eight times deeper wherever more distinct
texts than two tasks' share begin alike.  Each task inserts its whole texts in radix tries, whose terminals hold the least id, and
traverses them again for each row's flag.  Within an Arrow batch a small trie comes first: only the rows of least id of each
distinct text travel with their text, so a text that a third of all rows hold is one row for each batch; the other rows are duplicates
already.

Every document's failed filters are a mask of five bits.  Rows are reduced to counts by part and mask (at most 32 for a part), and
all orders of filters are answered from these counts.

Defined results: a null text is the empty text, and empty texts are identical; a null source is the part ''; a row is a duplicate
if a row of smaller doc_id has the same text, so repeated rows of equal id tie and are none by each other; a null doc_id has no
smaller or greater one; labels of a null or unknown id are no labels, and several rows for an id count as one that holds 1 where
any does; very long texts are whole; other columns, whatever their names, are passed by; no documents, no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import words as W
from quadrille.llm.arrow import chunks

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
DEPTH, DEEPER = 16, 8  # characters of a prefix, and how many times more where too many texts share one
RANGES = 4  # ranges for each task
TASK_BYTES = 16 << 20  # of texts that a task's tries hold, about
DUPLICATE = FILTERS.index("E")
FEWEST = 64  # distinct texts under one prefix that a task takes anyway


class RadixTrie:
    """A compressed trie of texts; a node is [label, children by first byte, least id of the text that ends there or None, whether one ends]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None, False]

    def insert(self, text: bytes, of: int | None) -> list:
        """The terminal of a text, which is made if need be; ``of`` counts if it is less than the id there."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            below = node[1].get(text[at])
            if below is None:
                below = node[1][text[at]] = [text[at:], {}, None, False]
                node, at = below, end
                break
            label = below[0]
            if text.startswith(label, at):
                node, at = below, at + len(label)
                continue
            cut = self._common(label, text, at)
            upper = [label[:cut], {label[cut]: below}, None, False]
            below[0] = label[cut:]
            node[1][text[at]] = upper
            node, at = upper, at + cut
        node[3] = True
        if of is not None and (node[2] is None or of < node[2]):
            node[2] = of
        return node

    @staticmethod
    def _common(label: bytes, text: bytes, at: int) -> int:
        """How many bytes of ``label`` stand at ``at``: some, but not all."""
        low, high = 1, min(len(label), len(text) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if text.startswith(label[:middle], at):
                low = middle
            else:
                high = middle - 1
        return low

    def terminals(self) -> Iterator[tuple[bytes, int | None]]:
        """All texts, with their least ids."""
        open_nodes = [(b"", self.root)]
        while open_nodes:
            before, node = open_nodes.pop()
            text = before + node[0]
            if node[3]:
                yield text, node[2]
            open_nodes += [(text, below) for below in node[1].values()]


def failures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 for each text: too few words, too few distinct ones, too many capitals, symbols."""

    def per_text(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(marks))[off])

    words = W.split(data, off, W.PLAIN)
    n = words.counts
    distinct = np.array([len(np.unique(words.hash[a:b])) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)], np.int64)
    capitals, points = per_text((data >= 65) & (data <= 90)), per_text((data & 0xC0) != 0x80)
    symbols = per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
    found = (n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * points, symbols > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(found))


def borders(docs: DataFrame, ranges: int) -> list[bytes]:
    """Sorted text prefixes at which ranges begin: ``ranges`` at most for each depth, as deep as distinct texts need to part."""
    rows, depth, found, share = docs.select(F.coalesce("text", F.lit("")).alias("text")), DEPTH, set(), None
    while True:
        start = F.substring("text", 1, depth)
        distinct = rows.select(start.alias("start"), F.xxhash64("text").alias("whole")).distinct()
        lows = distinct.repartitionByRange(ranges, "start").groupBy(F.spark_partition_id().alias("p")).agg(F.min("start").alias("low"), F.count("*").alias("n")).collect()
        found.update(r["low"].encode() for r in lows)
        share = share or max(FEWEST, 2 * sum(r["n"] for r in lows) // ranges)
        heavy = [r["start"] for r in distinct.groupBy("start").count().where(F.col("count") > share).collect()]  # fewer than ranges
        if not heavy:
            return sorted(found)
        rows, depth = rows.where(start.isin(heavy)), depth * DEEPER


SCANNED = "doc_id long, part string, mask int, range int, text binary"


def scan(docs: DataFrame, starts: list[bytes]) -> DataFrame:
    """Each row with its failures; the text only where the batch holds no smaller id with the same text.

    Rows without text have numbers of ranges below 0, which spread them.
    """
    table = docs.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = np.concatenate([np.empty(0, np.int32), *(failures(data, off) for _, _, data, off in chunks(b.column(2)))])
            ids, texts, trie = b.column(0).to_pylist(), [x.as_py() or b"" for x in b.column(2).cast(pa.large_binary())], RadixTrie()
            ends = [trie.insert(t, d) for t, d in zip(texts, ids, strict=True)]
            more = [d is not None and d > e[2] for d, e in zip(ids, ends, strict=True)]
            place = [-1 - i if m else bisect_right(table.value, t) for i, (t, m) in enumerate(zip(texts, more, strict=True))]
            kept = [None if m else t for t, m in zip(texts, more, strict=True)]
            bits = masks | np.array(more, np.int32) << DUPLICATE
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits), pa.array(place, pa.int32()), pa.array(kept, pa.binary())], names=[f.split()[0] for f in SCANNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, SCANNED)


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole ranges (doc_id, part, mask, range, text): (doc_id, part, mask) with the flag of duplicates."""
    tries: dict[int, RadixTrie] = {}
    held = []
    for b in batches:
        rows = zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True)
        held.append((b.select([0, 1, 2]), [tries.setdefault(r, RadixTrie()).insert(t.as_py(), d) if t.is_valid else None for d, r, t in rows]))
    for b, ends in held:
        more = [e is not None and d is not None and d > e[2] for d, e in zip(b.column(0).to_pylist(), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(b.column(2).to_numpy() | np.array(more, np.int32) << DUPLICATE)], names=["doc_id", "part", "mask"])


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row; bit i is set if it fails the filter FILTERS[i]."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    scanned = scan(docs, borders(docs, RANGES * tasks))
    return scanned.repartition(tasks, "range").mapInArrow(_flag, "doc_id long, part string, mask int")


def counts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail these filters, of them labelled good and toxic."""
    one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    return found.join(told, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))


def in_every_order(counted: DataFrame) -> DataFrame:
    """The audit's rows: for each part, order of the filters and step."""
    orders = ["".join(o) for o in permutations(FILTERS)]
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [(o, k + 1, bit[f], sum(bit[x] for x in o[:k])) for o in orders for k, f in enumerate(o)]
    columns = [F.array(*(F.lit(s[c]) for s in steps)) for c in range(4)]
    rows = counted.select("*", F.posexplode(columns[0]).alias("at", "filter_order"))
    here = rows.withColumns({name: F.element_at(c, F.col("at") + 1) for name, c in zip(("step", "bit", "before"), columns[1:], strict=True)})
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")

    told = here.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"))
    return told.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return in_every_order(counts(masks(docs), labels))
