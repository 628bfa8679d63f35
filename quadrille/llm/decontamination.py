"""Benchmark decontamination by winnowing.

Of every ``window - gram + 1`` successive k-grams the least hash is kept, on both
sides alike, so any ``window`` shared words share a fingerprint.  Fingerprints of
documents are joined with those of the benchmark, and each hit is extended to the
windows around it that the item really holds.  An item of fewer words is one window,
looked up by its whole hash.

Documents first pass a bit table of fixed size made from the benchmark's fingerprints; it
only saves rows, and whatever it lets through meets the join.

Defined results: null and empty texts have no words and no hits; items without words
never occur; a null item_id counts as the empty string; equal items count one by one; an
empty benchmark hits nothing; repeated rows have equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import words as W
from quadrille.llm.arrow import chunks, giving_back, lists
from quadrille.llm.storage import materialize

WINDOW, GRAM = 10, 5
BITS = 22  # 2**22 bits: half a megabyte, whatever the benchmark's size


def _tagged(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of m words as fingerprints of short items, apart from those of k-grams."""
    return W.mix(h ^ np.uint64(m * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def fingerprints(words: W.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed k-gram hashes of each text, and where each text's begin (one more at the end)."""
    h, first = W.run_hashes(words, gram)
    least = W.window_minima(h, first, window - gram + 1)
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    at = least[new]
    return h[at], np.searchsorted(at, first)


def benchmark_fingerprints(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(ik, m, f): of each item its fingerprints; m is its number of words if less than a window, else 0."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in chunks(b.column(1)):
                words = W.split(data, off, W.ALNUM)
                found, at = fingerprints(words, window, gram)
                parts = [(np.zeros(len(found), np.int32), np.repeat(np.arange(i, j), np.diff(at)), found)]
                for m in range(1, window):
                    h, first = W.run_hashes(words, m)
                    short = np.flatnonzero(words.counts == m)
                    parts.append((np.full(len(short), m, np.int32), short + i, _tagged(h[first[short]], m)))
                m, row, f = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(m), pa.array(W.signed(f))], names=["ik", "m", "f"])

    return items.select("ik", "text").mapInArrow(run, "ik long, m int, f long").distinct()


def _bit_table(found: DataFrame) -> np.ndarray:
    """One bit for each leading part of a fingerprint; at most 2**BITS / 64 rows come to the driver."""
    place = F.shiftrightunsigned("f", 64 - BITS)
    rows = found.select(F.shiftrightunsigned(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(f, {64 - BITS}) & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << BITS - 6, np.int64)
    table[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table.view(np.uint64)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k, doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``docs``."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").withColumn("ik", F.xxhash64("item_id", "text"))
    found = materialize(benchmark_fingerprints(items, window, gram), "benchmark-fingerprints")
    short = sorted(r["m"] for r in found.where("m > 0").select("m").distinct().collect())
    table = spark.sparkContext.broadcast(_bit_table(found))
    fields = "k long, doc_id long, n_words long, found array<long>, text string"

    def passes(f: np.ndarray) -> np.ndarray:
        place = f >> np.uint64(64 - BITS)
        return (table.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    @giving_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in chunks(b.column(2)):
                words = W.split(data, off, W.ALNUM)
                f, first = fingerprints(words, window, gram)
                parts = [(np.repeat(np.arange(j - i), np.diff(first)), f)]
                for m in short:
                    h, first = W.run_hashes(words, m)
                    parts.append((np.repeat(np.arange(j - i), np.diff(first)), _tagged(h, m)))
                kept = [(row[ok], f[ok]) for row, f in parts for ok in (passes(f),)]
                row, f = (np.concatenate(x) for x in zip(*kept, strict=True))
                order = np.argsort(row, kind="stable")
                row, f = row[order], f[order]
                at = np.searchsorted(row, np.arange(j - i + 1))
                text = b.column(2).take(pa.array(np.arange(i, j), mask=np.diff(at) == 0))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(words.counts, pa.int64()), lists(W.signed(f), at, pa.int64()), text], names=["k", "doc_id", "n_words", "found", "text"])

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = materialize(keyed.mapInArrow(scan, fields), "decontamination-scan")
    hits = scanned.select("k", F.explode(F.array_distinct("found")).alias("f")).join(found.select("f", "ik"), "f").select("k", "ik").distinct()
    told = hits.join(items, "ik").groupBy("k").agg(F.collect_list(F.struct("item_id", F.col("text").alias("item"))).alias("items"))
    judged = scanned.where("text is not null").select("k", "text").join(told, "k").mapInArrow(_judge(window), "k long, n_hit long, n_items long, items_sha256 string").dropDuplicates(["k"])
    nothing = hashlib.sha256(b"").hexdigest()
    return scanned.select("k", "doc_id", "n_words").join(judged, "k", "left").select(
        "k", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.lit(nothing)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def hit_words(doc: np.ndarray, item: np.ndarray, window: int) -> np.ndarray:
    """First word, in ``doc``, of each window of ``item`` that it holds (both are words' hashes)."""
    m = min(window, len(item))
    if not m or len(doc) < m:
        return np.empty(0, np.int64)
    runs = [W.run_hashes(W.Words(x, x, x, np.array([0, len(x)])), m)[0] for x in (doc, item)]
    return np.flatnonzero(np.isin(*runs))


def _judge(window: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, items in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                texts = pa.array([text.as_py(), *(x["item"] for x in items)], pa.string())
                ((_, _, data, off),) = chunks(texts, 1 << 62)
                words = W.split(data, off, W.ALNUM)
                doc = words.hash[: words.first[1]]
                change, ids = np.zeros(len(doc) + 1, np.int64), []
                for x, (a, z) in zip(items, zip(words.first[1:-1].tolist(), words.first[2:].tolist(), strict=True), strict=True):
                    at = hit_words(doc, words.hash[a:z], window)
                    if len(at):
                        ids.append(x["item_id"] or "")
                        np.add.at(change, at, 1)
                        np.add.at(change, at + min(window, z - a), -1)
                rows.append((int((np.cumsum(change[:-1]) > 0).sum()), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
            hit, n, sha = list(zip(*rows, strict=True)) or ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["k", "n_hit", "n_items", "items_sha256"])

    return run
