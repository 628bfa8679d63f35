"""Substring deduplication with a log-structured index of fingerprints.

A window is ``width`` consecutive words of a text; a word goes if a window that
covers it begins anywhere else too.  In each window the least hash of its k-word
runs is its anchor (winnowing), so equal windows have equal anchors.  The windows of
one anchor are one stretch of words; its hash is the anchor's span.

A batch of documents becomes an immutable run: (fingerprint, span, n, first), sorted
and bucketed by fingerprint.  Each new run is merge-joined with the runs of earlier batches, bucket
by bucket, which tells the fingerprints that recur; beyond ``RUNS`` runs all are compacted into one.  At the
end only the rows of recurring fingerprints are taken from the runs and verified: spans that occur twice are equal windows all
over; where a fingerprint recurs in other surroundings, the windows of each of its spans are compared one by one.

Defined results: null and empty texts have no words; texts shorter than a window keep
all words; repeated rows lose every word that a window covers; ties of fingerprints are told apart by their windows; very
long texts are read whole; other columns, whatever their names, are passed by; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import words as W
from quadrille.llm.arrow import chunks, lists
from quadrille.llm.storage import materialize, new_path, remove

WIDTH = 35
GRAM = 10  # words in a fingerprint
BUCKET_ROWS, MOST_BUCKETS = 4_000_000, 100_000  # buckets follow the anchors of the input, and are as many as shuffle partitions at least
RUNS = 1  # more runs than these are compacted into one
BATCHES = 2


class Anchors:
    """The anchors of all texts of a chunk: words of first and last window, fingerprint and span; and of each text the first."""

    def __init__(self, words: W.Words, width: int, gram: int) -> None:
        h, first = W.run_hashes(words, gram)
        least = W.window_minima(h, first, width - gram + 1)
        n = np.maximum(words.counts - width + 1, 0)
        ends = np.append(0, np.cumsum(n))
        self.windows = np.repeat(words.first[:-1] - ends[:-1], n) + np.arange(ends[-1])  # first word of each window
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        at = np.flatnonzero(new)
        self.begin, self.n = at, np.diff(np.append(at, len(least)))  # windows of each anchor
        self.first = np.searchsorted(at, ends)
        self.ends = ends
        self.fingerprint = h[least[at]]
        start, last = self.windows[at], self.windows[at + self.n - 1] if len(at) else at
        word = least[at] + (words.first[:-1] - first[:-1])[np.repeat(np.arange(len(n)), np.diff(self.first))]
        self.span = W.mix(W.Spans(words.hash).hash(start, last + width) + (word - start).astype(np.uint64))

    def per_window(self, of_anchor: np.ndarray) -> np.ndarray:
        return np.repeat(of_anchor, self.n)


POSTINGS = "k long, doc_id long, n_words long, kept_sha256 string, fingerprints array<long>, spans array<long>"


def _sha(data: np.ndarray, at: np.ndarray) -> list[str]:
    view = memoryview(np.ascontiguousarray(data))
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def postings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Of each row: its key, and the fingerprints and spans of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in chunks(b.column(2)):
                words = W.split(data, off, W.PLAIN)
                a = Anchors(words, width, gram)
                sha = _sha(*W.joined(data, words, np.ones(len(words.start), bool)))
                columns = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(words.counts, pa.int64()), pa.array(sha), lists(W.signed(a.fingerprint), a.first, pa.int64()), lists(W.signed(a.span), a.first, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in POSTINGS.split(", ")])

    return keyed(docs).mapInArrow(run, POSTINGS)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows of equal key have equal results, so nothing rests on keys being unique."""
    return docs.select(F.xxhash64("doc_id", "text").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of fingerprint and span with their number and least key, so that a common pair leaves a batch as one row."""
    for b in batches:
        f, s = (b.column(c).flatten().to_numpy() for c in (1, 2))
        k = b.column(0).to_numpy()[pc.list_parent_indices(b.column(1)).to_numpy()]
        order = np.lexsort((k, s, f))
        f, s, k = f[order], s[order], k[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        at = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(f[at]), pa.array(s[at]), pa.array(np.diff(np.append(at, len(f)))), pa.array(k[at])], names=["fingerprint", "span", "n", "first"])


RUN = "fingerprint long, span long, n long, first long"


class FingerprintIndex:
    """Sorted immutable runs of (fingerprint, span, n, first), all bucketed alike, and the fingerprints that recurred so far.

    ``runs`` (table names) and ``touched`` (tables of fingerprints) are all its state: handed to a new index of equal
    folder and buckets they let it go on where another ended.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 64, runs: Sequence[str] = (), touched: Sequence[DataFrame] = ()) -> None:
        self.spark, self.buckets = spark, buckets
        self.folder = folder or new_path(spark, "fingerprints")
        self.runs, self.touched = list(runs), list(touched)

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        counted = rows.repartition(self.buckets, "fingerprint").groupBy("fingerprint", "span").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        (counted.write.option("path", f"{self.folder}/{name}").option("compression", "zstd").bucketBy(self.buckets, "fingerprint").sortBy("fingerprint", "span").saveAsTable(name))
        return name

    def take(self, posted: DataFrame) -> DataFrame:
        """Adds a batch's postings as a run; (fingerprint) of those that recur in the batch or that earlier runs hold."""
        new = self._write(posted.select("k", "fingerprints", "spans").mapInArrow(_counted, RUN))
        found = self.spark.table(new).groupBy("fingerprint").agg(F.sum("n").alias("n")).where("n > 1").select("fingerprint")
        for old in self.runs:
            found = found.unionByName(self.spark.table(new).select("fingerprint").join(self.spark.table(old).select("fingerprint").hint("merge"), "fingerprint", "left_semi"))
        met = materialize(found, "fingerprints-met")
        self.touched.append(met)
        self.runs.append(new)
        if len(self.runs) > RUNS:
            self.compact()
        return met.distinct()

    def compact(self) -> None:
        """All runs as one; the old ones go."""
        old, rows = self.runs, self.spark.createDataFrame([], RUN)
        for name in old:
            rows = rows.unionByName(self.spark.table(name))
        self.runs = [self._write(rows)]
        self._remove(old)

    def _remove(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            remove(self.spark, f"{self.folder}/{name}")

    def drop(self) -> None:
        """Ends the index; its tables and files go."""
        self._remove(self.runs)
        self.runs, self.touched = [], []

    def recurring(self) -> DataFrame:
        """(fingerprint, span, n, first) of all fingerprints that recurred, over all runs."""
        rows = self.spark.createDataFrame([], RUN)
        if self.touched:
            met = self.touched[0]
            for more in self.touched[1:]:
                met = met.unionByName(more)
            met = materialize(met.distinct(), "fingerprints-recurring")
            for name in self.runs:
                rows = rows.unionByName(self.spark.table(name).join(met.hint("merge"), "fingerprint", "left_semi"))
        return rows.groupBy("fingerprint", "span").agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    def repeated(self) -> tuple[DataFrame, DataFrame]:
        """(span) of those that occur twice; (k, span, n) of all whose fingerprint has a span that occurs once, and others."""
        rows = materialize(self.recurring(), "fingerprints-rows")
        twice = rows.where("n > 1").select("span")
        per = rows.groupBy("fingerprint").agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1 and least = 1").select("fingerprint")
        return twice, rows.join(per, "fingerprint", "left_semi").select(F.col("first").alias("k"), "span", "n")


def buckets_for(posted: DataFrame) -> int:
    """A bucket is what one task shuffles and writes as one file."""
    anchors = posted.agg(F.sum(F.size("fingerprints"))).first()[0] or 0
    return min(MOST_BUCKETS, max(int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-anchors // BUCKET_ROWS)))


WINDOWS = "h long, k long, n long"


def _texts(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, W.Words, Anchors]]:
    for b in batches:
        for i, j, data, off in chunks(b.column(b.schema.get_field_index("text"))):
            words = W.split(data, off, W.PLAIN)
            yield b, i, j, data, words, Anchors(words, width, gram)


def _values(b: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    x = b.column(b.schema.get_field_index(name))[row]
    return x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else np.empty(0, np.int64)


def deduplicate(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of each row, judged over all rows."""
    spark = docs.sparkSession
    posted = materialize(postings(docs, width, gram), "substrings-postings")
    index = FingerprintIndex(spark, buckets=buckets_for(posted))
    for i in range(batches):
        index.take(posted.where(F.pmod("k", F.lit(batches)) == i))
    twice, doubtful = index.repeated()
    index.drop()

    pairs = posted.select("k", F.explode(F.array_distinct("spans")).alias("span"))
    resolved = pairs.join(twice, "span", "left_semi").groupBy("k").agg(F.collect_set("span").alias("twice"))
    to_check = doubtful.groupBy("k").agg(F.collect_list("span").alias("spans"), F.collect_list("n").alias("ns"))
    wanted = resolved.join(to_check, "k", "full")
    concerned = materialize(keyed(docs).select("k", "text").join(wanted, "k"), "substrings-concerned")

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, _, words, a in _texts(it, width, gram):
            h, _ = W.run_hashes(words, width)
            keys = b.column(b.schema.get_field_index("k"))
            for r in range(i, j):
                spans = _values(b, "spans", r)
                if not len(spans):
                    continue
                own = slice(a.first[r - i], a.first[r - i + 1])
                order = np.argsort(spans)
                found, which = np.unique(W.signed(a.span[own]), return_index=True)
                at = np.minimum(np.searchsorted(spans[order], found), len(spans) - 1)
                hit = spans[order][at] == found
                anchors, n = which[hit] + own.start, _values(b, "ns", r)[order][at[hit]]
                windows = W.signed(h[np.concatenate([np.arange(a.begin[x], a.begin[x] + a.n[x]) for x in anchors.tolist()] or [np.empty(0, np.int64)])])
                yield pa.RecordBatch.from_arrays([pa.array(windows), pa.array(np.full(len(windows), keys[r].as_py(), np.int64)), pa.array(np.repeat(n, a.n[anchors]), pa.int64())], names=["h", "k", "n"])

    windows = materialize(concerned.where("spans is not null").select("k", "text", "spans", "ns").mapInArrow(emit, WINDOWS), "substrings-windows")
    again = windows.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1").select("h")
    late = windows.where("n = 1").select("h", "k").join(again, "h", "left_semi").groupBy("k").agg(F.collect_set("h").alias("windows"))
    final = concerned.drop("spans", "ns").join(late, "k", "left").where("twice is not null or windows is not null")
    fields = "k long, n_removed long, sha string" + ", kept_text string" * with_text

    def remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, data, words, a in _texts(it, width, gram):
            h, _ = W.run_hashes(words, width)
            hit = np.zeros(len(h), bool)
            for r in range(i, j):
                own = slice(a.first[r - i], a.first[r - i + 1])
                part = slice(a.ends[r - i], a.ends[r - i + 1])
                good = np.isin(W.signed(a.span[own]), _values(b, "twice", r))
                hit[part] = np.repeat(good, a.n[own]) | np.isin(W.signed(h[part]), _values(b, "windows", r))
            change = np.zeros(len(words.start) + 1, np.int64)
            begins = a.windows[hit]
            np.add.at(change, begins, 1)
            np.add.at(change, begins + width, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept, at = W.joined(data, words, ~gone)
            total = np.append(0, np.cumsum(gone))[words.first]
            columns = [b.column(b.schema.get_field_index("k")).slice(i, j - i), pa.array(np.diff(total), pa.int64()), pa.array(_sha(kept, at))]
            if with_text:
                raw = kept.tobytes()
                columns.append(pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])

    removed = final.select("k", "text", "twice", "windows").mapInArrow(remove, fields).dropDuplicates(["k"])
    told = posted.select("k", "doc_id", "n_words", "kept_sha256").join(removed, "k", "left")
    out = told.select("k", "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"), *(["kept_text"] if with_text else []))
    return out.drop("k")
