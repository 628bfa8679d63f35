"""Spans of text: how the scanners return them, their digests, and redaction.

A span has a kind, start and end (code points, end exclusive), and whether a base pattern
found it.  Spans of a text are ordered by start, then by the scanner's order of kinds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.arrow import giving_back

Span = tuple[str, int, int, bool]

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def with_spans(docs: DataFrame, find: Callable[[str], list[Span]], column: str = "spans") -> DataFrame:
    """Add the spans of ``text`` (null: empty); a column of that name is replaced."""
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != column.lower()))
    at = kept.columns.index("text")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find(x or "")] for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _ARROW)], names=[*b.schema.names, column])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"`{column}` {SPANS}"])
    return kept.mapInArrow(run, fields)


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def apart(start: int, end: int, spans: list[Span]) -> bool:
    """Whether no span shares a character with start..end."""
    return all(end <= s[1] or start >= s[2] for s in spans)


def told(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def count_base(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> of base spans, base_sha256, spans."""
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *(count_base(F.col("spans"), k).alias(f"n_{k}") for k in kinds), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact_text(text: str, spans: list[Span], mark: Callable[[str], str]) -> str:
    """Overlapping spans are covered together, by the mark of the first."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], mark(kind)]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, find: Callable[[str], list[Span]], mark: Callable[[str], str] = lambda kind: f"[{kind.upper()}]") -> DataFrame:
    """The same rows with spans of ``text`` replaced, ``n_chars`` (if there) brought in line; null stays null."""
    at = docs.columns.index("text")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x and redact_text(x, find(x), mark) for x in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(run, fields)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


class LeastByHash:
    """The ``size`` distinct texts of least hash among those offered: the same whatever the order, and mergeable."""

    def __init__(self, size: int) -> None:
        self.size, self.held = size, {}

    def offer(self, texts: Iterable[str]) -> None:
        new = [x for x in set(texts) if x not in self.held]
        self.held.update((x, zlib.crc32(x.encode("utf-8", "surrogatepass"))) for x in new)
        if len(self.held) > 2 * self.size:
            self.trim()

    def trim(self) -> list[str]:
        self.held = dict(nsmallest(self.size, self.held.items(), key=lambda x: (x[1], x[0])))
        return list(self.held)


PARTS = 256  # of a kind's words, each cut to the sample before they meet


def least_by_hash(found: DataFrame, sample: int) -> dict[str, list[str]]:
    """{kind: words} of (kind, word, h) rows: at most ``sample`` distinct words of each kind, those of least hash, in one pass.

    Parts of a kind are cut to the sample first, so the task of a kind gets at most ``PARTS`` times the sample however many
    tasks the rows come from.
    """

    def cut(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "word"))).where(F.col("r") <= sample)

    dealt = found.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS))).repartition("kind", "part")
    once = dealt.groupBy("kind", "part", "word").agg(F.min("h").alias("h"))
    ranked = cut(cut(once, "kind", "part").drop("r"), "kind")
    out: dict[str, list[str]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["kind"], r["r"])):
        out.setdefault(r["kind"], []).append(r["word"])
    return out
