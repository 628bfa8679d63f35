"""Text documents: line breaks, splitting, patterns, headings, segments, merging, keywords."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import text as T


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 0, line): every line of each text; an empty text is one line, a null text none."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def paragraphs(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(doc_id, order, paragraph): trimmed parts that aren't empty; none of a blank text."""
    parts = T.parts(F.coalesce("text", F.lit("")), separator)
    return docs.select("doc_id", F.posexplode(parts).alias("order", "paragraph"))


def structure(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, mean_length, kind, strategy): how the lines that aren't blank look, and the way to split that this suggests."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines_of = F.filter(F.transform(F.split(text, "\n"), T.stripped), lambda x: x != "")
    d = docs.select("doc_id", text.alias("text"), lines_of.alias("ls"))
    n = F.size("ls")
    share = lambda p: F.size(F.filter("ls", lambda x: x.rlike(p))) / F.greatest(n, F.lit(1))
    rows, rules = share(T.TABLE_ROW), share(T.TABLE_RULE)
    marked = F.col("text").rlike(r"(?md)^#{1,6}\s+|^[*-]\s+|^[0-9]+\.\s+") & ((share(T.MARKDOWN) > 0.1) | F.col("text").contains("\n\n"))
    length = F.aggregate(F.transform("ls", F.length), F.lit(0), lambda a, x: a + x) / F.greatest(n, F.lit(1))
    gaps = F.regexp_count("text", F.lit("\n\n"))
    kinds = [
        (n == 0, None, "paragraph"), (share(T.CONTACT) > 0.7, "contacts", "line"), (share(T.CONFIG) > 0.5, "config", "line"), ((rules > 0) & (rows > 0.3), "table", "paragraph"),
        (marked & (rows > 0.2), "mixed", "paragraph"), (marked, "structured", "semantic"), ((length < 50) & (n > 10), "short_items", "line"), (gaps > 2, "paragraphs", "paragraph"),
    ]
    kind, strategy = F.lit("general"), F.lit("paragraph")
    for ok, k, s in reversed(kinds):
        kind, strategy = F.when(ok, F.lit(k)).otherwise(kind), F.when(ok, F.lit(s)).otherwise(strategy)
    return d.select("doc_id", n.alias("n_lines"), length.alias("mean_length"), kind.alias("kind"), strategy.alias("strategy"))


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, level, heading) of lines that are headings; none within code fences."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    fenced = F.sum(F.col("line").rlike(T.FENCE).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    all_lines = lines(docs).withColumn("fenced", fenced | F.col("line").rlike(T.FENCE)).withColumn("next", F.lead("line").over(order))
    kind = T.heading_kind(F.col("line"), F.col("next"))
    return all_lines.withColumn("kind", kind).where("kind is not null and not fenced").select("doc_id", "line_no", "kind", T.heading_level(F.col("kind"), F.col("line"), F.col("next")).alias("level"), T.heading_text(F.col("kind"), F.col("line")).alias("heading"))


def heading_path(docs: DataFrame, levels: int = 6) -> DataFrame:
    """(doc_id, line_no, path): for each line the headings above it, those a higher one ends left out."""
    marked = lines(docs).join(headings(docs).select("doc_id", "line_no", "level", "heading"), ["doc_id", "line_no"], "left")
    up = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    found = []
    for k in range(1, levels + 1):
        last = F.max(F.when(F.col("level") == k, F.struct("line_no", "heading"))).over(up)
        reset = F.max(F.when(F.col("level") < k, F.col("line_no"))).over(up)
        found.append(F.when(last.isNotNull() & (reset.isNull() | (last["line_no"] > reset)), last["heading"]))
    return marked.select("doc_id", "line_no", F.array_compact(F.array(*found)).alias("path"))


def _segments(marked: DataFrame, least: int = 0) -> DataFrame:
    """Number runs of lines from one boundary to the next, and join their lines."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    numbered = marked.withColumn("segment", F.sum(F.col("boundary").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    out = numbered.groupBy("doc_id", "segment").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), joined.alias("content"))
    return out.where(F.length("content") >= least)


def log_segments(docs: DataFrame, least: int = 10) -> DataFrame:
    """Log texts, cut before each line that begins with a time."""
    return _segments(lines(docs).withColumn("boundary", F.col("line").rlike(T.TIMESTAMP)), least)


def code_segments(docs: DataFrame, least: int = 50) -> DataFrame:
    """Source texts, cut before each function or class."""
    return _segments(lines(docs).withColumn("boundary", F.col("line").rlike(T.DEFINITION)), least)


def structured_segments(docs: DataFrame, least: int = 50) -> DataFrame:
    """Texts with headings, cut before each."""
    at = headings(docs).select("doc_id", "line_no", F.lit(True).alias("boundary"))
    return _segments(lines(docs).join(at, ["doc_id", "line_no"], "left").withColumn("boundary", F.coalesce("boundary", F.lit(False))), least)


def turn_segments(turns: DataFrame, key: str, order: str, sender: str, text: str) -> DataFrame:
    """Runs of turns of one sender, joined."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.coalesce((F.col(sender) != F.lag(sender).over(w)), F.lit(True)).cast("int")
    numbered = turns.withColumn("_c", change).withColumn("segment", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return numbered.groupBy(key, "segment").agg(F.first(sender).alias(sender), F.count("*").alias("n_turns"), joined.alias("content"))


SEGMENT = "doc_id long, segment int, sender string, content string"


def sender_segments(docs: DataFrame, most: int = 2000, least: int = 10) -> DataFrame:
    """(doc_id, segment, sender, content): lines from one sender's mark to the next one's, cut where they pass ``most`` characters."""
    def cut(text: str | None) -> list[tuple[str | None, str]]:
        out, held, who = [], [], None
        for line in filter(None, (x.strip() for x in (text or "").split("\n"))):
            found = re.search(T.SENDER, line)
            new = found[0] != who if found else bool(held) and sum(map(len, held)) + len(held) + len(line) > most
            if new:
                out.append((who, "\n".join(held)))
                held = []
            held.append(line)
            who = found[0] if found else who
        return [x for x in [*out, (who, "\n".join(held))] if len(x[1]) >= max(least, 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, *x) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, x in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "segment", "sender", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, SEGMENT)


def merge_fixed(parts: DataFrame, size: int, key: str = "doc_id", order: str = "order", text: str = "paragraph") -> DataFrame:
    """Join each ``size`` successive parts."""
    group = F.floor(F.col(order) / size).alias("chunk")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return parts.groupBy(key, group).agg(F.count("*").alias("n_parts"), joined.alias("content"))


def greedy_chunks(lengths: Column, limit: int) -> Column:
    """Number of the chunk of each part, for an array of lengths: a part begins a new chunk where it would not fit."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, n: Column) -> Column:
        fits = (a["used"] + n <= limit) | (a["used"] == 0)
        chunk = F.when(fits, a["chunk"]).otherwise(a["chunk"] + 1)
        return F.struct(F.when(fits, a["used"] + n).otherwise(n).alias("used"), chunk.alias("chunk"), F.concat(a["out"], F.array(chunk)).alias("out"))

    return F.aggregate(lengths, start, step, lambda a: a["out"])


def merge_by_length(docs: DataFrame, limit: int, separator: str = "\n") -> DataFrame:
    """Pack successive parts of each text into chunks of at most ``limit`` characters (longer parts stand alone)."""
    parts = docs.select("doc_id", T.parts(F.coalesce("text", F.lit("")), separator).alias("parts"))
    numbered = parts.withColumn("chunks", greedy_chunks(F.transform("parts", F.length), limit))
    each = numbered.select("doc_id", F.posexplode(F.arrays_zip("chunks", "parts")).alias("order", "x")).select("doc_id", "order", F.col("x.chunks").alias("chunk"), F.col("x.parts").alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "part"))), lambda x: x["part"]), "\n")
    return each.groupBy("doc_id", "chunk").agg(F.count("*").alias("n_parts"), F.sum(F.length("part")).alias("n_chars"), joined.alias("content"))


def merge_by_hierarchy(segments: DataFrame, limit: int) -> DataFrame:
    """Merge segments (doc_id, order, level, content) from the deepest level up while a parent's whole stays within ``limit``."""
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items = [[int(r.order), int(r.level), r.content or ""] for r in rows.sort_values("order").itertuples()]
        for level in sorted({x[1] for x in items}, reverse=True):
            merged: list[list] = []
            for x in items:
                if merged and x[1] == level and merged[-1][1] <= level and len(merged[-1][2]) + 1 + len(x[2]) <= limit:
                    merged[-1][2] += "\n" + x[2]
                else:
                    merged.append(x)
            items = merged
        return pd.DataFrame({"doc_id": key[0], "chunk": range(len(items)), "first_order": [x[0] for x in items], "level": [x[1] for x in items], "content": [x[2] for x in items]})

    return segments.groupBy("doc_id").applyInPandas(one, "doc_id long, chunk int, first_order int, level int, content string")


def keywords(docs: DataFrame, limit: int = 10) -> DataFrame:
    """(doc_id, keywords): the first words of two letters and more, each once whatever its case, as first written."""
    found = docs.select("doc_id", F.posexplode_outer(T.words(F.coalesce("text", F.lit("")))).alias("at", "word"))
    once = found.groupBy("doc_id", F.lower("word").alias("low")).agg(F.min(F.struct("at", "word")).alias("first"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("first.at")))
    ordered = F.array_sort(F.collect_list(F.when(F.col("first.word").isNotNull(), F.col("first"))))
    return ranked.where(F.col("place") <= limit).groupBy("doc_id").agg(F.transform(ordered, lambda x: x["word"]).alias("keywords"))


def distinctive_terms(cells: DataFrame, rows: int, k: int = 15) -> DataFrame:
    """(sheet, chunk, place, term, n) for chunks of ``rows`` rows of (sheet, row, col, raw): values that are rare in the whole sheet.

    Rare is twice at most, or four times from four letters on; rarest and longest first, then as they stand.  A sheet of
    one chunk has none.
    """
    values = cells.select("sheet", "row", "col", F.floor((F.col("row") - 1) / rows).alias("chunk"), T.stripped(F.col("raw")).alias("term")).where("term is not null").where(~T.noise(F.col("term")))
    counts = values.groupBy("sheet", "term").agg(F.count("*").alias("n")).where((F.col("n") <= 2) | ((F.col("n") <= 4) & (F.length("term") >= 4)))
    several = cells.groupBy("sheet").agg(F.max("row").alias("h")).where(F.col("h") > rows).select("sheet")
    rare = values.join(counts, ["sheet", "term"]).join(several, "sheet", "left_semi")
    once = rare.groupBy("sheet", "chunk", F.lower("term").alias("low")).agg(F.min(F.struct("row", "col", "term", "n")).alias("f"))
    place = F.row_number().over(Window.partitionBy("sheet", "chunk").orderBy("f.n", F.desc(F.length("f.term")), "f.row", "f.col"))
    return once.withColumn("place", place).where(F.col("place") <= k).select("sheet", "chunk", "place", "f.term", "f.n")


def decoded(files: DataFrame, codecs: tuple[str, ...] = ("utf-8-sig", "utf-8", "cp950", "big5", "latin-1")) -> DataFrame:
    """(path, codec, text) of binary files (path, content), read with the first codec that fits."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw in b["content"]:
                for c in codecs:
                    try:
                        out.append((c, bytes(raw).decode(c)))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append((None, None))
            yield pd.DataFrame({"path": b["path"], "codec": [c for c, _ in out], "text": [t for _, t in out]})

    return files.select("path", "content").mapInPandas(run, "path string, codec string, text string")
