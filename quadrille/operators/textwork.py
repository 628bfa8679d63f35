"""More work on texts: greedy splitting, keyword replies, repair of encodings, fuzzy names, hierarchy keys, slices."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import text as T


def split_text(docs: DataFrame, limit: int = 1000, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk, content): parts at paragraphs, else lines, else full stops, packed up to a limit.

    The next chunk begins with the last ``overlap`` characters of the one before it.  Each part is emitted once.
    """
    def pieces(text: str) -> list[str]:
        for sign in ("\n\n", "\n", "。"):
            if sign in text:
                return [p.strip() for p in text.split(sign) if p.strip()]
        return [text] if text.strip() else []

    def cut(text: str) -> list[str]:
        out, held = [], ""
        for p in pieces(text):
            for k in range(0, len(p), limit):
                part = p[k : k + limit]
                if held and len(held) + 1 + len(part) > limit:
                    out.append(held)
                    tail = held[-overlap:] if overlap else ""
                    held = tail if len(tail) + 1 + len(part) <= limit else ""
                held = f"{held}\n{part}" if held else part
        return [*out, held] if held else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, x) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, x in enumerate(cut(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, content string")


def keyword_list(text: str | None) -> list[str]:
    """Keywords of a reply: JSON (fenced or with words around), else parted by commas, lines or bars; each once."""
    if not text:
        return []
    found: list[str] = []
    m = re.search(r"(\[[^\[\]]*\]|\{.*\})", re.sub(r"```\w*", "", text), re.DOTALL)
    if m:
        try:
            value = json.loads(m[1])
            value = next((v for v in value.values() if isinstance(v, list)), []) if isinstance(value, dict) else value
            found = [str(x) for x in value]
        except ValueError:
            found = re.findall(r'"([^"]+)"', m[1])
    if not found:
        found = re.split(r"[,\n;|、，]", text)
    seen: dict[str, str] = {}
    for x in (re.sub(r"^[\s\-*\d.]+", "", y).strip() for y in found):
        if x:
            seen.setdefault(x.lower(), x)
    return list(seen.values())


def parsed_keywords(replies: DataFrame, column: str = "reply") -> DataFrame:
    @F.pandas_udf("array<string>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(keyword_list)

    return replies.withColumn("keywords", parse(F.col(column)))


def repaired(docs: DataFrame) -> DataFrame:
    """Undo UTF-8 that was read as Latin-1 or Windows-1252, where that leaves fewer odd letters."""
    def odd(t: str) -> int:
        return len(re.findall("[\u0080-\u009f\ufffd]|Ã.|Â.|â€", t))

    def mend(t: str | None) -> str | None:
        if not t or not odd(t):
            return t
        best = t
        for codec in ("cp1252", "latin-1"):
            try:
                new = t.encode(codec).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if odd(new) < odd(best):
                best = new
        return best

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(mend, na_action="ignore")

    return docs.withColumn("text", F.when(F.col("text").rlike("[\u0080-\u009f\ufffdÃÂâ]"), run(F.col("text"))).otherwise(F.col("text")))


def rtf_cleaned(text: Column) -> Column:
    """Text without control words and groups of a rich-text remnant."""
    for pattern, new in ((r"\\par[d]?\b", "\n"), (r"\\'[0-9a-fA-F]{2}", ""), (r"\\[a-zA-Z]+-?[0-9]* ?", ""), (r"[{}]", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def fuzzy_names(names: DataFrame, known: DataFrame, least: float = 0.3) -> DataFrame:
    """(name, match, score): the known name of greatest cosine of weighted words, if over ``least``; of equals the first.

    Words are two letters and more, weighted by how rare they are in both lists (ln((n + 1) / (df + 1)) + 1); names meet by words that
    both hold.  Each list counts each of its names once.
    """
    def words(df: DataFrame, c: str) -> DataFrame:
        found = F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
        return df.select(F.col(c)).where(F.col(c).isNotNull()).distinct().select(c, F.explode(found).alias("g")).groupBy(c, "g").agg(F.count("*").alias("tf"))

    def weighted(df: DataFrame, c: str) -> DataFrame:
        w = df.join(weight, "g").withColumn("w", F.col("tf") * F.col("idf"))
        norm = w.groupBy(c).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norm, c).select(c, "g", (F.col("w") / F.col("norm")).alias("w"))

    a, b = words(names, "name"), words(known, "known")
    n = F.broadcast(names.select("name").distinct().agg(F.count("name").alias("a")).crossJoin(known.select("known").distinct().agg(F.count("known").alias("b"))))
    both = a.select("g").unionByName(b.select("g")).groupBy("g").agg(F.count("*").alias("df"))
    weight = both.crossJoin(n).select("g", (F.log((F.col("a") + F.col("b") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    wa, wb = weighted(a, "name"), weighted(b, "known").withColumnRenamed("w", "v")
    scored = wa.join(wb, "g").groupBy("name", "known").agg(F.sum(F.col("w") * F.col("v")).alias("score")).where(F.col("score") > least)
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc(F.round("score", 9)), "known"))
    return scored.withColumn("_r", best).where("_r = 1").select("name", F.col("known").alias("match"), "score")


def hierarchy_keys(rows: DataFrame, file: str, sheet: str, terms: str) -> Column:
    """file::sheet::term for each term."""
    return F.transform(F.col(terms), lambda t: F.concat_ws("::", F.col(file), F.col(sheet), t))


def row_slices(cells: DataFrame, slices: DataFrame, strict: bool = False) -> DataFrame:
    """Cells of the rows that (sheet, first, last) keep; sheets without a slice stay whole, ends are cut to the sheet.

    ``strict``: slices that begin below the sheet fail instead of keeping nothing.
    """
    joined = cells.join(slices, "sheet", "left")
    if strict:
        height = cells.groupBy("sheet").agg(F.max("row").alias("h"))
        wrong = slices.join(height, "sheet", "left").where("h is null or first > h or first > last").limit(1).collect()
        if wrong:
            raise ValueError(f"slice outside sheet {wrong[0]['sheet']!r}")
    return joined.where("first is null or row between first and last").select("sheet", "row", "col", "raw")


def key_values(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, key, value): values of the known labels, after a colon in the cell or in the next cells of the row that say something."""
    labels = "|".join(T.LABELS)
    raw = T.stripped(F.col("raw"))
    inline = F.regexp_extract(raw, rf"^({labels})\s*[:：]\s*(.+)$", 1)
    said = T.stripped(F.regexp_extract(raw, rf"^({labels})\s*[:：]\s*(.+)$", 2))
    later = Window.partitionBy("sheet", "row").orderBy("col").rowsBetween(1, Window.unboundedFollowing)
    good = F.when((raw != "") & ~T.noise(raw), raw)
    each = cells.select("sheet", "row", "col", raw.alias("raw"), inline.alias("inline"), said.alias("said"), F.first(good, ignorenulls=True).over(later).alias("next"))
    label = T.stripped(F.regexp_replace("raw", "[：:]+$", ""))
    own = (F.col("inline") != "") & (F.col("said") != "")
    key, value = F.when(own, F.col("inline")).when(label.isin(*T.LABELS), label), F.when(own, F.col("said")).otherwise(F.col("next"))
    return each.select("sheet", "row", "col", key.alias("key"), value.alias("value")).where("key is not null and value is not null").where(~T.noise(F.col("value")))


def sheet_keywords(cells: DataFrame, limit: int = 50) -> DataFrame:
    """(sheet, keywords): labels' values, then part codes and measures, then values with two letters or more, each once whatever its case."""
    raw = T.stripped(F.col("raw"))
    at = lambda rank, i, term: [F.lit(rank).alias("rank"), "row", "col", i, term]

    valued = key_values(cells).select("sheet", *at(1, F.lit(0).alias("i"), F.col("value").alias("term")))
    codes = F.concat(F.regexp_extract_all(raw, F.lit(T.PART_CODE), F.lit(0)), F.regexp_extract_all(raw, F.lit(T.MEASURE), F.lit(0)))
    measured = cells.where("raw is not null").where(~T.noise(raw)).select("sheet", "row", "col", F.posexplode(codes).alias("i", "term")).select("sheet", *at(2, "i", "term"))
    named = cells.where(raw.rlike(r"[\u4e00-\u9fff]|[A-Za-z]{2,}")).select("sheet", *at(3, F.lit(0).alias("i"), raw.alias("term")))
    every = valued.unionByName(measured).unionByName(named).withColumn("term", T.stripped(F.col("term"))).where(~T.noise(F.col("term")))
    once = every.groupBy("sheet", F.lower("term").alias("low")).agg(F.min(F.struct("rank", "row", "col", "i", "term")).alias("first"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("sheet").orderBy("first"))).where(F.col("place") <= limit)
    return ranked.groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["term"]).alias("keywords"))
