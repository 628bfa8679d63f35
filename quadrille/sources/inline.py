"""Tables given as text: JSON, Markdown, tab- or comma-separated; parsed row by row on Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.coerce import literal

MATRIX = "array<array<string>>"


def json_matrix(text: Column) -> Column:
    """A list of lists, or an object that holds one as ``table`` or ``data``."""
    plain = F.from_json(text, MATRIX)
    held = F.from_json(text, f"struct<table:{MATRIX},data:{MATRIX}>")
    return F.coalesce(F.when(F.trim(text).startswith("["), plain), held["table"], held["data"])


def markdown_matrix(text: Column) -> Column:
    """Rows between bars; the line under the header goes."""
    rows = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x).startswith("|") & ~F.trim(x).rlike(r"^\|?[\s:|-]+\|?$"))
    return F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def delimited_matrix(text: Column, separator: str) -> Column:
    """Rows of fields; a field in double quotes may hold the separator."""
    rows = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    if separator == "\t":
        return F.transform(rows, lambda x: F.split(x, "\t"))
    field = f'("(?:[^"]|"")*"|[^{separator}]*)(?:{separator}|$)'
    unquote = lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"')
    cut = lambda x: F.regexp_extract_all(F.concat(x, F.lit(separator)), F.lit(field.replace("|$", "")), F.lit(1))
    return F.transform(rows, lambda x: F.transform(cut(x), unquote))


def auto_matrix(text: Column) -> Column:
    """The first of JSON, Markdown, tabs and commas that fits."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[\[{]"), json_matrix(text)).when(t.startswith("|"), markdown_matrix(text)).when(text.contains("\t"), delimited_matrix(text, "\t")).otherwise(delimited_matrix(text, ","))


def cells(tables: DataFrame, text: str = "text", sheet: str = "sheet") -> DataFrame:
    """(sheet, row, col, raw) of each table's cells."""
    rows = tables.select(F.col(sheet).cast("string").alias("sheet"), F.posexplode(auto_matrix(F.col(text))).alias("r", "values"))
    each = rows.select("sheet", "r", F.posexplode("values").alias("c", "raw"))
    return each.select("sheet", (F.col("r") + 1).cast("long").alias("row"), (F.col("c") + 1).alias("col"), "raw")


def literals(found: DataFrame) -> DataFrame:
    return found.withColumn("literal", literal(F.col("raw")))


def separator_of(text: str) -> str:
    """The separator that parts the first lines most evenly; a comma if none does."""
    lines = [x for x in text.splitlines() if x.strip()][:20]
    best, score = ",", 0
    for s in (",", ";", "\t", "|"):
        counts = [x.count(s) for x in lines]
        if counts and min(counts) > 0 and min(counts) * 100 - (max(counts) - min(counts)) > score:
            best, score = s, min(counts) * 100 - (max(counts) - min(counts))
    return best
