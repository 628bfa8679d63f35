"""What is known of pictures, put in the place of their placeholders: all placeholders of all texts by one join.

Defined results: null texts stay null; placeholders of unknown pictures, of failed or empty analyses, and numbers with zeros before
them stay as they are; a line that the text holds already isn't put in again; lines themselves aren't searched for placeholders.
Keys of texts are unique, ids of analyses too; no texts, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import text as T

#: The placeholder, the summary of a failure, and the marks of lines.
PLACEHOLDER = r"\[IMAGE_PLACEHOLDER_([0-9]+)\]"
FAILURE = "[圖像說明失敗]"
PICTURE, SUPPLEMENT = "圖像說明", "補充物件內容"


def annotation() -> Column:
    """The line of an analysis (image_id, summary, image_hash, annotation_type, error); null if there is nothing to say."""
    summary, digest = T.stripped(F.col("summary")), F.nullif(T.stripped(F.col("image_hash")), F.lit(""))
    mark = F.when(F.col("annotation_type") == "supplemental_object", SUPPLEMENT).otherwise(PICTURE)
    line = F.concat(F.lit("["), mark, F.lit("|id="), F.col("image_id").cast("string"), F.coalesce(F.concat(F.lit("|hash="), digest), F.lit("")), F.lit("] "), summary, F.lit("\n"))
    return F.when(F.col("error").isNull() & (F.col("summary") != ""), F.when(summary == FAILURE, summary).otherwise(line))


def spliced(texts: DataFrame, analyses: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``texts`` with placeholders of ``text`` replaced, and image_ids, those that were, each once in order."""
    lines = analyses.select(F.col("image_id").cast("string").alias("_id"), annotation().alias("_line")).where("_line is not null")
    whole, number = (F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(g)) for g in (0, 1))
    found = texts.select(key, F.col(text).alias("_text"), F.posexplode(F.arrays_zip(whole.alias("whole"), number.alias("number"))).alias("_at", "_p"))
    known = found.join(lines, F.col("_p.number") == F.col("_id"), "left")
    fresh = F.col("_line").isNotNull() & ~F.contains("_text", F.col("_line"))
    piece = F.struct("_at", F.when(fresh, F.col("_line")).otherwise(F.col("_p.whole")).alias("piece"), F.when(fresh, F.col("_id").cast("long")).alias("id"))
    told = known.groupBy(key).agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    between = F.split(text, PLACEHOLDER)
    pieces = F.transform("_pieces", lambda x: x["piece"])
    joined = F.array_join(F.zip_with(between, F.concat(pieces, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    ids = F.array_distinct(F.filter(F.transform("_pieces", lambda x: x["id"]), lambda x: x.isNotNull()))
    out = texts.join(told, key, "left")
    return out.withColumns({text: F.when(F.col("_pieces").isNull(), F.col(text)).otherwise(joined), "image_ids": F.coalesce(ids, F.array().cast("array<long>"))}).drop("_pieces")
