"""Outlines of documents: headings that hold against their surroundings, the tree they span, tags, and chunks along that tree.

All of it is window functions by document and higher-order functions; no document is handled by Python.

Defined results: null texts are empty and have no headings, segments or chunks; levels beyond ``DEEPEST`` count as that;
rows of one doc_id are one document if their lines are numbered apart, so ids are taken as unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import text as T
from quadrille.operators import documents

DEEPEST = 12
NEAR = 5  # lines above a numbered heading among which its parent must stand
#: What the lines above say of lines that only look like headings, what such lines say themselves, and their forms.
WARNED = ("應視為非標題", "誤判風險")
DENIED = ("版本號", "節點代碼", "不是章節標題", "非章節標題", "為步驟概述", "問卷選項", "不是標題", "產品型號", "（只是清單）", "只是枚舉", "只是清單")
FALSE_FORMS = (
    ("cn_chapter", r"^第[一二三四五六七八九十百千0-9]+[章節條款項]為"),
    ("hyphen", r"[0-9]+(?:-[0-9]+)+-[A-Za-z0-9]"),
    ("alpha", rf"^[A-Za-z]\.{T.S}+[A-Za-z]\.{T.S}+[A-Za-z]\."),
    ("cn_numeral", r"^[一二三四五六七八九十]、[一二三四五六七八九十]、[一二三四五六七八九十]"),
)
NUMBERED = ("decimal", "decimal_simple", "hyphen")


def _any(line: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | line.contains(w)
    return out


def _consistent(kind: Column, marker: Column, above: Column) -> Column:
    """Whether a number of several parts has a parent among the markers above: its beginning, or a chapter of its digits."""
    parts = F.split(marker, F.when(kind == "decimal", r"\.").otherwise("-"))
    begins = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.when(kind == "decimal", F.array_join(F.slice(parts, F.lit(1), n), ".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "-")))

    def held(begin: Column) -> Column:
        digits = F.regexp_replace(begin, "[^0-9]", "")
        return F.exists(above, lambda a: (a["kind"].isin(*NUMBERED) & (a["marker"] == begin)) | ((a["kind"] == "cn_chapter") & a["marker"].contains(digits)))

    return F.when(kind.isin("decimal", "hyphen") & (F.size(parts) > 1), F.exists(begins, held)).otherwise(True)


def judged_headings(lines: DataFrame, near: int = NEAR) -> DataFrame:
    """(doc_id, line_no, kind, level, heading, marker, denied, consistent) of lines (doc_id, line_no, line) that look like headings.

    denied says why the surroundings speak against it (warned, phrase, form), or null; consistent is false for numbers of
    several parts whose parent doesn't stand within ``near`` lines above.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    seen = lines.withColumns({"_form": T.heading_form(F.col("line")), "_next": F.lead("line").over(order), "_warns": _any(F.col("line"), WARNED)})
    marked = seen.withColumn("_marker", T.heading_marker(F.col("_form"), F.col("line")))
    fences = F.col("line").rlike(T.FENCE)
    fenced = (F.sum(fences.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1) | fences
    above = F.collect_list(F.when(F.col("_form").isNotNull(), F.struct(F.col("_form").alias("kind"), F.col("_marker").alias("marker")))).over(order.rangeBetween(-near, -1))
    warned = F.coalesce(F.max("_warns").over(order.rowsBetween(-3, -1)), F.lit(False))
    kind = T.heading_kind(F.col("line"), F.col("_next"))
    found = marked.withColumns({"kind": kind, "_fenced": fenced, "_above": above, "_warned": warned}).where("kind is not null and not _fenced")
    line = T.stripped(F.col("line"))
    form = F.lit(False)
    for name, pattern in FALSE_FORMS:
        form = form | ((F.col("kind") == name) & line.rlike(pattern))
    denied = F.when(F.col("_warned"), "warned").when(_any(line, DENIED), "phrase").when(form, "form")
    return found.select(
        "doc_id", "line_no", "kind", T.heading_level(F.col("kind"), F.col("line"), F.col("_next")).cast("int").alias("level"), T.heading_text(F.col("kind"), F.col("line")).alias("heading"),
        F.when(F.col("kind") == F.col("_form"), F.col("_marker")).alias("marker"), denied.alias("denied"), _consistent(F.col("kind"), F.col("_marker"), F.col("_above")).alias("consistent"))


def filtered_headings(lines: DataFrame, serial: bool = False) -> DataFrame:
    """Headings that nothing around them denies; with ``serial`` also without numbers that have no parent above."""
    found = judged_headings(lines).where("denied is null")
    return (found.where("consistent") if serial else found).select("doc_id", "line_no", "kind", "level", "heading")


def heading_fallback(units: DataFrame) -> DataFrame:
    """Units (doc_id, order, text, structure) with level: of units without a heading, table or image, that of the heading their text is.

    A unit is one line, whatever breaks it holds; so a unit of signs alone makes a heading of the one before.  structure is an
    array of kinds; a unit that gets a level gets ``heading`` there too.
    """
    flat = units.select("doc_id", F.col("order").alias("line_no"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("line"))
    found = filtered_headings(flat).select("doc_id", F.col("line_no").alias("order"), F.col("level").alias("_level"))
    free = ~F.arrays_overlap(F.coalesce("structure", F.array().cast("array<string>")), F.array(*map(F.lit, ("heading", "table", "image"))))
    added = units.join(found, ["doc_id", "order"], "left").withColumn("level", F.when(free, F.col("_level"))).drop("_level")
    return added.withColumn("structure", F.when(F.col("level").isNotNull(), F.concat(F.coalesce("structure", F.array().cast("array<string>")), F.array(F.lit("heading")))).otherwise(F.col("structure")))


def segments(docs: DataFrame, serial: bool = False) -> DataFrame:
    """(doc_id, segment, first_line, level, heading, content): the lines from one heading to the next; level 0 and no heading before the first.

    Segments are numbered from 0; those without content are left out.
    """
    lines = documents.lines(docs)
    marked = lines.join(filtered_headings(lines, serial), ["doc_id", "line_no"], "left")
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cut = marked.withColumn("_run", F.count("kind").over(order))
    joined = T.stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"))
    out = cut.groupBy("doc_id", "_run").agg(F.min("line_no").alias("first_line"), F.least(F.coalesce(F.max("level"), F.lit(0)), F.lit(DEEPEST)).alias("level"), F.nullif(F.max("heading"), F.lit("")).alias("heading"), joined.alias("content"))
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")) - 1).alias("segment")
    return out.where("content <> ''").select("doc_id", number, "first_line", "level", "heading", "content")


def _before(order: Window, of: str, value: Column) -> list[Column]:
    """For each level from 0 on, the last such value of the rows above."""
    return [F.last(F.when(F.col(of) == k, value), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)) for k in range(DEEPEST + 1)]


def tagged(found: DataFrame, path: str | None = None, as_paths: bool = True) -> DataFrame:
    """Segments with ancestors (headings from the top down), os_tags, struc_tags, contextual_tags and content_tags.

    struc_tags go from near to far: for each higher level the last heading of it above, or else that of the closest level above
    which isn't named yet; then the segment's own; ``as_paths`` leaves headings out that are folders' or temporary files' names.  os_tags come from column ``path``: two folders, or the file's name.
    """
    order = Window.partitionBy("doc_id").orderBy("segment")
    said = found.withColumns({"_last": F.array(*_before(order, "level", F.nullif(T.trimmed(F.col("heading")), F.lit("")))), "_at": F.array(*_before(order, "level", F.struct("segment", "heading")))})
    last, level = F.col("_last"), F.col("level")

    def step(tags: Column, k: Column) -> Column:
        exact, lower = F.get(last, k), F.filter(F.slice(last, F.lit(1), k), lambda x: x.isNotNull())
        close = F.get(lower, F.size(lower) - 1)
        return F.when(exact.isNotNull(), F.array_append(tags, exact)).when(close.isNotNull() & ~F.coalesce(F.array_contains(tags, close), F.lit(False)), F.array_append(tags, close)).otherwise(tags)

    none = F.array().cast("array<string>")
    above = F.when(level > 0, F.aggregate(F.sequence(level - 1, F.lit(0), F.lit(-1)), none, step)).otherwise(none)
    own = T.trimmed(F.col("heading"))
    struc = T.tags_kept(F.concat(above, F.when(own != "", F.array(own)).otherwise(none)), of_paths=as_paths)
    open_ = F.filter(F.slice("_at", F.lit(1), F.greatest(level, F.lit(0))), lambda x, k: x.isNotNull() & x["heading"].isNotNull() & ~F.exists(F.slice("_at", F.lit(1), k), lambda y: F.coalesce(y["segment"] > x["segment"], F.lit(False))))
    words = T.words(F.col("content"))
    first = F.lower(F.get(words, F.lit(0)))
    content = F.when(F.length(T.trimmed(F.col("content"))) >= 10, F.concat(F.slice(words, 1, 1), F.slice(F.filter(words, lambda w: F.lower(w) != first), 1, 1))).otherwise(none)
    out = said.withColumns({"ancestors": F.transform(open_, lambda x: x["heading"]), "os_tags": path_tags(F.col(path)) if path else none, "struc_tags": struc, "content_tags": content})
    return out.withColumn("contextual_tags", F.concat("os_tags", "struc_tags")).drop("_last", "_at")


def path_tags(path: Column, most: int = 2) -> Column:
    """Folders of a path that say something, then the file's name: the first ``most``."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")
    kept, name = T.tags_kept(parts), F.get(parts, F.size(parts) - 1)
    whole = F.when(name.isNull() | F.coalesce(F.array_contains(kept, name), F.lit(False)), kept).otherwise(F.array_append(F.filter(kept, lambda x: F.lower(x) != F.lower(name)), name))
    return T.tags_kept(F.slice(whole, 1, most))


def fallback_prompt(heading: Column, struc: Column, contextual: Column, content: Column) -> Column:
    """The heading, else up to three tags, else the first fifty characters."""
    some = lambda tags: F.nullif(F.array_join(F.slice(tags, 1, 3), " | "), F.lit(""))
    return F.coalesce(F.nullif(T.stripped(heading), F.lit("")), some(struc), some(contextual), T.stripped(F.substring(content, 1, 50)), F.lit(""))


def chunks_by_tree(found: DataFrame, limit: int = 1000) -> DataFrame:
    """(doc_id, chunk, first_line, n_segments, level, heading, struc_tags, content, by_length): segments merged along their tree.

    A segment with all below it is one unit as soon as it fits ``limit`` characters; what doesn't fit stands alone, and what is below
    it is judged by itself.  Neighbouring units under one parent are then packed while they fit.  Where levels say little, segments
    are packed in order instead: fewer than three or a twentieth of them at the deepest level, or more than half at level 0 with under
    500 characters.  level and heading are the highest ones of a chunk, its tags all its headings from high to low, each once.
    """
    doc = Window.partitionBy("doc_id")
    up, down = doc.orderBy("segment"), doc.orderBy(F.desc("segment"))
    room = F.lit(limit + 2)  # two line breaks stand between segments
    size = F.length("content") + 2
    deepest = F.max("level").over(doc)
    base = found.select("doc_id", "segment", "first_line", "level", "heading", "content", size.alias("size"), deepest.alias("deepest"), F.count("*").over(doc).alias("n"), F.sum(size - 2).over(doc).alias("whole"))
    deep, flat = F.sum((F.col("level") == F.col("deepest")).cast("int")).over(doc), F.sum((F.col("level") == 0).cast("int")).over(doc)
    base = base.withColumn("by_length", (deep < 3) | (deep < 0.05 * F.col("n")) | ((flat > 0.5 * F.col("n")) & (F.col("whole") < 500)))
    later = [F.last(F.when(F.col("level") == k, F.col("segment")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)) for k in range(DEEPEST + 1)]
    base = base.withColumns({"_next": F.array(*later), "_above": F.array(*_before(up, "level", F.col("segment"))), "sum": F.sum("size").over(up.rowsBetween(Window.unboundedPreceding, 0))})
    ends = F.coalesce(F.array_min(F.slice("_next", F.lit(1), F.col("level") + 1)), F.col("n"))
    parent = F.coalesce(F.array_max(F.slice("_above", F.lit(1), F.col("level"))), F.lit(-1))
    base = base.withColumns({"end": ends, "parent": parent})
    upto = base.select("doc_id", (F.col("segment") + 1).alias("end"), F.col("sum").alias("upto"))
    base = base.join(upto, ["doc_id", "end"]).withColumn("below", F.col("upto") - F.col("sum") + F.col("size"))
    fits = F.col("below") <= room
    covered = F.coalesce(F.max(F.when(fits, F.col("end"))).over(up.rowsBetween(Window.unboundedPreceding, -1)) > F.col("segment"), F.lit(False))
    units = base.withColumn("fits", fits).withColumn("unit", F.col("by_length") | ~covered)
    own = units.where("unit").withColumn("used", F.when(F.col("by_length") | ~F.col("fits"), F.col("size")).otherwise(F.col("below")))
    change = ~F.col("by_length") & (~F.col("fits") | ~F.coalesce(F.lag("fits").over(up), F.lit(True)) | (F.col("parent") != F.coalesce(F.lag("parent").over(up), F.col("parent"))))
    runs = own.withColumn("_c", change.cast("int")).withColumn("run", F.sum("_c").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    listed = runs.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("segment", "used"))).alias("u"))
    packed = listed.select("doc_id", "run", F.explode(F.arrays_zip(F.transform("u", lambda x: x["segment"]).alias("segment"), documents.greedy_chunks(F.transform("u", lambda x: x["used"].cast("int")), limit + 2).alias("pack"))).alias("x"))
    label = packed.select("doc_id", F.col("x.segment").alias("segment"), F.struct("run", F.col("x.pack").alias("pack")).alias("label"))
    each = base.join(label, ["doc_id", "segment"], "left").withColumn("label", F.last("label", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct("segment", "content")))
    heads = F.array_sort(F.collect_list(F.when(F.col("heading").isNotNull(), F.struct("level", "segment", "heading"))))
    told = each.groupBy("doc_id", "label", "by_length").agg(F.min("first_line").alias("first_line"), F.count("*").alias("n_segments"), F.min("level").alias("level"), heads.alias("heads"), F.array_join(F.transform(rows, lambda x: x["content"]), "\n\n").alias("content"))
    chunk = (F.row_number().over(doc.orderBy("first_line")) - 1).alias("chunk")
    return told.select("doc_id", chunk, "first_line", "n_segments", "level", F.get("heads", F.lit(0))["heading"].alias("heading"), F.array_distinct(F.transform("heads", lambda x: x["heading"])).alias("struc_tags"), "content", "by_length")
