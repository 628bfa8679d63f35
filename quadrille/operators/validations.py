"""Drop-down lists of sheets: areas to cells, options from formulas, clusters by rows and columns, and what is said of them.

``validations`` has sheet, rank (their order in the sheet), type, sqref, formula1; ``cells`` has sheet, row, col, raw.

Defined results: addresses with other signs are passed over; of several validations of a cell the last one counts, at the place of
the first; a null or empty sqref covers nothing; a reference to an unknown sheet means the own one; options that can't
be resolved are none; no validations, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import a1
from quadrille.functions import text as T

ADDRESS = r"^([A-Z]+)([0-9]+)$"
#: Lines that annotate a sheet's text, and what they say.
ANNOTATED = r"(?m)^\[(?:圖像說明|補充物件內容|頁面視覺說明|表格視覺說明)\|[^\]]+\][^\n]*\n?"
CHOICES = r"(?m)^\[下拉選單\|[^\]]+\][^\n]*\n?"
CHOICES_HEADER = r"(?m)^## 下拉選單\s*\n?"


def _ends(address: Column) -> Column:
    """struct(top, left, bottom, right) of A1 or A1:C3, ends in any order; null if it is no address."""
    parts = F.split(F.upper(address), ":", 2)
    at = [(F.regexp_extract(p, ADDRESS, 2).try_cast("int"), a1.column_number(F.regexp_extract(p, ADDRESS, 1))) for p in (F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))]
    (r1, c1), (r2, c2) = at
    box = F.struct(F.least(r1, r2).alias("top"), F.least(c1, c2).alias("left"), F.greatest(r1, r2).alias("bottom"), F.greatest(c1, c2).alias("right"))
    return F.when(r1.isNotNull() & r2.isNotNull() & c1.isNotNull() & c2.isNotNull(), box)


def _cells_of(df: DataFrame, box: str) -> DataFrame:
    rows = df.withColumn("row", F.explode(F.sequence(F.col(f"{box}.top"), F.col(f"{box}.bottom"))))
    return rows.withColumn("col", F.explode(F.sequence(F.col(f"{box}.left"), F.col(f"{box}.right")))).drop(box)


def inline_options(formula: Column) -> Column:
    """Options of a list that is written out: parts between commas without blanks and quotes."""
    text = T.stripped(F.coalesce(formula, F.lit("")))
    text = F.when((F.length(text) >= 2) & text.startswith('"') & text.endswith('"'), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    items = F.transform(F.split(text, ","), lambda x: F.regexp_replace(T.stripped(x), '^"+|"+$', ""))
    return F.when(text.startswith("="), F.array().cast("array<string>")).otherwise(F.filter(items, lambda x: x != ""))


def resolved(validations: DataFrame, cells: DataFrame) -> DataFrame:
    """Validations with options (array) and options_source: inline_list, formula_ref, formula_ref_unresolved, or null for other types."""
    text = T.stripped(F.coalesce("formula1", F.lit("")))
    expr = T.stripped(F.substring(text, F.lit(2), F.length(text)))
    sheet = F.regexp_extract(expr, r"^(?:'([^']+)'|([^!]+))!(.+)$", 1)
    sheet = F.nullif(F.when(sheet != "", sheet).otherwise(F.regexp_extract(expr, r"^(?:'([^']+)'|([^!]+))!(.+)$", 2)), F.lit(""))
    area = F.replace(F.when(sheet.isNotNull(), F.regexp_extract(expr, r"^(?:'([^']+)'|([^!]+))!(.+)$", 3)).otherwise(expr), F.lit("$"), F.lit(""))
    is_list = F.coalesce(F.lower(T.stripped(F.col("type"))) == "list", F.lit(False))
    refers = is_list & text.startswith("=")
    asked = validations.where(refers).select("sheet", "rank", F.coalesce(sheet, F.col("sheet")).alias("_named"), _ends(area).alias("_box")).where("_box is not null")
    known = cells.select(F.col("sheet").alias("_named")).distinct().withColumn("_known", F.lit(True))
    asked = asked.join(known, "_named", "left").withColumn("_of", F.when(F.col("_known"), F.col("_named")).otherwise(F.col("sheet")))
    filled = cells.where("raw is not null and raw <> ''").select(F.col("sheet").alias("_of"), "row", "col", T.stripped(F.col("raw")).alias("_raw"))
    found = _cells_of(asked.select("sheet", "rank", "_of", "_box"), "_box").join(filled, ["_of", "row", "col"])
    listed = found.groupBy("sheet", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "_raw"))), lambda x: x["_raw"]).alias("_found"))
    none = F.array().cast("array<string>")
    options = F.when(refers, F.coalesce("_found", none)).when(is_list, inline_options(F.col("formula1"))).otherwise(none)
    source = F.when(refers, F.when(F.col("_found").isNotNull(), "formula_ref").otherwise("formula_ref_unresolved")).when(is_list, "inline_list")
    return validations.join(listed, ["sheet", "rank"], "left").withColumns({"options": options, "options_source": source}).drop("_found")


def by_cell(validations: DataFrame) -> DataFrame:
    """(sheet, row, col, place, type, formula1, options, options_source): the validation of each cell; place is its order in the sheet."""
    tokens = F.posexplode(F.split(T.stripped(F.coalesce("sqref", F.lit(""))), r"\s+")).alias("_n", "_token")
    entry = F.struct(F.lower(T.stripped(F.col("type"))).alias("type"), "formula1", "options", "options_source")
    spread = validations.select("sheet", "rank", entry.alias("_entry"), tokens).select("sheet", "rank", "_entry", "_n", _ends(F.col("_token")).alias("_box")).where("_box is not null")
    each = _cells_of(spread, "_box")
    place = F.struct("rank", "_n", "row", "col")
    return each.groupBy("sheet", "row", "col").agg(F.min(place).alias("place"), F.max_by("_entry", place).alias("e")).select("sheet", "row", "col", "place", "e.*")


def signature(options: Column, formula: Column) -> Column:
    """What two lists must have in common to be one: their options, else their formula."""
    return F.when(F.size(options) > 0, F.to_json(options)).otherwise(F.concat(F.lit("="), F.coalesce(formula, F.lit(""))))


def clustered(found: DataFrame, least: int = 2) -> DataFrame:
    """Cells of lists with kind (row_uniform, row_mixed, col_uniform, col_mixed, scattered) and number, of the row or column.

    A row with ``least`` cells and more is a cluster, uniform if its lists are one; then columns among the rest.
    """
    lists = found.where("type = 'list'").withColumn("_sig", signature(F.col("options"), F.col("formula1")))

    def along(df: DataFrame, axis: str) -> Column:
        w = Window.partitionBy("sheet", axis)
        return F.when(F.count("*").over(w) >= least, F.when(F.min("_sig").over(w) == F.max("_sig").over(w), f"{axis}_uniform").otherwise(f"{axis}_mixed"))

    rows = lists.withColumn("_row", along(lists, "row"))
    rest = rows.where("_row is null")
    cols = rest.withColumn("kind", F.coalesce(along(rest, "col"), F.lit("scattered"))).withColumn("number", F.when(F.col("kind") != "scattered", F.col("col")))
    return rows.where("_row is not null").withColumn("kind", F.col("_row")).withColumn("number", F.col("row")).unionByName(cols).drop("_row", "_sig")


def annotations(clusters: DataFrame, cells: DataFrame, examples: int = 3) -> DataFrame:
    """(sheet, kind, number, top, left, bottom, right, n_cells, line): a line for each cluster, and for each scattered cell."""
    value = F.replace(F.replace(F.substring(T.stripped(F.coalesce("raw", F.lit(""))), 1, 200), F.lit("|"), F.lit("/")), F.lit("]"), F.lit(")"))
    said = clusters.join(cells.select("sheet", "row", "col", "raw"), ["sheet", "row", "col"], "left").withColumn("chosen", F.nullif(value, F.lit("")))
    one = F.when(F.col("kind") == "scattered", F.struct("row", "col"))
    firsts = said.groupBy("sheet", "kind", "number", one.alias("one"), "chosen").agg(F.min("place").alias("place"), F.count("*").alias("n"), F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"), F.min(F.struct("place", "options", "options_source")).alias("first"))
    chosen = F.array_sort(F.collect_list(F.when(F.col("chosen").isNotNull(), F.struct("place", "chosen"))))  # one row a value already
    groups = firsts.groupBy("sheet", "kind", "number", "one").agg(F.sum("n").alias("n_cells"), F.min("top").alias("top"), F.min("left").alias("left"), F.max("bottom").alias("bottom"), F.max("right").alias("right"), F.min("first").alias("first"), F.transform(chosen, lambda x: x["chosen"]).alias("chosen"))
    place = F.row_number().over(Window.partitionBy("sheet", "kind", "number").orderBy("place"))
    short = F.concat(a1.cell(F.col("row"), F.col("col")), F.lit("("), F.size("options").cast("string"), F.lit("項"), F.coalesce(F.concat(F.lit(",選「"), F.col("chosen"), F.lit("」")), F.lit("")), F.lit(")"))
    some = said.where(F.col("kind").endswith("mixed")).withColumn("_p", place).where(F.col("_p") <= examples).groupBy("sheet", "kind", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", short.alias("s")))), lambda x: x["s"]), "; ").alias("examples"))
    groups = groups.join(some, ["sheet", "kind", "number"], "left")
    options = F.col("first.options")
    joined = F.nullif(F.array_join(F.filter(options, lambda x: T.stripped(x) != ""), "、"), F.lit(""))
    axis = F.substring("kind", 1, 3)
    first = F.get("chosen", F.lit(0))
    now = F.when(F.size("chosen") == 1, F.concat(F.lit("目前皆為「"), first, F.lit("」"))).when(F.size("chosen") > 1, F.concat(F.lit("目前選值: "), F.array_join("chosen", "、"))).otherwise("目前無選值")
    whole = F.when(axis == "row", "全列").otherwise("全欄")
    at, n = F.col("number").cast("string"), F.col("n_cells").cast("string")
    selected = F.coalesce(F.concat(F.lit("|selected="), first), F.lit(""))
    count = F.size(options).cast("string")
    uniform = F.concat(F.lit("[下拉選單|list|"), axis, F.lit("="), at, F.lit("|range="), a1.area(F.col("top"), F.col("left"), F.col("bottom"), F.col("right")), F.lit("|option_count="), count, F.lit("|cells="), n, selected, F.lit("] "), whole, F.coalesce(F.concat(F.lit("共用選項: "), joined), F.lit("共用下拉選單")), F.lit("；"), now)
    mixed = F.concat(F.lit("[下拉選單|list|"), axis, F.lit("="), at, F.lit("|pattern=mixed|cells="), n, F.lit("] 例: "), F.col("examples"))
    suffix = F.when(joined.isNotNull(), F.concat(F.lit("選項: "), joined)).when(F.col("first.options_source") == "formula_ref_unresolved", "選項: (公式參照未解析, options_source=formula_ref_unresolved)").otherwise("選項: (未解析)")
    scattered = F.concat(F.lit("[下拉選單|list|anchor="), a1.cell(F.col("top"), F.col("left")), F.lit("|option_count="), count, selected, F.lit("] "), suffix)
    line = F.when(F.col("kind") == "scattered", scattered).when(F.col("kind").endswith("mixed"), mixed).otherwise(uniform)
    return groups.select("sheet", "kind", "number", "top", "left", "bottom", "right", "n_cells", line.alias("line"))


def without_annotations(text: Column, choices: bool = True) -> Column:
    """A sheet's text without lines that describe pictures, and without those of drop-down lists unless ``choices`` is false."""
    text = F.coalesce(text, F.lit(""))
    if choices:
        text = F.regexp_replace(F.regexp_replace(text, CHOICES, ""), CHOICES_HEADER, "")
    return T.stripped(F.regexp_replace(text, ANNOTATED, ""))
