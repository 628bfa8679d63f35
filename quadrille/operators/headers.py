"""Header rows, index columns and the kind of a table, for all tables of all sheets at once.

Cells come as ``inspector.placed`` gives them: (sheet, table_id, r, c, raw, ctype), places from 1
within the table, a row for each cell that the sheet holds.  ``boxes`` has (sheet, table_id, top, left,
bottom, right).  Blank and missing cells are the same; tables without cells give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import a1
from quadrille.functions.coerce import NUMBER, is_blank
from quadrille.operators.profile import DATES, NUMERIC
from quadrille.operators.regions import within

KEY = ["sheet", "table_id"]
#: How many rows and columns may name others, and how many more are looked at.
MOST_HEADERS, MOST_INDEXES, MORE = 3, 3, 2
#: Kinds that a header's text, or an index's, may have.
HEADER_KINDS, INDEX_KINDS = ("string", "date", "datetime"), ("string", "date", "datetime", "time", "integer")
#: Marks of cells that describe instead of measure; they count three times.
TEXT_MARKS = ("材質", "砂芯", "重", "後", "量", "客供", "計算", "加", "電鍍", "磨光", "研磨", "SS", "RH", "SW", "LW")
NAN = "^(?i)[+-]?(nan|inf|infinity)$"


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _sized(boxes: DataFrame) -> DataFrame:
    return boxes.select(*KEY, "top", "left", "bottom", "right", (F.col("bottom") - F.col("top") + 1).alias("h"), (F.col("right") - F.col("left") + 1).alias("w"))


def header_row_scores(inside: DataFrame, boxes: DataFrame) -> DataFrame:
    """(sheet, table_id, r, score) of the first rows: texts, distinct, filled, and columns of one kind below.

    Kinds of cells are counted once per column; what lies below a row is the whole count less that of the first rows.
    """
    rows = MOST_HEADERS + MORE
    sizes = _sized(boxes)
    filled = inside.where("ctype != 'empty'")
    top = filled.where(F.col("r") <= rows).groupBy(*KEY, "r").agg(
        F.count("*").alias("filled"), F.count_if(F.col("ctype").isin(*HEADER_KINDS)).alias("text"), F.countDistinct(F.trim("raw")).alias("different"))
    above = [F.count_if(F.col("r") <= i).alias(f"a{i}") for i in range(1, rows + 1)]
    kinds = filled.groupBy(*KEY, "c", "ctype").agg(F.count("*").alias("n"), *above)
    below = kinds.select(*KEY, "c", "ctype", F.posexplode(F.array(*(F.col("n") - F.col(f"a{i}") for i in range(1, rows + 1)))).alias("i", "n")).withColumn("r", F.col("i") + 1)
    of = lambda names: _share(F.sum(F.when(F.col("ctype").isin(*names), F.col("n"))), F.sum("n"))
    columns = below.groupBy(*KEY, "r", "c").agg(F.sum("n").alias("n"), of(NUMERIC).alias("numeric"), of(DATES).alias("dates"), _share(F.max("n"), F.sum("n")).alias("most")).where("n >= 2")
    sure = F.when(F.col("numeric") >= 0.8, F.col("numeric")).when(F.col("dates") >= 0.8, F.col("dates")).otherwise(F.col("most"))
    steady = columns.groupBy(*KEY, "r").agg(F.avg((sure >= 0.7).cast("int")).alias("steady"))
    looked = sizes.select(*KEY, "w", F.explode(F.sequence(F.lit(1), F.least(F.col("h"), F.lit(rows)).cast("int"))).alias("r"))
    joined = looked.join(top, [*KEY, "r"], "left").join(steady, [*KEY, "r"], "left")
    score = 0.3 * F.col("text") / F.col("filled") + 0.2 * F.col("different") / F.col("filled") + 0.2 * F.col("filled") / F.col("w") + 0.3 * F.coalesce("steady", F.lit(0.0))
    return joined.select(*KEY, "r", F.coalesce(score, F.lit(0.0)).alias("score"))


def _at(name: str, i: int) -> Column:
    return F.coalesce(F.get(F.col(name), i), F.lit(0.0))


def _scores(df: DataFrame, place: str, name: str) -> DataFrame:
    return df.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, "score"))), lambda x: x["score"]).alias(name))


def infer(inside: DataFrame, boxes: DataFrame) -> DataFrame:
    """(sheet, table_id, header_rows, index_cols, header_confidence, index_confidence, data_top, data_left, data_bottom, data_right).

    One to three header rows and none to two index columns; the data's ends are those in the sheet.
    """
    sizes = _sized(boxes)
    rows = _scores(header_row_scores(inside, boxes), "r", "s")
    s1, s2, s3 = (_at("s", i) for i in range(3))
    count = F.when((F.size("s") >= 3) & (s3 > 0.75) & (F.least(s1, s2) > 0.55), 3).when((F.size("s") >= 2) & (s2 > 0.72) & (s1 > 0.5), 2).otherwise(1)
    headed = sizes.join(rows, KEY).withColumn("header_rows", F.least(count, F.lit(MOST_HEADERS), F.col("h") - 1).cast("int"))

    body = inside.join(headed.select(*KEY, "header_rows", "h"), KEY).where((F.col("r") > F.col("header_rows")) & (F.col("c") <= MOST_INDEXES + MORE) & (F.col("ctype") != "empty"))
    per = body.groupBy(*KEY, "c").agg(
        F.count("*").alias("n"), F.count_if(F.col("ctype").isin(*INDEX_KINDS)).alias("named"), F.count_if(F.col("ctype").isin(*NUMERIC)).alias("numbers"),
        F.countDistinct(F.trim("raw")).alias("different"), (F.first("h") - F.first("header_rows")).alias("rows"))
    score = F.greatest(F.lit(0.0), 0.35 * F.col("named") / F.col("n") + 0.35 * F.col("different") / F.col("n") + 0.3 * F.col("n") / F.col("rows") - 0.75 * F.col("numbers") / F.col("n"))
    looked = sizes.select(*KEY, F.explode(F.sequence(F.lit(1), F.least(F.col("w"), F.lit(MOST_INDEXES + MORE)).cast("int"))).alias("c"))
    columns = _scores(looked.join(per, [*KEY, "c"], "left").select(*KEY, "c", F.coalesce(score, F.lit(0.0)).alias("score")), "c", "t")
    t1, t2 = _at("t", 0), _at("t", 1)
    both = headed.join(columns, KEY).withColumn("index_cols", F.least(F.when((t1 >= 0.62) & (t2 >= 0.72), 2).when(t1 >= 0.62, 1).otherwise(0), F.lit(MOST_INDEXES), F.col("w") - 1).cast("int"))
    best = lambda scores, n: F.round(F.array_max(F.slice(scores, 1, F.greatest(F.lit(1), F.col(n)))), 4)
    return both.select(
        *KEY, "header_rows", "index_cols", best("s", "header_rows").alias("header_confidence"), best("t", "index_cols").alias("index_confidence"),
        (F.col("top") + F.col("header_rows")).alias("data_top"), (F.col("left") + F.col("index_cols")).alias("data_left"), F.col("bottom").alias("data_bottom"), F.col("right").alias("data_right"))


def labels(inside: DataFrame, boxes: DataFrame, found: DataFrame) -> DataFrame:
    """(sheet, table_id, c, label) of the columns beyond the index: texts of all header rows joined by " / ", else col_<c>."""
    columns = _sized(boxes).join(found.select(*KEY, "header_rows", "index_cols"), KEY)
    each = columns.select(*KEY, "header_rows", F.explode(F.sequence(F.col("index_cols") + 1, F.col("w").cast("int"))).alias("c"))
    texts = inside.where(F.col("r") <= MOST_HEADERS).where(~is_blank(F.col("raw"))).select(*KEY, "c", "r", F.trim("raw").alias("raw"))
    named = each.join(texts, [*KEY, "c"], "left")
    part = F.when(F.col("r") <= F.col("header_rows"), F.struct("r", "raw"))
    joined = named.groupBy(*KEY, "c").agg(F.concat_ws(" / ", F.transform(F.array_sort(F.collect_list(part)), lambda x: x["raw"])).alias("label"))
    return joined.select(*KEY, "c", F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("col_"), F.col("c"))).alias("label"))


def guessed_headers(inside: DataFrame, boxes: DataFrame) -> DataFrame:
    """(sheet, table_id, c, header): the first row's text, else col_<c>."""
    each = _sized(boxes).select(*KEY, F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("c"))
    first = inside.where("r = 1").select(*KEY, "c", F.nullif(F.trim("raw"), F.lit("")).alias("raw"))
    return each.join(first, [*KEY, "c"], "left").select(*KEY, "c", F.coalesce("raw", F.concat(F.lit("col_"), F.col("c"))).alias("header"))


def header_signals(inside: DataFrame, boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """(sheet, table_id, row_score, col_score, index_row, index_col): whether the first row, and the first column, name the others.

    The mean of four shares: filled, holding a letter, distinct regardless of case, and filled cells beside the names.
    """
    sizes = _sized(boxes)
    filled = inside.where(~is_blank(F.col("raw")))

    def side(line: str, place: str, across: str, along: str, name: str) -> DataFrame:
        names = filled.where(F.col(line) == 1).select(*KEY, place, "raw")
        beside = filled.where(F.col(line) > 1).groupBy(*KEY, place).agg(F.count("*").alias("beside"))
        per = names.join(beside, [*KEY, place], "left").join(sizes, KEY)
        text = F.trim("raw")
        out = per.groupBy(*KEY).agg(
            F.count("*").alias("n"), F.count_if(text.rlike(r"\p{L}")).alias("text"), F.countDistinct(F.lower(text)).alias("different"),
            F.avg(_share(F.coalesce("beside", F.lit(0)), F.nullif(F.col(along) - 1, F.lit(0)))).alias("fill"), F.first(across).alias("size"))
        score = F.round((F.col("n") / F.col("size") + F.col("text") / F.col("n") + F.col("different") / F.col("n") + F.col("fill")) / 4, 3)
        return out.select(*KEY, score.alias(name))

    both = sizes.select(*KEY).join(side("r", "c", "w", "h", "row_score"), KEY, "left").join(side("c", "r", "h", "w", "col_score"), KEY, "left")
    both = both.na.fill(0.0, ["row_score", "col_score"])
    return both.select(*KEY, "row_score", "col_score", (F.col("row_score") >= least).alias("index_row"), (F.col("col_score") >= least).alias("index_col"))


def line_statistics(cells: DataFrame, axis: str) -> DataFrame:
    """(sheet, <axis>, non_empty, text, numeric, text_ratio, numeric_ratio) of each row or column of typed cells."""
    filled = F.col("ctype") != "empty"
    number = F.col("ctype").isin(*NUMERIC)
    out = cells.groupBy("sheet", axis).agg(F.count_if(filled).alias("non_empty"), F.count_if(filled & ~number).alias("text"), F.count_if(number).alias("numeric"))
    return out.select("*", _share(F.col("text"), F.col("non_empty")).alias("text_ratio"), _share(F.col("numeric"), F.col("non_empty")).alias("numeric_ratio"))


def sequential(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, n, sequential): whether the texts are three or more whole numbers without a gap or repeat, in any order."""
    whole = F.when(F.trim(text).rlike("^-?[0-9]+$"), F.trim(text).try_cast("decimal(38,0)"))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(whole).alias("w"), F.countDistinct(whole).alias("d"), (F.max(whole) - F.min(whole)).alias("span"))
    return out.select(*keys, "n", F.coalesce((F.col("w") == F.col("n")) & (F.col("n") >= 3) & (F.col("d") == F.col("n")) & (F.col("span") == F.col("n") - 1), F.lit(False)).alias("sequential"))


def _beside(cells: DataFrame, boxes: DataFrame, above: bool, reach: int, least: float) -> DataFrame:
    low, end, line, place = ("top", "bottom", "row", "col") if above else ("left", "right", "col", "row")
    size = (F.col("right") - F.col("left") + 1) if above else (F.col("bottom") - F.col("top") + 1)
    strips = boxes.select(*KEY, "top", "left", "bottom", "right", size.alias("size")).where(F.col(low) > 1)
    strips = strips.withColumn(end, F.col(low) - 1).withColumn(low, F.greatest(F.lit(1), F.col(low) - reach))
    held = within(cells.where(~is_blank(F.col("raw"))).select("sheet", "row", "col"), strips)
    counted = held.groupBy(*KEY, line).agg(F.countDistinct(place).alias("n"), F.first("size").alias("size"))
    return counted.where(F.col("n") >= F.col("size") * least).groupBy(*KEY).agg(F.min(line).alias(line))


def column_headers(cells: DataFrame, boxes: DataFrame, reach: int = 3) -> DataFrame:
    """(sheet, table_id, row): the first of the ``reach`` rows above a region that is at least half filled; none if no row is."""
    return _beside(cells, boxes, True, reach, 0.5)


def row_indexes(cells: DataFrame, boxes: DataFrame, reach: int = 3) -> DataFrame:
    """(sheet, table_id, col): the first of the ``reach`` columns left of a region that is at least 70 % filled; none if no column is."""
    return _beside(cells, boxes, False, reach, 0.7)


def numeric_areas(cells: DataFrame, height: int, width: int, strict: bool = True) -> DataFrame:
    """(sheet, tile_row, tile_col, n_filled, n_numbers, n_text, is_data) of tumbling tiles of (sheet, row, col, raw).

    Data has two or more numbers and 70 % of them; ``strict`` also asks that texts, those with a mark counted thrice, are 30 % at most.
    """
    filled = F.col("raw").isNotNull()
    cleaned = F.regexp_replace("raw", "[,± ]", "")
    number = filled & (F.trim(cleaned).rlike(NUMBER) | F.trim(cleaned).rlike(NAN))
    marked = F.lit(False)
    for m in TEXT_MARKS:
        marked = marked | F.col("raw").contains(m)
    weight = F.when(filled & ~number, F.when(marked, 3).otherwise(1)).otherwise(0)
    place = [F.floor((F.col("row") - 1) / height).alias("tile_row"), F.floor((F.col("col") - 1) / width).alias("tile_col")]
    out = cells.groupBy("sheet", *place).agg(F.count_if(filled).alias("n_filled"), F.count_if(number).alias("n_numbers"), F.sum(weight).alias("n_text"))
    good = (F.col("n_filled") > 0) & (F.col("n_numbers") >= 2) & (F.col("n_numbers") >= F.col("n_filled") * 0.7)
    return out.withColumn("is_data", good & (F.col("n_text") <= F.col("n_filled") * 0.3) if strict else good)


def numeric_tables(cells: DataFrame) -> DataFrame:
    """(sheet, is_numeric, missing_ratio) of (sheet, row, col, raw), a row for each cell.

    A sheet of four rows and two columns or more is judged from its fourth row and second column on, where texts with ± pass;
    a smaller one throughout, where they don't.
    """
    text = F.trim("raw")
    blank = is_blank(F.col("raw"))
    number = text.rlike(NUMBER) | text.rlike(NAN)
    inner = (F.col("row") >= 4) & (F.col("col") >= 2)
    out = cells.groupBy("sheet").agg(
        F.max("row").alias("h"), F.max("col").alias("w"), F.count_if(inner & ~blank & ~number & ~F.col("raw").contains("±")).alias("inner_text"),
        F.count_if(~blank & ~number).alias("any_text"), F.count_if(F.col("raw").isNull() | (F.col("raw") == "")).alias("missing"), F.count("*").alias("n"))
    large = (F.col("h") >= 4) & (F.col("w") >= 2)
    return out.select("sheet", F.when(large, F.col("inner_text") == 0).otherwise(F.col("any_text") == 0).alias("is_numeric"), (F.col("missing") / F.col("n")).alias("missing_ratio"))


def blocks(boxes: DataFrame, rows: int = 100, columns: int = 15) -> DataFrame:
    """(sheet, table_id, block, top, left, bottom, right, address): tables cut in blocks of that size, row by row, ragged ends kept."""
    down = F.sequence(F.col("top"), F.col("bottom"), F.lit(rows).cast("long"))
    longs = boxes.select(*KEY, *(F.col(x).cast("long").alias(x) for x in ("top", "left", "bottom", "right")))
    cut = longs.select(*KEY, "bottom", "right", F.col("top").alias("t0"), F.col("left").alias("l0"), F.explode(down).alias("top"), "left").withColumn("left", F.explode(F.sequence("l0", "right", F.lit(columns).cast("long"))))
    wide = F.ceil((F.col("right") - F.col("l0") + 1) / columns)
    number = F.floor((F.col("top") - F.col("t0")) / rows) * wide + F.floor((F.col("left") - F.col("l0")) / columns)
    bottom, right = F.least(F.col("top") + rows - 1, F.col("bottom")), F.least(F.col("left") + columns - 1, F.col("right"))
    return cut.select(*KEY, number.alias("block"), "top", "left", bottom.alias("bottom"), right.alias("right"), a1.area(F.col("top"), F.col("left"), bottom, right).alias("address"))
