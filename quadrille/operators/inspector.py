"""The inspector: tables of a sheet, their headers, column types, relations, and the rules these make.

All tables of all sheets go through the same few plans; nothing loops over tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators import cells as C
from quadrille.operators import headers, regions
from quadrille.operators.profile import DATES, NUMERIC
from quadrille.operators.relations import MIN_RATE, MIN_SUPPORT, TOP, approx_equal

HEADER, TYPE_LEAST, RELATION_LEAST = 0.72, 0.8, 0.85
MOST_COLUMNS = 80  # the usual bound of the search, which is cubic in columns; see too_wide

KEY = ["sheet", "table_id"]


def placed(cells: DataFrame, gap: int = 1) -> DataFrame:
    """Typed cells of each table, with places within the table from 1."""
    boxes = regions.tables(cells, gap)
    inside = regions.within(C.typed(cells), boxes.select("sheet", "table_id", "top", "left", "bottom", "right"))
    return inside.select(*KEY, "row", "col", (F.col("row") - F.col("top") + 1).alias("r"), (F.col("col") - F.col("left") + 1).alias("c"), "raw", "num", "ctype")


def layout(inside: DataFrame) -> DataFrame:
    """(sheet, table_id, score, has_header): whether the first row names the columns."""
    filled = F.col("ctype") != "empty"
    top = inside.where("r = 1").groupBy(*KEY).agg(
        F.count("*").alias("n"), F.count_if(filled).alias("filled"), F.count_if(F.col("ctype") == "string").alias("text"), F.countDistinct(F.when(filled, F.col("raw"))).alias("different"))
    kinds = inside.where((F.col("r") > 1) & filled).groupBy(*KEY, "c", "ctype").agg(F.count("*").alias("n"))
    steady = kinds.groupBy(*KEY, "c").agg((F.max("n") / F.sum("n")).alias("s")).groupBy(*KEY).agg(F.avg("s").alias("steady"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    score = 0.3 * share("text", "filled") + 0.2 * share("different", "filled") + 0.2 * share("filled", "n") + 0.3 * F.coalesce("steady", F.lit(0.0))
    return top.join(steady, KEY, "left").select(*KEY, score.alias("score"), (score >= HEADER).alias("has_header"))


def header_rows(found: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """A layout with header_rows: the first row or none, or those inferred."""
    first = F.col("has_header").cast("int")
    if inferred is None:
        return found.withColumn("header_rows", first)
    return found.join(inferred.select(*KEY, F.col("header_rows").alias("_rows")), KEY, "left").withColumn("header_rows", F.coalesce("_rows", first)).drop("_rows")


def labels(inside: DataFrame, found: DataFrame) -> DataFrame:
    """(sheet, table_id, c, label): the header's text, else column_<c>."""
    first = inside.where("r = 1").select(*KEY, "c", "raw")
    return first.join(found.select(*KEY, "has_header"), KEY).select(*KEY, "c", F.when(F.col("has_header") & (F.trim("raw") != ""), F.trim("raw")).otherwise(F.concat(F.lit("column_"), F.col("c"))).alias("label"))


def data_types(inside: DataFrame, found: DataFrame) -> DataFrame:
    """(sheet, table_id, c, data_type, confidence) of the rows below the header rows."""
    body = inside.join(found.select(*KEY, "header_rows"), KEY).where(F.col("r") > F.col("header_rows")).where("ctype != 'empty'")
    kinds = body.groupBy(*KEY, "c", "ctype").agg(F.count("*").alias("n"))
    of = lambda names: F.coalesce(F.sum(F.when(F.col("ctype").isin(*names), F.col("n"))), F.lit(0)) / F.sum("n")
    most = F.min(F.struct((-F.col("n")).alias("n"), "ctype")).alias("most")
    per = kinds.groupBy(*KEY, "c").agg(of(NUMERIC).alias("numeric"), of(DATES).alias("dates"), most, F.sum("n").alias("n"))
    share = -F.col("most.n") / F.col("n")
    kind = F.when(F.col("numeric") >= 0.8, "number").when(F.col("dates") >= 0.8, "datetime").when(share >= 0.65, F.col("most.ctype")).otherwise("mixed")
    sure = F.when(F.col("numeric") >= 0.8, F.col("numeric")).when(F.col("dates") >= 0.8, F.col("dates")).otherwise(share)
    return per.select(*KEY, "c", kind.alias("data_type"), sure.alias("confidence"))


def _widths(inside: DataFrame, place: str) -> DataFrame:
    return inside.where("num is not null").groupBy(*KEY).agg(F.max(place).alias("width"))


def too_wide(inside: DataFrame, axis: str = "column", most: int = MOST_COLUMNS) -> DataFrame:
    """(sheet, table_id, width) of tables that ``relations`` leaves out under that bound."""
    return _widths(inside, "c" if axis == "column" else "r").where(F.col("width") > most)


def relations(inside: DataFrame, axis: str = "column", most: int | None = MOST_COLUMNS) -> DataFrame:
    """(sheet, table_id, a, sign, b, t, valid, support, confidence) over the columns (or rows) of every table.

    Cells of a line meet on (table, line); both tables and lines spread the work.  Tables of more than ``most`` columns
    (or rows) are left out and named by ``too_wide``; None leaves none out.
    """
    line, place = ("r", "c") if axis == "column" else ("c", "r")
    numbers = inside.where("num is not null").select(*KEY, F.col(line).alias("line"), F.col(place).alias("p"), "num")
    kept = numbers if most is None else numbers.join(_widths(inside, place).where(F.col("width") <= most).select(*KEY), KEY, "left_semi")
    rows = kept.groupBy(*KEY, "line").agg(F.array_sort(F.collect_list(F.struct("p", "num"))).alias("v"))
    a = rows.select(*KEY, "line", "v", F.explode("v").alias("a"))
    ab = a.select("*", F.explode(F.filter("v", lambda x: x["p"] > F.col("a.p"))).alias("b"))
    abt = ab.select("*", F.explode(F.filter("v", lambda x: (x["p"] != F.col("a.p")) & (x["p"] != F.col("b.p")))).alias("t"))
    x, y = F.col("a.num"), F.col("b.num")
    each = F.array(*(F.struct(F.lit(s).alias("sign"), F.lit(swap).alias("swap"), e.alias("e")) for s, swap, e in (("+", False, x + y), ("-", False, x - y), ("-", True, y - x), ("*", False, x * y), ("/", False, F.try_divide(x, y)), ("/", True, F.try_divide(y, x)))))
    tested = abt.select(*KEY, F.col("a.p").alias("i"), F.col("b.p").alias("j"), F.col("t.p").alias("t"), F.col("t.num").alias("num"), F.explode(each).alias("x"))
    counted = tested.groupBy(*KEY, "i", "j", "t", "x.sign", "x.swap").agg(F.count("x.e").alias("valid"), F.count_if(approx_equal(F.col("num"), F.col("x.e"))).alias("support"))
    rate = F.col("support") / F.col("valid")
    good = counted.where((F.col("valid") >= MIN_SUPPORT) & (rate >= MIN_RATE))
    return good.select(*KEY, F.lit(axis).alias("axis"), F.when(F.col("swap"), F.col("j")).otherwise(F.col("i")).alias("a"), "sign", F.when(F.col("swap"), F.col("i")).otherwise(F.col("j")).alias("b"), "t", "valid", "support", F.round(F.least(F.lit(0.99), rate * F.least(F.lit(1.0), F.col("support") / 20)), 4).alias("confidence"))


def inspect(cells: DataFrame, gap: int = 1, most: int | None = MOST_COLUMNS, full_headers: bool = False) -> dict[str, DataFrame]:
    """Everything about a workbook's sheets, as plans over the same cells.

    ``most`` bounds the search of relations; tables (and axes) that it leaves out are in ``too_wide``, and None leaves none out.
    With ``full_headers`` labels, types and exported rules go by all inferred header rows (one to three, always one at least), texts of a
    column joined by " / "; without it by the first row, if it names the columns.
    """
    inside = placed(cells, gap)
    boxes = regions.tables(cells, gap)
    inferred = headers.infer(inside, boxes)
    found = header_rows(layout(inside), inferred if full_headers else None)
    both = ("column", "row")
    wide = [too_wide(inside, x, 2**31 - 1 if most is None else most).select(*KEY, F.lit(x).alias("axis"), "width") for x in both]
    return {
        "tables": boxes, "layout": found, "header_index": inferred, "labels": headers.labels(inside, boxes, found.select(*KEY, "header_rows", F.lit(0).alias("index_cols"))) if full_headers else labels(inside, found), "types": data_types(inside, found),
        "relations": relations(inside, most=most).unionByName(relations(inside, "row", most)), "too_wide": wide[0].unionByName(wide[1])}


def totals(cells: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """One row (sheets, tables, relations): what was found in all sheets of ``cells``; zeros where there are none."""
    counts = [df.agg(n.alias(name)) for name, df, n in (("sheets", cells, F.countDistinct("sheet")), ("tables", found["tables"], F.count("*")), ("relations", found["relations"], F.count("*")))]
    return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))


def export_rules(found: dict[str, DataFrame]) -> DataFrame:
    """(rule_id, sheet, table_id, kind, text, confidence): regions, headers, sure types and sure relations, numbered in order."""
    names = found["labels"]
    typed = found["types"].where(F.col("confidence") >= TYPE_LEAST).join(names, [*KEY, "c"], "left")
    sure = found["relations"].where((F.col("confidence") >= RELATION_LEAST) & (F.col("axis") == "column"))
    for x in ("a", "b", "t"):
        sure = sure.join(names.select(*KEY, F.col("c").alias(x), F.col("label").alias(f"label_{x}")), [*KEY, x], "left")
    parts = [
        found["tables"].select(*KEY, F.lit("1 region").alias("kind"), F.format_string("rows %d to %d, columns %d to %d", F.col("top").cast("long"), F.col("bottom").cast("long"), F.col("left").cast("long"), F.col("right").cast("long")).alias("text"), "confidence"),
        found["layout"].where("header_rows > 0").select(*KEY, F.lit("2 header").alias("kind"), F.when(F.col("header_rows") == 1, "the first row names the columns").otherwise(F.format_string("the first %d rows name the columns", "header_rows")).alias("text"), F.col("score").alias("confidence")),
        typed.select(*KEY, F.lit("3 type").alias("kind"), F.concat_ws(" is ", "label", "data_type").alias("text"), "confidence"),
        sure.select(*KEY, F.lit("4 relation").alias("kind"), F.format_string("%s = %s %s %s", "label_t", "label_a", "sign", "label_b").alias("text"), "confidence"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("table_id", "kind", "text"))
    return out.withColumn("rule_id", F.format_string("R%04d", place)).withColumn("kind", F.substring("kind", 3, 20))


def best_relations(found: DataFrame, top: int = TOP) -> DataFrame:
    return found.orderBy(F.desc("confidence"), F.desc("support"), *KEY, "t", "a", "b").limit(top)
