"""Queries of sheets: aggregates, cells, profiles, windows, regions, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import a1
from quadrille.operators import cells as C
from quadrille.operators import grouped, inspector, profile, regions, relations, textwork, windows
from quadrille.queries.base import EVENTS_SQL, LINE_VALUES, LINES_SQL, ORDER_CELLS_SQL, Book, event_sheet, line_sheet, order_cells, table

BOOK = Book()


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _earliest_sql(source: str, keys: str, value: str, time: str, order: str, keep: str) -> str:
    return f"""with s as (select *, row_number() over (partition by {keys} order by ({time}) is null, {time}, {order}) as rn from {source})
      select {keys}, round(avg({value}), 4) as {value}_mean, round(stddev_samp({value}), 4) as {value}_std, count(*) as row_count,
        {', '.join(f'max(case when rn = 1 then {k} end) as {k}' for k in keep.split(', '))}, min({order}) as first_seen from s group by {keys}"""


@BOOK.add(_earliest_sql("events", "event_type", "value", "ts", "event_id", "event_id, user_id"))
def groupagg_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grouped.group_aggregate(table(spark, sf_dir, "events"), ["event_type"], "value", [F.col("ts")], "event_id", ["event_id", "user_id"]), "value_mean", "value_std", places=4)


@BOOK.add(_earliest_sql("orders", "o_orderpriority", "o_totalprice", "null", "o_orderkey", "o_orderkey, o_custkey"))
def groupagg_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grouped.group_aggregate(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [], "o_orderkey", ["o_orderkey", "o_custkey"]), "o_totalprice_mean", "o_totalprice_std", places=4)


@BOOK.add(_earliest_sql("orders", "o_orderstatus, o_orderpriority", "o_totalprice", "o_orderdate", "o_orderkey", "o_orderkey, o_custkey"))
def groupagg_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grouped.group_aggregate(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice", [F.col("o_orderdate")], "o_orderkey", ["o_orderkey", "o_custkey"]), "o_totalprice_mean", "o_totalprice_std", places=4)


@BOOK.add("with " + LINES_SQL + ", j as (select li.*, least(l_shipdate, o_orderdate) as t from li join orders on l_orderkey = o_orderkey), " + _earliest_sql("j", "l_returnflag, l_linestatus", "l_quantity", "t", "row", "row, l_orderkey").removeprefix("with "))
def groupagg_multi_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = line_sheet(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _rounded(grouped.group_aggregate(both, ["l_returnflag", "l_linestatus"], "l_quantity", [F.col("l_shipdate"), F.col("o_orderdate")], "row", ["row", "l_orderkey"]), "l_quantity_mean", "l_quantity_std", places=4)


@BOOK.add("""select 'sheet' as sheet, min(c_custkey) as top, 1 as left_col, max(c_custkey) as bottom, 3 as right_col, 'A' || min(c_custkey) || ':C' || max(c_custkey) as address from customer""")
def used_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = C.to_cells(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "row"), ["c_name", "c_mktsegment", "c_acctbal"])
    return C.used_range(sheet).select("sheet", "top", F.col("left").cast("int").alias("left_col"), "bottom", F.col("right").cast("int").alias("right_col"), "address")


@BOOK.add("select p_partkey, p_name, p_brand from (select p_partkey, case when p_partkey % 7 = 0 then '' else p_name end as p_name, case when p_partkey % 14 = 0 then null else p_brand end as p_brand from part) where coalesce(nullif(p_name, ''), nullif(p_brand, '')) is not null")
def records_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(key % 7 == 0, F.lit("")).otherwise(F.col("p_name")).alias("p_name"), F.when(key % 14 == 0, None).otherwise(F.col("p_brand")).alias("p_brand"))
    return C.drop_empty_rows(rows, ["p_name", "p_brand"])


@BOOK.add(f"with {ORDER_CELLS_SQL} select row, col, raw is null as is_null from oc where row in (select row from oc where ctype <> 'empty') and col in (select col from oc where ctype <> 'empty')")
def prune_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prune_blank(order_cells(spark, sf_dir)).select("row", "col", F.col("raw").isNull().alias("is_null"))


@BOOK.add(f"with {ORDER_CELLS_SQL} select row, col, raw from oc where row between 4 and 39 and col between 3 and 5")
def range_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.in_area(order_cells(spark, sf_dir), "C4:E39").select("row", "col", "raw")


@BOOK.add(f"with {ORDER_CELLS_SQL} select col, ctype, count(*) as n from oc group by col, ctype")
def cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.type_counts(order_cells(spark, sf_dir))


def _profile_sql(axis: str) -> str:
    return f"""with {ORDER_CELLS_SQL}, c as (select {axis}, ctype, count(*) as n from oc group by all),
      p as (select {axis}, sum(n) as n_cells, coalesce(sum(n) filter (ctype <> 'empty'), 0) as f, coalesce(sum(n) filter (ctype in ('integer', 'number')), 0) as u, coalesce(sum(n) filter (ctype = 'date'), 0) as d,
        max(n) filter (ctype <> 'empty') as m from c group by {axis}),
      b as (select {axis}, ctype from (select *, row_number() over (partition by {axis} order by n desc, ctype) as k from c where ctype <> 'empty') where k = 1)
      select {axis}, cast(n_cells as bigint) as n_cells, cast(f as bigint) as n_filled, round(1 - f / n_cells, 6) as missing_rate,
        case when f = 0 then 'empty' when u / f >= 0.8 then 'number' when d / f >= 0.8 then 'datetime' when m / f >= 0.65 then ctype else 'mixed' end as data_type,
        round(case when f = 0 then 1.0 when u / f >= 0.8 then u / f when d / f >= 0.8 then d / f else m / f end, 6) as confidence from p left join b using ({axis})"""


@BOOK.add(_profile_sql("col"))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.axis_profile(order_cells(spark, sf_dir), "col"), "missing_rate", "confidence")


@BOOK.add(_profile_sql("row"))
def row_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.axis_profile(order_cells(spark, sf_dir), "row"), "missing_rate", "confidence")


@BOOK.add(f"with {ORDER_CELLS_SQL} select row, col, raw, ctype, 'number' as data_type from oc where col = 2 and ctype = 'string'")
def type_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.anomalies(order_cells(spark, sf_dir))


@BOOK.add(f"with {ORDER_CELLS_SQL} select col, k as place, row, raw from (select *, row_number() over (partition by col order by row) as k from oc where ctype <> 'empty') where k <= 3")
def column_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.examples(order_cells(spark, sf_dir))


@BOOK.add(f"""with {ORDER_CELLS_SQL}, t as (select row, count(*) as n, count(*) filter (ctype <> 'empty') as filled, count(*) filter (ctype = 'string') as text, count(distinct raw) filter (ctype <> 'empty') as different from oc where row <= 3 group by row),
  c as (select col, ctype, count(*) as n from oc where row > 3 and ctype <> 'empty' group by all),
  p as (select col, sum(n) as f, sum(case when ctype in ('integer', 'number') then n else 0 end) as u, sum(case when ctype = 'date' then n else 0 end) as d, max(n) as m from c group by col),
  s as (select avg(case when u / f >= 0.8 then u / f when d / f >= 0.8 then d / f when m / f >= 0.65 then m / f else 0.0 end) as steady from p)
  select row, filled, text, different, round(0.3 * text / filled + 0.2 * different / filled + 0.2 * filled / n + 0.3 * steady, 6) as score from t, s""")
def header_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.header_scores(order_cells(spark, sf_dir)), "score")


@BOOK.add(f"""with {ORDER_CELLS_SQL} select col, filled, text, numbers, different, round(0.35 * text / filled + 0.35 * different / filled + 0.3 * filled / n - 0.75 * numbers / filled, 6) as score from
  (select col, count(*) as n, count(*) filter (ctype <> 'empty') as filled, count(*) filter (ctype = 'string') as text, count(*) filter (ctype in ('integer', 'number')) as numbers, count(distinct raw) filter (ctype <> 'empty') as different from oc where col <= 3 group by col)""")
def index_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.index_scores(order_cells(spark, sf_dir)), "score")


def _flat(df: DataFrame, n: int) -> DataFrame:
    return df.select("start_row", "start_col", *(F.get("values", i).alias(f"v{i}") for i in range(n)), "filled")


@BOOK.add(f"with {EVENTS_SQL}, w as (select row - 1 as start_row, 0 as start_col, value as v0, lead(value, 1) over (order by row) as v1, lead(value, 2) over (order by row) as v2, lead(row, 2) over (order by row) as last from ev) select start_row, start_col, v0, v1, v2, (v0 is not null)::bigint + (v1 is not null)::bigint + (v2 is not null)::bigint as filled from w where last is not null")
def window_scan_3x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(windows.valid(windows.scan(event_sheet(spark, sf_dir), ["value"], 3, 1), 3, 1), 3)


@BOOK.add(f"with {LINES_SQL}, w as (select row - 1 as r, l_quantity a, l_discount b, l_tax c, lead(l_quantity) over (order by row) as d, lead(l_discount) over (order by row) as e, lead(l_tax) over (order by row) as f, lead(row) over (order by row) as last from li) select r as start_row, 0 as start_col, a as v0, b as v1, d as v2, e as v3, 4::bigint as filled from w where last is not null union all select r, 1, b, c, e, f, 4::bigint from w where last is not null")
def window_scan_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(windows.scan(line_sheet(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], 2, 2), 4)


@BOOK.add(f"with {LINES_SQL}, w as (select row - 1 as r, l_quantity a, l_discount b, l_tax c, l_extendedprice p, lead(row, 2) over (order by row) as last, lead(l_quantity, 2) over (order by row) as z from li) select r as start_row, 0 as start_col, a as first, z as last_first, 6::bigint as filled from w where last is not null and r % 2 = 0 union all select r, 2, b, lead_b, 6::bigint from (select row - 1 as r, l_discount b, lead(l_discount, 2) over (order by row) as lead_b from li) where lead_b is not null and r % 2 = 0")
def window_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.scan(line_sheet(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3, 2, 2, 2)
    return found.select("start_row", "start_col", F.get("values", 0).alias("first"), F.get("values", 4).alias("last_first"), "filled")


_LINE_CELLS_SQL = f"{LINES_SQL}, lc as ({' union all '.join(f'select row, {i} as col, {c} as num from li' for i, c in enumerate(LINE_VALUES, 1))})"


def _line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(i).alias("col"), F.col(c).alias("num")) for i, c in enumerate(LINE_VALUES, 1)))
    return line_sheet(spark, sf_dir).select("row", F.explode(each).alias("x")).select("row", "x.col", "x.num")


@BOOK.add(f"with {_LINE_CELLS_SQL} select (row - 1) // 5 as tile_row, (col - 1) // 3 as tile_col, count(*) as n_cells, count(num) as n_numbers, round(sum(num), 4) as total from lc group by 1, 2")
def tiles_5x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.tiles(_line_cells(spark, sf_dir), 5, 3).withColumn("tile_col", F.col("tile_col").cast("int")), "total", places=4)


@BOOK.add(f"with {_LINE_CELLS_SQL} select col, min(num) as low, max(num) as high, round(max(num) - min(num), 6) as spread, round(avg(num), 4) as mean, count(*) as n from lc where num is not null group by col")
def axis_stats_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(windows.axis_statistics(_line_cells(spark, sf_dir), "col"), "spread"), "mean", places=4)


@BOOK.add(f"with {_LINE_CELLS_SQL} select row, min(num) as low, max(num) as high, round(max(num) - min(num), 6) as spread, round(avg(num), 4) as mean, count(*) as n from lc where num is not null group by row")
def axis_stats_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(windows.axis_statistics(_line_cells(spark, sf_dir), "row"), "spread"), "mean", places=4)


@BOOK.add(f"with {LINES_SQL} select row, 0 as start_col, l_quantity as v0, l_discount as v1, true as ok from li union all select row, 1, l_discount, l_tax, true from li")
def axis_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.axis_windows(line_sheet(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], 2)
    return found.select("row", "start_col", F.get("values", 0).alias("v0"), F.get("values", 1).alias("v1"), "ok")


_MASK_SQL = "m as (select c_custkey // 40 as row, c_custkey % 40 as col from customer where c_nationkey < 10)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of all customers, forty to a row; cells are filled for the first ten nations and blank for the others."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.lit("grid").alias("sheet"), F.floor(key / 40).alias("row"), (key % 40).cast("long").alias("col"), F.when(F.col("c_nationkey") < 10, F.lit("x")).alias("raw"))


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.filled_mask(_grid(spark, sf_dir))


@BOOK.add(f"""with recursive {_MASK_SQL}, r as (select row, col, row as r, col as c from m union select m.row, m.col, r.r, r.c from r join m on abs(m.row - r.row) + abs(m.col - r.col) = 1),
  l as (select row, col, min(r * 40 + c) as label from r group by row, col), b as (select label, min(row) as top, min(col) as left_col, max(row) as bottom, max(col) as right_col, count(*) as non_empty from l group by label)
  select top, left_col, bottom, right_col, non_empty, round(non_empty / ((bottom - top + 1) * (right_col - left_col + 1)), 6) as density from b where non_empty >= 4 and non_empty / ((bottom - top + 1) * (right_col - left_col + 1)) >= 0.12""")
def regions_4n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(regions.tables(_grid(spark, sf_dir), gap=0).select("top", F.col("left").alias("left_col"), "bottom", F.col("right").alias("right_col"), "non_empty", "density"), "density")


@BOOK.add(f"""with {_MASK_SQL}, c as (select row, col, lag(col) over (partition by row order by col) as b from m), d as (select row, col, lag(row) over (partition by col order by row) as b from m)
  select row, col from m union select row, col - 1 from c where col - b = 2 union select row - 1, col from d where row - b = 2""")
def gap_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.bridge_gaps(_mask(spark, sf_dir), 1).select("row", "col")


_BOXES_SQL = "b as (select s_suppkey as table_id, s_suppkey * 7 % 90 as top, s_suppkey * 3 % 30 as left_col, s_suppkey * 7 % 90 + 9 as bottom, s_suppkey * 3 % 30 + 4 as right_col from supplier)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    top, left = key * 7 % 90, key * 3 % 30
    return table(spark, sf_dir, "supplier").select(F.lit("grid").alias("sheet"), key.alias("table_id"), top.alias("top"), left.alias("left"), (top + 9).alias("bottom"), (left + 4).alias("right"))


@BOOK.add(f"with {_MASK_SQL}, {_BOXES_SQL} select table_id, row, col from m join b on row between top and bottom and col between left_col and right_col")
def bbox_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.within(_mask(spark, sf_dir), _boxes(spark, sf_dir), cell=16).select("table_id", "row", "col")


@BOOK.add(f"with {_MASK_SQL}, {_BOXES_SQL} select row, col from m where not exists (select 1 from b where row between top and bottom and col between left_col and right_col)")
def bbox_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.outside(_mask(spark, sf_dir), _boxes(spark, sf_dir)).select("row", "col")


_PRICED_SQL = "q as (select *, l_quantity as qty, l_extendedprice / l_quantity as price, l_extendedprice as amount, l_extendedprice * l_discount as cut, l_extendedprice - l_extendedprice * l_discount as net from li)"


def _priced(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    lines = line_sheet(spark, sf_dir) if numbered else table(spark, sf_dir, "lineitem")
    return lines.select(*(["row"] if numbered else []), q.alias("qty"), (p / q).alias("price"), p.alias("amount"), (p * d).alias("cut"), (p - p * d).alias("net"), d.alias("rate"))


def _relations_sql(columns: list[str], lag: int | None = None) -> str:
    parts = []
    for r in relations.candidates(columns, lag):
        e = {"+": f"{r.left} + {r.right}", "-": f"{r.left} - {r.right}", "*": f"{r.left} * {r.right}", "/": f"{r.left} / nullif({r.right}, 0)"}[r.sign]
        parts.append(f"select '{r.formula}' as formula, count(*) filter (({e}) is not null) as valid, count(*) filter (abs({r.target} - ({e})) <= greatest(1e-6, abs({e}) * 1e-4)) as support from q")
    return f"""with {LINES_SQL}, {_PRICED_SQL}, c as ({' union all '.join(parts)}) select 'column' as axis, formula, valid, support, round(support / valid, 4) as support_rate, round(least(0.99, support / valid * least(1.0, support / 20)), 4) as confidence
      from c where valid >= 3 and support / valid >= 0.75"""


@BOOK.add(_relations_sql(["qty", "price", "amount", "cut", "net"]))
def relations_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.detect(_priced(spark, sf_dir, numbered=False), ["qty", "price", "amount", "cut", "net"], top=None).drop("sign")


@BOOK.add(_relations_sql(["qty", "price", "amount", "cut", "net"], 1))
def relation_lag_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.detect(_priced(spark, sf_dir, numbered=False), ["qty", "price", "amount", "cut", "net"], lag=1, top=None).drop("sign")


@BOOK.add(f"with {LINES_SQL}, {_PRICED_SQL} select row, round(qty * rate, 6) as expected, round(cut, 6) as actual, round(cut - qty * rate, 6) as difference from (select *, l_discount as rate from q) where abs(cut - qty * rate) > greatest(1e-6, abs(qty * rate) * 1e-4)")
def relation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(relations.violations(_priced(spark, sf_dir), relations.Relation("*", "qty", "rate", "cut"), first=None), "expected", "actual", "difference")


@BOOK.add(f"with {LINES_SQL}, {_PRICED_SQL} select row, round(abs(amount - cut - net), 4) as residual, abs(amount - cut - net) < 0.01 as ok from q")
def coefficient_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(relations.coefficient_rule(_priced(spark, sf_dir), ["amount", "cut", "net"], [1, -1, -1]).select("row", "residual", "ok"), "residual", places=4)


@BOOK.add("""with n as (select distinct l_partkey % 16384 + 1 as col from lineitem) select col, case when col <= 26 then chr((64 + col)::int) when col <= 702 then chr((64 + (col - 1) // 26)::int) || chr((65 + (col - 1) % 26)::int)
  else chr((65 + (col - 703) // 676)::int) || chr((65 + (col - 703) // 26 % 26)::int) || chr((65 + (col - 703) % 26)::int) end as name, col as back from n""")
def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 16384 + 1).alias("col")).distinct()
    return n.withColumn("name", a1.column_name(F.col("col"))).withColumn("back", a1.column_number(F.col("name")).cast("long"))


def _table_relations_sql() -> str:
    columns, parts = ["qty", "amount", "cut", "net"], []
    for i, a in enumerate(columns, 1):
        for j, b in enumerate(columns, 1):
            for t, target in enumerate(columns, 1):
                if i >= j or t in (i, j):
                    continue
                for sign, swap, e in (("+", 0, f"{a} + {b}"), ("-", 0, f"{a} - {b}"), ("-", 1, f"{b} - {a}"), ("*", 0, f"{a} * {b}"), ("/", 0, f"{a} / nullif({b}, 0)"), ("/", 1, f"{b} / nullif({a}, 0)")):
                    p, q = (j, i) if swap else (i, j)
                    parts.append(f"select l_returnflag as sheet, {p} as a, '{sign}' as sign, {q} as b, {t} as t, count({e}) as valid, count(*) filter (abs({target} - ({e})) <= greatest(1e-6, abs({e}) * 1e-4)) as support from q group by 1")
    return f"""with {LINES_SQL}, {_PRICED_SQL}, c as ({' union all '.join(parts)}) select sheet, a, sign, b, t, valid, support, round(least(0.99, support / valid * least(1.0, support / 20)), 4) as confidence from c where valid >= 3 and support / valid >= 0.75"""


@BOOK.add(_table_relations_sql())
def inspector_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations among columns of several tables at once, one for each return flag."""
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    each = F.array(*(F.struct(F.lit(i).alias("c"), v.alias("num")) for i, v in enumerate((q, p, p * d, p - p * d), 1)))
    inside = line_sheet(spark, sf_dir).select(F.col("l_returnflag").alias("sheet"), F.lit(1).alias("table_id"), F.col("row").alias("r"), F.explode(each).alias("x")).select("sheet", "table_id", "r", "x.c", "x.num")
    return inspector.relations(inside).select("sheet", "a", "sign", "b", "t", "valid", "support", "confidence")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a sheet of labels and values, some in one cell."""
    key = F.col("p_partkey")
    cells = [F.when(key % 3 == 0, F.concat(F.lit("品名： "), F.col("p_name"))).otherwise(F.lit("品名:")), F.when(key % 5 == 0, F.lit("12")).otherwise(F.col("p_name")), F.lit("規格"), F.when(key % 7 == 0, F.lit("標準")).otherwise(F.col("p_type")), F.col("p_brand")]
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), key.alias("row"), F.posexplode(F.array(*cells)).alias("col", "raw")).withColumn("col", F.col("col") + 1)


_LABELLED_SQL = """lb as (select p_brand as sheet, p_partkey as row, unnest([1, 2, 3, 4, 5]) as col, unnest([case when p_partkey % 3 = 0 then '品名： ' || p_name else '品名:' end, case when p_partkey % 5 = 0 then '12' else p_name end, '規格', case when p_partkey % 7 = 0 then '標準' else p_type end, p_brand]) as raw from part),
  kv as (select p_brand as sheet, p_partkey as row, 1 as col, '品名' as key, case when p_partkey % 3 = 0 or p_partkey % 5 <> 0 then p_name else '規格' end as value from part union all select p_brand, p_partkey, 3, '規格', case when p_partkey % 7 = 0 then p_brand else p_type end from part)"""


@BOOK.add(f"with {_LABELLED_SQL} select * from kv")
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textwork.key_values(_labelled(spark, sf_dir))


@BOOK.add(f"with {ORDER_CELLS_SQL}, b as (select row, col, raw, 'n' || row % 25 as sheet from oc), s as (select 'n' || n_nationkey as sheet, n_nationkey * 10 as first, n_nationkey * 10 + 400 as last from nation where n_nationkey % 2 = 0) select b.sheet, row, col, raw from b left join s using (sheet) where first is null or row between first and last")
def row_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir).select(F.concat(F.lit("n"), F.col("row") % 25).alias("sheet"), "row", "col", "raw")
    key = F.col("n_nationkey")
    slices = table(spark, sf_dir, "nation").where(key % 2 == 0).select(F.concat(F.lit("n"), key).alias("sheet"), (key * 10).alias("first"), (key * 10 + 400).alias("last"))
    return textwork.row_slices(cells, slices)


@BOOK.add(r"""with a as (select distinct substring(p_name, 1, length(p_name) - 1) as x from part where p_partkey % 50 = 0), b as (select distinct p_name as x from part),
  w as (select 0 as side, x, unnest(regexp_extract_all(lower(x), '[\p{L}\p{N}_]{2,}')) as g from a union all select 1, x, unnest(regexp_extract_all(lower(x), '[\p{L}\p{N}_]{2,}')) from b),
  f as (select side, x, g, count(*) as tf from w group by all), i as (select g, ln(((select count(*) from a) + (select count(*) from b) + 1) / (count(*) + 1)) + 1 as idf from f group by g),
  v as (select side, x, g, tf * idf as w, sqrt(sum(tf * idf * tf * idf) over (partition by side, x)) as norm from f join i using (g)),
  s as (select p.x as name, q.x as match, sum(p.w / p.norm * q.w / q.norm) as score from v p join v q on p.g = q.g and p.side = 0 and q.side = 1 group by all)
  select name, match, round(score, 6) as score from (select *, row_number() over (partition by name order by round(score, 9) desc, match) as r from s where score > 0.3) where r = 1""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, their last letter missing, against the names themselves."""
    names = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.expr("substring(p_name, 1, length(p_name) - 1)").alias("name"))
    return textwork.fuzzy_names(names, table(spark, sf_dir, "part").select(F.col("p_name").alias("known"))).withColumn("score", F.round("score", 6))


@BOOK.add(rf"""with {_LABELLED_SQL}, e as (select sheet, 1 as rank, row, col, 0 as i, value as term from kv union all select sheet, 3, row, col, 0, raw from lb where raw not in ('12', '標準')),
  f as (select sheet, lower(term) as low, min(rank::bigint * 1000000000 + row * 100 + col) as spot, arg_min(term, rank::bigint * 1000000000 + row * 100 + col) as term from e group by all), r as (select *, row_number() over (partition by sheet order by spot) as n from f)
  select sheet, string_agg(term, '|' order by spot) as keywords from r where n <= 50 group by sheet""")
def sheet_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First terms of each brand's parts."""
    return textwork.sheet_keywords(_labelled(spark, sf_dir)).select("sheet", F.concat_ws("|", "keywords").alias("keywords"))
