"""Queries of table layouts: header rows, index columns, labels, numeric areas, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.coerce import cell_type
from quadrille.operators import headers, inspector
from quadrille.operators.numbering import number_rows
from quadrille.queries.base import ORDER_CELLS_SQL, Book, line_sheet, order_cells, table
from quadrille.queries.sheets import _table_relations_sql

BOOK = Book()


def _inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one sheet of tables of twenty rows, the first one to three of which name the columns."""
    o = number_rows(table(spark, sf_dir, "orders"), ["o_orderkey"])
    t, r, key = F.floor((F.col("row") - 1) / 20), (F.col("row") - 1) % 20 + 1, F.col("o_orderkey")
    second = F.when(t % 2 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("P"), "o_custkey"))
    third = F.when(key % 61 == 0, F.lit("±3")).when(key % 97 == 0, F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string"))
    data = [F.concat(F.lit("K"), key), second, third, F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(key % 3 == 0, F.lit("")).otherwise((key % 50).cast("string"))]
    names = [F.concat(F.lit("SS" if c == 1 else "h"), (r - 1) % 2, F.lit("c"), F.lit(c)) for c in range(1, 6)]
    cells = F.array(*(F.when(r <= t % 3 + 1, n).otherwise(d) for n, d in zip(names, data, strict=True)))
    out = o.select(F.lit("orders").alias("sheet"), t.alias("table_id"), "row", r.alias("r"), F.posexplode(cells).alias("c", "raw")).withColumn("c", F.col("c") + 1)
    return out.withColumn("ctype", cell_type(F.col("raw")))


def _boxes(inside: DataFrame) -> DataFrame:
    return inside.groupBy("sheet", "table_id").agg(F.min("row").alias("top"), F.min("c").alias("left"), F.max("row").alias("bottom"), F.max("c").alias("right"))


_INSIDE_SQL = """o as (select *, row_number() over (order by o_orderkey) as row from orders), p as (select *, (row - 1) // 20 as t, (row - 1) % 20 + 1 as r, o_orderkey as key from o),
  q as (select t as table_id, row, r, unnest([1, 2, 3, 4, 5]) as c, case when r <= t % 3 + 1 then unnest(['SS', 'h', 'h', 'h', 'h']) || (r - 1) % 2 || 'c' || unnest([1, 2, 3, 4, 5]) else unnest(['K' || key, case when t % 2 = 0 then o_orderpriority else 'P' || o_custkey end,
    case when key % 61 = 0 then '±3' when key % 97 = 0 then o_orderpriority else cast(o_totalprice as varchar) end, strftime(o_orderdate, '%Y-%m-%d'), case when key % 3 = 0 then '' else cast(key % 50 as varchar) end]) end as raw from p),
  x as (select *, case when trim(raw) = '' then 'empty' when regexp_matches(raw, '^[0-9.]+$') then case when cast(raw as double) = floor(cast(raw as double)) then 'integer' else 'number' end when regexp_matches(raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then 'date' else 'string' end as ctype from q),
  b as (select table_id, max(r) as h, min(row) as top, max(row) as bottom from x group by table_id)"""

_SCORES_SQL = f"""{_INSIDE_SQL}, lk as (select table_id, h, i from b, unnest([1, 2, 3, 4, 5]) as u(i) where i <= h),
  tp as (select table_id, r as i, count(*) as filled, count(*) filter (ctype in ('string', 'date')) as text, count(distinct raw) as different from x where ctype <> 'empty' group by all),
  kn as (select lk.table_id, i, c, ctype, count(*) as n from lk join x on x.table_id = lk.table_id and x.r > i and ctype <> 'empty' group by all),
  pc as (select table_id, i, c, sum(case when ctype in ('integer', 'number') then n else 0 end) / sum(n) as u, sum(case when ctype = 'date' then n else 0 end) / sum(n) as d, max(n) / sum(n) as m from kn group by all having sum(n) >= 2),
  st as (select table_id, i, avg((case when u >= 0.8 then u when d >= 0.8 then d else m end >= 0.7)::int) as steady from pc group by all),
  sc as (select lk.table_id, lk.h, i, coalesce(0.3::double * text / filled + 0.2::double * different / filled + 0.2::double * filled / 5 + 0.3::double * coalesce(steady, 0), 0) as score from lk left join tp using (table_id, i) left join st using (table_id, i))"""

_FOUND_SQL = f"""{_SCORES_SQL}, pv as (select table_id, h, max(score) filter (i = 1) as s1, coalesce(max(score) filter (i = 2), 0) as s2, coalesce(max(score) filter (i = 3), 0) as s3 from sc group by all),
  hd as (select *, least(case when s3 > 0.75 and least(s1, s2) > 0.55 then 3 when s2 > 0.72 and s1 > 0.5 then 2 else 1 end, h - 1) as header_rows from pv),
  cl as (select hd.table_id, header_rows, h, c, count(*) as n, count(*) filter (ctype in ('string', 'date', 'integer')) as named, count(*) filter (ctype in ('integer', 'number')) as numbers, count(distinct raw) as different from hd join x on x.table_id = hd.table_id and r > header_rows and ctype <> 'empty' group by all),
  ci as (select table_id, c, greatest(0, 0.35::double * named / n + 0.35::double * different / n + 0.3::double * n / (h - header_rows) - 0.75::double * numbers / n) as score from cl),
  cp as (select table_id, coalesce(max(score) filter (c = 1), 0) as t1, coalesce(max(score) filter (c = 2), 0) as t2 from ci group by all),
  fd as (select *, case when t1 >= 0.62 and t2 >= 0.72 then 2 when t1 >= 0.62 then 1 else 0 end as index_cols from hd join cp using (table_id) join (select table_id, top, bottom from b) using (table_id))"""


@BOOK.add(f"with {_SCORES_SQL} select table_id, i as r, round(score, 6) as score from sc")
def header_row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = _inside(spark, sf_dir)
    return headers.header_row_scores(inside, _boxes(inside)).select("table_id", "r", F.round("score", 6).alias("score"))


@BOOK.add(f"""with {_FOUND_SQL} select table_id, header_rows, index_cols, round(case header_rows when 3 then greatest(s1, s2, s3) when 2 then greatest(s1, s2) else s1 end, 4) as header_confidence,
  round(case index_cols when 2 then greatest(t1, t2) else t1 end, 4) as index_confidence, top + header_rows as data_top, 1 + index_cols as data_left, bottom as data_bottom, 5 as data_right from fd""")
def header_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = _inside(spark, sf_dir)
    return headers.infer(inside, _boxes(inside)).drop("sheet")


@BOOK.add(f"""with {_FOUND_SQL}, e as (select table_id, header_rows, unnest(range(index_cols + 1, 6)) as c from fd)
  select e.table_id, e.c, coalesce(string_agg(trim(raw), ' / ' order by r), 'col_' || e.c) as label from e left join x on x.table_id = e.table_id and x.c = e.c and r <= header_rows and trim(raw) <> '' group by e.table_id, e.c""")
def column_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = _inside(spark, sf_dir)
    boxes = _boxes(inside)
    return headers.labels(inside, boxes, headers.infer(inside, boxes)).drop("sheet")


@BOOK.add(f"with {_INSIDE_SQL} select table_id, c, coalesce(nullif(trim(raw), ''), 'col_' || c) as header from x where r = 1")
def guessed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = _inside(spark, sf_dir)
    return headers.guessed_headers(inside, _boxes(inside)).drop("sheet")


@BOOK.add(f"""with {_INSIDE_SQL}, f as (select * from x where trim(raw) <> ''),
  r1 as (select f.table_id, count(*) / 5 + avg(regexp_matches(raw, '\\p{{L}}')::int) + count(distinct lower(raw)) / count(*) + avg(coalesce((select count(*) from f g where g.table_id = f.table_id and g.c = f.c and g.r > 1) / nullif(h - 1, 0), 0)) as s from f join b using (table_id) where r = 1 group by f.table_id),
  c1 as (select f.table_id, count(*) / any_value(h) + avg(regexp_matches(raw, '\\p{{L}}')::int) + count(distinct lower(raw)) / count(*) + avg((select count(*) from f g where g.table_id = f.table_id and g.r = f.r and g.c > 1) / 4) as s from f join b using (table_id) where c = 1 group by f.table_id)
  select table_id, round(r1.s / 4, 3) as row_score, round(c1.s / 4, 3) as col_score, round(r1.s / 4, 3) >= 0.3 as index_row, round(c1.s / 4, 3) >= 0.3 as index_col from r1 join c1 using (table_id)""")
def header_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = _inside(spark, sf_dir)
    return headers.header_signals(inside, _boxes(inside)).drop("sheet")


@BOOK.add(f"""with {ORDER_CELLS_SQL} select col, count(*) filter (ctype <> 'empty') as non_empty, count(*) filter (ctype in ('string', 'date')) as text, count(*) filter (ctype in ('integer', 'number')) as numeric,
  round(count(*) filter (ctype in ('string', 'date')) / count(*) filter (ctype <> 'empty'), 6) as text_ratio, round(count(*) filter (ctype in ('integer', 'number')) / count(*) filter (ctype <> 'empty'), 6) as numeric_ratio from oc group by col""")
def line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = headers.line_statistics(order_cells(spark, sf_dir), "col").drop("sheet")
    return out.withColumns({c: F.round(c, 6) for c in ("text_ratio", "numeric_ratio")})


@BOOK.add("select l_orderkey, count(*) as n, count(*) >= 3 and count(distinct l_linenumber) = count(*) and max(l_linenumber) - min(l_linenumber) = count(*) - 1 as sequential from lineitem group by l_orderkey")
def sequential_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.sequential(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("text")), ["l_orderkey"], "text")


_TILES_SQL = """select (row - 1) // 6 as tile_row, c - 1 as tile_col, count(*) as n_filled, count(*) filter (regexp_matches(raw, '^±?[0-9.]+$')) as n_numbers,
  cast(sum(case when regexp_matches(raw, '^±?[0-9.]+$') then 0 when raw like '%SS%' or raw like '%LW%' or raw like '%SW%' or raw like '%RH%' then 3 else 1 end) as bigint) as n_text from x group by 1, 2"""


@BOOK.add(f"with {_INSIDE_SQL}, tl as ({_TILES_SQL}) select *, n_numbers >= 2 and n_numbers / n_filled >= 0.7 and n_text <= n_filled * 0.3 as is_data from tl")
def numeric_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.numeric_areas(_inside(spark, sf_dir).withColumnRenamed("c", "col"), 6, 1).drop("sheet")


@BOOK.add(f"with {_INSIDE_SQL}, tl as ({_TILES_SQL}) select tile_row * 6 as start_row, tile_col as start_col, n_numbers from tl where n_numbers >= 2 and n_numbers / n_filled >= 0.7")
def data_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = headers.numeric_areas(_inside(spark, sf_dir).withColumnRenamed("c", "col"), 6, 1, strict=False).where("is_data")
    return found.select((F.col("tile_row") * 6).alias("start_row"), F.col("tile_col").alias("start_col"), "n_numbers")


@BOOK.add(f"""with {_INSIDE_SQL}, y as (select table_id, r, (c + 1) // 2 as c, raw from x where c % 2 = 1), z as (select table_id, max(r) as h, count(*) as n, count(*) filter (raw = '') as missing,
  count(*) filter (r >= 4 and c >= 2 and raw <> '' and not regexp_matches(raw, '^[0-9.]+$') and raw not like '%±%') as inner_text, count(*) filter (raw <> '' and not regexp_matches(raw, '^[0-9.]+$')) as any_text from y group by table_id)
  select table_id, case when h >= 4 then inner_text = 0 else any_text = 0 end as is_numeric, round(missing / n, 6) as missing_ratio from z""")
def numeric_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _inside(spark, sf_dir).where("c % 2 = 1").select(F.col("table_id").cast("string").alias("sheet"), F.col("r").alias("row"), F.floor((F.col("c") + 1) / 2).alias("col"), "raw")
    return headers.numeric_tables(cells).select(F.col("sheet").cast("long").alias("table_id"), "is_numeric", F.round("missing_ratio", 6).alias("missing_ratio"))


_DENSE_SQL = """m as (select c_custkey // 40 + 1 as row, c_custkey % 40 + 1 as col from customer where c_nationkey < 18), b as (select s_suppkey as table_id, s_suppkey * 7 % 37 + 1 as top, s_suppkey * 3 % 30 + 1 as l, s_suppkey * 7 % 37 + 10 as bottom, s_suppkey * 3 % 30 + 5 as r from supplier)"""


def _dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key, s = F.col("c_custkey"), F.col("s_suppkey")
    cells = table(spark, sf_dir, "customer").select(F.lit("grid").alias("sheet"), (F.floor(key / 40) + 1).alias("row"), (key % 40 + 1).alias("col"), F.when(F.col("c_nationkey") < 18, F.lit("x")).alias("raw"))
    top, left = s * 7 % 37 + 1, s * 3 % 30 + 1
    return cells, table(spark, sf_dir, "supplier").select(F.lit("grid").alias("sheet"), s.alias("table_id"), top.alias("top"), left.alias("left"), (top + 9).alias("bottom"), (left + 4).alias("right"))


@BOOK.add(f"with {_DENSE_SQL}, c as (select table_id, row from b join m on row between greatest(1, top - 3) and top - 1 and col between l and r group by all having count(*) >= 2.5) select table_id, min(row) as row from c group by table_id")
def column_header_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.column_headers(*_dense(spark, sf_dir)).drop("sheet")


@BOOK.add(f"with {_DENSE_SQL}, c as (select table_id, col from b join m on col between greatest(1, l - 3) and l - 1 and row between top and bottom group by all having count(*) >= 7) select table_id, min(col) as col from c group by table_id")
def row_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.row_indexes(*_dense(spark, sf_dir)).drop("sheet")


@BOOK.add("""with b as (select s_suppkey as table_id, s_suppkey * 7 % 90 + 1 as t, s_suppkey * 3 % 30 + 1 as l, s_suppkey * 7 % 90 + 1 + s_suppkey * 13 % 500 as bt, s_suppkey * 3 % 30 + 1 + s_suppkey % 41 as rt from supplier),
  d as (select *, unnest(range(t, bt + 1, 100)) as top from b), e as (select *, unnest(range(l, rt + 1, 15)) as le from d), f as (select *, least(top + 99, bt) as bottom, least(le + 14, rt) as re from e),
  g as (select *, case when le <= 26 then chr((64 + le)::int) else chr((64 + (le - 1) // 26)::int) || chr((65 + (le - 1) % 26)::int) end as ln, case when re <= 26 then chr((64 + re)::int) else chr((64 + (re - 1) // 26)::int) || chr((65 + (re - 1) % 26)::int) end as rn from f)
  select table_id, row_number() over (partition by table_id order by top, le) - 1 as block, top, bottom, ln || top || ':' || rn || bottom as address from g""")
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    top, left = s * 7 % 90 + 1, s * 3 % 30 + 1
    boxes = table(spark, sf_dir, "supplier").select(F.lit("grid").alias("sheet"), s.alias("table_id"), top.alias("top"), left.alias("left"), (top + s * 13 % 500).alias("bottom"), (left + s % 41).alias("right"))
    return headers.blocks(boxes).select("table_id", "block", "top", "bottom", "address")


@BOOK.add(_table_relations_sql())
def relations_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inspector's relations among rows: lines of an order sheet as columns, their four amounts as rows."""
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    each = F.array(*(F.struct(F.lit(i).alias("r"), v.alias("num")) for i, v in enumerate((q, p, p * d, p - p * d), 1)))
    inside = line_sheet(spark, sf_dir).select(F.col("l_returnflag").alias("sheet"), F.lit(1).alias("table_id"), F.col("row").alias("c"), F.explode(each).alias("x")).select("sheet", "table_id", "x.r", "c", "x.num")
    return inspector.relations(inside, "row").select("sheet", "a", "sign", "b", "t", "valid", "support", "confidence")
