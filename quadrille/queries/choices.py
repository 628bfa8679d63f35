"""Queries of drop-down lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import a1
from quadrille.operators import validations
from quadrille.queries.base import Book, table

BOOK = Book()


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of parts in a sheet of thirty columns; one in seven is blank."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.lit("grid").alias("sheet"), F.floor(key / 30 + 1).cast("int").alias("row"), (key % 30 + 1).cast("int").alias("col"), F.when(key % 7 != 0, F.col("p_brand")).alias("raw"))


def _validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier a list over two areas, of five sorts; they overlap."""
    k = F.col("s_suppkey")
    row, col = (k * 37 % 900 + 1).cast("int"), (k * 3 % 28 + 1).cast("int")
    sqref = F.concat(a1.area(row, col, row + (k % 2).cast("int"), col + (k % 3 % 2).cast("int")), F.lit(" $A$1 "), a1.cell(row + 3, col), F.lit(" none"))
    formula = F.when(k % 5 == 0, F.lit('"yes, no,,""maybe"')).when(k % 5 == 1, F.lit("=grid!$A$1:$B$2")).when(k % 5 == 2, F.concat(F.lit("='other sheet'!C"), (k % 9 + 1).cast("string"))).when(k % 5 == 3, F.lit("=named_range")).otherwise(F.lit("a,b"))
    return table(spark, sf_dir, "supplier").select(F.lit("grid").alias("sheet"), k.alias("rank"), F.when(k % 11 == 0, "whole").otherwise("List").alias("type"), sqref.alias("sqref"), formula.alias("formula1"))


_CELLS_SQL = "ce as (select p_partkey // 30 + 1 as row, p_partkey % 30 + 1 as col, case when p_partkey % 7 <> 0 then p_brand end as raw from part)"
_CLUSTERS_SQL = f"""{_CELLS_SQL}, v as (select s_suppkey as k, s_suppkey * 37 % 900 + 1 as r, s_suppkey * 3 % 28 + 1 as c, case when s_suppkey % 11 = 0 then 'whole' else 'list' end as type from supplier),
  o as (select *, case k % 5 when 0 then ['yes', 'no', 'maybe'] when 1 then coalesce((select list(raw order by row, col) from ce where row <= 2 and col <= 2 and raw is not null), []) when 2 then coalesce((select list(raw) from ce where row = k % 9 + 1 and col = 3 and raw is not null), []) when 3 then [] else ['a', 'b'] end as options,
    case k % 5 when 3 then '=named_range' when 2 then '=''other sheet''!C' || (k % 9 + 1) when 1 then '=grid!$A$1:$B$2' else '' end as formula from v),
  x as (select k, 0 as n, r + unnest(range(0, k % 2 + 1)) as row, c, k % 3 % 2 as w from o), x1 as (select k, n, row, c + unnest(range(0, w + 1)) as col from x union all select k, 2, r + 3, c from o),
  x2 as (select row, col, min(struct_pack(k := k, n := n, r := row, c := col)) as place, max(struct_pack(k := k, n := n)).k as k from x1 group by row, col),
  l as (select x2.row, x2.col, place, options, formula, case when len(options) > 0 then array_to_string(options, chr(31)) else '=' || formula end as sig, o.k % 5 as sort from x2 join o using (k) where type = 'list'),
  r1 as (select *, count(*) over (partition by row) as n, min(sig) over (partition by row) = max(sig) over (partition by row) as one from l), r2 as (select *, count(*) over (partition by col) as m, min(sig) over (partition by col) = max(sig) over (partition by col) as one2 from r1 where n < 2),
  cl as (select row, col, place, options, sort, case when one then 'row_uniform' else 'row_mixed' end as kind, row as number from r1 where n >= 2 union all select row, col, place, options, sort, case when m < 2 then 'scattered' when one2 then 'col_uniform' else 'col_mixed' end, case when m >= 2 then col end from r2)"""


@BOOK.add(f"with {_CLUSTERS_SQL} select row, col, kind, number, array_to_string(options, '|') as options from cl")
def validation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validations.clustered(validations.by_cell(validations.resolved(_validations(spark, sf_dir), _cells(spark, sf_dir))))
    return found.select("row", "col", "kind", "number", F.array_join("options", "|").alias("options"))


_A1_SQL = "case when {0} > 26 then chr((64 + ({0} - 1) // 26)::int) else '' end || chr((65 + ({0} - 1) % 26)::int)"


@BOOK.add(f"""with {_CLUSTERS_SQL}, s as (select cl.*, case when kind = 'scattered' then row * 1000 + col end as own, nullif(trim(raw), '') as chosen, {_A1_SQL.format('cl.col')} || cl.row as cell from cl left join ce using (row, col)),
  u as (select kind, number, own, chosen, min(place) as p from s where chosen is not null group by all), uu as (select kind, number, own, list(chosen order by p) as ch from u group by all),
  ex as (select kind, number, string_agg(cell || '(' || len(options) || '項' || coalesce(',選「' || chosen || '」', '') || ')', '; ' order by place) as e from (select *, row_number() over (partition by kind, number order by place) as i from s where kind like '%mixed') where i <= 3 group by all),
  g as (select kind, number, own, min(row)::int as top, min(col)::int as "left", max(row)::int as bottom, max(col)::int as "right", count(*) as n_cells, arg_min(options, place) as options, arg_min(sort, place) as sort from s group by all),
  h as (select g.*, coalesce(ch, []) as ch, e, nullif(array_to_string(options, '、'), '') as joined from g left join uu on uu.kind = g.kind and uu.number is not distinct from g.number and uu.own is not distinct from g.own left join ex on ex.kind = g.kind and ex.number = g.number)
  select kind, number::int as number, top, "left", bottom, "right", n_cells, case when kind like '%uniform' then '[下拉選單|list|' || kind[1:3] || '=' || number || '|range=' || {_A1_SQL.format('"left"')} || top || ':' || {_A1_SQL.format('"right"')} || bottom || '|option_count=' || len(options) || '|cells=' || n_cells || coalesce('|selected=' || ch[1], '') || '] ' || case when kind like 'row%' then '全列' else '全欄' end
      || coalesce('共用選項: ' || joined, '共用下拉選單') || '；' || case len(ch) when 0 then '目前無選值' when 1 then '目前皆為「' || ch[1] || '」' else '目前選值: ' || array_to_string(ch, '、') end
    when kind like '%mixed' then '[下拉選單|list|' || kind[1:3] || '=' || number || '|pattern=mixed|cells=' || n_cells || '] 例: ' || e
    else '[下拉選單|list|anchor=' || {_A1_SQL.format('"left"')} || top || '|option_count=' || len(options) || coalesce('|selected=' || ch[1], '') || '] ' || coalesce('選項: ' || joined, case when sort in (1, 2, 3) then '選項: (公式參照未解析, options_source=formula_ref_unresolved)' else '選項: (未解析)' end) end as line from h""")
def validation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    found = validations.clustered(validations.by_cell(validations.resolved(_validations(spark, sf_dir), cells)))
    return validations.annotations(found, cells).drop("sheet")
