"""Queries of rules that are rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import retrospective, ruletable
from quadrille.queries.base import Book, table

BOOK = Book()

#: Each line as an equation between numbers, in eleven forms; SQL works out the sides from the columns.
_FORMS = ("{q} * {p} = {e}", "{e} = {e} * (1 - {d}) + {t}", "-{q} ** 2 = 0 - {q} * {q}", "{e} == {e}", "{e} - {q}", "{q} {q} = 1", "{q} = 重量", "{e} / {d} = 1", "({q} + {t}) * 2 // 3 = abc", "1e3 = {q} * 20", "{q} - -{q} = 2 * {q}")


@BOOK.add("""with l as (select *, (l_orderkey + l_linenumber) % 11 as k, l_quantity as q, l_extendedprice as e, l_discount as d, l_tax as t, l_suppkey::double as p from lineitem),
  v as (select l_orderkey, l_linenumber, k, case k when 0 then q * p when 1 then e when 2 then -(q * q) when 6 then q when 7 then case when d <> 0 then e / d end when 8 then floor((q + t) * 2 / 3) when 9 then 1000.0 when 10 then q + q end as left_value,
    case k when 0 then e when 1 then e * (1 - d) + t when 2 then 0 - q * q when 5 then 1.0 when 7 then 1.0 when 9 then q * 20 when 10 then 2 * q end as right_value from l)
  select l_orderkey, l_linenumber, round(left_value, 6) as left_value, round(right_value, 6) as right_value, case when k = 3 then 'format' when k = 4 then 'no_sign' when left_value is null then 'left' when k = 6 then 'field_names' when right_value is null then 'right' when abs(left_value - right_value) < 0.01 then 'ok' else 'differs' end as status,
    case when k in (3, 4) or left_value is null then false when k = 6 then true else coalesce(abs(left_value - right_value) < 0.01, false) end as is_correct from v""")
def literal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"{q}": "l_quantity", "{e}": "l_extendedprice", "{d}": "l_discount", "{t}": "l_tax", "{p}": "l_suppkey"}
    text = F.element_at(F.array(*map(F.lit, _FORMS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 11 + 1).cast("int"))
    for mark, column in values.items():
        text = F.replace(text, F.lit(mark), F.col(column).cast("string"))
    found = ruletable.literal_equations(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("equation")))
    return found.select("l_orderkey", "l_linenumber", F.round("left_value", 6).alias("left_value"), F.round("right_value", 6).alias("right_value"), "status", "is_correct")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a window of one row, named by its part."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("start_row"), F.lit(0).alias("start_col"), F.col("l_partkey").cast("string").alias("row_name"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("values"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rules for each part, from its price and size, and five for all lines."""
    price, size = F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")
    texts = [
        F.concat(F.lit("$(0,0) * "), price, F.lit(" = $(0,1)")),
        F.lit("$(0,1) - $(0,1) * $(0,2) = (0,1) * (1 - $(0,2))"),
        F.concat(F.lit("$(0,2)+$(0,3) = 0.0"), (F.col("p_size") % 10).cast("string")),
        F.concat(F.lit("`$ (0,0) // "), size, F.lit("` = 2")),
        F.concat(F.lit("-$(0,3) ** 2 * "), size, F.lit(" ＝ -$(0,2) / $(0,0)")),
    ]
    of_part = table(spark, sf_dir, "part").select((F.col("p_partkey") * 5).alias("base"), F.col("p_partkey").cast("string").alias("row_name"), F.posexplode(F.array(*texts)).alias("k", "equation"))
    for_all = table(spark, sf_dir, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("rule_id"), F.concat(F.lit("$0 = "), (F.col("r_regionkey") * 10 + 1).cast("string")).alias("equation"), F.lit(None).cast("string").alias("row_name"))
    return of_part.select((F.col("base") + F.col("k")).alias("rule_id"), "equation", "row_name").unionByName(for_all)


_CHECKED_SQL = """with l as (select l_orderkey * 8 + l_linenumber as start_row, l_partkey, l_quantity as q, l_extendedprice as e, l_discount as d, l_tax as t, p_retailprice as p, p_size as s from lineitem left join part on p_partkey = l_partkey),
  c as (select start_row, l_partkey * 5 + k as rule_id, case k when 0 then abs(q * p - e) <= 0.01 when 1 then abs((e - e * d) - e * (1 - d)) <= 0.01 when 2 then abs((d + t) - (s % 10) / 100.0::double) <= 0.01 when 3 then floor(q / nullif(s, 0)) = 2 else abs(-(t * t) * s - -d / q) <= 0.01 end as ok from l, (select unnest(range(5)) as k) where p is not null
    union all select start_row, -1 - r_regionkey, q = r_regionkey * 10 + 1 from l, region)"""


@BOOK.add(f"{_CHECKED_SQL} select rule_id, count(*) as checks, count(*) filter (ok) as passed, round(count(*) filter (ok) / count(*), 6) as consistency_rate from c group by rule_id")
def rule_table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ruletable.by_rule(ruletable.checks(_windows(spark, sf_dir), _rules(spark, sf_dir), 1, 4))
    return found.select("rule_id", "checks", "passed", F.round("consistency_rate", 6).alias("consistency_rate"))


@BOOK.add(f"{_CHECKED_SQL} select start_row, count(*) as total_rules, count(*) filter (ok) as valid_rules, round(count(*) filter (ok) / count(*), 6) as success_rate from c group by start_row")
def rule_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ruletable.validation(ruletable.checks(_windows(spark, sf_dir), _rules(spark, sf_dir), 1, 4))
    return found.select("start_row", "total_rules", "valid_rules", F.round("success_rate", 6).alias("success_rate"))


def _grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines as windows, grouped by flag, status and number, and the rules that some of them name, with spaces of many kinds."""
    lines = table(spark, sf_dir, "lineitem").withColumn("row_name", F.concat_ws("-", "l_returnflag", "l_linestatus", "l_linenumber"))
    windows = lines.select("row_name", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("values"))
    n = F.col("l_linenumber")
    texts = F.array(
        F.concat(F.lit("$(0,0) =  "), (n * 5).cast("string")), F.concat(F.lit(" $(0,2) + $(0,3) = 0.0"), (n % 4).cast("string")),
        F.when(n % 2 == 0, "$(0,0) * $(0,2) = $(0,0) * $(0,3)").otherwise("$(0,0)\t= $(0,0) +  $(9,9)"), F.when(n == 3, "$(0,1) > 5").otherwise(" "))
    return windows, lines.select("row_name", F.explode(texts).alias("equation"))


_MATRIX_SQL = """with w as (select l_returnflag || '-' || l_linestatus || '-' || l_linenumber as g, l_linenumber as n, l_quantity as q, l_discount as d, l_tax as t from lineitem),
  r as (select distinct g, case k when 0 then '$(0,0) = ' || n * 5 when 1 then '$(0,2) + $(0,3) = 0.0' || n % 4 when 2 then case when n % 2 = 0 then '$(0,0) * $(0,2) = $(0,0) * $(0,3)' else '$(0,0) = $(0,0) + $(9,9)' end when 3 then '$(0,1) > 5' end as equation, k, n from w, (select unnest(range(4)) as k) where k < 3 or n = 3),
  e as (select distinct equation, k, case k when 0 then n * 5 when 1 then n % 4 end as m, k = 2 and n % 2 = 0 as even from r),
  c as (select g, equation, count(*) filter (case k when 0 then abs(q - m) <= 0.01 when 1 then abs(d + t - m / 100) <= 0.01 when 2 then even and abs(q * d - q * t) <= 0.01 else false end) as v from w, e group by all),
  s as (select g, count(*) as total from w group by g)"""


@BOOK.add(f"""{_MATRIX_SQL}, x as (select r.g as rule_group, c.g as window_group, r.g = c.g as own, equation, v as valid_windows, total - v as invalid_windows, total as total_windows, round(v / total, 6) as consistency_rate from r join c using (equation) join s on s.g = c.g where v > 0 or r.g = c.g) select * from x""")
def retrospective_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrospective.matrix(*_grouped(spark, sf_dir), 1, 4).withColumn("consistency_rate", F.round("consistency_rate", 6))


@BOOK.add(f"""{_MATRIX_SQL}, f as (select r.g, equation, bool_or(c.g <> r.g and v > 0) as far, max(v) filter (c.g = r.g) / max(total) as rate, max(total) as total from r join c using (equation) join s on s.g = r.g group by all)
  select g as row_name, total as window_count, count(*) as total_rules, round(avg(rate), 6) as mean_rate, count(*) filter (far) as carried from f group by all""")
def retrospective_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrospective.by_group(retrospective.matrix(*_grouped(spark, sf_dir), 1, 4)).withColumn("mean_rate", F.round("mean_rate", 6))
