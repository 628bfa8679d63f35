"""Queries of what discovery says of its rules: summaries, kept and renewed verdicts, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import audit, degeneracy, grouped, relations, summaries
from quadrille.queries.base import Book, table
from quadrille.queries.rulework import _checked, _checks_sql
from quadrille.queries.sheets import _priced, _relations_sql

BOOK = Book()


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_RATES_SQL = f"{_checks_sql()}, ra as (select row_name, equation, avg(ok::int) as rate, count(*) as n from k group by all), gs as (select row_name, max(n) as window_count, count(*) as rules_found, count(*) filter (rate >= 0.1) as rules_passed from ra group by row_name)"


@BOOK.add(f"with {_RATES_SQL} select *, round(rules_passed / rules_found, 6) as passed_rate, rules_passed > 0 as is_valid from gs")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summaries.group_summary(audit.consistency(_checked(spark, sf_dir)), 0.1), "passed_rate")


@BOOK.add(f"with {_RATES_SQL} select count(*) as groups, count(*) filter (rules_passed > 0) as valid_groups, round(avg((rules_passed > 0)::int), 6) as success_rate from gs")
def group_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summaries.overall(summaries.group_summary(audit.consistency(_checked(spark, sf_dir)), 0.1)), "success_rate")


_STATISTICS_SQL = f"""{_checks_sql()}, w2 as (select row_name, count(distinct start_row) as windows from k group by 1 having count(distinct start_row) >= 2), nm as (select row_name, equation, count(*) as n, count(*) filter (ok) as p, count(distinct start_row) as iw from k group by all),
  rs as (select equation, cast(sum(n) as bigint) as validations, cast(sum(p) as bigint) as valid_count, sum(p) / sum(n) as valid_ratio, sum(iw / windows) / (select count(*) from w2) as consistency_rate from nm left join w2 using (row_name) group by equation)"""


@BOOK.add(f"with {_STATISTICS_SQL} select equation, validations, valid_count, round(valid_ratio, 6) as valid_ratio, round(consistency_rate, 6) as consistency_rate, consistency_rate >= 0.8 as passes from rs")
def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summaries.rule_statistics(_checked(spark, sf_dir)), "valid_ratio", "consistency_rate")


@BOOK.add(f"""with {_STATISTICS_SQL} select count(*) as rules_found, count(*) filter (consistency_rate >= 0.8) as rules_passed, cast(sum(validations) as bigint) as validations, cast(sum(valid_count) as bigint) as valid, cast(sum(valid_count) filter (consistency_rate >= 0.8) as bigint) as valid_of_passed,
  round(count(*) filter (consistency_rate >= 0.8) / count(*), 6) as pass_rate, round(sum(valid_count) / sum(validations), 6) as valid_ratio, round(sum(valid_count) filter (consistency_rate >= 0.8) / sum(validations), 6) as passed_ratio from rs""")
def rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summaries.totals(summaries.rule_statistics(_checked(spark, sf_dir))), "pass_rate", "valid_ratio", "passed_ratio")


@BOOK.add(f"with {_checks_sql()} select equation, cast(place as int) as place, start_row, start_col, row_name, ok from (select *, row_number() over (partition by equation order by start_row) as place from k) where place <= 3")
def rule_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.example_windows(_checked(spark, sf_dir))


@BOOK.add(f"""with {_checks_sql()}, h as (select *, 'seen ' || start_row % 3 as description from k where ok), z as (select row_name, count(distinct start_row) as windows from h group by 1), d as (select row_name, equation, description, count(*) as n, min(start_row) as f from h group by all),
  s as (select row_name, equation, sum(n) as n from d group by all), m as (select * from (select *, row_number() over (partition by row_name, equation order by n desc, f) as i from d) where i = 1),
  a as (select h.*, m.description as said, row_number() over (partition by h.row_name, h.start_row order by rule_id) as i from h join s on s.row_name = h.row_name and s.equation = h.equation join z on z.row_name = h.row_name join m on m.row_name = h.row_name and m.equation = h.equation where windows >= 2 and s.n >= greatest(2, windows // 2))
  select row_name, start_row, start_col, equation, said as description from a where i = 1 union all select h.row_name, start_row, start_col, equation, description from h join z using (row_name) where windows < 2""")
def agreed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _checked(spark, sf_dir).where("ok").select("*", F.concat(F.lit("seen "), F.col("start_row") % 3).alias("description"), F.col("rule_id").alias("order"))
    return summaries.agreed_rules(held)


_AGREED_SQL = f"""{_checks_sql()}, h as (select *, 'seen ' || start_row % 3 as description from k where lhs <= rhs), z as (select row_name, count(distinct start_row) as windows from k group by 1), d as (select row_name, equation, description, count(*) as n, min(start_row) as f from h group by all),
  s as (select row_name, equation, sum(n) as n from d group by all), m as (select * from (select *, row_number() over (partition by row_name, equation order by n desc, f) as i from d) where i = 1),
  a as (select h.*, m.description as said, row_number() over (partition by h.row_name, h.start_row order by rule_id) as i from h join s on s.row_name = h.row_name and s.equation = h.equation join z on z.row_name = h.row_name join m on m.row_name = h.row_name and m.equation = h.equation where windows >= 2 and s.n >= greatest(2, windows // 2))"""


@BOOK.add(f"with {_AGREED_SQL} select row_name, start_row, start_col, equation, said as description from a where i = 1 union all select h.row_name, start_row, start_col, equation, description from h join z using (row_name) where windows < 2")
def agreed_rules_of_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window names the rules whose left side isn't greater; windows that name none count as well."""
    checked = _checked(spark, sf_dir)
    named = checked.where("lhs <= rhs").select("*", F.concat(F.lit("seen "), F.col("start_row") % 3).alias("description"), F.col("rule_id").alias("order"))
    return summaries.agreed_rules(named, checked.select("row_name", "start_row", "start_col"))


#: Rules of each group of lines: eight forms, some of which say nothing; the cell (1,1) has no number, zeros, one value or many, by the line's number.
_SAID = ("$(0,0) + $(0,2) = $(0,2)", "$(0,2)+$(0,0) = $(0,2)", "$(0,2) - $(0,1) = $(0,2)", "$(0,1) = `$(0,1)`", "1 + 1 = 2", "$(0,0) * $(0,2) = $(0,1)", "$(0,1) / $(1,1) = $(0,0)", "$(0,0) = $(5,0)")


def _said(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").withColumn("row_name", F.concat_ws("-", "l_returnflag", "l_linestatus", "l_linenumber"))
    last = F.when(n == 1, None).when(n == 2, 0.0).when(n == 3, 7.0).otherwise(F.col("l_tax"))
    windows = lines.select("row_name", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax", last.cast("double"), "l_quantity").alias("values"))
    rates = lines.select("row_name").distinct().select("row_name", F.explode(F.array(*map(F.lit, _SAID))).alias("equation"), F.lit(10).alias("total_windows"), F.lit(0.9).alias("consistency_rate"))
    return rates, windows


_REASONS_SQL = """with g as (select l_returnflag || '-' || l_linestatus || '-' || l_linenumber as row_name, l_linenumber as n, count(distinct case when abs(l_tax) > 1e-12 then round(l_tax, 12) end) as dt, count(distinct case when abs(l_discount) > 1e-12 then round(l_discount, 12) end) as dd, count(distinct round(l_quantity, 12)) as dq, count(distinct round(l_extendedprice, 12)) as de, count(*) filter (abs(l_tax) > 1e-12) as nt, count(*) filter (abs(l_discount) > 1e-12) as nd from lineitem group by all),
  o as (select row_name, n, case when dq < 3 then 'operand_distinct_insufficient:$(0,0)' end as q, case when de < 3 then 'operand_distinct_insufficient:$(0,1)' end as e,
    case when nd < 1 then 'operand_nonzero_insufficient:$(0,2)' when dd < 3 then 'operand_distinct_insufficient:$(0,2)' end as d, case when nt < 1 then 'operand_nonzero_insufficient:$(1,0)' when dt < 3 then 'operand_distinct_insufficient:$(1,0)' end as t from g),
  r as (select row_name, k, case k when 0 then '$(0,0) + $(0,2) = $(0,2)' when 1 then '$(0,2)+$(0,0) = $(0,2)' when 2 then '$(0,2) - $(0,1) = $(0,2)' when 3 then '$(0,1) = `$(0,1)`' when 4 then '1 + 1 = 2' when 5 then '$(0,0) * $(0,2) = $(0,1)' when 6 then '$(0,1) / $(1,1) = $(0,0)' else '$(0,0) = $(5,0)' end as equation,
    case k when 0 then 'add_forced_zero_trailing' when 1 then 'add_forced_zero_leading' when 2 then 'sub_minuend_eq_rhs_forces_subtrahend_zero' when 3 then 'identity_equation' when 4 then 'no_operands' when 5 then coalesce(q, d, e)
      when 6 then coalesce(e, case n when 1 then 'operand_no_numeric:$(1,1)' when 2 then 'operand_nonzero_insufficient:$(1,1)' when 3 then 'operand_distinct_insufficient:$(1,1)' else replace(t, '(1,0)', '(1,1)') end, q) else coalesce(q, 'operand_no_numeric:$(5,0)') end as reason from o, (select unnest(range(8)) as k))"""


@BOOK.add(f"{_REASONS_SQL} select row_name, equation, reason from r")
def rule_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates, windows = _said(spark, sf_dir)
    return degeneracy.rejections(rates, windows, 3, least_distinct=3).select("row_name", "equation", "reason")


@BOOK.add(f"{_REASONS_SQL} select row_name, 10 as window_count, count(*) as rules_found, count(*) filter (reason is null) as rules_passed, round(count(*) filter (reason is null) / count(*), 6) as passed_rate, count(*) filter (reason is null) > 0 as is_valid from r group by row_name")
def group_summary_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates, windows = _said(spark, sf_dir)
    return _rounded(summaries.group_summary(degeneracy.rejections(rates, windows, 3, least_distinct=3)), "passed_rate")


@BOOK.add(f"with {_checks_sql()} select start_row, equation, case when start_row % 5 = 0 then start_row % 2 = 0 else ok end as valid, case when start_row % 5 = 0 then 'existing_' else 'revalidated_' end || case when case when start_row % 5 = 0 then start_row % 2 = 0 else ok end then 'valid' else 'invalid' end as status from k")
def revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the windows has stored verdicts, written with other spaces."""
    wanted = _checked(spark, sf_dir)
    stored = wanted.where("start_row % 5 = 0").select("start_row", "start_col", F.concat(F.lit("  "), "equation", F.lit(" ")).alias("equation"), (F.col("start_row") % 2 == 0).alias("ok"), F.lit(0).alias("order"))
    return summaries.revalidated(wanted, stored).select("start_row", "equation", "valid", "status")


@BOOK.add(f"with {_checks_sql()} select distinct row_name, equation as equation_key from k where ok")
def rule_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.fingerprints(_checked(spark, sf_dir))


@BOOK.add(f"""with {_checks_sql()}, f as (select row_name, equation, min(start_row) as start_row from k where ok and row_name <> 'R' group by all), w3 as (select row_name, start_row, start_col, count(*) filter (ok) as n from k group by all)
  select w3.row_name, w3.start_row, start_col, n = 0 or exists (select 1 from f where f.row_name = w3.row_name and f.start_row = w3.start_row) as kept from w3""")
def repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the rows R are known from the start."""
    found = _checked(spark, sf_dir)
    return summaries.without_repeats(found, summaries.fingerprints(found.where("row_name = 'R'")))


@BOOK.add(r"""with t as (select p_partkey, p_name as a, p_type || ' ' || case when p_partkey % 3 = 0 then p_name else p_brand end as b from part) select p_partkey,
  len(list_intersect(list_filter(string_split_regex(trim(a), '\s+'), lambda w: regexp_matches(w, '\p{L}')), list_filter(string_split_regex(trim(b), '\s+'), lambda w: regexp_matches(w, '\p{L}')))) >= 2 as similar from t""")
def rule_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.concat_ws(" ", "p_type", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", summaries.similar(F.col("p_name"), other).alias("similar"))


@BOOK.add(f"with {_checks_sql()} select row_name, equation, min(start_row) as start_row, 0 as start_col from k where ok group by all")
def valid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.valid_rules(_checked(spark, sf_dir), ["row_name"])


@BOOK.add(f"with {_checks_sql()} select count(*) as rules, count(*) filter (ok) as valid, round(avg(ok::int), 6) as ratio from k")
def rule_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summaries.compliance(_checked(spark, sf_dir)), "ratio")


@BOOK.add(f"with {_checks_sql()} select equation, count(*) filter (ok) as valid_windows, count(*) filter (not ok) as invalid_windows, round(count(*) filter (ok) / (select count(distinct start_row) from k), 6) as consistency_rate from k group by equation")
def true_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summaries.true_consistency(_checked(spark, sf_dir)), "consistency_rate")


_ANOMALIES_SQL = "an as (select user_id as location, arg_min(event_id % 4, event_id) as rule, 'rule ' || arg_min(event_type, event_id) as description from events group by user_id)"


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select(F.col("user_id").alias("location"), (F.col("event_id") % 4).alias("rule"), F.concat(F.lit("rule "), "event_type").alias("description"), "event_id")
    return summaries.distinct_anomalies(found, "event_id")


@BOOK.add(f"with {_ANOMALIES_SQL} select * from an")
def distinct_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomalies(spark, sf_dir)


@BOOK.add(f"with {_ANOMALIES_SQL} select rule, min(description) as description, count(*) as violations from an where rule > 0 group by rule")
def violation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.violation_summary(_anomalies(spark, sf_dir))


@BOOK.add("select axis, formula, confidence, o_orderkey from (select o_orderstatus as axis, o_orderpriority || o_custkey % 40 as formula, o_orderkey % 7 / 10 as confidence, o_orderkey, row_number() over (partition by axis, formula order by o_orderkey % 7 desc, o_orderkey) as r from orders) where r = 1")
def relation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("axis"), F.concat("o_orderpriority", F.col("o_custkey") % 40).alias("formula"), (F.col("o_orderkey") % 7 / 10).alias("confidence"), "o_orderkey")
    return summaries.best_of_formula(found, "o_orderkey")


@BOOK.add(f"with d as ({_relations_sql(['qty', 'price', 'amount'])}) select 'amount_equals_qty_times_price' as rule_name, 'amount = qty * price' as expected_formula, count(*) > 0 as tested, max(support_rate) as support_rate, case when count(*) > 0 then 'passed' else 'not_confirmed' end as status from d where axis = 'column' and formula = 'amount = qty * price'")
def expected_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["qty", "price", "amount"]
    return summaries.confirmed(names, relations.detect(_priced(spark, sf_dir), names, top=None))


@BOOK.add("select o_custkey, round(avg(o_totalprice), 4) as o_totalprice_mean, round(stddev_samp(o_totalprice), 4) as o_totalprice_std, count(*) as row_count, arg_min(o_orderstatus, o_orderkey) as o_orderstatus, min(o_orderkey) as first_seen from orders group by o_custkey order by first_seen limit 10")
def groupagg_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped.group_aggregate(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", [], "o_orderkey", ["o_orderstatus"])
    return summaries.preview(out, ["first_seen"]).withColumns({c: F.round(c, 4) for c in ("o_totalprice_mean", "o_totalprice_std")})
