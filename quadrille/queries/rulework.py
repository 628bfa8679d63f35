"""Queries of rules: audits over windows, rule sets, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import audit, discover, rules, windows
from quadrille.operators.audit import Rule
from quadrille.plans import equation as E
from quadrille.queries.base import LINES_SQL, Book, line_sheet, table

BOOK = Book()

#: Rules over windows of two rows of (quantity, discount, tax); the third concerns one flag's rows only.
RULES = [Rule("$(0,0) = $(1,0)"), Rule("$(0,1) + $(0,2) = $(1,1)"), Rule("(0,0) * $(0,1) ＝ $(1,0) - $(0,2)", "R"), Rule("$(0,0)**2 / $(1,1) = 40 + $(0,0)", "A")]
COLUMNS = ["l_quantity", "l_discount", "l_tax"]

_SIDES = (("a", "d"), ("b + c", "e"), ("a * b", "d - c"), ("power(a, 2) / nullif(e, 0)", "40 + a"))
_CELLS = ("a, d", "b, c, e", "a, b, d, c", "a, e")


def _fits(cells: str) -> str:
    return " and ".join(f"({x} = 0 or (abs({x}) >= 1e-4 and abs({x}) < 1e16))" for x in cells.split(", "))


def _checks_sql() -> str:
    """Every rule on every window that it concerns; no window is without a rule, as two concern all."""
    parts = []
    for i, (r, (left, right), cells) in enumerate(zip(RULES, _SIDES, _CELLS, strict=True)):
        where = f" and name = '{r.row_name}'" if r.row_name else ""
        parts.append(f"select r as start_row, 0 as start_col, name as row_name, {i} as rule_id, '{r.key}' as equation, {left} as lhs, {right} as rhs, coalesce(abs(({left}) - ({right})) <= 0.01 and {_fits(cells)}, false) as ok from w where last is not null{where}")
    return f"{LINES_SQL}, w as (select row - 1 as r, l_returnflag as name, l_quantity as a, l_discount as b, l_tax as c, lead(l_quantity) over (order by row) as d, lead(l_discount) over (order by row) as e, lead(l_tax) over (order by row) as f, lead(row) over (order by row) as last from li), k as ({' union all '.join(parts)})"


def _checked(spark: SparkSession, sf_dir: str, named: bool = False) -> DataFrame:
    sheet = line_sheet(spark, sf_dir, [*COLUMNS, "l_returnflag"] if named else None)
    found = windows.valid(windows.scan(sheet, COLUMNS, 2, 3, name="l_returnflag", around=audit.reach(RULES) if named else None), 2, 3)
    return audit.checks(found, RULES, 2, 3, named=named)


@BOOK.add(f"with {_checks_sql()} select start_row, start_col, row_name, rule_id, equation, round(lhs, 6) as lhs, round(rhs, 6) as rhs, ok from k")
def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("start_row", "start_col", "row_name", "rule_id", "equation", F.round("lhs", 6).alias("lhs"), F.round("rhs", 6).alias("rhs"), "ok")


_PER_WINDOW = "pw as (select start_row, start_col, count(*) as n, count(*) filter (ok) as p from k group by all)"


@BOOK.add(f"with {_checks_sql()}, {_PER_WINDOW} select cast(sum(n) as bigint) as total_checks, count(*) as matched_windows, count(*) filter (p < n) as failed_windows, cast(sum(p) as bigint) as passed, cast(sum(n) - sum(p) as bigint) as failed, round(sum(p) / sum(n), 6) as pass_rate from pw")
def rule_audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.metrics(_checked(spark, sf_dir)).withColumn("pass_rate", F.round("pass_rate", 6))


@BOOK.add(f"with {_checks_sql()}, pw as (select row_name, start_row, count(*) as n, count(*) filter (ok) as p from k group by all) select row_name, count(*) as windows, cast(sum(n) as bigint) as checks, cast(sum(p) as bigint) as passed, cast(sum(n) - sum(p) as bigint) as failed, round(sum(p) / sum(n), 6) as pass_rate from pw group by row_name")
def audit_row_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.row_statistics(_checked(spark, sf_dir)).withColumn("pass_rate", F.round("pass_rate", 6))


@BOOK.add(f"with {_checks_sql()} select start_row, start_col, row_name, count(*) as failed_rules, string_agg(distinct equation, ';' order by equation) as equations from k where not ok group by all")
def failed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.failed_windows(_checked(spark, sf_dir)).withColumn("equations", F.concat_ws(";", "equations"))


def _suspects_sql(top_k: int) -> str:
    cells = []
    for i, r in enumerate(RULES):
        both = E.sides(r.equation)
        cells += [f"select {i} as rule_id, {c.row} as cr, {c.col} as cc" for s in both for c in E.cells_of(E.parse(s))]
    order = f" order by occurrences desc, windows desc, row, col limit {top_k}" if top_k else ""
    return f"""with {_checks_sql()}, o as ({' union all '.join(cells)}), s as (select start_row + cr + 1 as row, start_col + cc + 1 as col, start_row, equation from k join o using (rule_id) where not ok)
      select row, cast(col as bigint) as col, count(*) as occurrences, count(distinct start_row) as windows, count(distinct equation) as rules, chr((64 + col)::int) || row as address from s group by row, col{order}"""


@BOOK.add(_suspects_sql(0))
def suspect_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.suspect_cells(_checked(spark, sf_dir, named=True))


@BOOK.add(_suspects_sql(25))
def suspect_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.suspect_cells(_checked(spark, sf_dir, named=True), top_k=25)


STRICT = [Rule("$(0,0) = $(1,0)", "R"), Rule("$(0,1) = $(1,1)", "A")]


def _strict(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    found = windows.scan(line_sheet(spark, sf_dir), COLUMNS, 2, 3, name="l_returnflag")
    return audit.row_statistics(audit.checks(found, STRICT, 2, 3, strict=strict)).withColumn("pass_rate", F.round("pass_rate", 6))


def _strict_sql(strict: bool) -> str:
    rows = ("select 'R' as n, 0 as i union all select 'A', 1") + ("" if strict else " union all select 'N', 0 union all select 'N', 1")
    return f"""with {LINES_SQL}, w as (select l_returnflag as name, row, l_quantity as a, l_discount as b, lead(l_quantity) over (order by row) as d, lead(l_discount) over (order by row) as e, lead(row) over (order by row) as last from li), x as ({rows}),
      k as (select name, row, case when i = 0 then abs(a - d) <= 0.01 else abs(b - e) <= 0.01 end as ok from w join x on name = n where last is not null), p as (select name, row, count(*) as n, count(*) filter (ok) as p from k group by all)
      select name as row_name, count(*) as windows, cast(sum(n) as bigint) as checks, cast(sum(p) as bigint) as passed, cast(sum(n) - sum(p) as bigint) as failed, round(sum(p) / sum(n), 6) as pass_rate from p group by name"""


@BOOK.add(_strict_sql(True))
def audit_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict(spark, sf_dir, True)


@BOOK.add(_strict_sql(False))
def audit_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict(spark, sf_dir, False)


@BOOK.add(f"with {_checks_sql()} select row_name, equation, count(*) filter (ok) as valid_windows, count(*) as total_windows, round(avg(ok::int), 6) as consistency_rate from k group by all")
def rule_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.consistency(_checked(spark, sf_dir)).withColumn("consistency_rate", F.round("consistency_rate", 6))


@BOOK.add(f"""with {LINES_SQL}, w as (select l_quantity as a, l_discount as b, lead(l_discount) over (order by row) as e, lead(row) over (order by row) as last from li), x as (select '$(0,0)' as cell, a as v from w where last is not null union all select '$(0,1)', b from w where last is not null union all select '$(1,1)', e from w where last is not null)
  select cell, count(*) filter (abs(v) > 1e-12) as nonzero, count(distinct case when abs(v) > 1e-12 then round(v, 12) end) as distinct_nonzero from x group by cell""")
def degeneracy_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.scan(line_sheet(spark, sf_dir), COLUMNS, 2, 3)
    return rules.support(found, "$(0,0) * $(0,1) = $(1,1)", 3)


@BOOK.add("""with c as (select o_custkey % 50 as key, o_orderpriority, count(*) as n, min(o_orderkey) as f from orders group by all), r as (select *, row_number() over (partition by key order by n desc, f) as k from c) select key, o_orderpriority, n from r where k = 1""")
def rule_mode_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.most_frequent(table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey") % 50), "key", "o_orderpriority", "o_orderkey")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule texts in the many ways people write them, made from order lines."""
    n, s = F.col("l_linenumber").cast("string"), F.col("l_returnflag")
    form = F.when(s == "A", F.concat(F.lit("`$ ("), n, F.lit(", 0) + (1,0) ＝ $"), n, F.lit("`"))).when(s == "N", F.concat(F.lit("$"), n, F.lit(" - $(2,"), n, F.lit(") = (0, "), n, F.lit(")"))).otherwise(F.concat(F.lit("todo"), n))
    return table(spark, sf_dir, "lineitem").select(form.alias("equation"), "l_linestatus")


_WRITTEN_SQL = """e as (select l_linestatus, case l_returnflag when 'A' then '`$ (' || l_linenumber || ', 0) + (1,0) ＝ $' || l_linenumber || '`' when 'N' then '$' || l_linenumber || ' - $(2,' || l_linenumber || ') = (0, ' || l_linenumber || ')' else 'todo' || l_linenumber end as equation from lineitem),
  g as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(equation, '＝', '=', 'g'), '`', '', 'g'), '\\$\\s+\\(', '$(', 'g'), '(^|[^$])\\(\\s*(-?[0-9]+)\\s*,\\s*(-?[0-9]+)\\s*\\)', '\\1$(\\2,\\3)', 'g'), '\\$([0-9]+)', '$(\\1,0)', 'g'), '\\s+', '', 'g') as key from e)"""


@BOOK.add(f"with {_WRITTEN_SQL} select equation, key as equation_key, count(*) as n from g group by all")
def rule_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).withColumn("equation_key", E.normalized(F.col("equation"))).groupBy("equation", "equation_key").agg(F.count("*").alias("n"))


@BOOK.add(f"with {_WRITTEN_SQL}, d as (select distinct key from g), x as (select key, unnest(regexp_extract_all(key, '\\$\\(([0-9]+),([0-9]+)\\)', 1)) as r, unnest(regexp_extract_all(key, '\\$\\(([0-9]+),([0-9]+)\\)', 2)) as c from d) select key as equation_key, cast(r as int) as r, cast(c as int) as c, count(*) as n from x group by all")
def rule_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _written(spark, sf_dir).select(E.normalized(F.col("equation")).alias("equation_key")).distinct()
    return keys.withColumn("x", F.explode(E.operands(F.col("equation_key")))).groupBy("equation_key", F.col("x.r").alias("r"), F.col("x.c").alias("c")).agg(F.count("*").alias("n"))


@BOOK.add(f"""with {_WRITTEN_SQL}, a as (select key, count(*) as n_a, min(equation) as sample_a from g where l_linestatus = 'O' and key not like '%1%' group by key), b as (select key, count(*) as n_b, min(equation) as sample_b from g where l_linestatus = 'F' and key not like '%3%' group by key)
  select key as equation_key, case when n_b is null then 'only_a' when n_a is null then 'only_b' else 'both' end as status, coalesce(n_a, 0) as n_a, coalesce(n_b, 0) as n_b, sample_a, sample_b from a full join b using (key)""")
def rule_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = _written(spark, sf_dir).withColumn("k", E.normalized(F.col("equation")))
    return rules.compare(written.where("l_linestatus = 'O' and k not like '%1%'"), written.where("l_linestatus = 'F' and k not like '%3%'"))


@BOOK.add("""with t as (select n_nationkey as n, case n_nationkey % 4 when 0 then '左邊 = $(0,1)' when 1 then 'Left = right' else '$(0,' || n_nationkey % 7 || ') + $2 = $(1,0)' end as equation, n_nationkey % 3 = 0 as sided from nation),
  s as (select n_nationkey as id, n_nationkey % 3 + 1 as h, n_nationkey % 5 + 1 as w from nation), c as (select distinct n, equation, unnest(case when sided then [0, 1] else [0, 2, 1] end) as r, unnest(case when sided then [3, 0] else [n % 7, 0, 0] end) as c from t where sided or n % 4 > 1),
  z as (select n, equation, 0 as r, 1 as c from t where not sided and n % 4 = 0)
  select equation, 'equation_sides_null' as issue, null::bigint as window_id, null::int as row, null::int as col from t where not sided union all select equation, 'placeholder_tokens', null, null, null from t where n % 4 < 2
  union all select equation, 'index_out_of_range', id::bigint, r, c from (select * from c union all select * from z) x join s on s.id in (x.n, (x.n + 1) % 25) where r >= h or c >= w""")
def rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each nation, with sides for one in three, supported by two windows of other shapes."""
    n = F.col("n_nationkey")
    equation = F.when(n % 4 == 0, "左邊 = $(0,1)").when(n % 4 == 1, "Left = right").otherwise(F.concat(F.lit("$(0,"), n % 7, F.lit(") + $2 = $(1,0)")))
    sided = F.when(n % 3 == 0, F.array(F.lit("$(0,3)"), F.lit("$(1,0)")))
    written = table(spark, sf_dir, "nation").select(equation.alias("equation"), sided.alias("equation_sides"), F.array(n.cast("long"), ((n + 1) % 25).cast("long")).alias("windows"))
    shapes = table(spark, sf_dir, "nation").select(n.cast("long").alias("window_id"), (n % 3 + 1).alias("height"), (n % 5 + 1).alias("width"))
    return rules.quality(written, shapes)


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet of (price, discount, net price, tax) by flag; the net price is wrong in one row of nine."""
    p, d = F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_discount")
    wrong = F.when(F.col("row") % 9 == 0, 7.0).otherwise(0.0)
    return line_sheet(spark, sf_dir).select("row", p.alias("a"), F.round(d, 2).alias("b"), F.round(p - F.round(d, 2) + wrong, 2).alias("c"), "l_returnflag")


def _discover_sql() -> str:
    parts = []
    for e in discover.templates(1, 3):
        left, right = E.sides(e)
        cells = [f"v{c.col}" for s in (left, right) for c in E.cells_of(E.parse(s))]
        sql = lambda s: "".join({"$(0,0)": "v0", "$(0,1)": "v1", "$(0,2)": "v2"}.get(t, t) for _, t in E.tokens(s))
        lhs = sql(left).replace("/", " / nullif(") + ", 0)" * ("/" in left)
        parts.append(f"select row_name, '{e}' as equation, count(*) filter (coalesce(abs(({lhs}) - {sql(right)}) <= 0.01 and {_fits(', '.join(dict.fromkeys(cells)))}, false)) as valid_windows, count(*) as total_windows from w group by row_name")
    return f"""with {LINES_SQL}, w as (select l_returnflag as row_name, l_extendedprice as v0, round(l_extendedprice * l_discount, 2) as v1, round(l_extendedprice - round(l_extendedprice * l_discount, 2) + case when row % 9 = 0 then 7.0::double else 0.0::double end, 2) as v2 from li), k as ({' union all '.join(parts)})
      select row_name, equation, valid_windows, total_windows, round(valid_windows / total_windows, 6) as consistency_rate from k where valid_windows / total_windows >= 0.8"""


@BOOK.add(_discover_sql())
def rule_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.scan(_planted(spark, sf_dir), ["a", "b", "c"], 1, 3, name="l_returnflag")
    return discover.discover(found, 1, 3).withColumn("consistency_rate", F.round("consistency_rate", 6))


@BOOK.add(f"with {LINES_SQL} select row - 1 as start_row, 0 as start_col from li where row % 4 <> 1")
def anti_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.scan(_planted(spark, sf_dir), ["a", "b", "c"], 1, 3)
    return discover.not_analysed(found, found.where("start_row % 4 = 0").select("start_row", "start_col")).select("start_row", "start_col")
