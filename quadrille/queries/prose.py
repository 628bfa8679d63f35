"""Queries of text: splitting, patterns, headings, segments, keywords, inline tables, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import text as T
from quadrille.operators import documents, textwork
from quadrille.queries.base import Book, table
from quadrille.sources import inline
from quadrille.streaming import events as stream

BOOK = Book()


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_LINES = "ln as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10)))))::int as line_no from documents)"


@BOOK.add(f"with {_LINES} select doc_id, line_no, line from ln")
def split_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.lines(_docs(spark, sf_dir))


@BOOK.add("""with p as (select doc_id, list_filter(list_transform(string_split(text, '. '), lambda x: trim(x)), lambda x: x <> '') as parts from documents), q as (select doc_id, parts from p where len(parts) > 0)
  select doc_id, unnest(range(0, len(parts)))::int as "order", unnest(parts) as paragraph from q""")
def split_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.paragraphs(_docs(spark, sf_dir), r"\. ")


@BOOK.add(r"""with c as (select doc_id, coalesce(text, '') as t from documents), n as (select doc_id, length(t) as size, (length(t) - length(replace(t, chr(13) || chr(10), ''))) / 2 as crlf, length(t) - length(replace(t, chr(10), '')) as lf, contains(t, chr(13) || chr(10) || chr(13) || chr(10)) as a, contains(t, chr(10) || chr(10)) as b from c)
  select doc_id, case when size < 10 then 'lf2' when a then 'crlf2' when b then 'lf2' when crlf > lf * 2 then 'crlf' else 'lf' end as line_break from n""")
def linebreak_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.line_break(F.col("text")).alias("line_break"))


def _dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are dressed in one of eight ways, as the tables hold plain prose."""
    way, nl = F.col("doc_id") % 8, F.lit("\n")
    each = lambda before, after="": F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit(before), x, F.lit(after))), "\n")
    table_ = F.concat(F.lit("| a | b |\n|---|:-:|\n"), each("| ", " |"))
    some = F.concat(F.lit("# One\n"), F.col("text"), F.lit("\n\n- x\n\n\n`y`"))
    code = F.concat(F.lit("import x\ndef f(a):\n  # one\n  return {a}\nclass B: pass\n"), F.col("text"))
    log = F.concat(F.lit("2024-01-01 10:00:00 INFO a\nsame\nsame\nsame\nsame\nsame\n"), F.col("text"))
    mail = F.concat(F.lit("From: a.b@example.org\nTo: c\nSubject: Re: x\n[me]: y\n"), F.col("text"))
    made = F.when(way == 1, each("[co] ")).when(way == 2, each("key = ")).when(way == 3, table_).when(way == 4, some).when(way == 5, code).when(way == 6, log).when(way == 7, mail).otherwise(F.concat(F.col("text"), nl))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))


_DRESSED_SQL = r"""dressed as (select doc_id, case doc_id % 8
    when 1 then '[co] ' || replace(text, chr(10), chr(10) || '[co] ') when 2 then 'key = ' || replace(text, chr(10), chr(10) || 'key = ')
    when 3 then '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || replace(text, chr(10), ' |' || chr(10) || '| ') || ' |'
    when 4 then '# One' || chr(10) || text || chr(10) || chr(10) || '- x' || chr(10) || chr(10) || chr(10) || '`y`'
    when 5 then replace('import x@def f(a):@  # one@  return {a}@class B: pass@', '@', chr(10)) || text
    when 6 then '2024-01-01 10:00:00 INFO a' || repeat(chr(10) || 'same', 5) || chr(10) || text
    when 7 then replace('From: a.b#example.org@To: c@Subject: Re: x@[me]: y@', '@', chr(10)) || text else text || chr(10) end as t0 from documents),
  dt as (select doc_id, replace(t0, 'a.b#example', 'a.b@example') as t from dressed)"""


@BOOK.add(rf"""with {_DRESSED_SQL}, l as (select doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from dt),
  m as (select doc_id, t, len(ls) as n, list_sum(list_transform(ls, lambda x: length(x)))::double as chars,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\[.+?\].+'))) as contacts, len(list_filter(ls, lambda x: regexp_matches(x, '^[\p{{L}}\p{{N}}_]+\s*[=:]|^\[.+\]$'))) as config,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\|.*\|.*$'))) as rows, len(list_filter(ls, lambda x: regexp_matches(x, '^\|[\s|:-]+\|$'))) as rules,
    len(list_filter(ls, lambda x: regexp_matches(x, '^#{{1,6}}\s+|^[*-]\s+|^\d+\.\s+'))) as marks, regexp_matches(t, '(?m)^#{{1,6}}\s+|^[*-]\s+|^\d+\.\s+') as marked, contains(t, chr(10) || chr(10)) as parted, len(regexp_extract_all(t, '\n\n')) as gaps from l),
  k as (select *, case when n = 0 then null when contacts / n > 0.7 then 'contacts' when config / n > 0.5 then 'config' when rules > 0 and rows / n > 0.3 then 'table' when marked and (marks / n > 0.1 or parted) then (case when rows / n > 0.2 then 'mixed' else 'structured' end)
    when chars / n < 50 and n > 10 then 'short_items' when gaps > 2 then 'paragraphs' else 'general' end as kind from m)
  select doc_id, n::int as n_lines, round(chars / n, 6) as mean_length, kind, case when kind in ('contacts', 'config', 'short_items') then 'line' when kind = 'structured' then 'semantic' else 'paragraph' end as strategy from k""")
def structure_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.structure(_dressed(spark, sf_dir)).withColumn("mean_length", F.round("mean_length", 6))


@BOOK.add(rf"""with {_DRESSED_SQL}, k as (select doc_id, t, string_split(t, chr(10)) as ls, len(list_filter(['def ', 'class ', 'function ', 'import ', 'return ', 'const ', 'let ', 'var ', 'public ', 'private '], lambda w: contains(t, w))) as words,
    len(list_filter(['INFO', 'ERROR', 'WARNING', 'WARN', 'DEBUG', 'TRACE', 'FATAL'], lambda w: contains(t, w))) as levels, len(list_filter(['from:', 'to:', 'subject:', 'date:', 'cc:', 'bcc:'], lambda w: contains(lower(t), w))) as mail from dt),
  s as (select doc_id, least(1.0, least(words * 0.2, 0.6) + case when regexp_matches(t, '\{{[^}}]*\}}|\[[^\]]*\]|\([^)]*\)') then 0.2 else 0 end + case when regexp_matches(t, '(?m)^\s*#|^\s*//|^\s*/\*') then 0.2 else 0 end)::double as code,
    least(1.0, case when regexp_matches(t, '\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}') then 0.4 else 0 end + case when levels > 0 then 0.4 else 0 end + case when len(ls) > 5 and len(list_distinct(ls)) < len(ls) * 0.7 then 0.2 else 0 end)::double as log,
    least(1.0, case when mail >= 2 then 0.6 when mail = 1 then 0.4 else 0 end + case when regexp_matches(t, '[\p{{L}}\p{{N}}_.-]+@[\p{{L}}\p{{N}}_.-]+') then 0.3 else 0 end + case when regexp_matches(t, '(?m)^\[.*\]:|^<.*>:|^.*\s+\d{{2}}:\d{{2}}') then 0.3 else 0 end + case when contains(t, 'Re:') or contains(t, 'RE:') or contains(t, 'Fwd:') then 0.2 else 0 end)::double as communication,
    least(1.0, case when regexp_matches(t, '(?m)^#+\s+') then 0.4 else 0 end + case when regexp_matches(t, '(?m)^\s*[-*+]\s+|^\s*\d+\.\s+') then 0.2 else 0 end + case when contains(t, '`') then 0.2 else 0 end + case when regexp_matches(t, '\n\s*\n\s*\n') then 0.2 else 0 end)::double as structured_doc from k)
  select doc_id, round(code, 6) as code, round(log, 6) as log, round(communication, 6) as communication, round(structured_doc, 6) as structured_doc, case when code > 0.75 then 'code' when log > 0.75 then 'log' when communication > 0.75 then 'communication' when structured_doc > 0.75 then 'structured_doc' else 'plain_text' end as pattern from s""")
def pattern_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weights are tenths, so above 0.7 is 0.75 and more in the SQL's decimals."""
    t = F.col("text")
    return _dressed(spark, sf_dir).select("doc_id", *(F.round(c, 6).alias(k) for k, c in T.pattern_scores(t).items()), T.document_pattern(t).alias("pattern"))


_MARKS = ("# ", "## ", "2.1 ", "一、", "3) ", "[4] ", "1-2 ", "iv. ", "b) ", "第二節 ", "【5】", "===", "12 ")


def _heading_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose fourth lines are made headings of several kinds, as the tables hold none."""
    mark = lambda i: F.element_at(F.array(*(F.lit(m) for m in _MARKS)), ((i / 4).cast("int") % len(_MARKS) + 1))
    made = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.when(mark(i) == "===", mark(i)).otherwise(F.concat(mark(i), F.substring(x, 1, 30)))).otherwise(x)), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))


_HEADING_SQL = """x as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(0, len(string_split(text, chr(10)))))::int as line_no from documents),
  m as (select *, ['# ', '## ', '2.1 ', '一、', '3) ', '[4] ', '1-2 ', 'iv. ', 'b) ', '第二節 ', '【5】', '===', '12 '][(line_no // 4) % 13 + 1] as mark from x),
  y as (select doc_id, line_no, case when line_no % 4 = 0 then case when mark = '===' then mark else mark || substring(raw, 1, 30) end else raw end as line from m)"""

#: What follows lines y (doc_id, line_no, line).
HEADINGS_OF_LINES_SQL = r"""s as (select *, regexp_replace(line, '^\s+|\s+$', '', 'g') as t, lead(regexp_replace(line, '^\s+|\s+$', '', 'g')) over (partition by doc_id order by line_no) as nxt,
    sum(regexp_matches(line, '^\s*(```|~~~)')::int) over (partition by doc_id order by line_no) % 2 = 1 or regexp_matches(line, '^\s*(```|~~~)') as fenced from y),
  f as (select *, case when regexp_matches(t, '^(={3,}|-{3,})$') then null when regexp_matches(t, '^#{1,6}\s+.+$') then 'markdown' when regexp_matches(t, '^第[一二三四五六七八九十百千0-9]+[章節條款項]') then 'cn_chapter' when regexp_matches(t, '^[一二三四五六七八九十百千]+[、．.)]') then 'cn_numeral'
    when regexp_matches(t, '^\d+(\.\d+)+') then 'decimal' when regexp_matches(t, '^\d+[、.)．]') then 'decimal_simple' when regexp_matches(line, '^\[\d+([.-]\d+)*\]') then 'bracket_num' when regexp_matches(line, '^【\d+([.-]\d+)*】') then 'bracket_num_fw'
    when regexp_matches(t, '^\d+(-\d+)+') then 'hyphen' when regexp_matches(t, '^(?i:[IVXLCDM]+)[.)]') then 'roman' when regexp_matches(t, '^[A-Za-z][.)]') then 'alpha' when t <> '' and regexp_matches(nxt, '^(={3,}|-{3,})$') then 'setext' end as kind from s),
  g as (select * from f where kind is not null and not fenced
    and not (regexp_matches(t, '^\|?[\s:]*-{3,}[\s:|-]*\|[\s:|-]*$') or (length(t) - length(replace(t, '|', '')) >= 2 and len(list_filter(string_split(t, '|'), lambda x: trim(x) <> '')) >= 2))
    and not (kind in ('cn_chapter', 'bracket_num', 'bracket_num_fw', 'setext') and regexp_matches(t, '^(```|~~~)|^(//|/\*|\*|#[^\s])|^#$|\b(def|class|return|import|from|const|let|var|public|private|if|for|while|switch|case)\b|[{};]|->|=>'))),
  hd as (select doc_id, line_no, kind, case kind when 'markdown' then length(regexp_extract(t, '^(#+)', 1)) when 'cn_chapter' then position(regexp_extract(t, '^第[一二三四五六七八九十百千0-9]+([章節條款項])', 1) in '章節條款項') when 'decimal' then len(regexp_extract_all(regexp_extract(t, '^\d+(\.\d+)+'), '\.')) + 1
      when 'hyphen' then len(regexp_extract_all(regexp_extract(t, '^\d+(-\d+)+'), '-')) + 1 when 'setext' then case when nxt like '=%' then 1 else 2 end else 1 end as level,
    regexp_replace(case kind when 'setext' then t when 'markdown' then regexp_replace(t, '^#+\s+', '') when 'cn_chapter' then regexp_replace(t, '^第[一二三四五六七八九十百千0-9]+[章節條款項]', '') when 'cn_numeral' then regexp_replace(t, '^[一二三四五六七八九十百千]+[、．.)]', '') when 'decimal' then regexp_replace(t, '^\d+(\.\d+)+', '')
      when 'decimal_simple' then regexp_replace(t, '^\d+[、.)．]', '') when 'bracket_num' then regexp_replace(t, '^\[[^\]]*\]', '') when 'bracket_num_fw' then regexp_replace(t, '^【[^】]*】', '') when 'hyphen' then regexp_replace(t, '^\d+(-\d+)+', '') else regexp_replace(t, '^[A-Za-z]+[.)]', '') end, '^\s+|\s+$', '', 'g') as heading from g)"""
_HEADINGS_SQL = f"{_HEADING_SQL}, {HEADINGS_OF_LINES_SQL}"


@BOOK.add(f"with {_HEADINGS_SQL} select doc_id, line_no, kind, cast(level as int) as level, heading from hd")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.headings(_heading_docs(spark, sf_dir)).withColumn("level", F.col("level").cast("int"))


@BOOK.add(f"""with {_HEADINGS_SQL}, j as (select y.doc_id, y.line_no, level, heading from y left join hd using (doc_id, line_no)),
  a as (select doc_id, line_no, {', '.join(f'max(case when level = {k} then line_no end) over w as n{k}, last_value(case when level = {k} then heading end ignore nulls) over w as h{k}, max(case when level < {k} then line_no end) over w as r{k}' for k in range(1, 7))} from j window w as (partition by doc_id order by line_no))
  select doc_id, line_no, concat_ws(' / ', {', '.join(f'case when n{k} is not null and (r{k} is null or n{k} > r{k}) then h{k} end' for k in range(1, 7))}) as path from a""")
def asof_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.heading_path(_heading_docs(spark, sf_dir)).select("doc_id", "line_no", F.concat_ws(" / ", "path").alias("path"))


def _log_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of users: a time and what happened, the properties on a line of their own."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("event_type"), F.lit("\n  "), F.coalesce("props", F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(joined.alias("text"))


@BOOK.add("""with e as (select *, row_number() over (partition by user_id order by event_id) as k from events) select user_id as doc_id, k as segment, cast(2 * k - 2 as int) as first_line, 2::bigint as n_lines, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || chr(10) || '  ' || coalesce(props, '') as content from e""")
def log_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.log_segments(_log_docs(spark, sf_dir))


@BOOK.add("""with c as (select *, coalesce(role <> lag(role) over (partition by conv_id order by turn), true)::int as x from conversations), s as (select *, sum(x) over (partition by conv_id order by turn) as segment from c)
  select conv_id, cast(segment as bigint) as segment, any_value(role) as role, count(*) as n_turns, string_agg(text, chr(10) order by turn) as content from s group by conv_id, segment""")
def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.turn_segments(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@BOOK.add(r"""with recursive t as (select conv_id as doc_id, string_agg('[' || role || ']:' || chr(10) || text || chr(10), chr(10) order by turn) as t from conversations group by conv_id),
  u as (select doc_id, regexp_replace(unnest(string_split(t, chr(10))), '^\s+|\s+$', '', 'g') as line, unnest(range(0, len(string_split(t, chr(10))))) as o from t),
  l as (select doc_id, line, row_number() over (partition by doc_id order by o) as i, nullif(regexp_extract(line, '^(From:|To:|<.*>|\[.*\]:|.*\s+\d{2}:\d{2})'), '') as who from u where line <> ''),
  r as (select doc_id, i, who, length(line) as used, 0 as segment, line from l where i = 1 union all
    select l.doc_id, l.i, coalesce(l.who, r.who), case when new then length(l.line) else r.used + 1 + length(l.line) end, r.segment + new::int, l.line
    from r join l on l.doc_id = r.doc_id and l.i = r.i + 1, lateral (select case when l.who is not null then l.who is distinct from r.who else r.used + 1 + length(l.line) > 2000 end as new))
  select doc_id, (row_number() over (partition by doc_id order by segment) - 1)::int as segment, sender, content from (select doc_id, segment, max_by(who, i) as sender, string_agg(line, chr(10) order by i) as content from r group by doc_id, segment) where length(content) >= 10""")
def sender_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.struct("turn", F.concat(F.lit("["), F.col("role"), F.lit("]:\n"), F.col("text"), F.lit("\n")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["x"]), "\n")
    return documents.sender_segments(table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(joined.alias("text")))


@BOOK.add(f"with {_LINES}, p as (select doc_id, trim(line) as part, row_number() over (partition by doc_id order by line_no) - 1 as o from ln where trim(line) <> '') select doc_id, o // 3 as chunk, count(*) as n_parts, string_agg(part, chr(10) order by o) as content from p group by all")
def merge_fixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.merge_fixed(documents.paragraphs(_docs(spark, sf_dir), "\n"), 3)


@BOOK.add(f"""with recursive {_LINES}, l as (select doc_id, trim(line) as part, row_number() over (partition by doc_id order by line_no) as i from ln where trim(line) <> ''),
  r as (select doc_id, i, length(part) as used, 0 as chunk, part from l where i = 1 union all
    select l.doc_id, l.i, case when r.used + length(l.part) <= 1000 then r.used + length(l.part) else length(l.part) end, r.chunk + (r.used + length(l.part) > 1000)::int, l.part from r join l on l.doc_id = r.doc_id and l.i = r.i + 1)
  select doc_id, chunk, count(*) as n_parts, sum(length(part))::bigint as n_chars, string_agg(part, chr(10) order by i) as content from r group by doc_id, chunk""")
def merge_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.merge_by_length(_docs(spark, sf_dir), 1000)


@BOOK.add(r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_\-\x{4e00}-\x{9fff}]{2,}') as ws from documents), u as (select doc_id, unnest(ws) as w, unnest(range(0, len(ws))) as i from w), f as (select doc_id, lower(w) as k, min(i) as i, arg_min(w, i) as w from u group by 1, 2), r as (select *, row_number() over (partition by doc_id order by i) as n from f)
  select doc_id, string_agg(w, ' ' order by i) as keywords from r where n <= 10 group by doc_id union all select doc_id, '' from w where len(ws) = 0""")
def simple_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.keywords(_docs(spark, sf_dir)).select("doc_id", F.concat_ws(" ", "keywords").alias("keywords"))


@BOOK.add("""with c as (select p_partkey + 1 as row, 1 as col, p_name as v from part union all select p_partkey + 1, 2, p_brand || ' ' || p_size from part union all select p_partkey + 1, 3, p_type from part),
  n as (select *, count(*) over (partition by v) as n, (row - 1) // 100 as chunk from c), f as (select chunk, lower(v) as low, min(row * 10 + col) as spot, arg_min(v, row * 10 + col) as term, arg_min(n, row * 10 + col) as n from n where n <= 2 or (n <= 4 and length(v) >= 4) group by 1, 2),
  r as (select *, row_number() over (partition by chunk order by n, length(term) desc, spot) as place from f) select chunk::bigint as chunk, term, n, place::int as place from r where place <= 15""")
def distinctive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a sheet in chunks of a hundred rows."""
    cell = lambda i, v: F.struct(F.lit(i).alias("col"), v.alias("raw"))
    cells = table(spark, sf_dir, "part").select(F.lit("part").alias("sheet"), (F.col("p_partkey") + 1).alias("row"), F.explode(F.array(cell(1, F.col("p_name")), cell(2, F.concat_ws(" ", "p_brand", "p_size")), cell(3, F.col("p_type")))).alias("x")).select("sheet", "row", "x.*")
    return documents.distinctive_terms(cells, 100).select("chunk", "term", "n", "place")


@BOOK.add(r"""with u as (select p_partkey, p_brand || '-' || p_size || ' ' || upper(substring(p_name, 1, 3)) || (p_partkey + 100) || '-A (X' || p_size || ') ' || p_size || ' MM ± 0.5' as t from part)
  select p_partkey, array_to_string(regexp_extract_all(t, '\b[A-Z]{1,4}\d{3,}[A-Z0-9\-]*(?:\s+[A-Z]{1,3}\d{2,})?(?:\s*\([A-Z0-9\-]+\))?'), '|') as codes, array_to_string(regexp_extract_all(t, '(?i)(?:±\s*)?\d+(?:\.\d+)?\s*(?:mm|cm|m|g|kg|度|%|mpa|kpa|μm|um|mil)\b|±\s*\d+(?:\.\d+)?'), '|') as measures from u""")
def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size"), F.lit(" "), F.upper(F.substring("p_name", 1, 3)), F.col("p_partkey") + 100, F.lit("-A (X"), F.col("p_size"), F.lit(") "), F.col("p_size"), F.lit(" MM ± 0.5"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", F.regexp_extract_all(t, F.lit(T.PART_CODE), F.lit(0))).alias("codes"), F.concat_ws("|", F.regexp_extract_all(t, F.lit(T.MEASURE), F.lit(0))).alias("measures"))


@BOOK.add(r"""with u as (select page_id, unnest(list_concat(string_split(url, '/'), ['v1.2.3', 'x', 'Home', '2024a', page_id || 'b.tmp', '~$doc', 'node modules', 'Program-Files', 'test_basic', '12', 'a.old'])) as t from pages), v as (select page_id, t, lower(trim(t)) as s from u)
  select page_id, t as tag from v where length(s) >= 2 and not list_contains(w, s) and not list_contains(w, regexp_replace(s, '[ _-]', '', 'g')) and length(regexp_replace(s, '[^0-9]', '', 'g')) <= 0.8 * length(s) and not regexp_matches(s, '^v?\d+(\.\d+)*$')
    and not starts_with(s, '~$') and not regexp_matches(s, '\.(tmp|bak|old|swp)$') and s not in ('test', 'test_update_flow', 'test_duplicate_path_flow', 'test_batch', 'test_collection_basic', 'test_basic')""".replace(" where length(s)", """, (select string_split('c:|d:|e:|f:|g:|h:|program files|program files (x86)|programdata|users|user|documents|desktop|downloads|appdata|local|roaming|temp|tmp|windows|system32|syswow64|winnt|usr|var|etc|opt|home|root|bin|sbin|lib|lib64|dev|proc|sys|mnt|media|node_modules|.git|.vscode|.idea|__pycache__|venv|env|virtualenv|.venv|system|system64|drivers|common|shared|public|private|storage|log|logs|cache|backup|documentmanager|domain|test|tests|test_|tmp_|.svn|docxparser|contextparser|source|ml_home', '|') as w) where length(s)""", 1))
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.array(*(F.lit(x) for x in ("v1.2.3", "x", "Home", "2024a")), F.concat(F.col("page_id").cast("string"), F.lit("b.tmp")), *(F.lit(x) for x in ("~$doc", "node modules", "Program-Files", "test_basic", "12", "a.old")))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.tags_kept(F.concat(F.split("url", "/"), more))).alias("tag"))


@BOOK.add("select doc_id, contains(text, chr(65533)) or regexp_matches(text, '\\?\\?') as corrupt from documents")
def corrupt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.looks_corrupt(F.col("text")).alias("corrupt"))


@BOOK.add("select doc_id, case when length(replace(text, chr(10), ' ')) > 60 then substring(replace(text, chr(10), ' '), 1, 57) || '...' else replace(text, chr(10), ' ') end as shown from documents")
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.display(F.col("text"), 60).alias("shown"))


@BOOK.add("""with t as (select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey) select cast(n_nationkey as varchar) as sheet, 2::bigint as row, 1 as col, n_name as raw from t union all select cast(n_nationkey as varchar), 2, 2, r_name from t
  union all select cast(n_nationkey as varchar), 1, 1, 'nation' from t union all select cast(n_nationkey as varchar), 1, 2, 'region' from t""")
def inline_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation as a small table in one of four notations."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n, r, kind = F.col("n_name"), F.col("r_name"), F.col("n_nationkey") % 4
    json = F.concat(F.lit('{"data": [["nation", "region"], ["'), n, F.lit('", "'), r, F.lit('"]]}'))
    markdown = F.concat(F.lit("| nation | region |\n| --- | :-: |\n| "), n, F.lit(" | "), r, F.lit(" |"))
    comma = F.concat(F.lit('nation,region\n"'), n, F.lit('",'), r)
    tab = F.concat(F.lit("nation\tregion\n"), n, F.lit("\t"), r)
    text = F.when(kind == 0, json).when(kind == 1, markdown).when(kind == 2, comma).otherwise(tab)
    return inline.cells(both.select(F.col("n_nationkey").alias("sheet"), text.alias("text")))


@BOOK.add("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@BOOK.add("with u as (select time_bucket(interval '30 minutes', ts) as s, event_type from events) select s as window_start, event_type, count(*) as n from (select s, event_type from u union all select s - interval '30 minutes', event_type from u) group by all")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sliding(table(spark, sf_dir, "events"))


@BOOK.add("""with g as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval '30 minutes', true)::int as x from events), s as (select *, sum(x) over (partition by user_id order by ts rows unbounded preceding) as k from g)
  select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from s group by user_id, k""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(table(spark, sf_dir, "events"))


@BOOK.add()
def split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing with overlap; tested on small texts."""
    return textwork.split_text(_docs(spark, sf_dir))
