"""Numbers and kinds of cells.

The dialects differ on purpose; each names the flow that reads cells that way.
All yield null where a text is no number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def is_blank(raw: Column) -> Column:
    return raw.isNull() | (F.trim(raw) == "")


def number(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def commas_removed(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ",", "")


def _boolean(raw: Column) -> Column:
    return F.when(F.upper(F.trim(raw)) == "TRUE", 1.0).when(F.upper(F.trim(raw)) == "FALSE", 0.0)


def inspector_number(raw: Column) -> Column:
    """Thousands separators and percentages are read; truth values are no numbers."""
    t = commas_removed(raw)
    return F.when(t.endswith("%"), number(F.regexp_replace(t, "%$", "")) / 100).otherwise(number(t))


def window_number(raw: Column) -> Column:
    """Truth values count 1 and 0, thousands separators are read, percentages aren't."""
    return F.coalesce(_boolean(raw), number(commas_removed(raw)))


def aggregate_number(raw: Column) -> Column:
    """Truth values count; separators and percentages aren't read, infinities and NaN drop."""
    return F.coalesce(_boolean(raw), number(raw))


def region_is_data(raw: Column) -> Column:
    """Whether a cell is numeric for region detection; a leading plus-minus sign is allowed, a percentage isn't."""
    return F.coalesce(number(F.regexp_replace(commas_removed(raw), "^±", "")).isNotNull(), F.lit(False))


#: Whole texts that are dates or times.
DATES = (r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$", r"^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}$", r"^[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日$")
TIME = r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"


def cell_type(raw: Column) -> Column:
    """empty, boolean, formula, percentage, integer, number, date, time or string; the first that fits."""
    t = F.trim(raw)
    value = number(commas_removed(raw))
    percent = number(F.regexp_replace(commas_removed(raw), "%$", ""))
    return (
        F.when(is_blank(raw), "empty")
        .when(F.upper(t).isin("TRUE", "FALSE"), "boolean")
        .when(t.startswith("="), "formula")
        .when(t.endswith("%") & percent.isNotNull(), "percentage")
        .when(value.isNotNull() & (value == F.floor(value)), "integer")
        .when(value.isNotNull(), "number")
        .when(t.rlike(DATES[0]) | t.rlike(DATES[1]) | t.rlike(DATES[2]), "date")
        .when(t.rlike(TIME), "time")
        .otherwise("string")
    )


#: Layouts of date texts, tried in this order once slashes are hyphens.
LAYOUTS = ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "yyyyMMdd", "M-d-yyyy", "d-M-yyyy", "yyyy.M.d")


def datetime_of(text: Column) -> Column:
    """A timestamp from ISO or one of the usual layouts; plain numbers but eight digits are none."""
    t = F.regexp_replace(F.trim(text), "/", "-")
    return F.coalesce(F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), t.try_cast("timestamp")), *(F.try_to_timestamp(t, F.lit(x)) for x in LAYOUTS))


def literal(text: Column) -> Column:
    """The JSON form of an inline table's cell: null, true, false, a number or a string."""
    t = F.trim(text)
    low = F.lower(t)
    return F.when(text.isNull() | low.isin("", "null", "none"), "null").when(low.isin("true", "false"), low).when(t.rlike(NUMBER), t).otherwise(F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2))
