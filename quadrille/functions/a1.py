"""Spreadsheet addresses as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_name(number: Column) -> Column:
    """Letters of a column from its number (1 is A), up to XFD."""
    n = number.cast("int") - 1
    letter = lambda x: F.chr((x + 65).cast("int"))
    one = letter(n)
    two = F.concat(letter(F.floor((n - 26) / 26) % 26), letter(F.pmod(n - 26, F.lit(26))))
    m = n - 702
    three = F.concat(letter(F.floor(m / 676)), letter(F.floor(m / 26) % 26), letter(F.pmod(m, F.lit(26))))
    return F.when(n < 0, None).when(n < 26, one).when(n < 702, two).otherwise(three)


def column_number(letters: Column) -> Column:
    """The number of a column from its letters; null if they are none."""
    chars = F.filter(F.split(F.upper(F.trim(letters)), ""), lambda c: c != "")
    value = F.aggregate(chars, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)
    return F.when(F.upper(F.trim(letters)).rlike("^[A-Z]{1,3}$"), value)


def cell(row: Column, col: Column) -> Column:
    return F.concat(column_name(col), row.cast("string"))


def area(top: Column, left: Column, bottom: Column, right: Column) -> Column:
    return F.concat_ws(":", cell(top, left), cell(bottom, right))


_PART = re.compile(r"\$?([A-Za-z]{1,3})\$?([0-9]+)$")


def number_of(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def parse_area(text: str) -> tuple[int, int, int, int]:
    """(top, left, bottom, right) of an address such as B4:L39 or C7, 1-based; ends in any order."""
    ends = [_PART.match(p.strip()) for p in text.split("!")[-1].split(":")]
    if not 1 <= len(ends) <= 2 or not all(ends):
        raise ValueError(f"no address: {text!r}")
    rows = [int(m[2]) for m in ends]
    cols = [number_of(m[1]) for m in ends]
    return min(rows), min(cols), max(rows), max(cols)
