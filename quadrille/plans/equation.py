"""The equation language, compiled to column expressions.

``$(r,c)`` is a cell of a window; ``(r,c)`` and ``$i`` are short forms.  Sides are
arithmetic over cells and numbers with + - * / // ** and brackets.  A side has the
meaning of its text with values written in: a negative cell is raised to a power
before its sign counts, and values that would be written with an exponent make the
check fail, as do missing cells and division by zero.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 0.01


class BadEquation(ValueError):
    """The text is no equation of the language."""


#: Steps of the normal form: (pattern, what replaces it).  Java and Python read both alike but for the dollar sign.
STEPS = ((r"＝", "="), (r"`", ""), (r"\$\s+\(", "$("), (r"(?<!\$)\(\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*\)", "$(<1>,<2>)"), (r"\$([0-9]+)", "$(<1>,0)"), (r"\s+", ""))


def normalize(text: str) -> str:
    for pattern, new in STEPS:
        text = re.sub(pattern, re.sub("<([0-9])>", r"\\\1", new), text)
    return text


def normalized(text: Column) -> Column:
    for pattern, new in STEPS:
        text = F.regexp_replace(text, pattern, re.sub("<([0-9])>", r"$\1", new.replace("$", r"\$")))
    return text


def sides(text: str) -> tuple[str, str] | None:
    """Both sides, parted at the first equals sign."""
    left, sign, right = normalize(text).partition("=")
    return (left, right) if sign and left and right else None


def operands(text: Column) -> Column:
    """array<struct<r,c>> of all cells in an equation, repeats kept."""
    t = normalized(text)
    rows, cols = (F.regexp_extract_all(t, F.lit(r"\$\((-?[0-9]+),(-?[0-9]+)\)"), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(rows.alias("r"), cols.alias("c")), lambda x: F.struct(x["r"].cast("int").alias("r"), x["c"].cast("int").alias("c")))


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Cell:
    row: int
    col: int


@dataclass(frozen=True)
class Negative:
    of: object


@dataclass(frozen=True)
class Bracket:
    of: object


@dataclass(frozen=True)
class Binary:
    sign: str
    left: object
    right: object


_TOKEN = re.compile(r"\s*(?:(?P<cell>\$\((-?[0-9]+),(-?[0-9]+)\))|(?P<number>[0-9]+\.?[0-9]*|\.[0-9]+)|(?P<sign>\*\*|//|[-+*/()]))")


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = normalize(text)
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise BadEquation(f"unexpected {text[at:]!r}")
        kind = m.lastgroup if m["cell"] is None else "cell"
        if out and {out[-1][0], kind} <= {"cell", "number"}:
            raise BadEquation("a number or cell touches another")
        out.append((kind, m[0].strip()))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokens(text), 0

    def next_sign(self, *signs: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in signs:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def sum(self) -> object:
        left = self.product()
        while sign := self.next_sign("+", "-"):
            left = Binary(sign, left, self.product())
        return left

    def product(self) -> object:
        left = self.signed()
        while sign := self.next_sign("*", "/", "//"):
            left = Binary(sign, left, self.signed())
        return left

    def signed(self) -> object:
        if sign := self.next_sign("+", "-"):
            of = self.signed()
            return Negative(of) if sign == "-" else of
        base = self.atom()
        return Binary("**", base, self.signed()) if self.next_sign("**") else base

    def atom(self) -> object:
        if self.next_sign("("):
            inside = self.sum()
            if not self.next_sign(")"):
                raise BadEquation("a bracket is left open")
            return Bracket(inside)
        if self.at == len(self.tokens):
            raise BadEquation("the text ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Number(float(text))
        if kind == "cell":
            r, c = re.findall("-?[0-9]+", text)
            return Cell(int(r), int(c))
        raise BadEquation(f"unexpected {text!r}")


def parse(text: str) -> object:
    p = _Parser(text)
    out = p.sum()
    if p.at < len(p.tokens):
        raise BadEquation(f"unexpected {p.tokens[p.at][1]!r}")
    return out


def cells_of(tree: object) -> list[Cell]:
    """All cells, repeats kept, from left to right."""
    if isinstance(tree, Cell):
        return [tree]
    if isinstance(tree, Negative | Bracket):
        return cells_of(tree.of)
    return cells_of(tree.left) + cells_of(tree.right) if isinstance(tree, Binary) else []


def value(tree: object, cell) -> Column:
    """The tree as a column; ``cell`` gives the column of a cell."""
    if isinstance(tree, Number):
        return F.lit(tree.value)
    if isinstance(tree, Cell):
        return cell(tree)
    if isinstance(tree, Negative):
        return -value(tree.of, cell)
    if isinstance(tree, Bracket):
        return value(tree.of, cell)
    left, right = value(tree.left, cell), value(tree.right, cell)
    if tree.sign == "**":
        size = F.abs(left) if isinstance(tree.left, Cell) else left
        power = F.when((size == 0) & (right < 0), None).otherwise(F.pow(size, right))
        return F.when(left < 0, -power).otherwise(power) if isinstance(tree.left, Cell) else power
    if tree.sign == "/":
        return F.try_divide(left, right)
    if tree.sign == "//":
        return F.floor(F.try_divide(left, right)).cast("double")
    return {"+": left + right, "-": left - right, "*": left * right}[tree.sign]


def printable(x: Column) -> Column:
    """Whether a value is written without an exponent."""
    return (x == 0) | ((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16))


@dataclass(frozen=True)
class Check:
    """Columns of one equation on one window."""

    left: Column
    right: Column
    difference: Column
    ok: Column


def compile_sides(left: str, right: str, cell, tolerance: float = TOLERANCE, strict: bool = False, need_cells: bool = False) -> Check:
    """``strict``: the difference must be under the tolerance, not at most it; ``need_cells``: each side must name a cell."""
    try:
        a, b = parse(left), parse(right)
    except BadEquation:
        none = F.lit(None).cast("double")
        return Check(none, none, none, F.lit(False))
    if need_cells and not (cells_of(a) and cells_of(b)):
        none = F.lit(None).cast("double")
        return Check(none, none, none, F.lit(False))
    x, y = value(a, cell), value(b, cell)
    gap = F.abs(x - y)
    fine = gap < tolerance if strict else gap <= tolerance
    for c in dict.fromkeys(cells_of(a) + cells_of(b)):
        fine = fine & printable(cell(c))
    return Check(x, y, gap, F.coalesce(fine & ~F.isnan(gap), F.lit(False)))


def in_window(values: Column, height: int, width: int):
    """Cells of a window whose values are an array, row by row; null outside."""
    def cell(c: Cell) -> Column:
        return F.get(values, c.row * width + c.col) if 0 <= c.row < height and 0 <= c.col < width else F.lit(None).cast("double")

    return cell


def degenerate(equation: str) -> str | None:
    """Why an equation says nothing, or null."""
    both = sides(equation)
    if not both:
        return "no sides"
    left, right = both
    if not re.search(r"\$\(", left + right):
        return "no cells"
    if left == right:
        return "same sides"
    for whole, part in ((left, right), (right, left)):
        m = re.fullmatch(r"(\$\(-?[0-9]+,-?[0-9]+\))([+-])(\$\(-?[0-9]+,-?[0-9]+\))", whole)
        if m and ((m[2] == "+" and part in (m[1], m[3])) or (m[2] == "-" and part == m[1])):
            return "a cell must be zero"
    return None


