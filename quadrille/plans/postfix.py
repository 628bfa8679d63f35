"""Equations that are data: texts in columns become postfix tokens, and these are evaluated row by row with a stack.

This says what ``equation`` says for equations known when the plan is built, but for columns of any
equations; both steps are higher-order functions, so no Python runs and no rule passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.plans.equation import printable

TOKEN = "struct<op:string,value:double,row:int,col:int>"
CELL = r"\$\((-?[0-9]+),(-?[0-9]+)\)"
PIECE = rf"({CELL}|[0-9]+\.?[0-9]*|\.[0-9]+|\*\*|//|[-+*/()])"
ORDER = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "negative": 3, "**": 4, "cell**": 4}
MOST_DIGITS = 9  # of a cell's row or column; more is no cell


def _binding(sign: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, n in ORDER.items():
        out = out.when(sign == name, n)
    return out.otherwise(0)


def _token(op: Column, value: Column | None = None, row: Column | None = None, col: Column | None = None) -> Column:
    return F.struct(op.alias("op"), (F.lit(None).cast("double") if value is None else value).alias("value"), *((F.lit(None).cast("int") if x is None else x).alias(n) for n, x in (("row", row), ("col", col))))


def _signs(ops: Column) -> Column:
    return F.transform(ops, lambda o: _token(o))


def postfix(text: Column) -> Column:
    """array of tokens of an expression in postfix order; null if it is none.  White space parts tokens and says nothing else."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    start = F.struct(F.array().cast(f"array<{TOKEN}>").alias("out"), F.array().cast("array<string>").alias("ops"), F.lit("(").alias("before"), F.lit(True).alias("ok"))

    def state(out: Column, ops: Column, before: Column, ok: Column) -> Column:
        return F.struct(out.alias("out"), ops.alias("ops"), before.alias("before"), ok.alias("ok"))

    def popped(s: Column, stays) -> tuple[Column, Column]:
        """Signs from the top of the stack down to one that stays, and the rest."""
        down = F.reverse(s["ops"])
        first = F.array_position(F.transform(down, stays), F.lit(True)).cast("int")
        n = F.when(first == 0, F.size(down)).otherwise(first - 1)
        return F.slice(down, F.lit(1), n), F.slice(s["ops"], F.lit(1), F.size(down) - n)

    def step(s: Column, t: Column) -> Column:
        open_ = s["before"].isin("(", "sign")  # an operand must follow
        cell = t.startswith("$")
        where = [F.regexp_extract(t, CELL, i) for i in (1, 2)]
        operand = F.when(cell, _token(F.lit("cell"), row=where[0].try_cast("int"), col=where[1].try_cast("int"))).otherwise(_token(F.lit("number"), t.try_cast("double")))
        sign = F.when((t == "**") & (s["before"] == "cell"), F.lit("cell**")).otherwise(t)
        closed, below = popped(s, lambda o: o == "(")
        least = F.when(t == "**", 5).otherwise(_binding(t))
        bound, rest = popped(s, lambda o: _binding(o) < least)
        return (
            F.when(cell | t.rlike("^[0-9.]"), state(F.array_append(s["out"], operand), s["ops"], F.when(cell, F.lit("cell")).otherwise("number"), s["ok"] & open_))
            .when(t == "(", state(s["out"], F.array_append(s["ops"], t), F.lit("("), s["ok"] & open_))
            .when(t == ")", state(F.concat(s["out"], _signs(closed)), F.slice(below, F.lit(1), F.greatest(F.size(below) - 1, F.lit(0))), F.lit(")"), s["ok"] & ~open_ & (F.size(below) > 0)))
            .when(open_, state(s["out"], F.when(t == "-", F.array_append(s["ops"], F.lit("negative"))).otherwise(s["ops"]), F.lit("sign"), s["ok"] & t.isin("+", "-")))
            .otherwise(state(F.concat(s["out"], _signs(bound)), F.array_append(rest, sign), F.lit("sign"), s["ok"]))
        )

    def end(s: Column) -> Column:
        fine = s["ok"] & ~s["before"].isin("(", "sign") & ~F.array_contains(s["ops"], "(")
        return F.when(fine, F.concat(s["out"], _signs(F.reverse(s["ops"]))))

    whole = F.array_join(pieces, "") == F.regexp_replace(text, r"\s+", "")
    small = ~text.rlike(rf"\$\([^)]*[0-9]{{{MOST_DIGITS + 1}}}")
    return F.when(whole & small & (F.size(pieces) > 0), F.aggregate(pieces, start, step, end))


def cells(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t["op"] == "cell")


def evaluate(tokens: Column, cell=None) -> Column:
    """The value of postfix tokens; ``cell`` gives the column of a cell from its row and column.  Null where there is none."""

    def step(stack: Column, t: Column) -> Column:
        n = F.size(stack)
        y, x = F.get(stack, n - 1), F.get(stack, n - 2)
        power = F.when((x == 0) & (y < 0), None).otherwise(F.pow(x, y))
        of_cell = F.when((x == 0) & (y < 0), None).when(x < 0, -F.pow(F.abs(x), y)).otherwise(F.pow(x, y))  # -5 ** 2 is -(5 ** 2) as a text
        binary = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y), "//": F.floor(F.try_divide(x, y)).cast("double"), "**": power, "cell**": of_cell}
        made = F.when(F.lit(False), F.lit(None).cast("double"))
        for op, v in binary.items():
            made = made.when(t["op"] == op, v)
        held = F.when(t["op"] == "number", t["value"])
        if cell is not None:
            held = held.when(t["op"] == "cell", cell(t["row"], t["col"]))
        return (
            F.when(t["op"].isin("number", "cell"), F.array_append(stack, held))
            .when(t["op"] == "negative", F.array_append(F.slice(stack, F.lit(1), F.greatest(n - 1, F.lit(0))), -y))
            .otherwise(F.array_append(F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0))), made))
        )

    return F.aggregate(tokens, F.array().cast("array<double>"), step, lambda s: F.get(s, F.lit(0)))


def in_window(values: Column, height: Column | int, width: Column | int):
    """Cells of a window whose values are an array, row by row; null outside."""
    height, width = (x if isinstance(x, Column) else F.lit(x) for x in (height, width))

    def cell(row: Column, col: Column) -> Column:
        return F.when((row >= 0) & (row < height) & (col >= 0) & (col < width), F.get(values, row * width + col))

    return cell


def check(left: Column, right: Column, cell, tolerance: float, strict: bool = False) -> Column:
    """struct(lhs, rhs, difference, ok) of both sides' tokens; missing cells, and values that are written with an exponent, fail."""
    x, y = evaluate(left, cell), evaluate(right, cell)
    gap = F.abs(x - y)
    fine = gap < tolerance if strict else gap <= tolerance
    plain = F.forall(F.concat(cells(left), cells(right)), lambda t: printable(cell(t["row"], t["col"])))
    return F.struct(x.alias("lhs"), y.alias("rhs"), gap.alias("difference"), F.coalesce(fine & plain & ~F.isnan(gap), F.lit(False)).alias("ok"))


def holds(left: Column, right: Column, cell, tolerance: float) -> Column:
    """What ``check`` calls ok; both sides are worked out once."""
    plain = F.forall(F.concat(cells(left), cells(right)), lambda t: printable(cell(t["row"], t["col"])))
    return F.coalesce(F.abs(evaluate(left, cell) - evaluate(right, cell)) <= tolerance, F.lit(False)) & F.coalesce(plain, F.lit(False))
