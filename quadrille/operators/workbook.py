"""Workbooks as catalogs of lazy sheets: commands change plans, not cells in memory."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import a1
from quadrille.operators import cells as C
from quadrille.sources._letters import letters

EMPTY = "sheet string, row long, col int, raw string"


class CommandError(ValueError):
    """A command that can't be done."""


@dataclass
class Workbook:
    """Sheets by name, in order, with tables, filters, validations and a log."""

    spark: SparkSession
    sheets: dict[str, DataFrame] = field(default_factory=dict)
    active: str | None = None
    tables: dict[str, tuple[str, str]] = field(default_factory=dict)
    filters: dict[str, str] = field(default_factory=dict)
    validations: list[tuple[str, str, list[str]]] = field(default_factory=list)
    log: list[tuple[int, str, str]] = field(default_factory=list)
    dirty: bool = False

    @classmethod
    def of(cls, cells: DataFrame) -> Workbook:
        """A workbook of (sheet, row, col, raw)."""
        book = cls(cells.sparkSession)
        for r in cells.select("sheet").distinct().orderBy("sheet").collect():
            book.add_sheet(r["sheet"], cells.where(F.col("sheet") == r["sheet"]).select("sheet", "row", "col", "raw"))
        book.dirty = False
        return book

    def _note(self, command: str, what: str) -> None:
        self.dirty = True
        self.log.append((len(self.log) + 1, command, what))

    def sheet(self, name: str | None = None) -> DataFrame:
        name = name or self.active
        if name not in self.sheets:
            raise CommandError(f"no sheet {name!r}")
        return self.sheets[name]

    def cells(self) -> DataFrame:
        out = self.spark.createDataFrame([], EMPTY)
        for df in self.sheets.values():
            out = out.unionByName(df)
        return out

    def add_sheet(self, name: str, cells: DataFrame | None = None) -> None:
        if name in self.sheets:
            raise CommandError(f"sheet {name!r} is there already")
        self.sheets[name] = cells if cells is not None else self.spark.createDataFrame([], EMPTY)
        self.active = self.active or name
        self._note("add_sheet", name)

    def rename_sheet(self, old: str, new: str) -> None:
        if new in self.sheets:
            raise CommandError(f"sheet {new!r} is there already")
        moved = self.sheet(old).withColumn("sheet", F.lit(new))
        self.sheets = {new if k == old else k: moved if k == old else v for k, v in self.sheets.items()}
        self.active = new if self.active == old else self.active
        self._note("rename_sheet", f"{old} to {new}")

    def delete_sheet(self, name: str) -> None:
        self.sheet(name)
        if len(self.sheets) == 1:
            raise CommandError("the last sheet stays")
        del self.sheets[name]
        self.active = next(iter(self.sheets)) if self.active == name else self.active
        self._note("delete_sheet", name)

    def copy_sheet(self, name: str, new: str) -> None:
        self.add_sheet(new, self.sheet(name).withColumn("sheet", F.lit(new)))

    def move_sheet(self, name: str, place: int) -> None:
        self.sheet(name)
        rest = [k for k in self.sheets if k != name]
        rest.insert(place, name)
        self.sheets = {k: self.sheets[k] for k in rest}
        self._note("move_sheet", name)

    def set_active(self, name: str) -> None:
        self.sheet(name)
        self.active = name

    def read_range(self, area: str, name: str | None = None) -> DataFrame:
        return C.in_area(self.sheet(name), area)

    def write_range(self, start: str, matrix: list[list[object]], name: str | None = None) -> None:
        """Put a matrix at a cell; null clears."""
        name = name or self.active
        top, left, _, _ = a1.parse_area(start)
        rows = [(name, top + r, left + c, None if x is None else str(x)) for r, line in enumerate(matrix) for c, x in enumerate(line)]
        self.sheets[name] = C.overwrite(self.sheet(name), self.spark.createDataFrame(rows, EMPTY)).where("raw is not null")
        self._note("write_range", f"{name}!{start}")

    def clear_range(self, area: str, name: str | None = None) -> None:
        name = name or self.active
        inside = C.in_area(self.sheet(name), area)
        self.sheets[name] = self.sheet(name).join(inside.select("sheet", "row", "col"), ["sheet", "row", "col"], "left_anti")
        self._note("clear_range", f"{name}!{area}")

    def append_rows(self, matrix: list[list[object]], name: str | None = None) -> None:
        name = name or self.active
        rows = [(name, r, c, None if x is None else str(x)) for r, line in enumerate(matrix, 1) for c, x in enumerate(line, 1)]
        self.sheets[name] = C.append_rows(self.sheet(name), self.spark.createDataFrame(rows, EMPTY))
        self._note("append_rows", name)

    def shift(self, axis: str, at: int, n: int, name: str | None = None) -> None:
        """Insert n rows or columns at a place, or delete -n."""
        name = name or self.active
        self.sheets[name] = C.insert_lines(self.sheet(name), axis, at, n) if n >= 0 else C.delete_lines(self.sheet(name), axis, at, -n)
        self._note("shift", f"{name} {axis} {at} {n}")

    def used_range(self, name: str | None = None) -> str:
        first = C.used_range(self.sheet(name)).first()
        return first["address"] if first else "A1:A1"

    def set_formula(self, cell: str, formula: str, name: str | None = None) -> None:
        self.write_range(cell, [[formula if formula.startswith("=") else "=" + formula]], name)

    def fill_formula(self, start: str, area: str, name: str | None = None) -> None:
        """Copy a cell's formula over an area, moving its relative references."""
        top, left, _, _ = a1.parse_area(start)
        held = self.read_range(start, name).first()
        if not held or not (held["raw"] or "").startswith("="):
            raise CommandError(f"{start} has no formula")
        r0, c0, r1, c1 = a1.parse_area(area)
        self.write_range(f"{letters(c0)}{r0}", [[translate(held["raw"], r - top, c - left) for c in range(c0, c1 + 1)] for r in range(r0, r1 + 1)], name)

    def create_table(self, table: str, area: str, name: str | None = None) -> None:
        a1.parse_area(area)
        if table in self.tables:
            raise CommandError(f"table {table!r} is there already")
        self.tables[table] = (name or self.active, area)
        self._note("create_table", table)

    def set_filter(self, area: str, name: str | None = None) -> None:
        """A mark on the sheet; no rows are hidden."""
        self.filters[name or self.active] = area
        self._note("set_filter", area)

    def clear_filter(self, name: str | None = None) -> None:
        self.filters.pop(name or self.active, None)
        self._note("clear_filter", name or self.active or "")

    def set_choices(self, area: str, choices: list[str], name: str | None = None) -> None:
        a1.parse_area(area)
        self.validations.append((name or self.active, area, choices))
        self._note("set_choices", area)

    def broken_choices(self) -> DataFrame:
        """Filled cells of a validated area whose value is none of its choices."""
        out = self.spark.createDataFrame([], EMPTY)
        for sheet, area, choices in self.validations:
            out = out.unionByName(C.in_area(self.sheet(sheet), area).where(F.col("raw").isNotNull() & ~F.col("raw").isin(*choices)))
        return out

    def audit_log(self, limit: int = 0) -> DataFrame:
        """The last entries; all of them if the limit is 0."""
        return self.spark.createDataFrame(self.log[-limit:] if limit else self.log, "n int, command string, what string")


_REFERENCE = re.compile(r"(\$?)([A-Z]{1,3})(\$?)([0-9]+)(?![0-9(A-Za-z])")


def translate(formula: str, rows: int, cols: int) -> str:
    """A formula as it reads some rows and columns on; parts after a dollar sign stay, texts in quotes too."""
    def moved(m: re.Match) -> str:
        col = m[2] if m[1] else letters(max(1, a1.number_of(m[2]) + cols))
        row = m[4] if m[3] else str(max(1, int(m[4]) + rows))
        return f"{m[1]}{col}{m[3]}{row}"

    parts = re.split(r'("[^"]*")', formula)
    return "".join(p if i % 2 else _REFERENCE.sub(moved, p) for i, p in enumerate(parts))
