"""Sinks: matrices and records as CSV or JSON, reports, rule books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.cells import matrix


def csv(records: DataFrame, path: str, header: bool = True) -> None:
    """Null becomes an empty field."""
    records.write.option("header", header).option("nullValue", "").option("emptyValue", "").csv(path)


def json_records(records: DataFrame, path: str) -> None:
    records.write.option("ignoreNullFields", "false").json(path)


def json_matrix(cells: DataFrame, path: str) -> None:
    """One line for each row of each sheet."""
    matrix(cells).write.option("ignoreNullFields", "false").json(path)


def report(checked: DataFrame, path: str, kind: str = "json") -> None:
    """A report's rows as JSON, or as readable lines."""
    if kind == "json":
        checked.write.json(path)
    else:
        told = F.format_string("row %d, column %d: %s is %s", F.col("start_row") + 1, F.col("start_col") + 1, "equation", F.when(F.col("ok"), "kept").otherwise("broken"))
        checked.select(told).write.text(path)
