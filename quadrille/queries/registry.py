"""All registered queries of the library and their SQL."""

from __future__ import annotations

from quadrille.queries import choices, layouts, outlines, prose, ruletables, rulework, sheets, verdicts
from quadrille.queries.base import Query

BOOKS = (sheets.BOOK, layouts.BOOK, rulework.BOOK, verdicts.BOOK, ruletables.BOOK, prose.BOOK, outlines.BOOK, choices.BOOK)


def queries() -> dict[str, Query]:
    return {name: f for b in BOOKS for name, f in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for b in BOOKS for name, sql in b.sql.items()}
