"""Workbooks (.xlsx, .xlsm): a reader to cells, and a plain writer.

The reader takes files as Spark lists them; each is opened in a task, and sheets'
XML is parsed as a stream.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quadrille.functions.a1 import number_of

CELLS = "path string, sheet string, row long, col int, raw string, formula boolean"
BOOKS = "*.{xlsx,xlsm}"
#: Namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def arrow_schema(fields: str) -> pa.Schema:
    """The Arrow schema of plain fields, as ``path string, row long``."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, place in the archive), in order."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ET.fromstring(z.read("xl/workbook.xml"))
    return [(s.get("name"), "xl/" + targets[s.get(RELATION)].removeprefix("/xl/")) for s in book.iter(f"{MAIN}sheet")]


def read_cells(content: bytes) -> Iterator[tuple[str, int, int, str, bool]]:
    """(sheet, row, col, text, whether it is a formula) of all cells that hold something; formulas are kept as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = _strings(z)
        for name, place in sheets(z):
            with z.open(place) as f:
                for _, c in ET.iterparse(f):
                    if c.tag != f"{MAIN}c":
                        continue
                    m = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r", ""))
                    value, formula = c.find(f"{MAIN}v"), c.find(f"{MAIN}f")
                    if formula is not None and formula.text:
                        text = "=" + formula.text
                    elif c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    elif value is None or value.text is None:
                        c.clear()
                        continue
                    elif c.get("t") == "s":
                        text = shared[int(value.text)]
                    elif c.get("t") == "b":
                        text = "TRUE" if value.text == "1" else "FALSE"
                    else:
                        text = value.text
                    if m:
                        yield name, int(m[2]), number_of(m[1]), text, text.startswith("=")
                    c.clear()


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cells of all workbooks under a path."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in CELLS.split(", ")]
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                rows = [(p, *x) for x in read_cells(bytes(content))]
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", BOOKS).load(path).select("path", "content").mapInPandas(run, CELLS)


def workbook(sheets_of: dict[str, list[list[object]]], marked: set[tuple[str, int, int]] = frozenset()) -> bytes:
    """Bytes of a workbook from matrices; marked cells (sheet, row, col) are filled yellow."""
    from quadrille.sources._letters import letters

    def cell(sheet: str, r: int, c: int, x: object) -> str:
        at, style = f"{letters(c)}{r}", ' s="1"' if (sheet, r, c) in marked else ""
        if x is None:
            return f'<c r="{at}"{style}/>' if style else ""
        if isinstance(x, bool):
            return f'<c r="{at}"{style} t="b"><v>{int(x)}</v></c>'
        if isinstance(x, int | float):
            return f'<c r="{at}"{style}><v>{x!r}</v></c>'
        text = str(x)
        if text.startswith("="):
            return f'<c r="{at}"{style}><f>{escape(text[1:])}</f></c>'
        return f'<c r="{at}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = MAIN[1:-1], RELATION[1:].partition("}")[0]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets_of)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + f'<Relationship Id="rId0" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFFF00"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fillId="2" applyFill="1"/></cellXfs></styleSheet>')
        for i, n in enumerate(names, 1):
            rows = "".join(f'<row r="{r}">' + "".join(cell(n, r, c, x) for c, x in enumerate(row, 1)) + "</row>" for r, row in enumerate(sheets_of[n], 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()
