"""What workbooks hold beside cells: pictures, text boxes and drop-down lists, with their places in sheets.

One pass reads the members of each file and gives flat rows; which sheet shows which drawing, and which drawing which
picture, are joins of these rows.  XML of sheets is read as a stream and pictures are hashed piece by piece, so a task
holds one member's drawing at most.

Defined results: a file that is no archive, and a member that can't be read, give a row of kind ``error`` (see ``errors``) while the
other members count; relations to what isn't in the file are passed over; anchors without a cell have null places;
a picture that is shown twice is listed twice; no files, no rows.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import a1
from quadrille.session import cut
from quadrille.sources.xlsx import BOOKS, MAIN, RELATION, arrow_schema

ELEMENTS = "path string, member string, kind string, place int, key string, target string, text string, top int, left int, bottom int, right int, size long, digest string"
SCHEMA = arrow_schema(ELEMENTS)
BOOK = "xl/workbook.xml"
PIECE = 1 << 20
DIGEST = 16  # letters of a picture's hash that are kept
#: Namespaces of the format.
DRAWN = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
ART = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
EMBED = RELATION.replace("}id", "}embed")

Element = dict[str, object]


def _resolved(owner: str, target: str) -> str:
    """The member that a relation of ``owner`` means."""
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(owner), target))


def _relations(member: str, f: IO[bytes]) -> Iterator[Element]:
    folder, name = posixpath.split(member)
    owner = posixpath.join(posixpath.dirname(folder), name.removesuffix(".rels"))
    for r in ET.parse(f).getroot().iter(f"{PACKAGE}Relationship"):
        if r.get("Id") and r.get("Target") and r.get("TargetMode") != "External":
            yield {"member": owner, "kind": "relation", "key": r.get("Id"), "target": _resolved(owner, r.get("Target"))}


def _sheets(member: str, f: IO[bytes]) -> Iterator[Element]:
    for i, s in enumerate(ET.parse(f).getroot().iter(f"{MAIN}sheet")):
        yield {"member": member, "kind": "sheet", "place": i, "key": s.get(RELATION), "text": s.get("name")}


def _of_sheet(member: str, f: IO[bytes]) -> Iterator[Element]:
    """Drawings and drop-down lists; rows of cells are let go as they end."""
    n, root = 0, None
    for event, e in ET.iterparse(f, ("start", "end")):
        root = e if root is None else root
        if event == "start":
            continue
        if e.tag == f"{MAIN}drawing":
            yield {"member": member, "kind": "drawing", "key": e.get(RELATION)}
        elif e.tag == f"{MAIN}dataValidation":
            yield {"member": member, "kind": "validation", "place": n, "key": e.get("type"), "target": e.get("sqref"), "text": e.findtext(f"{MAIN}formula1")}
            n += 1
        if e.tag == f"{MAIN}row":
            e.clear()
        elif e.tag == f"{MAIN}sheetData":
            root.clear()


def _corner(anchor: ET.Element, name: str) -> tuple[int | None, int | None]:
    at = anchor.find(DRAWN + name)
    if at is None:
        return None, None
    row, col = (at.findtext(DRAWN + x, "0").strip() for x in ("row", "col"))
    return (int(row) if row.isdigit() else 0) + 1, (int(col) if col.isdigit() else 0) + 1


def _of_drawing(member: str, f: IO[bytes]) -> Iterator[Element]:
    pictures = 0
    for i, anchor in enumerate(x for x in ET.parse(f).getroot() if x.tag.startswith(DRAWN) and x.tag.endswith("Anchor")):
        top, left = _corner(anchor, "from")
        bottom, right = _corner(anchor, "to")
        if bottom is None:
            bottom, right = top, left
        at = {"member": member, "top": top, "left": left, "bottom": bottom, "right": right}
        for blip in anchor.iter(f"{ART}blip"):
            yield at | {"kind": "picture", "place": pictures, "key": blip.get(EMBED)}
            pictures += 1
        lines = [t.text.strip() for t in anchor.iter(f"{ART}t") if t.text and t.text.strip()]
        if lines and top is not None:
            yield at | {"kind": "textbox", "place": i, "text": "\n".join(lines), "size": len(lines)}


def _media(member: str, f: IO[bytes]) -> Iterator[Element]:
    size, digest = 0, hashlib.sha256()
    while piece := f.read(PIECE):
        size += len(piece)
        digest.update(piece)
    yield {"member": member, "kind": "media", "size": size, "digest": digest.hexdigest()[:DIGEST]}


def _reader(member: str):
    folder = posixpath.dirname(member)
    if member.endswith(".rels"):
        return _relations
    if member == BOOK:
        return _sheets
    if not member.endswith(".xml"):
        return _media if folder == "xl/media" else None
    return {"xl/worksheets": _of_sheet, "xl/drawings": _of_drawing}.get(folder)


def read_elements(content: bytes) -> Iterator[Element]:
    """Elements of one workbook; what can't be read is an element of kind ``error``."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        yield {"kind": "error", "text": str(e)}
        return
    with z:
        for member in z.namelist():
            if (read := _reader(member)) is None:
                continue
            try:
                with z.open(member) as f:
                    found = list(read(member, f))
            except (ET.ParseError, zipfile.BadZipFile, ValueError, OSError, EOFError, NotImplementedError, RuntimeError, zipfile.zlib.error) as e:
                found = [{"member": member, "kind": "error", "text": f"{type(e).__name__}: {e}"}]
            yield from found


def elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Elements of all workbooks under a path, written once, so that no later join opens the files again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                yield pa.RecordBatch.from_pylist([{"path": p.as_py(), **x} for x in read_elements(content.as_py())], SCHEMA)

    return cut(spark.read.format("binaryFile").option("pathGlobFilter", BOOKS).load(path).select("path", "content").mapInArrow(run, ELEMENTS))


def errors(found: DataFrame) -> DataFrame:
    """(path, member, error): files (null member) and members that couldn't be read."""
    return found.where("kind = 'error'").select("path", "member", F.col("text").alias("error"))


def _followed(df: DataFrame, found: DataFrame, key: str, to: str) -> DataFrame:
    """``df`` (path, member, key) with the member that its key leads to as ``to``."""
    links = found.where("kind = 'relation'").select("path", "member", F.col("key").alias(key), F.col("target").alias(to))
    return df.join(links, ["path", "member", key])


def sheets(found: DataFrame) -> DataFrame:
    """(path, sheet, place, member) of all sheets."""
    named = found.where("kind = 'sheet'").select("path", "member", "key", F.col("text").alias("sheet"), "place")
    return _followed(named, found, "key", "to").select("path", "sheet", "place", F.col("to").alias("member"))


def _drawn(found: DataFrame) -> DataFrame:
    """(path, sheet, sheet_place, member): drawings of sheets."""
    shown = found.where("kind = 'drawing'").select("path", "member", "key").join(sheets(found).withColumnRenamed("place", "sheet_place"), ["path", "member"])
    return _followed(shown, found, "key", "to").select("path", "sheet", "sheet_place", F.col("to").alias("member"))


def _cell(row: str, col: str) -> Column:
    return F.when(F.col(row).isNotNull(), a1.cell(F.col(row), F.col(col)))


def images(found: DataFrame) -> DataFrame:
    """(path, sheet, local_index, id, placeholder, type, anchor_cell, anchor_row, anchor_col, size_bytes, image_hash).

    Ids count the pictures of a workbook from 0, sheet by sheet; a picture without a cell is a ``sheet_image``; size and hash are null if the
    file lacks it.
    """
    pictures = found.where("kind = 'picture'").select("path", "member", "key", "place", "top", "left").join(_drawn(found), ["path", "member"])
    media = found.where("kind = 'media'").select("path", F.col("member").alias("to"), "size", "digest")
    links = found.where("kind = 'relation'").select("path", "member", "key", F.col("target").alias("to"))
    held = pictures.join(links, ["path", "member", "key"], "left").join(media, ["path", "to"], "left")
    order = ["sheet_place", "member", "place"]
    number = lambda *by: (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int")
    told = held.withColumns({"local_index": number("path", "sheet"), "id": number("path")})
    return told.select(
        "path", "sheet", "local_index", "id", F.format_string("[IMAGE_PLACEHOLDER_%d]", "id").alias("placeholder"), F.when(F.col("top").isNull(), "sheet_image").otherwise("cell_image").alias("type"),
        _cell("top", "left").alias("anchor_cell"), F.col("top").alias("anchor_row"), F.col("left").alias("anchor_col"), F.col("size").alias("size_bytes"), F.col("digest").alias("image_hash"))


def text_boxes(found: DataFrame) -> DataFrame:
    """(path, sheet, textbox_id, top, left, bottom, right, a1_range, text, line_count) of boxes anchored to cells."""
    boxes = found.where("kind = 'textbox'").select("path", "member", "place", "top", "left", "bottom", "right", "text", F.col("size").alias("line_count"))
    order = Window.partitionBy("path", "sheet").orderBy("member", "place")
    placed = boxes.join(_drawn(found), ["path", "member"]).withColumn("textbox_id", (F.row_number().over(order) - 1).cast("int"))
    return placed.select("path", "sheet", "textbox_id", "top", "left", "bottom", "right", F.concat_ws(":", _cell("top", "left"), _cell("bottom", "right")).alias("a1_range"), "text", "line_count")


def validations(found: DataFrame) -> DataFrame:
    """(path, sheet, rank, type, sqref, formula1), as ``operators.validations`` takes them (of one workbook, or with path and sheet joined)."""
    lists = found.where("kind = 'validation'").select("path", "member", F.col("place").alias("rank"), F.col("key").alias("type"), F.col("target").alias("sqref"), F.col("text").alias("formula1"))
    return lists.join(sheets(found).select("path", "sheet", "member"), ["path", "member"]).select("path", "sheet", "rank", "type", "sqref", "formula1")
