"""Folders of files, imported again and again: each run reads what is new or changed since the last manifest, by type.

A manifest is a table (path, mtime, size) in a numbered folder; the highest number is the current one.  A new one is written beside and
put in its place by one rename, so a run that dies leaves the last manifest valid and its files are read again.

Defined results: a file counts as changed if its time (whole seconds) or its size is another; one that is touched while it is read is read again next
time; a file that can't be read, or is of no known type, gives a row of kind ``error`` and is in the manifest, so that it is tried again
when it changes; files that are gone are in ``removed``; texts are read in the first codec that fits; an empty file counts as none, as
Spark lists none, so one that is emptied is in ``removed``.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.session import cut
from quadrille.sources.inline import separator_of
from quadrille.sources.xlsx import arrow_schema, read_cells

#: Types by suffix, and codecs in the order they are tried.
TYPES = {".xlsx": "xlsx", ".xls": "xlsx", ".xlsm": "xlsx", ".csv": "xlsx", ".txt": "txt", ".text": "txt", ".md": "md", ".markdown": "md", ".json": "json"}
CODECS = ("utf-8-sig", "utf-8", "cp950", "big5", "latin-1")
ROWS = "path string, parser_type string, kind string, codec string, sheet string, row long, col int, raw string, formula boolean, text string"
SCHEMA = arrow_schema(ROWS)
BATCH = 50_000  # rows of an Arrow batch
DIGITS = 8


class ManifestConflict(RuntimeError):
    """Another run has written the next manifest first."""


def parser_type(path: Column) -> Column:
    """The type of a file's suffix; an unknown suffix is its own type, without the dot."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    known = F.element_at(F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair)), suffix)
    return F.coalesce(known, F.regexp_replace(suffix, r"^\.", ""))


def listing(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """(path, mtime, size, parser_type) of all files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), parser_type(F.col("path")).alias("parser_type"))


def _files(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()), path


def _version(spark: SparkSession, folder: str) -> int:
    """The number of the current manifest, 0 if there is none."""
    _, files, path = _files(spark, folder)
    if not files.util().exists(path):
        return 0
    names = [s.getPath().getName() for s in files.util().listStatus(path)]
    return max((int(n) for n in names if re.fullmatch(f"[0-9]{{{DIGITS}}}", n)), default=0)


def _place(folder: str, version: int) -> str:
    return f"{folder}/{version:0{DIGITS}d}"


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(path, mtime, size) as the last run, or a given one, left it; empty before the first."""
    version = _version(spark, folder) if version is None else version
    return spark.read.parquet(_place(folder, version)) if version else spark.createDataFrame([], "path string, mtime long, size long")


def _commit(files: DataFrame, folder: str, version: int) -> None:
    spark = files.sparkSession
    beside = f"{folder}/.new-{uuid.uuid4().hex}"
    files.select("path", "mtime", "size").write.parquet(beside)
    jvm, context, _ = _files(spark, folder)
    path, kind = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    if context.util().exists(path(_place(folder, version))):
        context.delete(path(beside), True)
        raise ManifestConflict(f"manifest {version} is there already")
    context.rename(path(beside), path(_place(folder, version)), how)


def _text(raw: bytes) -> tuple[str, str]:
    for codec in CODECS:
        try:
            return raw.decode(codec), codec
        except UnicodeDecodeError:
            continue
    raise ValueError("no codec fits")  # latin-1 fits all


def _rows(path: str, kind: str, raw: bytes) -> Iterator[dict[str, object]]:
    """Cells of a workbook or CSV file, the text of another."""
    suffix = posixpath.splitext(path)[1].lower()
    if suffix in (".xlsx", ".xlsm"):
        for sheet, row, col, text, formula in read_cells(raw):
            yield {"kind": "cell", "sheet": sheet, "row": row, "col": col, "raw": text, "formula": formula}
    elif suffix == ".csv":
        text, codec = _text(raw)
        csv.field_size_limit(2**31 - 1)
        for r, values in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=separator_of(text)), 1):
            for c, x in enumerate(values, 1):
                if x != "":
                    yield {"kind": "cell", "codec": codec, "sheet": "Sheet1", "row": r, "col": c, "raw": x, "formula": x.startswith("=")}
    elif kind in ("txt", "md"):
        text, codec = _text(raw)
        yield {"kind": "text", "codec": codec, "text": text}
    elif kind == "json":
        yield {"kind": "text", "codec": "utf-8", "text": json.dumps(json.loads(raw.decode("utf-8-sig")), ensure_ascii=False)}
    else:
        yield {"kind": "error", "text": f"unsupported type: {suffix or kind}"}


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cells, texts and errors of files, by type; a file is opened once, in a task.  A file that fails gives its error alone."""
    if not paths:
        return spark.createDataFrame([], ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, kind, raw in zip(b["path"].to_pylist(), b["parser_type"].to_pylist(), b["content"], strict=True):
                try:
                    rows = list(_rows(path, kind, raw.as_py()))
                except (ValueError, KeyError, IndexError, TypeError, csv.Error, zipfile.BadZipFile, zipfile.zlib.error, ET.ParseError, OSError, EOFError, RuntimeError) as e:
                    rows = [{"kind": "error", "text": f"{type(e).__name__}: {e}"}]
                for i in range(0, len(rows), BATCH):
                    yield pa.RecordBatch.from_pylist([{"path": path, "parser_type": kind, **x} for x in rows[i : i + BATCH]], SCHEMA)

    plain = [re.sub(r"([\\*?\[\]{},])", r"\\\1", p) for p in paths]  # names with signs of patterns mean themselves
    files = spark.read.format("binaryFile").load(plain)
    return files.select("path", parser_type(F.col("path")).alias("parser_type"), "content").mapInArrow(run, ROWS)


@dataclass(frozen=True)
class Import:
    """What a run found: rows of new and changed files, and the lists of files."""

    rows: DataFrame
    changed: DataFrame
    removed: DataFrame
    version: int

    @property
    def cells(self) -> DataFrame:
        return self.rows.where("kind = 'cell'").select("path", "sheet", "row", "col", "raw", "formula")

    @property
    def texts(self) -> DataFrame:
        return self.rows.where("kind = 'text'").select("path", "parser_type", "codec", "text")

    @property
    def errors(self) -> DataFrame:
        return self.rows.where("kind = 'error'").select("path", "parser_type", F.col("text").alias("error"))


def run(spark: SparkSession, path: str | list[str], folder: str, recursive: bool = True) -> Import:
    """Read what has changed since the manifest in ``folder`` and write the next one; a run without changes writes none.

    Rows are written before the manifest is, so a file is in a manifest only when it has been read.  Names of changed files pass through the
    driver, whose index of the folder holds all names anyway.
    """
    version = _version(spark, folder)
    known = manifest(spark, folder, version)
    found = cut(listing(spark, path, recursive))
    changed = cut(found.join(known, ["path", "mtime", "size"], "left_anti"))
    removed = cut(known.join(found, "path", "left_anti"))
    rows = cut(read(spark, [r["path"] for r in changed.select("path").toLocalIterator()]))
    if changed.isEmpty() and removed.isEmpty():
        return Import(rows, changed, removed, version)
    _commit(found, folder, version + 1)
    return Import(rows, changed, removed, version + 1)
