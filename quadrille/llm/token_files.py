"""Token-id files: independent zstandard frames with a trailing seek table.

A file holds ids as little-endian unsigned 32-bit integers in frames of whole
documents, then a skippable frame with the index of documents, then the seek table
of the public zstandard seekable format: sizes and a checksum of each frame.
A reader decompresses only the frames that hold the wanted documents.

Defined results: a null text is empty and has only the end id; null doc_ids come
first; rows of one doc_id stay rows of their own; an empty table gives no files.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quadrille.llm.storage import new_path
from quadrille.llm.tokens import encoder, tokenizer_path, with_end

FRAME_IDS = 1 << 16

#: Fixed values of the zstandard seekable format.
SEEK_FRAME = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
#: A skippable frame of our own.
INDEX_FRAME = 0x184D2A50

INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4"), ("start", "<u8")])


class DamagedFile(ValueError):
    """A checksum or a size in the file does not hold."""


class Writer:
    """Writes documents in the order they come."""

    def __init__(self, out: BinaryIO, frame_ids: int = FRAME_IDS, level: int = 3) -> None:
        import zstandard

        self.out, self.frame_ids = out, frame_ids
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.parts: list[np.ndarray] = []
        self.held, self.total = 0, 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.held + len(ids) > self.frame_ids:
            self._flush()
        self.index.append((doc_id or 0, doc_id is None, len(self.frames), self.held, len(ids), self.total))
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)

    def _flush(self) -> None:
        import xxhash

        raw = np.concatenate(self.parts).astype("<u4").tobytes()
        packed = self.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.parts, self.held = [], 0

    def close(self) -> None:
        if self.parts:
            self._flush()
        index = self.compress(np.array(self.index, INDEX).tobytes())
        self.out.write(struct.pack("<2I", INDEX_FRAME, len(index)) + index)
        table = b"".join(struct.pack("<3I", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<2I", SEEK_FRAME, len(table)) + table)


class Reader:
    """Reads documents by their place in the index; a frame is decompressed once for neighbours."""

    def __init__(self, source: BinaryIO, size: int) -> None:
        import zstandard

        self.source, self.decompress = source, zstandard.ZstdDecompressor().decompress
        n, kind, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEK_MAGIC or kind != CHECKSUMS:
            raise DamagedFile("no seek table with checksums at the end")
        self.frames = np.frombuffer(self._bytes(size - 9 - 12 * n, 12 * n), "<u4").reshape(-1, 3)
        self.places = np.append(0, np.cumsum(self.frames[:, 0], dtype=np.int64))
        magic, length = struct.unpack("<2I", self._bytes(int(self.places[-1]), 8))
        if magic != INDEX_FRAME:
            raise DamagedFile("no index after the frames")
        self.index = np.frombuffer(self.decompress(self._bytes(int(self.places[-1]) + 8, length)), INDEX)
        self.held, self.ids = -1, np.empty(0, "<u4")

    def _bytes(self, at: int, n: int) -> bytes:
        if at < 0:
            raise DamagedFile("the file is too short")
        self.source.seek(at)
        got = self.source.read(n)
        if len(got) != n:
            raise DamagedFile("the file is too short")
        return got

    def frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        if k != self.held:
            packed, size, check = self.frames[k].tolist()
            try:
                raw = self.decompress(self._bytes(int(self.places[k]), packed), max_output_size=size)
            except zstandard.ZstdError as e:
                raise DamagedFile(f"frame {k}: {e}") from e
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise DamagedFile(f"frame {k} differs from its checksum")
            self.held, self.ids = k, np.frombuffer(raw, "<u4")
        return self.ids

    def document(self, i: int) -> np.ndarray:
        x = self.index[i]
        return self.frame(int(x["frame"]))[int(x["at"]) : int(x["at"]) + int(x["n"])]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, frame_ids: int = FRAME_IDS) -> list[tuple[str, int]]:
    """Write all ids in ascending order of doc_id; (path, ids in it) of each file, in order.

    To the driver comes one small row for each file.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        final, temporary, out, writer = f"{folder}/ids-{part:07d}.zst", f"{folder}/.ids-{part:07d}-{attempt}", None, None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                store, place = _opened(temporary)
                store.create_dir(_opened(folder)[1], recursive=True)
                out = store.open_output_stream(place)
                writer = Writer(out, frame_ids)
            for i, j, ids, at in encoder(path).encode(b.column(1)):
                ids, at = with_end(ids, at)
                for k, doc in enumerate(b.column(0).slice(i, j - i).to_pylist()):
                    writer.add(doc, ids[at[k] : at[k + 1]])
        if writer is not None:
            writer.close()
            out.close()
            store.move(place, _opened(final)[1])  # whichever attempt ends last, the file is whole
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([final]), pa.array([writer.total], pa.int64())], names=["part", "path", "n"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    files = ordered.mapInArrow(run, "part int, path string, n long").collect()
    return [(f["path"], f["n"]) for f in sorted(files, key=lambda f: f["part"])]


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_files(spark, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files; start counts from the first file."""
    rows, before = [], 0
    for path, n in files:
        rows.append((path, before))
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, place = _opened(path)
                with store.open_input_file(place) as source:
                    r = Reader(source, source.size())
                    crc = [zlib.crc32(r.document(i).tobytes()) for i in range(len(r.index))]
                x = r.index
                yield pa.RecordBatch.from_arrays([pa.array(x["doc_id"].astype(np.int64), mask=x["is_null"].astype(bool)), pa.array(x["start"].astype(np.int64) + first), pa.array(x["n"].astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "path string, first long")
    return listed.repartition(max(1, len(rows))).mapInArrow(run, READ)


def read_documents(path: str, wanted: set[int]) -> dict[int, np.ndarray]:
    """Ids of the wanted documents of one file; other frames stay compressed."""
    store, place = _opened(path)
    with store.open_input_file(place) as source:
        r = Reader(source, source.size())
        hits = np.flatnonzero(np.isin(r.index["doc_id"], list(wanted)) & (r.index["is_null"] == 0))
        return {int(r.index["doc_id"][i]): r.document(i).copy() for i in hits.tolist()}


def in_memory(documents: list[tuple[int | None, np.ndarray]], frame_ids: int = FRAME_IDS) -> bytes:
    """A file's bytes."""
    out = io.BytesIO()
    w = Writer(out, frame_ids)
    for doc, ids in documents:
        w.add(doc, ids)
    w.close()
    return out.getvalue()


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files in the shared folder, and read them back."""
    spark = docs.sparkSession
    return read_files(spark, write_files(docs, new_path(spark, "token-files"), tokenizer))
