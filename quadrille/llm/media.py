"""Media columns: ISO base media containers.

``encode_documents`` wraps bytes as an uncompressed 8x8 8-bit grey track, one
frame of 64 bytes per sample.  ``track_features`` walks the nested boxes of any
such file and decodes its sample tables; payload bytes are never looked at.

Defined results: a null text is an empty one; an empty payload is one frame of
zeros; a null or malformed container gives no tracks and a message in ``error``, as do boxes that
nest more than ``DEEPEST`` deep, tables that promise more than the file holds, and fragments; the digests of a
null container are null; very long texts are whole; repeated rows and equal ids give repeated results;
columns named like the output, whatever their case, are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 64
DEEPEST = 32  # boxes in boxes
GROUP = 16  # frames from one keyframe to the next
CHUNK = 32  # frames in a chunk
TIMESCALE = 25

#: Fixed values of the format: boxes that hold only boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"udta"}

MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class MalformedMedia(ValueError):
    """The bytes are no container that can be walked."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _entry() -> bytes:
    """Visual sample entry ``raw ``: 8 by 8, 8-bit grey (depth 40)."""
    return _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">2H2I", 8, 8, 0x480000, 0x480000), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 40, -1))


def _movie(n: int, data_at: int) -> bytes:
    chunks = np.arange(0, n, CHUNK, dtype=np.int64) * FRAME + data_at
    wide = bool(chunks[-1] >= 1 << 32)
    runs = [(1, CHUNK)] if n % CHUNK == 0 else [(1, CHUNK), (len(chunks), n % CHUNK)] if len(chunks) > 1 else [(1, n)]
    sync = np.arange(1, n + 1, GROUP, dtype=">u4")
    table = _box(
        b"stbl",
        _full(b"stsd", 0, 0, struct.pack(">I", 1), _entry()),
        _full(b"stts", 0, 0, struct.pack(">3I", 1, n, 1)),
        _full(b"stss", 0, 0, struct.pack(">I", len(sync)), sync.tobytes()),
        _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">3I", first, per, 1) for first, per in runs)),
        _full(b"stsz", 0, 0, struct.pack(">2I", FRAME, n)),
        _full(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", len(chunks)), chunks.astype(">u8" if wide else ">u4").tobytes()),
    )
    info = _box(b"minf", _full(b"vmhd", 0, 1, bytes(8)), _box(b"dinf", _full(b"dref", 0, 0, struct.pack(">I", 1), _full(b"url ", 0, 1))), table)
    media = _box(b"mdia", _full(b"mdhd", 0, 0, struct.pack(">4I2H", 0, 0, TIMESCALE, n, 0x55C4, 0)), _full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(12), b"\0"), info)
    head = _full(b"tkhd", 0, 3, struct.pack(">5I", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">2I", 8 << 16, 8 << 16))
    return _box(b"moov", _full(b"mvhd", 0, 0, struct.pack(">4I", 0, 0, TIMESCALE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2)), _box(b"trak", head, media))


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % FRAME or (0 if data else FRAME))


def encode(payload: bytes) -> bytes:
    """A container of ``payload``, whose length must be a positive multiple of 64."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    n = len(payload) // FRAME
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    header = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(_movie(n, 0))
    return kind + _movie(n, len(kind) + size + header) + _box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of the body) of each box between two places."""
    while start < end:
        if end - start < 8:
            raise MalformedMedia(f"{end - start} bytes left over at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise MalformedMedia(f"no room for a long size at {start}")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise MalformedMedia(f"box {kind!r} at {start} ends outside its parent")
        if kind == b"uuid":
            body = min(body + 16, stop)
        yield kind, body, stop
        start = stop


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes, parents first, with the path of types that leads to each; boxes nest at most ``DEEPEST`` deep."""
    open_boxes = [((), boxes(data, start, end))]
    while open_boxes:
        path, inside = open_boxes[-1]
        found = next(inside, None)
        if found is None:
            open_boxes.pop()
            continue
        kind, body, stop = found
        here = (*path, kind)
        yield here, body, stop
        if kind in CONTAINERS:
            if len(here) > DEEPEST:
                raise MalformedMedia("boxes nest too deep")
            open_boxes.append((here, boxes(data, body, stop)))


def _ints(data: memoryview, at: int, n: int, kind: str, end: int) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > end:
        raise MalformedMedia("a table is longer than its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


class Track:
    """The decoded sample tables of one track."""

    def __init__(self) -> None:
        self.codec, self.handler, self.timescale, self.duration = "", "", 0, 0
        self.sync: np.ndarray | None = None
        self.runs = self.durations = np.empty((0, 3), np.int64)
        self.chunks = self.sizes = np.empty(0, np.int64)

    def read(self, data: memoryview, kind: bytes, at: int, end: int) -> None:
        if kind == b"mdhd":
            form = ">2Q" if data[at] == 1 else ">2I"
            skip = struct.calcsize(form)
            self.timescale, self.duration = struct.unpack_from(">IQ" if data[at] == 1 else ">2I", data, at + 4 + skip)
        elif kind == b"hdlr":
            self.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd":
            self.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stss":
            self.sync = _ints(data, at + 8, self._count(data, at, end), ">u4", end)
        elif kind == b"stts":
            self.durations = _ints(data, at + 8, 2 * self._count(data, at, end), ">u4", end).reshape(-1, 2)
        elif kind == b"stsc":
            self.runs = _ints(data, at + 8, 3 * self._count(data, at, end), ">u4", end).reshape(-1, 3)
        elif kind == b"stsz":
            same, n = struct.unpack_from(">2I", data, at + 4)
            if same * n > len(data):
                raise MalformedMedia("samples that the file can't hold")
            self.sizes = np.full(n, same, np.int64) if same else _ints(data, at + 12, n, ">u4", end)
        elif kind == b"stz2":
            bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
            if bits == 4:
                both = _ints(data, at + 12, (n + 1) // 2, "u1", end)
                self.sizes = np.stack([both >> 4, both & 15], 1).ravel()[:n]
            else:
                self.sizes = _ints(data, at + 12, n, {8: "u1", 16: ">u2"}[bits], end)
        elif kind in (b"stco", b"co64"):
            self.chunks = _ints(data, at + 8, self._count(data, at, end), ">u4" if kind == b"stco" else ">u8", end)

    @staticmethod
    def _count(data: memoryview, at: int, end: int) -> int:
        if at + 8 > end:
            raise MalformedMedia("a table has no length")
        return struct.unpack_from(">I", data, at + 4)[0]

    def offsets(self) -> np.ndarray:
        """Place in the file of each sample: its chunk's, and what stands before it there."""
        n, m = len(self.sizes), len(self.chunks)
        if not n:
            return np.empty(0, np.int64)
        if not m or not len(self.runs) or self.runs[0, 0] != 1:
            raise MalformedMedia("samples without chunks")
        per = np.repeat(self.runs[:, 1], np.diff(np.append(np.minimum(self.runs[:, 0] - 1, m), m)).clip(0))
        if per.sum() < n:
            raise MalformedMedia("more samples than the chunks hold")
        per = np.diff(np.append(0, np.minimum(np.cumsum(per), n)))  # of the last chunks no more than there are samples
        chunk = np.repeat(np.arange(len(per)), per)
        before = np.cumsum(self.sizes) - self.sizes
        first = np.searchsorted(chunk, chunk)
        return self.chunks[chunk] + before - before[first]

    def keyframes(self) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and lengths of sync samples; every sample is one where no table says otherwise."""
        at = self.offsets()
        if self.sync is None:
            return at, self.sizes
        if len(self.sync) and not 1 <= self.sync.min() <= self.sync.max() <= len(at):
            raise MalformedMedia("a keyframe that is no sample")
        return at[self.sync - 1], self.sizes[self.sync - 1]


def tracks(media: bytes) -> list[Track]:
    found: list[Track] = []
    data = memoryview(media)
    try:
        for path, at, end in walk(data, 0, len(data)):
            if path[-1] == b"moof":
                raise MalformedMedia("samples in fragments are not read")
            if path[-1] == b"trak":
                found.append(Track())
            elif found and b"trak" in path:
                found[-1].read(data, path[-1], at, end)
    except (struct.error, IndexError, KeyError) as e:
        raise MalformedMedia(str(e)) from e
    return found


def stored_payload(media: bytes, track: Track) -> bytes:
    """A track's samples, read back in order."""
    at = track.offsets()
    if not len(at):
        return b""
    joined = np.flatnonzero(at[1:] != at[:-1] + track.sizes[:-1]) + 1
    first, last = np.append(0, joined), np.append(joined, len(at)) - 1
    return b"".join(media[at[i] : at[j] + track.sizes[j]] for i, j in zip(first, last, strict=True))


TRACK_TYPE = "array<struct<codec:string,handler:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<offset:long,length:long>>>>"


def _described(media: bytes | None) -> dict:
    if media is None:
        return {"tracks": [], "error": "null"}
    try:
        out = []
        for t in tracks(media):
            at, sizes = t.keyframes()
            out.append({"codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "keyframes": [{"offset": a, "length": n} for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]})
        return {"tracks": out, "error": None}
    except MalformedMedia as e:
        return {"tracks": [], "error": str(e)}


def track_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Replace column ``media`` by ``tracks`` and ``error``; other columns stay (but for ones of those names)."""
    rest = [c for c in df.columns if c.lower() not in (media.lower(), "tracks", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_described(x) for x in b.column(len(rest)).to_pylist()]
            found = pa.array([r["tracks"] for r in rows], _ARROW_TRACKS)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found, pa.array([r["error"] for r in rows], pa.string())], names=[*rest, "tracks", "error"])

    kept = df.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{media}`"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), f"tracks {TRACK_TYPE}", "error string"])
    return kept.mapInArrow(run, fields)


_ARROW_TRACKS = pa.list_(pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))]))


def encode_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): a container of each whole text, padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media = [], []
            for text in b.column(1).cast(pa.large_binary()):
                raw = text.as_py() or b""
                sizes.append(len(raw))
                media.append(encode(pad(raw)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_digests(media: DataFrame) -> DataFrame:
    """Digests of a table (doc_id, n_bytes, media), all from the stored bytes."""

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 6
        (t,) = tracks(raw)
        payload = stored_payload(raw, t)
        at, sizes = t.keyframes()
        ranges = ",".join(f"{a}+{n}" for a, n in zip(at.tolist(), sizes.tolist(), strict=True))
        told = f"{t.codec.strip()};{t.handler};{t.timescale};{t.duration};{len(t.sizes)};{len(at)};{ranges}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(raw), hashlib.sha256(raw).hexdigest(), told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(x.as_py()) for x in b.column(2)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=[f.split()[0] for f in DIGEST.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)
