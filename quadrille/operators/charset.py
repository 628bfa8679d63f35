"""Which codec the bytes of a text are in: state checks, then how bytes pair in each codec.

A codec that can't decode the whole of the bytes is out.  Of those left, each has a share of its non-ASCII units that are where running text
in it has them: characters of everyday use in the two-byte codecs (both put these first in their tables), letters within words in the
one-byte ones, tone marks on vowels in Vietnamese.

Defined results: bytes in ASCII alone, and none at all, are ``ascii`` with confidence 1; null stays null; where no codec is surer than the
bound, the name is ``utf-8`` with the confidence of the best one; ties go to the codec listed first; whole texts are looked at, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: What is surer than this counts, and what is said otherwise.
SURE = 0.7
OTHERWISE = "utf-8"
#: Marks at the beginning, longest first.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
ASCII_OR_UNIT = re.compile(rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x00-\xff]")
HIGH = re.compile(rb"[\x80-\xff]+")
#: Letters and points of the one-byte codecs; text in them has few side by side.
LETTERS_POINTS = re.compile(rb"[\xc0-\xff\x8a\x8c\x8e\x9a\x9c\x9e\x9f\x80\x82\x84\x85\x91-\x97\xa0\xa1\xa3\xa7\xa9\xab\xae\xb0-\xb7\xbb\xbf]{1,3}")
#: In windows-1258: tone marks after a vowel, and letters that Vietnamese alone has.
TONE = rb"[AEIOUYaeiouy\xc2\xc3\xca\xd4\xd5\xdd\xe2\xe3\xea\xf4\xf5\xfd][\xcc\xd2\xde\xec\xf2]"
TONED = re.compile(TONE + rb"|[\xd0\xf0\xc3\xe3\xd5\xf5\xdd\xfd]")
TONES = re.compile(TONE)
VIETNAMESE_LEAST = 0.2
HIGH_SECONDS = 0.2


def _decodes(raw: bytes, codec: str) -> bool:
    try:
        raw.decode(codec)
    except UnicodeDecodeError:
        return False
    return True


def _units(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and second bytes of the two-byte units, read in step from the beginning."""
    pairs = np.frombuffer(b"".join(x for x in ASCII_OR_UNIT.findall(raw) if len(x) == 2), np.uint8)
    return pairs[::2], pairs[1::2]


def _two_byte(raw: bytes) -> dict[str, float]:
    first, second = _units(raw)
    if not len(first):
        return {}
    big5 = ((first >= 0xA4) & (first <= 0xC6)) | ((first >= 0xA1) & (first <= 0xA3))
    likely = 1.0 if float(np.mean(second >= 0x80)) >= HIGH_SECONDS else 0.5  # else it looks like accented letters before plain ones
    gb = ((first >= 0xB0) & (first <= 0xD7) | (first >= 0xA1) & (first <= 0xA3)) & (second >= 0xA1)
    out = {}
    # Half of Big5's second bytes lie where a text in GB 2312 has none, and the reverse holds for first bytes beyond its everyday part.
    if _decodes(raw, "cp950"):
        out["big5"] = likely * (float(np.mean(big5)) - 0.5 * float(np.mean(gb & ~big5)))
    if _decodes(raw, "gbk"):
        out["gb2312" if _decodes(raw, "gb2312") else "gbk"] = likely * float(np.mean(gb))
    return out


def _one_byte(raw: bytes) -> dict[str, float]:
    runs = HIGH.findall(raw)
    high = sum(map(len, runs))
    fits = sum(len(x) for x in runs if LETTERS_POINTS.fullmatch(x))
    out = {}
    vietnamese = sum(sum(b >= 0x80 for b in x) for x in TONED.findall(raw)) / high
    if _decodes(raw, "cp1258") and len(TONES.findall(raw)) / high >= VIETNAMESE_LEAST:
        out["windows-1258"] = 0.96 + 0.04 * min(1.0, vietnamese)
    name = "windows-1252" if re.search(rb"[\x80-\x9f]", raw) else "iso-8859-1"
    if name == "iso-8859-1" or _decodes(raw, "cp1252"):
        out[name] = 0.95 * fits / high
    return out


def guess(raw: bytes | None) -> tuple[str | None, float | None]:
    """(codec, confidence) of a text's bytes."""
    if raw is None:
        return None, None
    for mark, name in MARKS:
        if raw.startswith(mark) and _decodes(raw, name):
            return name, 1.0
    if raw.isascii():
        return "ascii", 1.0
    if _decodes(raw, "utf-8"):
        return "utf-8", 1 - 0.5 ** sum(map(len, HIGH.findall(raw)))
    found = _two_byte(raw) | _one_byte(raw)
    name = max(found, key=found.get, default=OTHERWISE)
    sure = max(0.0, found.get(name, 0.0))
    return (name if sure > SURE else OTHERWISE), sure


def guessed(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with codec and confidence in the place of its bytes, by Arrow batches."""
    kept = [f for f in files.schema.fields if f.name != content]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["codec string", "confidence double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = [guess(None if x is None else bytes(x)) for x in b[content]]
            yield b[[f.name for f in kept]].assign(codec=[n for n, _ in told], confidence=[c for _, c in told])

    return files.mapInPandas(run, schema)
