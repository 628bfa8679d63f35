"""Token ids of whole texts with a tokenizer file of the tokenizers library.

For byte-level BPE files whose pre-tokenizer is the usual split into words, the
split is done for a whole Arrow batch at once, and the library encodes each
distinct word once; ids are those of encoding the text whole.  Texts with letters
outside the ranges that all Unicode versions agree on, or with a special token's
string, and all texts of other tokenizers, go to the library as they are.

Defined results: null is the empty text, whose ids are none.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quadrille.llm.arrow import chunks, flat, ranges

END_ID = 2
CACHED_WORDS = 3_000_000
ENCODED_AT_ONCE = 2 << 20

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Code points of Unicode's White_Space below U+2100.
WHITE = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}
#: The split's contractions.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + k for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point that the fast split knows; 0 for the others."""
    table = np.zeros(0x2070, np.uint8)
    for c in (*range(0x530), *range(0x2000, 0x2070)):
        kind = unicodedata.category(chr(c))[0]
        table[c] = SPACE if c in WHITE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    return table


def word_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a word begins at each byte; and at each text, whether the split knows all its characters."""
    table, n = _classes(), len(data)
    kind = table[:128][data & 127]
    kind[data >= 128] = 0
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        lead = data[high].astype(np.int64)
        tail = lambda k: data[np.minimum(high + k, n - 1)].astype(np.int64) & 63
        two = (lead & 31) << 6 | tail(1)
        three = (lead & 15) << 12 | tail(1) << 6 | tail(2)
        code = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, 0x10000))
        found = np.where(code < len(table), table[np.minimum(code, len(table) - 1)], 0)
        for k in range(4):
            here = lead >= (0, 0xC0, 0xE0, 0xF0)[k]
            kind[np.minimum(high[here] + k, n - 1)] = found[here]
    first = np.zeros(n + 1, bool)
    first[off] = True
    first = first[:n]
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # white space before a word: its last character stands alone, or leads the word if it is a blank
    after = np.flatnonzero(starts[1:] & ~first[1:] & (kind[:-1] == SPACE)) + 1
    if len(after):
        last = after - 1
        for _ in range(2):
            last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
        starts[last] = True
        starts[after[data[after - 1] == 0x20]] = False
    quotes = np.flatnonzero(starts[:-1] & (data[:-1] == 0x27) & (kind[1:] == LETTER) & ~first[1:])
    if len(quotes):
        one, two = data[quotes + 1], data[np.minimum(quotes + 2, n - 1)]
        inside = (quotes + 2 < n) & ~first[np.minimum(quotes + 2, n - 1)]
        size = np.zeros(len(quotes), np.int64)
        for c in CONTRACTIONS:
            size[(one == ord(c[0])) & (len(c) == 1 or inside & (two == ord(c[-1])))] = len(c) + 1
        quotes, size = quotes[size > 0], size[size > 0]
        starts[quotes + 1] = False
        rest = quotes + size
        rest = rest[rest < n]
        starts[rest[kind[rest] == LETTER]] = True
    unknown = np.flatnonzero(kind == 0)
    known = np.ones(len(off) - 1, bool)
    known[np.searchsorted(off, unknown, "right") - 1] = False
    return starts, known


class Encoder:
    """Encodes columns of text, and keeps ids of words it has seen; one for each Python worker."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        split = told.get("pre_tokenizer") or {}
        self.fast = split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True) and not told.get("normalizer") and told["model"]["type"] == "BPE"
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.ids, self.begins = array("I"), array("q", [0])

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among those known, new ones included."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        place = pc.index_in(words, value_set=self.known).to_numpy(zero_copy_only=False)
        new = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(words), bool)
        if new.any():
            unseen = words.filter(pa.array(new))
            tokenize = self.library.model.tokenize
            for w in unseen.to_pylist():
                self.ids.extend([t.id for t in tokenize(w.decode("latin-1").translate(BYTE_LETTERS))])
                self.begins.append(len(self.ids))
            place[new] = np.arange(len(self.known), len(self.known) + len(unseen))
            self.known = pa.concat_arrays([self.known, unseen])
        return place.astype(np.int64)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, offsets of each row's ids) for runs of rows."""
        marked = np.zeros(len(column), bool)
        for s in self.special:
            marked |= pc.fill_null(pc.match_substring(column, s), False).to_numpy(zero_copy_only=False)
        for i, j, data, off in chunks(column, ENCODED_AT_ONCE):
            slow = np.ones(j - i, bool)
            ids, at = np.empty(0, np.uint32), np.zeros(j - i + 1, np.int64)
            if self.fast and len(data):
                starts, known = word_starts(data, off)
                slow = ~known | marked[i:j]
                begin = np.flatnonzero(starts)
                words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
                place = self._words(words.dictionary)[words.indices.to_numpy()]
                begins, known_ids = np.frombuffer(self.begins, np.int64), np.frombuffer(self.ids, np.uint32)
                sizes = begins[place + 1] - begins[place]
                ids = known_ids[ranges(begins[place], sizes)]
                at = np.append(0, np.cumsum(sizes))[np.searchsorted(begin, off)]
                del begins, known_ids
            slow &= np.diff(off) > 0
            if slow.any():
                rows = np.flatnonzero(slow)
                encoded = dict(zip(rows.tolist(), self._whole([column[i + r].as_py() for r in rows.tolist()]), strict=True))
                parts = [encoded[r] if r in encoded else ids[at[r] : at[r + 1]] for r in range(j - i)]
                ids, at = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
            yield i, j, ids, at


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, at: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` after each row."""
    n = len(at) - 1
    out = np.full(len(ids) + n, end, "<u4")
    keep = np.ones(len(out), bool)
    keep[at[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, at + np.arange(n + 1)


__all__ = ["END_ID", "Encoder", "encoder", "flat", "tokenizer_path", "with_end", "word_starts"]
