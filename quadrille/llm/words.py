"""Words of whole texts as 64-bit hashes, and hashes of runs of words, for an Arrow batch at once.

A word is a longest run of bytes that are no separators.  Its hash is a polynomial
over random byte values, mixed; a run of words has a polynomial over its words' hashes,
mixed again.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE, RUN_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _byte_values(separators: np.ndarray, lower: bool) -> np.ndarray:
    values = np.random.default_rng(20_240).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    values[separators] = 0
    return values


def _set(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


@dataclass(frozen=True)
class Rule:
    """Which bytes part words, and what each other byte counts in the hash."""

    separators: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, lower: bool, *spans: tuple[int, int]) -> Rule:
        table = _set(*spans)
        return cls(table, _byte_values(table, lower))


#: Words between white space as they are, the same with A-Z lowered, and words of letters and digits with A-Z lowered.
PLAIN = Rule.of(False, (0x09, 0x0D), (0x20, 0x20))
LOWER = Rule.of(True, (0x09, 0x0D), (0x20, 0x20))
ALNUM = Rule.of(True, (0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
ALNUM.separators[65:91] = False
ALNUM.values[65:91] = ALNUM.values[97:123]


@dataclass
class Words:
    """Words of some texts: where each begins and ends, its hash, and the first word of each text (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(data: np.ndarray, off: np.ndarray, rule: Rule) -> Words:
    n = len(data)
    inside = ~rule.separators[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, off)
    if not len(start):
        return Words(start, end, np.empty(0, np.uint64), first)
    size = end - start
    power = powers(BASE, int(size.max()))
    place = np.arange(n) - np.repeat(np.append(0, start), np.diff(np.append(np.append(0, start), n)))
    np.minimum(place, len(power) - 1, out=place)
    value = rule.values[data]
    value *= power[place]
    return Words(start, end, mix(np.add.reduceat(value, start) + size.astype(np.uint64)), first)


def run_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of k words from each word on where a text has so many, and the first such of each text (one more at the end)."""
    n = np.maximum(words.counts - k + 1, 0)
    first = np.append(0, np.cumsum(n))
    at = np.repeat(words.first[:-1] - first[:-1], n) + np.arange(first[-1])
    return mix(_runs(words.hash, k)[at]) if len(at) else np.empty(0, np.uint64), first


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomials of k successive hashes, by doubling; the last k-1 are without meaning."""
    total, done, block, width, power = None, 0, h, 1, int(RUN_BASE)
    shifted = lambda x, s: np.concatenate([x[s:], np.zeros(min(s, len(x)), np.uint64)])
    scale, low = 1, (1 << 64) - 1
    while True:
        if k & width:
            part = shifted(block, done) * np.uint64(scale)
            total = part if total is None else total + part
            done += width
            scale = scale * power & low
        if width * 2 > k:
            return total
        block = block + shifted(block, width) * np.uint64(power)
        power, width = power * power & low, width * 2


def window_minima(h: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """For each w successive hashes within a text: the place of the least (the first of equals)."""
    n = np.maximum(np.diff(first) - w + 1, 0)
    bits = max(1, int(len(h)).bit_length())
    mask = np.uint64((1 << bits) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= w:
        key = np.minimum(key[: len(key) - width], key[width:]) if len(key) > width else key[:0]
        width *= 2
    if width < w:
        s = w - width
        key = np.minimum(key[: len(key) - s], key[s:]) if len(key) > s else key[:0]
    ends = np.append(0, np.cumsum(n))
    at = np.repeat(first[:-1] - ends[:-1], n) + np.arange(ends[-1])
    return (key[at] & mask).astype(np.int64)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Spans:
    """Hashes of runs of any length."""

    def __init__(self, h: np.ndarray) -> None:
        self.inverse = powers(np.uint64(pow(int(RUN_BASE), -1, 1 << 64)), len(h) + 1)
        self.total = np.append(np.uint64(0), np.cumsum(h * powers(RUN_BASE, len(h))[: len(h)], dtype=np.uint64))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of words start..end-1, with their number."""
        return mix(mix((self.total[end] - self.total[start]) * self.inverse[start]) + (end - start).astype(np.uint64))


def joined(data: np.ndarray, words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each text with one space between, and where each text begins (one more at the end)."""
    start, end = words.start[keep], words.end[keep]
    first = np.append(0, np.cumsum(keep))[words.first]
    size = end - start
    led = np.ones(len(size), np.int64)
    led[first[:-1][first[:-1] < first[1:]]] = 0
    at = np.append(0, np.cumsum(size + led))
    mark = np.zeros(len(data) + 1, np.int8)
    np.add.at(mark, start, 1) if len(start) < 64 else mark.__setitem__(start, 1)
    mark[end] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    out = np.full(int(at[-1]), 0x20, np.uint8)
    body = np.ones(len(out), bool)
    body[at[:-1][led > 0]] = False
    out[body] = data[inside]
    return out, at[first]
