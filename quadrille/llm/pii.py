"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate spans (up to ``LONGEST`` tokens) by features of the
span, and dynamic programming chooses boundaries and kinds together.  It learns from a
bounded sample of stretches that the base patterns have labelled.  A candidate
holds a digit or an @ and reaches at most ``AROUND`` tokens and ``SCOPE`` characters beyond the first and the last of
them in its stretch: longer spans aren't candidates.  Stretches of a text don't overlap, so its best labelling is that of its stretches.

Defined results: null is the empty text, which has no spans; without anything to learn
from, or in an empty table, nothing is added; spans that touch a base span aren't added; of equally good labellings the first found;
repeated rows have equal spans; very long texts are read whole (stretches of more than ``LEARNED_LENGTH`` characters are labelled, but not
learned from); a column named like the output is replaced, whatever its case.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.spans import LeastByHash, Span, least_by_hash, ordered, with_spans

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16  # tokens in a span
AROUND = 6  # tokens of a stretch before and after what makes it one
SAMPLE = 240  # stretches that the field learns from
LEARNED_LENGTH = 600  # characters of a stretch that is learned from, at most
EPOCHS = 10
FRAME = 4096  # tokens whose candidates are held at once
KIND = np.arange(len(KINDS))

#: The base patterns.  An address is looked for from its @, numbers from the start of a run of digits.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_LETTERS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end(), True))
            done = m.end()
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(y) <= 3 and int(y or 0) <= 255 for y in (x.lstrip("0") for x in m[0].split("."))):
                found.append(("ip", *m.span(), True))
        for m in CARD.finditer(text):
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                found.append(("card", *m.span(), True))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(digits_of(m[0])) <= 15:
                found.append(("phone", *m.span(), True))
    return ordered(found, KINDS)


TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.DOTALL)
TRIGGER = re.compile(r"[0-9]+|@")
TRIGGERS = frozenset("0123456789@")
SCOPE = 160  # characters beside a trigger that tokens are taken from


def stretches(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(place in the text, tokens as rows of start and end) of each part around digits and @."""
    parts: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - SCOPE), min(len(text), m.end() + SCOPE)
        if parts and a <= parts[-1][1]:
            parts[-1][1] = b
        else:
            parts.append([a, b])
    for a, b in parts:
        tokens = np.fromiter((x for m in TOKEN.finditer(text, a, b) for x in m.span()), np.int64).reshape(-1, 2)
        hot = np.flatnonzero([text[x] in TRIGGERS for x in tokens[:, 0].tolist()])
        if len(hot):
            low, high = max(0, int(hot[0]) - AROUND), min(len(tokens), int(hot[-1]) + AROUND + 1)
            yield a, tokens[low:high]


FEATURES = (
    "one", "at", "dots1", "dots2", "dots3", "dots4", "digits1-3", "digits4-6", "digits7-9", "digits10-13", "digits14-19", "digits20",
    "groups1", "groups2", "groups3", "groups4", "groups5", "plus", "bracket", "starts digit", "starts letter", "ends digit", "ends letter",
    "blank", "hyphen", "letters", "luhn", "bytes", "cut left", "cut right", "other", "tokens", "domain", "underscore",
)


DOMAIN_AT_END = re.compile(r"@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+\Z")


def _doubled(d: np.ndarray) -> np.ndarray:
    return np.where(d < 5, 2 * d, 2 * d - 9)


class Lattice:
    """The candidate spans of a stretch that end behind token ``low``, by where they end, and their features.

    Features are differences of running sums over tokens, so that a span costs the same however long it is.
    """

    def __init__(self, text: str, tokens: np.ndarray, low: int = 0) -> None:
        self.text, self.n, self.tokens = text, len(tokens), np.asarray(tokens, np.int64).reshape(-1, 2)
        tokens = self.tokens
        start, end = tokens[:, 0], tokens[:, 1]
        words = [text[a:b] for a, b in tokens.tolist()]
        lead, last = [w[0] for w in words], [w[-1] for w in words]

        def marks(of, some: list[str] = lead) -> np.ndarray:
            return np.fromiter((of(x) for x in some), bool, self.n)

        def summed(marks: np.ndarray) -> np.ndarray:
            return np.append(0, np.cumsum(marks, dtype=np.int64))

        digit = marks(lambda c: "0" <= c <= "9")
        newline = summed(marks("\n".__eq__))
        edge = marks(frozenset(" \t\r\n,;:!?\"'").__contains__)
        hot = summed(digit | marks("@".__eq__))
        j = np.repeat(np.arange(low + 1, self.n + 1), LONGEST)
        i = j - np.tile(np.arange(LONGEST, 0, -1), self.n - low)
        ok = i >= 0
        i, j = i[ok], j[ok]
        ok = ~edge[i] & ~edge[j - 1] & (hot[j] > hot[i]) & (newline[j] == newline[i])
        i, j = i[ok], j[ok]
        self.start, self.end = i, j
        self.at = np.searchsorted(j, np.arange(self.n + 2))
        by_start = np.argsort(i, kind="stable")
        first = np.searchsorted(i[by_start], np.arange(self.n + 1))
        self._starting = by_start, first

        count = lambda sums: sums[j] - sums[i]
        signs = {c: summed(marks(c.__eq__)) for c in "@. -_"}
        size = end - start
        digits = np.append(0, np.cumsum(np.where(digit, size, 0)))
        n, dots, groups, at_signs = count(digits), count(signs["."]), count(summed(digit)), count(signs["@"])
        letters = count(summed(marks(lambda w: any(c.isalpha() for c in w), words))) > 0
        each = np.frombuffer("".join(w for w, d in zip(words, digit.tolist(), strict=True) if d).encode(), np.uint8).astype(np.int64) - 48
        turn = np.arange(len(each)) & 1
        sums = [np.append(0, np.cumsum(np.where(turn == k, each, _doubled(each)))) for k in (0, 1)]
        p, q = digits[i], digits[j]
        odd = (q - 1) & 1
        luhn_ok = np.where(odd == 1, sums[1][q] - sums[1][p], sums[0][q] - sums[0][p]) % 10 == 0
        small = digit & (size < 4) & np.fromiter((len(w) < 4 and d and int(w) < 256 for w, d in zip(words, digit.tolist(), strict=True)), bool, self.n)
        bytes_ = (j - i == 7) & (dots == 3) & (groups == 4) & digit[i] & (count(summed(small)) == 4)
        before = np.fromiter((a > 0 and (text[a - 1].isalnum() or text[a - 1] in "@.+") for a in start.tolist()), bool, self.n)
        after = np.fromiter((b < len(text) and (text[b].isalnum() or text[b] == "@") for b in end.tolist()), bool, self.n)
        other = count(summed(marks(frozenset("\n\t,;:!?\"'/").__contains__))) > 0
        domain = np.zeros(len(i), bool)
        for k in np.flatnonzero((at_signs > 0) & (dots > 0)).tolist():
            domain[k] = DOMAIN_AT_END.search(text, int(start[i[k]]), int(end[j[k] - 1])) is not None
        of_lead = lambda of: marks(of)[i]
        of_last = lambda of: marks(of, last)[j - 1]
        told = (
            np.ones(len(i), bool), (at_signs == 1) & ~of_lead("@".__eq__) & ~of_last("@".__eq__), dots == 1, dots == 2, dots == 3, dots > 3, (n >= 1) & (n <= 3), (n >= 4) & (n <= 6), (n >= 7) & (n <= 9), (n >= 10) & (n <= 13), (n >= 14) & (n <= 19), n > 19,
            groups == 1, groups == 2, groups == 3, groups == 4, groups > 4, of_lead("+".__eq__), of_lead("(".__eq__), of_lead(str.isdigit), of_lead(str.isalpha), of_last(str.isdigit), of_last(str.isalpha),
            count(signs[" "]) > 0, count(signs["-"]) > 0, letters, (n >= 14) & (n <= 19) & ~letters & luhn_ok, bytes_, before[i], after[j - 1], other, end[j - 1] - start[i] > 8, domain, count(signs["_"]) > 0,
        )
        self.x = np.stack(told, 1).astype(np.float64)

    @property
    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.start.tolist(), self.end.tolist(), strict=True))

    def ending(self, j: int) -> np.ndarray:
        return np.arange(self.at[j], self.at[j + 1])

    def starting(self, i: int) -> np.ndarray:
        by_start, first = self._starting
        return by_start[first[i] : first[i + 1] if i < self.n else len(by_start)]


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True, initial=-1e30)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Field:
    """Weights of features by kind, and of kinds that follow each other (0 is no entity)."""

    def __init__(self) -> None:
        self.weights = np.zeros((len(FEATURES), len(KINDS)))
        self.follows = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def forward(self, lattice: Lattice, score: np.ndarray, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Of each place the sum (or the best) of all ways there by kind, and of those on into each kind."""
        over = np.max if best else _sum
        alpha, reach = np.full((lattice.n + 1, len(KINDS) + 1), -1e30), np.zeros((lattice.n + 1, len(KINDS)))
        alpha[0, 0] = 0.0
        for j in range(lattice.n + 1):
            if j:
                alpha[j, 0] = over(alpha[j - 1] + self.follows[:, 0], 0)
                at = lattice.ending(j)
                if len(at):
                    alpha[j, 1:] = over(reach[lattice.start[at]] + score[at], 0)
            reach[j] = over(alpha[j][:, None] + self.follows[:, 1:], 0)
        return alpha, reach

    def backward(self, lattice: Lattice, score: np.ndarray) -> np.ndarray:
        beta = np.full((lattice.n + 1, len(KINDS) + 1), -1e30)
        beta[lattice.n] = 0.0
        for i in range(lattice.n - 1, -1, -1):
            ways = [(self.follows[:, 0] + beta[i + 1, 0])[:, None]]
            at = lattice.starting(i)
            if len(at):
                inside = _sum(score[at] + beta[lattice.end[at], 1:], 0)
                ways.append(self.follows[:, 1:] + inside[None, :])
            beta[i] = _sum(np.concatenate(ways, 1), 1)
        return beta

    def learn(self, lattices: list[Lattice], gold: list[dict[int, int]], epochs: int = EPOCHS, rate: float = 0.5, shrink: float = 0.002) -> None:
        """Ascend the likelihood of the labelled spans (number of span -> kind), adapting each weight's step."""
        seen = np.full(self.weights.shape, 1e-6)
        for _ in range(epochs):
            for lattice, right in zip(lattices, gold, strict=True):
                if not len(lattice.x):
                    continue
                score = lattice.x @ self.weights
                (alpha, reach), beta = self.forward(lattice, score), self.backward(lattice, score)
                whole = _sum(alpha[lattice.n], 0)
                p = np.exp(np.minimum(reach[lattice.start] + score + beta[lattice.end, 1:] - whole, 0.0))
                for span, kind in right.items():
                    p[span, kind] -= 1.0
                slope = -(lattice.x.T @ p) - shrink * self.weights
                seen += slope * slope
                self.weights += rate * slope / np.sqrt(seen)

    def decode(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        return self.label(lattice.text, lattice.tokens)

    def label(self, text: str, tokens: np.ndarray, frame: int = FRAME) -> list[tuple[int, int, int]]:
        """(first token, token after the last, kind) of the best labelling.

        Candidates are scored for ``frame`` tokens at a time; what stays of a token is how each kind that ends there came about.
        """
        n, k = len(tokens), len(KINDS) + 1
        alpha = np.full((LONGEST, k), -1e30)  # of the last tokens
        alpha[-1, 0] = 0.0
        came = np.zeros((n + 1, k, 2), np.int8)  # tokens of the span, and the kind before
        for low in range(0, n, frame):
            begin = max(0, low - LONGEST)
            lattice = Lattice(text, tokens[begin : low + frame], low - begin)
            score, first = lattice.x @ self.weights, lattice.start + (LONGEST - (low - begin))
            size = lattice.n - (low - begin)
            alpha = np.concatenate([alpha[-LONGEST:], np.full((size, k), -1e30)])  # row r is token low - LONGEST + r
            ways = alpha[:LONGEST, :, None] + self.follows[None, :, 1:]
            reach, via = np.concatenate([ways.max(1), np.zeros((size, k - 1))]), np.concatenate([ways.argmax(1), np.zeros((size, k - 1), np.int64)])
            borders = lattice.at.tolist()
            for r in range(LONGEST, LONGEST + size):
                j = r - LONGEST + low - begin + 1  # place behind the token, in the lattice
                into, here = alpha[r - 1] + self.follows[:, 0], came[low + r - LONGEST + 1]
                best = int(into.argmax())
                alpha[r, 0], here[0] = into[best], (1, best)
                x, y = borders[j], borders[j + 1]
                if x < y:
                    at = first[x:y] - 1
                    total = reach[at] + score[x:y]
                    which = total.argmax(0)
                    alpha[r, 1:] = total[which, KIND]
                    here[1:, 0] = r - at[which]
                    here[1:, 1] = via[at[which], KIND]
                ways = alpha[r][:, None] + self.follows[:, 1:]
                via[r] = ways.argmax(0)
                reach[r] = ways[via[r], KIND]
        j, y, found = n, int(alpha[-1].argmax()), []
        while j:
            size, before = came[j, y].tolist()
            if y:
                found.append((j - size, j, y - 1))
            j, y = j - size, before
        return found[::-1]


def labelled(text: str) -> list[tuple[Lattice, dict[int, int]]]:
    """Each stretch with the base spans that are among its candidates."""
    base, out = base_spans(text), []
    for _, tokens in stretches(text):
        lattice = Lattice(text, tokens)
        place = {(int(tokens[i, 0]), int(tokens[j - 1, 1])): k for k, (i, j) in enumerate(lattice.spans)}
        right, end = {}, 0
        for kind, a, b, _ in base:
            if (a, b) in place and a >= end:
                right[place[a, b]], end = KINDS.index(kind), b
        out.append((lattice, right))
    return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from at most ``sample`` stretches, the least by a hash of their text, half of them with base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: LeastByHash(sample // 2) for k in ("marked", "plain")}
        for b in batches:
            for x in b.column(0).to_pylist():
                base = base_spans(x)
                for _, tokens in stretches(x):
                    a, z = int(tokens[0, 0]), int(tokens[-1, 1])
                    if z - a <= LEARNED_LENGTH:
                        held["marked" if any(s[1] >= a and s[2] <= z for s in base) else "plain"].offer([x[a:z]])
        rows = [(kind, word) for kind, some in held.items() for word in some.trim()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string()), pa.array([held[k].held[w] for k, w in rows], pa.int64())], names=["kind", "word", "h"])

    words = least_by_hash(docs.select("text").where("text rlike '[0-9@]'").mapInArrow(run, "kind string, word string, h long"), sample // 2)
    rows = [*words.get("marked", []), *words.get("plain", [])]
    both = [x for part in rows for x in labelled(part)]
    field = Field()
    field.learn([x for x, _ in both], [x for _, x in both])
    return field


def merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans, in order of start, cover together."""
    starts, ends = [], []
    for _, a, z, _ in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], z)
        else:
            starts.append(a)
            ends.append(z)
    return starts, ends


def finder(field: Field):
    """All spans of a text: the base ones, and what the field adds."""

    def find(text: str) -> list[Span]:
        base = base_spans(text)
        if not field.weights.any() or not TRIGGER.search(text):
            return base
        added: list[Span] = []
        starts, ends = merged(base)
        for _, tokens in stretches(text):
            for i, j, kind in field.label(text, tokens):
                a, z = int(tokens[i, 0]), int(tokens[j - 1, 1])
                k = bisect_right(ends, a)
                if k == len(starts) or z <= starts[k]:
                    added.append((KINDS[kind], a, z, False))
        return ordered([*base, *added], KINDS)

    return find


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Add ``spans`` to the rows."""
    return with_spans(docs, finder(field or learn(docs)))
