"""Secret scans: fixed base patterns, and probabilistic automata inferred from labelled credentials.

A prefix tree of the labelled credentials is folded up: states merge, in the red-blue
order, if a Hoeffding bound finds their outgoing and ending frequencies alike, and so
do the states below them.  Letters stand for themselves while a format's constant head
lasts, then for their class.  Each run of credential letters is a candidate, and so are its parts between = / . and :
where the run itself is none.  It is a secret if the automaton of some kind finds it far likelier per letter than the model of
ordinary words does, and as likely as the credentials it was made from.

Defined results: null is the empty text, which has no spans; without credentials to
learn from, or in an empty table, nothing is added; spans that touch a base span aren't added; of equally likely kinds the
last by name; repeated rows have equal spans; very long texts are read whole (words of more than ``LEARNED_LENGTH`` letters are
scored, but not learned from); a column named like the output is replaced, whatever its case.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.arrow import giving_back
from quadrille.llm.spans import LeastByHash, Span, apart, least_by_hash, ordered, with_spans

KINDS = ("assign", "access", "hex")
SAMPLE = 600  # credentials of a kind, and ordinary words, that are learned from
SIGNIFICANCE = 0.02
LEARNED_LENGTH = 200  # letters of what is learned from, at most
HEAD = 4  # letters that stand for themselves at most
LEAST = 12  # letters of a candidate, as of the shortest credential
MARGIN = 0.5  # nats a letter by which a secret is likelier than an ordinary word

#: The base patterns and the least length of what they must hold.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=:-]{12,}")
PARTS = re.compile(r"[^=/.:]+")
ORDINARY = re.compile(r"[A-Za-z0-9+/_.=-]{3,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
WORDS_OF_ASSIGN = ("passw", "secret", "token", "api")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18


def _table(letters: str) -> bytes:
    return bytes(120 if chr(c) in letters else 32 for c in range(256))


_HEX_TABLE = _table("0123456789abcdef")
_CREDENTIAL_TABLE = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=:-")


def base_matches(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the matches that pass."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    if b"x" * 16 in text.encode("utf-8", "surrogatepass").translate(_HEX_TABLE):
        found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return found


def base_spans(text: str) -> list[Span]:
    return ordered([(kind, a, b, True) for kind, a, b, _ in base_matches(text)], KINDS)


def letter_class(c: str) -> str:
    return "0" if c.isdigit() else "a" if "a" <= c <= "f" else "g" if c.islower() else "A" if c.isupper() else c


def symbols(word: str, head: int) -> list[str]:
    return [*(f"={c}" for c in word[:head]), *map(letter_class, word[head:])]


def constant_head(words: list[str]) -> int:
    """Letters that nearly all the words begin with."""
    for n in range(HEAD, 0, -1):
        if words and Counter(w[:n] for w in words).most_common(1)[0][1] >= 0.9 * len(words):
            return n
    return 0


@dataclass
class State:
    visits: int = 0
    ends: int = 0
    moves: dict[str, int] = field(default_factory=dict)  # symbol -> state
    counts: Counter = field(default_factory=Counter)


def differ(hits: int, of: int, others: int, among: int, significance: float = SIGNIFICANCE) -> bool:
    """Hoeffding's bound on two frequencies."""
    if not of or not among:
        return False
    bound = math.sqrt(0.5 * math.log(2 / significance)) * (1 / math.sqrt(of) + 1 / math.sqrt(among))
    return abs(hits / of - others / among) > bound


class Automaton:
    """A probabilistic automaton over symbols; state 0 begins."""

    def __init__(self) -> None:
        self.states = [State()]
        self.head, self.alphabet, self.floor = 0, 1, 0.0

    def add(self, word: list[str]) -> None:
        at = 0
        for c in word:
            s = self.states[at]
            s.visits += 1
            s.counts[c] += 1
            if c not in s.moves:
                s.moves[c] = len(self.states)
                self.states.append(State())
            at = s.moves[c]
        self.states[at].visits += 1
        self.states[at].ends += 1

    def alike(self, p: int, q: int) -> bool:
        """Whether the states and all that follows them are compatible."""
        work = [(p, q)]
        while work:
            p, q = work.pop()
            a, b = self.states[p], self.states[q]
            if differ(a.ends, a.visits, b.ends, b.visits) or any(differ(a.counts[c], a.visits, b.counts[c], b.visits) for c in a.counts.keys() | b.counts.keys()):
                return False
            work += [(a.moves[c], b.moves[c]) for c in a.moves.keys() & b.moves.keys()]
        return True

    def fold(self, p: int, q: int) -> None:
        """Add the tree below q to p and what follows it."""
        work = [(p, q)]
        while work:
            p, q = work.pop()
            a, b = self.states[p], self.states[q]
            a.visits += b.visits
            a.ends += b.ends
            a.counts.update(b.counts)
            for c, to in b.moves.items():
                if c in a.moves:
                    work.append((a.moves[c], to))
                else:
                    a.moves[c] = to

    def generalize(self) -> None:
        """Merge states in the red-blue order."""
        red, blue = [0], [(0, c) for c in sorted(self.states[0].moves)]
        while blue:
            parent, c = blue.pop(0)
            q = self.states[parent].moves[c]
            if q in red:
                continue
            into = next((p for p in red if self.alike(p, q)), None)
            if into is None:
                red.append(q)
                blue += [(q, x) for x in sorted(self.states[q].moves)]
            else:
                self.states[parent].moves[c] = into
                self.fold(into, q)
                blue += [(p, x) for p in red for x in sorted(self.states[p].moves) if self.states[p].moves[x] not in red and (p, x) not in blue]

    def likelihood(self, word: str) -> float:
        """Mean log probability a letter, the end included; unseen moves have a small share."""
        at, total = 0, 0.0
        told = symbols(word, self.head)
        for c in told:
            s = self.states[at]
            total += math.log((s.counts[c] + 0.02) / (s.visits + 0.02 * (self.alphabet + 1)))
            if c not in s.moves:
                return -20.0
            at = s.moves[c]
        s = self.states[at]
        return (total + math.log((s.ends + 0.02) / (s.visits + 0.02 * (self.alphabet + 1)))) / (len(told) + 1)


def infer(words: list[str]) -> Automaton:
    a = Automaton()
    a.head = constant_head(words)
    told = [symbols(w, a.head) for w in words]
    a.alphabet = len({c for w in told for c in w}) or 1
    for w in told:
        a.add(w)
    a.generalize()
    fits = sorted(a.likelihood(w) for w in words)
    a.floor = fits[len(fits) // 20] if fits else 0.0
    return a


class Ordinary:
    """Pairs of letter classes in words that are no credentials."""

    def __init__(self, words: list[str]) -> None:
        self.pairs: Counter = Counter()
        self.firsts: Counter = Counter()
        for w in words:
            told = ["^", *map(letter_class, w), "$"]
            self.pairs.update(zip(told, told[1:], strict=False))
            self.firsts.update(told[:-1])

    def likelihood(self, word: str) -> float:
        told = ["^", *map(letter_class, word), "$"]
        return sum(math.log((self.pairs[x] + 0.5) / (self.firsts[x[0]] + 6.0)) for x in zip(told, told[1:], strict=False)) / (len(told) - 1)


@dataclass
class Model:
    automata: dict[str, Automaton]
    ordinary: Ordinary

    def kind_of(self, word: str) -> str | None:
        best = max(((a.likelihood(word) - max(a.floor, self.ordinary.likelihood(word) + MARGIN), k) for k, a in self.automata.items()), default=(-1.0, ""))
        return best[1] if best[0] >= 0 else None


def candidates(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Runs of credential letters that hold both a digit and a letter: each run, then its parts."""
    if b"x" * LEAST not in text.encode("utf-8", "surrogatepass").translate(_CREDENTIAL_TABLE):
        return
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if not (DIGIT.search(run) and LETTER.search(run)):
            continue
        both = [(m.start() + x.start(), x[0]) for x in [re.match(r".*", run), *PARTS.finditer(run)]]
        out = []
        for at, word in both:
            inner = word.strip(".=-_/+:")
            if len(inner) >= LEAST and DIGIT.search(inner) and LETTER.search(inner):
                start = at + word.index(inner)
                if not out or (start, inner) != (out[0][0], out[0][2]):
                    out.append((start, start + len(inner), inner))
        if out:
            yield out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Automata from at most ``sample`` credentials of each kind and as many ordinary words of all texts, the least by a hash."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: LeastByHash(sample) for k in (*KINDS, "ordinary")}
        for b in batches:
            for x in b.column(0).to_pylist():
                found = base_matches(x)
                for kind, _, _, word in found:
                    if len(word) <= LEARNED_LENGTH:
                        held[kind].offer([word])
                plain = ORDINARY.findall(x)
                if found:
                    plain = [w for w in plain if not any(w in c or c in w for *_, c in found)]
                held["ordinary"].offer(w for w in plain if len(w) <= LEARNED_LENGTH)
        rows = [(kind, word) for kind, some in held.items() for word in some.trim()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string()), pa.array([held[k].held[w] for k, w in rows], pa.int64())], names=["kind", "word", "h"])

    words = least_by_hash(docs.select("text").where("text is not null").mapInArrow(run, "kind string, word string, h long"), sample)
    return Model({k: infer(words[k]) for k in KINDS if k in words}, Ordinary(words.get("ordinary", [])))


def finder(model: Model):
    """All spans of a text: the base ones, and what the automata add."""

    def find(text: str) -> list[Span]:
        base = base_spans(text)
        added: list[Span] = []
        for run in candidates(text) if model.automata else ():
            for a, b, word in run:
                if apart(a, b, base) and (kind := model.kind_of(word)):
                    added.append((kind, a, b, False))
                    if (a, b, word) == run[0]:
                        break
        return ordered([*base, *added], KINDS)

    return find


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Add ``spans`` to the rows."""
    return with_spans(docs, finder(model or learn(docs)))
