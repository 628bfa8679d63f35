"""Language identification with hyperdimensional profiles.

Each code point has a random bipolar vector, drawn from its own seed.  A trigram's
vector is the product of its letters' vectors, rotated by their place; a text's
is the sum over its trigrams, and a language's the sum over its training texts.
Texts are compared with languages by cosine.

Defined results: null texts and those without a letter are ``und`` with score 0,
and so is everything if nothing could be learned; equal cosines go to the first
language by name; rows with null language aren't learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.arrow import giving_back
from quadrille.llm.storage import fresh, materialize

DIMENSIONS = 2048
UNKNOWN = "und"
PIECE = 1 << 21  # characters that are counted at once
CELLS = 1 << 22  # counts (texts x trigrams) that are held at once; texts of many scripts are counted in smaller runs
BLOCK = 1024  # trigrams whose vectors are held at once
RARE = 0.01  # share of training texts of a language and length that a floor is set without
PART = 0.33  # of the cosine that the others reach, the floor
ENOUGH = 100  # training texts that a floor is set from, at least
FEW = 1 << 20  # rejected rows that are broadcast by their hashes (8 MB)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 32 for what is no letter.

    Made by rule from Python's own tables.
    """
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(maxsize=4096)
def letter_vector(code: int, d: int) -> np.ndarray:
    return np.random.default_rng([code, d, 7]).integers(0, 2, d, dtype=np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, d: int) -> np.ndarray:
    """A row for each trigram, made anew each time: held ones would stay with a worker through all later stages (2 kB each)."""
    letters, at = np.unique(grams, return_inverse=True)
    table, at = np.stack([letter_vector(c, d) for c in letters.tolist()]), at.reshape(grams.shape)
    return np.roll(table, 2, 1)[at[:, 0]] * np.roll(table, 1, 1)[at[:, 1]] * table[at[:, 2]]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Trigrams (rows of three code points), and (text x trigram) counts; third, whether a text has a letter.

    Null if several texts have too many counts together.
    """
    joined = "".join(f"  {x} " for x in texts)
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.array([len(x) + 3 for x in texts])
    doc = np.repeat(np.arange(len(texts)), sizes)
    keep = (codes != 32) | (np.append(codes[1:], 0) != 32) | np.append(doc[1:] != doc[:-1], True)  # a run of spaces becomes one
    codes, doc = codes[keep], doc[keep]
    lettered = np.bincount(doc[codes != 32], minlength=len(texts)) > 0
    alphabet, small = np.unique(codes, return_inverse=True)
    n = len(alphabet)
    same = doc[2:] == doc[:-2]
    small = small.astype(np.int64)
    key, doc = ((small[:-2] * n + small[1:-1]) * n + small[2:])[same], doc[2:][same]
    if n**3 <= 1 << 22:
        seen = np.flatnonzero(np.bincount(key, minlength=n**3))
        place = np.zeros(n**3, np.int64)
        place[seen] = np.arange(len(seen))
        at = place[key]
    else:
        seen, at = np.unique(key, return_inverse=True)
    if len(texts) > 1 and len(texts) * len(seen) > CELLS:
        return None
    grams = np.stack([alphabet[seen // (n * n)], alphabet[seen // n % n], alphabet[seen % n]], 1)
    cell = doc.astype(np.int64) * len(seen) + at
    counts = np.bincount(cell, minlength=len(texts) * len(seen)).reshape(len(texts), len(seen)).astype(np.float32)
    return grams, counts, lettered


def bundled(counts: np.ndarray, grams: np.ndarray, d: int) -> np.ndarray:
    """Sums of trigrams' vectors, each as often as counted."""
    out = np.zeros((len(counts), d), counts.dtype)
    for k in range(0, len(grams), BLOCK):
        out += counts[:, k : k + BLOCK] @ gram_vectors(grams[k : k + BLOCK], d).astype(counts.dtype)
    return out


def counted(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, trigrams, counts, lettered) of runs of texts short enough to count together."""
    first, run, size, work = 0, [], 0, []
    for i, x in enumerate([*texts, None]):
        x = x or ""
        if run and (i == len(texts) or size + len(x) > PIECE or len(run) >= 512):
            work.append((first, run))
            first, run, size = i, [], 0
        run.append(x)
        size += len(x)
        while work:
            at, some = work.pop()
            found = gram_counts(some)
            if found is None:
                half = len(some) // 2
                work += [(at, some[:half]), (at + half, some[half:])]
            else:
                yield at, len(some), *found


def held_out(doc_id: int | None, folds: int = 5) -> bool:
    """Whether crc32 of the number as text leaves no remainder; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes from (text, lang), all rows.  To the driver come languages x dimensions numbers."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, n, grams, counts, _ in counted(texts):
                names = langs[first : first + n]
                kinds = sorted(set(names))
                sums = np.stack([counts[[i for i, x in enumerate(names) if x == lang]].sum(0, dtype=np.float64) for lang in kinds])
                for lang, v in zip(kinds, bundled(sums, grams, dimensions), strict=True):
                    total[lang] = total.get(lang, 0) + v
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions), pa.int32()), pa.array(np.asarray(v, np.float64))], names=["lang", "at", "x"])

    usable = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = usable.mapInArrow(run, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x")).toPandas()
    return {lang: part.sort_values("at")["x"].to_numpy() for lang, part in sums.groupby("lang") if np.any(part["x"])}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the closest language and its cosine (0 to 1); columns of those names are replaced."""
    names = sorted(prototypes)
    d = len(prototypes[names[0]]) if names else DIMENSIONS
    unit = np.stack([prototypes[x] / np.linalg.norm(prototypes[x]) for x in names]).astype(np.float32) if names else np.zeros((0, d), np.float32)
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (lang_col, score_col)))
    at = kept.columns.index("text")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for first, _, grams, counts, lettered in counted(texts) if names else ():
                vectors = bundled(counts, grams, d)
                cosine = vectors @ unit.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                best = cosine.argmax(1)
                for i in np.flatnonzero(lettered):
                    langs[first + i], scores[first + i] = names[best[i]], min(1.0, max(0.0, float(cosine[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*b.schema.names, lang_col, score_col])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"`{lang_col}` string", f"`{score_col}` double"])
    return kept.mapInArrow(run, fields)


def fold(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Add ``held_out``."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0)


def _like(characters: Column) -> Column:
    """Texts of equal number are of like length (within a factor of two)."""
    return F.length(F.bin(characters.cast("long")))


def scores(docs: DataFrame, prototypes: dict[str, np.ndarray], key: Column) -> DataFrame:
    """(k, doc_id, lang, like, lang_pred, score) of each row: what verdicts rest on, without texts."""
    rows = docs.select(key.alias("k"), "doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return identify(rows, prototypes).select("k", "doc_id", "lang", _like(F.length("text")).alias("like"), "lang_pred", "score")


def floors(scored: DataFrame) -> DataFrame:
    """(lang, low, high, floor): a part of the cosine that all but few training texts of a language and length reach.

    From rows of ``scores``, but for held-out ones.  Lengths from low to below high have a
    floor: that of their own texts, or where these are under ``ENOUGH``, that of the next
    shorter ones.  Texts shorter than all of these have none.
    """
    rows = fold(scored).where((F.col("lang_pred") != UNKNOWN) & F.col("lang").isNotNull() & ~F.col("held_out"))
    found = rows.groupBy(F.col("lang_pred").alias("lang"), F.col("like").alias("low")).agg(F.count("*").alias("n"), (F.percentile_approx("score", RARE) * PART).alias("floor"))
    return found.where(F.col("n") >= ENOUGH).select("lang", "low", F.expr("lead(low, 1, 64) over (partition by lang order by low)").alias("high"), "floor")


def judged(scored: DataFrame) -> DataFrame:
    """Add the verdict to rows of ``scores``: no letter, below floor, or kept.  Floors are at most languages x 64 rows."""
    at = floors(scored).withColumnRenamed("lang", "of")
    joined = scored.join(F.broadcast(at), (F.col("lang_pred") == F.col("of")) & (F.col("like") >= F.col("low")) & (F.col("like") < F.col("high")), "left")
    told = F.when(F.col("lang_pred") == UNKNOWN, "no letter").when(F.col("score") < F.col("floor"), "below floor").otherwise("kept")
    return joined.select(*scored.columns, told.alias("verdict"))


def accepted(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose verdict is kept.

    Scores are written, texts aren't.  Equal rows have equal verdicts, so rejected rows are known by a hash of id and text;
    up to ``FEW`` of these are broadcast, more are joined by a shuffle.
    """
    key, k = F.xxhash64("doc_id", "text"), fresh(docs, "_k")
    scored = materialize(scores(docs, prototypes, key), "language-scores")
    gone = materialize(judged(scored).where("verdict != 'kept'").select(F.col("k").alias(k)).distinct(), "language-rejected")
    if gone.count() <= FEW:
        gone = F.broadcast(gone)
    return docs.withColumn(k, key).join(gone, k, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
