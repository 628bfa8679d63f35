"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents of one length are alike, so an island works on its histogram of
lengths: a gene is a bin (the lengths in it) and how many such bins there are.
Crossover injects whole well-filled bins of one parent, drops the other's bins
that hold documents which are placed already, and best-fits the displaced.
Islands share out the documents evenly, whatever their lengths; between epochs the
best bins of each island go to the next one as genes.  At the end every island gives up its
emptiest bins, and what was in them is packed again in islands of their own, so that many islands
waste no more than one.  Pieces of full length need no company and are sequences as they are.

Defined results: a null text is empty, and its only id is the end id; repeated rows
are packed one by one; pieces of equal length are dealt in order of doc_id and piece; very long texts are cut;
other columns, whatever their names, are passed by; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quadrille.llm.arrow import giving_back, ranges
from quadrille.llm.storage import materialize
from quadrille.llm.tokens import encoder, tokenizer_path, with_end

CAPACITY = 1024
ISLAND_DOCUMENTS = 4_000
POPULATION, GENERATIONS, EPOCHS, ELITES = 6, 24, 3, 64
SPREAD = 4096  # most tasks that share out the islands
GIVEN_UP = 20  # one in so many of an island's bins, the emptiest ones, is packed again with those of other islands

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"

Bins = Counter  # lengths in falling order -> how many such bins


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of each piece: full ones, and before them what is left over."""
    left = lengths % capacity
    pieces = lengths // capacity + (left > 0)
    row = np.repeat(np.arange(len(lengths)), pieces)
    k = ranges(np.zeros(len(lengths), np.int64), pieces)
    shift = np.where(left[row] > 0, left[row] - capacity, 0)
    start = np.maximum(k * capacity + shift, 0)
    return row, start, np.minimum((k + 1) * capacity + shift, lengths[row]) - start


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of each document's ids (end id included); ``spread`` is an even number to deal them out by."""
    path = tokenizer or tokenizer_path()

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        count = (context.partitionId() if context else 0) * 0x9E3779B1
        for b in batches:
            for i, j, ids, at in encoder(path).encode(b.column(1)):
                ids, at = with_end(ids, at)
                row, start, size = cut(np.diff(at), capacity)
                view, begin = memoryview(ids).cast("B"), at[row] + start
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
                piece = np.arange(len(row)) - np.searchsorted(row, row)
                spread = count + np.arange(len(row))
                count += len(row)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(spread, pa.int64())], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(counts: Counter, bins: Bins, capacity: int) -> Bins:
    """Put documents (length -> how many), longest first, where least room is left; open bins for the rest."""
    room: dict[int, Counter] = {}
    done: Bins = Counter()
    for lengths, n in bins.items():
        left = capacity - sum(lengths)
        (room.setdefault(left, Counter()) if left else done)[lengths] += n
    free = sorted(room)

    def put(left: int, lengths: tuple[int, ...], n: int) -> None:
        if not left:
            done[lengths] += n
            return
        if left not in room:
            room[left] = Counter()
            insort(free, left)
        room[left][lengths] += n

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n > 0:
            at = bisect_left(free, size)
            if at == len(free):
                each = capacity // size
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            left = free[at]
            lengths, have = next(iter(room[left].items()))
            take = min(n, have)
            if take == have:
                del room[left][lengths]
                if not room[left]:
                    del room[left]
                    free.pop(at)
            else:
                room[left][lengths] -= take
            put(left - size, tuple(sorted((*lengths, size), reverse=True)), take)
            n -= take
    for some in room.values():
        done.update(some)
    return done


def _keep(bins: list[tuple[tuple[int, ...], int]], left: Counter) -> Bins:
    """As many of each bin as the documents that are left allow; they are taken from ``left``."""
    kept: Bins = Counter()
    for lengths, n in bins:
        need = Counter(lengths)
        n = min(n, min(left[x] // k for x, k in need.items()))
        if n > 0:
            kept[lengths] += n
            for x, k in need.items():
                left[x] -= n * k
    return kept


def exchange(out: Counter, kept: Bins, capacity: int, most: int = 16) -> tuple[Counter, Bins]:
    """Fill the emptiest bins better with displaced documents: one or two of a bin go out for one or two that take more room."""
    out, done = Counter(out), Counter()
    emptiest = set(nsmallest(most, kept, key=sum))
    for lengths, n in kept.items():
        room = capacity - sum(lengths) if lengths in emptiest else 0
        while room and n and out:
            sizes = sorted(out)[-most:]
            new = {(d,): d for d in sizes} | {(d, e): d + e for i, d in enumerate(sizes) for e in sizes[: i + 1] if (d != e or out[d] > 1)}
            old = {(x,): x for x in lengths} | {(lengths[i], lengths[j]): lengths[i] + lengths[j] for i in range(len(lengths)) for j in range(i)}
            gain, d, x = max(((b - a, d, x) for d, b in new.items() for x, a in old.items() if 0 < b - a <= room), default=(0, (), ()))
            if not gain:
                break
            lengths_new = tuple(sorted((Counter(lengths) - Counter(x) + Counter(d)).elements(), reverse=True))
            if n > 1:
                done[lengths] += n - 1
                n = 1
            out.subtract(d)
            out.update(x)
            out = +out
            lengths, room = lengths_new, room - gain
        done[lengths] += n
    return out, done


def crossover(a: Bins, b: Bins, documents: Counter, rng: np.random.Generator, capacity: int) -> Bins:
    """Whole well-filled bins of ``b`` go into ``a``."""
    fills = sorted((capacity - sum(x) for x in b))
    good = max(fills[len(fills) // 2], 1)
    chosen = [(x, int(n)) for x, n in b.items() if capacity - sum(x) <= good and rng.random() < 0.5]
    left = Counter(documents)
    child = _keep(chosen, left)
    own = sorted(a.items(), key=lambda x: (capacity - sum(x[0]), rng.random()))
    child.update(_keep(own, left))
    return best_fit(*exchange(+left, child, capacity), capacity)


def mutate(a: Bins, rng: np.random.Generator, capacity: int) -> Bins:
    """Empty the worst bins and some others, and best-fit what was in them."""
    bins = sorted(a.items(), key=lambda x: sum(x[0]))
    worst = set(range(max(1, len(bins) // 20))) | set(rng.integers(0, len(bins), max(1, len(bins) // 20)).tolist())
    out: Counter = Counter()
    kept: Bins = Counter()
    for i, (lengths, n) in enumerate(bins):
        if i in worst:
            for x in lengths:
                out[x] += n
        else:
            kept[lengths] = n
    return best_fit(*exchange(out, kept, capacity), capacity)


def fitness(a: Bins, capacity: int) -> tuple[int, float]:
    """Bins, and then how far from all-or-nothing they are filled; less is better."""
    return sum(a.values()), -sum(n * (sum(x) / capacity) ** 2 for x, n in a.items())


def evolve(documents: Counter, start: list[Bins], rng: np.random.Generator, capacity: int = CAPACITY, population: int = POPULATION, generations: int = GENERATIONS) -> Bins:
    """The best bins found for an island's documents; ends early where no better can exist."""
    least = -(-sum(x * n for x, n in documents.items()) // capacity)
    people = []
    for bins in [Counter(), *start]:
        left = Counter(documents)
        kept = _keep(list(bins.items()), left)
        people.append(best_fit(+left, kept, capacity))
    best = min(people, key=lambda x: fitness(x, capacity))
    if sum(best.values()) == least:
        return best
    while len(people) < population:
        people.append(mutate(people[int(rng.integers(len(people)))], rng, capacity))
    scored = sorted(((fitness(x, capacity), k, x) for k, x in enumerate(people)), key=lambda x: x[:2])
    for k in range(generations):
        if scored[0][0][0] == least:
            break
        a, b = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[a][2], scored[b][2], documents, rng, capacity)
        if rng.random() < 0.5:
            child = mutate(child, rng, capacity)
        new = (fitness(child, capacity), population + k, child)
        if new[0] < scored[-1][0] and all(new[0] != x[0] for x in scored):
            scored = sorted([*scored[:-1], new], key=lambda x: x[:2])
    return scored[0][2]


GENES = "island long, kind string, lengths array<int>, n long"


def islands(histogram: DataFrame, n_islands: int, capacity: int = CAPACITY, epochs: int = EPOCHS, **how: int) -> DataFrame:
    """(island, lengths, n): bins for each island's (island, length, n)."""
    documents = histogram.select("island", F.lit("document").alias("kind"), F.array(F.col("length").cast("int")).alias("lengths"), "n")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        genes = {kind: Counter({tuple(map(int, x)): int(n) for x, n in zip(part["lengths"], part["n"], strict=True)}) for kind, part in rows.groupby("kind")}
        held = Counter({x[0]: n for x, n in genes.pop("document", {}).items()})
        if not held:
            return pd.DataFrame({"island": [], "kind": [], "lengths": [], "n": []})
        start = [genes[k] for k in ("own", "elite") if k in genes]
        best = evolve(held, start, np.random.default_rng([key[0], len(genes)]), capacity, **how)
        best = sorted(best.items(), key=lambda x: (-sum(x[0]), x[0]))
        return pd.DataFrame({"island": key[0], "kind": "own", "lengths": [list(x) for x, _ in best], "n": [n for _, n in best]})

    genes = documents
    for epoch in range(epochs):
        found = materialize(genes.repartition(min(n_islands, SPREAD), "island").groupBy("island").applyInPandas(run, GENES), f"packing-epoch{epoch}")
        filled = F.aggregate("lengths", F.lit(0), lambda a, x: a + x)
        ranked = found.withColumn("rank", F.expr("row_number() over (partition by island order by aggregate(lengths, 0, (a, x) -> a + x) desc, n desc, lengths)"))
        elite = ranked.where((F.col("rank") <= ELITES) & (filled > capacity // 2)).select(((F.col("island") + 1) % n_islands).alias("island"), F.lit("elite").alias("kind"), "lengths", "n")
        genes = documents.unionByName(found).unionByName(elite)
    return found.select("island", "lengths", "n")


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _place(key: tuple, pieces: pd.DataFrame, bins: pd.DataFrame) -> pd.DataFrame:
    """Give the pieces of an island the slots of their length; those beyond the slots get none.  Bins are numbered within the island."""
    names = [f.split()[0] for f in PACKED.split(", ")]
    pieces = pieces.sort_values(["length", "doc_id", "piece", "ids_crc32", "spread"], kind="stable")
    if not len(bins):
        return pieces.assign(sequence_id=None, offset=None)[names]
    lengths = [np.asarray(x, np.int64) for x in bins["lengths"]]
    times = bins["n"].to_numpy(np.int64)
    kind = np.repeat(np.arange(len(lengths)), times)
    sizes = np.array([len(x) for x in lengths])
    first = np.cumsum(sizes) - sizes
    flat = np.concatenate(lengths)
    before = np.concatenate([np.cumsum(x) - x for x in lengths])
    at = ranges(first[kind], sizes[kind])
    slots = pd.DataFrame({"length": flat[at], "bin": np.repeat(np.arange(len(kind)), sizes[kind]), "offset": before[at]}).sort_values("length", kind="stable")
    for side in (slots, pieces):
        side["nth"] = side.groupby("length").cumcount()
    both = pieces.merge(slots, on=["length", "nth"], how="left")
    if int(both["bin"].notna().sum()) != len(slots):
        raise ValueError(f"island {key[0]}: the bins hold more than its pieces")
    return both.assign(sequence_id=((key[0] << 40) + both["bin"].astype("Int64")), offset=both["offset"].astype("Int64"))[names]


def _placed(pieces: DataFrame, bins: DataFrame) -> DataFrame:
    """Pieces by island in their bins; ``island`` stays for those without."""
    found = pieces.groupBy("island").cogroup(bins.groupBy("island")).applyInPandas(_with_island, f"{PACKED}, island long")
    return materialize(found, "packing-placed")


def _with_island(key: tuple, pieces: pd.DataFrame, bins: pd.DataFrame) -> pd.DataFrame:
    return _place(key, pieces, bins).assign(island=key[0])


def pack(pieces: DataFrame, capacity: int = CAPACITY, island_documents: int = ISLAND_DOCUMENTS, **how: int) -> DataFrame:
    """Add sequence_id and offset to the pieces of ``tokenized_pieces``, each packed once."""
    names = [f.split()[0] for f in PACKED.split(", ")]
    pieces = materialize(pieces, "packing-pieces")
    alone = pieces.where(F.col("length") == capacity).select(*(c.split()[0] for c in PIECES.split(", ")[:-1]), (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    some = pieces.where(F.col("length") < capacity)
    n_islands = max(1, -(-some.count() // island_documents))
    dealt = some.withColumn("island", F.pmod(F.xxhash64("spread"), F.lit(n_islands)))
    bins = islands(dealt.groupBy("island", "length").agg(F.count("*").alias("n")), n_islands, capacity, **how)

    room = F.lit(capacity) - F.aggregate("lengths", F.lit(0), lambda a, x: a + x)
    emptiest = Window.partitionBy("island").orderBy(F.desc("room"), "lengths").rowsBetween(Window.unboundedPreceding, 0)
    judged = bins.withColumn("room", room).withColumn("above", F.sum("n").over(emptiest)).withColumn("all", F.sum("n").over(Window.partitionBy("island")))
    given = (F.col("room") > 0) & ((F.col("above") - F.col("n")) * GIVEN_UP < F.col("all"))
    judged = materialize(judged.withColumn("given", given), "packing-bins")
    first = _placed(dealt, judged.where("not given").select("island", "lengths", "n"))

    loose = first.where("sequence_id is null")
    n_pools = max(1, -(-loose.count() // island_documents))
    pool = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n_pools))
    loose = loose.select(*names[:5], F.lit(0).cast("long").alias("spread"), pool.alias("island"))
    again = islands(loose.groupBy("island", "length").agg(F.count("*").alias("n")), n_pools, capacity, **how)
    second = _placed(loose.withColumn("island", F.col("island") + n_islands), again.withColumn("island", F.col("island") + n_islands))
    return first.where("sequence_id is not null").select(*names).unionByName(second.select(*names)).unionByName(alone)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves.  Needs doc_id to be unique in ``docs``."""
    path = tokenizer or tokenizer_path()

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, ids, at in encoder(path).encode(b.column(0)):
                ids, at = with_end(ids, at, end)
                places = b.column(1).slice(i, j - i).to_pylist()
                for r, some in enumerate(places):
                    parts = [ids[at[r] + p["start"] : at[r] + p["start"] + p["length"]].astype(np.int64).tolist() for p in some or []]
                    yield pa.RecordBatch.from_arrays([pa.array([p["sequence_id"] for p in some or []], pa.int64()), pa.array([p["offset"] for p in some or []], pa.int64()), pa.array(parts, pa.list_(pa.int32()))], names=["sequence_id", "offset", "part"])

    places = packed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))
    joined = docs.select("doc_id", "text").join(places, docs["doc_id"].eqNullSafe(places["doc_id"])).select("text", "places")
    parts = joined.mapInArrow(run, "sequence_id long, offset long, part array<int>")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])
    return parts.groupBy("sequence_id").agg(F.flatten(ordered).alias("ids"))
