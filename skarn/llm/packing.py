"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document is its token ids and an end id. Longer ones than the capacity are
cut into full pieces and, first, the remainder. Pieces shorter than the
capacity are packed: islands of bounded size, dealt by hash, each evolve a small
population of packings. Crossover injects the well-filled bins of one parent
into another, drops the bins that hold a document twice and best-fits the
documents that this displaces. After an epoch the full bins are done; the
elite packing of the rest migrates, bin by bin, to larger-mixed islands, whose
first individual it becomes.

Null texts are empty: one piece of the end id. Repeated rows are packed each by
itself; null ids stay null. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import textkit as K
from skarn.llm import tokens
from skarn.llm.common import materialize

CAPACITY = 1024
END_ID = 2
ISLAND = 4096
EPOCHS = 3
POPULATION, GENERATIONS = 4, 6
#: A bin with no more free places than this is done after an epoch.
SLACK = 2

_PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() + 1) << 40
        for whole in batches:
            for b in K.slices(whole, "text"):
                ids, bounds = tokens.document_ids(b.column("text"), path)
                length = np.diff(bounds) + 1
                at = np.arange(b.num_rows)
                full = np.insert(ids, bounds[1:], np.uint32(end_id))
                begin = bounds[:-1] + at
                rest = length % capacity
                count = length // capacity + (rest > 0)
                of = np.repeat(at, count)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                head = np.where(rest > 0, rest, capacity)[of]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                size = np.where(piece == 0, head, capacity)
                low = begin[of] + start
                crc = [zlib.crc32(full[x:y].tobytes()) for x, y in zip(low.tolist(), (low + size).tolist(), strict=True)]
                doc = b.column("doc_id").cast(pa.int64()).take(pa.array(of))
                key = row + np.arange(len(of))
                row += len(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["row", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def best_fit(order: list[int], sizes: list[int], bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Put each item of ``order`` into the open bin it fills best, else a new one."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, f in enumerate(free):
        if f:
            open_bins[f].append(i)
            mask |= 1 << f
    for item in order:
        size = sizes[item]
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
            free.append(capacity)
        room -= size
        free[at] = room
        if room:
            open_bins[room].append(at)
            mask |= 1 << room


def fitness(free: list[int], capacity: int) -> float:
    """Mean squared fill: fewer and fuller bins score higher."""
    return sum(((capacity - f) / capacity) ** 2 for f in free) / max(1, len(free))


def crossover(a: tuple, b: tuple, sizes: list[int], capacity: int, fill: float, rng: np.random.Generator) -> tuple:
    """Inject a's well-filled bins into b, drop b's bins that they repeat, and
    best-fit what that displaces."""
    well = [bin_ for bin_, f in zip(*a[:2], strict=True) if f <= capacity * (1 - fill)]
    if len(well) > 1:
        well = [well[i] for i in np.flatnonzero(rng.random(len(well)) < 0.7)]
    taken = {i for bin_ in well for i in bin_}
    bins, out = [list(x) for x in well], []
    for bin_ in b[0]:
        if taken.isdisjoint(bin_):
            bins.append(list(bin_))
        else:
            out += [i for i in bin_ if i not in taken]
    free = [capacity - sum(sizes[i] for i in x) for x in bins]
    # the least filled bins are broken up as well, so that their documents move
    worst = sorted(range(len(bins)), key=lambda i: -free[i])[: max(1, len(bins) // 20)]
    worst = [i for i in worst if free[i] > 0]
    out += [i for w in worst for i in bins[w]]
    gone = set(worst)
    bins, free = [x for i, x in enumerate(bins) if i not in gone], [x for i, x in enumerate(free) if i not in gone]
    best_fit(sorted(out, key=lambda i: -sizes[i]), sizes, bins, free, capacity)
    return bins, free, fitness(free, capacity)


def evolve(sizes: list[int], start: list[list[int]] | None, capacity: int, seed: int) -> list[list[int]]:
    """The best packing found: lists of places in ``sizes``. ``start`` is a
    packing that came with the items (migrated elite), or None."""
    rng = np.random.default_rng(seed)
    people = []
    if start:
        free = [capacity - sum(sizes[i] for i in x) for x in start]
        people.append((start, free, fitness(free, capacity)))
    base = np.array(sizes, np.float64)
    while len(people) < POPULATION:
        noise = 0 if len(people) == bool(start) else rng.normal(0, capacity * 0.02, len(base))
        bins: list[list[int]] = []
        free: list[int] = []
        best_fit(np.argsort(-(base + noise), kind="stable").tolist(), sizes, bins, free, capacity)
        people.append((bins, free, fitness(free, capacity)))
    bound = -(-sum(sizes) // capacity)
    for _ in range(GENERATIONS):
        people.sort(key=lambda p: (len(p[0]), -p[2]))
        if len(people[0][0]) == bound:
            break
        other = 1 + int(rng.integers(len(people) - 1))
        people[-1] = crossover(people[0], people[other], sizes, capacity, 0.97, rng)
    people.sort(key=lambda p: (len(p[0]), -p[2]))
    return people[0][0]


def _island(epoch: int, last: bool, capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin", "row"]).reset_index(drop=True)
        sizes = pdf["length"].tolist()
        start = None
        if epoch:
            start = [g.tolist() for g in pdf.groupby("bin", sort=True).indices.values()]
        island = int(pdf["island"].iloc[0])
        bins = evolve(sizes, start, capacity, island)
        at = np.concatenate([np.array(b) for b in bins])
        fill = np.array([sum(sizes[i] for i in b) for b in bins])
        count = np.array([len(b) for b in bins])
        which = np.repeat(np.arange(len(bins)), count)
        size = np.array(sizes)[at]
        before = np.cumsum(size) - size
        offset = before - np.repeat(before[np.cumsum(count) - count], count)
        return pd.DataFrame(
            {
                "row": pdf["row"].to_numpy()[at],
                "length": size,
                "bin": (epoch << 58) + (island << 20) + which,
                "offset": offset,
                "done": (fill >= capacity - SLACK)[which] | last,
            }
        )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every
    piece of ``docs``; a sequence holds at most ``capacity`` ids without gaps."""
    path = path or tokens.tokenizer_path()
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, end_id), _PIECES))
    items = pieces.where(F.col("length") < capacity).select("row", "length", F.col("row").alias("bin"))
    placed = None
    for epoch in range(EPOCHS):
        n = items.count()
        if not n:
            break
        islands = max(1, round(n / ISLAND))
        last = epoch == EPOCHS - 1
        # a bin migrates whole; the first epoch's bins are single pieces
        dealt = items.withColumn("island", F.pmod(F.xxhash64("bin", F.lit(epoch)), F.lit(islands)))
        out = materialize(dealt.groupBy("island").applyInPandas(_island(epoch, last, capacity), "row long, length long, bin long, offset long, done boolean"))
        done = out.where("done").select("row", "bin", "offset")
        placed = done if placed is None else placed.union(done)
        items = out.where("not done").select("row", "length", "bin")
    whole = pieces.where(F.col("length") == capacity).select("*", (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if placed is not None:
        short = pieces.join(placed, "row").select(*pieces.columns, (F.col("bin") * 2 + 1).alias("sequence_id"), "offset")
        whole = whole.union(short)
    return whole.drop("row")
