"""Benchmark decontamination: short items inside long documents.

Containment search by size-partitioned MinHash. Items are partitioned by the
size of their shingle set (powers of two). For a partition whose items have up
to 2q shingles, documents are searched in windows of 4q shingles with stride
2q, so that any passage of 2q shingles lies in one window and no window is much
larger than what it may contain. From the containment threshold follows the
least Jaccard similarity of a true match with its window, and from that the
number of permutations which misses a match with a chance of at most MISS. A
window is a candidate of an item that it agrees with in one permutation or
more; candidates are verified by exact containment of the item's shingles in
the whole document.

Words are lower-cased and parted by white space and ASCII punctuation. An item
below five words is one shingle. Null and empty texts on either side match
nothing. Repeated documents and items give repeated rows. Items are broadcast in
blocks of ITEM_BLOCK rows, of any number; a block's size is bounded by that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import textkit as K
from skarn.llm.common import broadcast_if_small, materialize

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-4
#: Shingles of the units that windows are made of.
UNIT = 8
#: Items that are broadcast together.
ITEM_BLOCK = 20_000


class Items:
    """A block of items, indexed by partition and permutation."""

    def __init__(self, ids: list, texts: list[str | None]):
        h, bounds = K.shingles(*K.words(pa.array(texts, pa.large_string()), punctuation=True), SHINGLE)
        self.ids = ids
        self.sets = [np.unique(h[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        self.parts = []  # (window and stride in units, items, minima [permutations, items])
        size = np.array([len(s) for s in self.sets])
        for power in range(int(size.max(initial=0)).bit_length()):
            mine = np.flatnonzero((size >= 1 << power) & (size < 2 << power))
            if not len(mine):
                continue
            stride = max(1, -(-(2 << power) // UNIT))
            window = 2 * stride if power > 1 else 2
            q, u = 1 << power, window * UNIT
            need = math.ceil(CONTAINMENT * q)
            likeness = need / (u + q - need)
            k = math.ceil(math.log(MISS) / math.log1p(-likeness))
            flat = np.concatenate([self.sets[i] for i in mine])
            edges = np.concatenate([[0], np.cumsum(size[mine])])
            self.parts.append((window, stride, mine, K.minhash(flat, edges, k)))
        self.permutations = max((m.shape[1] for *_, m in self.parts), default=0)

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) pairs that agree in a permutation for some window."""
        count = np.diff(bounds)
        units = -(-count // UNIT)
        unit_bounds = np.concatenate([[0], np.cumsum(units)])
        if not unit_bounds[-1]:
            return []
        nth = np.arange(unit_bounds[-1]) - np.repeat(unit_bounds[:-1], units)
        at = np.concatenate([np.repeat(bounds[:-1], units) + nth * UNIT, bounds[-1:]])
        low = K.minhash(h, at, self.permutations)
        row_of = np.repeat(np.arange(len(count)), units)
        found = []
        for window, stride, mine, minima in self.parts:
            # windows begin at every stride-th unit of a row
            begin = np.flatnonzero(nth % stride == 0)
            end = np.minimum(begin + window, unit_bounds[row_of[begin] + 1])
            edges = np.stack([begin, end], 1).ravel()
            for j in range(minima.shape[1]):
                column = np.append(low[:, j], np.uint32(0xFFFFFFFF))
                least = np.minimum.reduceat(column, edges)[::2]
                order = np.argsort(minima[:, j], kind="stable")
                keys = minima[order, j]
                first, past = np.searchsorted(keys, least, "left"), np.searchsorted(keys, least, "right")
                for w in np.flatnonzero(past > first).tolist():
                    row = int(row_of[begin[w]])
                    found += [(row, int(mine[order[x]])) for x in range(first[w], past[w])]
        return sorted(set(found))


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for whole in batches:
            for b in K.slices(whole, "text"):
                h, bounds = K.shingles(*K.words(b.column("text"), punctuation=True), SHINGLE)
                out, own, of = [], None, -1
                for row, item in items.candidates(h, bounds):
                    if row != of:
                        own, of = np.unique(h[bounds[row] : bounds[row + 1]]), row
                    want = items.sets[item]
                    at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                    both = int((own[at] == want).sum())
                    if both >= CONTAINMENT * len(want):
                        out.append((row, items.ids[item], len(want), both, both / len(want)))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                doc = b.column("doc_id").take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [doc.cast(pa.int64()), *[pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]],
                    names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"],
                )

    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """The rows of ``items`` in blocks of ITEM_BLOCK, one block in memory at a time."""
    n = items.count()
    blocks = max(1, -(-n // ITEM_BLOCK))
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    for k in range(blocks):
        yield dealt.where(F.col("block") == k).select("item_id", "text").collect()


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): items of which a
    document holds 0.8 or more of the distinct 5-word shingles."""
    spark = docs.sparkSession
    out = None
    for rows in _blocks(items):
        shared = spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows]))
        found = docs.select("doc_id", "text").mapInArrow(_search(shared), "doc_id long, item_id long, n_shingles long, n_shared long, containment double")
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item, told by doc_id; rows
    whose doc_id is null can't be told apart and stay."""
    bad = materialize(contained(docs, items).select(F.col("doc_id").alias("__bad")).distinct())
    return docs.join(broadcast_if_small(bad, bad.count()), docs["doc_id"] == bad["__bad"], "left_anti")
