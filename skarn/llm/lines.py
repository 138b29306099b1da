"""Fuzzy line dedup: one line of each group of near-equal lines stays.

Lines that are not blank, lower-cased (ASCII) and trimmed, are near-equal when
the Jaccard similarity of their sets of 6-character shingles is 0.8 or more.
Candidates come from BANDS bands of ROWS MinHash values (a pair at the threshold
is missed with a chance of about 4e-6; tests measure the recall). The values of
a line below SPLIT shingles come from as many permutations. The shingles of a
longer one are parted by hash into PARTS, each of which gives a value for each
of PARTS times fewer permutations, a band being of ROWS different parts; lines
up to LIKE times as long as SPLIT have both, so that they meet either kind.
Every candidate is verified exactly, and components are found by a distributed
union-find. Of a component, the first line by (doc_id, line) stays, everywhere
else its lines go. A line shorter than a shingle is near-equal to its exact
repeats only, which are joined by hash without bands. Blank lines stay.

Lines are named by 64-bit hashes: of n distinct lines any two share one by
accident with a chance of n * n / 2**65.

Null and empty texts have no lines and are returned as they are. Rows with
one doc_id count as one document: their equal lines at an equal place are one
line. Rows whose doc_id is null keep all their lines. Texts and lines of any
length are worked on whole, in slices of rows. Empty tables give no rows.
Columns named n_lines or n_removed are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from skarn.llm import textkit as K
from skarn.llm.common import Sets, band_keys, broadcast_if_small, components, linked, materialize, release, shared_buckets, similar

SHINGLE = 6
BANDS, ROWS = 32, 5
SPLIT, PARTS = 128, 8
#: Two near-equal lines differ in their number of shingles by this factor at most.
LIKE = 1.25
SIMILARITY = (8, 10)
#: Lists of lines to drop are broadcast up to this size in bytes, else joined by a shuffle.
BROADCAST_BYTES = 32 << 20


_PLACES = np.arange(BANDS * ROWS).reshape(BANDS, ROWS)
#: Value j of part p stands at p * (BANDS * ROWS / PARTS) + j; neighbours in this order are of different parts.
_PARTED = np.arange(BANDS * ROWS).reshape(PARTS, -1).T.reshape(BANDS, ROWS)


def line_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, row, place in the row) of lines that are compared,
    lower-cased and without the white space around them."""
    data, offsets = K.buffers(column)
    low = K._LOWER[data]
    cut = np.flatnonzero(data == 10)
    # a line ends at a newline or at the end of its row
    ends = np.sort(np.concatenate([cut, offsets[1:]]), kind="stable")
    starts = np.concatenate([[0], ends[:-1] + 1])
    is_row_end = np.zeros(len(ends), bool)
    is_row_end[np.searchsorted(cut, offsets[1:], "left") + np.arange(len(offsets) - 1)] = True
    starts[1:][is_row_end[:-1]] -= 1
    row = np.cumsum(np.concatenate([[0], is_row_end[:-1].astype(np.int64)]))
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    place = np.arange(len(ends)) - first[row] if len(ends) else row
    # trim: the first and the last byte of each line that is no space
    space = K._SEPARATORS[False]
    for _ in range(8):
        starts = starts + ((starts < ends) & space[data[np.minimum(starts, len(data) - 1)]]) if len(data) else starts
        ends = ends - ((starts < ends) & space[data[ends - 1]]) if len(data) else ends
    has = np.flatnonzero(starts < ends)
    starts, ends, row, place = starts[has], ends[has], row[has], place[has]
    if (space[data[starts]] | space[data[ends - 1]]).any():  # more white space than that
        solid = np.flatnonzero(~space[data])
        a, z = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
        has = np.flatnonzero(a <= z)
        starts, ends, row, place = solid[a[has]], solid[z[has]] + 1, row[has], place[has]
    return low, starts, ends, row, place


def gathered(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the spans one after another, their bounds)."""
    size = ends - starts
    bounds = np.concatenate([[0], np.cumsum(size)])
    return low[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size)], bounds


_SEEN = "id long, doc_id long, place int, line binary"


def first_seen(ids: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
    """Which ids are neither earlier in ``ids`` nor in ``held``, ascending arrays
    each at least twice as long as the next, to which the new ones are added."""
    new = np.zeros(len(ids), bool)
    new[np.unique(ids, return_index=True)[1]] = True
    for known in held:
        new &= known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] != ids
    mine = np.sort(ids[new])
    while len(mine) and held and len(held[-1]) < 2 * len(mine):
        mine = np.sort(np.concatenate([held.pop(), mine]), kind="stable")
    if len(mine):
        held.append(mine)
    return new


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with its document and place; its bytes once in a task, which
    holds 8 bytes for each of its distinct lines."""
    held: list[np.ndarray] = []
    for whole in batches:
        for b in K.slices(whole, "text"):
            low, starts, ends, row, place = line_spans(b.column("text"))
            ids = K.span_hashes(low, starts, ends)
            first = first_seen(ids, held)
            flat, bounds = gathered(low, starts, np.where(first, ends, starts))
            lines = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [pa.py_buffer(np.packbits(first, bitorder="little")), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)])
            doc = b.column("doc_id").cast(pa.int64()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(K.int64(ids)), doc, pa.array(place, pa.int32()), lines], names=["id", "doc_id", "place", "line"])


def _points(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all lines, bounds)."""
    data, offsets = K.buffers(lines)
    if not (data & 0x80).any():
        return data, offsets
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]


def parted_minhash(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """[rows, BANDS * ROWS] minima of the parts of each row's hashes."""
    rows, k = len(bounds) - 1, BANDS * ROWS // PARTS
    part = (h & np.uint64(PARTS - 1)).astype(np.uint8)
    order = np.argsort(part, kind="stable")  # by part, and in it by row
    size = np.bincount(part.astype(np.int64) * rows + np.repeat(np.arange(rows), np.diff(bounds)), minlength=PARTS * rows)
    values = K.minhash(h[order], np.concatenate([[0], np.cumsum(size)]), k)
    return values.reshape(PARTS, rows, k).transpose(1, 0, 2).reshape(rows, PARTS * k)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for whole in batches:
        for b in K.slices(whole, "line"):
            points, bounds = _points(b.column("line"))
            ids, size = b.column("id").to_numpy(), np.diff(bounds) - SHINGLE + 1
            h, rows = K.shingles(points.astype(np.uint64), bounds, SHINGLE)
            # a line below a shingle is like no other
            for has, made, places in (((size > 0) & (size <= SPLIT * LIKE), lambda *x: K.minhash(*x, BANDS * ROWS), _PLACES), (size >= SPLIT, parted_minhash, _PARTED)):
                if has.any():
                    mine = h[np.repeat(has, np.diff(rows))]
                    keys = band_keys(made(mine, np.concatenate([[0], np.cumsum(np.diff(rows)[has])])), places)
                    yield (keys if places is _PLACES else K.mix(keys)).ravel(), np.repeat(ids[has], BANDS)


def char_shingles(lines: list[bytes]) -> list[np.ndarray]:
    """The ascending set of hashed character shingles of each line."""
    points, bounds = _points(pa.array(lines, pa.binary()))
    h, rows = K.shingles(points.astype(np.uint64), bounds, SHINGLE)
    return K.row_sets(h, rows)


def line_components(seen: DataFrame) -> DataFrame:
    """(id, component) of distinct lines (by hash) that are near-equal to another
    one; ``seen`` is what ``_occurrences`` gives."""
    lines = seen.where("line is not null").select("id", "line")

    def content(ids: DataFrame) -> DataFrame:
        return lines.withColumnRenamed("line", "s").join(broadcast_if_small(ids, ids.count()), "id", "left_semi").dropDuplicates(["id"])

    kind = Sets(content, char_shingles, similar(*SIMILARITY), *SIMILARITY)
    return components(linked(shared_buckets(lines, _entries), kind)).withColumnRenamed("node", "id")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, drop): the places (from 0) of each document's lines that repeat
    a line which stays elsewhere. Documents without such lines have no row."""
    seen = materialize(docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(_occurrences, _SEEN))
    label = materialize(line_components(seen))
    first = seen.groupBy("id").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max(F.struct("doc_id", "place")).alias("last"))
    first = materialize(first.join(broadcast_if_small(label, label.count()), "id", "left").where("first <> last or component is not null"))
    keep = materialize(first.where("component is not null").groupBy("component").agg(F.min("first").alias("keep")))
    plan = first.join(broadcast_if_small(keep, keep.count()), "component", "left").select("id", F.coalesce("keep", "first").alias("keep"))
    plan = materialize(plan)
    release(label, first, keep)
    hit = seen.select("id", "doc_id", "place").join(broadcast_if_small(plan, plan.count()), "id").where("struct(doc_id, place) <> keep")
    drop = materialize(hit.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("drop")))
    release(seen, plan)
    return drop


def _rewritten(text: bytes, drop: list[int]) -> bytes:
    gone = set(drop)
    return b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in K.slices(whole, "text"):
            at, names = b.schema.get_field_index("text"), b.schema.names
            texts = b.column("text")
            data, offsets = K.buffers(texts)
            cuts = np.searchsorted(np.flatnonzero(data == 10), offsets)
            lines = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(cuts) + 1, 0)
            drops = b.column("__drop")
            gone = np.zeros(b.num_rows, np.int32)
            if drops.null_count < b.num_rows:
                new = texts.cast(pa.binary()).to_pylist()
                for i, d in enumerate(drops.to_pylist()):
                    if d and new[i] is not None:
                        new[i], gone[i] = _rewritten(new[i], d), len(d)
                texts = pa.array(new, pa.binary()).cast(pa.string())
            cols = [texts if i == at else b.column(i) for i in range(b.num_columns) if names[i] != "__drop"]
            names = [n for n in names if n != "__drop"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int32()), pa.array(gone, pa.int32())], names=[*names, "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines (before)
    and n_removed; columns of these two names that it has are replaced."""
    docs = docs.drop("n_lines", "n_removed", "__drop")
    drop = repeated_lines(docs).withColumnRenamed("doc_id", "__doc")
    n, places = drop.agg(F.count("*"), F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()
    small = 48 * n + 4 * places <= BROADCAST_BYTES
    drop = F.broadcast(drop) if small else drop.hint("merge")
    wide = docs.join(drop, docs["doc_id"] == drop["__doc"], "left").drop("__doc").withColumnRenamed("drop", "__drop")
    schema = types.StructType([*docs.schema.fields, types.StructField("n_lines", types.IntegerType()), types.StructField("n_removed", types.IntegerType())])
    return wide.mapInArrow(_rewrite, schema)
