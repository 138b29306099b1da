"""Vectorised words, shingles and MinHash over Arrow string columns.

Everything works on the column's own byte buffer; a row's words are hashed
without making Python strings. Hashes are 64 bits and depend on the text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Text bytes that are worked on together; a single longer row is taken alone.
SLICE_BYTES = 1 << 20

def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SEPARATORS = {False: _table(SPACES), True: _table(SPACES + PUNCTUATION)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null row is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = 0) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``size`` (SLICE_BYTES) bytes of text each."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (size or SLICE_BYTES), "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


#: Numbers that are worked on at a time, so that they stay in the cache.
BLOCK = 1 << 14


def mix(h: np.ndarray) -> np.ndarray:
    out = np.empty(h.shape, np.uint64)
    flat, source = out.reshape(-1), np.ascontiguousarray(h).reshape(-1)
    tmp = np.empty(min(BLOCK, flat.size), np.uint64)
    for at in range(0, flat.size, BLOCK):
        x, part = flat[at : at + BLOCK], source[at : at + BLOCK]
        t = tmp[: len(x)]
        np.right_shift(part, np.uint64(31), out=t)
        np.bitwise_xor(part, t, out=x)
        np.multiply(x, np.uint64(0xBF58476D1CE4E5B9), out=x)
        np.right_shift(x, np.uint64(27), out=t)
        np.bitwise_xor(x, t, out=x)
        np.multiply(x, np.uint64(0x94D049BB133111EB), out=x)
        np.right_shift(x, np.uint64(31), out=t)
        np.bitwise_xor(x, t, out=x)
    return out


_PLACE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
#: What is kept of eight bytes of which the first 0 to 8 count.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """uint64 hash of each byte span; spans ascend and do not overlap.

    Each eight bytes go through ``mix`` with a key of their place before they
    are summed, so that no arithmetic relation between texts survives, as it
    does in a polynomial modulo a power of two.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        base, top = int(starts[at]), int(ends[stop - 1])
        part = np.zeros(top - base + 8, np.uint8)
        part[: top - base] = _LOWER[data[base:top]] if lower else data[base:top]
        eight = np.ndarray((top - base + 1,), "<u8", part, strides=(1,))  # the eight bytes from each place on
        s, size = starts[at:stop] - base, ends[at:stop] - starts[at:stop]
        sums = mix((eight[s] & _MASKS[np.minimum(size, 8)]) ^ _PLACE)
        more = np.flatnonzero(size > 8)
        if len(more):
            count = (size[more] + 7) // 8 - 1
            first = np.cumsum(count) - count
            nth = np.arange(count.sum()) - np.repeat(first, count) + 1
            place = np.repeat(s[more], count) + 8 * nth
            left = np.minimum(np.repeat(size[more], count) - 8 * nth, 8)
            sums[more] += np.add.reduceat(mix((eight[place] & _MASKS[left]) ^ ((nth + 1).astype(np.uint64) * _PLACE)), first)
        out[at:stop] = mix(sums + size.astype(np.uint64) * _LENGTH)
        at = stop
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row bounds): byte spans of words, and where each row's
    words begin. Words are runs of non-space bytes; with ``punctuation`` ASCII
    punctuation separates too."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATORS[punctuation][data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(column, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of lower-cased words, row bounds)."""
    data, offsets = buffers(column)
    starts, ends, bounds = word_spans(data, offsets, punctuation)
    return span_hashes(data, starts, ends, lower=True), bounds


_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_SIZE = np.uint64(0xA0761D6478BD642F)


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, row bounds): every run of ``n`` words of a row, in
    order; a row of fewer words is one shingle, a row without words none."""
    counts = np.diff(bounds)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, np.uint64), out_bounds
    # every run of n, also those over the end of a row; then the places that count
    run = np.full(len(hashes), n * int(_SIZE) % (1 << 64), np.uint64)
    tmp = np.empty(min(BLOCK, len(hashes)), np.uint64)
    for at in range(0, len(hashes), BLOCK):
        x = run[at : at + BLOCK]
        for k in range(min(n, len(hashes) - at)):
            part = hashes[at + k : at + k + len(x)]
            t = np.multiply(part, _STEP[k], out=tmp[: len(part)])
            x[: len(part)] += t
    if total == len(hashes):
        out = run
    else:
        inside = np.ones(len(hashes), bool)
        for k in range(1, n):
            over = bounds[1:] - k
            inside[over[(over >= bounds[:-1]) & (counts >= n)]] = False
        for r in np.flatnonzero((counts > 1) & (counts < n)).tolist():
            inside[bounds[r] + 1 : bounds[r + 1]] = False
        out = run[inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        one = counts[short].astype(np.uint64) * _SIZE
        for k in range(n - 1):
            has = counts[short] > k
            one[has] += hashes[bounds[short[has]] + k] * _STEP[k]
        out[out_bounds[short]] = one
    return mix(out), out_bounds


def row_sets(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes of each row, ascending."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if len(bounds) <= 1 << 16:
        row = row.astype(np.uint16)  # sorted by radix
    if len(h) < 32 * len(bounds):
        order = np.argsort(h)
        order = order[np.argsort(row[order], kind="stable")]
        h, row = h[order], row[order]
    else:  # long rows are sorted faster one by one, in place
        h = h.copy()
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            h[x:y].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h = h[new]
    ends = np.cumsum(np.bincount(row[new], minlength=len(bounds) - 1)).tolist()
    return [h[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of ``k`` universal hashes x -> a*x + b mod 2**32, a odd; the
    first ones are the same for any ``k``."""
    a, b = (np.random.default_rng(seed).integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) for seed in (20_011, 20_021))
    return a | np.uint32(1), b


def minhash(hashes: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """[rows, k] uint32 minima; a row without shingles is all ones."""
    rows = len(bounds) - 1
    out = np.full((rows, k), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if not len(full):
        return out
    a, b = permutations(k)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    at, step = 0, 1 << 15
    while at < len(full):  # runs of rows that stay in the cache
        stop = max(at + 1, int(np.searchsorted(bounds[full + 1], bounds[full[at]] + step, "right")))
        lo, hi = bounds[full[at]], bounds[full[stop - 1] + 1]
        part, starts = x[lo:hi], bounds[full[at:stop]] - lo
        tmp = np.empty_like(part)
        for j in range(k):
            np.multiply(part, a[j], out=tmp)
            np.add(tmp, b[j], out=tmp)
            out[full[at:stop], j] = np.minimum.reduceat(tmp, starts)
        at = stop
    return out


def int64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
