"""Pre-tokens of byte-level BPE, found for a whole Arrow column at once.

The byte_bpe_50k tokenizer first cuts a text by its public pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
and then encodes each part by itself. ``spans`` gives the same cuts from the
character class of every code point, without running the pattern.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

from skarn.llm import textkit as K

LETTER, DIGIT, SPACE, OTHER, SPECIAL = 0, 1, 2, 3, 4
SPECIAL_TEXT = "<|endoftext|>"


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point by the tables of the ``regex`` library."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    every = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    return out


def _special(data: np.ndarray) -> np.ndarray:
    """Byte places where the special string begins."""
    mark = SPECIAL_TEXT.encode()
    at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
    return at[[data[i : i + len(mark)].tobytes() == mark for i in at]] if len(at) else at


def _contraction(data: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Letters that a quote at byte place q takes with it (0 if none)."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    x, y = padded[q + 1], padded[q + 2]
    one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
    two = (x == ord("r")) & (y == ord("e")) | (x == ord("v")) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    return np.where(one, 1, np.where(two, 2, 0))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row bounds, class): byte spans that tile every row."""
    z = np.zeros(0, np.int64)
    if not len(data):
        return z, z, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte place of every code point
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    row_first = np.zeros(len(lead) + 1, bool)
    row_first[np.searchsorted(lead, offsets)] = True
    special = _special(data)
    if len(special):
        row = np.searchsorted(offsets, special, "right")
        special = special[special + len(SPECIAL_TEXT) <= offsets[row]]
        at = np.searchsorted(lead, special)
        kind[(at[:, None] + np.arange(len(SPECIAL_TEXT))).ravel()] = SPECIAL
        row_first[at] = True  # what stands around it is encoded by itself
        row_first[at + len(SPECIAL_TEXT)] = True
    n = len(kind)
    cut = row_first[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    run_start = np.flatnonzero(cut)
    run_end = np.concatenate([run_start[1:], [n]])
    run_kind = kind[run_start]
    begin = np.zeros(n + 1, bool)
    begin[run_start] = True
    # A run of white space gives its last character to what follows: a plain
    # space joins the next part, any other one is a part of its own.
    ws = np.flatnonzero(run_kind == SPACE)
    ws = ws[~row_first[run_end[ws]] & (run_end[ws] < n)]
    last = run_end[ws] - 1
    begin[last] = True
    plain = points[last] == 0x20
    begin[run_end[ws][plain]] = False
    # Quotes: 's and the like are a part, unless a space went to the quote.
    o = np.flatnonzero((run_kind == OTHER) & (run_end - run_start == 1))
    o = o[(points[run_start[o]] == 0x27) & begin[run_start[o]]]
    o = o[(run_end[o] < n)]
    o = o[~row_first[run_end[o]] & (kind[np.minimum(run_end[o], n - 1)] == LETTER)]
    if len(o):
        taken = _contraction(data, lead[run_start[o]])
        o, taken = o[taken > 0], taken[taken > 0]
        after = run_start[o] + 1 + taken
        fits = after <= run_end[np.minimum(o + 1, len(run_end) - 1)]
        o, after = o[fits], after[fits]
        begin[run_start[o] + 1] = False
        begin[after] = True
    part = np.flatnonzero(begin[:n])
    starts = lead[part]
    ends = np.concatenate([starts[1:], [len(data)]])
    # the class of a part that begins with its space is that of its second character
    follow = np.minimum(part + 1, n - 1)
    of = np.where((kind[part] == SPACE) & (points[part] == 0x20) & ~begin[follow] & (kind[follow] != SPACE), kind[follow], kind[part])
    return starts, ends, np.searchsorted(starts, offsets), of


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    whole = data.tobytes()
    return [whole[s:e].decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct part ascending, place of one occurrence, index of each part in these)."""
    h = K.span_hashes(data, starts, ends)
    return np.unique(h, return_index=True, return_inverse=True)
