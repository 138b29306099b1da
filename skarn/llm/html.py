"""Main text of web pages: page structure and a suffix array of each host.

A page is cut into blocks by its markup. Blocks below menus, headers, footers,
sidebars, notices, adverts, forms, comments and the like are dropped, blocks
below an article or main element are its main text. The token streams of a
host's pages are concatenated and their suffixes sorted; substrings of RUN
tokens or more that stand on distinct pages are repeated. On a page without an
article or main element they decide: repeated stretches of its other blocks go,
and unique runs stay. Text below an article stays even where it is repeated,
as a quoted passage is still the article's.

A host of more than CHUNK characters is dealt by hash into chunks of about that
many, each with a suffix array of its own, so a large host is no large task. The
arrays of a host are then merged in two rounds. First only the leading bits of the
hashes of all runs of RUN tokens and of all pages are dealt by ranges, as steps of
about a byte, and each chunk is told which of its own another chunk has, too. Then
the suffixes whose hashes begin with these are dealt by ranges of the whole hash of
their first RUN tokens, a range of all chunks is sorted in one task, and each chunk
is told which of its suffixes stand on pages of others, too. Bits that agree by
accident cost a few suffixes in the second round and change nothing. So the result
does not depend on how a host is dealt.
Pages of equal token streams count as one page, and a page all of whose open
blocks are repeated is taken for a copy and keeps them.

Null html is empty text. Null urls share a host of their own. Repeated rows give
repeated rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import textkit as K
from skarn.llm.common import broadcast_if_small, materialize

RUN = 8
#: Characters of html of a host that one task sorts.
CHUNK = 16 << 20
#: Leading bits of a hash that chunks are compared by first, besides those that number
#: the chunks: with about 2**21 runs a chunk one in 32 agrees by accident.
LEADING = 26
#: Bytes of text of a chunk's pages that are compressed together.
TOGETHER = 1 << 20
#: Share of a block's tokens that must be repeated for it to lose them.
COVERED = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav header footer aside form menu head dialog button select fieldset object audio video canvas".split())
_ROLES = re.compile(r"\brole\s*=\s*[\"']?(navigation|banner|contentinfo|complementary|search|dialog|alert|alertdialog|menu|menubar|toolbar)\b", re.I)
_MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?(main|article)\b", re.I)
_NAMES = re.compile(r"\b(?:class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|warning|popup|modal|overlay|sidebar|side|aside|comments?|commentlist|disqus|replies|respond"
    r"|nav|navbar|navigation|menu|breadcrumbs?|pagination|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|footer|header|masthead|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: What may hold articles of its own that are none.
_COMMENTS = re.compile("comment|disqus|repl(?:y|ies)|respond|related|recommended", re.I)
DROP, OPEN, MAIN = 0, 1, 2


def _hinted(attributes: str) -> bool:
    if "=" not in attributes:
        return False
    return bool(_ROLES.search(attributes) or any(_HINTS.search(m.strip("\"'")) for m in _NAMES.findall(attributes)))


def blocks(page: str) -> tuple[list[str], list[int]]:
    """(texts, kinds) of the blocks of a page, in order; white space is single."""
    texts, kinds, part = [], [], []
    drop = drop_depth = main_depth = 0
    drop_tag, main_stack, held = "", [], False

    def flush() -> None:
        if part:
            text = " ".join(entities.unescape("".join(part)).split())
            part.clear()
            if text:
                texts.append(text)
                kinds.append(DROP if drop else MAIN if main_depth else OPEN)

    for m in _TOKEN.finditer(page):
        text = m[8]
        if text is not None:
            part.append(text)
            continue
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "br":
            part.append(" ")
        if tag in _BLOCKS:
            flush()
        if tag in _VOID or attributes.endswith("/"):
            continue
        container = tag in ("article", "main")
        if not closing:
            bad = tag in _DROPPED or (tag not in ("html", "body") and _hinted(attributes))
            if drop and container and not bad and not held and MAIN not in kinds:
                drop = 0  # an unclosed container does not swallow the article
            if drop and drop_tag == "p" and tag in _BLOCKS:
                drop = 0  # a paragraph ends where the next block begins
            if drop:
                drop_depth += tag == drop_tag
            elif bad and (tag in _BLOCKS or tag in _DROPPED):
                drop, drop_tag, drop_depth = 1, tag, 1
                held = container or main_depth > 0 or bool(_COMMENTS.search(attributes))
            if not drop and (container or _MAIN_ROLE.search(attributes)):
                main_stack.append([tag, 1])
                main_depth += 1
            elif main_stack and main_stack[-1][0] == tag and not drop:
                main_stack[-1][1] += 1
        elif drop:
            if tag == drop_tag:
                drop_depth -= 1
                if not drop_depth:
                    drop = 0
            elif tag in ("body", "html"):
                drop = 0
        elif main_stack and main_stack[-1][0] == tag:
            main_stack[-1][1] -= 1
            if not main_stack[-1][1]:
                main_stack.pop()
                main_depth -= 1
    flush()
    return texts, kinds


def suffixes(tokens: np.ndarray, bounds: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, where its groups begin, page of each suffix, which groups
    stand on two distinct pages or more) of the suffixes of ``run`` tokens or
    more on their page. They are sorted to that depth by prefix doubling; a group
    are neighbours of one rank."""
    n = len(tokens)
    page = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if n < run:
        none = np.zeros(0, np.int64)
        return none, none, none, none > 0
    rank, width = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while width < run:
        step = min(width, run - width)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    whole = np.flatnonzero(np.arange(n) + run <= bounds[1:][page])  # suffixes with so many tokens on their page
    suffix_array = whole[np.argsort(rank[whole], kind="stable")]
    if not len(suffix_array):
        return suffix_array, suffix_array, suffix_array, suffix_array > 0
    edge = np.flatnonzero(np.concatenate([[True], rank[suffix_array][1:] != rank[suffix_array][:-1]]))
    own = page[suffix_array]
    return suffix_array, edge, own, np.minimum.reduceat(own, edge) != np.maximum.reduceat(own, edge)


def _covered(at: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of ``n`` tokens the runs that begin at ``at`` cover."""
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, np.minimum(at + run, n), -1)
    return np.cumsum(covered)[:n] > 0


def repeated(tokens: np.ndarray, bounds: np.ndarray, run: int = RUN, also: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Which tokens of the concatenated streams stand in a substring of ``run``
    tokens or more that is on two distinct pages or more, or of whose key ``also``
    holds."""
    suffix_array, edge, _, shared = suffixes(tokens, bounds, run)
    if also is not None:
        shared = shared | also(run_keys(tokens, bounds, suffix_array[edge], run))
    return _covered(suffix_array[np.repeat(shared, np.diff(np.append(edge, len(suffix_array))))], len(tokens), run)


def run_keys(tokens: np.ndarray, bounds: np.ndarray, at: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hashes of the ``run`` tokens from each place on, all on one page."""
    if not len(at):
        return np.zeros(0, np.uint64)
    h, begin = K.shingles(tokens, bounds, run)
    page = np.searchsorted(bounds, at, "right") - 1
    return h[begin[page] + at - bounds[page]]


def unique_text(text: str, hit: np.ndarray) -> str:
    """A block without its repeated stretches, if these are COVERED of it or more."""
    if hit.mean() < COVERED:
        return text
    return " ".join(w for w, h in zip(text.split(" "), hit, strict=True) if not h)


def _streams(pages: list[tuple[list[str], bytes]]) -> tuple[list[str], dict[str, int], np.ndarray, np.ndarray]:
    """(token stream of each page, places of the distinct ones, their tokens, bounds)."""
    streams = [" ".join(texts) for texts, _ in pages]
    place = {s: i for i, s in enumerate(dict.fromkeys(streams))}
    return streams, place, *K.words(pa.array(list(place), pa.large_string()))


def _main_text(pages: list[tuple[list[str], bytes]], also: Callable[[np.ndarray], np.ndarray] | None = None) -> list[tuple[str, int, int]]:
    """(text, tokens, repeated tokens) of each page of a chunk of a host; ``also``
    holds of the keys of runs that stand in other chunks, too."""
    streams, place, w, bounds = _streams(pages)
    hit = repeated(w, bounds, also=also)
    out = []
    for (texts, kinds), stream in zip(pages, streams, strict=True):
        mine = hit[bounds[place[stream]] : bounds[place[stream] + 1]]
        if MAIN in kinds:
            keep = [t for t, k in zip(texts, kinds, strict=True) if k == MAIN]
        else:
            keep, at, whole = [], 0, [t for t, k in zip(texts, kinds, strict=True) if k == OPEN]
            for t, k in zip(texts, kinds, strict=True):
                n = t.count(" ") + 1
                if k == OPEN and (t := unique_text(t, mine[at : at + n])):
                    keep.append(t)
                at += n
            keep = keep or whole
        out.append(("\n".join(keep), len(mine), int(mine.sum())))
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of some pages of one chunk. Words are parted by plain spaces only, other
    white space was turned into these; so lines part blocks and form feeds pages."""
    for b in batches:
        rows, held, size = [], defaultdict(list), defaultdict(int)

        def close(key: tuple) -> None:
            ids, urls, texts, kinds = zip(*held.pop(key), strict=True)
            plain = b"\f".join([b"".join(kinds), *texts])
            rows.append((ids, urls, *key, len(plain), _codec().compress(plain, asbytes=True)))
            del size[key]

        for page_id, url, page, *key in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "html", "host", "salt", "chunks")), strict=True):
            key, (texts, kinds) = tuple(key), blocks(page) if page else ([], [])
            held[key].append((page_id, url, "\n".join(texts).encode(errors="replace"), bytes(kinds)))
            size[key] += len(held[key][-1][2])
            if size[key] >= TOGETHER:
                close(key)
        for key in list(held):
            close(key)
        yield _batch(rows, _CHUNKED)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=9)


_CHUNKED = "page_ids array<long>, urls array<string>, host string, salt long, chunks long, size long, blocks binary"
_OUT = "page_id long, url string, text string, n_chars long, n_tokens long, n_repeated long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _rows(columns: pa.RecordBatch | pa.Table) -> Iterator[list[tuple]]:
    """(page_id, url, blocks, kinds) of the pages of each row."""
    for ids, urls, size, packed in zip(*(columns.column(n).to_pylist() for n in ("page_ids", "urls", "size", "blocks")), strict=True):
        kinds, *texts = _codec().decompress(packed, size, asbytes=True).split(b"\f")
        parts = [t.decode().split("\n") if t else [] for t in texts]
        ends = np.cumsum([len(t) for t in parts]).tolist()
        yield [(i, u, t, kinds[e - len(t) : e]) for i, u, t, e in zip(ids, urls, parts, ends, strict=True)]


def _pages(columns: pa.Table) -> list[tuple]:
    return [page for row in _rows(columns) for page in row]


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], list[tuple]]]:
    """((host, salt, chunks of the host), its pages) of rows ordered by these."""
    of, held = None, []
    for b in batches:
        for key, pages in zip(zip(*(b.column(n).to_pylist() for n in ("host", "salt", "chunks")), strict=True), _rows(b), strict=True):
            if key != of:
                if held:
                    yield of, held
                of, held = key, []
            held += pages
    if held:
        yield of, held


def _results(rows: list[tuple], also: Callable[[np.ndarray], np.ndarray] | None = None) -> list[pa.Array]:
    got = _main_text([r[2:] for r in rows], also)
    return [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.string()),
        pa.array([g[0] for g in got], pa.string()),
        pa.array([len(g[0]) for g in got], pa.int64()),
        pa.array([g[1] for g in got], pa.int64()),
        pa.array([g[2] for g in got], pa.int64()),
    ]


_COLUMNS = [x.split()[0] for x in _OUT.split(", ")]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages ordered by (host, salt), each host one chunk."""
    for _, rows in _by_chunk(batches):
        yield pa.RecordBatch.from_arrays(_results(rows), names=_COLUMNS)


#: Leading bits of a chunk's hashes in one range: their number, the least and the steps
#: to the next ones.
_LED = "host string, part long, salt long, n long, least binary, steps binary"
#: Which of these another chunk has, bit by bit.
_MET = "host string, part long, salt long, bits binary"
#: Groups of suffixes of a chunk in one range: their number, the least key, the steps
#: to the next ones and, as places in a list, what they stand on: 0 several pages of
#: the chunk, 1 a page that no other chunk has, else the hash of a page's token stream.
_RANGED = "host string, part long, salt long, chunks long, n long, least binary, steps binary, streams binary, at binary"
#: Leading bits of the keys of a chunk in one range that stand on pages of others, too,
#: and whole keys where the chunk has others that begin so.
_TOLD = "host string, salt long, n long, least binary, steps binary, keys binary"


def _planes(a: np.ndarray) -> bytes:
    """Whole numbers below 2**63 as planes of as many bytes as the greatest takes,
    of which the highest, which is far from even, is packed."""
    k = max(1, (int(a.max()).bit_length() + 7) // 8)
    each = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T)
    pack = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    return bytes([k]) + each[:-1].tobytes() + pack.compress(each[-1].tobytes()) + pack.flush()


def _from_planes(b: bytes, n: int) -> np.ndarray:
    k = b[0]
    each = np.zeros((8, n), np.uint8)
    each[: k - 1] = np.frombuffer(b, np.uint8, (k - 1) * n, 1).reshape(k - 1, n)
    each[k - 1] = np.frombuffer(zlib.decompress(b[1 + (k - 1) * n :]), np.uint8)
    return np.ascontiguousarray(each.T).view("<u8").ravel()


def _steps(keys: np.ndarray) -> tuple[int, bytes, bytes]:
    """(number, least, steps to the next ones) of ascending keys."""
    return (len(keys), keys[:1].tobytes(), _planes(np.diff(keys, prepend=keys[0]))) if len(keys) else (0, b"", b"")


def _from_steps(n: int, least: bytes, steps: bytes) -> np.ndarray:
    return np.frombuffer(least, np.uint64) + np.cumsum(_from_planes(steps, n)) if n else np.zeros(0, np.uint64)


def _unled(chunks: int) -> np.uint64:
    """Bits of a hash that do not lead it."""
    return np.uint64(max(0, 64 - LEADING - (chunks - 1).bit_length()))


def _cuts(keys: np.ndarray, chunks: int) -> np.ndarray:
    """Where the ranges of ascending keys begin, of which a host has as many as chunks."""
    part = ((keys >> np.uint64(32)) * np.uint64(chunks) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(part, np.arange(chunks + 1))


def _hashed(pages: list[tuple], chunks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of the distinct pages of a chunk, bounds, hash of each such page, leading
    bits of these and of all runs, where their ranges begin)."""
    _, place, w, bounds = _streams([r[2:] for r in pages])
    data, offsets = K.buffers(pa.array(list(place), pa.large_string()))
    streams = K.span_hashes(data, offsets[:-1], offsets[1:]) | np.uint64(1)
    whole = np.flatnonzero(np.arange(len(w)) + RUN <= np.repeat(bounds[1:], np.diff(bounds)))
    leading = np.unique(np.concatenate([run_keys(w, bounds, whole), streams]) >> _unled(chunks))
    return w, bounds, streams, leading, _cuts(leading << _unled(chunks), chunks)


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leading bits of each chunk by ranges."""
    for (host, salt, chunks), pages in _by_chunk(batches):
        *_, leading, cuts = _hashed(pages, chunks)
        yield _batch([(host, p, salt, *_steps(leading[cuts[p] : cuts[p + 1]])) for p in np.flatnonzero(np.diff(cuts)).tolist()], _LED)


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[tuple]]]:
    """((host, part), what each chunk has there) of rows ordered by (host, part)."""
    of, held = None, []
    for b in batches:
        for host, part, *row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if (host, part) != of:
                if held:
                    yield of, held
                of, held = (host, part), []
            held.append(row)
    if held:
        yield of, held


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges by (host, part): to each chunk which of its own another chunk has."""
    for of, held in _by_range(batches):
        keys = np.concatenate([_from_steps(*row[1:]) for row in held])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]  # a chunk has each once
        met = np.zeros(len(keys), bool)
        met[order[1:][same]] = met[order[:-1][same]] = True
        each = np.split(met, np.cumsum([row[1] for row in held])[:-1])
        yield _batch([(*of, row[0], zlib.compress(np.packbits(m).tobytes(), 1)) for row, m in zip(held, each, strict=True) if m.any()], _MET)


def _ranged(pages: pa.Table, told: pa.Table) -> pa.Table:
    """The groups of a chunk's suffix array that begin with what another chunk has,
    by ranges."""
    if not told.num_rows or not pages.num_rows:
        return pa.Table.from_batches([_batch([], _RANGED)])
    host, salt, chunks = (pages.column(c)[0].as_py() for c in ("host", "salt", "chunks"))
    w, bounds, streams, leading, cuts = _hashed(_pages(pages), chunks)
    met = np.zeros(len(leading), bool)
    for p, bits in zip(told.column("part").to_pylist(), told.column("bits").to_pylist(), strict=True):
        met[cuts[p] : cuts[p + 1]] = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=cuts[p + 1] - cuts[p])
    leading = leading[met]
    suffix_array, edge, own, shared = suffixes(w, bounds)
    keys = run_keys(w, bounds, suffix_array[edge])
    on = np.where(np.isin(streams >> _unled(chunks), leading), streams, np.uint64(1))
    stands = np.where(shared, np.uint64(0), on[own[edge]])
    some = np.flatnonzero(np.isin(keys >> _unled(chunks), leading))
    order = some[np.argsort(keys[some])]
    cuts = _cuts(keys[order], chunks)
    out = []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        i = order[cuts[p] : cuts[p + 1]]
        known, at = np.unique(stands[i], return_inverse=True)
        out.append((host, p, salt, chunks, *_steps(keys[i]), known.tobytes(), _planes(at)))
    return pa.Table.from_batches([_batch(out, _RANGED)])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges by (host, part): to each chunk which of its keys stand on one of its
    pages and on a page of another chunk."""
    for (host, _), held in _by_range(batches):
        keys = np.concatenate([_from_steps(*row[2:5]) for row in held])
        stands = np.concatenate([np.frombuffer(known, np.uint64)[_from_planes(at, n)] for _, _, n, _, _, known, at in held])
        chunk = np.repeat(np.arange(len(held)), [row[2] for row in held])
        stands = np.where(stands == 1, 2 * (chunk.astype(np.uint64) + np.uint64(1)), stands)  # hashes of pages are odd
        order = np.argsort(keys, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        several = np.minimum.reduceat(stands[order], begin) != np.maximum.reduceat(stands[order], begin)
        mine = np.empty(len(keys), bool)
        mine[order] = np.repeat(several, np.diff(np.append(begin, len(keys))))
        mine &= stands != 0
        out, end = [], 0
        for salt, chunks, n, *_ in held:
            at, end = end, end + n
            lead = keys[at:end] >> _unled(chunks)
            begin = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
            # what stands on several pages of the chunk is known to be repeated there
            every = np.logical_and.reduceat(mine[at:end] | (stands[at:end] == 0), begin)
            short = every & np.logical_or.reduceat(mine[at:end], begin)
            rest = mine[at:end] & np.repeat(~every, np.diff(np.append(begin, n)))
            if short.any() or rest.any():
                out.append((host, salt, *_steps(lead[begin[short]]), keys[at:end][rest].tobytes()))
        yield _batch(out, _TOLD)


def _finished(pages: pa.Table, told: pa.Table) -> pa.Table:
    """The pages of one chunk and what it was told."""
    if not pages.num_rows:
        return pa.Table.from_batches([_batch([], _OUT)])
    unled = _unled(pages.column("chunks")[0].as_py())
    short = [_from_steps(*x) for x in zip(*(told.column(c).to_pylist() for c in ("n", "least", "steps")), strict=True)]
    whole = np.frombuffer(b"".join(told.column("keys").to_pylist()), np.uint64)
    leading = np.concatenate([np.zeros(0, np.uint64), *short])
    return pa.Table.from_arrays(_results(_pages(pages), lambda keys: np.isin(keys >> unled, leading) | np.isin(keys, whole)), names=_COLUMNS)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_tokens, n_repeated) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    size = F.sum(F.coalesce(F.length("html"), F.lit(0)) + 100)
    large = materialize(pages.groupBy("host").agg(F.ceil(size / CHUNK).cast("long").alias("chunks")).where("chunks > 1"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = large.count()
    known = broadcast_if_small(large, count)

    def dealt(df: DataFrame) -> DataFrame:
        df = df.select("page_id", "url", "html", "host", F.pmod(F.xxhash64("page_id", "url"), F.col("chunks")).alias("salt"), "chunks")
        return df.mapInArrow(_parsed, _CHUNKED).repartition(n, "host", "salt")

    small = dealt(pages.join(known, "host", "left_anti").withColumn("chunks", F.lit(1).cast("long")))
    out = small.sortWithinPartitions("host", "salt").mapInArrow(_extracted, _OUT)
    if not count:
        return out
    chunks = dealt(pages.join(known, "host"))
    by_chunk = chunks.groupBy("host", "salt")
    led = chunks.sortWithinPartitions("host", "salt").mapInArrow(_led, _LED)
    met = led.repartition(n, "host", "part").sortWithinPartitions("host", "part").mapInArrow(_met, _MET)
    ranges = by_chunk.cogroup(met.groupBy("host", "salt")).applyInArrow(_ranged, _RANGED)
    also = ranges.repartition(n, "host", "part").sortWithinPartitions("host", "part").mapInArrow(_merged, _TOLD)
    return out.unionByName(by_chunk.cogroup(also.groupBy("host", "salt")).applyInArrow(_finished, _OUT))
