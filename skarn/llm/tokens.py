"""Token counts and ids by byte_bpe_50k.json, through distinct pre-tokens.

Null texts count as empty. A text may hold the tokenizer's special string,
which counts as one id, as the library does by default.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import pretokens as T
from skarn.llm import textkit as K

LIMIT = 1024
#: Distinct pre-tokens whose ids a worker keeps between slices of text.
KEPT = 200_000
#: Buckets of pre-tokens are at most so many, at any size of the input.
BUCKETS = 4096


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of pre-tokens by the tokenizers library, each encoded once."""

    _held: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of the distinct pre-tokens (ascending hashes, spans of ``data``)."""
        if len(self.hashes) > KEPT:
            self.forget()
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        if not known.all():
            new = np.flatnonzero(~known)
            ids = self.encode(T.strings(data, starts[new], ends[new]))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            slots = np.arange(len(new)) + len(self.bounds) - 1
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))])
            self.slots = np.insert(self.slots, at[new], slots)
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            at = np.searchsorted(self.hashes, hashes)
        return self.slots[at]


def document_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(uint32 ids of all rows, row bounds)."""
    data, offsets = K.buffers(column)
    starts, ends, rows, _ = T.spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    h, first, inverse = T.distinct(data, starts, ends)
    encoder = Encoder.of(path)
    slots = encoder.find(h, data, starts[first], ends[first])[inverse]
    sizes = encoder.bounds[slots + 1] - encoder.bounds[slots]
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(total[-1]) + np.repeat(encoder.bounds[slots] - total[:-1], sizes)
    return encoder.ids[at], total[rows]


def _pack(a: np.ndarray) -> bytes:
    """Non-negative whole numbers in the narrowest type, named by the first byte."""
    top = int(a.max()) if len(a) else 0
    k = next(k for k in (1, 2, 4, 8) if top < 1 << (8 * k))
    return bytes([k]) + a.astype(f"<u{k}").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


_FREQ = "key long, block long, parts binary, part_bytes binary, part_docs binary, docs binary, freqs binary, ids binary, nulls binary, n_bytes binary"
_FREQ_NAMES = [x.split()[0] for x in _FREQ.split(", ")]


def _frequencies(buckets: int):
    """Per-document frequencies of pre-tokens. A block (a slice of a task's rows)
    gives one row per bucket of pre-tokens, holding each distinct pre-token of
    the block once with its documents and frequencies, and one row that names
    the block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() + 1) << 32
        for whole in batches:
            for b in K.slices(whole, "text"):
                block += 1
                data, offsets = K.buffers(b.column("text"))
                doc = b.column("doc_id").cast(pa.int64())
                out = [[block, block, None, None, None, None, None, doc.fill_null(0).to_numpy().tobytes(), np.packbits(doc.is_null().to_numpy(zero_copy_only=False)).tobytes(), _pack(np.diff(offsets))]]
                starts, ends, rows, _ = T.spans(data, offsets)
                if len(starts):
                    h, first, inverse = T.distinct(data, starts, ends)
                    row_of = np.repeat(np.arange(b.num_rows), np.diff(rows))
                    pair, freq = np.unique(inverse * b.num_rows + row_of, return_counts=True)
                    part, row = pair // b.num_rows, pair % b.num_rows
                    spread = np.bincount(part, minlength=len(h))
                    edges = np.concatenate([[0], np.cumsum(spread)])
                    to = (h % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                    size, whole_bytes = ends[first] - starts[first], data
                    for k in range(buckets):
                        mine = order[cuts[k] : cuts[k + 1]]
                        if not len(mine):
                            continue
                        n, w = spread[mine], size[mine]
                        at = np.arange(n.sum()) + np.repeat(edges[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                        byte = np.arange(w.sum()) + np.repeat(starts[first][mine] - np.concatenate([[0], np.cumsum(w)[:-1]]), w)
                        out.append([k, block, whole_bytes[byte].tobytes(), _pack(w), _pack(n), _pack(row[at]), _pack(freq[at]), None, None, None])
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 8]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=_FREQ_NAMES)

    return run


_SUM = "block long, docs binary, tokens binary, ids binary, nulls binary, n_bytes binary"
_SUM_NAMES = [x.split()[0] for x in _SUM.split(", ")]


def _counted(path: str):
    """Count the pieces of each distinct pre-token of the bucket once and join
    them to the frequencies that pass by; documents' sums leave, never ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        hashes, pieces = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["parts"] is None:
                    out.append([r["block"], None, None, r["ids"], r["nulls"], r["n_bytes"]])
                    continue
                data = np.frombuffer(r["parts"], np.uint8)
                ends = np.cumsum(_unpack(r["part_bytes"]))
                starts = np.concatenate([[0], ends[:-1]])
                h = K.span_hashes(data, starts, ends)
                order = np.argsort(h)
                at = np.searchsorted(hashes, h[order])
                known = at < len(hashes)
                known[known] = hashes[at[known]] == h[order][known]
                if not known.all():
                    new = order[~known]
                    made = np.fromiter(map(len, encoder.encode(T.strings(data, starts[new], ends[new]))), np.int64, len(new))
                    hashes, pieces = np.insert(hashes, at[~known], h[new]), np.insert(pieces, at[~known], made)
                per = pieces[np.searchsorted(hashes, h)]
                docs, freq = _unpack(r["docs"]), _unpack(r["freqs"])
                sums = np.bincount(docs, weights=np.repeat(per, _unpack(r["part_docs"])) * freq).astype(np.int64)
                has = np.flatnonzero(sums)
                out.append([r["block"], _pack(has), _pack(sums[has]), None, None, None])
            if out:
                kinds = [pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=_SUM_NAMES)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, ordered by block, the block's documents first."""
    block, ids, null, n_bytes, total = None, None, None, None, None

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(n_bytes), pa.array(total), pa.array(total > LIMIT)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    for b in batches:
        for r in b.to_pylist():
            if r["block"] != block:
                if block is not None:
                    yield close()
                block = r["block"]
                ids, n_bytes = np.frombuffer(r["ids"], np.int64), _unpack(r["n_bytes"])
                null = np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=len(ids)).astype(bool)
                total = np.zeros(len(ids), np.int64)
            if r["docs"] is not None:
                total[_unpack(r["docs"])] += _unpack(r["tokens"])
    if block is not None:
        yield close()


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    Pieces are counted once per distinct pre-token of the corpus: pre-tokens are
    dealt by hash into buckets, and a bucket's task counts each of its
    pre-tokens when it first comes, joins the count to the per-document
    frequencies of every block and sums per document. A block ships a frequent
    pre-token once, so no bucket is hot. Null texts have 0 bytes and 0 tokens,
    null ids stay null, repeated rows give repeated rows.
    """
    path = path or tokenizer_path()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").mapInArrow(_frequencies(min(2 * n, BUCKETS)), _FREQ)
    sums = rows.repartition(n, "key").mapInArrow(_counted(path), _SUM)
    ordered = sums.repartition(n, "block").sortWithinPartitions("block", F.col("ids").isNull())
    return ordered.mapInArrow(_summed, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
