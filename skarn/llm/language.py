"""Language identification by segmentation-marginalised unigram models.

A language is a probability for every piece of a fixed public vocabulary. A
word's likelihood is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words (pre-tokens of
letters). Words are scored whole, whatever their length: those of up to BATCHED
bytes in batches of one length, longer ones each by itself with scaled sums.

Null texts and texts without letters are ``und`` with score 0, as is every text
if there is nothing to learn from. Rows without a language or an id that can be
tested are never learned from. Of equally likely languages the first by name is
predicted. Repeated rows give repeated rows, an empty table none. Texts of any
length are scored whole, in slices of rows. Columns of the input that are named
lang_pred or score are replaced, all others stay.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from skarn.llm import pretokens as T
from skarn.llm import textkit as K

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of a word that is scored in a batch with others of its length.
BATCHED = 48
#: Documents of a language that the model is fitted on, in expectation: a sample by hash of the id.
SAMPLE = 3000
SMOOTHING = 0.1
#: Words whose scores a worker keeps between slices.
KEPT = 200_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


class Pieces:
    """The vocabulary by hash, for whole arrays of byte strings."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.longest = max(map(len, ranks))
        self.size = max(ranks.values()) + 1
        names = sorted(ranks)
        data = np.frombuffer(b"".join(names), np.uint8)
        size = np.array([len(x) for x in names])
        ends = np.cumsum(size)
        h = _window_hashes(data, ends - size, size)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array([ranks[x] for x in names])[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[_slot(self.hashes)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h that are pieces, their ids)."""
        maybe = np.flatnonzero(self.filter[_slot(h)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[maybe]
        return maybe[hit], self.ids[at[hit]]


_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _window_hashes(data: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Polynomial hashes of short spans, each from its own first byte. Pieces are
    far shorter than the texts for which such hashes are known to collide."""
    out = np.zeros(len(low), np.uint64)
    up = _powers(_BASE, int(size.max(initial=0)) + 1)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] += (data[low[has] + k].astype(np.uint64) + np.uint64(1)) * up[k]
    return out + size.astype(np.uint64) * _LENGTH


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def forward(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """[words, languages] log likelihood of each byte span, summed over all of
    its segmentations; ``table`` is [piece ids, languages] probabilities."""
    out = np.zeros((len(starts), table.shape[1]))
    size = ends - starts
    up, down = _powers(_BASE, BATCHED + 1), _powers(pow(_BASE, -1, 1 << 64), BATCHED + 1)
    for n in np.unique(size[size <= BATCHED]).tolist():
        every = np.flatnonzero(size == n)
        for at in range(0, len(every), 1 << 12):
            mine = every[at : at + (1 << 12)]
            text = data[starts[mine][:, None] + np.arange(n)]
            sums = np.zeros((n + 1, len(mine)), np.uint64)
            np.cumsum((text.T.astype(np.uint64) + np.uint64(1)) * up[:n, None], axis=0, out=sums[1:])
            alpha = np.zeros((n + 1, len(mine), table.shape[1]))
            alpha[0] = 1
            for j in range(1, n + 1):
                for i in range(max(0, j - pieces.longest), j):
                    hit, ids = pieces.find((sums[j] - sums[i]) * down[i] + np.uint64((j - i) * int(_LENGTH) % (1 << 64)))
                    alpha[j, hit] += alpha[i, hit] * table[ids]
            out[mine] = np.log(np.maximum(alpha[n], 1e-300))
    for k in np.flatnonzero(size > BATCHED).tolist():
        out[k] = _forward_long(data[starts[k] : ends[k]], pieces, table)
    return out


def _forward_long(word: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """The same for one word of any length. Sums are rescaled at every byte; the
    last ``longest`` of them are kept, and pieces are looked up in stretches."""
    n, span = len(word), pieces.longest
    ring, logs = np.zeros((span + 1, table.shape[1])), np.zeros(table.shape[1])
    ring[0] = 1
    padded = np.concatenate([word, np.zeros(span, np.uint8)])
    up = _powers(_BASE, span + 1)
    for base in range(0, n, 1 << 14):
        # every piece that ends in (base, top]
        top, low = min(n, base + (1 << 14)), max(0, base - span)
        begin, final, ids = [], [], []
        h = np.zeros(top - low, np.uint64)
        for k in range(span):
            h += (padded[low + k : top + k].astype(np.uint64) + np.uint64(1)) * up[k]
            at, found = pieces.find(h + np.uint64((k + 1) * int(_LENGTH) % (1 << 64)))
            end = at + low + k + 1
            ok = (end > base) & (end <= top)
            begin.append(at[ok] + low)
            final.append(end[ok])
            ids.append(found[ok])
        b, f, p = (np.concatenate(x) for x in (begin, final, ids))
        order = np.argsort(f, kind="stable")
        b, f, p = b[order] % (span + 1), f[order], p[order]
        cuts = np.searchsorted(f, np.arange(base + 1, top + 2))
        for j in range(base + 1, top + 1):
            mine = slice(cuts[j - base - 1], cuts[j - base])
            now = (ring[b[mine]] * table[p[mine]]).sum(0)
            # each language is scaled so that its sum here is 1; a place that no piece reaches stays 0
            scale = np.where(now > 0, now, 1.0)
            ring[j % (span + 1)] = now
            ring = np.minimum(ring / scale, 1e250)
            logs += np.log(scale)
    last = ring[n % (span + 1)]
    return np.where(last > 0, logs + np.log(np.maximum(last, 1e-300)), -690.0)


def _piece_counts(path: str):
    """Count the pieces of each language's words, by the tokenizer's own segmentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        ranks = read_ranks(path)
        encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in K.slices(whole, "text"):
                data, offsets = K.buffers(b.column("text"))
                starts, ends, rows, kind = T.spans(data, offsets)
                lang = np.repeat(np.array(b.column("lang").to_pylist(), object), np.diff(rows))
                keep = kind == T.LETTER
                for name in set(lang[keep]):
                    mine = np.flatnonzero(keep & (lang == name))
                    h, first, times = np.unique(K.span_hashes(data, starts[mine], ends[mine]), return_index=True, return_counts=True)
                    ids = encoding.encode_ordinary_batch(T.strings(data, starts[mine][first], ends[mine][first]), num_threads=1)
                    flat = np.fromiter((i for x in ids for i in x), np.int64)
                    weight = np.repeat(times, [len(x) for x in ids])
                    sums = np.bincount(flat, weights=weight, minlength=max(ranks.values()) + 1)
                    total[name] = total.get(name, 0) + sums
        for name, sums in total.items():
            has = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(has)), pa.array(has, pa.int32()), pa.array(sums[has].astype(np.int64))], names=["lang", "piece", "n"])

    return run


class Model:
    """Languages, prior and piece probabilities; bounded by vocabulary and languages."""

    def __init__(self, langs: list[str], prior: list[float], counts: np.ndarray):
        self.langs, self.prior = langs, np.log(np.array(prior))
        smooth = counts + SMOOTHING
        self.table = smooth / smooth.sum(0) if len(langs) else smooth


def fit(docs: DataFrame, path: str | None = None, sample: int = SAMPLE) -> Model:
    """Learn from rows of ``docs`` with a language whose crc32(doc_id) mod 4 is not 2."""
    path = path or vocabulary_path()
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [], np.zeros((1, 0)))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])
    dealt = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    some = known.where(dealt < share[F.col("lang")]).select("text", "lang")
    rows = some.mapInArrow(_piece_counts(path), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((max(read_ranks(path).values()) + 1, len(langs)))
    place = {k: i for i, k in enumerate(langs)}
    counts[rows["piece"].to_numpy(), rows["lang"].map(place).to_numpy(np.int64)] = rows["n"].to_numpy()
    total = sum(sizes.values())
    return Model(langs, [sizes[k] / total for k in langs], counts)


class _Scorer:
    """A worker's scores of words it has met."""

    held: dict[tuple, "_Scorer"] = {}

    def __init__(self, model: Model, path: str):
        self.model, self.pieces = model, Pieces(path)
        self.hashes, self.logs = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)))

    def words(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.hashes) > KEPT:
            self.hashes, self.logs = self.hashes[:0], self.logs[:0]
        at = np.searchsorted(self.hashes, h)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == h[known]
        if not known.all():
            new = ~known
            made = forward(data, starts[new], ends[new], self.pieces, self.model.table)
            self.hashes, self.logs = np.insert(self.hashes, at[new], h[new]), np.insert(self.logs, at[new], made, axis=0)
            at = np.searchsorted(self.hashes, h)
        return self.logs[at]

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """([rows, languages] posterior, rows with letters)."""
        data, offsets = K.buffers(column)
        starts, ends, rows, kind = T.spans(data, offsets)
        row = np.repeat(np.arange(len(column)), np.diff(rows))
        word = kind == T.LETTER
        starts, ends, row = starts[word], ends[word], row[word]
        total = np.tile(self.model.prior, (len(column), 1))
        if len(row) and len(self.model.langs):
            h, first, inverse = T.distinct(data, starts, ends)
            logs = self.words(h, data, starts[first], ends[first])[inverse]
            has, begin = np.unique(row, return_index=True)
            total[has] += np.add.reduceat(logs, begin, axis=0)
        if len(self.model.langs):
            total -= total.max(1, keepdims=True)
            total = np.exp(total)
            total /= total.sum(1, keepdims=True)
        return total, np.bincount(row, minlength=len(column)) > 0


def _predict(shared, path: str, tag: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _Scorer.held:
            _Scorer.held.clear()
            _Scorer.held[tag] = _Scorer(shared.value, path)
        scorer = _Scorer.held[tag]
        langs = np.array([*scorer.model.langs, "und"], object)
        for whole in batches:
            for b in K.slices(whole, "text"):
                like, letters = scorer.texts(b.column("text"))
                best = like.argmax(1) if like.shape[1] else np.zeros(b.num_rows, np.int64)
                score = like.max(1) if like.shape[1] else np.zeros(b.num_rows)
                letters &= like.shape[1] > 0
                out = [pa.array(langs[np.where(letters, best, len(langs) - 1)], pa.string()), pa.array(np.where(letters, score, 0.0))]
                yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, path: str | None = None) -> DataFrame:
    """``docs`` (any columns, one of them ``text``) with lang_pred and score;
    columns of these names that it has are replaced."""
    import uuid

    path = path or vocabulary_path()
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = types.StructType([*docs.schema.fields, types.StructField("lang_pred", types.StringType()), types.StructField("score", types.DoubleType())])
    return docs.mapInArrow(_predict(shared, path, uuid.uuid4().hex), schema)


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; only the text decides."""
    model = fit(docs, path)
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, path)
    return out.select("doc_id", "held_out", "lang_pred", "score")
