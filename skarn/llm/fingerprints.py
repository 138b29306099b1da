"""Document fingerprints: MinHash over word shingles.

``fingerprint`` holds PERMUTATIONS minima (16 bits each, base64) of universal
hashes over the document's 5-word shingles; two fingerprints' likeness is the
share of equal places, an estimate of the Jaccard similarity of the shingle
sets. Bands of fingerprints are joined in Spark and candidates verified by exact
Jaccard: documents that reach 0.8, directly or through others, share a
component_id (a pair at 0.8 shares no band with a chance of 5e-5).

Null and empty texts have no shingles: their fingerprint is all ones, alike
with each other and unlike anything else, and they are their own component.
Texts below five words are one shingle. Repeated rows and ids give repeated
rows. Empty tables give none. Texts of any length are worked on whole, in slices
of rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import textkit as K
from skarn.llm.common import Sets, band_keys, broadcast_if_small, components, linked, materialize, release, shared_buckets, similar
from skarn.llm.ngrams import _content, _decode, digest

PERMUTATIONS = 128
SHINGLE = 5
BANDS, ROWS = 25, 5
_PLACES = np.arange(BANDS * ROWS).reshape(BANDS, ROWS)
SIMILARITY = (8, 10)
#: Ranges of ids that the ordered documents are dealt into, for each task of a shuffle, so that tasks are alike.
RANGES = 4


def signatures(texts: pa.Array) -> np.ndarray:
    """[rows, PERMUTATIONS] uint16."""
    return K.minhash(*K.shingles(*K.words(texts), SHINGLE), PERMUTATIONS).astype(np.uint16)


def set_ids(texts: pa.Array) -> np.ndarray:
    """Digest of each text's set of shingles, 0 without words."""
    h, bounds = K.shingles(*K.words(texts), SHINGLE)
    return np.array([digest(s) if len(s) else 0 for s in K.row_sets(h, bounds)], np.int64)


def encode(signature: np.ndarray) -> list[str]:
    return [base64.b64encode(row.tobytes()).decode() for row in signature]


def _sliced(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= K.SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _many(texts: list[str]) -> np.ndarray:
    parts = [signatures(pa.array(p, pa.large_string())) for p in _sliced(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, PERMUTATIONS), np.uint16)


def _ranges(docs: DataFrame) -> DataFrame:
    """``docs`` with ``range`` (0: the largest ids) and ``n`` of rows, plus, as rows with
    ``own`` false, a copy of the row that follows each range's last one. The
    driver holds RANGES ids for each task of a shuffle, whatever the rows."""
    ids = docs.select("doc_id")
    n, low = ids.agg(F.count("*"), F.count("doc_id")).first()
    parts = max(1, min(RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 64))
    cuts: list[int] = []
    if low and parts > 1:
        points = [i / parts for i in range(1, parts)]
        cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", points, 20 * parts)).first()[0]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(cuts, np.int64)
        for b in batches:
            doc = b.column("doc_id").cast(pa.int64())
            at = len(edges) - np.searchsorted(edges, doc.fill_null(0).to_numpy(zero_copy_only=False), "left")
            at = np.where(doc.is_null().to_numpy(zero_copy_only=False), len(edges) + 1, at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), doc, b.column("text").cast(pa.string())], names=["range", "doc_id", "text"]
            )

    dealt = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(deal, "range int, doc_id long, text string")
    # The first row of a range is its largest id (then the smallest text); the range before it needs a copy.
    heads = sorted((r["range"], r["doc_id"]) for r in _range_tops(ids, cuts))
    if not heads:
        return dealt.withColumn("own", F.lit(True))
    needed = docs.sparkSession.createDataFrame([(r, heads[i - 1][0], d) for i, (r, d) in enumerate(heads)], "range int, to int, top long")
    first = dealt.join(F.broadcast(needed), "range").where(F.col("doc_id").eqNullSafe(F.col("top")))
    first = first.groupBy("to", "doc_id").agg(F.min(F.struct(F.col("text").isNotNull().alias("k"), "text")).alias("m"))
    first = first.select(F.col("to").alias("range"), "doc_id", F.col("m.text").alias("text"), F.lit(False).alias("own"))
    return dealt.withColumn("own", F.lit(True)).union(first)


def _range_tops(ids: DataFrame, cuts: list[int]) -> list:
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, best, null = np.array(cuts, np.int64), {}, False
        for b in batches:
            doc = b.column("doc_id").cast(pa.int64())
            null |= doc.null_count > 0
            x = doc.drop_null().to_numpy()
            at = len(edges) - np.searchsorted(edges, x, "left")
            for r in np.unique(at).tolist():
                best[r] = max(best.get(r, x[at == r][0]), x[at == r].max())
        r = [*best, *([len(edges) + 1] if null else [])]
        d = [*map(int, best.values()), *([None] if null else [])]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(d, pa.int64())], names=["range", "doc_id"])

    return ids.mapInArrow(tops, "range int, doc_id long").groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("set_id", pa.int64())]
)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, each range in order, its borrowed last row at the end."""
    held: tuple | None = None  # the row that waits for the next one: (range, own, id, text, signature)

    def close(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[2] for r in rows]
        edits = [t[: len(t) - len(t) // 3] + nxt[: len(t) // 3] for _, _, t, _, nxt, _, _ in rows]
        own, changed = np.array([r[3] for r in rows]).reshape(len(rows), -1), _many(edits)
        follow = np.array([r[5] for r in rows]).reshape(len(rows), -1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for _, i, *_ in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
                pa.array(encode(own)),
                pa.array(encode(changed)),
                pa.array((own == changed).mean(1) if rows else [], pa.float64()),
                pa.array((own == follow).mean(1) if rows else [], pa.float64()),
                pa.array([r[6] for r in rows], pa.int64()),
            ],
            schema=_OUT,
        )

    for whole in batches:
        for b in K.slices(whole, "text"):
            texts = b.column("text").fill_null("").to_pylist()
            sigs, ids = _many(texts), set_ids(b.column("text"))
            rows = []
            for r, own, i, t, s, x in zip(b.column("range").to_pylist(), b.column("own").to_pylist(), b.column("doc_id").to_pylist(), texts, sigs, ids.tolist(), strict=True):
                if held and held[0] == r and held[1]:
                    rows.append((r, *held[2:5], t, s, held[5]))
                held = (r, own, i, t, s, x)
            if rows:
                yield close(rows)


_REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, set_id long"


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text: the last third of
    its code points replaced by the first as many of the next document by
    descending doc_id (after the last comes the first; null ids last, equal ids
    by text), and component_id of ``near_duplicates``. One shuffle of the texts
    into ranges of ids; each range gets a copy of the single row that follows it."""
    grouped = _grouped(docs)
    rows = _ranges(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "range").sortWithinPartitions("range", F.desc("own"), F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    out = ordered.select("range", "own", "doc_id", "text").mapInArrow(_edited, _REPORT)
    out = out.join(broadcast_if_small(grouped, grouped.count()), "set_id", "left")
    return out.select(*[c.split()[0] for c in _REPORT.split(", ")[:-1]], F.coalesce("component_id", "doc_id").alias("component_id"))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in K.slices(whole, "text"):
            sig = signatures(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(set_ids(b.column("text"))), pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["doc_id", "id", "fingerprint"],
            )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, 1 << 13):
            part = b.slice(at, 1 << 13)
            ids, first = np.unique(part.column("id").to_numpy(), return_index=True)
            sig = np.frombuffer(b"".join(part.column("fingerprint").take(pa.array(first)).to_pylist()), np.uint16).reshape(len(ids), -1)
            yield band_keys(sig, _PLACES).ravel(), np.repeat(ids, BANDS)


def _grouped(docs: DataFrame) -> DataFrame:
    """(set_id, component_id) of the sets that stand in two documents or more or link with others."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    base = materialize(docs.where("text is not null and doc_id is not null").mapInArrow(_signed, "doc_id long, id long, fingerprint binary").where("id <> 0"))
    kind = Sets(_content(docs, base, SHINGLE), _decode, similar(*SIMILARITY), *SIMILARITY)
    label = components(linked(shared_buckets(base.select("id", "fingerprint"), _entries), kind)).withColumnRenamed("node", "id")
    own = base.groupBy("id").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).join(broadcast_if_small(label, label.count()), "id", "left")
    own = materialize(own.where("first <> last or component is not null").select("id", "first", F.coalesce("component", "id").alias("c")))
    low = materialize(own.groupBy("c").agg(F.min("first").alias("component_id")))
    out = materialize(own.join(broadcast_if_small(low, low.count()), "c").select(F.col("id").alias("set_id"), "component_id"))
    release(base, own, low)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): documents linked, directly or through others, by
    a Jaccard similarity of 0.8 or more of their 5-word shingle sets; the
    component is its smallest doc_id. Texts without words stand alone."""
    grouped = _grouped(docs)
    own = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signed, "doc_id long, id long, fingerprint binary").select("doc_id", F.col("id").alias("set_id"))
    return own.join(broadcast_if_small(grouped, grouped.count()), "set_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
