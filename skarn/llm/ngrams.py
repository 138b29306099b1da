"""N-gram Jaccard join by prefix trees.

A document is the set of its distinct word shingles, in one global order (that
of their 64-bit hashes). Documents link when their sets' Jaccard similarity
reaches a threshold: 3 words and 0.9 for the query, 5 words and 0.8 for
near-duplicate stages. Equal sets are one node, named by a digest of the set.
Nodes meet by bands of MinHash (BANDS of ROWS; a pair at 0.8 shares none with a
chance of 3e-6, at 0.9 with one below 1e-12), which only says which sets are put
before the same tree; every link is decided by the tree: the sets that meet a
probe lie in a trie in the global order, whose nodes hold the overlap of their
path with the probe, and a subtree is left as soon as that overlap and the
shorter remainder cannot reach the needed overlap.

The dealt method by itself, one trie over all sets that every set traverses, is
a join of all documents in one place; the bands cut it into tries that fit a
task. Digests of 64 bits are taken for equal sets: of n distinct sets any two
share one by accident with a chance of n * n / 2**65.

Null texts and texts without words have an empty set, link with nothing and are
their own component. Repeated rows are equal sets and share a component, and so
do different texts below one doc_id that link; of a doc_id with texts of several
components each row has its own one. Texts of any length are read whole. An
empty table gives no rows. Further columns are ignored by the join and kept by
``one_per_group``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import textkit as K
from skarn.llm.common import Sets, band_keys, broadcast_if_small, components, linked, materialize, release, shared_buckets

SHINGLE = 3
NUMERATOR, DENOMINATOR = 9, 10
#: What near-duplicate stages take.
NEAR_SHINGLE, NEAR_NUMERATOR, NEAR_DENOMINATOR = 5, 8, 10
BANDS, ROWS = 32, 5
_PLACES = np.arange(BANDS * ROWS).reshape(BANDS, ROWS)
#: Elements that are looked up before the bound is tested again.
STEP = 32


def digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def ordered_sets(column: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    h, bounds = K.shingles(*K.words(column), n)
    return K.row_sets(h, bounds)


def _base(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in K.slices(whole, "text"):
                sets = ordered_sets(b.column("text"), shingle)
                size = np.array([len(s) for s in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                keys = band_keys(K.minhash(flat, np.concatenate([[0], np.cumsum(size)]), BANDS * ROWS), _PLACES)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").cast(pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array([digest(s) for s in sets], pa.int64()),
                        pa.array([x.tobytes() for x in keys], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "id", "keys"],
                )

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, 1 << 13):
            part = b.slice(at, 1 << 13)
            ids, first = np.unique(part.column("id").to_numpy(), return_index=True)
            keys = part.column("keys").take(pa.array(first)).to_pylist()
            yield np.frombuffer(b"".join(keys), np.uint64), np.repeat(ids, BANDS)


def tree_matches(probe: np.ndarray, sets: list[np.ndarray], numerator: int = NUMERATOR, denominator: int = DENOMINATOR, looked_up: list[int] | None = None) -> list[bool]:
    """Which of ``sets`` reach the similarity with ``probe``; all are ascending.

    The sets in lexicographic order are their trie read depth first: what a set
    shares with its predecessor is the path to their branching node. Each node
    of the path keeps the overlap with the probe and the probe's place, so a set
    goes on from its branching node, and one that branches off below a place
    where it is out of reach is left without looking up anything.
    ``looked_up`` gets the elements that were looked up for each set.
    """
    out = [False] * len(sets)
    order = sorted(range(len(sets)), key=[s.astype(">u8").tobytes() for s in sets].__getitem__)
    path = np.zeros(0, np.uint64)
    overlap, place = np.zeros(1, np.int64), np.zeros(1, np.int64)  # at each node of the path, from the root, as far as it was walked
    for i in order:
        s = sets[i]
        total = len(s) + len(probe)
        need = -(-numerator * total // (numerator + denominator))
        n = min(len(s), len(overlap) - 1)
        differs = np.flatnonzero(s[:n] != path[:n])
        depth = int(differs[0]) if len(differs) else n
        overlap, place, path = overlap[: depth + 1], place[: depth + 1], s
        seen = 0
        # what can be reached falls along the path, so its last node tells for all
        if overlap[-1] + min(len(s) - depth, len(probe) - place[-1]) >= need:
            walked, places = [overlap], [place]
            while depth < len(s):
                part = s[depth : depth + STEP]
                at = np.searchsorted(probe, part)
                hit = probe[np.minimum(at, len(probe) - 1)] == part
                seen += len(part)
                walked.append(walked[-1][-1] + np.cumsum(hit))
                places.append(at + hit)
                depth += len(part)
                if walked[-1][-1] + min(len(s) - depth, len(probe) - places[-1][-1]) < need:
                    break
            else:
                both = int(walked[-1][-1])
                out[i] = denominator * both >= numerator * (total - both)
            overlap, place = np.concatenate(walked), np.concatenate(places)
        if looked_up is not None:
            looked_up.append(seen)
    return out


def _decode(parts: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(p, np.uint64) for p in parts]


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in K.slices(whole, "text"):
                sets = {digest(s): s for s in ordered_sets(b.column("text"), shingle)}
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], names=["id", "s"])

    return run


def _content(docs: DataFrame, base: DataFrame, shingle: int):
    def content(ids: DataFrame) -> DataFrame:
        n = ids.count()
        # documents that hold one of the sets; a set is read from the first of them
        docs_of = base.where("doc_id is not null").join(broadcast_if_small(ids, n), "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        few = broadcast_if_small(materialize(docs_of.distinct()), n)
        sets = docs.select("doc_id", "text").join(few, "doc_id", "left_semi").mapInArrow(_sets(shingle), "id long, s binary")
        return sets.join(broadcast_if_small(ids, n), "id", "left_semi").dropDuplicates(["id"])

    return content


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is the
    smallest doc_id that links reach. A null doc_id is nobody's representative;
    it takes the component of its equal sets, null if there is none."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    base = materialize(docs.mapInArrow(_base(shingle), "doc_id long, n_shingles long, id long, keys binary"))
    named = base.where("n_shingles > 0 and doc_id is not null")
    kind = Sets(_content(docs, base, shingle), _decode, partial(tree_matches, numerator=numerator, denominator=denominator), numerator, denominator)
    label = components(linked(shared_buckets(named.select("id", "keys"), _entries), kind)).withColumnRenamed("node", "id")
    least = named.groupBy("id").agg(F.min("doc_id").alias("first")).join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = materialize(least)
    # of the sets in a component the smallest doc_id; sets that link with none keep their own
    shared = least.groupBy("component").agg(F.min("first").alias("c"), F.count("*").alias("n")).where("n > 1").select("component", "c")
    shared = materialize(shared)
    found = least.join(broadcast_if_small(shared, shared.count()), "component", "left").select("id", F.coalesce("c", "first").alias("c"))
    # only sets of several rows or of other names need the join; a row's own doc_id is its component elsewhere
    found = materialize(found)
    out = base.select("doc_id", "n_shingles", "id").join(broadcast_if_small(found, found.count()), "id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest
    doc_id, once. A doc_id with several texts goes if one of them is to go. Rows
    whose doc_id is null stay."""
    label = materialize(jaccard_components(docs, shingle, numerator, denominator))
    gone = materialize(label.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    out = docs.join(broadcast_if_small(gone, gone.count()), docs["doc_id"] == gone["__gone"], "left_anti")
    twice = materialize(label.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice")))
    if n := twice.count():
        many = broadcast_if_small(twice, n)
        again = out.join(many, out["doc_id"] == twice["__twice"], "left_semi").dropDuplicates(["doc_id"])
        out = out.join(many, out["doc_id"] == twice["__twice"], "left_anti").union(again)
    return out
