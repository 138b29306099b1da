"""Table access, lineage cuts and links between rows, shared by the operators."""

from __future__ import annotations

import atexit
import operator
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast after they have been counted.
BROADCAST_ROWS = 500_000

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session below spark.checkpoint.dir, which all executors
    see. Where that is unset, a local session (tests) gets a temporary folder of
    its own, and a cluster is refused."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='skarn-')}"
        _roots[app] = f"{base.rstrip('/')}/skarn-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _forget(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may already be gone at exit
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. A lost
    executor then costs a read, not everything upstream."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skarn_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing that is still to run reads it."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._skarn_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` is the counted size of ``df``; beyond ``limit`` Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its
    smallest node. Distributed union-find by contraction: in each round every
    node points to the first of itself and its neighbours, in an order that is
    random in the nodes, and edges are drawn anew between what their ends point
    to, until none is left; the pointers are then followed through the rounds.
    With that order a round at least halves the nodes of any graph, chains
    included, in expectation. Rounds are written to the shared folder; only
    counts come to the driver. Minima are aggregated before they are shuffled,
    so a hub is one row of each task, and joins with hubs are plain joins that
    adaptive execution splits.
    """
    e = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    rounds: list[DataFrame] = []
    while n := e.count():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("m"))
        to = materialize(low.select("u", F.least("m", F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v")))["v"].alias("p")))
        rounds.append(to)
        pointer = broadcast_if_small(to, 2 * n)
        drawn = e.join(pointer.select(F.col("u").alias("a"), F.col("p").alias("x")), "a").join(pointer.select(F.col("u").alias("b"), F.col("p").alias("y")), "b")
        new = materialize(drawn.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        release(e)
        e = new
    release(e)
    if not rounds:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    label = rounds[0].select(F.col("u").alias("node"), F.col("p").alias("l"))
    for to in rounds[1:]:
        label = label.join(to.select(F.col("u").alias("l"), F.col("p").alias("then")), "l", "left").select("node", F.coalesce("then", "l").alias("l"))
    label = materialize(label)
    release(*rounds)
    least = materialize(label.groupBy("l").agg(F.min("node").alias("component")))
    return label.join(broadcast_if_small(least, least.count()), "l").select("node", "component")


#: 64-bit words of a set's parity sketch.
SKETCH = 8


def parity(members: list[np.ndarray]) -> np.ndarray:
    """[sets, SKETCH] int64: of the elements that hash to each bit, odd or even.
    The sketches of two sets differ in at most as many bits as the sets differ
    in elements, so too many bits rule a link out."""
    out = np.zeros((len(members), SKETCH * 64), np.uint8)
    for i, s in enumerate(members):
        out[i] = np.bincount((s >> np.uint64(17)).astype(np.int64) % (SKETCH * 64), minlength=SKETCH * 64) & 1
    return np.packbits(out, axis=1).view(np.int64)


def difference(members: list[np.ndarray], probe: np.ndarray, oks: list[bool], numerator: int, denominator: int) -> tuple[list[int], list[bytes]]:
    """(size of the difference from ``probe``, prefix of it) for each ascending
    set. The prefix is as long as it takes for any partner that may link with
    the set, but not through the probe, to share an element of it; elements that
    the probe lacks come first.

    Two sets link only if they differ in few elements, and a set that does not
    link with the probe differs from it in more: so the differences of two sets
    that link, of which one at least does not link with the probe, share one
    element or more, and by the triangle inequality often many more.
    """
    sizes, prefixes = [], []
    gap = denominator - numerator
    for s, ok in zip(members, oks, strict=True):
        at = np.searchsorted(probe, s)
        hit = probe[np.minimum(at, len(probe) - 1)] == s
        lacks = np.ones(len(probe), bool)
        lacks[at[hit]] = False
        diff = np.concatenate([s[~hit], probe[lacks]])
        least = max(1, len(diff) - len(s) * gap // numerator)
        if ok:  # its partner keeps a distance from the probe
            least = max(least, int((len(diff) + gap * (len(probe) - len(s)) / (numerator + denominator)) // 2) + 1)
        sizes.append(len(diff))
        prefixes.append(diff[: max(0, len(diff) - least + 1)].tobytes())
    return sizes, prefixes


#: Entries that a task holds before it deals them out.
FLUSH = 1 << 20
#: Bytes of a bucket's key that go with an entry. Buckets of one part that agree
#: in them are taken for one, which costs tests and loses nothing.
KEY_BYTES = 4
_DEALT = "part int, direct boolean, keys binary, ids binary"
_BUCKET = "bucket long, id long"


def _blob(part: int, direct: bool, keys: np.ndarray, ids: np.ndarray) -> tuple:
    return part, direct, keys.tobytes() if direct else _short(keys), ids.tobytes()


def _short(keys: np.ndarray) -> bytes:
    """Ascending keys of one part as the steps between them, byte by byte: all
    their first bytes, all their second bytes and so on. The high ones are
    mostly 0 and cost next to nothing once the shuffle compresses them."""
    steps = np.diff(keys.astype("<u4"), prepend=np.uint32(0))
    return steps.view(np.uint8).reshape(-1, KEY_BYTES).T.tobytes()


def _keys(part: int, short: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(short, np.uint8).reshape(KEY_BYTES, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64) + (np.uint64(part) << np.uint64(8 * KEY_BYTES))


def _groups(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ids) by key, where each key begins, and the keys that two ids or more have."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys, ids, begin, np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)


def _dealer(entries: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], parts: int):
    """Deals the (bucket keys, ids) that ``entries`` finds. A bucket that has two
    ids in one flush is known to be shared: its entries go on as they are, to
    any task, and one of them stands for them where its key is dealt to. So a
    bucket of any size is a few entries of each flush in the task of its key."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]], nth: int) -> pa.RecordBatch:
        keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        # a key is its part, above KEY_BYTES bytes of its own
        part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        keys = (keys & np.uint64((1 << (8 * KEY_BYTES)) - 1)) + (part << np.uint64(8 * KEY_BYTES))
        keys, ids, begin, shared = _groups(keys, ids)
        rows = []
        known = np.repeat(shared, np.diff(np.append(begin, len(keys))))
        k, i = keys[known], ids[known]
        for at in range(0, len(k), 1 << 15):
            rows.append(_blob((nth * 7919 + (at >> 15) * 104_729) % parts, True, k[at : at + (1 << 15)], i[at : at + (1 << 15)]))
        k, i = keys[begin], ids[begin]
        to = (k >> np.uint64(8 * KEY_BYTES)).astype(np.int64)  # ascends with the key
        cuts = np.searchsorted(to, np.arange(parts + 1))
        rows += [_blob(p, False, k[cuts[p] : cuts[p + 1]], i[cuts[p] : cuts[p + 1]]) for p in np.flatnonzero(np.diff(cuts)).tolist()]
        kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _DEALT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, nth = [], 0, 0
        for keys, ids in entries(batches):
            held.append((keys, ids))
            size += len(keys)
            if size >= FLUSH:
                yield flush(held, nth)
                held, size, nth = [], 0, nth + 1
        if size:
            yield flush(held, nth)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of buckets that two ids or more share. Of what has passed by,
    one id of each bucket is kept."""
    first, one = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # buckets met, ascending, and an id of each

    def out(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids)], names=["bucket", "id"])

    def close(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        nonlocal first, one
        keys, ids, begin, shared = _groups(*(np.concatenate(x) for x in zip((first, one), *held, strict=True)))
        known = np.repeat(shared, np.diff(np.append(begin, len(keys))))
        first, one = keys[begin], ids[begin]
        return out(keys[known], ids[known])

    held, size = [], 0
    for b in batches:
        for part, direct, k, i in zip(*(b.column(n).to_pylist() for n in ("part", "direct", "keys", "ids")), strict=True):
            ids = np.frombuffer(i, np.int64)
            if direct:
                yield out(np.frombuffer(k, np.uint64), ids)
                continue
            held.append((_keys(part, k), ids))
            size += len(ids)
            if size >= max(4 * FLUSH, 2 * len(first)):
                yield close(held)
                held, size = [], 0
    if size:
        yield close(held)


def shared_buckets(rows: DataFrame, entries: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(bucket, id), each once, of all buckets with two ids or more. ``entries``
    turns batches of ``rows`` into arrays of keys (uint64) and ids (int64)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(_dealer(entries, 4 * n), _DEALT)
    return dealt.repartition(n, "part").mapInArrow(_met, _BUCKET).distinct()


def band_keys(signature: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """[rows, bands] uint64 keys: row k of ``bands`` names the places of the
    signature that make up band k."""
    from skarn.llm.textkit import mix

    key = np.broadcast_to(np.arange(1, len(bands) + 1, dtype=np.uint64) << np.uint64(40), (len(signature), len(bands))).copy()
    for k in range(bands.shape[1]):
        key = mix(key + signature[:, bands[:, k]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return key


#: Members of a star that one task tests against each other.
STAR = 1024
#: Bytes of sets that a task holds for that.
STAR_BYTES = 32 << 20
TESTED = "a long, b long, ok boolean, size long, n_diff long, prefix binary, sketch binary"


@dataclass(frozen=True)
class Sets:
    """What is linked. ``content``: a frame of ids -> (id, s binary), one row for
    each; ``decode``: these bytes -> ascending uint64 sets; ``match``: a probe
    and sets -> which of them are as similar as ``numerator`` / ``denominator``."""

    content: Callable[[DataFrame], DataFrame] | None
    decode: Callable[[list[bytes]], list[np.ndarray]]
    match: Callable[[np.ndarray, list[np.ndarray]], list[bool]]
    numerator: int
    denominator: int


def similar(numerator: int, denominator: int) -> Callable[[np.ndarray, list[np.ndarray]], list[bool]]:
    def match(probe: np.ndarray, sets: list[np.ndarray]) -> list[bool]:
        out = []
        for s in sets:
            both = 0
            if denominator * min(len(s), len(probe)) >= numerator * max(len(s), len(probe)):
                at = np.searchsorted(probe, s)
                both = int((probe[np.minimum(at, len(probe) - 1)] == s).sum())
            out.append(denominator * both >= numerator * (len(probe) + len(s) - both))
        return out

    return match


def among(names: list[int], sets: list[np.ndarray], ok: list[bool], prefixes: list[np.ndarray], sketches: np.ndarray, kind: Sets) -> list[tuple[int, int]]:
    """Links among the members of a star, of which ``ok`` ones link with its
    centre, up to components: a member that does not is tested with those whose
    prefix shares an element with its own and which it is not yet linked with."""
    label = np.array([-1 if x else i for i, x in enumerate(ok)])
    size = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), [len(p) for p in prefixes])
    token = np.concatenate(prefixes)
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    gap, total = kind.denominator - kind.numerator, kind.denominator + kind.numerator
    out = []
    for i in np.flatnonzero(label >= 0).tolist():
        low, high = np.searchsorted(token, prefixes[i]), np.searchsorted(token, prefixes[i], "right")
        spread = high - low
        met = np.unique(of[np.arange(spread.sum()) + np.repeat(low - np.cumsum(spread) + spread, spread)])
        apart = np.bitwise_count((sketches[met] ^ sketches[i]).view(np.uint64)).sum(1).astype(np.int64)
        met = met[apart * total <= (size[met] + size[i]) * gap]
        for j in met.tolist():
            if label[j] != label[i] and kind.match(sets[i], [sets[j]])[0]:
                out.append((names[i], names[j]))
                label[label == label[i]] = label[j]
    return out


def _stars(kind: Sets, full: bool):
    """Rows (a, salt, whole, b, s) by (a, salt), the centre (b is null) first. A
    star that stands whole in one task leaves as its links; with ``full``, the
    members of a larger one leave with their differences from the centre."""

    kind = replace(kind, content=None)  # the tasks have no frames

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, probe, names, sets, size = None, None, [], [], 0

        def close(whole: bool) -> list[tuple]:
            if not names:
                return []
            ok = kind.match(probe, sets)
            links = [(of[0], n, True, None, None, None, None) for n, k in zip(names, ok, strict=True) if k]
            if not full or whole and len(links) == len(names):
                return links
            sizes, prefixes = difference(sets, probe, ok, kind.numerator, kind.denominator)
            sketches = parity(sets)
            if whole:
                return links + [(x, y, True, None, None, None, None) for x, y in among(names, sets, ok, [np.frombuffer(p, np.uint64) for p in prefixes], sketches, kind)]
            return [(of[0], *x, y.tobytes()) for *x, y in zip(names, ok, map(len, sets), sizes, prefixes, sketches, strict=True)]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in TESTED.split(", ")])

        for b in batches:
            out = []
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                head = zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)
                for (a, salt, whole, name), s in zip(head, kind.decode(part.column(4).to_pylist()), strict=True):
                    if (a, salt) != (of and of[:2]):
                        out += close(of[2]) if of else []
                        of, probe, names, sets, size = (a, salt, whole), s, [], [], 0
                        continue
                    if size > STAR_BYTES:  # more than is held at once: from here on as a larger star
                        out += close(False)
                        of, names, sets, size = (a, salt, False), [], [], 0
                    names.append(name)
                    sets.append(s)
                    size += s.nbytes
            yield batch(out)
        if of:
            yield batch(close(of[2]))

    return run


def tested(pairs: DataFrame, content: DataFrame, kind: Sets, full: bool) -> DataFrame:
    """The pairs (a, b) put to the test star by star, as TESTED; those that fail
    have no row, but for the members of stars that were too large for a task."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("trees"))
    many = materialize(sizes.where("trees > 1"))
    dealt = pairs.join(broadcast_if_small(many, many.count()), "a", "left").na.fill(1, ["trees"])
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.col("trees")).cast("int").alias("salt"), (F.col("trees") == 1).alias("whole"))
    probes = dealt.select("a", "salt", "whole").distinct().join(content.withColumnRenamed("id", "a"), "a")
    members = dealt.join(content.withColumnRenamed("id", "b"), "b")
    rows = probes.select("a", "salt", "whole", F.lit(None).cast("long").alias("b"), "s").union(members.select("a", "salt", "whole", "b", "s"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull()).mapInArrow(_stars(kind, full), TESTED)


_PREFIX = "a long, b long, ok boolean, size long, n_diff long, c long, token long, place int" + "".join(f", s{k} long" for k in range(SKETCH))
_PREFIX_NAMES = [x.split()[0] for x in _PREFIX.split(", ")]


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
        n = np.array([len(x) for x in parts], np.int64)
        of = pa.array(np.repeat(np.arange(len(n)), n))
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rest = [b.column(c).take(of) for c in ("a", "b", "ok", "size", "n_diff", "c")]
        token = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        bits = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.int64).reshape(b.num_rows, SKETCH)[of.to_numpy()]
        sketch = [pa.array(bits[:, k]) for k in range(SKETCH)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(token, pa.int64()), pa.array(place, pa.int32()), *sketch], names=_PREFIX_NAMES)


def _far_pairs(family: DataFrame, first: DataFrame, kind: Sets) -> DataFrame:
    """Pairs (a, b) of members of large stars that may link, of which one at
    least does not link with the centre and which ``first`` leaves apart: a
    prefix join of the differences from the centre, with bounds by position and
    by parity sketches. Elements all of whose members already are of one
    component join nothing."""
    label = components(first).withColumnRenamed("node", "b").withColumnRenamed("component", "c")
    family = family.join(label, "b", "left").withColumn("c", F.coalesce("c", "b"))
    rows = materialize(family.select("a", "b", "ok", "size", "n_diff", "c", "prefix", "sketch").mapInArrow(_prefix_rows, _PREFIX))
    mixed = rows.groupBy("a", "token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("ok").alias("all_ok")).where("low <> high and not all_ok")
    mixed = materialize(mixed.select("a", "token"))
    kept = materialize(rows.join(broadcast_if_small(mixed, mixed.count()), ["a", "token"], "left_semi"))
    release(rows, mixed)
    x, y = kept.alias("x"), kept.alias("y")
    apart = (F.col("x.c") != F.col("y.c")) & ~(F.col("x.ok") & F.col("y.ok"))
    gap, total = kind.denominator - kind.numerator, kind.denominator + kind.numerator
    # twice the overlap that a link needs, times total
    need = (F.col("x.n_diff") + F.col("y.n_diff")) * total - (F.col("x.size") + F.col("y.size")) * gap
    most = F.least(F.col("x.n_diff") - F.col("x.place"), F.col("y.n_diff") - F.col("y.place"))
    bits = reduce(operator.add, [F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(SKETCH)])
    near = bits * total <= (F.col("x.size") + F.col("y.size")) * gap
    same = (F.col("x.a") == F.col("y.a")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.b") < F.col("y.b"))
    out = materialize(x.join(y, same & apart & (2 * most * total >= need) & near).select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct())
    release(kept)
    return out


def linked(buckets: DataFrame, kind: Sets) -> DataFrame:
    """Links (a, b) among the sets that share a bucket, up to components: every
    two sets of a bucket whose Jaccard similarity is numerator/denominator or
    more are connected by the result.

    ``buckets`` has (bucket, id) once each, ids of distinct sets. Each id is
    tested once against its bucket's leader, the member that shares the largest
    buckets: the text that others are copies of is in most of theirs. Two
    members that link with the leader need no test. For the others, two sets as
    close as a link differ in few elements, so their differences from the leader
    must overlap, and a prefix join of the differences finds them exactly: inside
    the task of a star where it fits there, by Spark beyond that. A second
    cluster below one leader has a leader of its own in the buckets that it does
    not share with the first one, which joins it before that prefix join.
    """
    shared = materialize(buckets)
    size = materialize(shared.groupBy("bucket").agg(F.count("*").alias("n")))
    n = size.count()
    weight = shared.join(broadcast_if_small(size, n), "bucket").groupBy("id").agg(F.sum("n").alias("w"))
    led = materialize(shared.join(weight, "id"))
    top = materialize(led.groupBy("bucket").agg(F.max(F.struct("w", F.negative("id").alias("rank"))).alias("top")))
    star = led.join(broadcast_if_small(top, n), "bucket").select("id", F.negative("top.rank").alias("a"))
    pairs = materialize(star.where("id <> a").select("a", F.col("id").alias("b")).distinct())
    release(shared, size, led, top)
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    content = materialize(kind.content(ids))
    out = materialize(tested(pairs, content, kind, True))
    first = out.where("ok").select("a", "b")
    release(pairs, ids)
    if not out.where("prefix is not null and not ok").limit(1).count():
        release(content)
        return first
    family = out.where("prefix is not null")
    open_ = family.groupBy("a").agg(F.count_if(~F.col("ok")).alias("far")).where("far > 0").select("a")
    far = _far_pairs(family.join(open_, "a", "left_semi"), first, kind)
    second = materialize(tested(far, content, kind, False))
    release(far, content)
    return first.union(second.select("a", "b"))
