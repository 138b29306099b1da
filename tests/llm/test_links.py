"""Hashes, trees and links between sets against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skarn.llm import common, language, licenses, lines, ngrams, packing, textkit, tokens


def thue_morse(k):
    text = "a"
    for _ in range(k):
        text += text.translate({97: 98, 98: 97})
    return text, text.translate({97: 98, 98: 97})


@pytest.mark.parametrize("k", [3, 6, 10, 12])
def test_words_of_a_known_structure_differ(k):
    a, b = thue_morse(k)
    h, _ = textkit.words(pa.array([a, b, a]))
    assert h[0] != h[1] and h[0] == h[2]


def test_ids_of_words_of_a_known_structure():
    from tokenizers import Tokenizer

    texts = list(thue_morse(10))
    ids, bounds = tokens.document_ids(pa.array(texts), tokens.tokenizer_path())
    whole = Tokenizer.from_file(tokens.tokenizer_path())
    assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_shingles_and_sets_of_rows():
    r = np.random.default_rng(0)
    for n in (1, 3, 6):
        count = r.integers(0, 9, 40)
        bounds = np.concatenate([[0], np.cumsum(count)])
        words = r.integers(0, 4, bounds[-1]).astype(np.uint64)
        h, out = textkit.shingles(words, bounds, n)
        name = {}
        for row, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            runs = [tuple(words[i : i + n].tolist()) for i in range(x, max(x + (y > x), y - n + 1))] if y - x >= n else [tuple(words[x:y].tolist())][: int(y > x)]
            assert out[row + 1] - out[row] == len(runs)
            for run, v in zip(runs, h[out[row] : out[row + 1]].tolist(), strict=True):
                assert name.setdefault(run, v) == v
        assert len(set(name.values())) == len(name)
        assert all((np.unique(h[x:y]) == s).all() for x, y, s in zip(out[:-1], out[1:], textkit.row_sets(h, out), strict=True))


def test_dead_subtrees_are_not_walked():
    r = np.random.default_rng(3)
    probe = np.unique(r.integers(1 << 20, 1 << 40, 2000).astype(np.uint64))
    sets = [np.concatenate([probe[:100], np.unique(r.integers(1 << 41, 1 << 42, 1900).astype(np.uint64))]) for _ in range(200)]
    seen: list[int] = []
    assert ngrams.tree_matches(probe, sets, looked_up=seen) == [False] * 200
    assert sum(seen) < 20_000  # of 400,000 elements


def test_long_lines_meet():
    """Pairs at the threshold among lines whose shingles are dealt into parts."""
    r = random.Random(4)
    pairs = []
    for _ in range(300):
        n = r.randrange(110, 400)  # also lines on both sides of the split
        line = "".join(r.choice("etaoinshrdlucmfw ") for _ in range(n))
        cut = (n - 5) * 4 // 5 + 5  # four fifths of the shingles
        pairs.append((line, line[: cut + 1]))
    flat = [x.encode() for p in pairs for x in p]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int64()), pa.array(flat, pa.binary())], names=["id", "line"])
    met: dict[int, set] = {}
    for keys, ids in lines._entries(iter([rows])):
        for k, i in zip(keys.tolist(), ids.tolist(), strict=True):
            met.setdefault(k, set()).add(i)
    together = {i // 2 for ids in met.values() for i in ids if i ^ 1 in ids}
    assert len(together) >= 299


def test_words_of_any_length_are_scored_whole():
    path = language.vocabulary_path()
    ranks, pieces = language.read_ranks(path), language.Pieces(path)
    table = np.random.default_rng(1).random((pieces.size, 2)) * 1e-2
    for word in ("wissenschaftlich" * 5, "東京都港区" * 9, "x" * 400):
        w = word.encode()
        sums = [np.ones(2)] + [np.zeros(2) for _ in w]
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - pieces.longest), j):
                if (p := ranks.get(w[i:j])) is not None:
                    sums[j] = sums[j] + sums[i] * table[p]
        with np.errstate(divide="ignore"):
            want = np.log(sums[-1])
        got = language.forward(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), pieces, table)[0]
        assert not np.isfinite(want).all() or np.allclose(got, want)


def test_every_template_names_a_licence():
    assert [t for ts in licenses.TEMPLATES.values() for t in ts if not re.search(licenses.ANCHOR, t, re.I)] == []


def test_one_id_with_several_texts(spark):
    r = random.Random(9)
    a, b = (" ".join(f"w{r.randrange(10**6)}" for _ in range(100)) for _ in range(2))
    rows = [(5, a), (5, b), (1, b + " more"), (7, a)]
    want = {(5, 5), (5, 1), (1, 1), (7, 5)}
    for order in (rows, rows[::-1]):
        got = ngrams.jaccard_components(spark.createDataFrame(order, "doc_id long, text string").coalesce(1))
        assert {(x["doc_id"], x["component_id"]) for x in got.collect()} == want


def test_stars_that_fit_no_task(spark, monkeypatch):
    """A large group of copies of one text, and chains off it, in stars of few members."""
    monkeypatch.setattr(common, "STAR", 8)
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        x = list(base)
        for _ in range(r.randrange(9)):
            x[r.randrange(len(x))] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(x))
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if v in (x, y) else v for v in root]
    got = ngrams.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {x["doc_id"]: x["component_id"] for x in got.collect()} == dict(enumerate(root))


def test_crossover_saves_sequences_where_best_fit_does_not():
    r = np.random.default_rng(0)
    sizes = r.integers(330, 361, 3000).tolist()
    bins, free = [], []
    packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, bins, free, 1024)
    assert len(packing.evolve(sizes, None, 1024, 1)) < len(bins)


def test_keys_of_a_part_survive_their_bytes():
    part = np.uint64(7) << np.uint64(8 * common.KEY_BYTES)
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 32, 20_000, dtype=np.uint64)) + part
    for some in (keys, keys[:1], keys[:0], np.repeat(keys[:3], 4)):
        assert (common._keys(7, common._short(some)) == some).all()


def test_ids_are_new_once():
    rng, held, seen = np.random.default_rng(2), [], set()
    for _ in range(50):
        ids = rng.integers(0, 3000, 200, dtype=np.uint64)
        new = lines.first_seen(ids, held)
        for x, is_new in zip(ids.tolist(), new.tolist(), strict=True):
            assert is_new == (x not in seen)
            seen.add(x)
    assert lines.first_seen(ids[:0], held).tolist() == [] and len(held) < 10


@pytest.mark.parametrize("size", [3, 200])
def test_sets_of_rows_are_those_of_sorting_each_row(size):
    rng = np.random.default_rng(size)
    bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 2 * size, 300))])
    h = rng.integers(0, 1 << 63, bounds[-1], dtype=np.uint64)
    h[::5] = h[0]
    got = textkit.row_sets(h, bounds)
    assert len(got) == 300 and all((g == np.unique(h[x:y])).all() for g, x, y in zip(got, bounds[:-1], bounds[1:], strict=True))
