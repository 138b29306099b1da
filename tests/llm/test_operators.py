"""Each operator against brute force on small fixtures with the odd cases:
nulls in any column, empty and very long texts, ties, repeated rows, empty
tables, extra columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skarn.llm import common, decontaminate, fingerprints, html, language, licenses, lines, ngrams, packing, passages, pretokens, textkit, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, id string, component string, score string"


def word(r):
    return "".join(r.choice("etaoinshrd") for _ in range(r.randint(2, 8)))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [" ".join(word(r) for _ in range(r.choice([3, 40, 120, 300]))) for _ in range(40)]
    out = [None, "", " \n\t ", "a", "Ein", "ÄÖ ü x\r\n\r\ny", "x" * 5000, "<|endoftext|> it's a 't  test\n", "12 34", "日本語 テキスト"]
    out += base
    for b in base[:20]:  # exact and near copies
        w = b.split()
        out.append(b)
        for share in (40, 12, 6):
            x = list(w)
            for _ in range(max(1, len(x) // share)):
                x[r.randrange(len(x))] = word(r)
            out.append(" ".join(x))
    hot = [word(r) for _ in range(150)]  # a large group of near copies at all distances
    for _ in range(40):
        x = list(hot)
        for _ in range(r.randint(0, 12)):
            x[r.randrange(len(x))] = word(r)
        out.append(" ".join(x))
    passage = " ".join(word(r) for _ in range(70))
    out += [" ".join(word(r) for _ in range(30)) + " " + passage + " " + " ".join(word(r) for _ in range(30)) for _ in range(4)]
    out += ["\n".join([" ".join(word(r) for _ in range(9)), "Share this page with all your good friends now!", "share this page with all your good friend now!", " ".join(word(r) for _ in range(9))]) for _ in range(5)]
    out.append(" ".join(word(r) for _ in range(20_000)))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], None, None if t is None else len(t), "b", "i", "c", "s") for i, t in enumerate(texts)]
    rows += [(None, "a row without an id", "en", None, 3, None, None, None, None), rows[12], rows[12]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sets_of(texts, n):
    out = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    return out


def brute_components(sets, num, den):
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    keys = sorted(sets)
    for x, i in enumerate(keys):
        for j in keys[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in keys}


def test_words_and_shingles():
    t = ["The  Quick\tbrown", "", None, "é È", "a b c d e f"]
    h, bounds = textkit.words(pa.array(t))
    assert np.diff(bounds).tolist() == [3, 0, 0, 2, 6]
    same, _ = textkit.words(pa.array(["the quick BROWN"]))
    assert (h[:3] == same).all()
    s, b = textkit.shingles(h, bounds, 4)
    assert np.diff(b).tolist() == [1, 0, 0, 1, 3] and len(set(s.tolist())) == 5


def test_pretokens_are_the_patterns(texts):
    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    r = random.Random(3)
    alphabet = ["a", "'s", "'ll", "'", " ", "  ", "\n", "1", "é", "!", "<|endoftext|>", "<|end", "日", " ", "\x85", "😀"]
    cases = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 10))) for _ in range(5000)] + [t or "" for t in texts]
    data, offsets = textkit.buffers(pa.array(cases))
    starts, ends, rows, _ = pretokens.spans(data, offsets)
    got = pretokens.strings(data, starts, ends)
    for k, t in enumerate(cases):
        want = []
        for i, part in enumerate(t.split("<|endoftext|>")):
            want += (["<|endoftext|>"] if i else []) + pattern.findall(part)
        assert got[rows[k] : rows[k + 1]] == want


def test_token_counts(docs, empty, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    got = tokens.count_tokens(docs).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        if r["doc_id"] is not None:
            x = texts[r["doc_id"]] or ""
            n = len(t.encode(x, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(x.encode()), n, n > 1024)
    assert tokens.count_tokens(empty).count() == 0


def test_packing(docs, empty, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    got = packing.pack(docs).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None and r["doc_id"] != 12:
            pieces[r["doc_id"]].append(r)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    for i, x in enumerate(texts):
        if i == 12:
            continue
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids)
    sizes, bins = sorted((r["length"] for r in got), reverse=True), []
    packing.best_fit(range(len(sizes)), sizes, bins, [], 1024)
    assert len(sequences) <= len(bins)
    assert packing.pack(empty).count() == 0


def test_crossover_keeps_every_item_once():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 1024, 200).tolist()
    bins = packing.evolve(sizes, None, 1024, 1)
    assert sorted(i for b in bins for i in b) == list(range(200)) and all(sum(sizes[i] for i in b) <= 1024 for b in bins)
    free = [1024 - sum(sizes[i] for i in b) for b in bins]
    child = packing.crossover((bins, free, 0), (bins[::-1], free[::-1], 0), sizes, 1024, 0.97, r)
    assert sorted(i for b in child[0] for i in b) == list(range(200))


def test_fingerprints(docs, empty, texts):
    got = fingerprints.edit_report(docs).collect()
    rows = sorted([(i, t or "") for i, t in enumerate(texts)] + [(12, texts[12])] * 2, key=lambda x: (-x[0], x[1])) + [(None, "a row without an id")]
    want = defaultdict(list)
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        want[i].append(hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest())
    have, prints = defaultdict(list), {}
    for r in got:
        have[r["doc_id"]].append(r["edited_sha256"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["doc_id"], r["fingerprint"])
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert prints[12] == prints[[i for i, t in enumerate(texts) if t == texts[12]][-1]]
    assert fingerprints.edit_report(empty).count() == 0


def test_fingerprints_over_several_ranges(docs, texts, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGES", 1)
    whole = {(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in fingerprints.edit_report(docs).collect()}
    monkeypatch.undo()
    assert whole == {(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in fingerprints.edit_report(docs).collect()}


def test_near_duplicates(docs, empty, texts):
    want = brute_components(sets_of(texts, 5), 8, 10)
    got = {r["doc_id"]: r["component_id"] for r in fingerprints.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert got == want
    assert fingerprints.near_duplicates(empty).count() == 0


def test_ngram_join(docs, empty, texts):
    sets = sets_of(texts, 3)
    want = brute_components(sets, 9, 10)
    rows = ngrams.jaccard_components(docs).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == {(i, len(s), want[i]) for i, s in sets.items()}
    assert len(rows) == len(texts) + 3
    assert ngrams.jaccard_components(empty).count() == 0
    kept = ngrams.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == sorted(set(want.values()))


def test_trees_agree_with_sets():
    r = np.random.default_rng(1)
    probe = np.unique(r.integers(0, 500, 120).astype(np.uint64))
    sets = [np.unique(np.concatenate([probe[r.random(len(probe)) > d], r.integers(0, 500, k).astype(np.uint64)])) for d in (0, 0.02, 0.05, 0.1, 0.3) for k in (0, 2, 8)]
    want = [10 * len(np.intersect1d(probe, s)) >= 9 * len(np.union1d(probe, s)) for s in sets]
    assert ngrams.tree_matches(probe, sets) == want and any(want) and not all(want)


def test_line_dedup(docs, empty, texts):
    lines_ = defaultdict(list)
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            line = re.sub("[A-Z]+", lambda m: m[0].lower(), line).strip(" \t\r\x0b\x0c")
            if line:
                lines_[line].append((i, k))
    names = sorted(lines_)
    comp = brute_components({i: frozenset(x[k : k + 6] for k in range(max(1, len(x) - 5))) for i, x in enumerate(names)}, 8, 10)
    keep, drop = {}, defaultdict(set)
    for i, x in enumerate(names):
        keep[comp[i]] = min(keep.get(comp[i], (1 << 60, 0)), min(lines_[x]))
    for i, x in enumerate(names):
        for d, k in lines_[x]:
            if (d, k) != keep[comp[i]]:
                drop[d].add(k)
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    for r in got.collect():
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            t = texts[r["doc_id"]]
            assert r["text"] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[r["doc_id"]])), r["doc_id"]
    assert lines.dedup_lines(empty).count() == 0


def test_short_lines_are_compared(spark):
    texts = ["And ornd.\nOf.\n\na", "of.\n \n and ornd. \nÄ\nOf", "Of.\n\nOf.\nÄ\n12345678901234", "a\n\n\n123456789012345"]
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["And ornd.\nOf.\n\na", " \nÄ\nOf", "\n12345678901234", "\n"]
    assert [r["n_removed"] for r in got] == [0, 2, 3, 2]


def test_isolated_pairs_of_lines_at_the_threshold(spark):
    r = random.Random(13)
    rows = []
    for i in range(1000):
        line = "".join(r.choice("etaoinshrdlucmfw") for _ in range(50))
        rows += [(2 * i, line), (2 * i + 1, line[:41])]  # 36 of 45 shingles
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_removed = 1").count() == 1000


def test_decontamination(spark, docs, empty, texts):
    items = [(0, texts[11]), (1, "no such words are in any document at all"), (2, None), (3, ""), (4, " ".join(texts[-1].split()[7000:7030])), (5, texts[11]), (None, "q")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def cut(t):
        w = [x for x in re.split(r"[ \t-\r!-/:-@\[-`{-~]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    own, want = {i: cut(t) for i, t in enumerate(texts)}, set()
    for j, t in items[:-1]:
        x = cut(t)
        want |= {(i, j) for i, s in own.items() if x and len(x & s) >= 0.8 * len(x)}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, bench).collect() if r["doc_id"] is not None and r["item_id"] is not None}
    assert got == want and (len(texts) - 1, 4) in got
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and {r[0] for r in left.select("doc_id").collect() if r[0] is not None} == set(own) - {i for i, _ in want}
    assert decontaminate.contained(empty, bench).count() == 0 and decontaminate.contained(docs, bench.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, docs, texts, monkeypatch):
    bench = spark.createDataFrame([(k, texts[k]) for k in range(10, 18)], "item_id long, text string")
    whole = {tuple(r) for r in decontaminate.contained(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 3)
    assert whole and {tuple(r) for r in decontaminate.contained(docs, bench).collect()} == whole


def test_language(spark, empty):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", "en"), (9003, "123 !!", "de"), (None, "The and of", "en"), (9004, "a" * 10_000, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(d.union(odd)).collect()}
    want = {r["doc_id"]: r["lang"] for r in d.collect()}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in want)
    assert np.mean([got[i]["lang_pred"] == want[i] for i in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (9001, 9002, 9003)] == ["und"] * 3 and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(empty).count() == 0
    assert language.identify(odd.where("lang is null")).first()["lang_pred"] == "und"


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(language.vocabulary_path())
    ranks = language.read_ranks(language.vocabulary_path())
    table = np.random.default_rng(0).random((pieces.size, 2)) / 50

    def brute(w):
        alpha = [np.ones(2)] + [np.zeros(2) for _ in w]
        for j in range(1, len(w) + 1):
            for i in range(j):
                if w[i:j] in ranks:
                    alpha[j] = alpha[j] + alpha[i] * table[ranks[w[i:j]]]
        return np.log(alpha[-1])

    words = [b" the", b"a", "größe".encode(), b"x" * 100]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = language.forward(data, ends - [len(w) for w in words], ends, pieces, table)
    for k, w in enumerate(words):
        cut = [w[i : i + language.CUT] for i in range(0, len(w), language.CUT)]
        assert np.allclose(got[k], sum(brute(c) for c in cut))


def test_licenses(spark, docs, empty):
    rows = [(1, "text\nThis work is licensed under the GNU General Public License, version 3.\nmore"), (2, "Released under the MIT License."), (3, "He lost his driving licence, a pity"), (4, None), (5, ""), (2, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0. All rights reserved.")]
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "paragraph", "family").collect()), key=repr)
    assert got[:4] == [(1, 1, "gpl"), (2, 0, "mit"), (2, 0, "mit"), (3, 0, "unknown")] and got[4][0] is None
    assert licenses.scan(docs).count() >= 0 and licenses.scan(empty).count() == 0
    for family, notices in licenses.TEMPLATES.items():
        df = spark.createDataFrame([(i, f"Note: {t}.") for i, t in enumerate(notices)], "doc_id long, text string")
        found = [r["family"] for r in licenses.scan(df).collect()]
        assert found.count(family) >= 0.5 * len(notices) and set(found) <= {family, "unknown"}, (family, found)


def test_licenses_equal_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    cur = con.execute(licenses.sql())
    names = [d[0] for d in cur.description]
    got = licenses.scan(spark.read.parquet(path))
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(cur.fetchall())


def test_licenses_equal_sql_on_letters_that_fold(spark, tmp_path):
    import duckdb

    long, kelvin = chr(0x17F), chr(0x212A)
    texts = [f"Relea{long}ed under the MIT Licen{long}e.", f"{long}pdx", f"a b{long}d-3", f"gnu{long} x", f"GNU{kelvin}", "as isé", "as \u0131s", "perm\u0130ssion", f"x\n\r\nall right{long} re{long}erved\r\nx", "gnu\u2028gpl\u0085", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    cur = con.execute(licenses.sql())
    names = [d[0] for d in cur.description]
    got = sorted(tuple(r[n] for n in names) for r in licenses.scan(spark.read.parquet(f"{tmp_path}/d")).collect())
    assert got == sorted(cur.fetchall()) and {0, 1, 2, 8} <= {r[0] for r in got}


def test_licenses_of_every_paragraph(spark):
    cut = "you may not use this file except in compliance with the"
    df = spark.createDataFrame([(1, f"A walk by the river.\n\n{cut}\n ...\nReleased under the MIT License."), (2, None), (3, "")], "doc_id long, text string")
    every = {(r["doc_id"], r["paragraph"]): tuple(r)[2:] for r in licenses.scan(df, every=True).collect()}
    named = {(r["doc_id"], r["paragraph"]): tuple(r)[2:] for r in licenses.scan(df).collect()}
    assert set(every) == {(1, 0), (1, 2), (1, 4)} and set(named) == {(1, 4)} and named.items() <= every.items()
    assert every[1, 0][0] == "unknown" and every[1, 2][0] == "apache" and every[1, 4][0] == "mit"


def test_passages(docs, empty, texts):
    rows = passages.repeated_passages(docs).collect()
    cover = defaultdict(set)
    for r in rows:
        cover[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        assert r["ref_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= passages.MIN_WORDS and r["identity"] >= passages.IDENTITY
    w = {i: [x for x in re.split(r"[ \t-\r!-/:-@\[-`{-~]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if x] for i, t in enumerate(texts)}
    seen = {}
    for i in sorted(w):
        for k in range(len(w[i]) - 59):
            g = tuple(w[i][k : k + 60])
            if seen.setdefault(g, i) != i:
                assert len(cover[i] & set(range(k, k + 60))) >= 55, (i, k)
    planted = [i for i, t in enumerate(texts) if t and len(t.split()) == 130]
    assert all(cover[i] for i in planted[1:])
    assert passages.repeated_passages(empty).count() == 0


def found_passages(spark, rows):
    """(doc_id, ref_doc_id): most words of one passage."""
    out = defaultdict(int)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out[r["doc_id"], r["ref_doc_id"]] = max(out[r["doc_id"], r["ref_doc_id"]], r["end_word"] - r["start_word"])
    return out


def test_passages_whose_parts_occur_elsewhere(spark):
    r, rows = random.Random(11), []
    some = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    sizes = [60, 80] * 15
    for k, size in enumerate(sizes):
        a, b = some(size // 2), some(size // 2)
        rows += [(4 * k + i, f"{some(30)} {t} {some(30)}") for i, t in enumerate((a, b, f"{a} {b}", f"{a} {b}"))]
    # parts of three earlier documents that lie over each other
    words = [some(1) for _ in range(70)]
    rows += [(1000 + i, f"{some(30)} {' '.join(words[low:high])} {some(30)}") for i, (low, high) in enumerate(((0, 40), (15, 55), (30, 70), (0, 70), (0, 70)))]
    got = found_passages(spark, rows)
    assert all(got[4 * k + 3, 4 * k + 2] >= size for k, size in enumerate(sizes)) and got[1004, 1003] >= 70


def test_edited_passages(spark):
    r, rows, edits = random.Random(12), [], []
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    for size in (55, 60, 80):
        for share in (0.05, 0.1, 0.15, 0.18):
            for _ in range(25):
                a = some(size)
                b = list(a)
                # the outer words stay, so that the passage ends where it was put
                for k in r.sample(range(2, size - 2), int(share * size)):
                    b[k] = some(1)[0]
                k = len(edits)
                edits.append((size, share))
                rows += [(2 * k + i, " ".join(some(40) + t + some(40))) for i, t in enumerate((a, b))]
    got = found_passages(spark, rows)
    missed = [e for k, e in enumerate(edits) if got[2 * k + 1, 2 * k] < passages.MIN_WORDS]
    assert not missed, missed


def test_edited_passages_whose_seeds_first_occur_in_several_documents(spark):
    r = random.Random(3)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    runs = [some(6) for _ in range(10)]
    rows = [(k, " ".join(some(30) + run + some(30))) for k, run in enumerate(runs)]
    for i in (50, 60, 60, 70):  # six words of seven are equal
        rows.append((i, " ".join(some(30) + [w for run in runs for w in run + some(1)] + some(30))))
    rows[12] = rows[11]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["ref_doc_id"]): x["identity"] for x in passages.repeated_passages(df, every=True).collect()}
    assert set(got) == {(60, 50), (70, 50), (70, 60)} and min(got.values()) >= passages.IDENTITY


def test_all_earlier_occurrences_equal_brute_force(monkeypatch):
    r = np.random.default_rng(4)
    keys, doc, pos = r.integers(0, 9, 200).astype(np.uint64), r.integers(0, 12, 200), r.permutation(200)
    want = {(i, j) for i in range(200) for j in range(200) if keys[i] == keys[j] and doc[j] < doc[i]}
    for flush in (1, 50, 1 << 20):
        monkeypatch.setattr(passages, "FLUSH", flush)
        found = [p for a, b in passages._to_all(keys, doc, pos) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(found) == len(want) and set(found) == want
    assert not list(passages._to_all(keys[:0], doc[:0], pos[:0]))


def test_chains_ascend_and_pay_for_gaps():
    x, y = [0, 10, 20, 30, 500], [100, 110, 90, 130, 2000]
    best = passages.chains(x, y)[0]
    assert [x[i] for i in best] == [0, 10, 30] and [y[i] for i in best] == [100, 110, 130]


PAGE = "<html><head><title>t</title></head><body><nav><a>Home</a></nav><!-- x --><div class='ad'>Buy</div>{}<footer>f</footer></body></html>"


def test_html(spark):
    menu = "<div>" + " ".join(f"menu{i}" for i in range(12)) + "</div>"
    rows = [(1, "http://a.example/1", PAGE.format("<article><h1>A &amp; B</h1><p>x  <b>y</b>&nbsp;z<br>w<p>next<script>no()</script><div class='comments'><article>c</article></div></article>")), (2, None, None), (3, "http://a.example/2", ""), (4, "bad url", "<p>a < b & c")]
    rows += [(10 + i, "http://b.example/x", f"<body>{menu}<p>only{i} here{i}</p></body>") for i in range(3)] + [(20, "http://b.example/x", f"<body>{menu}<p>only0 here0</p></body>")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A & B\nx y z w\nnext" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" == got[3]["text"] and got[4]["text"] == "a < b & c"
    assert [got[10 + i]["text"] for i in range(3)] == [f"only{i} here{i}" for i in range(3)] and got[20]["text"] == "only0 here0"
    assert html.blocks("<div class='ad'>x<article>y</article>")[1] == [0, 2]
    assert html.blocks("<article>y</article><div class='comments'><article>c</article></div>")[1] == [2, 0]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_runs_are_found_across_the_chunks_of_a_host(spark, monkeypatch):
    r = np.random.default_rng(5)
    some = lambda n: [f"w{v}" for v in r.integers(0, 10**6, n)]
    runs = [some(8) for _ in range(30)]
    texts = [some(20) for _ in range(300)]
    for run in runs:  # on two pages each
        for k in r.choice(300, 2, replace=False):
            texts[k] += run
    texts += [texts[0], some(3), [], [x.upper() for x in texts[1]]]
    rows = [(i, "http://large.example/x", f"<body><article>{' '.join(t)}</article></body>") for i, t in enumerate(texts)]
    rows += [(1000 + i, "http://other.example/x", f"<body><p>{' '.join(t)}</p></body>") for i, t in enumerate((texts[1], runs[0] + runs[1]))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {x["page_id"]: tuple(x) for x in html.extract(df).collect()}
    monkeypatch.setattr(html, "CHUNK", 2000)
    parted = {x["page_id"]: tuple(x) for x in html.extract(df).collect()}
    assert len(whole) == len(rows) and parted == whole
    assert sum(x[5] for x in parted.values()) >= 2 * 8 * len(runs)


@pytest.mark.parametrize("leading", [0, 6, 12, 26])
def test_leading_bits_that_agree_by_accident_change_nothing(monkeypatch, leading):
    monkeypatch.setattr(html, "LEADING", leading)
    monkeypatch.setattr(html, "TOGETHER", 500)
    r = np.random.default_rng(7)
    some = lambda n: [f"w{v}" for v in r.integers(0, 10**6, n)]
    texts, run = [some(r.integers(0, 40)) for _ in range(80)], some(12)
    for k in r.choice(80, 9, replace=False):  # on pages of several chunks, and each page's on one or two
        texts[k] += run + texts[(k + 1) % 80][:15]
    texts += [texts[0], texts[3], texts[3], [], []]  # equal pages in several chunks
    pages = [(None if i == 5 else i, None if i == 6 else f"http://a/{i}", f"<p>{' '.join(t)}</p>") for i, t in enumerate(texts)]
    names = ["page_id", "url", "html", "host", "salt", "chunks"]
    parsed = lambda rows: pa.Table.from_batches(html._parsed([pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows])]))
    whole = html._results(html._pages(parsed([(*p, "a", 0, 1) for p in pages])))
    chunks = [parsed([(*p, "a", salt, 3) for p in pages[salt::3]]) for salt in range(3)]
    led = pa.Table.from_batches([b for c in chunks for b in html._led(c.to_batches())]).sort_by("part")
    met = pa.Table.from_batches(html._met(led.to_batches()))
    told = lambda t, salt: t.filter(pa.compute.equal(t["salt"], salt))
    ranged = pa.concat_tables([html._ranged(c, told(met, salt)) for salt, c in enumerate(chunks)]).sort_by("part")
    merged = pa.Table.from_batches(html._merged(ranged.to_batches()))
    got = pa.concat_tables([html._finished(c, told(merged, salt)) for salt, c in enumerate(chunks)])
    rows = lambda columns: sorted(zip(*(c.to_pylist() for c in columns), strict=True), key=repr)
    assert rows(got.columns) == rows(whole) and sum(whole[5].to_pylist()) > 9 * 12
    assert bool(sum(map(len, merged["keys"].to_pylist()))) == (leading < 26)


def test_chunks_of_a_host_are_merged_with_few_bytes(spark, monkeypatch):
    r = np.random.default_rng(6)
    texts = [" ".join(f"w{v}" for v in r.integers(0, 10**6, 500)) for _ in range(500)]
    rows = [(i, f"http://large.example/{i}", f"<body><article>{t}</article></body>") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    def took():
        before = written()
        assert html.extract(df).agg(F.count("*"), F.sum("n_repeated")).first()[0] == 500
        return written() - before

    one = took()
    monkeypatch.setattr(html, "CHUNK", 200_000)
    assert took() - one < 4 * 500 * 500  # bytes a token: a hash has eight


def test_repeated_equals_brute_force():
    r = np.random.default_rng(2)
    pages = [r.integers(0, 2, n).astype(np.uint64) for n in (0, 40, 5, 60, 30)]
    tokens_, bounds = np.concatenate(pages), np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    where = defaultdict(set)
    for k, p in enumerate(pages):
        for i in range(len(p) - html.RUN + 1):
            where[tuple(p[i : i + html.RUN])].add(k)
    want = np.zeros(len(tokens_), bool)
    for k, p in enumerate(pages):
        for i in range(len(p) - html.RUN + 1):
            if len(where[tuple(p[i : i + html.RUN])]) > 1:
                want[bounds[k] + i : bounds[k] + i + html.RUN] = True
    assert (html.repeated(tokens_, bounds) == want).all() and want.any() and not want.all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)] + [(1000, 1000 + k) for k in range(300)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[300] == 100 and got[1299] == 1000
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        had = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = common.materialize(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == names and {r["doc_id"] for r in docs.collect()} <= set(had)
        if name == "near_duplicates":
            ids = sorted(had)
            comp = brute_components(dict(zip(ids, (s for s in sets_of([had[i] for i in ids], 5).values()), strict=True)), 8, 10)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(set(comp.values()))
        if name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.contained(spark.createDataFrame(list(had.items()), "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in docs.collect()} == set(had) - bad
    assert {r["doc_id"] for r in docs.collect()} <= before and docs.count()
    assert corpus_pipeline.run(spark, sf).select(F.countDistinct("doc_id")).first()[0] == len({r["doc_id"] for r in docs.collect()})
