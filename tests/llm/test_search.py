"""Near-duplicates, repeats, top-k, toxicity and the pipeline against brute force."""

import hashlib
import random
import sys
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import passages, simhash, suffix, topk, toxicity
from matchloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], DOCS).withColumns({"id": F.lit(1), "fp": F.lit(2), "run": F.lit(3), "node": F.lit(4), "row": F.lit(5), "toxic_score": F.lit(6)})


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(x) for x in range(n)]


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", lower) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(seed=5, n=160):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("alpha beta Gamma é delta eps zeta eta".split()) for _ in range(rnd.randrange(1, 90))) for _ in range(20)]
    texts = [None, "", " \t", "one", "One"]
    for _ in range(n):
        w = rnd.choice(base).split()
        if rnd.random() < 0.7:
            w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return [*texts, "long " * 30000]


@pytest.mark.parametrize("tile", [4096, 6])
def test_simhash_is_brute_force(spark, tile):
    texts = near_texts()
    docs = documents(spark, list(enumerate(texts)))
    docs = docs.union(docs.where("doc_id = 7"))
    got = {r.id: r for r in simhash.near_duplicates(docs, tile=tile).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == fps
    want = components(len(fps), [(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert [got[i].component for i in range(len(texts))] == want
    assert len(set(want)) < len(want) - 20


def test_simhash_report_and_deduplicate(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (2, "quite another text altogether"), (2, "quite another text altogether"), (None, "a b c d"), (None, "no id")]
    docs = documents(spark, rows)
    out = {r.doc_id: r for r in simhash.report(docs.where("doc_id is not null")).collect()}
    assert out[3].component_id == 1 and len(out[3].fingerprint) == 16 and int(out[3].fingerprint, 16) == slow_fingerprint("a b c d")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a b c d"), ("2", "quite another text altogether"), ("None", "no id")]
    assert simhash.report(docs.limit(0)).count() == 0


def test_simhash_tiles_are_skipped_by_population_count():
    rnd = np.random.default_rng(1)
    fps = np.unique(rnd.integers(0, 1 << 63, 3000).astype(np.uint64))
    near = fps[:500] ^ (np.uint64(1) << rnd.integers(0, 64, 500).astype(np.uint64))
    fps = np.unique(np.concatenate((fps, near)))
    compared = []
    a, b = simhash.forest(fps, compared=compared)
    every = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    want = components(len(fps), [(int(i), int(j)) for j, i in zip(*np.nonzero(np.tril(every, -1)), strict=True)])
    assert components(len(fps), list(zip(a.tolist(), b.tolist(), strict=True))) == want
    assert sum(compared) < 0.45 * len(fps) * (len(fps) - 1) / 2 * 2


def test_many_values_are_filed_without_loss():
    rnd = np.random.default_rng(0)
    for n in (10, 1 << 23, 1 << 32):
        masks = [m & (1 << 64) - 1 for m in simhash._masks(n, 3)]
        for _ in range(300):
            x = int(rnd.integers(0, 1 << 63))
            y = x
            for b in rnd.choice(64, 3, replace=False):
                y ^= 1 << int(b)
            assert any(x & m == y & m for m in masks)


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200, 202: 200}


def brute_repeats(rows, length):
    first, out = {}, []
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if i is not None and first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "gram", "seed"), [(12, 5, 1), (12, 5, 2), (50, 20, 3)])
def test_repeats_are_brute_force(spark, length, gram, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abé\0", k=length * 3)) for _ in range(4)] + ["x" * 200]
    rows = []
    for i in range(70):
        t = "".join(rnd.choice(base)[rnd.randrange(length) : rnd.randrange(length, length * 3)] for _ in range(rnd.randrange(6)))
        rows.append((rnd.randrange(60), t))
    rows += [(99, None), (98, ""), (None, base[0]), (None, base[0]), (1000, base[1] * 300)]
    got = suffix.remove_repeats(documents(spark, rows), length=length, gram=gram, run_bytes=2000, keep_bytes=False)
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats([(i, (t or "").encode()) for i, t in rows], length)


def test_kept_bytes_and_empty_tables(spark):
    docs = documents(spark, [(1, "y" * 60), (2, "before " + "y" * 60 + " after")])
    kept = {r.id: bytes(r.kept) for r in suffix.remove_repeats(docs).collect()}
    assert kept == {1: b"y" * 60, 2: b"before  after"}
    assert suffix.report(docs.limit(0)).count() == 0


def test_the_merge_is_a_sort():
    rnd = random.Random(0)
    runs = [sorted("".join(rnd.choices("ab", k=8)).encode() for _ in range(rnd.randrange(30))) for _ in range(7)]
    share = lambda x, y: next((i for i in range(8) if x[i] != y[i]), 8)
    commons = [[0] + [share(x, y) for x, y in zip(r, r[1:], strict=False)] for r in runs]
    source, common = suffix.merge(runs, commons, 8)
    heads = [0] * 7
    out = []
    for s in source:
        out.append(runs[s][heads[s]])
        heads[s] += 1
    assert out == sorted(x for r in runs for x in r) and common[1:] == [share(x, y) for x, y in zip(out, out[1:], strict=False)]


def test_topk_is_brute_force(spark):
    rnd = np.random.default_rng(1)
    vectors = [(i, (rnd.normal(size=8) * rnd.choice([0.1, 1, 3])).tolist()) for i in range(400)]
    vectors += [(i, vectors[3][1]) for i in range(400, 430)]
    vectors += [(500, None), (550, [1.0, None]), (600, [float("nan")]), (650, [float("inf"), 0.0]), (700, [1.0, 2.0]), (750, []), (None, [1.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "len": F.lit(3)})
    table = table.union(table.where("vec_id = 50"))
    fine = {i: [int(np.floor(256.0 * float(np.float32(x)))) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    pad = lambda v: v + [0] * (8 - len(v))
    want = set()
    for q in (i for i in fine if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(pad(fine[q]), pad(v), strict=True)), i) for i, v in fine.items() if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])}
    assert set(map(tuple, topk.report(table).collect())) == want
    rows = topk.whole_vectors(table, "vec_id", "embedding")
    small = topk.search(rows.where("id % 50 = 0"), rows, 5, block=16, query_block=2)
    assert set(map(tuple, small.collect())) == want
    assert topk.report(table.limit(0)).count() == 0
    few = topk.report(spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 65536)]


def test_topk_reads_files_of_any_order(spark):
    # Short vectors fill more bytes than long ones, so that their files come first in a read partition.
    rnd = np.random.default_rng(3)
    vectors = [(i, rnd.normal(size=8).tolist()) for i in range(600)]
    vectors += [(i, [float(np.exp(rnd.normal()) * 40)] + [0.0] * 7) for i in range(600, 1000)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = {i: np.floor(256 * np.array(v)) for i, v in vectors}
    want = set()
    for q in range(0, 1000, 25):
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])}
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        rows = topk.whole_vectors(table, "vec_id", "embedding")
        got = topk.search(rows.where("id % 25 = 0"), rows, 5, block=64)
        assert set(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_passages_find_what_repeats(spark):
    rnd = random.Random(4)
    words = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    shared, other = words(70), words(80)
    near = list(other)
    near[40] = "changed"
    line = words(12)
    texts = [words(90) + shared + words(40), words(30) + shared + words(200), other, words(60) + near, line + words(100), line + words(100), words(300), None, "", "short", shared[:40] + words(80), words(20000)]
    rows = [(i, t if t is None or isinstance(t, str) else " ".join(t)) for i, t in enumerate(texts)]
    docs = documents(spark, [*rows, (50, rows[2][1].upper()), (51, rows[2][1]), (None, rows[2][1])])
    got = {r.doc_id: r for r in passages.report(docs).collect()}
    assert got[1].class_id == 0 and got[0].n_links == 1 and got[1].word == 30
    assert {got[i].class_id for i in (2, 3, 50, 51)} == {2}
    assert all(got[i].class_id == i and got[i].n_links == 0 for i in (4, 5, 6, 7, 8, 9, 10, 11)) and got[None].class_id is None
    assert passages.report(docs.limit(0)).count() == 0


def test_passages_survive_lower_ids_that_quote_a_part(spark):
    rnd = random.Random(6)
    words = lambda n: [f"w{rnd.randrange(50000)}" for _ in range(n)]
    passage = words(60)
    texts = [words(60) + passage[:40] + words(60), words(60) + passage[-40:] + words(60), *(words(30 + i) + passage + words(30) for i in range(8))]
    got = {r.doc_id: r.class_id for r in passages.report(documents(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert got == {0: 0, 1: 1} | {i: 2 for i in range(2, 10)}


def test_passages_between_pieces_of_themselves(spark):
    # 60 pairs with an equal passage of 80 words, beside three lower ids with 40 words of each: nothing may stand in their way.
    rnd = random.Random(7)
    words = lambda n: [f"w{rnd.randrange(50000)}" for _ in range(n)]
    passages_ = [words(80) for _ in range(60)]
    texts = []
    for begin in (0, 20, 40):
        for piece in (passages_[:20], passages_[20:40], passages_[40:]):
            texts.append([w for p in piece for w in words(25) + p[begin : begin + 40]] + words(25))
    pieces = len(texts)
    texts += [words(30) + p + words(30) for p in passages_ for _ in (0, 1)]
    got = {r.doc_id: r.class_id for r in passages.report(documents(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert got == {i: i for i in range(pieces)} | {pieces + k: pieces + k - k % 2 for k in range(120)}


@pytest.mark.parametrize("near", [False, True])
def test_passages_behind_many_holders_of_their_keys(spark, near):
    # 16 pairs that share 50 words, or 56 but for one. 18 lower ids have 40 words of each, so that all keys have more holders than there are rounds of roots.
    rnd = random.Random(10)
    words = lambda n: [f"w{rnd.randrange(500000)}" for _ in range(n)]
    passages_ = [words(56 if near else 50) for _ in range(16)]
    texts = [words(25) + p[begin : begin + 40] + words(25) for p in passages_ for begin in ((0, 8, 16) if near else (0, 5, 10)) for _ in range(6)]
    lower = len(texts)
    texts += [words(25) + (p[:28] + ["changed"] + p[29:] if near and k else p) + words(25) for p in passages_ for k in (0, 1)]
    got = {r.doc_id: r.class_id for r in passages.report(documents(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert got == {i: i for i in range(lower)} | {lower + k: lower + k - k % 2 for k in range(32)}


def test_first_shingles_lose_no_similar_pair():
    # Any two windows that are alike share a place that both mark, in one order of all shingles.
    rnd = np.random.default_rng(11)
    width, least, links = 10, 0.8, 0
    for _ in range(60):
        x = rnd.integers(0, rnd.choice([8, 30, 200]), 24)
        y = np.concatenate((rnd.integers(0, 200, 6), x[4:20], rnd.integers(0, 200, 6)))
        for place in rnd.integers(0, len(y), 2):
            y[place] = rnd.integers(0, 200)
        ranked = np.array([int(rnd.integers(2, 9)) << 32 | int(v) for v in np.intersect1d(x, y)], np.int64)
        if not len(ranked):
            continue
        for i in range(len(x) - width + 1):
            for j in range(len(y) - width + 1):
                p, q = set(x[i : i + width].tolist()), set(y[j : j + width].tolist())
                if len(p & q) >= least * len(p | q):
                    links += 1
                    one, two = ({int(h[at]): int(m) for at, m in zip(*passages.first_shingles(h, np.array([k]), ranked, width, least), strict=True)} for h, k in ((x, i), (y, j)))
                    assert any(one[s] & two[s] & 2 or (one[s] | two[s]) & 4 for s in one.keys() & two.keys())
    assert links > 100


def brute_passages(texts, words=50, shingle=5, least=0.8):
    """Links by their definition, along each diagonal and those near it."""
    sets = [t.split() for t in texts]
    grams = [[tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] for w in sets]
    width, found = words - shingle + 1, []
    for b in range(len(grams)):
        for a in range(b):
            x, y = grams[a], grams[b]
            if any(len(p := set(x[i : i + width])) and len(p & (q := set(y[j : j + width]))) >= least * len(p | q) for i in range(len(x) - width + 1) if not set(x[i : i + width]).isdisjoint(y) for j in range(len(y) - width + 1)):
                found.append((a, b))
    return found


def test_passage_links_are_brute_force(spark):
    rnd = random.Random(8)
    words = lambda n: [f"v{rnd.randrange(20000)}" for _ in range(n)]
    base, texts = [words(rnd.choice([52, 60, 75])) for _ in range(14)], []
    for k in range(56):
        p = list(rnd.choice(base))
        kind = k % 4
        if kind == 1:
            p[len(p) // 2] = "changed"
        if kind == 2:
            del p[-20:]
        texts.append(" ".join(words(rnd.randrange(25)) + p + words(rnd.randrange(25))))
    links = brute_passages(texts)
    want = components(len(texts), links)
    got = {r.doc_id: r.class_id for r in passages.report(documents(spark, list(enumerate(texts)))).collect()}
    joined = [got[a] == got[b] for a, b in links]
    assert sum(joined) >= 0.95 * len(joined) and all(want[i] == want[got[i]] for i in range(len(texts)))
    equal = [(a, b) for a, b in links if any(" ".join(texts[a].split()[i : i + 51]) in texts[b] for i in range(len(texts[a].split()) - 50))]
    assert equal and all(got[a] == got[b] for a, b in equal)


def test_an_id_with_several_texts_is_one_document(spark):
    rnd = random.Random(9)
    text = lambda n: " ".join(f"u{rnd.randrange(9000)}" for _ in range(n))
    one, two, split = text(60), text(60), text(60)
    half = len(split.split()) // 2
    rows = [(1, one), (1, two), (2, one), (3, two), (4, " ".join(split.split()[:half])), (4, " ".join(split.split()[half:])), (5, split)]
    got = {r.doc_id: r.class_id for r in passages.report(documents(spark, rows)).distinct().collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_windows_end_at_the_nearest_lower_nodes_without_a_loop():
    rng = np.random.default_rng(3)
    hashes, owner = rng.integers(0, 1 << 31, 20000).astype(np.uint64) << np.uint64(32), np.sort(rng.integers(0, 9, 20004))
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        node, first, last = passages.compact_windows(hashes, 10, owner, 5)
    finally:
        sys.setprofile(None)
    assert len(node) > 2000 > len(calls)
    for i, a, b in list(zip(node, first, last, strict=True))[::7]:
        low, high = np.searchsorted(owner, owner[i]), np.searchsorted(owner, owner[i], side="right") - 5
        assert low <= a <= i <= b <= high and hashes[a : b + 1].min() == hashes[i]
        assert (a == low or hashes[a - 1] < hashes[i]) and (b == high or hashes[b + 1] < hashes[i])


def test_a_run_sends_each_kind_of_rows_by_itself_and_shingles_once(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 1 << 20, 40000))) for _ in range(4)]
    run = pd.DataFrame({"id": range(4), "text": texts, "run": 0})
    keys = np.unique(passages._run_keys(texts, 46, 5, 2)[0])
    made = []
    real = passages.shingles_of
    monkeypatch.setattr(passages, "shingles_of", lambda some, *rest: made.append(len(some)) or real(some, *rest))
    rows = passages._send(run, pd.DataFrame({"blob": [passages._packed(keys, 8)]}), 46, 5, 2, 8).to_pandas()
    assert len(made) > 1 and sum(made) == 4
    assert rows["function"].is_monotonic_increasing and set(rows["function"]) == {-2, -1, 0, 1}
    assert list(rows["blob"].notna()) == list(rows["function"] == -2)
    for r, text in zip(rows[rows["function"] == -2].itertuples(), texts, strict=True):
        assert (np.frombuffer(r.blob, "<u4") == (real([text])[0] >> np.uint64(32))[r.first : r.last + 1]).all()


def test_compact_windows_hold_every_subsequence_once():
    rnd = np.random.default_rng(2)
    for _ in range(20):
        h = rnd.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2)
        node, first, last = passages.compact_windows(h, 10)
        keys = h >> np.uint64(32)
        for x in range(60):
            for y in range(x + 9, 60):
                holds = (first <= x) & (x <= node) & (node <= y) & (y <= last)
                assert holds.sum() == 1 and keys[node[holds][0]] == keys[x : y + 1].min()


def test_toxicity_learns_and_holds_out(spark):
    rnd = random.Random(0)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = rnd.choices(common, k=40)
        bad = rnd.random() < 0.3
        if bad:
            for _ in range(4):
                w[rnd.randrange(40)] = rnd.choice(["vile", "Rotten!", "nasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = documents(spark, [*rows, (1001, None), (1002, ""), (None, "vile " * 20), (1003, "w1 " * 50000)])
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 0), (4, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.report(docs, table).collect()}
    assert len(out) == 904 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items() if i is not None)
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert out[1001].score == out[1002].score < 0.5 and out[None].predicted == 1
    kept = toxicity.reject_toxic(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in out.values())
    assert {r.score for r in toxicity.report(docs, table.limit(0)).collect()} == {0.0} or toxicity.report(docs, table.limit(0)).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.report(docs.limit(0), table).count() == 0


def plain_counts(docs):
    """By class, how many texts have each word and each pair."""
    import re

    one, two = {0: defaultdict(int), 1: defaultdict(int)}, {0: defaultdict(int), 1: defaultdict(int)}
    for text, y in docs:
        w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if x]
        for x in set(w):
            one[y][x] += 1
        for x in set(zip(["", *w], w, strict=False)):
            two[y][x] += 1
    return one, two


def plain_discount(n, both, share, counts, z):
    n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
    own = 0.0 if not n else 0.75
    if n and n1 and n2:
        y = n1 / (n1 + 2 * n2)
        own = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.75)[min(n, 3) - 1]
        own = min(max(own, 0.05), min(n, 3))
    return min(n, own + both * share + z * (both * share) ** 0.5 + z * z / 3)


def plain_evidence(docs, corpus, text, z):
    """The mean difference of log-likelihood, from the formulas."""
    import math

    one, two = plain_counts(docs)
    seen = defaultdict(int)
    for c in plain_counts([(t, 0) for t in corpus])[0].values():
        for x, n in c.items():
            seen[x] += n
    words = set(one[0]) | set(one[1]) | {""}
    p = lambda x: (seen[x] + 1 if x in words else 1) / (sum(seen.values()) + len(words) + 1)
    sums = {c: sum(one[c].values()) for c in (0, 1)}
    by = {c: defaultdict(int) for c in (0, 1)}
    for c in (0, 1):
        for (v, _), n in two[c].items():
            by[c][v] += n

    def unigram(c, x):
        d = lambda x: plain_discount(one[c].get(x, 0), one[0].get(x, 0) + one[1].get(x, 0), sums[c] / (sums[0] + sums[1]), one[c].values(), z)
        held = sum(map(d, words)) / sums[c]
        return held if x not in words else (one[c].get(x, 0) - d(x)) / sums[c] + held * p(x)

    def bigram(c, v, x):
        if not by[c][v]:
            return unigram(c, x)
        share = by[c][v] / (by[0][v] + by[1][v])
        d = lambda x: plain_discount(two[c].get((v, x), 0), two[0].get((v, x), 0) + two[1].get((v, x), 0), share, two[c].values(), z)
        held = sum(d(x) for x in words) / by[c][v]
        return (two[c].get((v, x), 0) - d(x)) / by[c][v] + held * unigram(c, x)

    import re

    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if x]
    return sum(math.log(bigram(1, v, x) / bigram(0, v, x)) for v, x in zip(["", *w], w, strict=False)) / max(len(w), 1)


@pytest.mark.parametrize("z", [0.0, 0.2, 2.0])
def test_kneser_ney_is_its_formulas(z):
    import pandas as pd

    rnd = random.Random(3)
    text = lambda y: " ".join(rnd.choice("Die der das ist und nicht".split() + ["Übel", "schlimm"] * y) for _ in range(rnd.randrange(1, 12)))
    docs = [(text(y), y) for y in [0] * 14 + [1] * 6]
    corpus = [t for t, _ in docs] + [text(0) + " extra" for _ in range(9)]
    frame = pd.DataFrame({"text": [t for t, _ in docs], "y": [y for _, y in docs]})
    pairs = pd.concat(toxicity._count_pairs([frame])).groupby(["v", "w"], as_index=False).sum()
    words = pd.concat(toxicity._count_class_words([frame])).groupby("w", as_index=False).sum()
    every = pd.concat(toxicity._count_words([pd.DataFrame({"text": corpus})])).groupby("w").sum()["n"]
    of = lambda f: {c: f[c].to_numpy() for c in "to"}
    model = toxicity.build(words["w"].to_numpy(), of(words), pairs["v"].to_numpy(), pairs["w"].to_numpy(), of(pairs), every.loc[words["w"]].to_numpy(), int(every.sum()), z)
    # The same from the pairs alone that chance can't explain whole.
    some = pairs[pairs[["t", "o"]].max(axis=1) > z * z / 3]
    firsts = pairs.groupby("v", as_index=False).sum()
    met = {c: toxicity.spectrum(pairs[c][pairs[c] > 0].to_numpy()) for c in "to"}
    lean = toxicity.build(words["w"].to_numpy(), of(words), some["v"].to_numpy(), some["w"].to_numpy(), of(some), every.loc[words["w"]].to_numpy(), int(every.sum()), z, (firsts["v"].to_numpy(), of(firsts)), met)
    assert np.allclose(lean.evidence([t for t, _ in docs]), model.evidence([t for t, _ in docs]), atol=1e-12)
    asked = [text(1) for _ in range(6)] + ["never seen words", "Übel unknown Übel", "x"]
    got = model.evidence([*asked, None, ""])
    unknown = model.other  # what no class has seen: the classes differ by their held share alone
    assert got[-3] == pytest.approx(unknown + model.held_of_start, abs=1e-9) and list(got[-2:]) == [0, 0]
    for t, g in zip(asked, got, strict=False):
        known = [x for x in t.lower().split() if x in {w for d, _ in docs for w in d.lower().split()}]
        if len(known) == len(t.split()):
            assert g == pytest.approx(plain_evidence(docs, corpus, t, z), abs=1e-9)


def test_pipeline_is_its_stages(spark, tmp_path):
    rnd = random.Random(1)
    item = [f"bench{i}" for i in range(12)]
    rows, labels = [], []
    for i in range(240):
        w = [f"t{rnd.randrange(4000)}" for _ in range(30)]
        if i % 6 == 0:
            w[5:5] = ["awful", "hideous", "awful"]
        if i % 40 == 7:
            w += item
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    rows += [(300 + i, rows[20 + i][1]) for i in range(5)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    model = toxicity.train(spark, docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    left = [(i, t) for i, t in rows if model.scores([t])[0] < 0.5]
    assert sum(i % 6 == 0 for i, _ in left if i < 240) <= 4 and sum(i % 6 != 0 for i, _ in left if i < 240) >= 196
    fps = [slow_fingerprint(t) for _, t in left]
    roots = components(len(left), [(a, b) for b in range(len(left)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 3])
    left = [left[k] for k, r in enumerate(roots) if r == k]
    left = [(i, t) for i, t in left if "bench0 bench1 bench2 bench3 bench4 bench5 bench6 bench7" not in t]
    counts = defaultdict(int)
    for r in out:
        counts[r.doc_id] += 1
        assert r.text == dict(rows)[r.doc_id] and 0 <= r.shard < corpus_pipeline.SHARDS
    assert set(counts) <= {i for i, _ in left} and max(counts.values()) <= 2
    taken, whole = sum(len(r.text.split()) for r in out), sum(len(t.split()) for _, t in left)
    assert abs(taken - 1.5 * whole) <= 100
    assert corpus_pipeline.ORACLE_SQL is None


def test_spans_of_repetitive_texts_agree_with_all_windows():
    rng = np.random.default_rng(3)
    for kinds in (2, 6, 40):
        for _ in range(30):
            a, b = (rng.integers(0, kinds, rng.integers(8, 40)).astype("<u4") for _ in range(2))
            if kinds == 40:
                b = np.concatenate((b[:5], a[3:]))
            found = passages.verified_span(a, b, 8, 0.8)
            if found:
                one, two = set(a[found[0] : found[0] + 8].tolist()), set(b[found[1] : found[1] + 8].tolist())
                assert found[2] == pytest.approx(len(one & two) / len(one | two)) and found[2] >= 0.8
            x, y = (np.random.default_rng(kinds).integers(0, kinds, 30) for _ in range(2))
            many = passages._different(np.concatenate((x, y)), np.concatenate((np.arange(30),) * 2), 8, 23)
            assert many.tolist() == [len(set(x[i : i + 8]) | set(y[i : i + 8])) for i in range(23)]
    same = np.zeros(3000, "<u4")
    other = np.arange(3000, dtype="<u4")
    assert passages.verified_span(same, other, 8, 0.8) is None
    assert passages.verified_span(other, other[100:], 8, 0.8)[2] == 1.0
