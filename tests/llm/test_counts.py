"""Decontamination, mixing, sharding, chat and license scans against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from matchloom.llm import chat, decontaminate, licenses, mixing, shard

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(AZ))


def documents(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS).withColumns({k: F.lit(v) for k, v in more.items()})


ITEM = "One two three four five six seven eight nine ten"
TEXTS = [
    None, "", "   ", "É é clean text with no hit at all, of more than eight words in it", f"before {ITEM.upper()}! after", f"{ITEM} {ITEM}",
    "short item", "a Short, ITEM here", "one two three four five six seven", "x " * 5000 + ITEM + " y" * 5000, f"{ITEM}; short item",
]


def brute_hits(texts, items, width=8):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    lengths = {len(g) for g in grams}
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                got = grams.get(tuple(w[k : k + n]))
                if got:
                    found |= got
                    hit.update(range(k, k + n))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


@pytest.mark.parametrize("most", [1000, 0])
def test_decontamination_is_brute_force(spark, most):
    items = [(3, ITEM), (20, "short item"), (100, None), (5, ""), (6, ITEM)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"words": F.lit(1), "h": F.lit(2)})
    docs = documents(spark, TEXTS, words=1, pos=2, h=3, rid=4, items=5)
    got = {r.doc: r for r in decontaminate.find_hits(docs, bench, max_broadcast=most).collect()}
    for d, want in brute_hits(TEXTS, items).items():
        r = got[d]
        assert (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) == want[:4], d
    assert {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs, bench).collect()} == brute_hits(TEXTS, items)


def test_decontamination_modes_and_odd_rows(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = documents(spark, [f"Keep this. {ITEM} And, this!", "clean", None, ITEM])
    docs = docs.union(docs.where("doc_id = 3")).union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    left = decontaminate.decontaminate(docs, bench, min_items=1)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2"]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs.where("doc_id < 3"), bench, mode="span", min_items=1).collect()}
    assert cut == {0: "Keep this And, this!", 1: "clean", 2: None}
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, mode="other")
    empty = bench.limit(0)
    assert decontaminate.report(docs, empty).where("n_hit > 0").count() == 0 and decontaminate.report(docs.limit(0), bench).count() == 0


#: By hand, not from the code.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def brute_base(texts):
    out = {}
    for d, t in enumerate(texts):
        w, found = words(t), []
        for label, phrase in BASE.items():
            p = phrase.split()
            found += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        starts = [k for k, _ in found]
        out[d] = (len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))
    return out


def test_licenses(spark):
    grant = next(text for label, text in licenses.TEMPLATES if text.startswith("Permission is hereby"))
    texts = [
        None, "", "Released under THE MIT LICENSE.", "apache-license, version 2 and under the mit license under the mit license", "CC BY NC cc by", "the mit", "x " * 3000 + grant.replace("restriction", "any restriction") + " y" * 300,
        "apache license version 3", "under the  mit\nlicense", "we do not use the MIT License here", "all rights reserved all rights reserved all rights reserved",
    ]
    docs = documents(spark, texts, words=1, pos=2, votes=3, label=4, tid=5)
    got = {r.doc_id: r for r in licenses.report(docs).collect()}
    for d, want in brute_base(texts).items():
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, d
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[6].labels == "mit" and got[6].base_labels == "" and got[9].labels == got[10].labels == ""
    assert licenses.report(docs.limit(0)).count() == 0
    twice = docs.union(docs)
    assert licenses.report(twice).count() == 2 * len(texts)
    named = docs.withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    assert licenses.report(named).where("doc_id = 'id2'").first().labels == "mit"


def test_one_member_of_a_family_of_licenses_is_named(spark):
    own = [(label, text) for label, text in licenses.TEMPLATES]
    lines = [
        ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
        ("gpl-3", "Licensed under the GNU General Public License, version 3."),
    ]
    texts = [(label, f"Some words ahead. {text} And others behind it.") for label, text in [*own, *lines]]
    texts.append(("bsd-3,cc0", texts[5][1] + " far from it " * 40 + own[-2][1]))
    got = {r.doc_id: r.labels for r in licenses.report(documents(spark, [t for _, t in texts])).collect()}
    assert [got[i] for i in range(len(texts))] == [label for label, _ in texts]


def test_license_sql_agrees(spark, tmp_path):
    import duckdb

    from matchloom.llm.sql import SQL

    texts = [text[: len(text) * n // 10] for _, text in licenses.TEMPLATES for n in (5, 7, 8, 10)] + [f"{x} odd {y}" for (_, x), (_, y) in zip(licenses.TEMPLATES, licenses.TEMPLATES[1:], strict=False)] + [None, "", "under the mit license cc by nc"]
    docs = documents(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
    want = con.execute(f"SELECT {columns} FROM ({SQL['op10_licenses']}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in licenses.report(docs).select(*columns.split(", ")).orderBy("doc_id").collect()]
    assert got == want


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, total, out = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= set(over)
    return out


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 97), "en", (None, "a", "b", "ß")[i % 4] if i % 3 else "hot", 0) for i in range(600)] + [(None, "q " * 5, "en", "a", 0), (7, None, "en", "z", 0), (8, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("x"), "target": F.lit(1), "h": F.lit(2), "multiplier": F.lit(3), "copies": F.lit(4)})
    out = mixing.report(docs).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.report(docs).collect()), key=str)
    source = {(r[0], len((r[1] or "").split())): r[3] for r in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        s = source[(r.doc_id, r.size)]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert abs(taken[s] - target[s]) <= max(3, 0.01 * target[s]), s
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())
    assert mixing.report(docs.limit(0)).count() == 0


def test_mixing_solves_its_dual_in_few_jobs(spark):
    """The driver keeps threads, plans and metrics of every job, however few its rows."""
    rows = [(i, "w " * (1 + (i * 7919 % 97) ** (1 + i % 3)), "en", (None, "a", "b", "c", "d")[i % 5], 0) for i in range(400)] + [(900 + i, "w " * 9, "en", "rare", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    sizes = docs.selectExpr("source", "size(split(trim(text), ' ')) + 0L size", "xxhash64(doc_id, text) h")
    solved = {r.source: r for r in mixing.plan(sizes).collect()}
    assert any(r.multiplier is None for r in solved.values()) and sum(r.multiplier is not None for r in solved.values()) >= 3
    for source, r in solved.items():
        own = [len(t.split()) for _, t, _, s, _ in rows if s == source]
        assert r.mean == pytest.approx(sum(own) / len(own)) and r.source_size == sum(own)
        if r.multiplier is None:
            assert r.target == 2 * sum(own)
        else:
            assert sum(n * 2 / (1 + math.exp(-r.multiplier * n / r.mean)) for n in own) == pytest.approx(r.target, rel=2e-6)
    done = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000), spark._jsparkSession.sharedState().statusStore().executionsCount())[1]
    before = done()
    mixing.mix(docs).count()
    assert done() - before <= 32


def brute_shards(rows, shards, together):
    """(id, size, crc) in shards, each in order: rows sorted by hash of the text, cut by the docstring."""
    signed = lambda t: (h := xxhash.xxh64_intdigest(t, 42)) - (1 << 64 if h >> 63 else 0)
    data = sorted((signed(t), len(t) + 8, zlib.crc32(t), i is not None, i or 0) for i, t in rows)
    ends, total = [], 0
    for r in data:
        total += r[1]
        ends.append(total)
    spans = {}
    for r, e in zip(data, ends, strict=True):
        low, _ = spans.setdefault(r[:3], (e - r[1], e))
        spans[r[:3]] = (low, e)
    cuts = [total * k / shards for k in range(1, shards)]
    for k, c in enumerate(cuts):
        for low, high in spans.values():
            if low < c < high and high - low <= together * total / shards and sum(r[:3] == x for x, v in spans.items() if v == (low, high) for r in data) > 1:
                cuts[k] = low if c - low <= high - c else high
    out = {}
    for r, e in zip(data, ends, strict=True):
        out.setdefault(sum(c <= e - r[1] / 2 for c in cuts), []).append((r[4] if r[3] else None, r[1], r[2]))
    return out


@pytest.mark.parametrize(("shards", "n"), [(24, 400), (5, 60)])
def test_shards_are_brute_force(spark, shards, n):
    texts = [None if i == 5 else "é" * (i * 37 % 50) + "x" * (4000 if i == 77 else 3) for i in range(n)] + ["hot text " * 9] * (n // 3)
    docs = documents(spark, texts, size=1, shard=2, part=3, tie=4, hash=5)
    docs = docs.union(docs.where("doc_id = 9")).union(docs.where("doc_id = 9")).union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    out = shard.report(docs, shards).collect()
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert {r.law for r in out} == {"bytes"} and len(out) == len(rows)
    got = {}
    for r in sorted(out, key=lambda r: (r.shard, r.slot)):
        assert r.slot == len(got.setdefault(r.shard, []))
        got[r.shard].append((r.doc_id, r.size, r.text_crc32))
    assert got == brute_shards(rows, shards, shard.TOGETHER)
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    assert all(abs(sum(x[1] for x in g) - total / shards) <= largest + shard.TOGETHER * total / shards for g in got.values())
    kept = shard.shard_documents(docs)
    assert sorted(kept.columns) == sorted(docs.columns + ["slot"]) and Counter((r.doc_id, (r.text or "").encode()) for r in kept.collect()) == Counter(rows)
    assert shard.report(docs.limit(0)).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    assert shard.report(named).count() == len(rows)


def test_chat_round_trip(spark):
    rows = [
        (0, 0, "user", "</s>[INST] ok <|end|>\n"), (0, 1, "assistant", "a < b && c &amp; <|turn|>user<|says|>"), (0, 2, "assistant", None),
        (1, 5, "system", "é😀"), (1, 2, None, "x"), (2, 0, "assistant", ""), (None, 0, "user", "n"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (3, 0, "assistant", "tie"),
    ] + [(4, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(70)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"id": F.lit(1), "parent": F.lit(2), "score": F.lit(3)})
    got = {r.conv_id: r for r in chat.report(table).collect()}
    said = "</s>[INST] ok [/INST]"
    by = {-1: [("user", said), ("assistant", said)]}
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.report(table.limit(0)).count() == 1


def test_reply_trees_rank_their_branches(spark):
    # 1 - 2 - 4 - 6, 2 - 5, 1 - 3; 7 and 8 answer each other; 9 answers nobody who is here.
    rows = [(1, None, 0.0), (2, 1, 1.0), (3, 1, 9.0), (4, 2, 1.0), (5, 2, 5.0), (6, 4, 1.0), (7, 8, 1.0), (8, 7, 1.0), (9, 99, 1.0)]
    table = spark.createDataFrame([(i, p, "user", f"m{i}", s) for i, p, s in rows], "id long, parent long, role string, text string, score double")
    paths = {}
    for r in chat.paths(table).orderBy("leaf", "nth").collect():
        paths.setdefault((r.root, r.leaf), []).append(r.id)
    assert paths == {(1, 3): [1, 3], (1, 5): [1, 2, 5], (1, 6): [1, 2, 4, 6], (9, 9): [9]}
    assert {r.leaf for r in chat.paths(table, best=1).collect()} == {3, 9}
    assert {r.leaf for r in chat.paths(table, best=2).collect()} == {3, 5, 9}
