"""SimHash near-dedup: tiled exact comparison with numpy exclusive-or and bit counts.

Fingerprints come from word shingles, batch by batch. Equal fingerprints are
one node, so that exact copies cost nothing. Different ones within the radius
agree in all of some set of bit blocks (64 bits in `radius` + k blocks: at least
k of them are equal), so each node is filed under every such set; the nodes of
one file are compared with each other, all with all, by exclusive-or and bit
count. A file is sorted by population count, and a block of its nodes is compared with
the tile of those alone whose counts lie within the radius of the block's. A
file of more than `tile` nodes is cut into tiles by population count
(and a hash beyond that): pairs of tiles whose counts differ by more than the
radius are never built. A comparison passes on a spanning forest of the links
that it finds, never all pairs, and components follow from the forests.

Filing loses no link, so results are those of comparing all with all.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; repeated rows share their class; a row with a null id is in the class of
what is near it, and in a null class if no row there has an id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import checked_broadcast, text_key, written
from matchloom.llm.components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Nodes that are compared all with all in one task.
TILE = 4096
#: Nodes that are compared with their tile at once.
BLOCK = 64


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, n, digest = b" ".join(words), len(words) - shingle + 1, xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = np.fromiter((fingerprint(t, shingle) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"id": pdf["id"], "fp": values.view(np.int64)})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fp bigint")


def forest(fps: np.ndarray, radius: int = RADIUS, block: int = BLOCK, compared: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ends of a spanning forest of the links between the values. compared: gets how many pairs each block took."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    fps = fps[order]
    pop, rest, a, b = np.bitwise_count(fps).astype(np.int64), np.arange(len(fps)), [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            some, front = np.sort(front[:block]), front[block:]
            # The tile: all that are left with a population count near the block's. The others are skipped unseen.
            left = np.searchsorted(pop[rest], pop[some[0]] - radius)
            right = np.searchsorted(pop[rest], pop[some[-1]] + radius, side="right")
            tile = rest[left:right]
            if compared is not None:
                compared.append(len(some) * len(tile))
            near = np.bitwise_count(fps[some][:, None] ^ fps[tile][None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                a.append(some[near[:, hit].argmax(axis=0)])
                b.append(tile[hit])
                front = np.concatenate((front, tile[hit]))
                keep = np.ones(len(rest), bool)
                keep[left:right] = ~hit
                rest = rest[keep]
    return (order[np.concatenate(a)], order[np.concatenate(b)]) if a else (np.empty(0, int), np.empty(0, int))


def _masks(n: int, radius: int) -> list[int]:
    """Sets of bit blocks of which one at least is equal in any two values within the radius; longer sets where there are more values."""
    same = 1 if n < 1 << 22 else 2 if n < 1 << 31 else 3
    edges = [round(i * BITS / (radius + same)) for i in range(radius + same + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(blocks, same)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _compare_files(batches: Iterable[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """batches: (file, fp, node), sorted by file. Forests of each file."""
    carry: list[pd.DataFrame] = []
    for pdf in batches:
        last = pdf["file"].iloc[-1] if len(pdf) else None
        if not len(pdf):
            continue
        if pdf["file"].iloc[0] == last and (not carry or carry[-1]["file"].iloc[0] == last):
            carry.append(pdf)
            continue
        whole = (pdf["file"] != last).to_numpy()
        yield _compare(pd.concat([*carry, pdf[whole]]), radius)
        carry = [pdf[~whole]]
    if carry:
        yield _compare(pd.concat(carry), radius)


def _compare(pdf: pd.DataFrame, radius: int, short: int = 16) -> pd.DataFrame:
    file, fps, node = pdf["file"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy()
    begin = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
    size = np.diff(np.append(begin, len(file)))
    few = np.repeat(size <= short, size)
    a, b = [], []
    for step in range(1, min(short, len(file))):  # the short files of the batch at once
        i = np.flatnonzero((file[step:] == file[:-step]) & few[step:])
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= radius]
        a.append(node[i])
        b.append(node[i + step])
    for s, n in zip(begin[size > short], size[size > short], strict=True):
        x, y = forest(fps[s : s + n], radius)
        a.append(node[s + x])
        b.append(node[s + y])
    return pd.DataFrame({"a": np.concatenate(a) if a else node[:0], "b": np.concatenate(b) if b else node[:0]})


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """nodes: (fp, node), fp different in each. Returns (a, b): enough links to connect all nodes that links within the radius connect."""
    masks = _masks(nodes.count(), radius)
    filed = nodes.select("fp", "node", F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks)))).alias("x"))
    filed = filed.select("fp", "node", F.struct(F.col("x.m").alias("m"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key")).alias("key"))
    sizes = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowds = written(sizes.where(F.col("n") > tile))  # few: files of more than a tile's nodes
    short = filed.join(crowds, "key", "left_anti").withColumn("file", F.xxhash64("key"))
    # Two keys may meet under one hash: that adds comparisons and loses none.
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    out = short.select("file", "fp", "node").repartition(parts, "file").sortWithinPartitions("file").mapInPandas(lambda batches: _compare_files(batches, radius), "a bigint, b bigint")
    if crowds.isEmpty():
        return out

    # Tiles: by population count, then by a hash so that none is much over its size.
    crowd = filed.join(crowds.select("key"), "key").withColumn("pop", F.bit_count("fp"))
    tiles = crowd.groupBy("key", "pop").agg(F.count("*").alias("n")).withColumn("slices", F.ceil(F.col("n") / tile).cast("int"))
    tiles = written(tiles.select("key", "pop", "slices"))
    crowd = crowd.join(tiles, ["key", "pop"]).withColumn("slice", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    cut = tiles.select("key", "pop", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    one, two = cut.select("key", F.struct("pop", "slice").alias("t")), cut.select("key", F.struct("pop", "slice").alias("u"))
    pairs = one.join(two, "key").where((F.col("t") <= F.col("u")) & (F.col("u.pop") - F.col("t.pop") <= radius))
    pairs = pairs.withColumn("pair", F.xxhash64("key", "t", "u"))
    sides = pairs.select("key", "pair", F.explode(F.array_distinct(F.array("t", "u"))).alias("t")).select("key", "pair", "t.pop", "t.slice")
    work = crowd.join(sides, ["key", "pop", "slice"]).select("pair", "fp", "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = forest(pdf["fp"].to_numpy().view(np.uint64), radius)
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"a": node[x], "b": node[y]})

    return out.union(work.groupBy("pair").applyInPandas(compare, "a bigint, b bigint"))


def _classes(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """rows: (fp, ...). (fp, root) of each different fingerprint: the least fingerprint that links reach."""
    nodes = written(rows.select("fp").distinct())
    roots = connected_components(links(nodes.withColumn("node", F.col("fp")), radius, tile))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(id, fp, component): component is the least id that links of fingerprints reach."""
    rows = written(fingerprints(docs, id_col, text_col, shingle))
    classes = written(_classes(rows, radius, tile))
    least = rows.groupBy("fp").agg(F.min("id").alias("id")).join(classes, "fp").groupBy("root").agg(F.min("id").alias("component"))
    return rows.join(classes.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row of each class stays: of the least id (null: the last), then of the least hash of the text.

    Rows that go are known by id and text, and broadcast up to a million of
    them, so that texts don't move; rows that are repeated as they are, which
    these keys can't tell apart, are few and become one.
    """
    keyed = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *text_key(F.col(text_col)))
    key = ["__id", "__h1", "__h2"]
    rows = keyed.select(F.struct(*key).alias("key"), F.col("__text").alias("text"))
    rows = written(fingerprints(rows.select(F.to_json("key", {"ignoreNullFields": "false"}).alias("key"), "text"), "key", "text", shingle))
    kind = f"__id {docs.schema[id_col].dataType.simpleString()}, __h1 bigint, __h2 bigint"
    rows = rows.select(F.from_json("id", kind).alias("key"), "fp")
    classes = written(_classes(rows, radius, tile))
    rows = written(rows.join(classes, "fp").select("root", "key").groupBy("root", "key").agg(F.count("*").alias("n")))
    order = F.struct(F.col("key.__id").isNull(), F.col("key"))
    first = rows.groupBy("root").agg(F.min(F.struct(order.alias("o"), "n")).alias("m")).select("root", F.col("m.o.key").alias("kept"), "m.n")
    gone = written(rows.join(first.select("root", "kept"), "root").where(~F.col("key").eqNullSafe(F.col("kept"))).select("key.*"))
    again = written(first.where("n > 1").select("kept.*"))
    match = lambda left, other, how: left.alias("l").join(other.alias("o"), F.col("l.__id").eqNullSafe(F.col("o.__id")) & (F.col("l.__h1") == F.col("o.__h1")) & (F.col("l.__h2") == F.col("o.__h2")), how)
    left = match(keyed, checked_broadcast(gone), "left_anti")
    if again.isEmpty():
        return left.select("__row.*")
    once = match(left, checked_broadcast(again), "left_semi").groupBy(*key).agg(F.first("__row").alias("__row"))
    return match(left, checked_broadcast(again), "left_anti").select("__row.*").union(once.select("__row.*"))


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
