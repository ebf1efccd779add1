"""Exact top-k by inner product.

Vectors become whole numbers, so that scores are exact. Candidates are dealt by
descending length. Vectors and queries are turned to the axes of the corpus
that hold the most (eigenvectors of its second moments, summed in the workers);
in each block of candidates the scores of the first axes are taken first, and by
Cauchy-Schwarz the rest of a score is at most the product of both rests'
lengths. Only where that could reach a query's threshold are whole scores
computed, in whole numbers. A query's threshold starts from the longest vectors
of all and rises as blocks pass; a block whose greatest length can't reach any
threshold ends its batch, which is sorted by length. Batches after it are still
looked at: a read partition packs files of any lengths in any order.

Queries go through in blocks of `query_block` rows. A block is broadcast, its
answers are written to the shared folder, and it is destroyed before the next
one comes: that bounds the driver and the workers whatever the number of
queries. Each block reads all candidates once.

Defined results: vectors that are null or hold null or non-finite components
take no part; shorter vectors count as if filled up with zeros; equal rows
count once; a row with the query's id is no candidate for it; ties go to the
smaller id; null ids take no part; an empty table gives no rows; further
columns are ignored. Scores beyond 64 bits are cut to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import written

SCALE, BLOCK, QUERY_BLOCK, HEAD = 256, 4096, 4096, 0.25
SEED_ROWS = 2048
#: Components that are gathered at once for exact scores: 32 MB.
GATHER = 1 << 22


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): components as whole numbers in doubles; (id, v) pairs once."""
    v = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).distinct()


def _matrix(vectors: Iterable[np.ndarray], dim: int) -> np.ndarray:
    vectors = list(vectors)
    if all(len(v) == dim for v in vectors) and vectors:
        return np.stack([np.asarray(v, np.float64) for v in vectors])
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in pairs, exact."""
    most = (np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0)) * max(q.shape[1], 1)
    if most < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)]
    return np.array([min(max(n, -(2**63)), 2**63 - 1) for n in whole], np.int64)


def search(queries: DataFrame, rows: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK, head: float = HEAD) -> DataFrame:
    """queries, rows: (id, v). Returns (query_id, rank, id, score)."""
    spark = rows.sparkSession
    schema = "query_id bigint, rank int, id bigint, score bigint"
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.withColumn("len", length).repartitionByRange(parts, F.desc("len"), "id").sortWithinPartitions(F.desc("len"), "id"))
    shape = rows.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    if not shape["n"]:
        return spark.createDataFrame([], schema)
    dim = shape["dim"]

    def moments(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for pdf in batches:
            x = _matrix(pdf["v"], dim)
            total += x.T @ x
        yield pd.DataFrame({"m": [total.ravel()]})

    added = rows.select("v").mapInPandas(moments, "m array<double>").select(F.posexplode("m").alias("i", "m")).groupBy("i").agg(F.sum("m").alias("m")).orderBy("i")
    second = np.array([r["m"] for r in added.collect()]).reshape(dim, dim) if dim else np.zeros((0, 0))  # dim * dim numbers
    turn = np.linalg.svd(second)[0] if dim else second
    longest = rows.orderBy(F.desc("len"), "id").limit(SEED_ROWS).toPandas()  # SEED_ROWS rows
    seed_ids, seed = longest["id"].to_numpy(), _matrix(longest["v"], dim)

    many = max(1, -(-queries.count() // query_block))
    asked = written(queries.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(many))))
    first = max(1, int(dim * head))

    def against(ids: np.ndarray, q: np.ndarray, floor: np.ndarray):
        q_turned = q @ turn
        q_rest = np.sqrt(np.maximum((q_turned[:, first:] ** 2).sum(axis=1), 0))
        q_len = np.sqrt((q**2).sum(axis=1))
        sent = spark.sparkContext.broadcast((ids, q, q_turned[:, :first].copy(), q_rest, q_len, floor, turn))

        pairs = max(1, GATHER // max(dim, 1))

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, q_head, q_rest, q_len, floor, turn = sent.value
            n = len(ids)
            least = floor.copy()
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for pdf in batches:
                pdf = pdf.sort_values("len", ascending=False, kind="stable")  # a batch may run across files
                for s in range(0, len(pdf), block):
                    part = pdf.iloc[s : s + block]
                    x, x_ids, x_len = _matrix(part["v"], dim), part["id"].to_numpy(), part["len"].to_numpy()
                    slack = 1e-9 * (1 + q_len * x_len[0])
                    if (q_len * x_len[0] + slack < least).all():
                        break  # the batch's rows only get shorter
                    turned = x @ turn
                    rest = np.sqrt(np.maximum((turned[:, first:] ** 2).sum(axis=1), 0))
                    bound = q_head @ turned[:, :first].T + np.outer(q_rest, rest) + slack[:, None]
                    i, j = np.nonzero(bound >= least[:, None])
                    own = ids[i] != x_ids[j]
                    i, j = i[own], j[own]
                    for c in range(0, len(i), pairs):
                        ci, cj = i[c : c + pairs], j[c : c + pairs]
                        exact = _scores(q[ci], x[cj])
                        reach = exact >= least[ci]
                        got.append((ci[reach], x_ids[cj[reach]], exact[reach]))
                    if sum(len(g[0]) for g in got) > 2 * n * k:
                        got = [_best(got, k)]
                        least = np.maximum(least, _thresholds(got[0], n, k))
            if got:
                i, x_ids, exact = _best(got, k)
                yield pd.DataFrame({"query_id": ids[i], "id": x_ids, "score": exact})

        return run, sent

    found = None
    for part in range(many):
        pdf = asked.where(F.col("part") == part).toPandas()  # about query_block rows
        if not len(pdf):
            continue
        ids, q = pdf["id"].to_numpy(), _matrix(pdf["v"], dim)
        # k real candidates' scores: no answer lies below the least of them.
        floor = np.full(len(q), -np.inf)
        if len(seed) > k:
            near = q @ seed.T
            near[ids[:, None] == seed_ids[None, :]] = -np.inf
            distinct = len(np.unique(seed_ids)) == len(seed_ids)
            if distinct:
                floor = np.partition(near, -k, axis=1)[:, -k]
                floor = np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), -np.inf)
        run, sent = against(ids, q, floor)
        out = written(rows.mapInPandas(run, "query_id bigint, id bigint, score bigint"))
        sent.destroy()
        found = out if found is None else found.union(out)
    if found is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _best(got: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, ids, exact = (np.concatenate([g[c] for g in got]) for c in range(3))
    order = np.lexsort((ids, -exact, i))
    i, ids, exact = i[order], ids[order], exact[order]
    begin = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, int)
    nth = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
    keep = nth < k
    return i[keep], ids[keep], exact[keep]


def _thresholds(best: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, k: int) -> np.ndarray:
    i, _, exact = best
    out = np.full(n, -np.inf)
    count = np.bincount(i, minlength=n)
    last = np.cumsum(count) - 1
    full = count >= k
    out[full] = exact[last[full]]
    return out


def report(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    rows = written(whole_vectors(embeddings, "vec_id", "embedding"))
    found = search(rows.where(F.pmod("id", F.lit(every)) == 0), rows, k)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
