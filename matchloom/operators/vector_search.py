"""Nearest joins by cosine similarity: queries in groups against references in blocks, never pairs as rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.nearest import numbered

BLOCK = 4_000
#: Queries that meet a block of references in one row.
GROUP = 512


def _unit_rows(vectors: Iterable) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def top_vectors(queries: DataFrame, refs: DataFrame, k: int = 5, block: int = BLOCK, zero_is_null: bool = False, other_than_own: bool = False) -> DataFrame:
    """queries (query_id, vector), refs (ref_id, vector; and ref, if there is one). Returns (query_id, rank, ref_id, similarity; ref).

    A vector without length scores 0 with every other, or takes no part if
    zero_is_null. Ties go to the smaller ref_id. other_than_own: a reference
    with the query's id is none for it. refs that come from `numbered` keep its
    blocks; then each vector is computed once, which counts where a service
    makes it.
    """
    there = F.col("vector").isNotNull() & (F.exists("vector", lambda x: x != 0) if zero_is_null else F.lit(True))
    labels = ["ref"] if "ref" in refs.columns else []
    some = refs if {"n", "block"} <= set(refs.columns) else numbered(refs.select("ref_id", "vector", *labels), block)
    blocks = some.where(there).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("n", "ref_id", *labels, "vector"))).alias("refs"))  # `block` rows in each
    blocks = blocks.select("refs.ref_id", F.col("refs.vector").alias("vectors"), "refs.n", *(F.col(f"refs.{c}") for c in labels))
    groups = 4 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.where(there).select("query_id", "vector").withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    # Groups of GROUP queries at most: a part of a group's rows each.
    nth = F.row_number().over(Window.partitionBy("group").orderBy("query_id"))
    asked = asked.withColumn("part", F.floor(nth / GROUP)).groupBy("group", "part").agg(F.collect_list(F.struct("query_id", "vector")).alias("q")).select("group", "q.query_id", F.col("q.vector").alias("asked"))
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, ref_id bigint, n bigint, similarity double" + ", ref string" * len(labels)
    most = k + 1 if other_than_own else k

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, numbers, own = pd.Series(r.ref_id, dtype="Int64").to_numpy(), np.asarray(r.n), np.asarray(r.query_id, dtype=object)
                scores = _unit_rows(r.asked) @ _unit_rows(r.vectors).T
                best = np.argsort(-scores, axis=1, kind="stable")[:, :most] if scores.shape[1] <= 4 * most else _top(scores, most)
                out = pd.DataFrame({"query_id": np.repeat(own, best.shape[1]), "ref_id": pd.array(ids[best].ravel(), "Int64"), "n": numbers[best].ravel(), "similarity": np.take_along_axis(scores, best, 1).ravel()})
                if labels:
                    out["ref"] = np.asarray(r.ref, dtype=object)[best].ravel()
                yield out[out["query_id"] != out["ref_id"]] if other_than_own else out

    found = blocks.withColumn("block", F.col("n")[0]).join(asked, F.lit(True)).repartition("group").mapInPandas(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "n")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "similarity", *labels)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best in each row, ties to the left: all that reach the kth best are sorted."""
    cut = np.partition(scores, -k, axis=1)[:, -k]
    out = np.empty((len(scores), k), np.int64)
    for i, row in enumerate(scores):
        reach = np.flatnonzero(row >= cut[i])
        out[i] = reach[np.argsort(-row[reach], kind="stable")[:k]]
    return out


def with_padding(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """A row for each query and rank up to k; ref_id -1 where there are fewer references."""
    every = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return every.join(found, ["query_id", "rank"], "left").withColumn("ref_id", F.coalesce("ref_id", F.lit(-1).cast("long")))
