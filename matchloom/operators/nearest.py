"""Nearest joins by fuzzy score: each distinct value once, references in blocks.

References are numbered in order of ref_id and cut into blocks of `block` rows,
each packed into one row of a table; values are dealt into groups. Every group
meets every block: only these few rows are joined, never pairs of a value and a
reference. A block's strings go to the worker that needs them, and nothing is
collected. Within a block candidates are grouped by length, and lengths and
letters bound a score before it is computed.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import kernels

BLOCK = 20_000
#: Values that meet a block of references in one row.
GROUP = 512


def numbered(refs: DataFrame, block: int) -> DataFrame:
    """refs with n, from 0, in order of ref_id (null first), and block.

    Numbers come from the counts by range partition: the rows of one partition
    alone are ordered in one task.
    """
    spark = refs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    every = [F.col(c) for c in refs.columns if c != "ref_id" and not refs.schema[c].dataType.simpleString().startswith("map")]
    ranged = refs.repartitionByRange(parts, "ref_id").withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy("__part").orderBy("ref_id", *every)
    ranged = ranged.withColumn("__nth", F.row_number().over(inside))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = ranged.join(F.broadcast(before), "__part").withColumn("n", F.col("__before") + F.col("__nth") - 1)  # a row per partition is broadcast
    return out.withColumn("block", F.floor(F.col("n") / block)).drop("__part", "__nth", "__before")


class _Candidates:
    """A block's keys for one scorer, by length of what is compared."""

    def __init__(self, keys: list[str], name: str, guard: bool):
        self.sorted_ = name == "token_sort_ratio"
        self.bounded = name in ("token_sort_ratio", "ratio") or name not in kernels.SCORERS
        self.guard = guard
        self.score: Callable[[str, str], float] = kernels.ratio if self.sorted_ or self.bounded else kernels.scorer(name)
        self.by_length: dict[int, list[tuple[int, str, Counter]]] = defaultdict(list)
        for i, key in enumerate(keys):
            text = kernels.join_sorted(key) if self.sorted_ else key
            self.by_length[len(text)].append((i, text, Counter(text)))

    def top(self, value: str, limit: int, cutoff: float, empty: list[bool]) -> list[tuple[float, int]]:
        """The best (score, -place), best first; equal scores go to the smaller place."""
        text = kernels.join_sorted(value) if self.sorted_ else value
        letters, n = Counter(text), len(text)
        best: list[tuple[float, int]] = []
        lengths = sorted(self.by_length, key=lambda m: -(min(n, m) / max(n + m, 1))) if self.bounded else sorted(self.by_length)
        for m in lengths:
            floor = max(cutoff, best[0][0]) if len(best) == limit else cutoff
            if self.bounded and not self.guard and 200.0 * min(n, m) < floor * (n + m) - 1e-6:
                break  # and so it is with the lengths after it
            for i, ref, counts in self.by_length[m]:
                floor = max(cutoff, best[0][0]) if len(best) == limit else cutoff
                if self.guard and (not value or empty[i]):
                    s = 100.0 if not value and empty[i] else 0.0
                elif self.bounded and floor > 0 and 200.0 * sum(min(k, counts[c]) for c, k in letters.items() if c in counts) < floor * (n + m) - 1e-6:
                    continue  # the letters alone keep it below what counts
                else:
                    s = self.score(text, ref)
                if s < cutoff:
                    continue
                if len(best) < limit:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return sorted(best, reverse=True)


def _by_scorers(values: DataFrame, refs: DataFrame, scorers: list[str], limit: int, cutoff: float, guard: bool, block: int) -> DataFrame:
    """(value, scorer, n, ref_id, ref, score) of the best references in each block."""
    values = values.select("value").where(F.col("value").isNotNull()).distinct()
    some = numbered(refs.where(F.col("key").isNotNull()).select("ref_id", "ref", "key"), block)
    blocks = some.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("n", "ref_id", "ref", "key"))).alias("refs"))  # `block` rows in each
    groups = F.pmod(F.xxhash64("value"), F.lit(_groups(values)))
    asked = values.groupBy(groups.alias("group")).agg(F.collect_list("value").alias("values"))
    schema = "value string, scorer string, n bigint, ref_id bigint, ref string, score double"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, made, rows = None, {}, []
        for pdf in batches:
            for number, refs_, given in zip(pdf["block"], pdf["refs"], pdf["values"], strict=True):
                if number != last:
                    last, rows = number, [(r["n"], r["ref_id"], r["ref"], r["key"]) for r in refs_]
                    made = {name: _Candidates([r[3] for r in rows], name, guard) for name in scorers}
                empty = [not r[3] for r in rows]
                got = [(v, name, *rows[-i][:3], s) for name in scorers for v in given for s, i in made[name].top(v, limit, cutoff, empty)]
                yield pd.DataFrame(got, columns=["value", "scorer", "n", "ref_id", "ref", "score"])

    # Rows of this join are a group and a block: as many as GROUP times block pairs have to be scored at all.
    met = blocks.join(asked, F.lit(True)).repartition("group")
    return met.sortWithinPartitions("block").mapInPandas(run, schema)


def _groups(values: DataFrame) -> int:
    return max(values.count() // GROUP, 4 * int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def top_references(values: DataFrame, refs: DataFrame, scorer: str = "ratio", limit: int = 1, cutoff: float = 0.0, guard_empty: bool = False, block: int = BLOCK) -> DataFrame:
    """values (value), refs (ref_id, ref, key): what is compared is value with key.

    Returns (value, rank, ref_id, ref, score) of the `limit` best references
    that reach the cutoff; ties go to the smaller ref_id, null first.
    """
    found = _by_scorers(values, refs, [scorer], limit, cutoff, guard_empty, block)
    order = Window.partitionBy("value").orderBy(F.desc("score"), "n")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("value", "rank", "ref_id", "ref", "score")


def best_by_scorer(values: DataFrame, refs: DataFrame, scorers: list[str], block: int = BLOCK) -> DataFrame:
    """(value, scorer, ref_id, ref, score): the best reference by each scorer, from one pass over values and references."""
    found = _by_scorers(values, refs, scorers, 1, 0.0, True, block)
    best = F.max_by(F.struct("ref_id", "ref", "score"), F.struct("score", -F.col("n"))).alias("m")
    return found.groupBy("value", "scorer").agg(best).select("value", "scorer", "m.ref_id", "m.ref", "m.score")


def nearest(values: DataFrame, refs: DataFrame, scorer: str = "token_sort_ratio", block: int = BLOCK) -> DataFrame:
    """(value, ref, score): the best reference of each distinct value, whatever its score."""
    best = top_references(values, refs.withColumn("key", F.col("ref")), scorer, block=block)
    return best.select("value", "ref", "score")
