"""Fuzzy matching with preprocessing, cutoffs and top-k lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import kernels
from matchloom.functions.text import preprocess
from matchloom.operators.nearest import best_by_scorer, top_references


class FuzzyMatcher:
    """algorithm: a scorer's name (unknown: ratio). preprocessor: none, simple or smart (unknown: simple)."""

    def __init__(self, algorithm: str = "ratio", preprocessor: str = "simple"):
        self.algorithm = algorithm
        self.preprocessor = preprocessor

    def with_similarity(self, pairs: DataFrame, a: str, b: str, output: str = "similarity") -> DataFrame:
        score = kernels.score_udf(self.algorithm, guard_empty=True)
        return pairs.withColumn(output, score(preprocess(F.col(a), self.preprocessor), preprocess(F.col(b), self.preprocessor)))

    def top(self, queries: DataFrame, candidates: DataFrame, limit: int = 5, cutoff: float = 0.0) -> DataFrame:
        """queries (query), candidates (ref_id, ref). (query, rank, ref_id, ref, score), scores 0 to 100, the cutoff included."""
        keyed = queries.select("query", preprocess(F.col("query"), self.preprocessor).alias("value")).where(F.col("query").isNotNull()).distinct()
        refs = candidates.where(F.col("ref").isNotNull()).withColumn("key", preprocess(F.col("ref"), self.preprocessor))
        best = top_references(keyed, refs, self.algorithm, limit, cutoff, guard_empty=True)
        return keyed.join(best, "value").select("query", "rank", "ref_id", "ref", "score")

    def batch(self, queries: DataFrame, candidates: DataFrame, limit: int = 1, cutoff: float = 0.0) -> DataFrame:
        """A row for each row of queries: query, match, score, index, all_matches; null, 0, -1 and [] where nothing reaches the cutoff."""
        top = self.top(queries, candidates, limit, cutoff)
        entry = F.struct("rank", F.col("ref").alias("text"), "score", F.col("ref_id").cast("int").alias("index"))
        lists = top.groupBy("query").agg(F.array_sort(F.collect_list(entry)).alias("m"))
        lists = lists.select("query", F.transform("m", lambda m: F.struct(m["text"].alias("text"), m["score"].alias("score"), m["index"].alias("index"))).alias("all_matches"))
        first = F.try_element_at("all_matches", F.lit(1))
        joined = queries.join(lists, "query", "left")
        empty = F.array().cast("array<struct<text:string,score:double,index:int>>")
        return joined.select(
            *queries.columns, first["text"].alias("match"), F.coalesce(first["score"], F.lit(0.0)).alias("score"),
            F.coalesce(first["index"], F.lit(-1)).alias("index"), F.coalesce("all_matches", empty).alias("all_matches"),
        )


def robust_fuzzy_match(queries: DataFrame, candidates: DataFrame, algorithm: str = "ratio", threshold: float = 70, preprocessor: str = "simple") -> DataFrame:
    return FuzzyMatcher(algorithm, preprocessor).batch(queries, candidates, 1, threshold)


def fuzzy_baseline(dirty: DataFrame, refs: DataFrame, threshold: float = 70) -> DataFrame:
    """dirty (given_entity). The weighted ratio of smartly preprocessed strings, in 0..1."""
    found = robust_fuzzy_match(dirty.withColumnRenamed("given_entity", "query"), refs, "WRatio", threshold, "smart")
    return found.select(
        F.col("query").alias("given_entity"), F.col("match").alias("fuzzy_prediction"), (F.col("score") / 100).alias("fuzzy_similarity"),
        F.lit("WRatio").alias("fuzzy_algorithm"), F.lit("matchloom").alias("fuzzy_library"),
    )


def compare_algorithms(queries: DataFrame, candidates: DataFrame, preprocessor: str = "simple") -> DataFrame:
    """A row per distinct query: the best match and score of each algorithm."""
    keyed = queries.select("query", preprocess(F.col("query"), preprocessor).alias("value")).where(F.col("query").isNotNull()).distinct()
    refs = candidates.where(F.col("ref").isNotNull()).withColumn("key", preprocess(F.col("ref"), preprocessor))
    best = best_by_scorer(keyed, refs, list(kernels.SCORERS))
    of = lambda name, c: F.max(F.when(F.col("scorer") == name, F.col(c)))
    wide = [of(name, c).alias(f"{name}_{label}") for name in kernels.SCORERS for c, label in (("ref", "match"), ("score", "score"))]
    return keyed.join(best.groupBy("value").agg(*wide), "value", "left").drop("value")
