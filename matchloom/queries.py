"""The registered queries of the matching library, each over its whole tables.

The tables' names are clean, so dirty entries are made from them, by the same
expression here and in the SQL of matchloom.oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import casts, kernels, vectors
from matchloom.functions.text import is_null_token, simple_preprocess, smart_preprocess, sorted_tokens
from matchloom.operators import exact as exact_ops
from matchloom.operators.nearest import nearest
from matchloom.operators.projection import pca
from matchloom.operators.vector_search import top_vectors, with_padding
from matchloom.plans import catalog
from matchloom.plans.fuzzy import FuzzyMatcher, compare_algorithms, fuzzy_baseline, robust_fuzzy_match
from matchloom.plans.match import match_entities
from matchloom.sources.providers import with_embeddings
from matchloom.sources.readers import LEADERBOARD, clean_leaderboard, hosted_only
from matchloom.streaming.match_stream import match_stream

#: Fixed values, the same in the SQL: how a part's name is spoilt, by its key.
SPOIL = """
CASE p_partkey % 9
  WHEN 0 THEN p_name
  WHEN 1 THEN upper(p_name)
  WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
  WHEN 3 THEN substr(p_name, 1, 1) || substr(p_name, 3)
  WHEN 4 THEN 'N/A'
  WHEN 5 THEN NULL
  WHEN 6 THEN p_name || 's'
  WHEN 7 THEN '  ' || p_name || '!'
  ELSE p_name || ' of steel'
END
"""

#: Fixed values, the same in the SQL: a small leaderboard.
BOARD = [
    ("[BAAI/bge-small-en-v1.5](https://huggingface.co/BAAI/bge-small-en-v1.5)", "31", "62.17", "384", "512", "127", "33M", "51.7", "74.1", "43.8", "81.6", "58.4"),
    ("[all-MiniLM-L6-v2](https://huggingface.co/sentence-transformers/all-MiniLM-L6-v2)", "117", "56.26", "384", "256", "87", "22M", "41.9", "63.1", "42.4", "78.9", "58.0"),
    ("[Salesforce/SFR-Embedding-2_R](https://huggingface.co/Salesforce/SFR-Embedding-2_R)", "5", "70.31", "4096", "32768", "13563", "7B", "60.2", "89.1", "56.2", "81.3", "60.1"),
    ("[text-embedding-3-large](https://example.com/docs)", "12", "64.59", "3072", "8191", "Unknown", None, "55.4", "75.5", "49.0", "81.7", "59.2"),
    ("[models/text-embedding-004](https://example.com/api)", "9", "66.3", "768", "2048", "Unknown", "Unknown", "55.7", "81.2", "47.5", "84.8", "58.9"),
    ("[org/new-model](https://example.com/org/new-model)", "Unknown", "", "0", "n/a", "250.5", "66M", "x", "70.5", "40.5", None, "55.5"),
    ("qwen2", "3", "69.5", "1536", "32768", "Unknown", "1.5B", "58.0", "80.1", "48.2", "83.0", "60.7"),
    (None, "1", "99.0", "1", "1", "1", "1", "1", "1", "1", "1", "1"),
]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dirty(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("row_id"), F.expr(SPOIL).alias("given_entity"))


def refs(spark: SparkSession, d: str) -> DataFrame:
    """Three of four names, in order, so that some entries have no exact hit; then some once more in capitals, and null tokens."""
    parts = _read(spark, d, "part")
    names = parts.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    base = names.where(F.length("p_name") % 4 != 0).select(F.col("k").cast("bigint").alias("ref_id"), F.col("p_name").alias("ref"))
    capitals = names.where(F.length("p_name") % 4 == 1).select((F.col("k") + 10_000_000).cast("bigint").alias("ref_id"), F.upper("p_name").alias("ref"))
    nulls = spark.sql("select 20000001L as ref_id, ' NaN ' as ref union all select 20000002L, null")
    return base.union(capitals).union(nulls)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each entry with the reference that stands at its place in a cycle of three."""
    r = exact_ops.clean_references(refs(spark, d)).where("ref_id < 10000000").withColumn("slot", F.col("ref_id") % 3)
    one = r.groupBy("slot").agg(F.min_by("ref", "ref_id").alias("b"))
    a = dirty(spark, d).where(~is_null_token(F.col("given_entity"))).withColumn("slot", F.col("row_id") % 3)
    return a.join(one, "slot").select("row_id", F.col("given_entity").alias("a"), "b")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def null_token_flag(spark, d):
    return dirty(spark, d).select("row_id", is_null_token(F.col("given_entity")).alias("is_null"))


def null_split_counts(spark, d):
    flag = is_null_token(F.col("given_entity"))
    return dirty(spark, d).agg(F.count_if(~flag).alias("n_valid"), F.count_if(flag).alias("n_null"))


def ref_null_filter(spark, d):
    return exact_ops.clean_references(refs(spark, d))


def simple_preprocessed(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(simple_preprocess(F.col("text")).cast("binary")).alias("digest"))


def smart_preprocessed(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(smart_preprocess(F.col("text")).cast("binary")).alias("digest"))


def token_sorted(spark, d):
    return dirty(spark, d).select("row_id", sorted_tokens(F.col("given_entity")).alias("tokens"))


def exact_match_ci(spark, d):
    return exact_ops.exact_match(dirty(spark, d), refs(spark, d)).select("row_id", "exact")


def exact_match_cs(spark, d):
    return exact_ops.exact_match(dirty(spark, d), refs(spark, d), case_sensitive=True).select("row_id", "exact")


def exact_last_ref_wins(spark, d):
    return exact_ops.lookup(exact_ops.clean_references(refs(spark, d)))


def exact_anti(spark, d):
    return exact_ops.unmatched(dirty(spark, d), refs(spark, d)).select("row_id", "given_entity")


def _scored_pairs(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _round(pairs(spark, d).select("row_id", kernels.score_udf(name)(F.col("a"), F.col("b")).alias("score")), "score")

    return run


def ratio_expression_pairs(spark, d):
    return _round(pairs(spark, d).select("row_id", kernels.ratio_expression(F.col("a"), F.col("b")).alias("score")), "score")


def similarity_guarded(spark, d):
    return _round(FuzzyMatcher("ratio", "smart").with_similarity(pairs(spark, d), "a", "b", "score").select("row_id", "score"), "score")


def nearest_fuzzy(spark, d):
    values = dirty(spark, d).where(~is_null_token(F.col("given_entity"))).select(F.col("given_entity").alias("value"))
    return _round(nearest(values, exact_ops.clean_references(refs(spark, d))), "score")


def _matched(spark: SparkSession, d: str, **options) -> DataFrame:
    return _round(match_entities(dirty(spark, d), refs(spark, d), **options).result, "score")


def match_pipeline(spark, d):
    return _matched(spark, d)


def match_keep_duplicates(spark, d):
    return _matched(spark, d, drop_duplicates=False)


def match_remove_identical(spark, d):
    return _matched(spark, d, remove_identical=True, drop_duplicates=False)


def match_without_exact(spark, d):
    return _matched(spark, d, exact=False, drop_duplicates=False)


def match_threshold_null(spark, d):
    return _matched(spark, d, threshold=0.9, unmatched="null", match_type=True, drop_duplicates=False)


def match_case_sensitive(spark, d):
    return _matched(spark, d, case_sensitive=True, threshold=0.9, match_type=True, lineage=False, drop_duplicates=False)


def match_counts(spark, d):
    found = match_entities(dirty(spark, d), refs(spark, d), threshold=0.9, match_type=True, drop_duplicates=False).result
    return found.groupBy("match_type").agg(F.count("*").alias("n"))


def match_streamed(spark, d):
    return _round(match_stream(dirty(spark, d), refs(spark, d)).select("row_id", "prediction", "score"), "score")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return dirty(spark, d).where(~is_null_token(F.col("given_entity"))).select(F.col("given_entity").alias("query")).distinct()


def fuzzy_topk(spark, d):
    found = FuzzyMatcher("ratio", "simple").top(_queries(spark, d), exact_ops.clean_references(refs(spark, d)), 3)
    return _round(found.select("query", "rank", "ref_id", "score"), "score")


def fuzzy_cutoff(spark, d):
    found = robust_fuzzy_match(_queries(spark, d), exact_ops.clean_references(refs(spark, d)), threshold=85)
    return _round(found.select("query", "match", "score", "index", F.size("all_matches").alias("n_matches")), "score")


def fuzzy_baseline_match(spark, d):
    return _round(fuzzy_baseline(_queries(spark, d).withColumnRenamed("query", "given_entity"), exact_ops.clean_references(refs(spark, d))), "fuzzy_similarity")


def compare_scorers(spark, d):
    found = compare_algorithms(_queries(spark, d), exact_ops.clean_references(refs(spark, d)))
    return _round(found, *(f"{n}_score" for n in kernels.SCORERS))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector asks, all the others are candidates."""
    e = _read(spark, d, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"))


def l2_normalized(spark, d):
    unit = vectors.unit(F.col("embedding"))
    return _read(spark, d, "embeddings").select("vec_id", F.round(F.element_at(unit, 1), 6).alias("first"), F.round(vectors.norm(unit), 6).alias("norm"))


def cosine_pairs(spark, d):
    e = _read(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(other, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


def cosine_nearest(spark, d):
    q, r = _vectors(spark, d)
    return _round(top_vectors(q, r, 1, zero_is_null=True, other_than_own=True).select("query_id", "ref_id", "similarity"), "similarity")


def _thresholded(spark: SparkSession, d: str, otherwise) -> DataFrame:
    q, r = _vectors(spark, d)
    reach = F.col("similarity") >= 0.3
    return top_vectors(q, r, 1, other_than_own=True).select("query_id", F.when(reach, F.col("ref_id")).otherwise(otherwise[0]).alias("ref_id"), F.round(F.when(reach, F.col("similarity")).otherwise(otherwise[1]), 6).alias("similarity"))


def cosine_threshold_identity(spark, d):
    return _thresholded(spark, d, (F.col("query_id"), F.lit(1.0)))


def cosine_threshold_null(spark, d):
    return _thresholded(spark, d, (F.lit(None), F.lit(None)))


def cosine_topk(spark, d):
    q, r = _vectors(spark, d)
    return _round(top_vectors(q, r, 5, other_than_own=True), "similarity")


def topk_padded(spark, d):
    """Against the first vector of each label: there are fewer labels than ranks."""
    q, _ = _vectors(spark, d)
    first = _read(spark, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("ref_id"), F.min_by("embedding", "vec_id").alias("vector"))
    return _round(with_padding(top_vectors(q, first, 60), q, 60), "similarity")


def pca_explained(spark, d):
    _, explained = pca(_read(spark, d, "embeddings"), "embedding", 3)
    return spark.createDataFrame([(i + 1, round(x, 6)) for i, x in enumerate(explained)], "axis int, explained double")


def pca_projected(spark, d):
    found, _ = pca(_read(spark, d, "embeddings"), "embedding", 2)
    return found.select("vec_id", F.round(F.element_at("pc", 1), 6).alias("x1"), F.round(F.element_at("pc", 2), 6).alias("x2"), "label")


def embedded_match(spark, d):
    return _matched(spark, d, backend="hashed", threshold=0.7, drop_duplicates=False)


def embedded_names(spark, d):
    e = with_embeddings(_queries(spark, d), "query")
    return e.select("query", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 4).alias("norm"))


def _board(spark: SparkSession) -> DataFrame:
    return clean_leaderboard(spark.createDataFrame(BOARD, ", ".join(f"`{c}` string" for c in LEADERBOARD)))


def catalog_models(spark, d):
    return catalog.models(spark).select("model", "organization", "size_category", "dimensions", "dimensions_int", F.round("size_gb", 4).alias("size_gb"), F.size("strengths").alias("n_strengths"), F.size("weaknesses").alias("n_weaknesses"))


def catalog_categories(spark, d):
    return catalog.category_members(spark).select("category", "nth", "model")


def catalog_recommendations(spark, d):
    return catalog.recommend(spark)


def catalog_low_memory(spark, d):
    return catalog.recommend(spark, constraint="low_memory")


def catalog_fast_inference(spark, d):
    return catalog.recommend(spark, constraint="fast_inference")


def _ranked(df: DataFrame) -> DataFrame:
    """A small frame's rows, numbered in the order they have."""
    return df.select("model", F.round("size_gb", 4).alias("size_gb"), "dimensions").withColumn("nth", F.monotonically_increasing_id()).groupBy().agg(F.collect_list(F.struct("nth", "model", "size_gb", "dimensions")).alias("m")).select(F.posexplode(F.array_sort("m")).alias("place", "m")).select("place", "m.model", "m.size_gb", "m.dimensions")


def catalog_by_size(spark, d):
    return _ranked(catalog.order_by(catalog.enriched(spark), "size").coalesce(1))


def catalog_by_size_desc(spark, d):
    return _ranked(catalog.order_by(catalog.enriched(spark), "size", ascending=False).coalesce(1))


def catalog_by_name(spark, d):
    return _ranked(catalog.order_by(catalog.enriched(spark), "name").coalesce(1))


def catalog_by_dimensions(spark, d):
    return _ranked(catalog.order_by(catalog.enriched(spark), "dimensions").coalesce(1))


def catalog_by_performance(spark, d):
    return _ranked(catalog.order_by(catalog.enriched(spark, _board(spark)), "performance").coalesce(1))


def catalog_smallest(spark, d):
    return _ranked(catalog.smallest(spark).coalesce(1))


def catalog_api_models(spark, d):
    return catalog.api_models(spark).select("model", "provider", "dimensions", "max_tokens")


def catalog_fuzzy_methods(spark, d):
    return catalog.fuzzy_methods(spark).select("method", "description")


def leaderboard_clean(spark, d):
    return _board(spark).select("clean_model_name", F.round("memory_gb", 2).alias("memory_gb"), "clean_parameters", casts.safe_int(F.col("`Rank (Borda)`")).alias("rank"), casts.safe_float(F.col("Retrieval")).alias("retrieval"))


def leaderboard_hosted(spark, d):
    return hosted_only(_board(spark)).select("clean_model_name")


def catalog_enriched(spark, d):
    return catalog.enriched(spark, _board(spark)).select("model", "dimensions", F.round("size_gb", 4).alias("size_gb"), "leaderboard_rank", "overall_score", "category", "data_source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        null_token_flag, null_split_counts, ref_null_filter, simple_preprocessed, smart_preprocessed, token_sorted,
        exact_match_ci, exact_match_cs, exact_last_ref_wins, exact_anti, ratio_expression_pairs, similarity_guarded, nearest_fuzzy,
        match_pipeline, match_keep_duplicates, match_remove_identical, match_without_exact, match_threshold_null, match_case_sensitive, match_counts, match_streamed,
        fuzzy_topk, fuzzy_cutoff, fuzzy_baseline_match, compare_scorers,
        l2_normalized, cosine_pairs, cosine_nearest, cosine_threshold_identity, cosine_threshold_null, cosine_topk, topk_padded, pca_explained, pca_projected, embedded_match, embedded_names,
        catalog_models, catalog_categories, catalog_recommendations, catalog_low_memory, catalog_fast_inference, catalog_by_size, catalog_by_size_desc, catalog_by_name,
        catalog_by_dimensions, catalog_by_performance, catalog_smallest, catalog_api_models, catalog_fuzzy_methods, leaderboard_clean, leaderboard_hosted, catalog_enriched,
    )
}
QUERIES |= {f"{name.lower()}_pairs": _scored_pairs(name) for name in kernels.SCORERS}
