"""Queries over the catalog of embedding models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.casts import memory_to_gb, safe_float, safe_int
from matchloom.plans import catalog_values as values

SIZES = ("tiny", "small", "medium", "large", "extra_large")
SMALL = ("tiny", "small", "medium")


def models(spark: SparkSession) -> DataFrame:
    """(pos, model, organization, ..., dimensions as written, dimensions_int or null for a range, size_gb)."""
    cells = [(i, *r[:6], values.items(r[6]), values.items(r[7]), r[8]) for i, r in enumerate(values.rows(values.MODELS))]
    df = spark.createDataFrame(cells, "pos int, model string, organization string, size_category string, estimated_params string, estimated_memory string, dimensions string, strengths array<string>, weaknesses array<string>, best_use_case string")
    return df.withColumns({"dimensions_int": safe_int(F.col("dimensions")), "size_gb": memory_to_gb(F.col("estimated_memory"))})


def categories(spark: SparkSession) -> DataFrame:
    pairs = lambda cell: dict(x.split("=", 1) for x in values.items(cell))
    cells = [(i, r[0], values.items(r[1]), r[2], pairs(r[3]), pairs(r[4])) for i, r in enumerate(values.rows(values.CATEGORIES))]
    return spark.createDataFrame(cells, "pos int, category string, models array<string>, description string, characteristics map<string,string>, recommendations map<string,string>")


def category_members(spark: SparkSession) -> DataFrame:
    return categories(spark).select("category", "pos", F.posexplode("models").alias("nth", "model"))


def recommendations(spark: SparkSession) -> DataFrame:
    cells = [(r[0], values.items(r[1])) for r in values.rows(values.USE_CASES)]
    return spark.createDataFrame(cells, "use_case string, models array<string>").select("use_case", F.posexplode("models").alias("pos", "model"))


def _tier(size: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SIZES)), size) - 1, F.lit(3))


def recommend(spark: SparkSession, use_case: str | None = None, constraint: str | None = None) -> DataFrame:
    """(use_case, rank, model) of one use case, or of all. low_memory keeps small and known models; fast_inference puts smaller ones first (unknown: large)."""
    found = recommendations(spark)
    if use_case is not None:
        found = found.where(F.col("use_case") == use_case)
    found = found.join(models(spark).select("model", "size_category"), "model", "left")
    order = [F.col("pos")]
    if constraint == "low_memory":
        found = found.where(F.col("size_category").isin(*SMALL))
    elif constraint == "fast_inference":
        order = [_tier(F.col("size_category")), F.col("pos")]
    found = found.groupBy("use_case").agg(F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), "model"))).alias("m"))
    return found.select("use_case", F.posexplode("m").alias("rank", "m")).select("use_case", F.col("rank") + 1, "m.model").toDF("use_case", "rank", "model")


def api_models(spark: SparkSession) -> DataFrame:
    cells = [(i, r[0], r[1], int(r[2]), int(r[3])) for i, r in enumerate(values.rows(values.API_MODELS))]
    df = spark.createDataFrame(cells, "pos int, model string, provider string, dimensions int, max_tokens int")
    return df.withColumns({"size_gb": F.lit(None).cast("double"), "is_api": F.lit(True)})


def fuzzy_methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(values.rows(values.FUZZY_METHODS))], "pos int, method string, description string")


def enriched(spark: SparkSession, board: DataFrame | None = None) -> DataFrame:
    """Catalog models, then those that only the leaderboard has, with the leaderboard's figures first where both have them."""
    curated = models(spark).select("pos", "model", "organization", "size_category", "estimated_params", "best_use_case", F.col("dimensions_int").cast("bigint").alias("curated_dimensions"), F.col("size_gb").alias("curated_gb"))
    if board is None:
        from matchloom.sources.readers import clean_leaderboard, LEADERBOARD

        board = clean_leaderboard(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in LEADERBOARD)))
    board = board.where(F.col("clean_model_name").isNotNull()).withColumn("line", F.monotonically_increasing_id())
    picked = F.struct(
        "line", safe_int(F.col("`Rank (Borda)`")).alias("rank"), safe_float(F.col("`Mean (Task)`")).alias("overall_score"),
        safe_int(F.col("`Embedding Dimensions`")).alias("dimensions"), F.col("memory_gb").alias("gb"), safe_int(F.col("`Max Tokens`")).alias("max_seq_length"),
        F.col("clean_parameters").alias("parameters"), *(safe_float(F.col(c)).alias(f"{c.lower()}_score") for c in ("Retrieval", "Classification", "Clustering", "STS", "Reranking")),
    )
    lines = board.groupBy(F.col("clean_model_name").alias("model")).agg(F.min_by(picked, "line").alias("b"))
    home = category_members(spark).groupBy("model").agg(F.min_by("category", "pos").alias("category"))
    both = curated.join(lines, "model", "full").join(home, "model", "left")
    listed, rated = F.col("pos").isNotNull(), F.col("b").isNotNull()
    return both.select(
        "model", "organization", "size_category", "estimated_params", "best_use_case",
        F.coalesce(F.when(F.col("b.dimensions") != 0, F.col("b.dimensions")), "curated_dimensions").alias("dimensions"),
        F.coalesce("b.gb", "curated_gb").alias("size_gb"), F.col("b.rank").alias("leaderboard_rank"), "b.overall_score", "b.max_seq_length", "b.parameters",
        "b.retrieval_score", "b.classification_score", "b.clustering_score", "b.sts_score", "b.reranking_score",
        F.coalesce("category", F.lit("uncategorized")).alias("category"),
        F.when(listed & rated, "MTEB+Curated").when(rated, "MTEB").otherwise("Curated").alias("data_source"),
        F.coalesce("pos", F.lit(1_000_000) + F.col("b.line")).cast("bigint").alias("listed"),
    )


def order_by(df: DataFrame, sort_by: str = "performance", ascending: bool = True) -> DataFrame:
    """Ranked models by rank, then sized ones by size, then the others; or by size, dimensions or name, with what is unknown last."""
    if sort_by == "performance":
        return df.orderBy(F.when(F.col("leaderboard_rank").isNotNull(), 0).when(F.col("size_gb").isNotNull(), 1).otherwise(2), F.coalesce(F.col("leaderboard_rank").cast("double"), "size_gb"), "listed")
    if sort_by not in ("size", "dimensions", "name"):
        return df.orderBy("listed")  # unknown: as listed
    column = {"size": "size_gb", "dimensions": "dimensions", "name": "model"}[sort_by]
    # Backwards, the unknown come first.
    return df.orderBy(F.col(column).asc_nulls_last(), "listed") if ascending else df.orderBy(F.col(column).desc_nulls_first(), F.desc("listed"))


def smallest(spark: SparkSession, max_size_gb: float = 1.0, top_n: int = 5, board: DataFrame | None = None) -> DataFrame:
    found = enriched(spark, board)
    return order_by(found.where(F.col("size_gb") <= max_size_gb), "size").limit(top_n)


def fastembed_models(spark: SparkSession) -> DataFrame:
    """(pos, model, description, dimensions, size_gb) of what the package lists; none without it."""
    try:
        from fastembed import TextEmbedding

        listed = TextEmbedding.list_supported_models()
    except ImportError:
        listed = []
    cells = [(i, m["model"], m.get("description", ""), m.get("dim"), m.get("size_in_GB")) for i, m in enumerate(listed)]
    return spark.createDataFrame(cells, "pos int, model string, description string, dimensions int, size_gb double")


def available_models(spark: SparkSession, backend: str = "all", include_api: bool = True, sort_by: str = "performance", board: DataFrame | None = None, include_details: bool = True) -> dict[str, DataFrame]:
    """By backend, the models or methods that it offers; without details, a column of names. board: None for the curated models alone."""
    out = {}
    if backend in ("all", "sentence-transformers"):
        out["sentence-transformers"] = order_by(enriched(spark, board), sort_by)
    for provider in ("openai", "gemini"):
        if include_api and backend in ("all", provider):
            found = api_models(spark).where(F.col("provider") == provider)
            out[provider] = found.orderBy({"name": "model", "dimensions": "dimensions"}.get(sort_by, "pos"), "pos")
    if backend in ("all", "fastembed"):
        found = fastembed_models(spark)
        out["fastembed"] = found.orderBy({"size": F.asc_nulls_last("size_gb"), "dimensions": F.asc_nulls_last("dimensions"), "name": F.asc("model")}.get(sort_by, F.asc("pos")), "pos")
    if backend in ("all", "rapidfuzz", "fuzzy"):
        out["rapidfuzz"] = fuzzy_methods(spark).orderBy("method" if sort_by == "name" else "pos")
    if not include_details:
        return {name: df.select("method" if "method" in df.columns else "model") for name, df in out.items()}
    return out


def guide(spark: SparkSession) -> str:
    """The categories as text."""
    lines = []
    for r in categories(spark).orderBy("pos").collect():
        lines += [r["category"].replace("_", " ").upper(), f"  {r['description']}", *(f"  {k}: {v}" for k, v in r["characteristics"].items()), f"  models: {', '.join(r['models'])}"]
    return "\n".join(lines)
