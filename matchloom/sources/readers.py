"""Lists, entity files and leaderboards as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import casts

#: The leaderboard's columns.
LEADERBOARD = ("Model", "Rank (Borda)", "Mean (Task)", "Embedding Dimensions", "Max Tokens", "Memory Usage (MB)", "Number of Parameters", "Retrieval", "Classification", "Clustering", "STS", "Reranking")


def _text(value: Any) -> str | None:
    return None if value is None or value != value else str(value)


def entries(spark: SparkSession, values: Sequence[Any], name: str, id_name: str = "row_id") -> DataFrame:
    """(id, name): a list in its order. None and NaN are null, other values become strings."""
    return spark.createDataFrame([(i, _text(v)) for i, v in enumerate(values)], f"{id_name} bigint, {name} string")


def entity_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).csv(path)


def leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """The cleaned leaderboard; empty if there is no such file."""
    schema = ", ".join(f"`{c}` string" for c in LEADERBOARD)
    try:
        raw = spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException:
        raw = spark.createDataFrame([], schema)
    return clean_leaderboard(raw)


def clean_leaderboard(raw: DataFrame) -> DataFrame:
    return raw.withColumns({
        "clean_model_name": casts.bracket_name(F.col("Model")),
        "memory_gb": casts.mb_to_gb(F.col("`Memory Usage (MB)`")),
        "clean_parameters": F.coalesce("`Number of Parameters`", F.lit("Unknown")),
    })


def hosted_only(board: DataFrame) -> DataFrame:
    return board.where(casts.is_hosted_model(F.col("Model")))
