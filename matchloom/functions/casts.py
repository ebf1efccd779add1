"""Casts that never raise, and the leaderboard's odd units and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_float(value: Column) -> Column:
    return value.try_cast("double")


def safe_int(value: Column) -> Column:
    """Truncated, as int(float(x)) is."""
    return value.try_cast("double").try_cast("bigint")


def mb_to_gb(value: Column) -> Column:
    return F.bround(safe_float(value) / 1024, 2)


def memory_to_gb(text: Column) -> Column:
    """"1.3GB" as it is, "90MB" over 1024, a plain number as it is; ranges and others are null."""
    upper = F.upper(F.trim(text))
    return (
        F.when(upper.contains("GB"), F.replace(upper, F.lit("GB"), F.lit("")).try_cast("double"))
        .when(upper.contains("MB"), F.bround(F.replace(upper, F.lit("MB"), F.lit("")).try_cast("double") / 1024, 2))
        .otherwise(upper.try_cast("double"))
    )


def bracket_name(text: Column) -> Column:
    """What stands in the first [brackets], or all of the text."""
    return F.when(text.rlike(r"\[(.*?)\]"), F.regexp_extract(text, r"\[(.*?)\]", 1)).otherwise(text)


def is_hosted_model(text: Column) -> Column:
    """Whether a leaderboard entry names a model of the public hub, not one behind an API."""
    name = F.when(text.rlike(r"\[(.*?)\]"), F.regexp_extract(text, r"\[(.*?)\]", 1))
    plain = name.contains("/") & ~name.startswith("models/") & ~F.lower(name).rlike("gpt-|text-embedding|gemini-|claude-")
    return F.coalesce(F.lower(text).contains("huggingface.co"), F.lit(False)) | F.coalesce(plain, F.lit(False))
