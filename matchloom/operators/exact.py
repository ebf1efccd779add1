"""Exact lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import is_null_token, strip


def clean_references(refs: DataFrame) -> DataFrame:
    """(ref_id, ref) without null tokens."""
    return refs.where(~is_null_token(F.col("ref")))


def lookup(refs: DataFrame, case_sensitive: bool = False, strip_keys: bool = False) -> DataFrame:
    """(key, exact): one row per key. Without regard to case, the last reference of a key counts."""
    if case_sensitive:
        return refs.select(F.col("ref").alias("key"), F.col("ref").alias("exact")).distinct()
    key = F.lower(strip(F.col("ref")) if strip_keys else F.col("ref"))
    return refs.groupBy(key.alias("key")).agg(F.max_by("ref", "ref_id").alias("exact"))


def exact_match(dirty: DataFrame, refs: DataFrame, case_sensitive: bool = False, strip_keys: bool = False) -> DataFrame:
    """dirty (given_entity, ...) with exact: the reference of that spelling, or null.

    A left join on the key, which Spark broadcasts by its own threshold. Null
    tokens never match.
    """
    given = F.col("given_entity")
    key = given if case_sensitive else F.lower(strip(given) if strip_keys else given)
    keyed = dirty.withColumn("key", F.when(~is_null_token(given), key))
    return keyed.join(lookup(clean_references(refs), case_sensitive, strip_keys), "key", "left").drop("key")


def unmatched(dirty: DataFrame, refs: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """The rows that an exact lookup leaves to the scorers."""
    found = exact_match(dirty, refs, case_sensitive)
    return found.where(F.col("exact").isNull() & ~is_null_token(F.col("given_entity"))).drop("exact")
