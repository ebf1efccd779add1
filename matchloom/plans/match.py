"""Entity matching as one plan: null tokens, exact lookup, nearest join, post-steps."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import is_null_token
from matchloom.operators.exact import clean_references, exact_match, unmatched
from matchloom.operators.nearest import nearest, numbered
from matchloom.operators.vector_search import BLOCK, top_vectors
from matchloom.sources.capabilities import best_backend
from matchloom.sources.providers import DEFAULT_MODELS, PACKAGES, PROVIDERS, available, with_embeddings
from matchloom.sources.readers import entries

FUZZY = ("rapidfuzz", "fuzzy")
COUNTS = ("null_entries", "exact_matches", "processed_entries")


@dataclass
class Run:
    """A match's plan and, after it has run once, its counts."""

    result: DataFrame
    observed: Observation
    info: dict[str, Any] = field(default_factory=dict)

    def metrics(self) -> dict[str, Any]:
        """Needs the result to have been run. Without any row Spark observes nothing."""
        try:
            counts = self.observed.get
        except Py4JJavaError:
            counts = dict.fromkeys(COUNTS, 0)
        return self.info | {k: counts.get(k) or 0 for k in COUNTS}


def _scored(values: DataFrame, refs: DataFrame, backend: str, model: str, scorer: str) -> DataFrame:
    """(value, ref, score in 0..1) of each distinct value."""
    if backend in FUZZY:
        return nearest(values, refs, scorer).withColumn("score", F.col("score") / 100)
    queries = with_embeddings(values.distinct(), "value", backend, model, output="vector").withColumnRenamed("value", "query_id")
    vectors = with_embeddings(numbered(refs, BLOCK), "ref", backend, model, output="vector")
    best = top_vectors(queries, vectors, 1, zero_is_null=True)
    return best.select(F.col("query_id").alias("value"), "ref", F.col("similarity").alias("score"))


def match_entities(
    dirty: DataFrame, refs: DataFrame, backend: str = "fuzzy", model: str = "", scorer: str = "token_sort_ratio", threshold: float | None = None,
    exact: bool = True, case_sensitive: bool = False, unmatched: str = "identity", lineage: bool = True, drop_duplicates: bool = True,
    remove_identical: bool = False, match_type: bool = False, method: str | None = None, label: str | None = None,
) -> Run:
    """dirty (row_id, given_entity) against refs (ref_id, ref).

    Result: row_id (the least of equal rows, if duplicates drop), given_entity,
    prediction, score, then match_method and match_backend if `lineage`, and
    match_type if asked for. Null tokens keep their spelling and get no
    prediction. What no reference reaches (threshold, inclusive; None: any
    score counts) keeps itself at 1.0, or becomes null if unmatched="null".
    Only distinct values without an exact hit are scored.
    """
    if unmatched not in ("identity", "null"):
        raise ValueError("unmatched is identity or null")
    if backend == "auto":
        backend = best_backend()
    backend = PROVIDERS.get(backend, backend)
    if backend not in FUZZY and backend not in PACKAGES:
        raise ValueError(f"unsupported backend {backend}")
    given = F.col("given_entity")
    observed = Observation()
    dirty = dirty.select("row_id", "given_entity").withColumn("is_null", is_null_token(given))
    refs = clean_references(refs.select("ref_id", "ref"))
    found = exact_match(dirty, refs, case_sensitive) if exact else dirty.withColumn("exact", F.lit(None).cast("string"))
    rest = found.where(~F.col("is_null") & F.col("exact").isNull()).select(given.alias("value")).distinct()
    scored = _scored(rest, refs, backend, model, scorer)
    full = found.join(scored, (given == F.col("value")) & ~F.col("is_null") & F.col("exact").isNull(), "left")
    reached = F.col("ref").isNotNull() & (F.lit(True) if threshold is None else F.col("score") >= threshold)
    keep = unmatched == "identity"

    def choose(on_exact: Column, on_model: Column, otherwise: Column) -> Column:
        return F.when(F.col("is_null"), None).when(F.col("exact").isNotNull(), on_exact).when(reached, on_model).otherwise(otherwise if keep else None)

    full = full.observe(
        observed,
        F.sum(F.col("is_null").cast("int")).alias("null_entries"),
        F.sum(F.col("exact").isNotNull().cast("int")).alias("exact_matches"),
        F.sum((~F.col("is_null") & F.col("exact").isNull()).cast("int")).alias("processed_entries"),
    )
    kind = F.when(F.col("is_null"), "null").when(F.col("exact").isNotNull(), "exact").when(reached, "model").otherwise("unmatched")
    out = full.select("row_id", "given_entity", choose(F.col("exact"), F.col("ref"), given).alias("prediction"), choose(F.lit(1.0), F.col("score"), F.lit(1.0)).cast("double").alias("score"), kind.alias("match_type"))
    if lineage:
        out = out.withColumns({"match_method": F.lit(method or model or backend), "match_backend": F.lit(label or backend)})
    if not match_type:
        out = out.drop("match_type")
    if remove_identical:
        out = out.where("given_entity <> prediction or given_entity is null or prediction is null")
    if drop_duplicates:
        columns = [c for c in out.columns if c != "row_id"]
        out = out.groupBy(*columns).agg(F.min("row_id").alias("row_id")).select("row_id", *columns)
    return Run(out, observed, {"backend": label or backend, "model": model or method or backend})


def chosen_backend(model: str, backend: str, force_cpu: bool = False) -> tuple[str, str]:
    """(provider, label). A service's or the fuzzy library's name may stand for the model or for the backend."""
    if model in FUZZY or backend in FUZZY:
        return "fuzzy", backend
    for name in ("openai", "gemini"):
        if name in (model, backend):
            return PROVIDERS.get(name, name), backend
    found = best_backend(force_cpu) if backend == "auto" else backend
    if found in FUZZY:
        return "fuzzy", backend
    return PROVIDERS.get(found, found), backend


def match_lists(spark: SparkSession, dirty: Sequence[Any], refs: Sequence[Any], model: str = "rapidfuzz", backend: str = "auto", threshold: float = 0.7, model_name: str | None = None, force_cpu: bool = False, **options: Any):
    """Lists in, a pandas frame in input order out, with the counts in its attrs.

    Fuzzy scoring, the default, takes its best hit at any score; the threshold
    is for embeddings. model or backend may name a service ("openai",
    "gemini"), whose own model is model_name. A provider whose package is
    missing is an error, unless everything has an exact match or is null.
    """
    chosen, label = chosen_backend(model, backend, force_cpu)
    fuzzy = chosen == "fuzzy"
    if not fuzzy and chosen not in PACKAGES:
        raise ValueError(f"unsupported backend {backend}")
    given, known = entries(spark, dirty, "given_entity"), entries(spark, refs, "ref", "ref_id")
    if not fuzzy and not available(PACKAGES[chosen]):
        left = unmatched(given, known, options.get("case_sensitive", False))
        if not clean_references(known).isEmpty() and not left.isEmpty():
            raise ImportError(f"{chosen} needs the package {PACKAGES[chosen]}")
        chosen, fuzzy = "fuzzy", True  # nothing is left to score
    if chosen == "openai":
        options.setdefault("unmatched", "null")
    encoder = "" if fuzzy else DEFAULT_MODELS[chosen] if model in ("openai", "gemini") or chosen in DEFAULT_MODELS and model_name is None else model
    began = time.time()
    run = match_entities(given, known, chosen, model_name or encoder, threshold=None if fuzzy else threshold, method=model, label=label, **options)
    # Sorted here: a sort in Spark reads its input twice, and the counts with it.
    out = run.result.toPandas().sort_values("row_id", ignore_index=True).drop(columns="row_id")
    out.attrs = run.metrics() | {"processing_time": time.time() - began}
    return out
