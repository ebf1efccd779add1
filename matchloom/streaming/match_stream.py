"""Stream-static matching: each row's match depends on that row alone, so no state is kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import kernels
from matchloom.functions.text import is_null_token
from matchloom.operators.exact import clean_references, lookup

#: References that a stream is matched against at most: they stay in the workers.
MOST_REFERENCES = 100_000


def match_stream(dirty: DataFrame, refs: DataFrame, scorer: str = "token_sort_ratio", case_sensitive: bool = False) -> DataFrame:
    """dirty: a streaming (or other) DataFrame with given_entity. Adds prediction and score; further columns stay."""
    known = clean_references(refs).select("ref_id", "ref").orderBy("ref_id").limit(MOST_REFERENCES + 1).collect()
    if len(known) > MOST_REFERENCES:
        raise ValueError(f"a stream is matched against {MOST_REFERENCES} references at most")
    names = [r["ref"] for r in known]

    @F.pandas_udf("prediction string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score, seen = kernels.scorer(scorer), {}

        def of(value):
            if value is None or not names:
                return None, None
            if value not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                scores = [score(value, n) for n in names]
                top = max(scores)
                seen[value] = names[scores.index(top)], top / 100
            return seen[value]

        for s in batches:
            yield pd.DataFrame([of(v) for v in s], columns=["prediction", "score"])

    given = F.col("given_entity")
    table = lookup(clean_references(refs), case_sensitive)
    joined = dirty.withColumn("key", F.when(~is_null_token(given), given if case_sensitive else F.lower(given))).join(table, "key", "left")
    asked = joined.withColumn("found", best(F.when(F.col("exact").isNull() & F.col("key").isNotNull(), given)))
    known_null = F.col("key").isNull()
    return asked.withColumns({
        "prediction": F.when(known_null, None).otherwise(F.coalesce("exact", "found.prediction", "given_entity")),
        "score": F.when(known_null, None).when(F.col("exact").isNotNull(), 1.0).otherwise(F.coalesce("found.score", F.lit(1.0))),
    }).drop("key", "exact", "found")
