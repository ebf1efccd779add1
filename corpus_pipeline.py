"""The corpus pipeline: from all documents to balanced shards of a clean mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents. No SQL can express the stages (fingerprints,
trained models, Newton iterations), so tests hold the pipeline against a
brute-force version.

Defined results, in all stages: rows are judged one by one, by their own text,
so null and repeated ids are no exception; a null text is an empty one. Empty
tables give no rows (of shards neither). Columns beyond those of documents stay,
whatever their names, but for `shard` and `slot`, which the last stage sets. A
stage's input is deleted from the shared folder once its output is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import decontaminate, mixing, shard, simhash, toxicity
from matchloom.llm.common import table, written

SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go that score 0.5 or more. Null and empty texts have no evidence against them; without labels of both classes nothing goes but by their share."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: of the least id, then of the least hash of the text. All empty texts are one class."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One verified window of any benchmark item is enough for a row to go. An empty benchmark lets all stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mix takes them: 0, 1 or 2 times. A null source is one of the sources; texts without words are taken as their rate is rounded, at no cost."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row goes to a shard, equal texts to the same one while they are few."""
    return shard.shard_documents(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
