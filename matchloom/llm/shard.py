"""Sharding by global prefix sums of byte sizes.

Native: DataFrame functions only. Rows are range-partitioned by a hash of their
text, so that equal texts are neighbours; each partition's total is known from
one row per partition, so a running sum inside the partition plus the totals
before it is the global prefix sum. Cuts are at equal targets of the sum. A cut
that falls inside a group of equal texts moves to the group's nearer edge, if
the group has at most `together` of a shard's target; a larger group is cut
where the target is. A row goes to the shard that the middle of its bytes falls
into. So shards differ by `together` of the target and the largest row at most,
and every group within that size is in one shard. Law: `bytes`.

Only ids, sizes, checksums and hashes are sorted, never texts.

Defined results: a null text counts no bytes, like an empty one; null ids
come first among equal texts; rows with equal ids are told apart by a row
number; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import written

#: Added to each text's bytes.
OVERHEAD = 8
#: Of a shard's target: groups of equal texts up to it are kept in one shard.
TOGETHER = 0.05


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tie: str | None = None) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"),
        (F.col(tie) if tie else F.monotonically_increasing_id()).alias("tie"),
    )


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, tie: str | None = None, together: float = TOGETHER) -> DataFrame:
    """(id, size, crc, tie, shard, slot). partitions: 0.5 million rows in each, if not given.

    tie: a column that tells equal rows apart, if there is one.
    """
    spark = docs.sparkSession
    rows = sized(docs, id_col, text_col, tie)
    if partitions is None:
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // 500_000)
    group = ["hash", "size", "crc"]
    order = [*group, "id", "tie"]
    # Where Spark cuts the ranges depends on a sample, so that they are written down before sums refer to them.
    ranged = written(rows.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # A row for each partition, so one task is enough for their prefix sums, and `partitions` bounds the broadcast.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = written(totals.select("part", "bytes", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows"))))
    total = totals.agg(F.sum("bytes")).first()[0] or 0
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({"end": F.sum("size").over(inside), "nth": F.row_number().over(inside)}).join(F.broadcast(totals), "part")
    placed = placed.withColumn("end", F.col("bytes_before") + F.col("end"))
    # Twice the places, in whole numbers over `shards`, so that cuts and middles are exact.
    unit, cuts = 2 * shards, [2 * total * k for k in range(1, shards)]
    groups = placed.groupBy(*group).agg(F.min(F.col("end") - F.col("size")).alias("low"), F.max("end").alias("high")).where(F.col("high") - F.col("low") > F.col("size"))
    hit = groups.where(F.exists(F.array(*(F.lit(c).cast("decimal(38,0)") for c in cuts)), lambda c: (c > unit * F.col("low").cast("decimal(38,0)")) & (c < unit * F.col("high").cast("decimal(38,0)")))) if cuts else groups.limit(0)
    for low, high in sorted((r["low"], r["high"]) for r in hit.where((F.col("high") - F.col("low")) * shards <= together * total).select("low", "high").collect()):  # one group a cut at most
        cuts = [(unit * low if c - unit * low <= unit * high - c else unit * high) if unit * low < c < unit * high else c for c in cuts]
    middle = (2 * F.col("end") - F.col("size")).cast("decimal(38,0)") * shards
    shard = F.size(F.filter(F.array(*(F.lit(c).cast("decimal(38,0)") for c in cuts)), lambda c: c <= middle)) if cuts else F.lit(0)
    placed = placed.select("id", "size", "crc", "tie", shard.cast("int").alias("shard"), (F.col("rows_before") + F.col("nth")).cast("long").alias("nth"))
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # `shards` rows at most
    return placed.join(F.broadcast(first), "shard").select("id", "size", "crc", "tie", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def report(docs: DataFrame, shards: int = 24) -> DataFrame:
    return assign(docs, shards).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with `shard` and `slot`. They are written down with a row number, so that both sides of the join mean the same row by it."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    docs = written(docs.select(F.struct("*").alias("__row"), F.monotonically_increasing_id().alias("__tie")))
    places = assign(docs, shards, f"__row.`{id_col}`", f"__row.`{text_col}`", tie="__tie").select(F.col("tie").alias("__tie"), "shard", "slot")
    return docs.join(places, "__tie").select(*(F.col(f"__row.`{c}`") for c in columns), "shard", "slot")
