"""Text expressions, table access and lineage cutting shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates words of letters, digits and non-ASCII characters.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that where all is ASCII, and is much faster than translate()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Lower-cased words; none for null."""
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD)
    return F.array_remove(split, "")


def word_count(text: Column) -> Column:
    """How many runs of characters other than ASCII white space."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the one that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="matchloom-")
        spark.sparkContext.setCheckpointDir(shared)
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, *superseded: DataFrame) -> DataFrame:
    """The rows, written to the shared folder once and read again: it cuts the
    lineage, survives lost executors, and is computed a single time.

    superseded: written tables that nothing refers to once this one is there; they are deleted.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    for old in superseded:
        discard(old)
    return out


def checked_broadcast(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df (written, or cheap to count), for broadcasting if it has at most `most` rows; beyond that Spark joins it as it would any other."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart, null from empty too."""
    return [F.xxhash64(text, F.octet_length(text)).alias("__h1"), F.xxhash64(F.crc32(text.cast("binary")), F.reverse(text), F.lit(1)).alias("__h2")]


def discard(df: DataFrame) -> None:
    """Deletes a written table (and leaves any other DataFrame alone)."""
    path = getattr(df, "scratch", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
