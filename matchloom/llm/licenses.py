"""License scans by diagonal voting.

Native: DataFrame functions only. Every rolling word k-gram of every text is
hashed in generated code and joined to the places where a template holds it,
word for word. A hit votes for its diagonal (place in the text less place in
the template); votes are the different template places by diagonal. Diagonals
at most `slack` apart merge, so that words put in or left out shift a match
without losing it. A merged span is verified: it counts if the different
template places that it holds reach `least` of all, and if it is at most twice
as long as the template; of a longer one (a text that repeats itself) its best
single diagonal is judged instead. Where spans of different templates overlap,
the one with the most template places wins, then the one with the greater
share, so that one member of a family of licenses is named, not all of them.
Phrases are templates whose every k-gram must vote for one diagonal; none of
them is ever beaten.

The templates are part of the code, so the broadcast side has a fixed size.

Defined results: null and empty texts have no words and no labels; repeated
rows and null ids are judged each for itself; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import words_of
from matchloom.llm.license_templates import PHRASES, TEMPLATES

K = 3
SLACK = 4
LEAST = 0.7


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: list[tuple[str, str]]) -> DataFrame:
    """(tid, label, phrase, n_grams, tpos, gram): a row for each k-gram of each template."""
    rows = [(i, label, i < len(phrases), text) for i, (label, text) in enumerate([*phrases.items(), *templates])]
    df = spark.createDataFrame(rows, "tid int, label string, phrase boolean, text string").withColumn("words", words_of(F.col("text")))
    df = df.withColumn("n_grams", F.size("words") - K + 1)
    grams = F.transform(F.sequence(F.lit(1), F.col("n_grams")), lambda i: F.slice("words", i, K))
    return df.select("tid", "label", "phrase", "n_grams", F.posexplode(grams).alias("tpos", "gram"))


def _beaten(s: Column, others: str) -> Column:
    """Whether a span overlaps with one of another label that has more template places, or as many and a greater share of its own."""
    better = lambda o: F.struct(o["votes"], o["coverage"], -o["tid"]) > F.struct(s["votes"], s["coverage"], -s["tid"])
    return F.exists(others, lambda o: (o["label"] != s["label"]) & (o["first"] <= s["last"]) & (s["first"] <= o["last"]) & better(o))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """Per document row: doc (its id), n_words, spans: each (label, phrase, coverage, first, last), in words, last included; nearest: the best share of a template."""
    grams = template_grams(docs.sparkSession, phrases or PHRASES, TEMPLATES if templates is None else templates)
    hashed = lambda col, first: F.xxhash64(*(F.get(col, first + i) for i in range(K)))
    grams = grams.withColumn("h", hashed(F.col("gram"), F.lit(0)))
    # An empty word ahead of the others stands for the document itself.
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc"), F.concat(F.array(F.lit("")), words_of(F.col(text_col))).alias("words"))
    rows = rows.select("rid", "doc", "words", F.posexplode_outer("words").alias("pos", "word")).withColumn("h", hashed(F.col("words"), F.col("pos")))
    hits = rows.join(F.broadcast(grams), (rows["h"] == grams["h"]) & (F.col("pos") > 0), "left")
    hits = hits.where((F.col("pos") == 0) | (F.slice("words", F.col("pos") + 1, K) == F.col("gram")))
    hits = hits.select("rid", "doc", (F.size("words") - 1).alias("n_words"), "tid", "label", "phrase", "n_grams", "tpos", (F.col("pos") - 1).alias("pos"), (F.col("pos") - 1 - F.col("tpos")).alias("diag"))
    keys = ["rid", "doc", "n_words", "tid", "label", "phrase", "n_grams"]
    # On one diagonal each place in the text is a place of the template: at most n_grams of them.
    votes = hits.groupBy(*keys, "diag").agg(F.collect_set("tpos").alias("places"), F.min("pos").alias("first"), (F.max("pos") + K - 1).alias("last"))

    # Neighbouring diagonals of a text merge; those of a phrase stay apart.
    order = Window.partitionBy("rid", "tid").orderBy("diag")
    new = F.coalesce(F.col("phrase") | (F.col("diag") - F.lag("diag").over(order) > slack), F.lit(True))
    merged = votes.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order))
    alone = F.struct(F.size("places").alias("votes"), (-F.col("first")).alias("before"), "last")
    spans = merged.groupBy(*keys, "island").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("together"), F.min("first").alias("begin"), F.max("last").alias("end"), F.max(alone).alias("best"))
    whole = F.col("end") - F.col("begin") < 2 * (F.col("n_grams") + K - 1)
    spans = spans.select(
        *keys,
        F.when(whole, F.col("together")).otherwise(F.col("best.votes")).alias("votes"),
        F.when(whole, F.col("begin")).otherwise(-F.col("best.before")).alias("first"),
        F.when(whole, F.col("end")).otherwise(F.col("best.last")).alias("last"),
    ).withColumn("coverage", F.col("votes") / F.col("n_grams"))

    # Spans that overlap, directly or through others, stand together; each is weighed against those only.
    spans = spans.withColumn("counts", F.coalesce(F.when(F.col("phrase"), F.col("votes") == F.col("n_grams")).otherwise(F.col("coverage") >= least), F.lit(False)))
    contested = F.col("counts") & ~F.col("phrase")
    order = Window.partitionBy("rid").orderBy(contested.desc(), "first", "last", "tid")
    reach = F.max(F.when(contested, F.col("last"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("apart", F.when(contested & (reach.isNull() | (F.col("first") > reach)), 1).otherwise(0))
    spans = spans.withColumn("crowd", F.when(contested, F.sum("apart").over(order)).otherwise(0))
    span = F.struct("label", "phrase", "coverage", "first", "last", "votes", "tid")
    of = ["rid", "doc", "n_words"]
    crowds = spans.groupBy(*of, "crowd").agg(F.collect_list(F.when(F.col("counts"), span)).alias("all"), F.max(F.when(~F.col("phrase"), F.col("coverage"))).alias("nearest"))
    crowds = crowds.withColumn("kept", F.filter("all", lambda s: s["phrase"] | ~_beaten(s, "all")))
    out = crowds.groupBy(*of).agg(F.flatten(F.collect_list("kept")).alias("spans"), F.coalesce(F.max("nearest"), F.lit(0.0)).alias("nearest"))
    return out.select("doc", F.col("n_words").cast("long").alias("n_words"), "spans", "nearest")


def report(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["phrase"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first"].cast("long"))
    return scan(docs).select(
        F.col("doc").alias("doc_id"), "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.col("nearest")).alias("score"),
    )
