"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Native: DataFrame functions only. Each document's word places are exploded, the
window at each is hashed in generated code and looked up in the benchmark's windows; a hit
counts only where the words themselves agree. One pass over the documents and
one shuffle, of a row per document plus a row per hit.

The benchmark side is broadcast if its windows are at most `max_broadcast`;
beyond that the same join is shuffled.

Defined results: a null or empty text has no words and is clean; a null item
text has no windows; repeated rows are judged each for itself (rows are told
apart by a row number of the scan, not by their id, so null and repeated ids
work); further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import NON_WORD, checked_broadcast, text_key, words_of, written

#: Windows of a benchmark up to which it is broadcast: about 200 bytes each.
MAX_BROADCAST = 300_000


def benchmark_windows(benchmark: DataFrame, width: int = 8, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(len, gram, items): each distinct window, and the items that hold it."""
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("len", F.least(F.size("words"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)
    grams = items.select("item", "len", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.col("len")))).alias("gram"))
    return grams.groupBy("len", "gram").agg(F.collect_set("item").alias("items"))


def _hash(words: Column, first: Column, lengths: list[int], length: Column) -> Column:
    """The hash of the `length` words from index `first`: plain columns, so that it stays in generated code."""
    out = F.lit(None).cast("long")
    for n in lengths:
        out = F.when(length == n, F.xxhash64(*(F.get(words, first + i) for i in range(n)))).otherwise(out)
    return out if len(lengths) != 1 else F.xxhash64(*(F.get(words, first + i) for i in range(lengths[0])))


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document row: doc (its id), n_words, n_hit, items (sorted strings), spans (start, end of hit runs in words)."""
    grams = benchmark_windows(benchmark, width, item_col, item_text_col)
    sizes = grams.groupBy("len").count().collect()  # `width` rows at most
    lengths = sorted((r["len"] for r in sizes), reverse=True)
    small = sum(r["count"] for r in sizes) <= max_broadcast

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc"), words_of(F.col(text_col)).alias("words"))
    # An empty word ahead of the others stands for the document itself, so that one pass keeps documents without hits.
    # The words stay in their row while their places are exploded: nothing is copied before a hit is found.
    rows = rows.withColumn("words", F.concat(F.array(F.lit("")), "words"))
    rows = rows.select("rid", "doc", "words", F.posexplode_outer("words").alias("pos", "word"))
    if len(lengths) > 1:
        rows = rows.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    else:
        rows = rows.withColumn("n", F.lit(lengths[0] if lengths else width))
    rows = rows.withColumn("h", _hash(F.col("words"), F.col("pos"), lengths or [width], F.col("n")))
    grams = grams.withColumn("h", _hash(F.col("gram"), F.lit(0), lengths or [width], F.col("len")))
    window, n_words = F.slice("words", F.col("pos") + 1, F.col("n")), (F.size("words") - 1).cast("long").alias("n_words")
    if small:
        grams = F.broadcast(grams)
    else:  # what is shuffled is each place's own window, never the text with it
        rows = rows.select("rid", "doc", n_words, "pos", "n", "h", F.when(F.col("pos") > 0, window).alias("window"))
        window, n_words = F.col("window"), F.col("n_words")
    # The hash alone is the join's key; the words are compared for what it finds.
    hits = rows.join(grams, (rows["h"] == grams["h"]) & (F.col("pos") > 0), "left")
    # Beyond a text's end there are nulls, which hashes pass over: lengths must agree too.
    hits = hits.where((F.col("pos") == 0) | (F.col("n") == F.col("len")) & (window == F.col("gram")))
    span = F.struct((F.col("pos") - 1).alias("s"), (F.col("pos") - 1 + F.col("n")).alias("e"))
    hits = hits.select("rid", "doc", n_words, F.when(F.col("pos") > 0, span).alias("span"), "items")
    out = hits.groupBy("rid", "doc", "n_words").agg(F.array_sort(F.collect_set("span")).alias("windows"), F.collect_set("items").alias("items"))
    # Windows in order of start: each joins the last run, or begins one.
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def merge(runs: Column, w: Column) -> Column:
        last = F.element_at(runs, -1)
        joined = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], w["e"]).alias("e"))))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["e"] >= w["s"]), joined).otherwise(F.concat(runs, F.array(w)))

    return out.select(
        "doc", "n_words",
        F.aggregate("windows", empty, merge).alias("spans"),
        F.array_sort(F.transform(F.array_distinct(F.flatten("items")), lambda x: x.cast("string"))).alias("items"),
    ).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["e"] - s["s"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", min_items: int = 2, width: int = 8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without what the benchmark holds.

    mode "document": rows whose text has windows of `min_items` or more items go;
    each row is judged by its own text, whatever its id. The texts that go are
    known by 128 bits of hashes, which are broadcast up to a million of them.
    mode "span": hit words go, with what stands before them; rows with a null id
    stay as they are.
    """
    if mode == "document":
        keyed = docs.withColumn("__key", F.struct(*text_key(F.col(text_col))))
        found = find_hits(keyed, benchmark, width, "__key", text_col, **options).where(F.size("items") >= min_items)
        gone = checked_broadcast(written(found.select("doc.*").distinct()))
        return keyed.join(gone, (F.col("__key.__h1") == gone["__h1"]) & (F.col("__key.__h2") == gone["__h2"]), "left_anti").select(*docs.columns)
    found = find_hits(docs, benchmark, width, id_col, text_col, **options).where(F.size("items") >= min_items).where(F.col("doc").isNotNull())
    if mode != "span":
        raise ValueError(f"mode is document or span, not {mode}")
    hit = found.groupBy(F.col("doc").alias("__doc")).agg(F.flatten(F.collect_set("spans")).alias("__spans"))
    pieces = F.expr(f"regexp_extract_all({_name(text_col)}, '{_WORD_WITH_LEAD}', 0)")
    kept = F.filter(F.transform(F.col("__pieces"), lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~F.exists("__spans", lambda s: (x["i"] >= s["s"]) & (x["i"] < s["e"])))
    tail = F.regexp_extract(F.col(text_col), f"({NON_WORD})$", 1)
    text = F.concat(F.array_join(F.transform(kept, lambda x: x["p"]), ""), tail)
    joined = docs.join(hit, docs[id_col] == hit["__doc"], "left").withColumn("__pieces", F.when(F.col("__doc").isNotNull(), pieces))
    return joined.withColumn(text_col, F.when(F.col("__doc").isNotNull(), text).otherwise(F.col(text_col))).select(*docs.columns)


_WORD_WITH_LEAD = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]*[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _name(col: str) -> str:
    return f"`{col.replace('`', '``')}`"


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_hits(docs, benchmark)
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )
