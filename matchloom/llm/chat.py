"""Chat formatting of reply trees.

Native: DataFrame functions only. Messages point to the message they answer.
Iterative self-joins that double their reach (the parent, its parent, the
fourth ancestor, ...) give each message its root, its depth and the summed
score of its path in as many rounds as the logarithm of the longest path.
Leaves are the branches; within a root they rank by the mean score of their
path, then by id. The path of each chosen leaf is enumerated by the same tables
taken backwards, from the longest reach to the shortest, so that every message
of a path is met once. Each path is one conversation.

The template marks turns by control strings, all of which begin with "<|". In
texts and roles `&`, `<` and `|` are written as entities, so no text can hold a
control string, and reading back restores it. The loss mask lists the spans, in
characters of the formatted string, of what assistants say.

Defined results: a null text is empty, as is a null role; a message whose
parent isn't there is a root; messages in a ring belong to no tree and are left
out; repeated ids count once (the least row); an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import written

BEGIN, ROLE_END, TURN_END = "<|turn|>", "<|says|>", "<|end|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("|", "&bar;"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """messages: (id, parent, role, text, score). Returns (leaf, root, nth, id, role, text) for the `best` branches of each root (all, if None), nth from 0 at the root."""
    first = messages.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("id", "m.*")
    first = written(first)
    known = first.select(F.col("id").alias("parent"))
    up = first.join(known, "parent", "left_semi").select("id", F.col("parent").alias("to"))
    # `to` is the ancestor `far` steps up, null if there is none; then `far` is the depth and `top` the root of a message below one.
    # score is of the message and the steps up to `to`, without it.
    reach = first.select("id", F.coalesce("score", F.lit(0.0)).alias("score")).join(up, "id", "left")
    reach = written(reach.select("id", "to", F.when(F.col("to").isNull(), 0).otherwise(1).alias("far"), "score", F.when(F.lit(False), F.col("to")).alias("top")))
    levels = []
    n = first.count()
    while 1 << len(levels) <= n and not reach.where("to is not null").isEmpty():
        levels.append(reach.where("to is not null").select("id", "to"))
        above = reach.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("score").alias("above"), F.col("top").alias("above_top"))
        # Only messages that aren't at their root yet are joined: few, once the short trees are through.
        further = reach.where("to is not null").join(above, "to").select(
            "id", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), (F.col("score") + F.col("above")).alias("score"),
            F.when(F.col("next").isNull(), F.coalesce("above_top", "to")).alias("top"),
        )
        reach = written(reach.where("to is null").union(further))
    ended = reach.where("to is null").withColumn("root", F.coalesce("top", "id"))
    leaves = ended.join(up.select(F.col("to").alias("id")).distinct(), "id", "left_anti")
    if best is not None:
        rank = Window.partitionBy("root").orderBy(F.desc(F.col("score") / (F.col("far") + 1)), "id")
        leaves = leaves.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= best)
    on = leaves.select(F.col("id").alias("leaf"), "root", F.col("far").alias("nth"), "id")
    for k in reversed(range(len(levels))):
        step = levels[k]
        on = written(on.union(on.join(step, "id").select("leaf", "root", (F.col("nth") - (1 << k)).alias("nth"), F.col("to").alias("id"))))
    return on.join(first.select("id", "role", "text"), "id").select("leaf", "root", "nth", "id", "role", "text")


def format_paths(members: DataFrame, by: list[str]) -> DataFrame:
    """One row per path: `by`, text (formatted) and mask, [(start, length)] in characters from 0."""
    turn = F.struct("nth", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("said"))
    turns = members.groupBy(*by).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit(ROLE_END))
    text = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["said"], F.lit(TURN_END))), "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(head(t))
        span = F.array(F.struct(begin.alias("start"), F.length(t["said"]).alias("length")))
        return F.struct((begin + F.length(t["said"]) + len(TURN_END)).alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return turns.select(*by, text.alias("text"), F.aggregate("turns", zero, step, lambda s: s["spans"]).alias("mask"))


def read_turns(text: Column) -> Column:
    """[(role, text)] of a formatted string."""
    pieces = F.split(text, r"<\|end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    body = lambda p: F.substring(p, F.lit(len(BEGIN) + 1), F.length(p))
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(body(p), ROLE_END, 1)).alias("role"), unescape(F.substring_index(body(p), ROLE_END, -1)).alias("text")))


def read_masked(text: Column, mask: Column) -> Column:
    """What the mask covers, as it was said."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(text, m["start"] + 1, m["length"]))), "")


def chains(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations by turn as messages: each answers the one before it. A null conversation is one of its own."""
    order = Window.partitionBy(conv_col).orderBy(turn_col, "role", "text")
    rows = conversations.select(conv_col, "role", "text", F.row_number().over(order).alias("n"))
    name = lambda n: F.struct(F.col(conv_col).alias("conv"), n.cast("long").alias("n"))
    return rows.select(name(F.col("n")).alias("id"), F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def report(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    probe = spark.sql("select -1L as conv_id, 0L as turn, 'user' as role, '</s>[INST] ok [/INST]' as text union all select -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(probe)
    formatted = format_paths(paths(chains(rows), best=1), ["root"])
    turns = read_turns(F.col("text"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumns({"turns": turns, "said": read_masked(F.col("text"), F.col("mask"))}).select(
        F.col("root.conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )
