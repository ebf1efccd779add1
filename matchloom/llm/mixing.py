"""Mixing sources to target weights by entropy balancing.

Native: DataFrame functions only. A document of source s takes the rate
w = limit / (1 + exp(-l_s * x)), x its size over its source's mean size: the
rates nearest to even ones, in entropy bounded by 0 and `limit`, whose words
meet the source's target. The multipliers l_s solve the convex dual; each
Newton iteration sums the gradient and the curvature of every source over a
table of (source, size, count), which is all that the solver needs of the
documents, inside a bracket that a bisection step halves where Newton leaves it.

Rates are rounded into copies: up where a document's fraction less a hash of it
is over the source's threshold. Two histograms of 4,096 bins, the second within
the bin of the first that the target falls in, set the threshold; one
more copy given or taken back then closes most of what is left.

The rate is the tilt of the odds of w against limit - w, in proportion to x: the
exponential tilt of an entropy that has an upper bound. Sums that decide
anything are of whole numbers, so that reruns agree in whatever order they are
added up.

Multipliers and thresholds are a row per source, broadcast up to 100,000 of
them, so that a source with a third of all rows stays where its rows are; a document's copies follow
from its own row and that one, so texts never move to be mixed.

Defined results: null and empty texts have size 0 and take 0 words; a null
source is a source, the last in order; null ids and repeated rows are mixed
like others (wholly equal rows get equal copies); an empty table gives no rows;
further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import checked_broadcast, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
BINS = 4096
#: Sources up to which their parameters are broadcast.
MOST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> tuple[DataFrame, bool]:
    """(source, source_size, n, target) from (source, size, n), and whether a row per source is small enough to be broadcast. Targets by weight up to `limit` times a source's size; what is over is shared again."""
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n"))
    # One row per source: a dimension of the corpus, not its rows.
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")))
    sources = written(sources.withColumn("most", F.col("source_size") * float(limit)))
    level = 0.0
    while True:  # each round, sources that are over their most leave; the others share what is left
        full = F.col("most") <= F.col("weight") * level
        rows, total, taken, weight = sources.agg(F.count("*"), F.sum("source_size"), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:
            break
        now = (share * total - (taken or 0.0)) / weight
        if now <= level:
            break
        level = now
    return sources.select("source", "source_size", "n", F.least("most", F.col("weight") * F.lit(level)).alias("target")), rows <= MOST_SOURCES


def _fixed(x: Column) -> Column:
    """A sum in units of 2**-20, the same in any order."""
    return (F.sum((x * F.lit(float(1 << 20))).cast("decimal(38,0)")).cast("double") / (1 << 20)).cast("double")


def _of_source(rows: DataFrame, params: DataFrame, a: str, b: str, small: bool) -> DataFrame:
    """Rows with what is known of their source. small: a row per source is to be broadcast."""
    return rows.alias(a).join((F.broadcast(params) if small else params).alias(b), F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")))


def _rate(x: Column, multiplier: Column, limit: int) -> Column:
    return limit / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), multiplier * x))))


_KNOWN = ["source", "source_size", "target", "mean"]


def _newton(sizes: DataFrame, state: DataFrame, small: bool, limit: int, tolerance: float) -> DataFrame:
    """One iteration: the sums by source carry its state with them, so that a single shuffle does."""
    both = _of_source(sizes, state, "d", "s", small)
    x = F.col("size") / F.col("mean")
    rate = _rate(x, F.col("multiplier"), limit)
    now = both.groupBy(*(f"s.{c}" for c in (*_KNOWN, "multiplier", "lo", "hi"))).agg(
        _fixed(F.col("d.n") * F.col("size") * rate).alias("words"),
        _fixed(F.col("d.n") * F.col("size") * x * rate * (1 - rate / limit)).alias("slope"),
    )
    gap = F.col("words") - F.col("target")
    lo = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("lo"))
    hi = F.when(gap >= 0, F.col("multiplier")).otherwise(F.col("hi"))
    far = 4 * (F.abs("multiplier") + 1)
    newton = F.col("multiplier") - gap / F.greatest("slope", F.lit(1e-300))
    # A step out of the bracket, or far beyond what was seen, is a bisection (or a step of bounded length) instead.
    low, high = F.coalesce(lo, F.col("multiplier") - far), F.coalesce(hi, F.col("multiplier") + far)
    step = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
    off = F.abs(gap) / F.greatest("target", F.lit(1.0))
    multiplier = F.when(off <= tolerance, F.col("multiplier")).otherwise(step)
    return now.select(*_KNOWN, multiplier.alias("multiplier"), lo.alias("lo"), hi.alias("hi"), off.alias("off"))


def solve(sizes: DataFrame, targets: DataFrame, small: bool, limit: int = LIMIT, tolerance: float = 1e-6, most: int = 60) -> DataFrame:
    """targets with mean (size of a document) and multiplier (null: every document takes `limit`).

    The driver pays for every job, however few its rows, so that two iterations are one job; one that comes after the last changes nothing.
    """
    full = F.col("target") >= F.col("source_size") * float(limit) * (1 - 1e-9)
    targets = written(targets.select("source", "source_size", "target", (F.col("source_size") / F.greatest("n", F.lit(1))).alias("mean"), full.alias("full")))
    # A source that isn't full has words, so each of them is in the sums.
    state = targets.where(~F.col("full")).select(*_KNOWN, *(F.lit(x).cast("double").alias(c) for c, x in (("multiplier", 0.0), ("lo", None), ("hi", None), ("off", 1.0))))
    sizes = sizes.where("size > 0")
    for _ in range(0, most, 2):
        if state.where(F.col("off") > tolerance).isEmpty():
            break
        half = _newton(sizes, state, small, limit, tolerance)
        state = written(_newton(sizes, half, small, limit, tolerance), state)
    return state.select(*_KNOWN, "multiplier").union(targets.where("full").select(*_KNOWN, F.lit(None).cast("double").alias("multiplier")))


def _lean(h: Column, limit: int) -> dict[str, Column]:
    """From a row's size, hash and its source's parameters: whole copies, and the bins of how it leans to one more."""
    rate = F.when(F.col("multiplier").isNull(), F.lit(float(limit))).otherwise(_rate(F.col("size") / F.col("mean"), F.col("multiplier"), limit))
    whole = F.floor(rate)
    lean = (rate - whole) - F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))  # from -1 to 1
    place = F.greatest(F.lit(0), F.least(F.floor((1 - lean) / 2 * BINS * BINS), F.lit(BINS * BINS - 1)))  # from 0, the first to get one more
    return {"whole": whole, "rate": rate, "bin": F.floor(place / BINS), "sub": place % BINS}


def _crossing(rows: DataFrame, of: str) -> DataFrame:
    """Each bin's words and those up to it by source, from (source, bin, words)."""
    order = Window.partitionBy("source").orderBy(of).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BINS rows at most
    return rows.withColumn("upto", F.sum("words").over(order))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """rows: (source, size, h). Returns per source: source_size, target, mean, multiplier, the cut (cut_bin, cut_sub): rows before it get one more copy; and the row (flip, its hash) that is the other way round."""
    sizes = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets, small = source_targets(sizes, weights, share, limit)
    params = written(solve(sizes, targets, small, limit))
    leaning = lambda params: _of_source(rows, params, "r", "p", small).select("p.*", "size", "h").withColumns(_lean(F.col("h"), limit))
    words = F.sum("size").alias("words")
    # Sums by source carry its parameters with them, so that nothing is joined with them again.
    based = leaning(params).groupBy(*params.columns).agg(F.sum(F.col("whole") * F.col("size")).alias("base"))
    params = written(based.select(*params.columns, F.greatest(F.col("target") - F.col("base"), F.lit(0.0)).alias("need")))
    able = leaning(params).where((F.col("whole") < limit) & (F.col("size") > 0))
    # The first bin whose words pass the need, and what is still needed when it begins.
    passed = _crossing(able.groupBy("source", "need", "bin").agg(words), "bin").where("upto > need")
    first = passed.groupBy("source").agg(F.min(F.struct("bin", (F.col("need") - F.col("upto") + F.col("words")).alias("need"))).alias("x"))
    first = written(first.select("source", "x.bin", "x.need"))
    inside = _of_source(able.drop("need"), first, "a", "f", small).where("a.bin = f.bin")
    subs = _crossing(inside.groupBy("a.source", "f.bin", "f.need", "sub").agg(words), "sub")
    # Of the cuts around the need, the nearer one.
    cut = subs.groupBy("source").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("need")).alias("off"), (F.col("sub") + 1).alias("sub"))).alias("x"), F.min("need").alias("none"), F.first("bin").alias("bin"))
    cut = cut.select("source", "bin", F.when(F.col("none") <= F.col("x.off"), 0).otherwise(F.col("x.sub")).alias("sub"))
    out = params.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    # Without a crossing bin, every row that leans to one more gets it.
    out = out.select("p.source", "source_size", "target", "mean", "multiplier", F.coalesce("bin", F.lit(BINS)).alias("cut_bin"), F.coalesce("sub", F.lit(0)).alias("cut_sub"))
    out = written(out)
    # Last, the one row by source whose copy more or less brings the words nearest to the target.
    gaps = leaning(out).withColumn("up", _up(limit)).groupBy(*out.columns).agg((F.max("target") - F.sum((F.col("whole") + F.col("up").cast("int")) * F.col("size"))).alias("gap"))
    out = written(gaps, out)
    flips = leaning(out).withColumn("up", _up(limit)).where(((F.col("gap") < 0) & F.col("up")) | ((F.col("gap") > 0) & ~F.col("up") & (F.col("whole") < limit)))
    flips = flips.withColumn("left", F.abs(F.abs("gap") - F.col("size"))).where(F.col("left") < F.abs("gap"))
    flips = flips.groupBy("source").agg(F.min(F.struct("left", "h")).alias("x")).select("source", F.col("x.h").alias("flip"))
    return out.alias("p").join(flips.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")), "left").select("p.*", "flip").drop("gap")


def _up(limit: int) -> Column:
    before = (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("sub") < F.col("cut_sub")))
    return before & (F.col("whole") < limit)


def _hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _copies(limit: int) -> Column:
    lean = _lean(F.col("h"), limit)
    before = (lean["bin"] < F.col("cut_bin")) | ((lean["bin"] == F.col("cut_bin")) & (lean["sub"] < F.col("cut_sub")))
    up = before & (lean["whole"] < limit)
    flipped = F.coalesce(F.col("h") == F.col("flip"), F.lit(False))
    return (lean["whole"] + F.when(up != flipped, 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """The documents of the mix: each as often as it has copies."""
    rows = written(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _hash(id_col, text_col).alias("h")))
    params = written(plan(rows, weights, share, limit)).withColumnRenamed("source", "__of")
    # The document's own columns stay in a struct, whatever their names.
    drawn = docs.select(F.struct("*").alias("__row"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("size"), _hash(id_col, text_col).alias("h"))
    drawn = drawn.join(checked_broadcast(params, MOST_SOURCES), F.col("__source").eqNullSafe(F.col("__of"))).select("__row", _copies(limit).alias("copies")).where("copies > 0")
    return drawn.select("__row", F.explode(F.sequence(F.lit(1), "copies"))).select("__row.*")


def report(docs: DataFrame) -> DataFrame:
    rows = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash("doc_id", "text").alias("h")))
    params = written(plan(rows.select("source", "size", "h")))
    joined = rows.alias("r").join(checked_broadcast(params, MOST_SOURCES).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("doc_id", "size", "h", "p.*")
    return joined.select("doc_id", "size", "source_size", "target", (_copies(LIMIT) * F.col("size")).alias("taken"))
