"""Toxicity from class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary text, are counted on labelled
documents. What is counted are contexts, as Kneser and Ney do it, and a
document is one context: a text that repeats itself is one witness. With
n_c(v, w) and n_c(w) the documents of class c that hold a pair and a word:

    p_c(w | v) = (n_c(v, w) - d) / n_c(v) + held_c(v) * p_c(w)
    p_c(w)     = (n_c(w) - d) / n_c + held_c * p(w)

n_c(v) and n_c are the sums of these counts, and held_c is what the discounts
leave. Both classes back off to one p(w), which knows no labels: in how many
documents of the whole corpus each word is, with 1 more for every word and for
the unknown one. So a word or pair that is rare in either class gets nearly the
same likelihood from both.

A discount d has two parts. One is the modified Kneser-Ney discount for counts
of 1, 2 and more, from the class's counts of counts. The other is what chance
explains: if both classes spoke alike, a class with the share s of all counts
would hold e = s * (n_t + n_o) of a word's; up to e + z * sqrt(e) + z**2 / 3
goes to the backoff too (no more than the count). Which z of CHANCES, the calibration
documents tell. Discounts of the first kind
alone were measured to fail here: on sf0.1 they found 5 of 97 held-out toxic
documents, since which language a class happens to hold more of outweighs a few
insults in hundreds of words; with both, 85.

A text's evidence is the difference of its log-likelihoods under the two
models, by word. It is put through a logistic curve that is fitted on labelled
documents which the models haven't counted (every fourth, by hash of the id).

Bounds. The labelled sample is at most `per_class` documents of each class
(those with the least hash of the id), and of these as many as begin within
`class_bytes` of text: only so the models, which are broadcast, have a bound (a
pair takes 16 bytes, and every two bytes of text make one at most). Within the
sample nothing is cut: every word and pair of it counts. Pairs that at most
z**2 / 3 documents of either class hold are discounted whole, so that their
likelihood is that of the backoff; they stay in Spark, which sums them, and only
the others come to the driver. From the model that is broadcast, words and pairs
are left out that are discounted whole for both classes: what isn't in it has
just the likelihoods that they have. The shared counts cover all documents, and
scoring every word of every text.

Words are lower-cased runs of letters, digits and non-ASCII characters, known
by 64-bit hashes. Learned from are only rows whose crc32(id as text) mod `folds`
isn't 0. Scores use the text alone.

Defined results: null and empty texts get the score of no evidence; repeated
rows get equal scores; null labels or ids aren't learned from, nor ids labelled
both ways; without labels of both classes every score is the share of toxic
labels (0 if there are none); further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import discard, written

PER_CLASS, CLASS_BYTES, FOLDS = 4000, 16 << 20, 5
#: Standard errors of a count that are put down to chance.
CHANCE = 2.0
#: Of these, training takes the one with the least loss on the calibration documents.
CHANCES = (2.0, 3.5, 6.0, 10.0)
#: Bytes of text that are looked at together.
CHUNK = 1 << 19

#: Bytes to what they count as: lower case, and a space for all but letters, digits and non-ASCII.
TABLE = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_ODD = 0x9FB21C651E98DF25
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    values = (values + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(_ODD)
    values ^= values >> np.uint64(29)
    values *= _MIX
    values ^= values >> np.uint64(32)
    return values


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * CHUNK)
        steps = np.empty((2, n), np.uint64)
        steps[0], steps[1] = np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))
        steps[:, 0] = 1
        _powers[:] = np.multiply.accumulate(steps, axis=1)
    return _powers[0], _powers[1]


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of all the texts in one go: the words' hashes, as signed numbers, and which text each is in."""
    data = np.frombuffer(b"\n".join((t or "").encode().translate(TABLE) for t in texts), np.uint8)
    line = data == 10
    edge = np.diff(np.concatenate(([1], ((data == 32) | line).astype(np.int8), [1])))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = _mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64), 0)
    return hashes.view(np.int64), np.searchsorted(np.flatnonzero(line), begin)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first.view(np.uint64) * np.uint64(_ODD) ^ second.view(np.uint64), 1).view(np.int64)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Texts, some at a time, each with the number of the first."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t or "") > CHUNK:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t or "")
    if texts:
        yield begin, texts[begin:]


#: Stands for what is ahead of a text's first word.
START = np.int64(0)


def pairs_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, text) of every word of the texts."""
    word, owner = words_of(texts)
    before = np.concatenate(([START], word[:-1])) if len(word) else word
    before = np.where(np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.empty(0, bool), START, before)
    return before, word, owner


def spectrum(counts: np.ndarray) -> np.ndarray:
    """How often each count from 0 to 4 is met, and larger ones."""
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)


def discounts(n: np.ndarray) -> np.ndarray:
    """From a spectrum, what is taken off counts of 0, 1, 2, and 3 or more: the modified Kneser-Ney estimate, kept within 0 and the count; 0.75 of what counts of counts can't tell."""
    n = np.asarray(n, float)
    if not n[1] or not n[2]:
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n[1] / (n[1] + 2 * n[2])
    third = 3 - 4 * y * n[4] / n[3] if n[3] else 0.75
    out = np.array([0.0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], third])
    return np.clip(out, [0.0, 0.05, 0.05, 0.05], [0.0, 1.0, 2.0, 3.0])


class Model:
    """Differences of log-likelihood, toxic less ordinary. All of it is arrays: a pair that was counted has its own; any other is its first word's held share and its second word's backed-off likelihood."""

    def __init__(self, words: np.ndarray, held: np.ndarray, back: np.ndarray, other: float, pairs: np.ndarray, gains: np.ndarray, bias: float = 0.0, slope: float = 0.0):
        self.words, self.held, self.back, self.other = words, held, back, other
        self.pairs, self.gains, self.bias, self.slope = pairs, gains, bias, slope

    def parts(self) -> tuple:
        """Plain arrays and numbers, for workers that may not have this package."""
        return self.words, self.held, self.back, self.other, self.pairs, self.gains, self.bias, self.slope

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """By text, the mean difference of log-likelihood of its words; 0 without words."""
        out = np.zeros(len(texts))
        if not len(self.words):
            return out
        for begin, some in chunks(texts):
            before, word, owner = pairs_of(some)
            if not len(word):
                continue
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            known = self.words[at] == word
            gain = np.where(known, self.back[at], self.other)
            held = np.where(known, self.held[at], 0.0)
            start = np.concatenate(([True], owner[1:] != owner[:-1]))
            gain += np.where(start, self.held_of_start, np.concatenate(([0.0], held[:-1])))
            if len(self.pairs):
                keys = pair_keys(before, word)
                spot = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
                counted = self.pairs[spot] == keys
                gain[counted] = self.gains[spot[counted]]
            n = np.bincount(owner, minlength=len(some))
            out[begin : begin + len(some)] = np.bincount(owner, gain, len(some)) / np.maximum(n, 1)
        return out

    @property
    def held_of_start(self) -> float:
        at = np.searchsorted(self.words, START)
        return float(self.held[at]) if at < len(self.words) and self.words[at] == START else 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * self.evidence(texts), -500, 500)))


def _discounted(n: np.ndarray, both: np.ndarray, share: np.ndarray | float, chance: float, met: np.ndarray) -> np.ndarray:
    """What the backoff gets of each count: the Kneser-Ney discount by the spectrum `met`, and what chance explains."""
    own = discounts(met)[np.minimum(n, 3).astype(int)]
    expected = both * share
    return np.minimum(n, own + expected + chance * np.sqrt(expected) + chance**2 / 3)


def build(words: np.ndarray, word_counts: dict[str, np.ndarray], first: np.ndarray, second: np.ndarray, pair_counts: dict[str, np.ndarray], shared_counts: np.ndarray, occurrences: int, chance: float = CHANCE, sums_of: tuple[np.ndarray, dict[str, np.ndarray]] | None = None, met: dict[str, np.ndarray] | None = None) -> Model:
    """sums_of (first words and their sums by class) and met (spectra by class) are of all pairs, where those that chance explains whole are left out of the others.

    words: all that are in the pairs but START. Counts by class (t, o) of documents; shared_counts: of all documents, by word; occurrences: their sum over all words, these or not."""
    words = np.append(words, START) if START not in words else words
    order = np.argsort(words)
    words = words[order]
    pad = lambda x: np.append(np.asarray(x, float), np.zeros(len(words) - len(x)))[order]
    shared = (pad(shared_counts) + 1) / (occurrences + len(words) + 1.0)
    n = {c: pad(word_counts[c]) for c in "to"}
    v, w = np.searchsorted(words, first), np.searchsorted(words, second)
    pairs = {c: np.asarray(pair_counts[c], float) for c in "to"}
    sums = {c: max(n[c].sum(), 1.0) for c in "to"}
    if sums_of is None:
        sums_of = first, pair_counts
    whose = np.searchsorted(words, sums_of[0])
    after = {c: np.bincount(whose, sums_of[1][c], len(words)) for c in "to"}
    met = met or {c: spectrum(pairs[c][pairs[c] > 0]) for c in "to"}
    every = np.maximum(after["t"] + after["o"], 1)
    log, other, pair_log, held_log = {}, {}, {}, {}
    # Words and pairs of which one class's count is more than its discount. Any other has the likelihood of what is unknown and needs no place in the model.
    said, linked = words == START, np.zeros(len(v), bool)
    for c in "to":
        d = _discounted(n[c], n["t"] + n["o"], sums[c] / (sums["t"] + sums["o"]), chance, spectrum(n[c][n[c] > 0]))
        other[c] = d.sum() / sums[c]
        said |= n[c] > d
        back = (n[c] - d) / sums[c] + other[c] * shared
        d = _discounted(pairs[c], pairs["t"] + pairs["o"], (after[c] / every)[v], chance, met[c])
        linked |= pairs[c] > d
        held = np.where(after[c] > 0, (after[c] - np.bincount(v, pairs[c] - d, len(words))) / np.maximum(after[c], 1), 1.0)
        pair_log[c] = np.log((pairs[c] - d) / np.maximum(after[c][v], 1) + held[v] * back[w])
        log[c], held_log[c] = np.log(back), np.log(held)
    said[v[linked]] = True
    keys = pair_keys(first[linked], second[linked])
    order = np.argsort(keys)
    gains = lambda x, some: (x["t"] - x["o"])[some]
    return Model(words[said], gains(held_log, said), gains(log, said), math.log(other["t"] / other["o"]), keys[order], gains(pair_log, linked)[order])


def calibrate(model: Model, evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """Weighted logistic regression on the one feature, by Newton's method with a slight pull to zero. Returns the loss."""
    middle = float(np.average(evidence, weights=weight))
    scale = float(np.sqrt(np.average((evidence - middle) ** 2, weights=weight))) or 1.0
    x = np.column_stack([np.ones(len(evidence)), (evidence - middle) / scale])
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (toxic - p)) - 1e-3 * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.slope = float(beta[1] / scale)
    model.bias = float(beta[0] - model.slope * middle)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-12, 1 - 1e-12)
    return float(-np.average(toxic * np.log(p) + (1 - toxic) * np.log(1 - p), weights=weight))


def _held_out(col: str, folds: int):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(folds)) == 0


def _flat(share: float) -> Model:
    """No evidence counts: every score is the share of toxic labels."""
    none = np.empty(0, np.int64)
    bias = -500.0 if share <= 0 else 500.0 if share >= 1 else math.log(share / (1 - share))
    return Model(none, np.empty(0), np.empty(0), 0.0, none, np.empty(0), bias)


def _count_pairs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, w, t, o): how many documents of each class have the pair."""
    for pdf in batches:
        texts, toxic = list(pdf["text"]), pdf["y"].to_numpy()
        for begin, some in chunks(texts):
            before, word, owner = pairs_of(some)
            once = np.unique(np.stack((before, word, owner)), axis=1)
            y = toxic[begin + once[2]]
            yield pd.DataFrame({"v": once[0], "w": once[1], "t": (y == 1).astype(np.int64), "o": (y == 0).astype(np.int64)})


def _count_class_words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(w, t, o): how many documents of each class have the word."""
    for pdf in batches:
        texts, toxic = list(pdf["text"]), pdf["y"].to_numpy()
        for begin, some in chunks(texts):
            word, owner = words_of(some)
            once = np.unique(np.stack((word, owner)), axis=1)
            y = toxic[begin + once[1]]
            yield pd.DataFrame({"w": once[0], "t": (y == 1).astype(np.int64), "o": (y == 0).astype(np.int64)})


def _count_words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(w, n): how many documents have the word, summed over a task's batches so far."""
    words, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for pdf in batches:
        for _, some in chunks(list(pdf["text"])):
            word, owner = words_of(some)
            once = np.unique(np.stack((word, owner)), axis=1)[0] if len(word) else word
            new, n = np.unique(once, return_counts=True)
            words, at = np.unique(np.concatenate((words, new)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n)), len(words)).astype(np.int64)
            if len(words) > 1 << 20:
                yield pd.DataFrame({"w": words, "n": counts})
                words, counts = words[:0], counts[:0]
    yield pd.DataFrame({"w": words, "n": counts})


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES, folds: int = FOLDS, chances: tuple[float, ...] = CHANCES) -> Model:
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~_held_out(id_col, folds))
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z").select("id", "y")
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return _flat(1.0 if sizes.get(1) else 0.0)
    chosen = [marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    # 2 * per_class ids at most.
    sample = F.broadcast(chosen[0].union(chosen[1]))
    fit = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(4)) > 0
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(sample, "id").withColumn("fit", fit)
    # Equal texts are one witness. By class, the texts that begin within class_bytes: these few rows are sorted by class alone.
    order = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    texts = written(texts.withColumn("ahead", F.coalesce(F.sum(F.octet_length("text")).over(order), F.lit(0))).where(F.col("ahead") < class_bytes).groupBy("text", "y").agg(F.max("fit").alias("fit")))
    counted = texts.where("fit").select("text", "y")
    sums = F.sum("t").alias("t"), F.sum("o").alias("o")
    # What comes to the driver is bounded by class_bytes.
    every_pair = written(counted.mapInPandas(_count_pairs, "v bigint, w bigint, t bigint, o bigint").groupBy("v", "w").agg(*sums))
    pairs = every_pair.where(F.greatest("t", "o") > min(chances) ** 2 / 3).toArrow()
    firsts = every_pair.groupBy("v").agg(*sums).toArrow()
    rows = every_pair.groupBy(F.least("t", F.lit(5)).alias("t"), F.least("o", F.lit(5)).alias("o")).agg(F.count("*").alias("n")).collect()  # 36 rows at most
    met = {c: np.array([sum(r["n"] for r in rows if r[c] == k) for k in range(6)]) for c in "to"}
    discard(every_pair)
    of_class = counted.mapInPandas(_count_class_words, "w bigint, t bigint, o bigint")
    kept = texts.where("not fit").toPandas()
    # Every document's words, summed together with those of the classes; only words of the sample come back, a row each.
    none = F.lit(0).cast("long")
    everywhere = docs.select(F.col(text_col).alias("text")).mapInPandas(_count_words, "w bigint, n bigint").select("w", "n", none.alias("t"), none.alias("o"))
    everywhere = written(everywhere.union(of_class.select("w", none.alias("n"), "t", "o")).groupBy("w").agg(F.sum("n").alias("n"), *sums), texts)
    words = everywhere.where("t > 0 or o > 0").toArrow()
    column = lambda table, c: table.column(c).to_numpy()
    if not column(words, "t").any() or not column(words, "o").any() or kept["y"].nunique() < 2:
        return _flat(sizes[1] / (sizes[0] + sizes[1]))
    by_class = lambda table: {c: column(table, c) for c in "to"}
    occurrences = everywhere.agg(F.sum("n")).first()[0]
    models = [build(column(words, "w"), by_class(words), column(pairs, "v"), column(pairs, "w"), by_class(pairs), column(words, "n"), occurrences, chance, (column(firsts, "v"), by_class(firsts)), met) for chance in chances]
    discard(everywhere)
    del pairs, words, firsts
    toxic = kept["y"].to_numpy(np.float64)
    share = {y: n / (kept["y"] == y).sum() for y, n in sizes.items()}
    weight = np.where(toxic == 1, share[1], share[0])
    losses = [calibrate(m, m.evidence(list(kept["text"])), toxic, weight / weight.mean()) for m in models]
    return models[int(np.argmin(losses))]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(row, toxic_score): the document as a struct, and its score from 0 to 1."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(train(spark, docs, labels, id_col, text_col, **options).parts())

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(*sent.value)
        for s in texts:
            yield pd.Series(model.scores(list(s)), dtype="float64")

    return docs.select(F.struct("*").alias("row"), scored(F.col(text_col)).alias("toxic_score"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that score less than the threshold."""
    return score(docs, labels, **options).where(F.col("toxic_score") < threshold).select("row.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, labels)
    return found.select("row.doc_id", F.coalesce(_held_out("row.doc_id", FOLDS), F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
