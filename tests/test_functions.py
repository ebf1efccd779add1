import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import casts, kernels, vectors
from matchloom.functions.text import is_null_token, preprocess, simple_preprocess, smart_preprocess, sorted_tokens
from matchloom.sources.readers import entries

LETTERS = st.text(alphabet="abcdé 😀ß", max_size=14)


def table_lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(line[j] + 1 if x == y else max(line[j + 1], new[j]))
        line = new
    return line[-1]


@settings(max_examples=300, deadline=None)
@given(LETTERS, LETTERS)
def test_common_subsequence_is_the_textbooks(a, b):
    assert kernels.common_subsequence(a, b) == table_lcs(a, b)


@settings(max_examples=200, deadline=None)
@given(LETTERS, LETTERS)
def test_scorers_are_bounded_and_symmetric_where_they_should_be(a, b):
    for name in kernels.SCORERS:
        assert 0 <= kernels.scorer(name)(a, b) <= 100 + 1e-9
    assert kernels.ratio(a, b) == kernels.ratio(b, a)
    assert kernels.upper_bound(a, b) + 1e-9 >= kernels.ratio(a, b)


def all_windows(a, b):
    """The best ratio of the shorter string with any piece of the other that is no longer, and, if it is shorter, stands at an end."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    best = 0.0
    for short, long in {(a, b), (b, a)} if len(a) == len(b) else {(min(a, b, key=len), max(a, b, key=len))}:
        for i in range(len(long)):
            for j in range(i + 1, min(i + len(short), len(long)) + 1):
                if j - i == len(short) or i == 0 or j == len(long):
                    best = max(best, 200.0 * table_lcs(short, long[i:j]) / (len(short) + j - i))
    return best


@settings(max_examples=200, deadline=None)
@given(LETTERS, LETTERS)
def test_partial_ratio_is_the_best_window(a, b):
    assert kernels.partial_ratio(a, b) == pytest.approx(all_windows(a, b))


def test_scorers_by_hand():
    assert kernels.ratio("", "") == 100
    assert kernels.ratio("abcd", "abxd") == pytest.approx(75)
    assert kernels.token_sort_ratio("fuzzy was a bear", "bear a was fuzzy") == 100
    assert kernels.token_set_ratio("fuzzy fuzzy bear", "fuzzy bear") == 100
    assert kernels.token_set_ratio("", "a") == 0
    assert kernels.partial_ratio("bear", "a fuzzy bear here") == 100
    assert kernels.weighted_ratio("", "x") == 0
    assert kernels.weighted_ratio("new york", "new york") == 100
    assert kernels.scorer("no such") is kernels.ratio
    assert kernels.similarity("", "") == 100 and kernels.similarity("", "a") == 0


def test_ratio_expression_equals_the_kernel(spark):
    rnd = random.Random(3)
    pairs = [("".join(rnd.choices("abcé😀 ", k=rnd.randrange(12))), "".join(rnd.choices("abcé😀 ", k=rnd.randrange(12)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("s", kernels.ratio_expression(F.col("a"), F.col("b"))).collect():
        assert r.s == pytest.approx(kernels.ratio(r.a, r.b)), (r.a, r.b)


def test_registered_scorers_work_in_sql(spark):
    kernels.register(spark)
    assert spark.sql("select token_sort_ratio('b a', 'a b') as s").first().s == 100


def test_null_tokens(spark):
    values = [None, float("nan"), "", "nan", "NaN", "null", "none", "na", "n/a", " N/A\t", "New York", "0", 0]
    df = entries(spark, values, "x").orderBy("row_id")
    assert [r[0] for r in df.select(is_null_token(F.col("x"))).collect()] == [True] * 10 + [False] * 3


@pytest.mark.parametrize("text", ["  Hello,  World!\t", "a　b", "É-É", "\x1fx\x1c", "naïve—test", "", "İstanbul"])
def test_preprocessing_is_pythons(spark, text):
    import re

    want = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text.lower().strip()).strip())
    df = spark.createDataFrame([(text,)], "x string")
    got = df.select(simple_preprocess(F.col("x")), smart_preprocess(F.col("x"))).first()
    assert got[0] == text.lower().strip()
    if text != "İstanbul":  # a combining dot is a word character here and none there
        assert got[1] == want


def test_preprocess_of_null_and_unknown_name(spark):
    df = spark.createDataFrame([(None,), (" A ",)], "x string")
    assert [r[0] for r in df.select(preprocess(F.col("x"), "no such")).collect()] == ["", "a"]
    assert [r[0] for r in df.select(sorted_tokens(F.lit("b  a\tc"))).collect()] == ["a b c"] * 2


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vectors.cosine(F.col("a"), F.col("a")), vectors.cosine(F.col("a"), F.col("b")), vectors.unit(F.col("a")), vectors.unit(F.col("b")), vectors.unit(F.col("b"), keep_zero=False)).first()
    assert r[0] == pytest.approx(1) and r[1] is None and r[2] == pytest.approx([0.6, 0.8]) and r[3] == [0, 0] and r[4] is None


def test_casts(spark):
    rows = [("12.9", 12.9, 12), ("Unknown", None, None), ("", None, None), (None, None, None), ("n/a", None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "x string").select(casts.safe_float(F.col("x")), casts.safe_int(F.col("x")))
    assert [tuple(r) for r in df.collect()] == [(r[1], r[2]) for r in rows]
    memory = {"90MB": 0.09, "1.3GB": 1.3, "3-7GB": None, "2": 2.0, None: None, "": None}
    df = spark.createDataFrame([(k,) for k in memory], "x string")
    assert [r[0] for r in df.select(casts.memory_to_gb(F.col("x"))).collect()] == list(memory.values())
    names = {"[a/b](https://huggingface.co/a/b)": True, "[a/b](x)": True, "[models/b](x)": False, "[x/gpt-4](y)": False, "plain": False, None: False}
    df = spark.createDataFrame([(k,) for k in names], "x string")
    assert [r[0] for r in df.select(casts.is_hosted_model(F.col("x"))).collect()] == list(names.values())
