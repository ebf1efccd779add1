import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.functions import kernels
from matchloom.operators.exact import clean_references, exact_match, unmatched
from matchloom.operators.nearest import nearest, top_references
from matchloom.operators.projection import pca, plot_frame, umap
from matchloom.operators.vector_search import top_vectors, with_padding
from matchloom.plans.fuzzy import FuzzyMatcher, compare_algorithms, fuzzy_baseline, robust_fuzzy_match
from matchloom.plans.match import chosen_backend, match_entities, match_lists
from matchloom.sources import providers
from matchloom.sources.capabilities import best_backend, check_optional_dependencies, fuzzy_library
from matchloom.sources.readers import entity_csv, entries
from matchloom.streaming.match_stream import match_stream

DIRTY = ["NY", "LA", "Chiacgo", "Houston City", "San Fran"]
REFS = ["New York", "Los Angeles", "Chicago", "Houston", "San Francisco"]
COLUMNS = ["given_entity", "prediction", "score", "match_method", "match_backend"]


def test_dependencies_and_backend():
    found = check_optional_dependencies()
    assert len(found) == 7 and all(isinstance(v, bool) for v in found.values())
    assert best_backend() in {"sentence-transformer", "fastembed", "fuzzy"} and best_backend(prefer_cpu=True) in {"sentence-transformer", "fastembed", "fuzzy"}
    assert "WRatio" in fuzzy_library()["algorithms"]


def test_basic_fuzzy_lists(spark):
    out = match_lists(spark, DIRTY, REFS)
    assert list(out.columns) == COLUMNS and len(out) == 5
    assert out["score"].between(0, 1).all() and list(out["given_entity"]) == DIRTY
    assert out["prediction"][2] == "Chicago" and out["match_backend"][0] == "auto"
    assert {"null_entries", "exact_matches", "processed_entries", "processing_time", "backend", "model"} <= set(out.attrs)
    assert out.attrs["processed_entries"] == 5 and out.attrs["processing_time"] >= 0


def test_exact_hits_score_one(spark):
    out = match_lists(spark, [*DIRTY, "Chicago", "houston"], REFS)
    assert out["score"][5] == 1.0 and out["prediction"][6] == "Houston" and out.attrs["exact_matches"] == 2


@pytest.mark.parametrize(("sensitive", "hits"), [(True, {0, 3}), (False, {0, 1, 3})])
def test_exact_lookup(spark, sensitive, hits):
    dirty, refs = entries(spark, ["New York", "new york", "LA", "Chicago"], "given_entity"), entries(spark, ["New York", "Los Angeles", "Chicago"], "ref", "ref_id")
    found = exact_match(dirty, refs, sensitive)
    assert {r.row_id for r in found.where("exact is not null").collect()} == hits
    assert unmatched(dirty, refs, sensitive).count() == 4 - len(hits)


def test_last_reference_of_a_key_wins_and_keys_are_not_stripped(spark):
    dirty, refs = entries(spark, ["delhi", " delhi"], "given_entity"), entries(spark, ["Delhi", "DELHI"], "ref", "ref_id")
    assert [r.exact for r in exact_match(dirty, refs).orderBy("row_id").collect()] == ["DELHI", None]
    assert [r.exact for r in exact_match(dirty, refs, strip_keys=True).orderBy("row_id").collect()] == ["DELHI", "DELHI"]


def test_nulls(spark):
    dirty = ["NY", "LA", float("nan"), "Chicago", None, "Houston", "", "N/A"]
    out = match_lists(spark, dirty, ["New York", "Los Angeles", float("nan"), "Chicago", "Houston", None], drop_duplicates=False)
    assert list(out["prediction"].isna()) == [False, False, True, False, True, False, True, True]
    assert out["given_entity"][7] == "N/A" and out.attrs["null_entries"] == 4
    assert clean_references(entries(spark, ["a", None, "nan"], "ref", "ref_id")).count() == 1


def test_edge_cases(spark):
    assert list(match_lists(spark, [], REFS).columns) == COLUMNS and match_lists(spark, [], REFS).empty
    assert list(match_lists(spark, ["test"], ["test"])["score"]) == [1.0]
    alone = match_lists(spark, ["test"], [])
    assert alone["prediction"][0] == "test" and alone["score"][0] == 1.0
    assert match_lists(spark, [None, float("nan"), ""], ["test"])["prediction"].isna().all()
    assert len(match_lists(spark, ["NY", "NY", "LA"], REFS)) == 2 and len(match_lists(spark, ["NY", "NY", "LA"], REFS, drop_duplicates=False)) == 3
    assert list(match_lists(spark, ["New York", "NY"], REFS, remove_identical=True)["given_entity"]) == ["NY"]
    assert "match_method" not in match_lists(spark, DIRTY, REFS, lineage=False).columns
    assert list(match_lists(spark, [0, 12], ["12", "0"])["prediction"]) == ["0", "12"]
    assert len(match_lists(spark, DIRTY, REFS, backend="no such")) == 5  # the default scorer never looks at the backend


def test_bad_options(spark):
    dirty, refs = entries(spark, DIRTY, "given_entity"), entries(spark, REFS, "ref", "ref_id")
    with pytest.raises(ValueError):
        match_entities(dirty, refs, backend="no such")
    with pytest.raises(ValueError):
        match_entities(dirty, refs, unmatched="other")


def test_thresholds_and_unmatched_policies(spark):
    dirty, refs = entries(spark, DIRTY, "given_entity"), entries(spark, REFS, "ref", "ref_id")
    counts = [match_entities(dirty, refs, "hashed", threshold=t, match_type=True).result.where("match_type = 'unmatched'").count() for t in (0.0, 0.5, 0.99)]
    assert counts == sorted(counts) and counts[-1] > 0
    rows = match_entities(dirty, refs, "hashed", threshold=0.99, unmatched="null", match_type=True).result.where("match_type = 'unmatched'").collect()
    assert all(r.prediction is None and r.score is None for r in rows)
    rows = match_entities(dirty, refs, "hashed", threshold=0.99, match_type=True).result.where("match_type = 'unmatched'").collect()
    assert all(r.prediction == r.given_entity and r.score == 1.0 for r in rows)


def test_ties_go_to_the_first_reference(spark):
    values, refs = spark.createDataFrame([("zz",)], "value string"), entries(spark, ["ab", "cd"], "ref", "ref_id")
    assert nearest(values, refs).first().ref == "ab"
    queries, vectors = (df for df in (spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>"), spark.createDataFrame([(5, [2.0, 0.0]), (4, [1.0, 0.0])], "ref_id long, vector array<double>")))
    assert top_vectors(queries, vectors, 1).first().ref_id == 4


def test_constant_provider_ties(spark):
    constant = lambda texts: np.full((len(texts), 100), 0.1)
    vectors = providers.embed_texts(spark, ["a", "b"], constant)
    assert vectors.shape == (2, 100) and providers.embed_texts(spark, "a", constant).shape == (100,)
    with pytest.raises(ValueError):
        providers.with_embeddings(entries(spark, ["a"], "x"), "x", "no such")
    providers.clear_model_cache()
    assert providers.load("hashed") and providers.cached_models() == ["hashed__True"]
    nulls = providers.with_embeddings(entries(spark, ["a", None], "x"), "x").orderBy("row_id").collect()
    assert len(nulls[0].embedding) == 64 and nulls[1].embedding is None


def test_blocks_of_references_give_the_same(spark):
    values = spark.createDataFrame([(f"item {i}",) for i in range(30)], "value string")
    refs = entries(spark, [f"item {i % 17} x" for i in range(40)], "ref", "ref_id").withColumn("key", F.col("ref"))
    rows = lambda block: sorted(map(tuple, top_references(values, refs, "ratio", 3, block=block).collect()))
    assert rows(7) == rows(1000)
    q = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(10)], "query_id long, vector array<double>")
    r = spark.createDataFrame([(i, [float(i % 5), 2.0, 1.0]) for i in range(23)], "ref_id long, vector array<double>")
    near = lambda block: sorted((a, b, c) for a, b, c, _ in top_vectors(q, r, 4, block).collect())
    assert near(5) == near(100)
    assert with_padding(top_vectors(q, r.limit(2), 4), q, 4).where("ref_id = -1").count() == 20


def test_fuzzy_api(spark):
    queries = spark.createDataFrame([("chicago!",), (None,), ("zzzz",), ("",)], "query string")
    refs = entries(spark, REFS, "ref", "ref_id")
    rows = {r.query: r for r in FuzzyMatcher("ratio", "smart").batch(queries, refs, limit=2, cutoff=60).collect()}
    assert rows["chicago!"].match == "Chicago" and rows["chicago!"].score == 100 and rows["chicago!"]["index"] == 2
    assert (rows["zzzz"].match, rows["zzzz"].score, rows["zzzz"]["index"], rows["zzzz"].all_matches) == (None, 0.0, -1, [])
    assert rows[None].match is None
    assert {r.query: r.match for r in robust_fuzzy_match(queries, refs, threshold=99).collect()}["chicago!"] is None
    base = fuzzy_baseline(spark.createDataFrame([("Chiacgo",)], "given_entity string"), refs).first()
    assert base.fuzzy_prediction == "Chicago" and 0.7 <= base.fuzzy_similarity <= 1
    wide = compare_algorithms(queries, refs)
    assert len(wide.columns) == 11 and wide.count() == 3
    for name in ("partial_ratio", "WRatio"):
        one = {r["query"]: (r.ref, r.score) for r in FuzzyMatcher(name).top(queries, refs, 1).collect()}
        assert {r["query"]: (r[f"{name}_match"], r[f"{name}_score"]) for r in wide.collect()} == one
    assert fuzzy_baseline(spark.createDataFrame([], "given_entity string"), refs).count() == 0


def test_stream_matches_like_a_batch(spark, tmp_path):
    dirty, refs = entries(spark, [*DIRTY, None, "chicago"], "given_entity"), entries(spark, REFS, "ref", "ref_id")
    dirty.write.parquet(str(tmp_path / "in"))
    stream = match_stream(spark.readStream.schema(dirty.schema).parquet(str(tmp_path / "in")), refs)
    query = stream.writeStream.format("memory").queryName("matched").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.row_id: (r.prediction, r.score) for r in spark.table("matched").collect()}
    want = {r.row_id: (r.prediction, r.score) for r in match_entities(dirty, refs, drop_duplicates=False).result.collect()}
    assert got == want


def test_pca_is_the_centred_svd(spark):
    x = np.random.default_rng(0).normal(size=(40, 5)) * [5, 3, 1, 1, 1] + 7
    found, explained = pca(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>"), "v", 2)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    axes = vt[:2] * np.sign(vt[[0, 1], np.abs(vt[:2]).argmax(axis=1)])[:, None]
    got = np.array([r.pc for r in found.orderBy("i").collect()])
    assert np.allclose(got, (x - x.mean(axis=0)) @ axes.T) and np.allclose(explained, 100 * s[:2] ** 2 / (s**2).sum())
    frame, titles = plot_frame(found, "pc", "i", explained=explained)
    assert frame.columns == ["x1", "x2", "labels"] and titles[0].startswith("x1 (")
    with pytest.raises(TypeError):
        plot_frame(pd.DataFrame(), "pc", "i")
    with pytest.raises(ValueError):
        plot_frame(found, "pc", "i", explained=[1.0])
    with pytest.raises(ImportError):
        umap(found, "v")


def test_entity_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("stname,dtname\nA,B\n")
    assert entity_csv(spark, str(tmp_path / "x.csv"), ["stname", "dtname"]).first().dtname == "B"


def test_repeated_and_null_ref_ids_over_block_edges(spark):
    values = spark.createDataFrame([("zz",), ("qq",)], "value string")
    refs = spark.createDataFrame([(1, "ab"), (1, "zz"), (None, "qq"), (None, "xx"), (2, "qz")], "ref_id long, ref string")
    for block in (1, 2, 99):
        assert {r.value: (r.ref, r.score) for r in nearest(values, refs, "ratio", block=block).collect()} == {"zz": ("zz", 100.0), "qq": ("qq", 100.0)}
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    r = spark.createDataFrame([(7, [0.0, 1.0]), (7, [3.0, 0.1]), (None, [1.0, 1.0])], "ref_id long, vector array<double>")
    for block in (1, 2, 99):
        assert [x.ref_id for x in top_vectors(q, r, 3, block).orderBy("rank").collect()] == [7, None, 7]


def test_every_bound_keeps_the_best(spark):
    rnd = np.random.default_rng(5)
    names = [" ".join("".join(rnd.choice(list("abcde"), rnd.integers(1, 6))) for _ in range(rnd.integers(1, 4))) for _ in range(120)]
    values, refs = spark.createDataFrame([(n,) for n in names[:50]], "value string"), entries(spark, names[50:], "ref", "ref_id")
    for name in ("token_sort_ratio", "ratio", "WRatio"):
        score = kernels.scorer(name)
        want = {v: max((score(v, r), -i) for i, r in enumerate(names[50:])) for v in set(names[:50])}
        got = {r.value: (r.score, -r.ref_id) for r in top_references(values, refs.withColumn("key", F.col("ref")), name, block=16).collect()}
        assert got == want, name


def test_each_text_is_embedded_once(spark, tmp_path):
    log = tmp_path / "texts"

    def encode(texts):
        with log.open("a") as f:
            f.writelines(t + "\n" for t in texts)
        return providers.hashed_ngrams(texts)

    providers._cache["hashed__True"] = encode
    try:
        dirty, refs = entries(spark, ["Chiacgo", "Huston", "Chiacgo"], "given_entity"), entries(spark, [f"Ref {i}" for i in range(12)], "ref", "ref_id")
        from matchloom.operators.vector_search import numbered

        vectors = providers.with_embeddings(numbered(refs, 2), "ref", encode, output="vector")
        queries = providers.with_embeddings(dirty.select("given_entity").distinct(), "given_entity", encode, output="vector").withColumnRenamed("given_entity", "query_id")
        assert top_vectors(queries, vectors, 1, 2).count() == 2
    finally:
        providers.clear_model_cache()
    assert sorted(log.read_text().split("\n")[:-1]) == sorted(["Chiacgo", "Huston", *(f"Ref {i}" for i in range(12))])


def test_names_select_their_provider_or_raise(spark, monkeypatch):
    for name in ("openai", "gemini"):
        assert chosen_backend(name, "auto")[0] == chosen_backend("x", name)[0] == {"gemini": "google"}.get(name, name)
        if not providers.available(providers.PACKAGES[{"gemini": "google"}.get(name, name)]):
            with pytest.raises(ImportError):
                match_lists(spark, DIRTY, REFS, model=name)
        assert list(match_lists(spark, ["chicago", None], REFS, model=name)["prediction"])[:1] == ["Chicago"]  # nothing is left for the model
    if not providers.available("sentence_transformers"):
        with pytest.raises(ImportError):
            match_lists(spark, DIRTY, REFS, model="all-MiniLM-L6-v2", backend="sentence-transformers")
    with pytest.raises(ValueError):
        match_lists(spark, DIRTY, REFS, model="all-MiniLM-L6-v2", backend="no such")
    monkeypatch.setattr("matchloom.sources.capabilities.available", lambda p: p in ("openai", None))
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert best_backend() == "openai"
    monkeypatch.delenv("OPENAI_API_KEY")
    assert best_backend() == "fuzzy"
    with pytest.raises(ValueError):
        providers._key("OPENAI_API_KEY")
