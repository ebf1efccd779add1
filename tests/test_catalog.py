from matchloom.plans import catalog
from matchloom.sources.readers import LEADERBOARD, leaderboard


def test_sizes_of_the_catalog(spark):
    assert catalog.models(spark).count() == 25 and catalog.models(spark).where("dimensions_int is null").count() == 5
    assert catalog.category_members(spark).count() == 32 and catalog.recommendations(spark).select("use_case").distinct().count() == 9


def test_recommendations(spark):
    names = lambda **o: [r.model for r in catalog.recommend(spark, **o).orderBy("rank").collect()]
    assert names(use_case="speed_critical")[0] == "all-MiniLM-L6-v2" and names(use_case="no such") == []
    assert names(use_case="general_purpose", constraint="low_memory") == ["Alibaba-NLP/gte-Qwen2-1.5B-instruct", "gemma2"]
    assert names(use_case="speed_critical", constraint="fast_inference") == ["all-MiniLM-L6-v2", "phi3", "gemma", "nomic-embed-text"]


def test_orders(spark):
    up = catalog.order_by(catalog.enriched(spark), "size").collect()
    down = catalog.order_by(catalog.enriched(spark), "size", ascending=False).collect()
    assert up[0].model == "all-MiniLM-L6-v2" and up[-1].size_gb is None and [r.model for r in down] == [r.model for r in reversed(up)]
    assert [r.size_gb for r in catalog.smallest(spark).collect()] == sorted(r.size_gb for r in catalog.smallest(spark).collect())
    assert set(catalog.available_models(spark)) == {"sentence-transformers", "openai", "gemini", "fastembed", "rapidfuzz"}
    assert list(catalog.available_models(spark, "openai")) == ["openai"] and "LIGHTWEIGHT" in catalog.guide(spark)


def test_a_missing_leaderboard_is_empty(spark, tmp_path):
    assert leaderboard(spark, str(tmp_path / "none.csv")).count() == 0
    assert catalog.enriched(spark, leaderboard(spark, str(tmp_path / "none.csv"))).count() == 25


def test_orders_names_and_leaderboards_from_files(spark, tmp_path):
    by = lambda order: [r.model for r in catalog.order_by(catalog.enriched(spark), order).collect()]
    assert by("no such")[0] == "all-MiniLM-L6-v2" and sorted(by("no such")) == sorted(by("size"))
    named = catalog.available_models(spark, include_details=False)
    assert {len(df.columns) for df in named.values()} == {1} and "fastembed" in named
    path = tmp_path / "board.csv"
    path.write_text(",".join(f'"{c}"' for c in LEADERBOARD) + "\n" + '"[all-MiniLM-L6-v2](https://x)",4,56.2,384,256,87,22M,41.9,63.1,42.4,78.9,58.0\n')
    board = leaderboard(spark, str(path))
    assert board.first().clean_model_name == "all-MiniLM-L6-v2"
    row = catalog.enriched(spark, board).where("model = 'all-MiniLM-L6-v2'").first()
    assert row.leaderboard_rank == 4 and row.data_source == "MTEB+Curated" and row.overall_score == 56.2
