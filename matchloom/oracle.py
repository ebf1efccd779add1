"""DuckDB SQL with the results of matchloom.queries."""

from __future__ import annotations

from matchloom.plans import catalog_values as values
from matchloom.queries import BOARD, SPOIL

WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _null(x: str) -> str:
    return f"({x} IS NULL OR {_strip(f'lower({x})')} IN ('nan', 'null', 'none', '', 'na', 'n/a'))"


def _simple(x: str) -> str:
    return f"coalesce({_strip(f'lower({x})')}, '')"


def _smart(x: str) -> str:
    spaced = f"regexp_replace({_simple(x)}, '{NOT_WORD}', ' ', 'g')"
    return f"regexp_replace({_strip(spaced)}, '{WS}+', ' ', 'g')"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort({_tokens(x)}), ' ')"


def _common(a: str, b: str) -> str:
    """Longest common subsequence of two columns, row by row of the textbook table."""
    cell = f"CASE WHEN {a}[i] = {b}[j] THEN line[j] + 1 ELSE greatest(line[j + 1], acc[j]) END"
    line = f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, {cell}), [0::BIGINT])"
    zeros = f"list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE list_last(list_reduce(range(1, length({a}) + 1), lambda line, i: {line}, {zeros})) END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * ({_common(a, b)}) / (length({a}) + length({b})) END"


DIRTY = f"dirty AS (SELECT CAST(p_partkey AS BIGINT) AS row_id, {SPOIL} AS given_entity FROM part)"
REFS = f"""names AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name),
refs AS (
  SELECT CAST(k AS BIGINT) AS ref_id, p_name AS ref FROM names WHERE length(p_name) % 4 <> 0
  UNION ALL SELECT CAST(k + 10000000 AS BIGINT), upper(p_name) FROM names WHERE length(p_name) % 4 = 1
),
lookup AS (SELECT lower(ref) AS key, arg_max(ref, ref_id) AS exact FROM refs GROUP BY 1)"""
PAIRS = f"""firsts AS (SELECT ref_id % 3 AS slot, arg_min(ref, ref_id) AS b FROM refs WHERE ref_id < 10000000 GROUP BY 1),
pairs AS (SELECT row_id, given_entity AS a, b FROM dirty JOIN firsts ON row_id % 3 = slot WHERE NOT {_null("given_entity")})"""
WITH = f"WITH {DIRTY}, {REFS}, {PAIRS}"

BEST = f"""given AS (SELECT DISTINCT given_entity AS value FROM dirty WHERE NOT {_null("given_entity")}),
sorted AS (SELECT value, ref_id, ref, x, y FROM (SELECT value, {_sorted("value")} AS x FROM given), (SELECT ref_id, ref, {_sorted("ref")} AS y FROM refs)),
scored AS (SELECT value, ref_id, ref, {_ratio("x", "y")} AS score FROM sorted),
best AS (SELECT value, ref, score FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, ref_id) AS n FROM scored) WHERE n = 1)"""


def _match(exact: bool = True, threshold: float | None = None, null: bool = False, sensitive: bool = False, lineage: bool = True, kind: bool = False, extra: str = "", duplicates: bool = True) -> str:
    hit = "NULL" if not exact else "CASE WHEN list_contains((SELECT list(ref) FROM refs), given_entity) THEN given_entity END" if sensitive else "exact"
    base = f"""found AS (SELECT row_id, given_entity, {_null("given_entity")} AS gone, {hit} AS exact FROM dirty LEFT JOIN lookup ON lower(given_entity) = key AND NOT {_null("given_entity")})"""
    reach = "b.ref IS NOT NULL" + (f" AND score / 100 >= {threshold}" if threshold is not None else "")
    miss, miss_score = ("NULL", "NULL") if null else ("given_entity", "1.0")
    columns = ["given_entity", "prediction", "score"] + ["match_type"] * kind + ["match_method", "match_backend"] * lineage
    rows = f"""out AS (SELECT row_id, given_entity,
  CASE WHEN gone THEN NULL WHEN exact IS NOT NULL THEN exact WHEN {reach} THEN b.ref ELSE {miss} END AS prediction,
  round(CASE WHEN gone THEN NULL WHEN exact IS NOT NULL THEN 1.0 WHEN {reach} THEN score / 100 ELSE {miss_score} END, 6) AS score,
  CASE WHEN gone THEN 'null' WHEN exact IS NOT NULL THEN 'exact' WHEN {reach} THEN 'model' ELSE 'unmatched' END AS match_type,
  'fuzzy' AS match_method, 'fuzzy' AS match_backend
FROM found LEFT JOIN best b ON given_entity = b.value)"""
    names = ", ".join(columns)
    final = f"SELECT row_id, {names} FROM out {extra}" if not duplicates else f"SELECT min(row_id) AS row_id, {names} FROM out {extra} GROUP BY {names}"
    return f"{WITH}, {BEST}, {base}, {rows} {final}"


def _top(preprocess, limit: int, cutoff: float) -> str:
    guarded = f"CASE WHEN x = '' AND y = '' THEN 100.0 WHEN x = '' OR y = '' THEN 0.0 ELSE {_ratio('x', 'y')} END"
    return f"""{WITH}, given AS (SELECT DISTINCT given_entity AS query FROM dirty WHERE NOT {_null("given_entity")}),
both_ AS (SELECT query, ref_id, ref, x, y FROM (SELECT query, {preprocess("query")} AS x FROM given), (SELECT ref_id, ref, {preprocess("ref")} AS y FROM refs)),
scored AS (SELECT query, ref_id, ref, {guarded} AS score FROM both_),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ref_id) AS rank FROM scored WHERE score >= {cutoff}) WHERE rank <= {limit})"""


_SET = f"""sets AS (SELECT row_id, list_distinct({_tokens("a")}) AS s, list_distinct({_tokens("b")}) AS t FROM pairs),
parts AS (
  SELECT row_id, len(s) AS ns, len(t) AS nt, array_to_string(list_sort(list_filter(s, lambda w: list_contains(t, w))), ' ') AS both_,
    array_to_string(list_sort(list_filter(s, lambda w: NOT list_contains(t, w))), ' ') AS x,
    array_to_string(list_sort(list_filter(t, lambda w: NOT list_contains(s, w))), ' ') AS y
  FROM sets
),
sizes AS (SELECT *, length(both_) AS m, CASE WHEN both_ = '' THEN 0 ELSE 1 END AS g, {_common("x", "y")} AS c FROM parts)
SELECT row_id, round(CASE WHEN ns = 0 OR nt = 0 THEN 0.0 WHEN m > 0 AND (x = '' OR y = '') THEN 100.0
  ELSE greatest(100.0 - 100.0 * (length(x) + length(y) - 2 * c) / (2 * (m + g) + length(x) + length(y)),
    CASE WHEN m > 0 THEN 100.0 - 100.0 * (1 + length(x)) / (2 * m + 1 + length(x)) ELSE 0 END,
    CASE WHEN m > 0 THEN 100.0 - 100.0 * (1 + length(y)) / (2 * m + 1 + length(y)) ELSE 0 END) END, 6) AS score FROM sizes"""

_COS = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
r AS (SELECT vec_id AS ref_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
top AS (SELECT * FROM (SELECT query_id, ref_id, s AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ref_id) AS INTEGER) AS rank
  FROM (SELECT query_id, ref_id, list_cosine_similarity(v, w) AS s FROM q, r WHERE {})) WHERE rank <= {})"""


def _quoted(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _gb(x: str) -> str:
    return f"CASE WHEN upper({x}) LIKE '%GB%' THEN try_cast(replace(upper({x}), 'GB', '') AS DOUBLE) WHEN upper({x}) LIKE '%MB%' THEN round_even(try_cast(replace(upper({x}), 'MB', '') AS DOUBLE) / 1024, 2) ELSE try_cast({x} AS DOUBLE) END"


def _values(rows: list[list], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(c) if isinstance(c, int) else _quoted(c) for c in r) + ")" for r in rows) + f") AS t({names})"


_models = [[i, *r[:6], len(values.items(r[6])), len(values.items(r[7]))] for i, r in enumerate(values.rows(values.MODELS))]
MODELS = f"models AS (SELECT pos, model, organization, size_category, estimated_params, dimensions, CAST(trunc(try_cast(dimensions AS DOUBLE)) AS BIGINT) AS dimensions_int, round({_gb('memory')}, 4) AS size_gb, n_strengths, n_weaknesses FROM {_values(_models, 'pos, model, organization, size_category, estimated_params, memory, dimensions, n_strengths, n_weaknesses')})"
_members = [[r[0], i, n, m] for i, r in enumerate(values.rows(values.CATEGORIES)) for n, m in enumerate(values.items(r[1]))]
MEMBERS = f"members AS (SELECT * FROM {_values(_members, 'category, pos, nth, model')})"
_uses = [[r[0], n, m] for r in values.rows(values.USE_CASES) for n, m in enumerate(values.items(r[1]))]
USES = f"uses AS (SELECT use_case, u.pos, u.model, size_category FROM {_values(_uses, 'use_case, pos, model')[:-len('AS t(use_case, pos, model)')]}AS u(use_case, pos, model) LEFT JOIN models m ON u.model = m.model)"
_NAME = r"CASE WHEN regexp_matches(name, '\[(.*?)\]') THEN regexp_extract(name, '\[(.*?)\]', 1) ELSE name END"
BOARD_ = f"""board AS (SELECT line, name, {_NAME} AS clean_model_name, CAST(trunc(try_cast(rank_ AS DOUBLE)) AS BIGINT) AS rank, try_cast(mean_ AS DOUBLE) AS overall_score,
  CAST(trunc(try_cast(dims AS DOUBLE)) AS BIGINT) AS dims, round_even(try_cast(mem AS DOUBLE) / 1024, 2) AS memory_gb, coalesce(params, 'Unknown') AS clean_parameters, try_cast(retr AS DOUBLE) AS retrieval
  FROM {_values([[i, *r] for i, r in enumerate(BOARD)], 'line, name, rank_, mean_, dims, tokens, mem, params, retr, clas, clus, sts, rera')})"""
ENRICHED = f"""{MODELS}, {MEMBERS}, {BOARD_},
lines AS (SELECT clean_model_name AS model, min(line) AS line, arg_min(rank, line) AS rank, arg_min(overall_score, line) AS overall_score, any_value(dims) AS dims, any_value(memory_gb) AS gb FROM board WHERE clean_model_name IS NOT NULL GROUP BY 1),
home AS (SELECT model, arg_min(category, pos) AS category FROM members GROUP BY 1),
enriched AS (SELECT coalesce(m.model, l.model) AS model, coalesce(nullif(dims, 0), dimensions_int) AS dimensions, round(coalesce(gb, size_gb), 4) AS size_gb, rank AS leaderboard_rank, overall_score,
  coalesce(category, 'uncategorized') AS category, CASE WHEN m.model IS NOT NULL AND l.model IS NOT NULL THEN 'MTEB+Curated' WHEN l.model IS NOT NULL THEN 'MTEB' ELSE 'Curated' END AS data_source,
  coalesce(m.pos, 1000000 + l.line) AS listed
  FROM models m FULL JOIN lines l ON m.model = l.model LEFT JOIN home h ON h.model = coalesce(m.model, l.model))"""


def _catalog(order: str, source: str = "SELECT model, size_gb, dimensions_int AS dimensions, pos AS listed FROM models", limit: str = "") -> str:
    return f"WITH {ENRICHED}, base AS ({source}) SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS place, model, size_gb, dimensions FROM base QUALIFY row_number() OVER (ORDER BY {order}) <= {limit or 1000}"


SQL: dict[str, str] = {
    "null_token_flag": f"{WITH} SELECT row_id, {_null('given_entity')} AS is_null FROM dirty",
    "null_split_counts": f"{WITH} SELECT count(*) FILTER (NOT {_null('given_entity')}) AS n_valid, count(*) FILTER ({_null('given_entity')}) AS n_null FROM dirty",
    "ref_null_filter": f"{WITH} SELECT ref_id, ref FROM refs",
    "simple_preprocessed": f"SELECT doc_id, md5({_simple('text')}) AS digest FROM documents",
    "smart_preprocessed": f"SELECT doc_id, md5({_smart('text')}) AS digest FROM documents",
    "token_sorted": f"{WITH} SELECT row_id, {_sorted('given_entity')} AS tokens FROM dirty",
    "exact_match_ci": f"{WITH} SELECT row_id, exact FROM dirty LEFT JOIN lookup ON lower(given_entity) = key AND NOT {_null('given_entity')}",
    "exact_match_cs": f"{WITH} SELECT row_id, r.ref AS exact FROM dirty LEFT JOIN (SELECT DISTINCT ref FROM refs) r ON given_entity = r.ref",
    "exact_last_ref_wins": f"{WITH} SELECT key, exact FROM lookup",
    "exact_anti": f"{WITH} SELECT row_id, given_entity FROM dirty LEFT JOIN lookup ON lower(given_entity) = key WHERE exact IS NULL AND NOT {_null('given_entity')}",
    "ratio_pairs": f"{WITH} SELECT row_id, round({_ratio('a', 'b')}, 6) AS score FROM pairs",
    "ratio_expression_pairs": f"{WITH} SELECT row_id, round({_ratio('a', 'b')}, 6) AS score FROM pairs",
    "similarity_guarded": f"{WITH} SELECT row_id, round({_ratio('a', 'b')}, 6) AS score FROM (SELECT row_id, {_smart('a')} AS a, {_smart('b')} AS b FROM pairs)",
    "token_sort_ratio_pairs": f"{WITH} SELECT row_id, round({_ratio('a', 'b')}, 6) AS score FROM (SELECT row_id, {_sorted('a')} AS a, {_sorted('b')} AS b FROM pairs)",
    "token_set_ratio_pairs": f"{WITH}, {_SET}",
    "nearest_fuzzy": f"{WITH}, {BEST} SELECT value, ref, round(score, 6) AS score FROM best",
    "match_pipeline": _match(),
    "match_keep_duplicates": _match(duplicates=False),
    "match_remove_identical": _match(duplicates=False, extra="WHERE given_entity <> prediction OR given_entity IS NULL OR prediction IS NULL"),
    "match_without_exact": _match(exact=False, duplicates=False),
    "match_threshold_null": _match(threshold=0.9, null=True, kind=True, duplicates=False),
    "match_case_sensitive": _match(threshold=0.9, sensitive=True, kind=True, lineage=False, duplicates=False),
    "match_counts": _match(threshold=0.9, duplicates=False).rsplit(" SELECT row_id", 1)[0] + " SELECT match_type, count(*) AS n FROM out GROUP BY match_type",
    "match_streamed": _match(lineage=False, duplicates=False).rsplit(" SELECT row_id", 1)[0] + " SELECT row_id, prediction, score FROM out",
    "fuzzy_topk": f"{_top(_simple, 3, 0)} SELECT query, CAST(rank AS INTEGER) AS rank, ref_id, round(score, 6) AS score FROM top",
    "fuzzy_cutoff": f"{_top(_simple, 1, 85)} SELECT g.query, ref AS match, round(coalesce(score, 0.0), 6) AS score, CAST(coalesce(ref_id, -1) AS INTEGER) AS index, CAST(CASE WHEN ref IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_matches FROM given g LEFT JOIN top USING (query)",
    "l2_normalized": "SELECT vec_id, round(v[1] / n, 6) AS first, 1.0 AS norm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "cosine_nearest": f"WITH {_COS.format('query_id <> ref_id', 1)} SELECT query_id, ref_id, round(similarity, 6) AS similarity FROM top",
    "cosine_threshold_identity": f"WITH {_COS.format('query_id <> ref_id', 1)} SELECT query_id, CASE WHEN similarity >= 0.3 THEN ref_id ELSE query_id END AS ref_id, round(CASE WHEN similarity >= 0.3 THEN similarity ELSE 1.0 END, 6) AS similarity FROM top",
    "cosine_threshold_null": f"WITH {_COS.format('query_id <> ref_id', 1)} SELECT query_id, CASE WHEN similarity >= 0.3 THEN ref_id END AS ref_id, round(CASE WHEN similarity >= 0.3 THEN similarity END, 6) AS similarity FROM top",
    "cosine_topk": f"WITH {_COS.format('query_id <> ref_id', 5)} SELECT query_id, rank, ref_id, round(similarity, 6) AS similarity FROM top",
    "topk_padded": f"WITH {_COS.format('ref_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)', 60)} SELECT query_id, CAST(n AS INTEGER) AS rank, coalesce(ref_id, -1) AS ref_id, round(similarity, 6) AS similarity FROM (SELECT query_id, unnest(range(1, 61)) AS n FROM q) LEFT JOIN (SELECT query_id, rank AS n, ref_id, similarity FROM top) USING (query_id, n)",
    "catalog_models": f"WITH {MODELS} SELECT model, organization, size_category, dimensions, dimensions_int, size_gb, n_strengths, n_weaknesses FROM models",
    "catalog_categories": f"WITH {MEMBERS} SELECT category, nth, model FROM members",
    "catalog_recommendations": f"WITH {MODELS}, {USES} SELECT use_case, CAST(pos + 1 AS INTEGER) AS rank, model FROM uses",
    "catalog_low_memory": f"WITH {MODELS}, {USES} SELECT use_case, CAST(row_number() OVER (PARTITION BY use_case ORDER BY pos) AS INTEGER) AS rank, model FROM uses WHERE size_category IN ('tiny', 'small', 'medium')",
    "catalog_fast_inference": f"WITH {MODELS}, {USES} SELECT use_case, CAST(row_number() OVER (PARTITION BY use_case ORDER BY CASE size_category WHEN 'tiny' THEN 0 WHEN 'small' THEN 1 WHEN 'medium' THEN 2 WHEN 'extra_large' THEN 4 ELSE 3 END, pos) AS INTEGER) AS rank, model FROM uses",
    "catalog_by_size": _catalog("size_gb ASC NULLS LAST, listed"),
    "catalog_by_size_desc": _catalog("size_gb DESC NULLS FIRST, listed DESC"),
    "catalog_by_name": _catalog("model ASC NULLS LAST, listed"),
    "catalog_by_dimensions": _catalog("dimensions ASC NULLS LAST, listed"),
    "catalog_by_performance": _catalog("CASE WHEN leaderboard_rank IS NOT NULL THEN 0 WHEN size_gb IS NOT NULL THEN 1 ELSE 2 END, coalesce(CAST(leaderboard_rank AS DOUBLE), size_gb) NULLS FIRST, listed", "SELECT * FROM enriched"),
    "catalog_smallest": _catalog("size_gb ASC NULLS LAST, listed", "SELECT model, size_gb, dimensions_int AS dimensions, pos AS listed FROM models WHERE size_gb <= 1.0", "5"),
    "catalog_api_models": f"SELECT model, provider, CAST(dimensions AS INTEGER) AS dimensions, CAST(max_tokens AS INTEGER) AS max_tokens FROM {_values([[r[0], r[1], int(r[2]), int(r[3])] for r in values.rows(values.API_MODELS)], 'model, provider, dimensions, max_tokens')}",
    "catalog_fuzzy_methods": f"SELECT method, description FROM {_values(values.rows(values.FUZZY_METHODS), 'method, description')}",
    "leaderboard_clean": f"WITH {BOARD_} SELECT clean_model_name, memory_gb, clean_parameters, rank, retrieval FROM board",
    "leaderboard_hosted": rf"WITH {BOARD_} SELECT clean_model_name FROM board WHERE coalesce(contains(lower(name), 'huggingface.co'), false) OR coalesce(regexp_matches(name, '\[(.*?)\]') AND contains(clean_model_name, '/') AND NOT starts_with(clean_model_name, 'models/') AND NOT regexp_matches(lower(clean_model_name), 'gpt-|text-embedding|gemini-|claude-'), false)",
    "catalog_enriched": f"WITH {ENRICHED} SELECT model, dimensions, size_gb, leaderboard_rank, overall_score, category, data_source FROM enriched",
}
