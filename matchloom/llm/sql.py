"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from matchloom.llm.license_templates import TEMPLATES

_WORDS = r"""coalesce(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"""

OP1 = f"""
WITH items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, n, w[i:i + n - 1] AS gram
  FROM (SELECT item_id, w, least(len(w), 8) AS n, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM grams),
windows AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM docs, lens)
),
hits AS (SELECT doc_id, i, n, item_id FROM windows JOIN grams USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(len(items), 0) >= 2 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scores)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""

OP5 = """
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
coded AS (SELECT *, length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '|', '&bar;')) + 24 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The phrases as the contract has them; the templates are the scan's own.
_PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
_TEMPLATES = ", ".join(f"({i}, {_quoted(label)}, {str(i < len(_PHRASES)).lower()}, {_quoted(text)})" for i, (label, text) in enumerate([*_PHRASES, *TEMPLATES]))

OP10 = f"""
WITH templates AS (SELECT tid, label, phrase, {_WORDS.format("text")} AS w FROM (VALUES {_TEMPLATES}) AS t(tid, label, phrase, text)),
grams AS (SELECT tid, label, phrase, len(w) - 2 AS n_grams, i - 1 AS tpos, w[i:i + 2] AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM templates)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("text")} AS w FROM documents),
places AS (SELECT rid, i - 1 AS pos, w[i:i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM docs)),
votes AS (
  SELECT rid, tid, label, phrase, n_grams, pos - tpos AS diag, list(DISTINCT tpos) AS places, min(pos) AS first, max(pos) + 2 AS last
  FROM places JOIN grams USING (gram) GROUP BY ALL
),
base AS (SELECT rid, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM votes WHERE phrase AND len(places) = n_grams GROUP BY rid),
stepped AS (SELECT *, diag - lag(diag) OVER (PARTITION BY rid, tid ORDER BY diag) AS step FROM votes WHERE NOT phrase),
islands AS (SELECT *, sum(CASE WHEN step <= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY rid, tid ORDER BY diag) AS island FROM stepped),
merged AS (
  SELECT rid, tid, label, n_grams, len(list_distinct(flatten(list(places)))) AS together, min(first) AS begin_, max(last) AS end_,
    max({{'votes': len(places), 'before': -first, 'last': last}}) AS best
  FROM islands GROUP BY rid, tid, label, n_grams, island
),
spans AS (
  SELECT rid, tid, label, n_grams, CASE WHEN whole THEN together ELSE best.votes END AS votes, CASE WHEN whole THEN begin_ ELSE -best.before END AS first, CASE WHEN whole THEN end_ ELSE best.last END AS last
  FROM (SELECT *, end_ - begin_ < 2 * (n_grams + 2) AS whole FROM merged)
),
shares AS (SELECT *, votes / n_grams AS coverage FROM spans),
counted AS (SELECT * FROM shares WHERE coverage >= 0.7),
kept AS (
  SELECT * FROM counted s WHERE NOT EXISTS (
    SELECT 1 FROM counted o WHERE o.rid = s.rid AND o.label <> s.label AND o.first <= s.last AND s.first <= o.last
      AND (o.votes > s.votes OR (o.votes = s.votes AND (o.coverage > s.coverage OR (o.coverage = s.coverage AND o.tid < s.tid)))))
),
named AS (SELECT rid, label FROM kept UNION SELECT rid, label FROM votes WHERE phrase AND len(places) = n_grams),
all_ AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY rid),
best AS (SELECT rid, max(coverage) AS nearest FROM shares GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(nearest, 0.0) END AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN all_ USING (rid) LEFT JOIN best USING (rid)
"""

SQL = {"op1_decontaminate": OP1, "op4_topk": OP4, "op5_chat": OP5, "op10_licenses": OP10}
