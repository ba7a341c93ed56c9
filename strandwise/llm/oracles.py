"""SQL for DuckDB of the queries that SQL can express. The others are tested against brute force in tests/llm."""

from __future__ import annotations

from strandwise.llm import license_scan as scan

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank
  FROM (SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0))
WHERE rank <= 5
"""


def escaped(x: str) -> str:
    return f"replace(replace({x}, '\\', '\\b'), '<', '\\l')"


CHAT = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
o AS (SELECT *, lag(role) OVER w p, row_number() OVER w n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, length({escaped('text')}) + CASE WHEN p = role THEN 6 ELSE 8 + length(replace({escaped('role')}, '|', '\\p')) + CASE WHEN p IS NULL THEN 0 ELSE 8 END END c FROM o)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) loss_sha256, (8 + sum(c))::BIGINT formatted_chars
FROM m GROUP BY conv_id
"""

LINES = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i - 1 pos, l[i:i + 2] t FROM (SELECT *, unnest(range(1, len(l) - 1)) i FROM d)),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) r FROM w WHERE trim(t[1] || t[2] || t[3]) <> '') WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) p FROM later),
x AS (SELECT doc_id, i - 1 p, l[i] line FROM (SELECT *, unnest(range(1, len(l) + 1)) i FROM d))
SELECT x.doc_id, coalesce(string_agg(line, chr(10) ORDER BY x.p) FILTER (WHERE g.p IS NULL), '') AS text, count(*) n_lines, count(g.p) n_removed
FROM x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""


def licenses() -> str:
    rows = []
    for n, (phrase, label) in enumerate([*scan.BASE.items(), *scan.NOTICES.items()]):
        w = phrase.split()
        rows += [f"({n}, '{label}', {str(n < len(scan.BASE)).lower()}, {len(w)}, {i}, '{' '.join(w[i : i + 3])}')" for i in range(len(w) - 2)]
    return f"""
WITH t(template, label, base, n, tpos, gram) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
g AS (SELECT doc_id, i - 1 pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] gram FROM (SELECT *, unnest(range(1, len(w) - 1)) i FROM d)),
v AS (SELECT doc_id, template, label, base, n, pos - tpos diagonal, list(DISTINCT tpos) hits, count(DISTINCT tpos) votes FROM g JOIN t USING (gram) GROUP BY doc_id, template, label, base, n, pos - tpos),
a AS (SELECT *, votes = n - 2 AS exact, coalesce(base OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {scan.SLACK}, true)::INT apart FROM v),
m AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) grp FROM a),
c AS (SELECT doc_id, label, base, n, template, grp, bool_or(exact) exact, flatten(list(hits)) hits, min(diagonal + list_min(hits)) f, max(diagonal + list_max(hits) + 2) l FROM m GROUP BY doc_id, label, base, n, template, grp),
s AS (SELECT *, len(list_distinct(flatten(list_transform(hits, lambda x: [x, x + 1, x + 2])))) / n coverage FROM c),
k AS (SELECT * FROM s WHERE CASE WHEN base THEN exact ELSE coverage >= {scan.COVER} AND l - f + 1 <= {scan.LONGEST} * n END)
SELECT d.doc_id, any_value(len(d.w))::BIGINT n_words, count(*) FILTER (WHERE base) n_base, (min(f) FILTER (WHERE base))::BIGINT first_word, (max(f) FILTER (WHERE base))::BIGINT last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') labels, coalesce(max(coverage), 0)::DOUBLE score
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""


ORACLE_SQL = {"op2_license_scan": licenses(), "op3_topk": TOPK, "op5_line_dedup": LINES, "op7_chat_formatting": CHAT}
