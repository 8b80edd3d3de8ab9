"""DuckDB SQL of the queries that SQL can express.

The others are tested without it: a tokenizer's ids (op5) against the library; the counts of op3, and its learned list by held-out accuracy; the law
of op6 and where groups lie; op7 against the given pages' articles; the patterns of op10, and its token spans on planted strings.
"""

from __future__ import annotations

BREAKS = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Nodes of ``links(x, y)``, both ways, with the smallest that they reach.
_REACHED = """reach AS (SELECT x AS id, least(x, y) AS c FROM links UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.id), lowest AS (SELECT id, min(c) AS c FROM reach GROUP BY id)"""

OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9), {_REACHED},
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM v LEFT JOIN degree ON x = vec_id LEFT JOIN lowest ON id = vec_id"""

_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP2 = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i {_BEFORE}), 0) AS whole FROM l),
x AS (SELECT doc_id, whole, unnest(regexp_extract_all(line, '[^.!?]*[.!?]+|[^.!?]+')) AS u, generate_subscripts(regexp_extract_all(line, '[^.!?]*[.!?]+|[^.!?]+'), 1) AS j FROM p),
z AS (SELECT doc_id, whole, j, u, whole + coalesce(sum(length(u)) OVER (PARTITION BY doc_id, whole ORDER BY j {_BEFORE}), 0) AS s FROM x),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY whole, j) - 1 AS pos, count(*) OVER (PARTITION BY doc_id, whole) AS n FROM z WHERE trim(u, {_WHITE}) <> ''),
a AS (SELECT doc_id, whole, line AS u, whole AS s, FALSE AS part, pos, pos + n AS "to" FROM p JOIN (SELECT doc_id, whole, min(pos) AS pos, any_value(n) AS n FROM y GROUP BY ALL) USING (doc_id, whole)
  UNION ALL SELECT doc_id, whole, u, s, TRUE, pos, pos + 1 FROM y WHERE n > 1),
k AS (SELECT doc_id, whole, part, pos, "to", CAST(s + length(u) - length(ltrim(u, {_WHITE})) AS INTEGER) AS s, length(trim(u, {_WHITE})) AS n, list_filter(string_split_regex(lower(u), '{BREAKS}'), lambda w: w <> '') AS w FROM a),
f AS (SELECT *, first_value(doc_id) OVER o AS first_doc_id, first_value(s) OVER o AS first_start FROM k WINDOW o AS (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, s)),
r AS (SELECT * FROM f WHERE (doc_id, s) <> (first_doc_id, first_start)),
q AS (SELECT * FROM r WHERE NOT part OR (doc_id, whole) NOT IN (SELECT (doc_id, whole) FROM r WHERE NOT part)),
g AS (SELECT *, coalesce(CAST(lag("to") OVER (PARTITION BY doc_id ORDER BY pos) <> pos AS INTEGER), 1) AS fresh FROM q),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g),
t AS (SELECT *, sum(len(w)) OVER (PARTITION BY doc_id, run) AS words FROM h)
SELECT doc_id, s AS "start", CAST(s + n AS INTEGER) AS "end", first_doc_id, first_start FROM t WHERE words >= 20"""

OP4 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS copy FROM documents),
k AS (SELECT doc_id, source, md5(t) AS print, copy, len(list_filter(string_split_regex(t, '{BREAKS}'), lambda w: w <> '')) AS size,
  -ln((CAST('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t) || ':' || copy), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
  / greatest(0.1::DOUBLE, CASE WHEN t = '' THEN 1.0::DOUBLE ELSE CAST(length(regexp_replace(t, '[0-9#*$%&|<>]+', '', 'g')) AS DOUBLE) / length(t) END) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight) AS target FROM l),
g AS (SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
  sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, print, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE AS middle FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CAST(middle <= target - epochs * source_size AS INTEGER)) AS BIGINT) AS taken FROM g"""

OP8 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{BREAKS}'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
f AS (SELECT doc_id, unnest(s) AS s FROM h), n AS (SELECT doc_id, len(s) AS n FROM h),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM f a JOIN f b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)), {_REACHED}
SELECT doc_id, n AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM n LEFT JOIN lowest ON id = doc_id"""

_CONTROLS = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"
_ESCAPED = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '" + _CONTROLS + "'))"

OP9 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n, string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x) AS whole, coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '') AS loss,
  sum(8 + {_ESCAPED.format('r')} + length(r) - length(replace(r, chr(10), '')) + {_ESCAPED.format('x')}) AS f FROM t GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM g"""

OP13 = """WITH v AS (SELECT vec_id, rowid AS place, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS x FROM (SELECT *, row_number() OVER () AS rowid FROM embeddings)
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.place, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.place <> c.place WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_vectors": OP1, "op2_repeated_lines": OP2, "op4_mix": OP4, "op8_near_documents": OP8, "op9_chat": OP9, "op13_top_k": OP13}
