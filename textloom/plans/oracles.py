"""DuckDB SQL for the queries."""

from __future__ import annotations

from textloom.functions.facts import BULLET, INSTRUCTION_PREFIXES, LEAD_INS, MOST_FACTS, REPORTING
from textloom.functions.text import STOP_WORDS
from textloom.operators.chunking import CHUNK_BYTES, OVERLAP_BYTES
from textloom.plans.queries import AROUND, CONTEXT, FALLBACK, FIRST, LAST, LITERAL, ONE_PATH, OVERLAP, PATTERN, QUERIES_OF, TOKENS_REQUEST

quoted = lambda words: ", ".join("'" + w + "'" for w in words)
LINES = """
arrays AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL AND text <> ''),
cut AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM arrays),
raw_lines AS (SELECT doc_id, unnest(a) AS text, unnest(range(1, len(a) + 1)) AS line_no FROM cut),
lines AS (SELECT doc_id, line_no, rtrim(text, chr(13)) AS content FROM raw_lines)
"""
TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2)"
literal = f"contains(lower(content), '{LITERAL}')"


def overlap(query: str, guard: str = "TRUE") -> str:
    words = list(dict.fromkeys(query.split()))
    n = " + ".join(f"CAST(contains(lower(content), '{w}') AS BIGINT)" for w in words)
    return f"SELECT doc_id, line_no, content, round(n / {len(words)}.0::DOUBLE * 1000) / 1000 AS score, 'token_overlap:' || n || '/{len(words)}' AS reason FROM (SELECT *, {n} AS n FROM lines) WHERE n > 0 AND {guard}"


FOUND = f"SELECT doc_id, line_no, content, 1.0::DOUBLE AS score, 'literal_match' AS reason FROM lines WHERE {literal}"
COSINE = """
pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, q.embedding AS a, e.embedding AS b
          FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % %(of)s = 0) q),
parts AS (SELECT query_id, chunk_id,
          list_sum(list_transform(list_zip(a, b), lambda z: CAST(z[1] * z[2] AS DOUBLE))) AS dot,
          sqrt(list_sum(list_transform(a, lambda x: CAST(x * x AS DOUBLE)))) * sqrt(list_sum(list_transform(b, lambda x: CAST(x * x AS DOUBLE)))) AS n FROM pairs),
sims AS (SELECT query_id, chunk_id, CASE WHEN n > 0 THEN dot / n ELSE 0.0 END AS similarity FROM parts)
""".replace("% %(of)s", f"% {QUERIES_OF}")
HITS = COSINE + f"""
, placed AS (SELECT s.*, d.source AS path, d.text FROM sims s JOIN documents d ON d.doc_id = s.chunk_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, path, chunk_id) AS r FROM placed) WHERE r <= 8),
asked AS (SELECT best.*, b.text AS question, query_id // {QUERIES_OF} // 5 AS prompt_id, (query_id // {QUERIES_OF}) % 5 AS query_ord, chunk_id % 3 + 1 AS start_line
          FROM best JOIN benchmark b ON b.item_id = (query_id // {QUERIES_OF}) % (SELECT count(*) FROM benchmark)),
worded AS (SELECT *, list_distinct({TOKENS.format('question')}) AS wanted FROM asked),
lapped AS (SELECT *, CASE WHEN len(wanted) > 0 THEN len(list_filter(wanted, lambda t: contains(lower(text), t))) / len(wanted)::DOUBLE ELSE 0.0 END AS overlap FROM worded),
scored AS (SELECT *, similarity + 0.25::DOUBLE * overlap + CASE WHEN trim(question) <> '' AND contains(lower(text), lower(trim(question))) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
          + CASE WHEN start_line = 1 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS score FROM lapped),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, chunk_id) - 1 AS rank FROM scored)
"""
#: One request a question, with a path or without one; the eight most similar chunks, reranked, then paged.
PAGES = """WITH e AS (SELECT vec_id, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x * x AS DOUBLE)))) AS n FROM embeddings),
chunks AS (SELECT d.source AS path, vec_id AS chunk_id, d.text, v, n FROM e JOIN documents d ON d.doc_id = vec_id),
requests AS ({requests}),
asked AS (SELECT query_id, r.v, r.n, nullif(trim(r.path), '') AS path, CASE WHEN r.lim <= 0 THEN 5 ELSE least(r.lim, 20) END AS lim, greatest(r.off, 0) AS off, trim(b.text) AS question
  FROM requests r JOIN benchmark b ON b.item_id = (query_id // {of}) % (SELECT count(*) FROM benchmark)),
sims AS (SELECT a.query_id, c.path, c.chunk_id, c.text, a.question, CASE WHEN a.n > 0 AND c.n > 0 THEN list_sum(list_transform(list_zip(a.v, c.v), lambda z: CAST(z[1] * z[2] AS DOUBLE))) / (a.n * c.n) ELSE 0.0 END AS similarity
  FROM asked a JOIN chunks c ON a.path IS NULL OR a.path = c.path),
best AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, path, chunk_id) <= 8),
worded AS (SELECT *, list_distinct({tokens}) AS wanted FROM best),
lapped AS (SELECT *, CASE WHEN len(wanted) > 0 THEN len(list_filter(wanted, lambda t: contains(lower(text), t))) / len(wanted)::DOUBLE ELSE 0.0 END AS overlap FROM worded),
scored AS (SELECT *, similarity + 0.25::DOUBLE * overlap + CASE WHEN contains(lower(text), lower(question)) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN chunk_id % 3 = 0 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS score FROM lapped),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, chunk_id) - 1 AS r, count(*) OVER (PARTITION BY query_id) AS total FROM scored),
sized AS (SELECT a.query_id, a.path, a.lim, coalesce(t.total, 0) AS total, least(a.off, coalesce(t.total, 0)) AS off FROM asked a LEFT JOIN (SELECT DISTINCT query_id, total FROM ranked) t USING (query_id))
SELECT s.query_id, coalesce(s.path, '') AS path, s.lim AS "limit", s.off AS "offset", least(s.off + s.lim, s.total) - s.off AS match_count, s.total AS total_matches, s.off + s.lim < s.total AS has_more,
  CASE WHEN s.off + s.lim < s.total THEN s.off + s.lim ELSE 0 END AS next_offset, coalesce(r.r - s.off, -1) AS place, coalesce(r.chunk_id, -1) AS chunk_id, coalesce(r.path, '') AS chunk_path, coalesce(r.similarity, 0.0::DOUBLE) AS similarity,
  coalesce(r.overlap, 0.0::DOUBLE) AS overlap, coalesce(round(r.score, 9), 0.0::DOUBLE) AS score
FROM sized s LEFT JOIN ranked r ON r.query_id = s.query_id AND r.r >= s.off AND r.r < s.off + s.lim"""
pages = lambda requests: PAGES.format(requests=requests, of=QUERIES_OF, tokens=TOKENS.format("question"))
FUSED = HITS + """
, merged AS (SELECT prompt_id, path, chunk_id, list_sum(list(1.0::DOUBLE / (60 + rank + 1) ORDER BY query_ord)) AS score, max(similarity) AS similarity, max(overlap) AS overlap,
             min(start_line) AS start_line, max(start_line + 5) AS end_line FROM hits GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, similarity DESC, overlap DESC, path, chunk_id) - 1 AS rank FROM merged) WHERE rank < 8)
"""
RANGES = LINES + f"""
, found AS (SELECT 'retrieved' AS kind, CAST(doc_id AS VARCHAR) AS path, line_no - 2 AS s, line_no + 2 AS e FROM lines WHERE {literal}
  UNION ALL SELECT 'verified', CAST(doc_id AS VARCHAR), line_no, line_no + 1 FROM lines WHERE regexp_matches(content, '{PATTERN}', 'i')),
clamped AS (SELECT DISTINCT kind, path, greatest(s, 1) AS s, greatest(e, greatest(s, 1)) AS e FROM found),
flagged AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY kind, path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM clamped),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY kind, path ORDER BY s, e) AS island FROM flagged),
merged AS (SELECT kind, path, min(s) AS start_line, max(e) AS end_line FROM islands GROUP BY kind, path, island)
"""
#: By points: what is left of each retrieved range falls into runs of neighbouring points.
LEFT = RANGES + """
, points AS (SELECT path, start_line AS s, unnest(range(start_line, end_line + 1)) AS p FROM merged WHERE kind = 'retrieved'),
gone AS (SELECT DISTINCT path, unnest(range(start_line, end_line + 1)) AS p FROM merged WHERE kind = 'verified'),
kept AS (SELECT *, p - row_number() OVER (PARTITION BY path, s ORDER BY p) AS run FROM points ANTI JOIN gone USING (path, p)),
left_over AS (SELECT path, min(p) AS start_line, max(p) AS end_line FROM kept GROUP BY path, s, run)
"""
#: Rank by rank: a hit is chosen by a rule over those chosen before it; verification goes through the ranks twice.
CHOSEN = """WITH RECURSIVE {fused}, f AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY prompt_id) AS n FROM fused),
walk AS (SELECT DISTINCT prompt_id, n, 0::BIGINT AS i, CAST([] AS BIGINT[]) AS chosen FROM f
  UNION ALL SELECT w.prompt_id, w.n, w.i + 1, CASE WHEN len(w.chosen) < 4 AND {rule} THEN list_append(w.chosen, f.rank) ELSE w.chosen END
  FROM walk w JOIN f ON f.prompt_id = w.prompt_id AND f.rank = w.i % w.n LEFT JOIN LATERAL (SELECT coalesce(bool_or({near}), false) AS near, coalesce(bool_or(c.path = f.path), false) AS same
    FROM f c WHERE c.prompt_id = w.prompt_id AND list_contains(w.chosen, c.rank)) ON true WHERE w.i < {rounds} * w.n),
done AS (SELECT * FROM walk WHERE i = {rounds} * n)
"""
SPREAD = CHOSEN.format(fused=FUSED, rounds=1, near="c.path = f.path AND abs(c.chunk_id - f.chunk_id) <= 1", rule="NOT (near AND w.n - w.i > 4 - len(w.chosen))")
APART = CHOSEN.format(fused=FUSED, rounds=2, near="c.path = f.path AND f.start_line <= c.end_line AND c.start_line <= f.end_line", rule="NOT near AND (w.i >= w.n OR NOT same)")
#: Chunk by chunk: where one starts decides where it ends and where the next one starts; longer lines are cut by characters.
BYTES = f"""WITH RECURSIVE {LINES},
sized AS (SELECT *, strlen(text) + CASE WHEN line_no < max(line_no) OVER (PARTITION BY doc_id) OR (SELECT ends_with(d.text, chr(10)) FROM documents d WHERE d.doc_id = raw_lines.doc_id) THEN 1 ELSE 0 END AS n FROM raw_lines),
summed AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS e FROM sized),
whole AS MATERIALIZED (SELECT doc_id, list(text ORDER BY line_no) AS a, list_prepend(0, list(e ORDER BY line_no)) AS e FROM summed GROUP BY doc_id),
walk AS (SELECT doc_id, 0::BIGINT AS s, 0::BIGINT AS b, 0::BIGINT AS t FROM whole
  UNION ALL SELECT doc_id, t, b2, CASE WHEN b2 = t THEN t + 1 WHEN b2 = last THEN last WHEN back > t THEN back ELSE b2 END
  FROM (SELECT *, len(list_filter(e, lambda x: x <= e[b2 + 1] - {OVERLAP_BYTES})) - 1 AS back FROM (SELECT w.doc_id, w.t, o.e, len(o.a) AS last, len(list_filter(o.e, lambda x: x <= o.e[w.t + 1] + {CHUNK_BYTES})) - 1 AS b2
  FROM walk w JOIN whole o USING (doc_id) WHERE w.t < len(o.a)))),
starts AS (SELECT doc_id, s, b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, b, t) AS k FROM walk) WHERE k > 1),
long AS (SELECT doc_id, s, a[s + 1] AS line, e[s + 1] AS off FROM starts JOIN whole USING (doc_id) WHERE b = s),
letters AS (SELECT doc_id, s, unnest(x) AS c, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, s, regexp_extract_all(line, '(?s).') AS x FROM long)),
marks AS MATERIALIZED (SELECT doc_id, s, list_prepend(0, list(n ORDER BY i)) AS n FROM (SELECT doc_id, s, i, sum(strlen(c)) OVER (PARTITION BY doc_id, s ORDER BY i)::BIGINT AS n FROM letters) GROUP BY ALL),
cuts AS (SELECT doc_id, s, -1::BIGINT AS p, 0::BIGINT AS q, 0::BIGINT AS t FROM marks
  UNION ALL SELECT doc_id, s, t, q2, CASE WHEN q2 = len(n) - 1 THEN q2 ELSE t + len(list_filter(n[t + 1:t + {CHUNK_BYTES} + 1], lambda x: x <= n[t + 1] + {CHUNK_BYTES - OVERLAP_BYTES})) - 1 END
  FROM (SELECT c.*, m.n, c.t + len(list_filter(m.n[c.t + 1:c.t + {CHUNK_BYTES} + 1], lambda x: x <= m.n[c.t + 1] + {CHUNK_BYTES})) - 1 AS q2 FROM cuts c JOIN marks m USING (doc_id, s) WHERE c.t < len(m.n) - 1)),
chunks AS (SELECT doc_id, s, 0 AS p, s + 1 AS start_line, b AS end_line, e[s + 1] AS byte_offset, array_to_string(a[s + 1:b], chr(10)) AS text FROM starts JOIN whole USING (doc_id) WHERE b > s
  UNION ALL SELECT doc_id, s, p, s + 1, s + 1, off + n[p + 1], substring(line, p + 1, q - p) FROM cuts JOIN marks USING (doc_id, s) JOIN long USING (doc_id, s) WHERE p >= 0)
"""
#: Three fifths of 1000 tokens without the 80 of the request, three characters each.
TOKEN_CHARS = 1560
PIECES = f"""WITH RECURSIVE {LINES},
bare AS (SELECT doc_id, line_no, CASE WHEN ends_with(text, chr(13)) THEN text[1:length(text) - 1] ELSE text END AS text FROM raw_lines),
summed AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS e FROM bare),
whole AS MATERIALIZED (SELECT doc_id, list(text ORDER BY line_no) AS a, list_prepend(0, list(e ORDER BY line_no)) AS e, list(line_no - 1 ORDER BY line_no) FILTER (text <> '') AS filled FROM summed GROUP BY doc_id),
walk AS (SELECT doc_id, 0::BIGINT AS s, 0::BIGINT AS b, 0::BIGINT AS t FROM whole
  UNION ALL SELECT doc_id, s2, b2, greatest(b2, s2 + 1) FROM (SELECT *, len(list_filter(e, lambda x: x <= e[s2 + 1] + {TOKEN_CHARS} + 1)) - 1 AS b2
  FROM (SELECT w.doc_id, o.e, list_min(list_filter(o.filled, lambda x: x >= w.t)) AS s2 FROM walk w JOIN whole o USING (doc_id)) WHERE s2 IS NOT NULL)),
starts AS (SELECT doc_id, s, b FROM walk WHERE t > 0),
chunks AS (SELECT doc_id, s, 0::BIGINT AS p, array_to_string(a[s + 1:b], chr(10)) AS text FROM starts JOIN whole USING (doc_id) WHERE b > s
  UNION ALL SELECT doc_id, s, p, substring(a[s + 1], p + 1, {TOKEN_CHARS}) FROM (SELECT *, unnest(range(0, length(a[s + 1]), {TOKEN_CHARS})) AS p FROM starts JOIN whole USING (doc_id) WHERE b = s))
"""
SPAN = "string_agg(CASE WHEN start_line = end_line THEN CAST(start_line AS VARCHAR) ELSE start_line || '-' || end_line END, ', ' ORDER BY start_line, end_line)"
starts = lambda c, words: "(" + " OR ".join(f"starts_with({c}, '{w}')" for w in words) + ")"
holds = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
WHITE = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

#: A text's lines as facts: (doc_id, i, fact), bullets off, instructions and blank lines out.
FACTS = f"""t AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM t),
b AS (SELECT doc_id, i, {WHITE.format("regexp_replace(" + WHITE.format("line") + ", '" + BULLET.replace("(?U)", "") + "', '')")} AS fact FROM u),
f AS (SELECT * FROM b WHERE fact <> '' AND NOT {starts("lower(fact)", INSTRUCTION_PREFIXES)})"""
FIRST_BYTES = ["text/plain; charset=utf-8", "text/plain; charset=utf-8", "image/gif", "audio/wave", "application/octet-stream", "text/html; charset=utf-8", "text/xml; charset=utf-8"]
SCRIPT = f"""{PIECES}, c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, p) - 1 AS chunk_id, text, string_split(text, chr(10))[1] AS first FROM chunks),
said AS (SELECT *, length(text) < 200 AS skip, {WHITE.format("first")} AS fact FROM c),
told AS (SELECT doc_id, chunk_id, CASE WHEN skip THEN '' WHEN fact = '' OR {starts("lower(fact)", INSTRUCTION_PREFIXES)} THEN '--' ELSE fact || chr(10) || '--' END AS facts, skip,
  CASE WHEN skip THEN 1 ELSE 3 END::BIGINT AS raw_lines, length(text) AS prompt_tokens, CASE WHEN skip THEN 1 ELSE 2 END::BIGINT AS completion_tokens FROM said)"""

ORACLES: dict[str, str] = {
    "lines_with_offsets": f"WITH {LINES} SELECT doc_id, line_no, text, CAST(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - strlen(text) - 1 AS BIGINT) AS byte_start, strlen(text) AS byte_len FROM raw_lines",
    "search_literal": f"WITH {LINES} {FOUND}",
    "search_literal_page": f"WITH {LINES}, m AS ({FOUND}) SELECT *, (SELECT count(*) FROM m) AS total_matches, (SELECT count(*) FROM m) > 15 AS has_more, CASE WHEN (SELECT count(*) FROM m) > 15 THEN 15 ELSE 0 END::BIGINT AS next_offset FROM m ORDER BY score DESC, doc_id, line_no LIMIT 10 OFFSET 5",
    "search_overlap_page": f"""WITH {LINES}, m AS (SELECT doc_id, line_no, content, 1.0::DOUBLE AS score, 'literal_match' AS reason FROM lines WHERE contains(lower(content), '{FALLBACK}')
        UNION ALL {overlap(FALLBACK, f"NOT EXISTS (SELECT 1 FROM lines WHERE contains(lower(content), '{FALLBACK}'))")}), p AS (SELECT * FROM m ORDER BY score DESC, doc_id, line_no LIMIT 10 OFFSET 10)
        SELECT p.*, (SELECT count(*) FROM m) AS total_matches, (SELECT count(*) FROM m) > 20 AS has_more, CASE WHEN (SELECT count(*) FROM m) > 20 THEN 20 ELSE 0 END::BIGINT AS next_offset,
        coalesce(b.content, '') AS context_before, coalesce(a.content, '') AS context_after FROM p LEFT JOIN lines b ON b.doc_id = p.doc_id AND b.line_no = p.line_no - 1 LEFT JOIN lines a ON a.doc_id = p.doc_id AND a.line_no = p.line_no + 1""",
    "search_one_path": f"""WITH {LINES}, m AS (SELECT * FROM lines WHERE doc_id = (SELECT min(doc_id) FROM documents) AND regexp_matches(content, '{ONE_PATH}')), n AS (SELECT count(*) AS n FROM m)
        SELECT doc_id, line_no, content, 1.0::DOUBLE AS score, 'regex_match' AS reason, n AS total_matches, n > 20 AS has_more, CASE WHEN n > 20 THEN 20 ELSE 0 END::BIGINT AS next_offset FROM m, n ORDER BY line_no LIMIT 20""",
    "search_totals": f"WITH {LINES} SELECT count(*) AS total_matches, false AS has_more, 0::BIGINT AS next_offset FROM lines WHERE {literal}",
    "search_regex": f"WITH {LINES} SELECT doc_id, line_no, content, 1.0::DOUBLE AS score, 'regex_match' AS reason FROM lines WHERE regexp_matches(content, '{PATTERN}', 'i')",
    "search_token_overlap": f"WITH {LINES} {overlap(OVERLAP)}",
    "search_auto_hit": f"WITH {LINES} {FOUND} UNION ALL {overlap(LITERAL, f'NOT EXISTS (SELECT 1 FROM lines WHERE {literal})')}",
    "search_auto_fallback": f"WITH {LINES} SELECT doc_id, line_no, content, 1.0::DOUBLE AS score, 'literal_match' AS reason FROM lines WHERE contains(lower(content), '{FALLBACK}') UNION ALL {overlap(FALLBACK, f"NOT EXISTS (SELECT 1 FROM lines WHERE contains(lower(content), '{FALLBACK}'))")}",
    "search_context_lines": f"""WITH {LINES} SELECT m.doc_id, m.line_no, any_value(m.content) AS content,
        coalesce(string_agg(n.content, chr(10) ORDER BY n.line_no) FILTER (n.line_no < m.line_no), '') AS context_before,
        coalesce(string_agg(n.content, chr(10) ORDER BY n.line_no) FILTER (n.line_no > m.line_no), '') AS context_after
        FROM lines m JOIN lines n ON m.doc_id = n.doc_id AND n.line_no BETWEEN m.line_no - {CONTEXT} AND m.line_no + {CONTEXT} WHERE {literal.replace('content', 'm.content')} GROUP BY m.doc_id, m.line_no""",
    "read_lines": f"WITH {LINES} SELECT * FROM lines WHERE line_no BETWEEN {FIRST} AND {LAST}",
    "read_around": f"WITH {LINES} SELECT * FROM lines WHERE line_no BETWEEN {AROUND} - 3 AND {AROUND} + 1",
    "list_documents_page": "SELECT doc_id, count(*) OVER () AS total_matches, count(*) OVER () > 70 AS has_more, CASE WHEN count(*) OVER () > 70 THEN 70 ELSE 0 END::BIGINT AS next_offset FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20",
    "tokenize_distinct": f"WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS token, unnest(range(len(a))) AS i FROM t), f AS (SELECT doc_id, token, min(i) AS i FROM u GROUP BY ALL) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, token FROM f",
    "approx_tokens": "SELECT doc_id, (length(text) + 2) // 3 AS tokens, strlen(text) AS bytes FROM documents",
    "seed_queries": f"""WITH t AS (SELECT item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS p, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS a FROM benchmark),
        u AS (SELECT item_id, unnest(a) AS token, unnest(range(len(a))) AS i FROM t), f AS (SELECT item_id, token, min(i) AS i FROM u WHERE length(token) >= 2 AND token NOT IN ({quoted(STOP_WORDS)}) GROUP BY ALL),
        g AS (SELECT item_id, string_agg(token, ' ' ORDER BY i) AS c, array_to_string(list(token ORDER BY i)[1:8], ' ') AS c8, array_to_string(list(token ORDER BY length(token) DESC, token)[1:5], ' ') AS l5 FROM f GROUP BY item_id),
        q AS (SELECT item_id, unnest([p, array_to_string(a, ' '), coalesce(c, ''), coalesce(c8, ''), coalesce(l5, '')]) AS query, unnest(range(5)) AS i FROM t LEFT JOIN g USING (item_id)),
        d AS (SELECT item_id, query, min(i) AS i FROM q WHERE query <> '' GROUP BY ALL) SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS query_ord, query FROM d""",
    "overlap_ratio": f"WITH q AS (SELECT item_id, list_distinct({TOKENS.format('text')}) AS w FROM benchmark WHERE item_id % {QUERIES_OF} = 0) SELECT * FROM (SELECT item_id, doc_id, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda t: contains(lower(text), t))) / len(w)::DOUBLE ELSE 0.0 END AS overlap FROM q, documents) WHERE overlap > 0",
    "cosine_topk": f"WITH {COSINE} SELECT query_id, chunk_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) - 1 AS rank FROM sims) WHERE rank < 8",
    "heuristic_rerank": f"WITH {HITS} SELECT query_id, path, chunk_id, similarity, overlap, round(score, 9) AS score, rank FROM hits",
    "semantic_search_pages": pages(f"""SELECT vec_id AS query_id, v, n, CASE WHEN vec_id // {QUERIES_OF} % 2 = 1 THEN d.source END AS path, vec_id // {QUERIES_OF} % 4 AS lim,
        CASE WHEN vec_id // {QUERIES_OF} % 5 = 4 THEN 50 ELSE (vec_id // {QUERIES_OF}) % 3 * 2 - 1 END AS off FROM e LEFT JOIN documents d ON d.doc_id = vec_id WHERE vec_id % {QUERIES_OF} = 0"""),
    "semantic_search_path": pages(f"SELECT vec_id AS query_id, v, n, (SELECT min(path) FROM chunks) AS path, 6 AS lim, 1 AS off FROM e WHERE vec_id % {QUERIES_OF} = 0"),
    "rrf_fusion": f"WITH {FUSED} SELECT prompt_id, path, chunk_id, round(score, 12) AS score, similarity, overlap, start_line, end_line, rank FROM fused",
    "weak_gate": f"WITH {FUSED} SELECT prompt_id, similarity < 0.18 AND overlap < 0.1 AS weak FROM fused WHERE rank = 0 UNION ALL SELECT -1, true",
    "select_evidence": f"""{SPREAD}, picks AS (SELECT f.*, CASE WHEN list_contains(chosen, rank) THEN list_position(chosen, rank) - 1 ELSE len(chosen) + rank - len(list_filter(chosen, lambda c: c < rank)) END AS pick FROM f JOIN done USING (prompt_id))
        SELECT prompt_id, path, chunk_id, pick::BIGINT AS pick FROM picks WHERE pick < 4""",
    "verification_reads": f"""{APART}, picks AS (SELECT f.*, list_position(chosen, rank) - 1 AS pick, end_line - start_line + 1 AS size FROM f JOIN done USING (prompt_id) WHERE list_contains(chosen, rank))
        SELECT prompt_id, path, chunk_id, pick::BIGINT AS pick, CASE WHEN size <= 40 THEN 'read_lines' ELSE 'read_around' END AS tool,
        CASE WHEN size <= 40 THEN start_line ELSE greatest(1, start_line + size // 2 - 20) END AS read_start, CASE WHEN size <= 40 THEN end_line ELSE start_line + size // 2 + 20 END AS read_end FROM picks""",
    "chunk_bytes": f"{BYTES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, p, end_line DESC) - 1 AS chunk_id, start_line, end_line, byte_offset, sha256(text) AS text_sha256 FROM chunks",
    "chunk_tokens": f"""{PIECES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, p) - 1 AS chunk_id, (length(text) + 2) // 3 AS token_count, strlen(text) AS byte_count,
        {TOKENS_REQUEST} + (length(text) + 2) // 3 AS request_tokens, sha256(text) AS text_sha256 FROM chunks""",
    "merge_ranges": f"WITH {RANGES} SELECT * FROM merged",
    "subtract_ranges": f"WITH {LEFT} SELECT * FROM left_over",
    "evidence_sources": f"WITH {LEFT} SELECT 'verified' AS kind, path, {SPAN} AS lines FROM merged WHERE kind = 'verified' GROUP BY path UNION ALL SELECT 'retrieved', path, {SPAN} FROM left_over GROUP BY path",
    "instruction_lines": f"""WITH t AS (SELECT conv_id, turn, string_split(role || ': ' || text || chr(10) || text, chr(10)) AS a FROM conversations),
        c AS (SELECT conv_id, turn, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM t),
        u AS (SELECT conv_id, turn, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM c) SELECT * FROM u WHERE NOT {starts("lower(" + WHITE.format("line") + ")", INSTRUCTION_PREFIXES)}""",
    "fact_ranking": f"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM t),
        b AS (SELECT doc_id, i, {WHITE.format("regexp_replace(" + WHITE.format("line") + ", '" + BULLET.replace("(?U)", "") + "', '')")} AS fact FROM u),
        f AS (SELECT * FROM b WHERE fact <> '' AND NOT {starts("lower(fact)", INSTRUCTION_PREFIXES)}),
        d AS (SELECT doc_id, arg_min(fact, i) AS fact, min(i) AS i FROM f GROUP BY doc_id, lower(fact)),
        p AS (SELECT *, CASE WHEN {starts("lower(fact)", LEAD_INS)} THEN 100 ELSE 0 END + CASE WHEN {holds("lower(fact)", REPORTING)} THEN 25 ELSE 0 END AS penalty, count(*) OVER (PARTITION BY doc_id) AS n FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n > {MOST_FACTS} THEN penalty ELSE i END, CASE WHEN n > {MOST_FACTS} THEN length(fact) ELSE 0 END, fact) AS r FROM p)
        SELECT doc_id, CAST(r - 1 AS INTEGER) AS pos, fact FROM r WHERE r <= {MOST_FACTS}""",
    "conversation_context": f"""WITH q AS (SELECT conv_id, turn, {WHITE.format("text")} AS question FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, question, coalesce((SELECT string_agg(p.question, chr(10) || '- ' ORDER BY p.turn) FROM q p WHERE p.conv_id = q.conv_id AND p.turn < q.turn AND p.question <> ''), '') AS history FROM q""",
    "tool_search_sql": f"""WITH {LINES} SELECT m.doc_id, m.line_no, any_value(m.content) AS content, 1.0::DOUBLE AS score, 'literal_match' AS reason,
        coalesce(string_agg(n.content, chr(10) ORDER BY n.line_no) FILTER (n.line_no < m.line_no), '') AS context_before,
        coalesce(string_agg(n.content, chr(10) ORDER BY n.line_no) FILTER (n.line_no > m.line_no), '') AS context_after
        FROM lines m JOIN lines n ON m.doc_id = n.doc_id AND n.line_no BETWEEN m.line_no - {CONTEXT} AND m.line_no + {CONTEXT} WHERE {literal.replace('content', 'm.content')} GROUP BY m.doc_id, m.line_no""",
    "tool_ranges_sql": f"""WITH {LINES}, m AS (SELECT doc_id, line_no, CASE WHEN line_no - {CONTEXT} > coalesce(lag(line_no) OVER w + {CONTEXT}, -1000000) THEN 1 ELSE 0 END AS fresh FROM lines WHERE {literal} WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM m)
        SELECT doc_id, greatest(1, min(line_no) - {CONTEXT}) AS start_line, max(line_no) + {CONTEXT} AS end_line, count(*) AS n_matches FROM i GROUP BY doc_id, island""",
    "session_novelty": """WITH r AS (SELECT conv_id AS session, turn, CASE WHEN turn % 2 = 0 THEN 'files' ELSE 'rag' END AS namespace, turn % 5 = 3 AS synthetic, role AS path, length(text) % 40 + 1 AS a, length(text) % 40 + length(text) % 23 AS b FROM conversations
          UNION ALL SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'files' ELSE 'rag' END, turn % 5 = 3, 'all', turn * 5, turn * 5 + 9 FROM conversations),
        k AS (SELECT DISTINCT session, turn, namespace, synthetic, path, unnest(range(a, b + 1)) AS line FROM r),
        f AS (SELECT session, turn, count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.session = k.session AND o.namespace = k.namespace AND o.path = k.path AND o.line = k.line AND o.turn < k.turn AND NOT o.synthetic) GROUP BY ALL)
        SELECT DISTINCT r.session, r.turn, coalesce(f.n, 0)::BIGINT AS novel_lines, coalesce(f.n, 0) = 0 AS already_seen FROM r LEFT JOIN f USING (session, turn)""",
    "tool_calls_in_text": f"""WITH t AS (SELECT conv_id, turn, text, regexp_replace(text, '\\s+', ' ', 'g')[1:30] AS head, turn % 5 = 4 AS broken FROM conversations)
        SELECT conv_id, turn, {WHITE.format("regexp_replace(text || '  tail', '\\s+', ' ', 'g')")} AS text, true AS detected, CASE WHEN broken THEN 'a call without a function' END AS error,
        CASE WHEN NOT broken THEN 'text-tool-call-' || turn || '-1' END AS call_id, CASE WHEN NOT broken THEN ['search_file', 'read_around', 'list_files'][turn % 3 + 1] END AS name,
        CASE WHEN NOT broken THEN '{{"deep":true,"line":' || (turn + 1) || CASE WHEN trim(head) <> '' THEN ',"query":' || CAST(to_json({WHITE.format("head")}) AS VARCHAR) ELSE '' END || '}}' END AS arguments FROM t""",
    "corpus_hash": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text FROM documents),
        l AS (SELECT path, sha256(strlen(path) || ':' || path || strlen(text) || ':' || text) AS digest FROM d),
        p AS (SELECT digest, row_number() OVER (ORDER BY path, digest) - 1 AS place FROM l),
        one AS (SELECT place // 4096 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM p GROUP BY place // 4096),
        two AS (SELECT CASE WHEN count(*) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest FROM one)
        SELECT sha256('5:texts|1:1|' || digest) AS content_hash FROM two""",
    "text_forms": f"""WITH {FACTS},
        g AS (SELECT doc_id, array_to_string(list(fact ORDER BY i)[1:3], chr(10)) AS three, coalesce(array_to_string(list(fact ORDER BY i) FILTER (fact <> '---'), chr(10)), '') AS merged FROM f GROUP BY doc_id),
        l AS (SELECT doc_id, i, {WHITE.format("line")} AS line FROM u), k AS (SELECT * FROM l WHERE NOT {starts("lower(line)", INSTRUCTION_PREFIXES)}),
        n AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k), m AS (SELECT doc_id, {WHITE.format("string_agg(line, chr(10) ORDER BY i)")} AS text FROM n WHERE line <> '' OR coalesce(before, '') <> '' GROUP BY doc_id)
        SELECT d.doc_id, sha256('=== file: ' || d.doc_id || ' ===' || chr(10) || d.text || CASE WHEN d.text = '' OR ends_with(d.text, chr(10)) THEN '' ELSE chr(10) END) AS part_sha256,
        sha256(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))) AS input_sha256, sha256(coalesce(m.text, '')) AS sanitized_sha256,
        sha256(CASE WHEN {WHITE.format("d.text")} = '' THEN '' WHEN upper({WHITE.format("d.text")}) = 'SKIP' THEN 'SKIP' ELSE coalesce(g.three, '') END) AS first_facts_sha256, sha256(coalesce(g.merged, '')) AS merged_facts_sha256,
        CASE WHEN d.doc_id % 7 IN (0, 1) AND regexp_matches(d.text[1:512], '[\\x00-\\x08\\x0B\\x0E-\\x1A\\x1C-\\x1F]') THEN 'other' ELSE {FIRST_BYTES}[d.doc_id % 7 + 1] END AS kind
        FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "file_names": """SELECT doc_id, path || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS path FROM (SELECT doc_id, coalesce(source, 'none') AS path, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) AS k FROM documents)""",
    "rerank_off": f"WITH {HITS} SELECT query_id, path, chunk_id, similarity, overlap, similarity AS score, r - 1 AS rank FROM scored",
    "evidence_kinds": f"""WITH {FUSED}, {LINES},
        top AS (SELECT prompt_id, chunk_id AS doc_id FROM fused WHERE rank = 0),
        found AS (SELECT prompt_id, 'retrieved' AS kind, path, start_line AS s, end_line AS e FROM fused
          UNION ALL SELECT prompt_id, 'verified', path, start_line, end_line FROM fused WHERE rank = 0
          UNION ALL SELECT prompt_id, 'verified', CAST(doc_id AS VARCHAR), line_no, line_no FROM top JOIN lines USING (doc_id) WHERE regexp_matches(content, '{PATTERN}', 'i')
          UNION ALL SELECT prompt_id, 'retrieved', CAST(doc_id AS VARCHAR), 1, len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) FROM top JOIN documents USING (doc_id) WHERE text <> ''),
        clamped AS (SELECT DISTINCT prompt_id, kind, trim(path) AS path, greatest(s, 1) AS s, greatest(e, greatest(s, 1)) AS e FROM found WHERE trim(path) <> ''),
        flagged AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY prompt_id, kind, path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM clamped),
        islands AS (SELECT *, sum(fresh) OVER (PARTITION BY prompt_id, kind, path ORDER BY s, e) AS island FROM flagged),
        ranges AS (SELECT prompt_id, kind, path, min(s) AS start_line, max(e) AS end_line FROM islands GROUP BY prompt_id, kind, path, island),
        points AS (SELECT prompt_id, path, start_line AS s, unnest(range(start_line, end_line + 1)) AS p FROM ranges WHERE kind = 'retrieved'),
        gone AS (SELECT DISTINCT prompt_id, path, unnest(range(start_line, end_line + 1)) AS p FROM ranges WHERE kind = 'verified'),
        kept AS (SELECT *, p - row_number() OVER (PARTITION BY prompt_id, path, s ORDER BY p) AS run FROM points ANTI JOIN gone USING (prompt_id, path, p)),
        rest AS (SELECT prompt_id, path, min(p) AS start_line, max(p) AS end_line FROM kept GROUP BY prompt_id, path, s, run),
        entries AS (SELECT prompt_id, 1 AS o, 'Verified' AS name, path, {SPAN} AS lines FROM ranges WHERE kind = 'verified' GROUP BY prompt_id, path UNION ALL SELECT prompt_id, 2, 'Retrieved', path, {SPAN} FROM rest GROUP BY prompt_id, path),
        blocks AS (SELECT prompt_id, o, name || ':' || chr(10) || chr(10) || string_agg('- ' || path || ':' || chr(10) || '  ' || lines, chr(10) ORDER BY path) AS block FROM entries GROUP BY prompt_id, o, name)
        SELECT prompt_id, string_agg(block, chr(10) || chr(10) ORDER BY o) AS sources FROM blocks GROUP BY prompt_id""",
    "novel_matches": f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE regexp_matches(content, '{PATTERN}', 'i') AND NOT {literal}",
    "scripted_map": f"{SCRIPT} SELECT doc_id, chunk_id, sha256(facts) AS facts_sha256, false AS failed, 1::BIGINT AS calls, raw_lines, prompt_tokens, completion_tokens FROM told",
    "scripted_counters": f"""{SCRIPT} SELECT count(*) AS chunks, count(*) AS calls, count(*) FILTER (facts <> '') AS successes, count(*) FILTER (facts = '') AS skips, 0::BIGINT AS errors, sum(raw_lines)::BIGINT AS fact_lines_raw,
        sum(CASE WHEN facts = '' THEN 0 ELSE len(string_split(facts, chr(10))) END)::BIGINT AS fact_lines_kept, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM told""",
}
