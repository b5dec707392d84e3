"""DuckDB SQL for the operators that SQL expresses, in plain forms: all pairs by shared shingles, all seats one by one."""

from __future__ import annotations

import string

from textloom.llm import mixing, periodic_runs, quality_rules
from textloom.llm.jaccard import PERCENT, SHINGLE

WHITE = r"[\x20\x09-\x0D]+"
words = lambda text: f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{WHITE}'), lambda x: x <> '')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} AS a FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(a[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""

#: CRC-32 byte by byte: its table, and the checksum of a string in UTF-8.
CRC_TABLE = "SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)"
octets = lambda s: f"list_transform(range(1, strlen({s}) + 1), lambda k: CAST('0x' || substr(hex(encode({s})), 2 * k - 1, 2) AS BIGINT))"
checksum = lambda s, t: f"xor(list_reduce({octets(s)}, lambda c, b: xor(c >> 8, {t}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"

RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {words("text")} AS a FROM documents),
u AS (SELECT doc_id, unnest(a) AS w, unnest(range(len(a))) AS i FROM d),
e AS (SELECT doc_id, i, 0 AS o, w AS gram FROM u UNION ALL SELECT doc_id, i, 1, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), '') || ' ' || w FROM u),
crc AS ({CRC_TABLE}),
h AS (SELECT gram, {checksum("gram", "t")} % {quality_rules.N_BUCKETS} AS b FROM (SELECT DISTINCT gram FROM e), crc),
g AS (SELECT doc_id, i, o, b FROM e JOIN h USING (gram)),
q AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
k AS (SELECT b, count(*) AS raw, count(q.doc_id) AS good FROM g LEFT JOIN q USING (doc_id) GROUP BY b),
z AS (SELECT sum(raw) AS all_raw, sum(good) AS all_good FROM k),
v AS (SELECT b, CAST(ln((good + {quality_rules.SHRINK}::DOUBLE) / (raw * all_good::DOUBLE / all_raw + {quality_rules.SHRINK}::DOUBLE)) AS FLOAT) AS weight FROM k, z),
s AS (SELECT doc_id, list_sum(list(CAST(weight AS DOUBLE) ORDER BY o, i)) / count(*) AS score FROM g JOIN v USING (b) GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(a[i:i + 4], ' ') AS x FROM (SELECT doc_id, a, unnest(range(1, len(a) - 3)) AS i FROM d WHERE len(a) >= 5)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
c AS (SELECT doc_id, len(a) AS n_words, length(array_to_string(a, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
f AS (SELECT c.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(s.score, 0.0) AS score
      FROM c LEFT JOIN cov USING (doc_id) LEFT JOIN s USING (doc_id)),
z2 AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {quality_rules.THRESHOLD} AS kept, round(score, 6) AS score FROM z2
"""

number = lambda part, *columns: f"CAST('0x' || substr(md5(concat_ws('|', '{mixing.SEED}:{part}', {', '.join(columns)})), 1, 8) AS BIGINT)"
most, block, per = mixing.MAX_REPEAT, mixing.BLOCK_WORDS, mixing.DOCS_PER_SHARD

MIX = f"""
WITH sized AS (SELECT doc_id, coalesce(source, '') AS k, source IS NULL AS nk, len({words("text")}) AS size FROM documents),
src AS (SELECT k, nk, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY ALL),
wt AS (SELECT *, {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY nk, k) - 1) % {len(mixing.WEIGHTS)} + 1] AS w FROM src),
o AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS ws,
      CAST({most} * coalesce(sum(source_size) OVER before, 0) AS BIGINT) AS capped, row_number() OVER (ORDER BY source_size::DOUBLE / w, nk, k) AS r FROM wt
      WINDOW before AS (ORDER BY source_size::DOUBLE / w, nk, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT * FROM o WHERE (total - capped) * w < {most} * source_size * ws ORDER BY r LIMIT 1),
t AS (SELECT o.k, o.nk, o.source_size, o.n, CASE WHEN f.r IS NULL OR o.r < f.r THEN CAST({most} * o.source_size AS DOUBLE) ELSE CAST((f.total - f.capped) * o.w AS DOUBLE) / f.ws END AS target FROM o LEFT JOIN f ON TRUE),
dealt AS (SELECT s.*, {number("shard", "coalesce(CAST(s.doc_id AS VARCHAR), '~')")} % CAST(ceil(t.n / {per}.0) AS BIGINT) AS shard,
          {number("order", "coalesce(CAST(s.doc_id AS VARCHAR), '~')")} AS ord FROM sized s JOIN t USING (k, nk)),
sh AS (SELECT k, nk, shard, CAST(sum(size) AS BIGINT) AS ss, CASE WHEN sum(size) > 0 THEN CAST(greatest(1, round(sum(size) / {block}.0::DOUBLE)) AS BIGINT) ELSE 0 END AS blocks FROM dealt GROUP BY ALL),
ps AS (SELECT k, nk, CAST(sum(blocks) AS BIGINT) AS nb, CAST(sum(ss) AS BIGINT) AS nw FROM sh GROUP BY ALL),
v AS (SELECT k, nk, nb, target * nb / nw AS votes FROM t JOIN ps USING (k, nk) WHERE nw > 0),
m AS (SELECT CAST(round(sum(votes)) AS BIGINT) AS seats FROM v),
qs AS (SELECT k, nk, nb, row_number() OVER (ORDER BY votes / (2 * seat + 1) DESC, nk, k, seat) AS r FROM (SELECT *, unnest(range(CAST(ceil(votes) AS BIGINT) + 30)) AS seat FROM v)),
q AS (SELECT k, nk, least(count(*), {most} * any_value(nb)) AS quota FROM qs, m WHERE r <= seats GROUP BY k, nk),
bs AS (SELECT k, nk, shard, quota, row_number() OVER (PARTITION BY k, nk ORDER BY blocks::DOUBLE / (2 * seat + 1) DESC, shard, seat) AS r
       FROM (SELECT sh.*, quota, unnest(range({most} * blocks + 2)) AS seat FROM sh JOIN q USING (k, nk) WHERE blocks > 0)),
b AS (SELECT k, nk, shard, count(*) AS seats FROM bs WHERE r <= quota GROUP BY ALL),
p AS (SELECT sh.*, least(b.seats, {most} * blocks) AS seats, {number("start", "k", "CAST(CAST(nk AS INTEGER) AS VARCHAR)", "CAST(sh.shard AS VARCHAR)")} % blocks AS first FROM sh JOIN b USING (k, nk, shard)),
e AS (SELECT k, nk, shard, seats // blocks AS times, first * ss // blocks AS from1, least(blocks, first + seats % blocks) * ss // blocks AS to1, greatest(0, first + seats % blocks - blocks) * ss // blocks AS to2 FROM p),
pl AS (SELECT *, CAST(sum(size) OVER (PARTITION BY k, nk, shard ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin FROM dealt)
SELECT doc_id, size, t.source_size, target, CAST(coalesce(times, 0) * size + coalesce(greatest(0, least(fin, to1) - greatest(fin - size, from1)) + greatest(0, least(fin, to2) - greatest(fin - size, 0)), 0) AS BIGINT) AS taken
FROM pl LEFT JOIN e USING (k, nk, shard) JOIN t USING (k, nk)
"""

#: All pairs of equal words a period apart; neighbouring ones are a stretch, and the smallest period of equal stretches counts.
PERIODIC = f"""
WITH crc AS ({CRC_TABLE}),
d AS (SELECT doc_id, {words("text")} AS a, {checksum("CAST(doc_id AS VARCHAR)", "t")}::BIGINT AS h FROM documents, crc),
s AS (SELECT *, len(a)::BIGINT AS n, h // 10 AS g FROM d),
e AS (SELECT doc_id, a, n, h % 10 = 0 AND n > 0 AS repeats, CASE WHEN n > 0 THEN g % n ELSE 0 END AS s, 1 + (n - CASE WHEN n > 0 THEN g % n ELSE 0 END) // (3 + g % 8) AS p FROM s),
u AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN repeats AND i >= s THEN a[s + (i - s) % p + 1] ELSE a[i + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM e)),
q AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // {periodic_runs.PERIODS}),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q),
st AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM k GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({periodic_runs.LEAST}, {periodic_runs.PERIODS} * q)),
r AS MATERIALIZED (SELECT doc_id, s, len, min(q) AS q FROM st GROUP BY doc_id, s, len),
b AS (SELECT doc_id, s, len, q FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len::DOUBLE / q DESC, s, q) = 1),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS told FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
left_over AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(t.n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
  sha256(coalesce(t.told, '')) AS runs_sha256, sha256(coalesce(left_over.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

ORACLES = {"op4_mix_sources": MIX, "op5_jaccard_components": JACCARD, "op9_quality_rules": RULES, "op13_periodic_runs": PERIODIC}
