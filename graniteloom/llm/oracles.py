"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from graniteloom.llm.rules import STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

#: Smallest id reachable over links(a, b): closure by rounds that keep what is new.
REACH = """reach AS (SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)"""

OP3 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
  ok AS (SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(x, lambda c: abs(c))) > 0),
  links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p, ok q WHERE p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.9),
  {REACH},
  n AS (SELECT a, count(*) AS n FROM links GROUP BY 1), c AS (SELECT id, min(other) AS c FROM reach GROUP BY 1)
  SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept
  FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.id = vec_id"""

OP6 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
  {REACH}, c AS (SELECT id, min(other) AS c FROM reach GROUP BY 1)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
  FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""

OP10 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
  win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS h FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(5) r(k) WHERE c > 1 GROUP BY 1),
  line AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}') GROUP BY 1),
  m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(line.n - line.u, 0) AS n_dup_lines, coalesce(line.n, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({STOPS}))) AS n_stop
    FROM d LEFT JOIN line ON line.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id),
  b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
    AND coalesce(CAST(word_chars AS DOUBLE) / nullif(n_words, 0) BETWEEN 2 AND 14 AND CAST(n_symbols AS DOUBLE) / nullif(n_words, 0) <= 0.25 AND CAST(n_stop AS DOUBLE) / nullif(n_words, 0) >= 0.02
    AND CAST(n_repeat_words AS DOUBLE) / nullif(n_words, 0) <= 0.2, true) AND coalesce(CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0) <= 0.35, true) AS kept FROM b"""

CHAT = r"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
  esc AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l') AS e, replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') AS er FROM raw),
  o AS (SELECT conv_id, role, text, '### ' || er || ': ' || e || '</turn>' || chr(10) AS f, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]')) + 6 AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM esc),
  h AS (SELECT conv_id, CASE WHEN role = 'system' THEN length(f) ELSE 0 END AS sys, CASE WHEN role = 'system' THEN n ELSE 0 END AS sys_n, role = 'system' AS has FROM o WHERE i = 1),
  t AS (SELECT o.conv_id, i, n, length(f) AS c, 512 - sys_n AS room, CAST(sum(n) OVER (PARTITION BY o.conv_id ORDER BY i) AS BIGINT) AS upto FROM o JOIN h USING (conv_id) WHERE NOT (has AND i = 1)),
  s AS (SELECT x.conv_id, x.i, min(y.i) AS h FROM t x JOIN t y ON y.conv_id = x.conv_id AND y.i <= x.i AND (y.i = x.i OR (x.upto - x.n - y.upto + y.n <= 128 AND x.upto - y.upto + y.n <= x.room)) GROUP BY 1, 2),
  b AS (SELECT t.*, s.h, y.upto - y.n AS b, lag(t.i) OVER (PARTITION BY t.conv_id ORDER BY t.i) AS before FROM t JOIN s ON s.conv_id = t.conv_id AND s.i = t.i JOIN t y ON y.conv_id = t.conv_id AND y.i = s.h),
  w AS (SELECT conv_id, i, b, i AS s, h FROM b WHERE before IS NULL UNION ALL
    SELECT b.conv_id, b.i, CASE WHEN fits THEN w.b ELSE b.b END, CASE WHEN fits THEN w.s ELSE b.i END, CASE WHEN fits THEN w.h ELSE b.h END
    FROM w JOIN (SELECT * FROM b) b ON b.conv_id = w.conv_id AND b.before = w.i, LATERAL (SELECT b.upto - w.b <= b.room AND (b.i - 1) % 1024 <> 0 AS fits)),
  k AS (SELECT conv_id, s, h, max(i) AS last FROM w GROUP BY 1, 2, 3),
  z AS (SELECT k.conv_id, k.s, CAST(sum(c) AS BIGINT) AS c FROM k JOIN t ON t.conv_id = k.conv_id AND t.i BETWEEN k.h AND k.last GROUP BY 1, 2),
  q AS (SELECT conv_id, CAST(sum(c + sys) AS BIGINT) AS c FROM z JOIN h USING (conv_id) GROUP BY 1),
  d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS a, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS l FROM o GROUP BY 1)
  SELECT conv_id, n_turns, sha256(a) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256, coalesce(q.c, h.sys) AS formatted_chars FROM d JOIN h USING (conv_id) LEFT JOIN q USING (conv_id)"""


def _seats(name: str, rows: str, group: str, order: str, weight: str, seats: str) -> str:
    """CTEs that end in `name`: rows with `won`, the seats of each group by the highest quotients weight / (2k + 1)."""
    part = f"PARTITION BY {group}" if group else ""
    return f"""{name}_s AS (SELECT *, count(*) OVER ({part}) AS n_, sum({weight}) OVER ({part}) AS t_ FROM {rows}),
  {name}_b AS (SELECT *, CAST(greatest(0, floor(CASE WHEN t_ > 0 THEN {weight} / t_ ELSE 0 END * ({seats} - n_ / CAST(2 AS DOUBLE)) + CAST(0.5 AS DOUBLE)) - 1) AS BIGINT) AS low_,
    CASE WHEN {weight} > 0 THEN CAST(floor({weight} / t_ * ({seats} + n_ / CAST(2 AS DOUBLE)) + CAST(0.5 AS DOUBLE)) + 1 AS BIGINT) ELSE 0 END AS high_ FROM {name}_s),
  {name}_o AS (SELECT *, {seats} - sum(low_) OVER ({part}) AS open_ FROM {name}_b),
  {name}_q AS (SELECT {order}, open_, {weight} AS w_, unnest(range(low_, high_)) AS k_ FROM {name}_o WHERE high_ > low_),
  {name}_w AS (SELECT {order}, count(*) AS more_ FROM (SELECT *, row_number() OVER ({part} ORDER BY w_ / (2 * k_ + 1) DESC, {order}) AS r_ FROM {name}_q) WHERE r_ <= open_ GROUP BY {order}),
  {name} AS (SELECT * EXCLUDE (n_, t_, low_, high_, open_, more_), low_ + coalesce(more_, 0) AS won FROM {name}_o LEFT JOIN {name}_w USING ({order}))"""


MIX = f"""WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, source IS NULL AS nul, coalesce(source, '') AS src, CAST('0x' || left(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 15) AS BIGINT) AS place, md5(coalesce(text, '')) AS tie FROM documents),
  k AS (SELECT *, place % (SELECT greatest(256, -(-count(*) // 65536)) FROM documents) AS shard FROM d), c AS (SELECT nul, src, shard, CAST(sum(size) AS BIGINT) AS words FROM k GROUP BY 1, 2, 3),
  s0 AS (SELECT nul, src, CAST(sum(words) AS BIGINT) AS source_size FROM c GROUP BY 1, 2), s1 AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY nul, src) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS most FROM s0),
  s2 AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, nul, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
  s3 AS (SELECT *, most <= level * weight AS full_ FROM s2), s4 AS (SELECT *, CASE WHEN full_ THEN most ELSE max(CASE WHEN NOT full_ THEN level END) OVER () * weight END AS target, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s3),
  s5 AS (SELECT nul, src, source_size, target, full_, greatest(1, total // 1048576) AS block, total // greatest(1, total // 1048576) AS seats FROM s4), {_seats("s6", "s5", "", "nul, src", "target", "seats")},
  s7 AS (SELECT *, CASE WHEN full_ THEN source_size * 3 ELSE least(won * block, source_size * 3) END AS take FROM s6), s8 AS (SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS passes FROM s7),
  s9 AS (SELECT nul, src, source_size, target, block, passes, CAST(round((take - passes * source_size) / CAST(block AS DOUBLE)) AS BIGINT) AS share FROM s8),
  e AS (SELECT c.*, source_size, target, block, passes, share, CAST(words AS DOUBLE) AS weight FROM c JOIN s9 USING (nul, src)), {_seats("f", "e", "nul, src", "nul, src, shard", "weight", "share")},
  g AS (SELECT k.doc_id, k.size, f.source_size, f.target, f.words, f.passes, least(f.won * f.block, f.words) AS rest, CAST(sum(k.size) OVER (PARTITION BY k.nul, k.src, k.shard ORDER BY place, tie ROWS UNBOUNDED PRECEDING) AS BIGINT) - k.size AS begin,
    CAST('0x' || left(md5('21:' || CASE WHEN k.nul THEN 'null' ELSE 'source' END || ':' || k.src || ':' || k.shard), 15) AS BIGINT) % greatest(1, f.words // f.block) * f.block AS start FROM k JOIN f ON f.nul = k.nul AND f.src = k.src AND f.shard = k.shard),
  h AS (SELECT *, CASE WHEN words > 0 THEN ((begin - start) % words + words) % words ELSE 0 END AS a FROM g)
  SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(passes * size + greatest(0, least(rest - a, size)) + greatest(0, least(rest, a + size - words)) AS BIGINT) AS taken FROM h"""

PII_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
LUHN = f"""list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({DIGITS}), i, 1) AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(reverse({DIGITS}), i, 1) AS INTEGER) + 1] END)) % 10 = 0"""
PII_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(left(ltrim(x, '0'), 4) AS INTEGER), 0) > 255)) = 0",
    "card": f"length({DIGITS}) BETWEEN 14 AND 19 AND {LUHN}",
    "phone": f"length({DIGITS}) BETWEEN 10 AND 15",
}


def _placed(pattern: str, kind: str, rows: str = "t") -> str:
    """doc_id, kind, v, a, b of the matches of a pattern, with their places from the lengths of matches and gaps."""
    return f"""SELECT doc_id, '{kind}' AS kind, v, CAST(stop - length(v) AS BIGINT) AS a, CAST(stop AS BIGINT) AS b FROM (SELECT doc_id, v, sum(length(v) + length(g)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM
    (SELECT doc_id, unnest(m) AS v, unnest(g[1 : len(m)]) AS g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM {rows}) WHERE len(m) > 0))"""


def _pii_round(r: int) -> str:
    """CTEs of one round of scoring: known<r> are the edges of known values, found<r> the values that it finds."""
    return f"""kinds{r} AS (SELECT p, arg_max(kind, (f, kind)) AS kind FROM (SELECT p, kind, count(DISTINCT v) AS f FROM known{r} GROUP BY 1, 2) GROUP BY 1),
  score{r} AS (SELECT p, log2(count(DISTINCT v) + 1) AS w FROM known{r} JOIN places USING (p) GROUP BY p, T HAVING count(DISTINCT v) >= 3 AND count(DISTINCT place) >= T * CAST(0.5 AS DOUBLE)),
  found{r} AS (SELECT v, arg_max(kind, (w, kind)) AS kind FROM (SELECT DISTINCT v, p FROM edges WHERE kind IN ('other', 'key')) JOIN score{r} USING (p) JOIN kinds{r} USING (p) GROUP BY 1 HAVING avg(w) >= 2),
  known{r + 1} AS (SELECT * FROM edges WHERE kind <> 'other' UNION ALL SELECT f.kind, e.v, e.p, e.place FROM edges e JOIN found{r} f ON f.v = e.v WHERE e.kind IN ('other', 'key'))"""


PII = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), base AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT * FROM ({_placed(p, k)}) WHERE {PII_VALID[k]}" for k, p in PII_KINDS.items())})),
  w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS i, lower(v) AS low FROM ({_placed(WORD, "word")})),
  x AS (SELECT *, lag(low) OVER q AS l1, lag(low, 2) OVER q AS l2, lead(low) OVER q AS r1, lead(low, 2) OVER q AS r2 FROM w WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
  bare AS (SELECT *, regexp_extract(v, '[\\p{{L}}0-9](?s:.*)[\\p{{L}}0-9]') AS z, length(regexp_extract(v, '^[^\\p{{L}}0-9]*')) AS lead_ FROM x WHERE regexp_matches(v, '[0-9]|\\p{{L}}[@_:=+.]\\p{{L}}')),
  cand AS (SELECT doc_id, CASE WHEN regexp_full_match(z, '[A-Za-z0-9]{{20,}}') AND length(regexp_replace(z, '[^0-9]', '', 'g')) >= 4 AND regexp_matches(z, '[A-Za-z]') THEN 'key' ELSE 'other' END AS kind, z AS v, a + lead_ AS a, a + lead_ + length(z) AS b, i AS first, i AS last
    FROM bare c WHERE length(z) >= 5 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.a < c.b AND c.a < b.b)),
  seed AS (SELECT b.doc_id, b.kind, b.v, b.a, b.b, f.i AS first, l.i AS last FROM base b JOIN w f ON f.doc_id = b.doc_id AND f.a <= b.a AND b.a < f.b JOIN w l ON l.doc_id = b.doc_id AND l.a < b.b AND b.b <= l.b),
  place AS (SELECT doc_id, i, concat_ws(chr(1), low, r1, r2) AS place, CASE WHEN l2 IS NOT NULL THEN concat_ws(chr(1), 'L2', l2, l1) END AS left_, CASE WHEN l1 IS NOT NULL AND r1 IS NOT NULL THEN concat_ws(chr(1), 'LR', l1, r1) END AS both_ FROM x),
  marks AS (SELECT m.*, place, left_, CASE WHEN first = last THEN both_ END AS both_ FROM (SELECT * FROM seed UNION ALL SELECT * FROM cand) m JOIN place p ON p.doc_id = m.doc_id AND p.i = m.first),
  edges AS (SELECT kind, v, left_ AS p, place FROM marks WHERE left_ IS NOT NULL UNION SELECT kind, v, both_, place FROM marks WHERE both_ IS NOT NULL), need AS (SELECT p FROM edges GROUP BY 1 HAVING count(DISTINCT v) >= 3 AND bool_or(kind IN ('other', 'key'))),
  places AS (SELECT p, count(DISTINCT place) AS T FROM (SELECT left_ AS p, place FROM place UNION ALL SELECT both_, place FROM place) JOIN need USING (p) GROUP BY 1), known1 AS (SELECT * FROM edges WHERE kind <> 'other'),
  {_pii_round(1)}, {_pii_round(2)}, {_pii_round(3)},
  every AS (SELECT doc_id, a, b, kind, true AS base FROM base UNION SELECT c.doc_id, c.a, c.b, f.kind, false FROM cand c JOIN found3 f ON f.v = c.v),
  named AS (SELECT *, list_position(['email', 'ip', 'card', 'phone', 'key'], kind) AS r, kind || ':' || a || ':' || b AS said FROM every),
  sums AS (SELECT doc_id, count(*) FILTER (base AND kind = 'email') AS n_email, count(*) FILTER (base AND kind = 'ip') AS n_ip, count(*) FILTER (base AND kind = 'card') AS n_card, count(*) FILTER (base AND kind = 'phone') AS n_phone,
    string_agg(said, ',' ORDER BY a, r, b) FILTER (base) AS base, string_agg(said, ',' ORDER BY a, r, b) AS spans FROM named GROUP BY 1)
  SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN sums USING (doc_id)"""



def _kmeans_round(r: int) -> str:
    """CTEs of one round: a<r> is the nearest centroid of c<r> for each vector, c<r + 1> the floors of the means."""
    return f"""a{r} AS MATERIALIZED (SELECT n, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT n, k, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY 1),
  c{r + 1} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (n), range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1
    UNION ALL SELECT k, c FROM c{r} WHERE k NOT IN (SELECT k FROM a{r}))"""


OP13 = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x AS c FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8)),
  {", ".join(_kmeans_round(r) for r in range(10))}, {_kmeans_round(10)}
  SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
  FROM a10 JOIN v USING (n) JOIN c10 USING (k)"""

ORACLE = {
    "op2_contextual_pii": PII,
    "op3_multi_index_dedup": OP3,
    "op4_sainte_lague_mix": MIX,
    "op6_signature_tree_join": OP6,
    "op7_budgeted_chat": CHAT,
    "op10_quality_rules": OP10,
    "op13_block_norm_clusters": OP13,
}
