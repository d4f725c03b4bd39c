"""DuckDB SQL for the queries that SQL can express, written over whole tables.

Near duplicates are found there by joining all shingles or all vectors, secrets by relational steps; the
trained, tokenising, sketching, chunking and packing queries are held against brute force in tests.
"""

from __future__ import annotations

from transpark.llm import secret_scan as ss

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL"""

VECTOR_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a, count(DISTINCT b)::BIGINT AS n_links FROM l GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id"""


def _spans(pattern: str, kind: int) -> str:
    """Rows (doc_id, s, k, e, v) of the matches of a pattern."""
    p = pattern.replace("'", "''")
    before = "coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)"
    return f"""SELECT doc_id, s, {kind} AS k, s + length(v) AS e, v FROM (
        SELECT doc_id, (list_sum(list_transform(g[1:i], lambda y: length(y))) + {before})::BIGINT AS s, m[i] AS v
        FROM (SELECT doc_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m FROM d)))"""


#: Place of a character in the alphabet of b symbols, by its code point.
_PLACE = """CASE WHEN b = 16 OR b = 36 THEN CASE WHEN ch <= '9' THEN ascii(ch) - 48 ELSE ascii(lower(ch)) - 87 END
      WHEN b = 32 THEN CASE WHEN ch <= '7' THEN ascii(ch) - 24 ELSE ascii(upper(ch)) - 65 END
      WHEN ch = '+' THEN 62 WHEN ch = '/' THEN 63 WHEN ch <= '9' THEN ascii(ch) + 4 WHEN ch <= 'Z' THEN ascii(ch) - 65 ELSE ascii(ch) - 71 END"""
_KIND = "['assign', 'access', 'hex', 'random'][k + 1]"
_LIST = f"string_agg({_KIND} || ':' || s || ':' || e, ',' ORDER BY s, k)"
_TC, _TD = ss.TEXT_COINCIDENCE, ss.TEXT_DIGITS

SECRET_SCAN = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT * FROM ({_spans(ss.ASSIGN, 0)}) WHERE length(regexp_extract(v, '{ss.ASSIGN.replace("'", "''")}', 1)) >= 6
  UNION ALL {_spans(ss.ACCESS, 1)} UNION ALL {_spans(ss.HEX, 2)}),
whole AS (SELECT row_number() OVER () AS c, * FROM ({_spans(ss.CANDIDATE, 3)})),
cuts AS (SELECT c, b.s, b.e FROM whole w JOIN base b USING (doc_id) WHERE b.s < w.e AND w.s < b.e),
starts AS (SELECT c, s AS p FROM whole UNION SELECT c, e FROM cuts),
parts AS (
  SELECT doc_id, p AS s, least(w.e, coalesce((SELECT min(x.s) FROM cuts x WHERE x.c = w.c AND x.s >= p), w.e)) AS e, w.s AS from_, v
  FROM starts JOIN whole w USING (c) WHERE p < w.e AND NOT EXISTS (SELECT 1 FROM cuts x WHERE x.c = w.c AND x.s <= p AND p < x.e)),
c0 AS (
  SELECT * FROM (SELECT doc_id, s, e, substr(v, s - from_ + 1, e - s) AS v FROM parts)
  WHERE regexp_matches(v, '[0-9]|[a-z][A-Z]') AND regexp_matches(v, '[A-Za-z]') AND length(rtrim(v, '=')) >= {ss.LEAST}),
c1 AS (
  SELECT doc_id, s, e, translate(rtrim(v, '='), '-_', '+/') AS v,
    CASE WHEN NOT regexp_matches(v, '[^0-9A-Fa-f]') THEN 16
         WHEN NOT regexp_matches(rtrim(v, '='), '[^A-Za-z2-7]') AND (v = upper(v) OR v = lower(v)) THEN 32
         WHEN NOT regexp_matches(v, '[^0-9A-Za-z]') THEN CASE WHEN v = upper(v) OR v = lower(v) THEN 36 ELSE 62 END ELSE 64 END AS b FROM c0),
c2 AS (
  SELECT *, length(v)::DOUBLE AS n, length(regexp_replace(v, '[^0-9]', '', 'g')) / length(v)::DOUBLE AS digits,
    list_transform(string_split(v, ''), lambda ch: ({_PLACE})::DOUBLE) AS c FROM c1),
c3 AS (
  SELECT *, list_avg(c) AS mean, list_sum(list_transform(list_distinct(c), lambda y: power(len(list_filter(c, lambda z: z = y)), 2))) AS squares,
    len(list_filter(c, lambda y: 2 * y >= b))::DOUBLE AS high,
    1 + len(list_filter(range(2, len(c) + 1), lambda i: (2 * c[i] >= b) <> (2 * c[i - 1] >= b))) AS runs,
    list_sum(list_transform(range(2, len(c) + 1), lambda i: (c[i] - list_avg(c)) * (c[i - 1] - list_avg(c)))) AS lagged,
    list_sum(list_transform(c, lambda y: power(y - list_avg(c), 2))) AS spread FROM c2),
c4 AS (SELECT *, 2 * high * (n - high) / n + 1 AS mu FROM c3),
c5 AS (
  SELECT *, greatest(0, (squares * b / n - n - (b - 1)) / sqrt(2 * (b - 1) * (n - 1) / n)) AS z1,
    coalesce((runs - mu) / nullif(sqrt(greatest(0, (mu - 1) * (mu - 2) / (n - 1))), 0), 99) AS z2,
    coalesce((lagged / nullif(spread, 0) + 1 / n) * sqrt(n), 99) AS z3,
    ({_TC} - (squares - n) / (n * (n - 1))) / sqrt(2 * {_TC} * (1 - {_TC}) / (n * (n - 1))) AS zt,
    CASE WHEN digits <= {_TD} THEN 1 ELSE exp(-n * (digits * ln(digits / {_TD})
      + CASE WHEN digits < 1 THEN (1 - digits) * ln((1 - digits) / (1 - {_TD})) ELSE 0 END)) END AS mix FROM c4),
c6 AS (
  SELECT doc_id, s, e, n, 3 * least({ss._tail("z1").replace("2D", "2")} / CASE WHEN z1 > 0 THEN 2 ELSE 1 END, {ss._tail("z2").replace("2D", "2")}, {ss._tail("z3").replace("2D", "2")}) AS r,
    2 * least(mix, CASE WHEN zt > 0 THEN {ss._tail("zt").replace("2D", "2")} / 2 ELSE 1 END) AS p FROM c5),
c7 AS (SELECT *, p * avg(n) OVER (PARTITION BY doc_id) / n AS q, count(*) OVER (PARTITION BY doc_id) AS m FROM c6),
c8 AS (SELECT *, {ss.RATE} * row_number() OVER (PARTITION BY doc_id ORDER BY q) / m AS allowed FROM c7),
c9 AS (SELECT *, max(CASE WHEN q <= allowed THEN allowed ELSE -1 END) OVER (PARTITION BY doc_id) AS cut FROM c8),
every AS (SELECT doc_id, s, k, e FROM base UNION ALL SELECT doc_id, s, 3, e FROM c9 WHERE q <= cut AND r >= {ss.REJECT}),
x AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    {_LIST.replace(" ORDER BY s, k)", " ORDER BY s, k) FILTER (k < 3)")} AS based, {_LIST} AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (doc_id)"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _word_list(text: str) -> str:
    """The list of words of a text, A-Z in lower case."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"


IMPORTANCE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_word_list("text")} AS w FROM documents),
f AS (SELECT r, unnest(w) AS w FROM d),
b AS (SELECT unnest({_word_list("text")}) AS w FROM benchmark),
shifted AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) t(i))),
v AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT),
    lambda c, x: xor(tab[xor(c, x) % 256 + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM f UNION SELECT w FROM b), shifted),
s AS (SELECT bucket, count(*) AS s FROM f JOIN v USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
x AS (SELECT r, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN v USING (w) JOIN g USING (bucket) GROUP BY r),
y AS (
  SELECT doc_id, r, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM d LEFT JOIN x USING (r)),
z AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n >= 20) AS every FROM y)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n >= 20 AND place <= 10 * every // 100 THEN place END AS rank FROM z"""

RANKED_SEARCH = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_word_list("text")} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, sum(len(w))::BIGINT AS big_l FROM d),
p AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w),
q AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, item_id, w FROM (SELECT item_id, unnest({_word_list("text")}) AS w FROM benchmark)),
t AS (SELECT w, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY w, big_n),
m AS (SELECT doc_id, r, 100 - 90 + (90 * len(w)::BIGINT * big_n) // big_l AS m FROM d, s WHERE len(w) > 0),
x AS (
  SELECT item, item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN p USING (w) JOIN t USING (w) JOIN m USING (r) GROUP BY item, item_id, r),
y AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM x JOIN m USING (r) WHERE score > 0)
SELECT * FROM y WHERE rank <= 10"""

ORACLE = {"op1_ngram_jaccard_join": NGRAM_JOIN, "op4_secret_scan": SECRET_SCAN, "op6_vector_near_dedup": VECTOR_DEDUP, "op12_ranked_search": RANKED_SEARCH, "op13_importance_resampling": IMPORTANCE}
