"""DuckDB SQL for those training-data queries that SQL can express."""

OP4 = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NULL OR p.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id IS NULL OR p.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, doc_id, text,
         list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), windows AS (
  SELECT k, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) > 7
), spelt AS (
  SELECT k, i, array_to_string(list_slice(words, i, i + 7), ' ') AS eight FROM windows
), often AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, eight) AS n FROM spelt
), covered AS (
  SELECT k, count(DISTINCT w_at) AS n_repeat_words
  FROM (SELECT k, unnest(range(i, i + 8)) AS w_at FROM often WHERE n > 1) GROUP BY k
), base AS (
  SELECT doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda x: regexp_matches(x, '[!?]{2}$'))) AS n_loud,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
         length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
         len(list_filter(lines, lambda x: suffix(x, '...'))) AS n_cut,
         coalesce(list_max(map_values(list_aggregate(words, 'histogram'))), 0) AS n_commonest
  FROM w LEFT JOIN covered USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
            OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 100 * n_loud > 25 * n_words OR 100 * n_capitals > 50 * word_chars
            OR 100 * n_digits > 50 * word_chars OR 100 * n_cut > 70 * n_lines OR 100 * n_commonest > 50 * n_words) AS kept
FROM base
"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAME = "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + ")"
_BEFORE = _NAME + r"""["'']?\x20*[:=]\x20*["'']?"""
_RULES = (("assign", _BEFORE + "[A-Za-z0-9+/_.=-]+"), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"), ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"))
_LEAST = f"""CASE kind WHEN 'assign' THEN length(regexp_extract(s, '^{_BEFORE}([A-Za-z0-9+/_.=-]+)$', 1)) >= 8 WHEN 'access' THEN length(s) >= 16 WHEN 'hex' THEN length(s) >= 32 ELSE true END"""

OP7 = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), m AS (
  {" UNION ALL ".join(f"SELECT k, {o} AS o, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d WHERE regexp_matches(text, '{p}')" for o, (kind, p) in enumerate(_RULES))}
), l AS (
  SELECT k, o, kind, unnest(m) AS s, unnest(list_transform(g, lambda x: length(x)))::BIGINT AS gap, unnest(range(1, len(g) + 1)) AS i FROM m
), p AS (
  SELECT k, o, kind, s, sum(gap) OVER w + coalesce(sum(length(s)) OVER b, 0) AS a FROM l
  WINDOW w AS (PARTITION BY k, o ORDER BY i), b AS (PARTITION BY k, o ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT k, o, kind, a, kind || ':' || a::BIGINT || ':' || (a + length(s))::BIGINT AS one FROM p WHERE s IS NOT NULL AND {_LEAST}
), t AS (
  SELECT k, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
         string_agg(one, ',' ORDER BY a, o) FILTER (WHERE o < 3) AS base, string_agg(one, ',' ORDER BY a, o) AS spans FROM f GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (k)
"""

#: Texts of one shingle set are one class, so that many copies are one row of the pairs.
OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d
), c AS (
  SELECT md5(array_to_string(list_sort(sh), chr(10))) AS class, any_value(sh) AS sh, any_value(len(sh)) AS n, min(doc_id) AS least FROM s WHERE len(sh) > 0 GROUP BY 1
), e AS (
  SELECT class, n, unnest(sh) AS shingle FROM c
), p AS (
  SELECT a.class AS x, b.class AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.class <> b.class AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.class, b.class HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), r AS (
  SELECT class AS x, class AS y FROM c UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
), m AS (
  SELECT r.x AS class, min(c.least) AS component_id FROM r JOIN c ON c.class = r.y GROUP BY 1
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(m.component_id, s.doc_id) AS kept
FROM s LEFT JOIN m ON m.class = md5(array_to_string(list_sort(s.sh), chr(10))) AND len(s.sh) > 0
"""

OP12 = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (SELECT * FROM r WHERE vec_id % 50 = 0
), s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, a.label AS own, r.rid, r.vec_id, r.label, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM a JOIN r ON a.rid <> r.rid AND len(a.v) = len(r.v)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, rid) AS k FROM s WHERE label = own QUALIFY k <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST, s.rid)::INTEGER AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND s.label <> p.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT * FROM n WHERE rank <= 3
"""

OP13 = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) q(k)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10
), u AS (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM c, (VALUES (1), (2)) q(cut) WHERE cut < k
), s AS (
  SELECT u.lang, u.phrase, u.a, x.f AS l, y.f AS r, ((1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.x AND x.k = u.cut JOIN f y ON y.lang = u.lang AND y.phrase = u.y AND y.k = u.k - u.cut
  QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, u.cut) = 1
), h AS (
  SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE k = 3) GROUP BY ALL
), o AS (SELECT s.* FROM s LEFT JOIN h ON h.lang = s.lang AND h.part = s.phrase WHERE NOT coalesce(100 * most >= 50 * a, false)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""
