"""DuckDB SQL for the queries of this subpackage that it can express, over whole tables."""

OP5_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM docs
), shingles AS (
  SELECT DISTINCT doc_id, md5(s) AS s FROM (
    SELECT doc_id, p, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM words
  ) WHERE p = 1 OR p <= n - 3
), sets AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS same FROM shingles GROUP BY doc_id
), classes AS (
  SELECT same, n, min(doc_id) AS rep FROM sets GROUP BY same, n
), held AS (
  SELECT rep, n, s FROM classes JOIN shingles ON doc_id = rep
), links AS (
  SELECT a.rep AS a, b.rep AS b
  FROM held a JOIN held b ON a.s = b.s AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT rep, rep FROM classes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), roots AS (
  SELECT a, min(b) AS component FROM reach GROUP BY a
)
SELECT docs.doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles, coalesce(roots.component, docs.doc_id) AS component_id
FROM docs LEFT JOIN sets ON sets.doc_id = docs.doc_id
LEFT JOIN classes ON classes.same = sets.same AND classes.n = sets.n LEFT JOIN roots ON roots.a = classes.rep
"""

OP8_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs
), windows AS (
  SELECT r, p, word, CASE WHEN count(*) OVER s = 35 THEN md5(string_agg(word, ' ') OVER s) END AS k
  FROM words WINDOW s AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), repeated AS (
  SELECT k FROM windows WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1
), marked AS (
  SELECT r, p, word,
    coalesce(bool_or(repeated.k IS NOT NULL) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
  FROM windows LEFT JOIN repeated USING (k)
), kept AS (
  SELECT r, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS left_text FROM marked GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


OP11_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS r, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
  )
), cut AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM cut GROUP BY lang
), counts AS (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM (
    SELECT lang, k, array_to_string(w[p : p + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM cut JOIN range(1, 6) AS sizes(k) ON len(w) >= k)
  ) GROUP BY lang, k, phrase HAVING count(*) >= 100
), candidates AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
), cuts AS (
  SELECT c.lang, phrase, a, w, c.k, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : c.k], ' ') AS tail FROM candidates c JOIN range(1, 5) AS places(j) ON j < c.k
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, cuts.k, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score,
    row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY 1000 * a * n // (x.f * y.f), j) AS place
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = head JOIN counts y ON y.lang = cuts.lang AND y.phrase = tail JOIN totals ON totals.lang = cuts.lang
), inner_ AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[p : p + size - 1], ' ') AS phrase FROM (SELECT lang, a, w, size, unnest(range(1, k - size + 2)) AS p FROM candidates JOIN range(2, 5) AS sizes(size) ON size < k)
  ) GROUP BY lang, phrase
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank
  FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.phrase = s.phrase WHERE place = 1 AND (longer IS NULL OR longer < a)
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), places AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM places
), sizes AS (
  SELECT DISTINCT n FROM windows
), starts AS (
  SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs JOIN sizes ON len(w) >= n)
), hits AS (
  SELECT r, n, p, k FROM starts WHERE k IN (SELECT k FROM windows)
), words AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits JOIN windows USING (k) WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
