"""Equivalent SQL of the text queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM documents),
items AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM benchmark),
windows AS (
  SELECT item_id, least(13, len(w)) AS n, array_to_string(w[p0 : p0 + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p0 FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
doc_windows AS (
  SELECT r, n, p0, array_to_string(w[p0 : p0 + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p0 FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT d.r, d.n, d.p0, i.item_id FROM doc_windows d JOIN windows i ON d.n = i.n AND d.words = i.words),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p0, p0 + n)) AS p FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

OP6 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

#: Unrolled for the two levels that the paths of the given tables have.
_LEVEL = """
b{k} AS (
  SELECT host, template, segs[{k}] AS seg, sum(n) AS bn, sum(b) AS bb, sum(a) AS ba,
         sum(CASE WHEN len(segs) = {k} THEN n ELSE 0 END) AS be
  FROM t{j} WHERE len(segs) >= {k} GROUP BY ALL),
n{k} AS (SELECT host, template, sum(bn) AS nn, sum(bb) AS nb, sum(ba) AS na, sum(be) AS ne FROM b{k} GROUP BY ALL),
d{k} AS (
  SELECT host, template, seg,
         nn > bn
         AND CASE WHEN nb + na = 0 THEN true
                  WHEN bb + ba = 0 THEN nb + na >= 30 AND pow(1 - (nb + na) / (nn - bn), bn) >= 0.05
                  WHEN nb + na = bb + ba THEN bb + ba >= 30 AND pow(1 - (bb + ba) / bn, nn - bn) >= 0.05
                  ELSE abs(bb / (bb + ba) - (nb - bb) / (nb + na - bb - ba))
                         <= sqrt(0.5 * ln(2 / 0.05)) * (1 / sqrt(bb + ba) + 1 / sqrt(nb + na - bb - ba))
                       AND (bb / (bb + ba) - 0.5) * ((nb - bb) / (nb + na - bb - ba) - 0.5) >= 0 END
         AND abs(be / bn - (ne - be) / (nn - bn)) <= sqrt(0.5 * ln(2 / 0.05)) * (1 / sqrt(bn) + 1 / sqrt(nn - bn))
         AS alike
  FROM (SELECT host, template, seg, bn::DOUBLE AS bn, bb::DOUBLE AS bb, ba::DOUBLE AS ba, be::DOUBLE AS be FROM b{k})
  JOIN (SELECT host, template, nn::DOUBLE AS nn, nb::DOUBLE AS nb, na::DOUBLE AS na, ne::DOUBLE AS ne FROM n{k})
  USING (host, template)),
t{k} AS (
  SELECT t.host, t.segs, t.n, t.b, t.a,
         CASE WHEN d.seg IS NULL THEN t.template
              WHEN d.alike THEN t.template || '/*' ELSE t.template || '/' || d.seg END AS template
  FROM t{j} t LEFT JOIN d{k} d ON t.host = d.host AND t.template = d.template AND t.segs[{k}] = d.seg)"""

OP1 = (
    r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
           AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
ruled AS (
  SELECT *,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    [CASE WHEN regexp_matches(s, '^[0-9a-fA-F-]{8,}$') AND regexp_matches(s, '[0-9]') THEN '{hex}'
          ELSE regexp_replace(s, '[0-9]+', '#', 'g') END for s in string_split(path, '/') if s <> ''] AS segs
  FROM hp),
labelled AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled
  FROM ruled),
t0 AS (
  SELECT host, segs, count(*) AS n, count(*) FILTER (ruled = 'block') AS b, count(*) FILTER (ruled = 'allow') AS a,
         '' AS template
  FROM labelled GROUP BY host, segs),
"""
    + ",".join(_LEVEL.format(j=k - 1, k=k) for k in (1, 2))
    + """,
totals AS (
  SELECT host, template, (sum(b) + 2.0)::DOUBLE / (sum(b) + sum(a) + 4.0)::DOUBLE AS purity FROM t2 GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict,
       template, purity
FROM labelled JOIN (SELECT host, segs, template FROM t2) USING (host, segs) JOIN totals USING (host, template)
"""
)

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = (
    r"""
WITH RECURSIVE bits(v, c, k) AS (
  SELECT v, v::BIGINT, 0 FROM range(256) r(v)
  UNION ALL
  SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all("""
    + _LOWER
    + r""", '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
per_doc AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
summed AS (
  SELECT run, k,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(s) + 1),
             lambda p: ('0x' || substr(hex(encode(s)), 2 * p::BIGINT - 1, 2))::BIGINT)),
           lambda h, x: xor(h >> 8, t[xor(h, x) % 256 + 1])), 4294967295) AS h
  FROM (SELECT run, k, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM per_doc), crc_table),
words AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM summed)
  GROUP BY word HAVING length(word) >= 5 AND sum(k) >= 3),
gaps AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
cut AS (
  SELECT word, n, p, substr(word, 1, p - 1) AS head, substr(word, p + 1) AS tail FROM gaps),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.p = b.p AND a.head = b.head AND a.tail = b.tail
  WHERE a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM cut a JOIN words w ON w.word = a.head || a.tail
  UNION SELECT w.word, a.word, a.n FROM cut a JOIN words w ON w.word = a.head || a.tail),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n,
         (list(other ORDER BY other_n DESC, encode(other)))[1] AS best FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form,
         CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
steps(word, spot) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.spot WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.spot AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM forms f JOIN steps s ON s.word = f.word JOIN forms e ON e.word = s.spot AND e.form IS NULL
"""
)

OP13 = (
    r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all("""
    + _LOWER
    + r""", '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, len(w) AS k, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts),
shingles AS (
  SELECT r, k, p, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS item
  FROM words WINDOW o AS (PARTITION BY r ORDER BY p)),
distinct_items AS (SELECT DISTINCT r, item FROM shingles WHERE p <= greatest(k - 4, 1)),
items AS (SELECT r, item, count(*) OVER (PARTITION BY r) AS n FROM distinct_items),
sets AS (SELECT r, doc_id, n FROM texts JOIN (SELECT DISTINCT r, n FROM items) USING (r)),
pairs AS (
  SELECT a.r AS x, b.r AS y FROM items a JOIN items b ON a.item = b.item AND a.r <> b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(r, spot) AS (SELECT r, r FROM sets UNION SELECT reach.r, pairs.y FROM reach JOIN pairs ON pairs.x = reach.spot)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reach USING (r) JOIN sets o ON o.r = reach.spot GROUP BY s.r, s.doc_id, s.n
UNION ALL SELECT doc_id, 0, doc_id FROM texts WHERE len(w) = 0
"""
)

ORACLE = {
    "op1_url_filters": OP1,
    "op4_benchmark_decontamination": OP4,
    "op6_exact_dedup": OP6,
    "op11_spelling_variants": OP11,
    "op13_ngram_jaccard_join": OP13,
}
