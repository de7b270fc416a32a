"""DuckDB SQL for the queries that SQL can express."""

ORACLE_SQL = {
    "op1_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), iwin AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM iwin),
dwin AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, ks WHERE len(w) >= k)
), occ AS (SELECT doc_id, item_id, d.k, p FROM dwin d JOIN iwin i ON d.g = i.g AND d.k = i.k),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS q FROM occ) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op6_neardup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[p] || ' ' || w[p + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1)) + 1)) AS p FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
lnk AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
reach AS (SELECT a AS node, a AS other FROM lnk UNION SELECT r.node, l.b FROM reach r JOIN lnk l ON l.a = r.other),
c AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
""",
    "op8_passages": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), f AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
rm AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN f USING (g) WHERE doc_id > m),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS t FROM words ANTI JOIN rm USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op9_embeddings": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0
), lnk AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM lnk GROUP BY a),
reach AS (SELECT a AS node, b AS other FROM lnk UNION SELECT r.node, l.b FROM reach r JOIN lnk l ON l.a = r.other),
c AS (SELECT node, least(node, min(other)) AS c FROM reach GROUP BY node)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id
""",
    "op10_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source
), w AS (
  SELECT source, total, 2.0 * total AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM s
), l AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
    (1.5 * CAST(sum(total) OVER () AS DOUBLE) - coalesce(sum(CAST(cap AS DOUBLE)) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(CAST(weight AS DOUBLE)) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE NOT cap < level * weight
), b AS (
  SELECT source, total, CASE WHEN cap < l.level * weight THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), f.level * weight) END AS target FROM l, f
), o AS (
  SELECT d.doc_id, d.source, d.size, b.total, b.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), e AS (
  SELECT *, CASE WHEN total > 0 THEN CAST(floor(target) AS BIGINT) // total ELSE 0 END AS n FROM o
)
SELECT doc_id, source, size, total AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(n * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - n * total - start)) AS BIGINT) AS taken FROM e
""",
    "op13_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN doc_id > first THEN 'E' ELSE '' END AS bad
  FROM d LEFT JOIN f USING (t) LEFT JOIN l USING (doc_id)
), cell AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (SELECT o, k, o[k] AS f, o[1:k - 1] AS b FROM o, unnest(range(1, 6)) AS u(k)),
j AS (
  SELECT part, o, k, n, good, toxic, contains(bad, f) AS fails, len(list_intersect(string_split(bad, ''), string_split(b, ''))) > 0 AND b <> '' AND bad <> '' AS early, bad = f AS only_f FROM cell, s
), r AS (
  SELECT part, o, k, sum(CASE WHEN NOT fails AND NOT early THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT early THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND early THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN only_f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT early THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT early THEN toxic ELSE 0 END) AS toxic_lost
  FROM j GROUP BY 1, 2, 3
)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, o[k]) AS BIGINT) AS shapley FROM r
""",
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  WITH RECURSIVE b AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM t
    UNION ALL SELECT c, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(v, CAST(ord(s[i // 9 + 1]) AS BIGINT)) ELSE xor(v >> 1, (v & 1) * 3988292384) END FROM b WHERE i < 9 * len(s))
  SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 6 AS h FROM b WHERE i = 9 * len(s)
), own AS (
  SELECT crc.c, k, r, x FROM crc JOIN t ON t.c = crc.c - crc.c % 100 WHERE k <= h
  UNION ALL SELECT crc.c, t.k + 10, r, x FROM crc JOIN t USING (c) WHERE k > h
), n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, r, x FROM own),
ln AS (SELECT crc.c, coalesce(max(d), 0) AS n FROM crc LEFT JOIN n USING (c) GROUP BY crc.c),
p AS (
  SELECT c, d, length(x) AS size, string_agg(sha256(strlen(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS g FROM n
  UNION ALL SELECT c, 0, 0, '' FROM crc
), node AS (
  SELECT d, g, min(c) AS c, count(*) AS n, max(size) AS size, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ln.n = d), '') AS ends
  FROM p JOIN ln USING (c) GROUP BY d, g
), kids AS (SELECT a.c, a.d, count(b.c) AS n FROM node a LEFT JOIN node b ON b.d = a.d + 1 AND starts_with(b.g, a.g) GROUP BY a.c, a.d),
sub AS (
  SELECT a.c, a.d, sum((b.n - 1) * b.size) AS saved, count(*) FILTER (WHERE k.n = 0) AS leaves
  FROM node a JOIN node b ON b.d >= a.d AND starts_with(b.g, a.g) JOIN kids k ON k.c = b.c AND k.d = b.d GROUP BY a.c, a.d
)
SELECT a.c AS conv_id, CAST(a.d AS BIGINT) AS depth, u.c AS parent_conv_id, CAST(a.n AS BIGINT) AS n_convs, CAST(k.n AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM node a JOIN kids k USING (c, d) JOIN sub s USING (c, d) LEFT JOIN node u ON u.d = a.d - 1 AND starts_with(a.g, u.g)
""",
    "op12_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT i, p, md5(substr(h, 2 * p + 1, 400)) AS g FROM (SELECT i, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM d WHERE len(h) >= 400)),
g AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
s AS (SELECT i, p, coalesce(lag(p) OVER (PARTITION BY i ORDER BY p) + 200, 0) AS e FROM w SEMI JOIN g USING (g)),
t AS (SELECT i, e AS lo, p AS hi, p > e OR p = 0 OR e = 0 AS new FROM s UNION ALL SELECT i, max(p) + 200, NULL, false FROM s GROUP BY i),
k AS (SELECT d.i, sum(CASE WHEN new THEN 1 ELSE 0 END) AS spans, string_agg(CASE WHEN hi IS NULL THEN substr(h, 2 * lo + 1) WHEN hi > lo THEN substr(h, 2 * lo + 1, 2 * (hi - lo)) ELSE '' END, '' ORDER BY lo) AS kept FROM t JOIN d USING (i) GROUP BY d.i)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST((len(h) - len(coalesce(kept, h))) // 2 AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (i)
""",
}
