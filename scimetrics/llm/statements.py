"""SQL of those operators that SQL can state."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

WARC = """
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
 CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, strlen(html) >= 100 AND page_id > first AS again FROM (
  SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first
  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)))"""

_COMPONENTS = """reach AS (
 SELECT {node} AS a, {node} AS b FROM nodes
 UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b),
roots AS (SELECT a AS {node}, min(b) AS component_id FROM reach GROUP BY a)"""

PROJECTIONS = f"""
WITH RECURSIVE nodes AS (
 SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (
 SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM nodes
 WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
 SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
 AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93::DOUBLE),
{_COMPONENTS.format(node="vec_id")}
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM roots LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)"""

MINHASH = f"""
WITH RECURSIVE nodes AS MATERIALIZED (
 SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
sets AS MATERIALIZED (
 SELECT doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w[1]]
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM nodes),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
 SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
{_COMPONENTS.format(node="doc_id")}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept
FROM sets JOIN roots USING (doc_id)"""

REPEATS = f"""
WITH texts AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS MATERIALIZED (
 SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS k
 FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts WHERE len(w) >= 50)),
bad AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM bad) GROUP BY 1),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts),
kept AS (
 SELECT p.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM placed p
 ANTI JOIN (SELECT doc_id, unnest(g) AS p FROM gone) x ON x.doc_id = p.doc_id AND x.p = p.p GROUP BY 1)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
 sha256(coalesce(kept, '')) AS kept_sha256 FROM texts t LEFT JOIN kept USING (doc_id)"""

STATEMENTS = {
    "op1_warc": WARC,
    "op5_projections": PROJECTIONS,
    "op6_minhash": MINHASH,
    "op9_repeats": REPEATS,
}
