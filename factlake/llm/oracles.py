"""SQL that gives the rows of those queries that SQL can express, written from their contracts."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Links of documents by common shingles, then everything reachable.
NGRAM_JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::varchar[]
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2),
      lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams FROM w),
g AS MATERIALIZED (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS src, b.doc_id AS dst FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.dst FROM reach r JOIN links l ON l.src = r.other)
SELECT doc_id, n_shingles, component_id
FROM (SELECT doc_id, cast(len(grams) AS bigint) AS n_shingles FROM s)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Every run of as many words as some window has, joined with the windows of that text.
DECONTAMINATE = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + 9], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i
        FROM items WHERE len(words) > 0)),
docs AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
runs AS (
  SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
  FROM docs, (SELECT DISTINCT n FROM windows)),
found AS MATERIALIZED (
  SELECT r.doc_id, r.i, r.n, w.item_id
  FROM (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win FROM runs) r
  JOIN windows w ON w.win = r.win AND w.n = r.n),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, cast(len(words) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)"""


def _grid_codes() -> str:
    """Every part against every entry, in two rounds and at the end."""
    near = """
n{k} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.part, c.entry, list_sum(list_transform(range(1, len(p.xs) + 1),
          lambda i: (p.xs[i] - c.xs[i]) * (p.xs[i] - c.xs[i]))) AS d
        FROM parts p JOIN c{k} c USING (part)) GROUP BY vec_id, part)"""
    moved = """
c{m} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.xs, c.xs) AS xs FROM c{k} c LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS xs FROM (
      SELECT part, entry, i, sum(p.xs[i]) AS s, count(*) AS n
      FROM n{k} JOIN parts p USING (vec_id, part), (SELECT unnest(range(1, 5)) AS i)
      GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry))"""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS hugeint)) AS xs
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, part, xs[part * 4 + 1:part * 4 + 4] AS xs FROM kept, (SELECT unnest(range(16)) AS part)),
c0 AS MATERIALIZED (
  SELECT part, entry, xs FROM parts JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < 64),
{near.format(k=0)},{moved.format(k=0, m=1)},{near.format(k=1)},{moved.format(k=1, m=2)},{near.format(k=2)},
book AS (
  SELECT sha256(string_agg(array_to_string(xs, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, cast(sum(d) AS bigint) AS error
  FROM n2 GROUP BY vec_id)
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), book"""


# Vectors of 64 components, as the table has them.
GRID_CODES = _grid_codes()

# Every kept term of every group, each source of a language beside each other one.
SOURCE_DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
t AS MATERIALIZED (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(gn.total, 0) + 5 * v) AS p
  FROM groups JOIN kept USING (lang) JOIN v USING (lang)
  LEFT JOIN c USING (lang, source, term) LEFT JOIN gn USING (lang, source)),
q AS MATERIALIZED (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (any_value(ln.total) + 5 * any_value(v)) AS q
  FROM c JOIN v USING (lang) JOIN ln USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
alone AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
rows AS (
  SELECT * FROM alone UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, cast(value AS bigint) AS value, cast(rank AS integer) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= 50"""
