"""The derived views of ``facts.py`` in DuckDB's SQL, and an oracle per query.

Floating values are compared after rounding, lists as joined text, and times
as text, so that both engines print the same values.
"""

from factlake.plans.facts import AS_OF

# The English stop words of PostgreSQL's text search.
_STOPS = """
a about above after again against all am an and any are as at be because been before being below between both
but by can did do does doing don down during each few for from further had has have having he her here hers
herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on
once only or other our ours ourselves out over own s same she should so some such t than that the their theirs
them themselves then there these they this those through to too under until up very was we were what when
where which while who whom why will with you your yours yourself yourselves"""
STOP_WORDS = ", ".join(f"'{w}'" for w in _STOPS.split())

_VIEWS = {
    "accesses": """
accesses AS (
  SELECT event_id AS call_id,
         md5(cast(event_id % (SELECT count(*) FROM documents) AS varchar)) AS id, ts
  FROM events WHERE event_type = 'click')""",
    "memory": """
touched AS (SELECT id, max(ts) AS la, count(*) AS ac FROM accesses GROUP BY id),
numbered AS (
  SELECT *, md5(cast(doc_id AS varchar)) AS id,
         (doc_id // 6) % (SELECT count(*) FROM embeddings) AS vec_id,
         timestamp '2024-01-01' + to_days(cast(doc_id % 25 AS int)) AS born
  FROM documents),
memory AS MATERIALIZED (
  SELECT *, nullif(split_part(created_by, '/', 1), 'auto') AS engineer,
         split_part(created_by, '/', 2) AS agent_type
  FROM (
    SELECT d.id, 'proj-' || (d.doc_id % 3) AS project_id, d.text AS content,
      CASE WHEN d.doc_id % 7 <> 3 THEN v.embedding::double[] END AS embedding,
      (['alice/code-reviewer', 'alice/architect', 'bob/debugger', 'auto/ci-fixer',
        'charlie/coder'])[1 + (d.doc_id // 7) % 5] AS created_by,
      CASE WHEN d.doc_id % 4 <> 0 THEN d.source END AS repo,
      CASE WHEN d.doc_id % 11 = 0 THEN []::varchar[]
           ELSE list_filter([d.lang,
             CASE WHEN d.doc_id % 2 = 0 THEN 'architecture' END,
             CASE WHEN d.doc_id % 3 = 0 THEN 'security' END], lambda x: x IS NOT NULL) END AS tags,
      CASE WHEN d.doc_id % 20 = 0 THEN 'critical'
           WHEN d.doc_id % 5 = 0 THEN 'high' ELSE 'normal' END AS importance,
      (d.doc_id % 20 = 0 OR d.doc_id % 13 = 0) AS pinned,
      (d.doc_id % 6 = 0) AS archived,
      born AS created_at,
      born + to_days(cast(d.doc_id % 10 AS int)) AS updated_at,
      greatest(born, coalesce(t.la, born)) AS last_accessed_at,
      cast(coalesce(t.ac, 0) AS int) AS access_count
    FROM numbered d
    LEFT JOIN embeddings v ON v.vec_id = d.vec_id
    LEFT JOIN touched t ON t.id = d.id))""",
    "questions": """
asked AS (
  SELECT conv_id * 1000 + turn AS query_id, conv_id AS n, conv_id * 8 + turn AS v, text AS question
  FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT -1 - item_id, item_id, item_id * 11 + 5, text FROM benchmark),
questions AS (
  SELECT q.query_id, 'proj-' || (q.n % 3) AS project_id, q.question,
    e.embedding::double[] AS qvec,
    CASE WHEN q.n % 5 = 1 THEN 'bob/debugger' END AS agent,
    CASE WHEN q.n % 7 = 2 THEN 'alice' END AS engineer_q,
    CASE WHEN q.n % 11 = 3 THEN 'src' || (q.n % 20) END AS repo_q,
    CASE WHEN q.n % 6 = 4 THEN ['architecture'] END AS tags_q,
    10 AS k,
    CASE WHEN q.n % 4 <> 3 THEN 0.2::double ELSE 0.3::double END AS threshold,
    q.n % 4 = 0 AS include_archived
  FROM asked q JOIN embeddings e ON e.vec_id = q.v % (SELECT count(*) FROM embeddings))""",
    # Pairs of a question and a fact in its scope, with similarity and text match.
    "lexed": r"""
m_lex AS MATERIALIZED (
  SELECT id, list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS tsv FROM memory),
q_lex AS MATERIALIZED (
  SELECT query_id, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) AS terms
  FROM questions)""",
    "scored": r"""
in_scope AS (
  SELECT q.query_id, m.id, q.qvec, m.embedding, q.threshold, q.k
  FROM questions q JOIN memory m ON m.project_id = q.project_id
  WHERE (q.include_archived OR NOT m.archived)
    AND (q.agent IS NULL OR m.created_by = q.agent)
    AND (q.engineer_q IS NULL OR m.engineer = q.engineer_q)
    AND (q.repo_q IS NULL OR m.repo = q.repo_q)
    AND (q.tags_q IS NULL OR list_has_all(m.tags, q.tags_q))),
with_vector AS MATERIALIZED (SELECT * FROM in_scope WHERE embedding IS NOT NULL),
scored AS (
  SELECT query_id, id, threshold, k,
         round(list_cosine_similarity(embedding, qvec), 9) AS similarity
  FROM with_vector
  UNION ALL
  SELECT query_id, id, threshold, k, NULL FROM in_scope WHERE embedding IS NULL)""",
    # Porter2 by the published steps, one column a step, over all words of the texts in use.
    "stems": r"""
words_in_use AS MATERIALIZED (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM (
    SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)),
stem_0 AS (
  SELECT word, regexp_replace(word, '(^|[aeiouy])y', '\1Y', 'g') AS w FROM words_in_use
  WHERE regexp_full_match(word, '[a-z]{3,}') AND word NOT IN ('skis', 'skies', 'dying', 'lying', 'tying', 'idly',
    'gently', 'ugly', 'early', 'only', 'singly', 'sky', 'news', 'howe', 'atlas', 'cosmos', 'bias', 'andes')),
region_1 AS (
  SELECT word, w, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN regexp_matches(w, '^commun') THEN 6
    WHEN regexp_matches(w, '[aeiouy][^aeiouy]') THEN length(regexp_extract(w, '^.*?[aeiouy][^aeiouy]'))
    ELSE length(w) END AS r1 FROM stem_0),
region_2 AS (
  SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '[aeiouy][^aeiouy]')
    THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^.*?[aeiouy][^aeiouy]')) ELSE length(w) END AS r2
  FROM region_1),
stem_1a AS (
  SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN w[:-3]
    WHEN w LIKE '%ied' OR w LIKE '%ies' THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
    WHEN w LIKE '%us' OR w LIKE '%ss' OR w NOT LIKE '%s' THEN w
    WHEN regexp_matches(left(w, length(w) - 2), '[aeiouy]') THEN w[:-2] ELSE w END AS w FROM region_2),
ending_1b AS (
  SELECT *, regexp_extract(w, '(eedly|eed|ingly|edly|ing|ed)$') AS e,
    w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') AS done FROM stem_1a),
cut_1b AS (SELECT *, left(w, length(w) - length(e)) AS b FROM ending_1b),
stem_1b AS (
  SELECT word, r1, r2, done, CASE WHEN done OR e = '' THEN w
    WHEN e LIKE 'eed%' THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END
    WHEN NOT regexp_matches(b, '[aeiouy]') THEN w
    WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
    WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, length(b) - 1)
    WHEN r1 >= length(b) AND regexp_matches(b, '(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$') THEN b || 'e'
    ELSE b END AS w FROM cut_1b),
stem_1c AS (
  SELECT word, r1, r2, done, CASE WHEN NOT done AND regexp_matches(w, '.[^aeiouy][yY]$')
    THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM stem_1b),
ending_2 AS (
  SELECT *, CASE WHEN done THEN '' ELSE regexp_extract(w, '(ational|tional|enci|anci|abli|entli|izer|ization|ation|ator|alism|aliti|alli|fulness|ousli|ousness|iveness|iviti|biliti|bli|fulli|lessli|ogi|li)$') END AS e
  FROM stem_1c),
cut_2 AS (SELECT *, left(w, length(w) - length(e)) AS b FROM ending_2),
stem_2 AS (
  SELECT word, r1, r2, done, CASE WHEN e = '' OR length(b) < r1 OR (e = 'ogi' AND b NOT LIKE '%l')
      OR (e = 'li' AND NOT regexp_matches(b, '[cdeghkmnrt]$')) THEN w
    WHEN e = 'tional' THEN b || 'tion' WHEN e = 'enci' THEN b || 'ence' WHEN e = 'anci' THEN b || 'ance'
    WHEN e = 'abli' THEN b || 'able' WHEN e = 'entli' THEN b || 'ent' WHEN e IN ('izer', 'ization') THEN b || 'ize'
    WHEN e IN ('ational', 'ation', 'ator') THEN b || 'ate' WHEN e IN ('alism', 'aliti', 'alli') THEN b || 'al'
    WHEN e IN ('fulness', 'fulli') THEN b || 'ful' WHEN e IN ('ousli', 'ousness') THEN b || 'ous'
    WHEN e IN ('iveness', 'iviti') THEN b || 'ive' WHEN e IN ('biliti', 'bli') THEN b || 'ble'
    WHEN e = 'lessli' THEN b || 'less' WHEN e = 'ogi' THEN b || 'og' ELSE b END AS w FROM cut_2),
ending_3 AS (
  SELECT *, CASE WHEN done THEN '' ELSE regexp_extract(w, '(ational|tional|alize|icate|iciti|ical|ful|ness|ative)$') END AS e
  FROM stem_2),
cut_3 AS (SELECT *, left(w, length(w) - length(e)) AS b FROM ending_3),
stem_3 AS (
  SELECT word, r1, r2, done, CASE WHEN e = '' OR length(b) < r1 OR (e = 'ative' AND length(b) < r2) THEN w
    WHEN e = 'tional' THEN b || 'tion' WHEN e = 'ational' THEN b || 'ate' WHEN e = 'alize' THEN b || 'al'
    WHEN e IN ('icate', 'iciti', 'ical') THEN b || 'ic' ELSE b END AS w FROM cut_3),
ending_4 AS (
  SELECT *, CASE WHEN done THEN '' ELSE regexp_extract(w, '(al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ism|ate|iti|ous|ive|ize|ion)$') END AS e
  FROM stem_3),
cut_4 AS (SELECT *, left(w, length(w) - length(e)) AS b FROM ending_4),
stem_4 AS (
  SELECT word, r1, r2, done, CASE WHEN e = '' OR length(b) < r2
    OR (e = 'ion' AND NOT regexp_matches(b, '[st]$')) THEN w ELSE b END AS w FROM cut_4),
stem_5 AS (
  SELECT word, CASE WHEN done THEN w
    WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(
      left(w, length(w) - 1), '(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$'))) THEN left(w, length(w) - 1)
    WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM stem_4),
stems AS MATERIALIZED (
  SELECT u.word, CASE u.word WHEN 'skis' THEN 'ski' WHEN 'skies' THEN 'sky' WHEN 'dying' THEN 'die'
    WHEN 'lying' THEN 'lie' WHEN 'tying' THEN 'tie' WHEN 'idly' THEN 'idl' WHEN 'gently' THEN 'gentl'
    WHEN 'ugly' THEN 'ugli' WHEN 'early' THEN 'earli' WHEN 'only' THEN 'onli' WHEN 'singly' THEN 'singl'
    ELSE coalesce(replace(s.w, 'Y', 'y'), u.word) END AS stem
  FROM words_in_use u LEFT JOIN stem_5 s USING (word)),
lexeme_of AS MATERIALIZED (SELECT * FROM stems WHERE word NOT IN (""" + STOP_WORDS + r"""))""",
    "lexed_english": r"""
m_words AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'))) AS word FROM memory),
q_words AS (
  SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}]+'))) AS word FROM questions),
m_lex_english AS MATERIALIZED (
  SELECT id, list(DISTINCT stem) AS tsv FROM m_words JOIN lexeme_of USING (word) GROUP BY id),
q_lex_english AS MATERIALIZED (
  SELECT query_id, list(DISTINCT stem) AS terms FROM q_words JOIN lexeme_of USING (word) GROUP BY query_id)""",
    "english_ranked": """
english_ranked AS (
  SELECT * FROM (
    SELECT s.*, row_number() OVER (
      PARTITION BY s.query_id ORDER BY similarity DESC NULLS LAST, s.id) AS rank
    FROM scored s LEFT JOIN m_lex_english USING (id) LEFT JOIN q_lex_english USING (query_id)
    WHERE similarity > threshold OR coalesce(list_has_all(tsv, terms), false))
  WHERE rank <= k)""",
    "vector_ranked": """
vector_ranked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
    FROM scored WHERE similarity > threshold)
  WHERE rank <= k)""",
    "hybrid_ranked": """
hybrid_ranked AS (
  SELECT * FROM (
    SELECT s.*, row_number() OVER (
      PARTITION BY s.query_id ORDER BY similarity DESC NULLS LAST, s.id) AS rank
    FROM scored s JOIN m_lex USING (id) JOIN q_lex USING (query_id)
    WHERE similarity > threshold OR (len(terms) > 0 AND list_has_all(tsv, terms)))
  WHERE rank <= k)""",
    "pairs": """
usable AS MATERIALIZED (
  SELECT id, project_id, created_by, embedding FROM memory
  WHERE embedding IS NOT NULL AND NOT archived),
pairs AS (
  SELECT * FROM (
    SELECT a.id, a.project_id, a.created_by, b.id AS match_id, b.created_by AS other_author,
           round(list_cosine_similarity(a.embedding, b.embedding), 9) AS similarity
    FROM usable a JOIN usable b ON a.project_id = b.project_id AND a.id <> b.id)
  WHERE similarity > 0.95)""",
    "incoming": """
incoming AS MATERIALIZED (
  SELECT c.conv_id * 1000 + c.turn AS candidate_id, 'proj-' || (c.conv_id % 3) AS project_id,
    c.text AS content, e.embedding::double[] AS cvec,
    (['alice/code-reviewer', 'bob/debugger', 'charlie/coder'])[1 + c.turn % 3] AS author
  FROM conversations c JOIN embeddings e
    ON e.vec_id = (c.conv_id * 8 + c.turn) % (SELECT count(*) FROM embeddings))""",
    "dedup": """
stored AS MATERIALIZED (
  SELECT id, project_id, created_by, embedding FROM memory
  WHERE embedding IS NOT NULL AND NOT archived),
dedup AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY similarity DESC, id) AS rank
    FROM (
      SELECT i.candidate_id, i.author, m.id, m.created_by,
             round(list_cosine_similarity(m.embedding, i.cvec), 9) AS similarity
      FROM incoming i JOIN stored m ON m.project_id = i.project_id)
    WHERE similarity > 0.95)
  WHERE rank <= 3)""",
    # The turns imported one after the other by one author, step by step.
    "imported": r"""
valid AS (
  SELECT candidate_id AS ordinal, content, cvec,
         row_number() OVER (ORDER BY candidate_id) AS n
  FROM incoming WHERE trim(content) <> '' AND length(content) <= 2000),
best AS (
  SELECT v.n,
    max(round(list_cosine_similarity(s.embedding, v.cvec), 9)) FILTER (s.created_by = 'bob/debugger') AS own,
    max(round(list_cosine_similarity(s.embedding, v.cvec), 9)) FILTER (s.created_by <> 'bob/debugger') AS other
  FROM valid v JOIN stored s ON s.project_id = 'proj-1'
    AND round(list_cosine_similarity(s.embedding, v.cvec), 9) > 0.95
  GROUP BY v.n),
earlier AS (
  SELECT i.n, list(j.n) AS blockers
  FROM valid i JOIN valid j ON j.n < i.n LEFT JOIN best b ON b.n = i.n
  WHERE round(list_cosine_similarity(i.cvec, j.cvec), 9) > 0.95
    AND round(list_cosine_similarity(i.cvec, j.cvec), 9) >= coalesce(b.other, -1)
  GROUP BY i.n),
item AS (
  SELECT v.n, v.ordinal, v.content, b.other, coalesce(e.blockers, []) AS blockers,
         coalesce(b.own >= coalesce(b.other, -1), false) AS known
  FROM valid v LEFT JOIN best b USING (n) LEFT JOIN earlier e USING (n)),
walk AS (
  SELECT 0::bigint AS n, []::bigint[] AS accepted
  UNION ALL
  SELECT i.n, CASE WHEN i.known OR list_has_any(w.accepted, i.blockers) THEN w.accepted
                   ELSE list_append(w.accepted, i.n) END
  FROM walk w JOIN item i ON i.n = w.n + 1),
final AS (SELECT accepted FROM walk ORDER BY n DESC LIMIT 1),
imported AS (
  SELECT i.*, list_contains((SELECT accepted FROM final), i.n) AS accepted FROM item i)""",
    # The turns stored one after the other in each project, step by step: every turn takes the
    # first of its near items, in the order of preference, that no turn before it moved away.
    "remembered": r"""
valid AS MATERIALIZED (
  SELECT candidate_id AS seq, project_id, author, content, cvec,
         CASE WHEN candidate_id % 3 = 0 THEN 'critical' END AS importance,
         row_number() OVER (PARTITION BY project_id ORDER BY candidate_id) AS n
  FROM incoming WHERE trim(content) <> '' AND length(content) <= 2000),
item AS (
  SELECT 's' || id AS item, project_id, created_by AS author, embedding AS vec, -1 AS seq, id FROM stored
  UNION ALL SELECT 'f' || seq, project_id, author, cvec, seq, '' FROM valid),
near AS MATERIALIZED (
  SELECT project_id, n, list({'item': item, 'own': own} ORDER BY similarity DESC, own DESC, seq DESC, id) AS items
  FROM (SELECT v.project_id, v.n, i.item, i.author = v.author AS own, i.seq, i.id,
          round(list_cosine_similarity(i.vec, v.cvec), 9) AS similarity
        FROM valid v JOIN item i ON i.project_id = v.project_id AND i.seq < v.seq)
  WHERE similarity > 0.95 GROUP BY project_id, n),
facing AS MATERIALIZED (
  SELECT v.project_id, v.n, coalesce(items, []) AS items FROM valid v LEFT JOIN near USING (project_id, n)),
walk AS (
  SELECT DISTINCT project_id, 0::bigint AS n, []::varchar[] AS gone, NULL::varchar AS item, false AS own FROM valid
  UNION ALL
  SELECT project_id, n, CASE WHEN best.own THEN list_append(gone, best.item) ELSE gone END,
         best.item, coalesce(best.own, false)
  FROM (SELECT f.project_id, f.n, w.gone,
               list_filter(f.items, lambda x: NOT list_contains(w.gone, x.item))[1] AS best
        FROM walk w JOIN facing f ON f.project_id = w.project_id AND f.n = w.n + 1)),
stepped AS MATERIALIZED (
  SELECT v.*, w.item, CASE WHEN w.own THEN 'update' WHEN w.item IS NULL THEN 'insert'
                           ELSE 'insert_corroborated' END AS action,
         md5(concat_ws(chr(1), v.project_id, v.author, v.seq, v.content, '""" + AS_OF + r"""')) AS h
  FROM valid v JOIN walk w USING (project_id, n)),
root AS (
  SELECT seq, CASE WHEN action <> 'update' THEN concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])
                   ELSE item[2:] END AS id
  FROM stepped WHERE action <> 'update' OR item[1] = 's'
  UNION ALL
  SELECT s.seq, r.id FROM root r JOIN stepped s ON s.action = 'update' AND s.item = 'f' || r.seq),
remembered AS (SELECT s.*, r.id FROM stepped s JOIN root r USING (seq))""",
    "changes": """
changes AS (
  SELECT event_id AS seq, ts, user_id, 'agent/' || user_id AS agent,
    md5(cast(event_id * 7 % (SELECT count(*) FROM documents) AS varchar)) AS id,
    'proj-' || ((event_id * 7 % (SELECT count(*) FROM documents)) % 3) AS project_id,
    CASE event_type
      WHEN 'click' THEN 'touch'
      WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'recall' ELSE 'promote' END
      WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'pin' ELSE 'unpin' END
      WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'archive' ELSE 'restore' END
      ELSE CASE WHEN user_id % 10 = 0 THEN 'forget' ELSE 'correct' END END AS kind,
    CASE WHEN event_type = 'error' THEN 'corrected by ' || event_id END AS payload
  FROM events)""",
    "tools": """
tools AS (
  SELECT ts, event_type AS tool, 'agent/' || (user_id % 5) AS agent_id,
         'proj-' || (user_id % 3) AS project_id,
         cast(round(value * 10) AS bigint) AS duration_ms, event_type <> 'error' AS success
  FROM events)""",
}

_NEEDS = {
    "memory": ("accesses",),
    "lexed": ("memory", "questions"),
    "scored": ("lexed",),
    "lexed_english": ("memory", "questions", "stems"),
    "english_ranked": ("scored", "lexed_english"),
    "vector_ranked": ("scored",),
    "hybrid_ranked": ("scored",),
    "pairs": ("memory",),
    "dedup": ("memory", "incoming"),
    "imported": ("dedup",),
    "remembered": ("dedup",),
}


def with_views(body: str, *names: str) -> str:
    """``body`` after the definitions of the named views and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    return "WITH RECURSIVE " + ",".join(_VIEWS[n] for n in ordered) + "\n" + body
