"""Search and lifecycle functions callable from SQL over a registered fact view."""

from pyspark.sql import DataFrame, SparkSession

from factlake.functions.text import STOP_WORDS_ENGLISH, WORD, stem_english
from factlake.operators import lifecycle
from factlake.schema import ARCHIVE_AFTER_DAYS, DEDUP_LIMIT, DEDUP_THRESHOLD

_COSINE = """
CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<FLOAT>, b ARRAY<FLOAT>)
RETURNS DOUBLE
RETURN round(try_divide(
  aggregate(zip_with(a, b, (x, y) -> cast(x AS DOUBLE) * cast(y AS DOUBLE)), 0D, (s, x) -> s + x),
  sqrt(aggregate(a, 0D, (s, x) -> s + cast(x AS DOUBLE) * cast(x AS DOUBLE)))
  * sqrt(aggregate(b, 0D, (s, x) -> s + cast(x AS DOUBLE) * cast(x AS DOUBLE)))), 9)
"""

# What ``functions.text.lexemes`` computes, for SQL; stems come from the same function.
_LEXEMES = f"""
CREATE OR REPLACE TEMPORARY FUNCTION lexemes(t STRING)
RETURNS ARRAY<STRING>
RETURN array_distinct(regexp_extract_all(lower(t), r'{WORD}', 0))
"""

_ENGLISH = """
CREATE OR REPLACE TEMPORARY FUNCTION english_lexemes(t STRING)
RETURNS ARRAY<STRING>
RETURN array_distinct(stem_words(array_except(lexemes(t), array({stops}))))
"""

# Optional restrictions of a recall: the field of a fact, and the type of the parameter.
_SCOPE = {"agent": ("created_by", "STRING"), "engineer": ("engineer", "STRING"), "repo": ("repo", "STRING")}

_RECALL = """
CREATE OR REPLACE TEMPORARY FUNCTION recall(
  p_project_id STRING, p_embedding ARRAY<FLOAT>, p_limit INT DEFAULT 10,
  p_threshold DOUBLE DEFAULT 0.3, p_include_archived BOOLEAN DEFAULT false,
  {parameters},
  p_tags ARRAY<STRING> DEFAULT NULL,
  p_query_text STRING DEFAULT NULL, p_text_config STRING DEFAULT 'english')
RETURNS TABLE (
  id STRING, content STRING, similarity DOUBLE, created_by STRING, engineer STRING,
  repo STRING, tags ARRAY<STRING>, importance STRING, pinned BOOLEAN, archived BOOLEAN,
  access_count INT, created_at {timestamp}, last_accessed_at {timestamp})
RETURN
  WITH scoped AS (
    SELECT m.*, cosine_similarity(m.embedding, p_embedding) AS similarity
    FROM {view} m
    WHERE m.project_id = p_project_id AND {scope}
      AND (p_tags IS NULL OR size(array_except(p_tags, m.tags)) = 0)
      AND (p_include_archived OR NOT m.archived)),
  hits AS (
    SELECT *, row_number() OVER (ORDER BY similarity DESC NULLS LAST, id) AS place
    FROM scoped
    WHERE similarity > p_threshold
       OR (p_query_text IS NOT NULL AND CASE p_text_config
         WHEN 'simple' THEN size(lexemes(p_query_text)) > 0
           AND size(array_except(lexemes(p_query_text), lexemes(content))) = 0
         ELSE size(english_lexemes(p_query_text)) > 0
           AND size(array_except(english_lexemes(p_query_text), {stored})) = 0 END))
  SELECT id, content, similarity, created_by, engineer, repo, tags, importance, pinned,
         archived, access_count, created_at, last_accessed_at
  FROM hits WHERE place <= p_limit
"""

_DEDUP = """
CREATE OR REPLACE TEMPORARY FUNCTION dedup_check(
  p_project_id STRING, p_embedding ARRAY<FLOAT>, p_threshold DOUBLE DEFAULT {threshold})
RETURNS TABLE (id STRING, content STRING, similarity DOUBLE, created_by STRING)
RETURN
  SELECT id, content, similarity, created_by
  FROM (
    SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rn
    FROM (
      SELECT m.*, cosine_similarity(m.embedding, p_embedding) AS similarity
      FROM {view} m WHERE m.project_id = p_project_id AND NOT m.archived)
    WHERE similarity > p_threshold)
  WHERE rn <= {limit}
"""


_TOUCH = """
CREATE OR REPLACE TEMPORARY FUNCTION touch_memories(p_ids ARRAY<STRING>, p_as_of {timestamp})
RETURNS TABLE (id STRING, last_accessed_at {timestamp}, access_count INT)
RETURN
  SELECT id, p_as_of, access_count + 1 FROM {view} WHERE array_contains(p_ids, id)
"""

_ARCHIVE = """
CREATE OR REPLACE TEMPORARY FUNCTION archive_stale(p_as_of {timestamp}, p_days INT DEFAULT {days})
RETURNS TABLE (id STRING, project_id STRING, last_accessed_at {timestamp})
RETURN
  SELECT id, project_id, last_accessed_at FROM {view}
  WHERE NOT pinned AND NOT archived AND last_accessed_at < p_as_of - make_dt_interval(p_days)
"""


def register(spark: SparkSession, view: str = "memory") -> None:
    """Create ``recall``, ``dedup_check``, ``touch_memories`` and ``archive_stale``
    as SQL table functions over ``view``.

    ``recall`` searches texts in English or, with ``p_text_config => 'simple'``,
    by plain words; a view with stored lexemes (``tsv``) is not analysed again.
    The last two return the rows a touch or a sweep changes, as they are after
    the touch and as the sweep finds them; nothing is changed in place.

    One call answers one question over a view of the facts; the operators of
    ``factlake.operators.search`` are the way to ask many.
    """
    timestamp = spark.table(view).schema["created_at"].dataType.simpleString()
    spark.sql(_COSINE)
    spark.udf.register("stem_words", stem_english)
    spark.sql(_LEXEMES)
    spark.sql(_ENGLISH.format(stops=", ".join(f"'{w}'" for w in STOP_WORDS_ENGLISH)))
    stored = "tsv" in spark.table(view).columns
    spark.sql(_RECALL.format(
        view=view, timestamp=timestamp, stored="coalesce(tsv, array())" if stored else "english_lexemes(content)",
        parameters=", ".join(f"p_{name} {kind} DEFAULT NULL" for name, (_, kind) in _SCOPE.items()),
        scope=" AND ".join(f"(p_{name} IS NULL OR m.{field} = p_{name})" for name, (field, _) in _SCOPE.items()),
    ))
    spark.sql(_DEDUP.format(view=view, threshold=DEDUP_THRESHOLD, limit=DEDUP_LIMIT))
    spark.sql(_TOUCH.format(view=view, timestamp=timestamp))
    spark.sql(_ARCHIVE.format(view=view, timestamp=timestamp, days=ARCHIVE_AFTER_DAYS))


def touch_memories(spark: SparkSession, ids: DataFrame, as_of, view: str = "memory") -> DataFrame:
    """The state of ``view`` after touching ``ids``."""
    return lifecycle.touch(spark.table(view), ids, as_of)[0]


def archive_stale(
    spark: SparkSession, as_of, days: int = ARCHIVE_AFTER_DAYS, view: str = "memory"
) -> tuple[DataFrame, int]:
    """(the state of ``view`` after the sweep, affected rows)."""
    swept, report = lifecycle.archive_stale(spark.table(view), as_of, days)
    return swept, report.first().affected
