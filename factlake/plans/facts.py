"""A fact table and its companions derived from the raw test tables.

Everything here covers whole tables: every document is a fact with its whole
text, every user turn and every benchmark passage is a question, every event
is an access or a tool call.  The same views exist in SQL in ``oracles.py``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.embed import embed_column
from factlake.operators.projections import with_identity

AS_OF = "2024-02-05 00:00:00"
TODAY = "2024-01-10 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in names}


_SIZES: dict[str, int] = {}


def size(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table, counted once."""
    key = f"{sf_dir}/{name}"
    if key not in _SIZES:
        _SIZES[key] = table(spark, sf_dir, name).count()
    return _SIZES[key]


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click events as accesses of facts: ``call_id, id, ts``."""
    t = _view(spark, sf_dir, "events")
    return spark.sql(
        """
        SELECT event_id AS call_id,
               md5(cast(event_id % {n_documents} AS string)) AS id, ts
        FROM {events} WHERE event_type = 'click'
        """,
        **t,
        n_documents=size(spark, sf_dir, "documents"),
    )


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact per document.

    Authors, projects, repositories, tags, flags and times follow from the
    document's number; six neighbouring documents share a vector, so copies by
    the same and by other authors occur; every seventh has no vector.
    """
    t = _view(spark, sf_dir, "documents", "embeddings")
    t["touched"] = accesses(spark, sf_dir).groupBy("id").agg(
        F.max("ts").alias("la"), F.count(F.lit(1)).alias("ac")
    )
    facts = spark.sql(
        """
        WITH d AS (
          SELECT *, md5(cast(doc_id AS string)) AS id,
                 timestamp_ntz'2024-01-01 00:00:00'
                   + make_dt_interval(cast(doc_id % 25 AS int)) AS born
          FROM {documents}),
        -- Of the numbers alone, so that the texts travel to one join at most.
        beside AS (
          SELECT n.doc_id, v.embedding, t.la, t.ac
          FROM (SELECT DISTINCT doc_id FROM {documents}) n
          LEFT JOIN {touched} t ON t.id = md5(cast(n.doc_id AS string))
          LEFT JOIN {embeddings} v ON v.vec_id = (n.doc_id div 6) % {n_embeddings})
        SELECT d.id, concat('proj-', d.doc_id % 3) AS project_id, d.text AS content,
          CASE WHEN d.doc_id % 7 <> 3 THEN b.embedding END AS embedding,
          element_at(array('alice/code-reviewer', 'alice/architect', 'bob/debugger',
                           'auto/ci-fixer', 'charlie/coder'),
                     cast(1 + (d.doc_id div 7) % 5 AS int)) AS created_by,
          CASE WHEN d.doc_id % 4 <> 0 THEN d.source END AS repo,
          CASE WHEN d.doc_id % 11 = 0 THEN cast(array() AS array<string>)
               ELSE array_compact(array(d.lang,
                 CASE WHEN d.doc_id % 2 = 0 THEN 'architecture' END,
                 CASE WHEN d.doc_id % 3 = 0 THEN 'security' END)) END AS tags,
          CASE WHEN d.doc_id % 20 = 0 THEN 'critical'
               WHEN d.doc_id % 5 = 0 THEN 'high' ELSE 'normal' END AS importance,
          (d.doc_id % 20 = 0 OR d.doc_id % 13 = 0) AS pinned,
          (d.doc_id % 6 = 0) AS archived,
          born AS created_at,
          born + make_dt_interval(cast(d.doc_id % 10 AS int)) AS updated_at,
          greatest(born, coalesce(b.la, born)) AS last_accessed_at,
          cast(coalesce(b.ac, 0) AS int) AS access_count
        FROM d LEFT JOIN beside b ON b.doc_id = d.doc_id
        """,
        **t,
        n_embeddings=size(spark, sf_dir, "embeddings"),
    )
    return with_identity(facts)


def text_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts with vectors made from their texts, so near copies are near."""
    return embed_column(memory(spark, sf_dir).drop("embedding"), "content")


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a line of an import file, some of them broken in one way."""
    t = _view(spark, sf_dir, "documents")
    return spark.sql(
        """
        SELECT doc_id + 1 AS line_no, CASE doc_id % 12
          WHEN 1 THEN concat('{{"content": ', to_json(named_struct('c', text)))
          WHEN 2 THEN to_json(array(text))
          WHEN 3 THEN to_json(named_struct('repo', source))
          WHEN 4 THEN to_json(named_struct('content', '  ', 'repo', source))
          WHEN 5 THEN to_json(named_struct('content', text, 'tags', array(1, 2), 'repo', source))
          WHEN 6 THEN to_json(named_struct('content', text, 'repo', doc_id, 'importance', 'urgent'))
          WHEN 7 THEN to_json(named_struct('content', doc_id))
          WHEN 8 THEN to_json(named_struct('content', text, 'importance', 'high'))
          ELSE to_json(named_struct('content', text, 'tags', array(lang, source),
                                    'repo', source, 'importance', 'normal')) END AS line
        FROM {documents}
        """,
        **t,
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn and every benchmark passage as a search request.

    Scopes vary with the numbers: some name an agent, an engineer, a
    repository or tags, some include archived facts, some are blank.
    """
    t = _view(spark, sf_dir, "conversations", "benchmark", "embeddings")
    return spark.sql(
        """
        WITH q AS (
          SELECT conv_id * 1000 + turn AS query_id, conv_id AS n,
                 conv_id * 8 + turn AS v, text AS question
          FROM {conversations} WHERE role = 'user'
          UNION ALL
          SELECT -1 - item_id, item_id, item_id * 11 + 5, text FROM {benchmark})
        SELECT q.query_id, concat('proj-', q.n % 3) AS project_id, q.question, e.embedding,
          CASE WHEN q.n % 5 = 1 THEN 'bob/debugger' WHEN q.n % 5 = 2 THEN '  ' END AS agent,
          CASE WHEN q.n % 7 = 2 THEN 'alice' END AS engineer,
          CASE WHEN q.n % 11 = 3 THEN concat(' src', q.n % 20, ' ') END AS repo,
          CASE WHEN q.n % 6 = 4 THEN array('architecture', ' ')
               WHEN q.n % 13 = 5 THEN array(' ') END AS tags,
          CASE WHEN q.n % 3 <> 1 THEN 10 END AS limit,
          CASE WHEN q.n % 4 <> 3 THEN 0.2D END AS threshold,
          q.n % 4 = 0 AS include_archived
        FROM q JOIN {embeddings} e ON e.vec_id = q.v % {n_embeddings}
        """,
        **t,
        n_embeddings=size(spark, sf_dir, "embeddings"),
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a fact about to be stored, with a vector of its own."""
    t = _view(spark, sf_dir, "conversations", "embeddings")
    return spark.sql(
        """
        SELECT c.conv_id * 1000 + c.turn AS candidate_id,
               concat('proj-', c.conv_id % 3) AS project_id, c.text AS content, e.embedding,
               element_at(array('alice/code-reviewer', 'bob/debugger', 'charlie/coder'),
                          cast(1 + c.turn % 3 AS int)) AS created_by
        FROM {conversations} c JOIN {embeddings} e
          ON e.vec_id = (c.conv_id * 8 + c.turn) % {n_embeddings}
        """,
        **t,
        n_embeddings=size(spark, sf_dir, "embeddings"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as an ordered log of operations on facts."""
    t = _view(spark, sf_dir, "events")
    return spark.sql(
        """
        SELECT cast(event_id AS string) AS event_id,
          md5(cast(event_id * 7 % {n_documents} AS string)) AS id,
          concat('proj-', (event_id * 7 % {n_documents}) % 3) AS project_id,
          CASE event_type
            WHEN 'click' THEN 'touch'
            WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'recall' ELSE 'promote' END
            WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'pin' ELSE 'unpin' END
            WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'archive' ELSE 'restore' END
            ELSE CASE WHEN user_id % 10 = 0 THEN 'forget' ELSE 'correct' END END AS kind,
          event_id AS seq, ts, concat('agent/', user_id) AS agent,
          CASE WHEN event_type = 'error' THEN concat('corrected by ', event_id) END AS payload
        FROM {events}
        """,
        **t,
        n_documents=size(spark, sf_dir, "documents"),
    )


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as tool invocations."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("tool"),
        F.concat(F.lit("agent/"), F.col("user_id") % 5).alias("agent_id"),
        F.concat(F.lit("proj-"), F.col("user_id") % 3).alias("project_id"),
        F.round(F.col("value") * 10).cast("long").alias("duration_ms"),
        (F.col("event_type") != "error").alias("success"),
    )
