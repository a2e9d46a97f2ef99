"""One query per operator over the derived fact table, with its oracle in SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.functions import scalars as S
from factlake.functions import vectors as V
from factlake.functions.dictionary import grow_dictionary, stem_lexemes
from factlake.functions.embed import HashedWords, embed_column, split_blank
from factlake.functions.text import lexemes, stem_english
from factlake.operators import (
    ann,
    annindex,
    duplicates,
    filters,
    ingest,
    lifecycle,
    listing,
    projections,
    remember,
    reports,
    search,
    textindex,
)
from factlake.plans import facts
from factlake.plans.facts import AS_OF, TODAY
from factlake.plans.oracles import STOP_WORDS, with_views
from factlake.session import fresh_path, materialize
from factlake.sources import json_lines, sql_functions, tables
from factlake.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register a query; ``sql`` reads the named views of ``oracles.py``."""
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return function
    return register


# --- values both engines print alike ------------------------------------------------

def ts(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def sim(column: str = "similarity") -> Column:
    """Similarities have nine decimals already; rounding twice would make ties."""
    return F.col(column).alias("similarity")


def state(df: DataFrame) -> DataFrame:
    """Everything a change can alter, as plain values."""
    return df.select(
        "id", "project_id", "pinned", "archived", "access_count", "importance",
        F.md5("content").alias("content_md5"), F.array_join("tags", ",").alias("tags"),
        ts("updated_at").alias("updated_at"), ts("last_accessed_at").alias("last_accessed_at"),
    )


def sql_state(changes: dict[str, str] | None = None, source: str = "memory m", where: str = "") -> str:
    base = {
        "id": "m.id", "project_id": "m.project_id", "pinned": "m.pinned",
        "archived": "m.archived", "access_count": "m.access_count",
        "importance": "m.importance", "content_md5": "md5(m.content)",
        "tags": "array_to_string(m.tags, ',')", "updated_at": sql_ts("m.updated_at"),
        "last_accessed_at": sql_ts("m.last_accessed_at"), **(changes or {}),
    }
    columns = ", ".join(f"{v} AS {k}" for k, v in base.items())
    return f"SELECT {columns} FROM {source} {where}"


NOW = f"TIMESTAMP '{AS_OF}'"
NOW_TEXT = f"'{AS_OF}.000000'"
ROW = "id, project_id, created_by, repo, importance, pinned, archived, access_count"


def row(df: DataFrame) -> DataFrame:
    return df.select(*ROW.split(", "))


def clicked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all clicked facts, with repeats."""
    return facts.accesses(spark, sf_dir).select("id")


CLICKED = "(SELECT DISTINCT id FROM accesses) c"

# --- sources and sinks -----------------------------------------------------------------


@query("src01_scan_memory",
       f"SELECT {ROW} FROM memory WHERE project_id = 'proj-1' AND NOT archived", "memory")
def _(spark, sf):
    path = fresh_path(spark, "memory")
    tables.write_memory(facts.memory(spark, sf), path)
    return row(tables.scan_memory(spark, path, "proj-1", archived=False))


_VALID = "doc_id % 12 NOT IN (1, 2, 3, 4, 7) AND length(text) <= 2000 AND trim(text) <> ''"


@query("src02_import_entries", f"""
SELECT doc_id + 1 AS ordinal, md5(text) AS content_md5,
  CASE WHEN doc_id % 12 NOT IN (5, 6, 8) THEN lang || ',' || source END AS tags,
  CASE WHEN doc_id % 12 NOT IN (6, 8) THEN source END AS repo,
  CASE WHEN doc_id % 12 = 8 THEN 'high' WHEN doc_id % 12 NOT IN (5, 6) THEN 'normal' END AS importance
FROM documents WHERE {_VALID}""")
def _(spark, sf):
    entries, _ = json_lines.parse_import_lines(facts.import_lines(spark, sf))
    return entries.select("ordinal", F.md5("content").alias("content_md5"),
                          F.array_join("tags", ",").alias("tags"), "repo", "importance")


@query("src02_import_warnings", """
WITH bad AS (
  SELECT doc_id + 1 AS line_no, unnest(CASE
    WHEN doc_id % 12 = 1 THEN ['is not valid JSON, skipping']
    WHEN doc_id % 12 = 2 THEN ['is not a JSON object, skipping']
    WHEN doc_id % 12 IN (3, 4, 7) OR trim(text) = '' THEN ['missing or empty "content" field, skipping']
    WHEN length(text) > 2000 THEN ['content exceeds 2000 chars, skipping']
    WHEN doc_id % 12 = 5 THEN ['has invalid "tags" (expected string[]), ignoring tags']
    WHEN doc_id % 12 = 6 THEN ['has invalid "repo" (expected string), ignoring repo',
                               'has invalid "importance" (expected normal/high/critical), ignoring']
    ELSE [] END) AS note FROM documents)
SELECT line_no, 'line ' || line_no || ' ' || note AS warning FROM bad""")
def _(spark, sf):
    return json_lines.parse_import_lines(facts.import_lines(spark, sf))[1]


@query("src03_read_tool_log", """
SELECT tool, agent_id, count(*) AS calls, cast(sum(duration_ms) AS bigint) AS total_ms,
  count(*) FILTER (NOT success) AS failures, min(strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS first
FROM tools GROUP BY tool, agent_id""", "tools")
def _(spark, sf):
    path = fresh_path(spark, "tool-log")
    log = facts.tool_log(spark, sf)
    log.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")) \
        .write.json(path)
    read = json_lines.read_tool_log(spark, path)
    return read.filter("_corrupt_record IS NULL").groupBy("tool", "agent_id").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("duration_ms").alias("total_ms"),
        F.count_if(~F.col("success")).alias("failures"), F.min(ts("timestamp")).alias("first"),
    )


def _streamed(spark, df: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """``df`` as a stream of files, written in ranges of ``order`` if given."""
    path = fresh_path(spark, name)
    df = df.select(*[
        F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c)
        for c, kind in df.dtypes
    ])
    (df if order is None else df.repartitionByRange(4, order)).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _finish(spark, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    return streams.run_to_end(
        stream, fresh_path(spark, f"{name}-out"), fresh_path(spark, f"{name}-state"), mode
    )


@query("src04_stream_memory_events",
       "SELECT kind, count(*) AS events, count(DISTINCT id) AS ids FROM changes GROUP BY kind",
       "changes")
def _(spark, sf):
    path = fresh_path(spark, "events")
    facts.changes(spark, sf).write.json(path)
    events = _finish(spark, json_lines.stream_memory_events(spark, path), "events")
    return events.groupBy("kind").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("id").alias("ids")
    )


_API = """
id, project_id AS projectId, md5(content) AS content, created_by AS createdBy, engineer,
agent_type AS agentType, repo, array_to_string(tags, ',') AS tags, importance, pinned, archived,
strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS createdAt,
strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS updatedAt,
strftime(last_accessed_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS lastAccessedAt,
access_count AS accessCount"""


def _api_text(df):
    return df.withColumns({"content": F.md5("content"), "tags": F.array_join("tags", ",")})


@query("snk01_export_memories",
       f"SELECT {_API}, CASE WHEN archived THEN 1 ELSE 0 END AS branch FROM memory", "memory")
def _(spark, sf):
    return _api_text(tables.export_memories(facts.memory(spark, sf)))


@query("snk02_append_memories", f"""
{sql_state()} UNION ALL
SELECT md5('new-' || candidate_id), project_id, false, false, 0, 'normal', md5(content), '',
  {NOW_TEXT}, {NOW_TEXT} FROM incoming""", "memory", "incoming")
def _(spark, sf):
    rows = facts.incoming(spark, sf).select(
        F.md5(F.concat(F.lit("new-"), "candidate_id")).alias("id"), "project_id", "content",
        "embedding", "created_by",
    )
    return state(ingest.append_memories(facts.memory(spark, sf), rows, AS_OF))


@query("snk03_snapshot", sql_state({
    "pinned": "m.pinned OR c.id IS NOT NULL",
    "updated_at": f"CASE WHEN c.id IS NULL THEN {sql_ts('m.updated_at')} ELSE {NOW_TEXT} END",
}, f"memory m LEFT JOIN {CLICKED} ON c.id = m.id"), "memory")
def _(spark, sf):
    root = fresh_path(spark, "snapshots")
    tables.write_snapshot(facts.memory(spark, sf), root)
    changed, _ = lifecycle.set_pinned(
        tables.read_snapshot(spark, root), clicked(spark, sf), True, AS_OF
    )
    tables.write_snapshot(changed, root)
    return state(tables.read_snapshot(spark, root))


@query("snk03_changed_buckets", f"""
{sql_state({
    "pinned": "m.pinned OR c.id IS NOT NULL",
    "updated_at": f"CASE WHEN c.id IS NULL THEN {sql_ts('m.updated_at')} ELSE {NOW_TEXT} END",
}, f"memory m LEFT JOIN {CLICKED} ON c.id = m.id")} UNION ALL
SELECT md5('new-' || candidate_id), project_id, false, false, 0, 'normal', md5(content), '',
  {NOW_TEXT}, {NOW_TEXT} FROM incoming""", "memory", "incoming")
def _(spark, sf):
    root = fresh_path(spark, "changes")
    memory = facts.memory(spark, sf)
    tables.write_snapshot(memory, root, bucket_rows=500)
    added = facts.incoming(spark, sf).select(
        F.md5(F.concat(F.lit("new-"), "candidate_id")).alias("id"), "project_id", "content",
        "embedding", "created_by",
    )
    tables.append_snapshot(ingest.append_memories(memory.filter(F.lit(False)), added, AS_OF), root)
    ids = clicked(spark, sf)
    tables.change_snapshot(spark, root, ids, lambda rows: lifecycle.set_pinned(rows, ids, True, AS_OF)[0])
    return state(tables.read_snapshot(spark, root))


# An export states times to the millisecond.
@query("snk04_round_trip", sql_state({
    "last_accessed_at": sql_ts("date_trunc('milliseconds', m.last_accessed_at)"),
}, "memory m"), "memory")
def _(spark, sf):
    path = fresh_path(spark, "export")
    memory = facts.memory(spark, sf)
    tables.write_export(tables.export_memories(memory), path)
    return state(tables.restore_export(spark, path, memory.schema["created_at"].dataType))


# --- projections -------------------------------------------------------------------------

_AGENTS_SQL = """
SELECT conv_id, turn, role, CASE (conv_id + turn) % 8
  WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN role WHEN 3 THEN '/' || role
  WHEN 4 THEN role || '/' WHEN 5 THEN role || '/turn/' || turn
  WHEN 6 THEN ' auto/' || role || ' ' ELSE role || '/turn-' || turn END AS agent
FROM conversations"""


@query("prj01_parse_agent_id", f"""
WITH a AS ({_AGENTS_SQL}), t AS (SELECT *, trim(agent) AS x,
  length(agent) - length(replace(agent, '/', '')) AS slashes FROM a),
e AS (SELECT *, CASE WHEN x = '' THEN 'EMPTY' WHEN slashes = 0 THEN 'NO_SEPARATOR'
  WHEN starts_with(x, '/') THEN 'EMPTY_PREFIX' WHEN ends_with(x, '/') THEN 'EMPTY_SUFFIX'
  WHEN slashes > 1 THEN 'EXTRA_SEPARATOR' END AS error FROM t)
SELECT conv_id, turn, CASE WHEN error IS NULL THEN x END AS created_by,
  CASE WHEN error IS NULL THEN nullif(split_part(x, '/', 1), 'auto') END AS engineer,
  CASE WHEN error IS NULL THEN split_part(x, '/', 2) END AS agent_type, error FROM e""")
def _(spark, sf):
    agents = spark.sql(_AGENTS_SQL.replace("FROM conversations", "FROM {c}"),
                       c=facts.table(spark, sf, "conversations"))
    return agents.select("conv_id", "turn", S.parse_agent_id(F.col("agent")).alias("p")) \
        .select("conv_id", "turn", "p.*")


@query("prj02_to_api_rows", f"SELECT {_API} FROM memory", "memory")
def _(spark, sf):
    return _api_text(projections.to_api_rows(facts.memory(spark, sf)))


_RESULT = """
SELECT r.query_id, r.rank, m.id, md5(m.content) AS content_md5, {similarity} AS similarity,
  m.created_by, m.engineer, m.repo, array_to_string(m.tags, ',') AS tags, m.importance,
  m.pinned, {archived} AS archived, m.access_count
FROM {ranked} r JOIN memory m USING (id)"""


def _result(df):
    return df.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "id",
        F.md5("content").alias("content_md5"), sim(), "created_by", "engineer", "repo",
        F.array_join("tags", ",").alias("tags"), "importance", "pinned", "archived", "access_count",
    )


@query("prj03_to_recall_rows", _RESULT.format(
    similarity="coalesce(similarity, 0)", archived="m.archived", ranked="hybrid_ranked"),
    "hybrid_ranked")
def _(spark, sf):
    found = search.hybrid_recall(facts.memory(spark, sf), facts.questions(spark, sf), config="simple")
    return _result(projections.to_recall_rows(found))


_AGE = """CASE WHEN {s} < 60000 THEN '{young}'
  WHEN {s} < 3600000 THEN ({s} // 60000) || 'm{after}'
  WHEN {s} < 86400000 THEN ({s} // 3600000) || 'h{after}'
  ELSE ({s} // 86400000) || 'd{after}' END"""


def _sql_age(column: str, now: str, young: str = "<1m", after: str = "") -> str:
    millis = f"((epoch_us({now}) - epoch_us({column})) // 1000)"
    return _AGE.format(s=millis, young=young, after=after)


def _sql_line(column: str, width: int) -> str:
    line = f"replace({column}, chr(10), ' ')"
    return (f"CASE WHEN length({line}) <= {width} THEN {line} "
            f"ELSE substring({line}, 1, {width - 3}) || '...' END")


@query("prj04_display_rows", f"""
SELECT id, substring(id, 1, 6) AS short_id, {_sql_line('content', 40)} AS content, created_by,
  CASE WHEN len(tags) > 0 THEN '[' || array_to_string(tags, ', ') || ']' ELSE '' END AS tags,
  CASE WHEN pinned THEN 'yes' ELSE 'no' END AS pinned,
  CASE WHEN archived THEN 'yes' ELSE 'no' END AS archived,
  {_sql_age('created_at', NOW)} AS age,
  {_sql_age('last_accessed_at', NOW, 'just now', ' ago')} AS accessed,
  strftime(last_accessed_at, '%Y-%m-%d %H:%M:%S UTC') AS accessed_at
FROM memory""", "memory")
def _(spark, sf):
    return projections.display_rows(facts.memory(spark, sf), AS_OF)


@query("prj05_promote_view", _RESULT.format(
    similarity="similarity", archived="false", ranked="vector_ranked"), "vector_ranked")
def _(spark, sf):
    found = search.recall_batch(facts.memory(spark, sf), facts.questions(spark, sf))
    return _result(projections.promote_view(found))


# --- filters ---------------------------------------------------------------------------------

def _filter_query(name: str, condition: str, apply: Callable[[DataFrame], DataFrame]) -> None:
    query(name, f"SELECT {ROW} FROM memory WHERE {condition}", "memory")(
        lambda spark, sf: row(apply(facts.memory(spark, sf)))
    )


_filter_query("flt01_by_project", "project_id = 'proj-2'", lambda m: filters.by_project(m, "proj-2"))
_filter_query("flt02_active", "NOT archived", filters.active)
_filter_query(
    "flt03_scopes", "created_by = 'alice/architect' AND engineer = 'alice' AND repo = 'src1'",
    lambda m: filters.by_repo(
        filters.by_engineer(filters.by_agent(m, "alice/architect"), "alice"), "src1"),
)
_filter_query("flt04_has_all_tags", "list_has_all(tags, ['architecture', 'security'])",
              lambda m: filters.has_all_tags(m, ["architecture", "security"]))
_filter_query("flt05_pinned_is", "pinned", lambda m: filters.pinned_is(m, True))
_filter_query("flt06_approaching_stale",
              f"NOT pinned AND NOT archived AND last_accessed_at < {NOW} - INTERVAL 20 DAY",
              lambda m: filters.approaching_stale(m, AS_OF))
_filter_query("flt07_archival_candidates",
              f"NOT pinned AND NOT archived AND last_accessed_at < {NOW} - INTERVAL 30 DAY",
              lambda m: filters.archival_candidates(m, AS_OF))
_filter_query("flt09_text_match", r"""
list_has_all(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'), ['the', 'and', 'of'])""",
              lambda m: filters.text_match(m, "The AND of, the", "simple"))


@query("flt08_above_similarity", """
WITH e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings),
p AS (SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS s
      FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, s AS similarity FROM p WHERE s > 0.05""")
def _(spark, sf):
    return filters.above_similarity(_neighbours(spark, sf), 0.05).select("vec_id", sim())


def _neighbours(spark, sf):
    """Every embedding with the next one."""
    e = facts.table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").withColumn(
        "similarity", V.cosine_similarity(F.col("embedding"), F.col("other"))
    )


@query("flt09_text_match_english", f"""
SELECT {ROW} FROM memory JOIN m_lex_english USING (id) WHERE list_contains(tsv, 'thing')""", "lexed_english")
def _(spark, sf):
    return row(filters.text_match(facts.memory(spark, sf), "the things", "english"))


@query("flt10_normalize_scope", """
SELECT query_id, agent, engineer_q AS engineer, repo_q AS repo, array_to_string(tags_q, ',') AS tags
FROM questions""", "questions")
def _(spark, sf):
    return filters.normalize_scope(facts.questions(spark, sf)).select(
        "query_id", "agent", "engineer", "repo", F.array_join("tags", ",").alias("tags"))


_UTF16 = r"(length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')))"
_REASON = f"CASE WHEN trim(text) = '' THEN 'CONTENT_EMPTY' WHEN {_UTF16} > 2000 THEN 'CONTENT_TOO_LONG' END"


@query("flt11_validate_content", f"SELECT doc_id, coalesce({_REASON}, 'OK') AS reason FROM documents")
def _(spark, sf):
    docs = facts.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    valid, rejected = filters.validate_content(docs)
    return valid.select("doc_id", F.lit("OK").alias("reason")).unionByName(
        rejected.select("doc_id", "reason"))


@query("flt12_validate_importance", """
SELECT doc_id, 'IMPORTANCE_INVALID' AS reason FROM documents
WHERE source NOT IN ('normal', 'high', 'critical') AND doc_id % 4 <> 0""")
def _(spark, sf):
    docs = facts.table(spark, sf, "documents").select(
        "doc_id", F.expr("CASE WHEN doc_id % 4 = 0 THEN 'high' ELSE source END").alias("importance"))
    return filters.validate_importance(docs)[1].select("doc_id", "reason")


@query("flt13_validate_queries", """
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'QUESTION_EMPTY'
  WHEN turn % 4 = 1 AND conv_id % 2 = 0 THEN 'LIMIT_NOT_POSITIVE'
  WHEN conv_id % 3 = 0 THEN 'THRESHOLD_OUT_OF_RANGE' END AS reason
FROM conversations
WHERE turn % 4 = 0 OR (turn % 4 = 1 AND conv_id % 2 = 0) OR conv_id % 3 = 0""")
def _(spark, sf):
    asked = facts.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "CASE WHEN turn % 4 = 0 THEN '' ELSE text END AS question",
        "CASE WHEN turn % 4 = 1 AND conv_id % 2 = 0 THEN 0 ELSE 5 END AS limit",
        "CASE WHEN conv_id % 3 = 0 THEN 1.5D ELSE 1D END AS threshold")
    return filters.validate_queries(asked)[1].select("conv_id", "turn", "reason")


# --- search and joins --------------------------------------------------------------------------

def _vector(spark, sf, vec_id: int = 204) -> list[float]:
    """The vector of one question."""
    e = facts.table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id)
    return list(e.first().embedding)


@query("jn01_recall", """
, usable AS MATERIALIZED (SELECT * FROM memory WHERE embedding IS NOT NULL
    AND project_id = 'proj-0' AND NOT archived),
s AS (SELECT m.id, m.created_by, round(list_cosine_similarity(m.embedding, e.embedding::double[]), 9) AS x
  FROM usable m, embeddings e WHERE e.vec_id = 204)
SELECT id, created_by, x AS similarity FROM s WHERE x > 0.2 ORDER BY x DESC, id LIMIT 10""",
       "memory")
def _(spark, sf):
    found = search.recall(facts.memory(spark, sf), _vector(spark, sf), "proj-0", threshold=0.2)
    return found.select("id", "created_by", sim())


@query("jn02_recall_batch", _RESULT.format(
    similarity="similarity", archived="m.archived", ranked="vector_ranked"), "vector_ranked")
def _(spark, sf):
    return _result(search.recall_batch(facts.memory(spark, sf), facts.questions(spark, sf)))


@query("jn03_hybrid_recall", _RESULT.format(
    similarity="similarity", archived="m.archived", ranked="hybrid_ranked"), "hybrid_ranked")
def _(spark, sf):
    return _result(search.hybrid_recall(facts.memory(spark, sf), facts.questions(spark, sf), config="simple"))


@query("jn03_hybrid_recall_english", _RESULT.format(
    similarity="similarity", archived="m.archived", ranked="english_ranked"), "english_ranked")
def _(spark, sf):
    return _result(search.hybrid_recall(facts.memory(spark, sf), facts.questions(spark, sf)))


@query("jn04_recall_with_side_effects", """
, hits AS (SELECT id, count(*) AS n,
    bool_or(include_archived) AS rescue FROM hybrid_ranked JOIN questions USING (query_id) GROUP BY id)
""" + sql_state({
    "archived": "m.archived AND NOT coalesce(h.rescue, false)",
    "access_count": "cast(m.access_count + coalesce(h.n, 0) AS int)",
    "updated_at": f"CASE WHEN m.archived AND h.rescue THEN {NOW_TEXT} ELSE {sql_ts('m.updated_at')} END",
    "last_accessed_at": f"CASE WHEN h.id IS NOT NULL THEN {NOW_TEXT} ELSE {sql_ts('m.last_accessed_at')} END",
}, "memory m LEFT JOIN hits h ON h.id = m.id"), "hybrid_ranked")
def _(spark, sf):
    _, after = search.recall_with_side_effects(
        facts.memory(spark, sf), facts.questions(spark, sf), AS_OF, config="simple")
    return state(after)


@query("jn05_dedup_check", """
SELECT candidate_id, rank, id, similarity, created_by FROM dedup""", "dedup")
def _(spark, sf):
    found = search.dedup_check(facts.memory(spark, sf), facts.incoming(spark, sf))
    return found.select("candidate_id", F.col("rank").cast("long").alias("rank"), "id", sim(), "created_by")


@query("jn06_near_duplicates", """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, match_id) AS rank
             FROM pairs)
SELECT id, rank, match_id, similarity FROM ranked WHERE rank <= 3""", "pairs")
def _(spark, sf):
    return duplicates.near_duplicates(facts.memory(spark, sf)).select(
        "id", F.col("rank").cast("long").alias("rank"), "match_id", sim())


@query("jn07_duplicate_clusters", """
, reach AS (
  SELECT id, match_id FROM pairs UNION SELECT r.id, p.match_id FROM reach r JOIN pairs p ON p.id = r.match_id)
SELECT r.id, min(m.project_id) AS project_id, min(r.match_id) AS cluster_id
FROM reach r JOIN memory m USING (id) GROUP BY r.id""", "pairs")
def _(spark, sf):
    return duplicates.duplicate_clusters(facts.memory(spark, sf))


@query("jn08_ann_recall")
def _(spark, sf):
    return _result(ann.ann_recall(
        facts.memory(spark, sf), facts.questions(spark, sf), n_cells=16, n_probe=4))


@query("jn08_ann_all_cells", _RESULT.format(
    similarity="similarity", archived="m.archived", ranked="vector_ranked"), "vector_ranked")
def _(spark, sf):
    return _result(ann.ann_recall(
        facts.memory(spark, sf), facts.questions(spark, sf), n_cells=8, n_probe=8))


def _index_with_given_centres(spark, sf):
    """An index whose centres are the first twenty vectors by id: stored with some facts
    under other scopes and others missing, then told of both."""
    memory = facts.memory(spark, sf)
    first = memory.filter("embedding IS NOT NULL").orderBy("id").limit(20)
    n = F.row_number().over(Window.orderBy("id")) - 1
    centres = materialize(first.select(n.alias("n"), F.col("embedding").alias("vec")), "given").select(
        F.when(F.col("n") < 4, F.col("n")).otherwise((F.col("n") - 4) % 4).alias("coarse"),
        F.when(F.col("n") < 4, -1).otherwise(F.floor((F.col("n") - 4) / 4)).alias("fine"), "vec")
    root = fresh_path(spark, "ann-index")
    annindex.write_index(
        memory.filter("id < '8'").withColumn("archived", (F.col("id") < "4") == F.col("archived")), root,
        centres=centres)
    annindex.update_index(memory.filter("id >= '4'"), root)
    return memory, root


_GIVEN_CELLS_SQL = """
, numbered_vectors AS (
  SELECT embedding, row_number() OVER (ORDER BY id) - 1 AS n FROM memory WHERE embedding IS NOT NULL),
cell_centres AS MATERIALIZED (
  SELECT CASE WHEN n < 4 THEN n ELSE (n - 4) % 4 END AS coarse,
         CASE WHEN n < 4 THEN -1 ELSE (n - 4) // 4 END AS fine, embedding AS cvec
  FROM numbered_vectors WHERE n < 20),
fact_coarse AS MATERIALIZED (SELECT id, embedding, coarse FROM (
  SELECT m.id, m.embedding, c.coarse, row_number() OVER (PARTITION BY m.id
    ORDER BY round(list_cosine_similarity(m.embedding, c.cvec), 9) DESC, c.coarse) AS o
  FROM memory m, cell_centres c WHERE c.fine = -1 AND m.embedding IS NOT NULL) WHERE o = 1),
fact_cell AS MATERIALIZED (SELECT id, coarse, fine FROM (
  SELECT f.id, c.coarse, c.fine, row_number() OVER (PARTITION BY f.id
    ORDER BY round(list_cosine_similarity(f.embedding, c.cvec), 9) DESC, c.fine) AS o
  FROM fact_coarse f JOIN cell_centres c ON c.coarse = f.coarse AND c.fine >= 0) WHERE o = 1),
question_coarse AS MATERIALIZED (SELECT query_id, qvec, coarse FROM (
  SELECT q.query_id, q.qvec, c.coarse, row_number() OVER (PARTITION BY q.query_id
    ORDER BY round(list_cosine_similarity(q.qvec, c.cvec), 9) DESC, c.coarse) AS o
  FROM questions q, cell_centres c WHERE c.fine = -1) WHERE o <= 2),
question_cell AS MATERIALIZED (SELECT query_id, coarse, fine FROM (
  SELECT q.query_id, c.coarse, c.fine, row_number() OVER (PARTITION BY q.query_id
    ORDER BY round(list_cosine_similarity(q.qvec, c.cvec), 9) DESC, c.coarse, c.fine) AS o
  FROM question_coarse q JOIN cell_centres c ON c.coarse = q.coarse AND c.fine >= 0) WHERE o <= 3),
cell_ranked AS (SELECT * FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY similarity DESC, s.id) AS rank
  FROM scored s JOIN fact_cell f ON f.id = s.id
  JOIN question_cell c ON c.query_id = s.query_id AND c.coarse = f.coarse AND c.fine = f.fine
  WHERE similarity > threshold) WHERE rank <= k)"""


@query("jn08_stored_index", _GIVEN_CELLS_SQL + _RESULT.format(
    similarity="similarity", archived="m.archived", ranked="cell_ranked"), "vector_ranked")
def _(spark, sf):
    memory, root = _index_with_given_centres(spark, sf)
    return _result(annindex.indexed_recall(memory, facts.questions(spark, sf), root, n_coarse=2, n_probe=3))


@query("jn09_stored_index_recall", _GIVEN_CELLS_SQL + """
SELECT count(*) AS exact_hits, count(c.id) AS found_hits, count(c.id) / count(*) AS recall_at_k
FROM vector_ranked v LEFT JOIN cell_ranked c ON c.query_id = v.query_id AND c.id = v.id""", "vector_ranked")
def _(spark, sf):
    memory, root = _index_with_given_centres(spark, sf)
    asked = facts.questions(spark, sf)
    found = materialize(annindex.indexed_recall(memory, asked, root, n_coarse=2, n_probe=3), "found")
    return ann.recall_at_k(found, search.recall_batch(memory, asked))


@query("jn08_learnt_index")
def _(spark, sf):
    memory, root = facts.memory(spark, sf), fresh_path(spark, "ann-index")
    annindex.write_index(memory, root, cell_rows=256)
    return _result(annindex.indexed_recall(memory, facts.questions(spark, sf), root))


@query("jn09_recall_at_k")
def _(spark, sf):
    memory, asked = facts.memory(spark, sf), facts.questions(spark, sf)
    approx = materialize(ann.ann_recall(memory, asked, n_cells=16, n_probe=4), "approx")
    return ann.recall_at_k(approx, search.recall_batch(memory, asked))


_KEYS_SQL = """
SELECT DISTINCT CASE doc_id % 5
  WHEN 0 THEN md5(cast(doc_id AS {text})) WHEN 1 THEN substring(md5(cast(doc_id AS {text})), 1, 8)
  WHEN 2 THEN substring(md5(cast(doc_id AS {text})), 1, 2)
  WHEN 3 THEN substring(md5(cast(doc_id AS {text})), 1, 6)
  ELSE concat('zz', md5(cast(doc_id AS {text}))) END AS key FROM {docs}"""


@query("jn10_resolve_ids", """
, keys AS (""" + _KEYS_SQL.format(text="varchar", docs="documents") + """),
exact AS (SELECT key FROM keys JOIN memory ON id = key),
open AS (SELECT key FROM keys WHERE key NOT IN (SELECT key FROM exact)),
hits AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS n
         FROM open JOIN memory ON starts_with(id, key)),
found AS (SELECT key, max(n) AS c FROM hits WHERE n <= 10 GROUP BY key)
SELECT key, 'exact' AS status, key AS id FROM exact UNION ALL
SELECT o.key, CASE WHEN c IS NULL THEN 'missing' WHEN c = 1 THEN 'unique' ELSE 'ambiguous' END, h.id
FROM open o LEFT JOIN found f USING (key) LEFT JOIN hits h ON h.key = o.key AND h.n <= 10""", "memory")
def _(spark, sf):
    keys = spark.sql(_KEYS_SQL.replace("{docs}", "{d}").replace("{text}", "string"),
                     d=facts.table(spark, sf, "documents"))
    return search.resolve_ids(facts.memory(spark, sf), keys)


@query("jn11_get_by_ids", """
, asked AS (SELECT DISTINCT md5(cast(event_id AS varchar)) AS id FROM events)
SELECT a.id, CASE WHEN m.id IS NULL THEN 'missing' ELSE 'found' END AS status
FROM asked a LEFT JOIN memory m ON m.id = a.id""", "memory")
def _(spark, sf):
    ids = facts.table(spark, sf, "events").select(F.md5(F.col("event_id").cast("string")).alias("id"))
    found, missing = search.get_by_ids(facts.memory(spark, sf), ids)
    return found.select("id", F.lit("found").alias("status")).unionByName(
        missing.select("id", F.lit("missing").alias("status")))


@query("jn12_cross_agent_corroboration", """
, ranked AS (SELECT *, row_number() OVER (
    PARTITION BY id, other_author ORDER BY similarity DESC, match_id) AS n
  FROM pairs WHERE other_author <> created_by)
SELECT id, project_id, created_by, other_author, match_id, similarity
FROM ranked WHERE n = 1""", "pairs")
def _(spark, sf):
    return duplicates.cross_agent_corroboration(facts.memory(spark, sf)).withColumn("similarity", sim())


_TEXT_PAIRS = """
SELECT q.query_id, m.id
FROM questions q JOIN q_lex USING (query_id) JOIN memory m USING (project_id) JOIN m_lex USING (id)
WHERE len(terms) > 0 AND list_has_all(tsv, terms)"""


def _text_index(spark, sf):
    path = fresh_path(spark, "text-index")
    textindex.write_text_index(facts.memory(spark, sf), path)
    return textindex.read_text_index(spark, path)


@query("txt03_text_search", _TEXT_PAIRS, "lexed")
def _(spark, sf):
    return textindex.text_search(_text_index(spark, sf), facts.questions(spark, sf), "simple")


@query("txt03_text_and_tags", _TEXT_PAIRS + """
  AND (q.tags_q IS NULL OR list_has_all(m.tags, q.tags_q))""", "lexed")
def _(spark, sf):
    return textindex.text_search(_text_index(spark, sf), facts.questions(spark, sf), "simple", tags=True)


# --- changes ---------------------------------------------------------------------------------------

@query("mut01_remember_batch", """
SELECT seq, id, action FROM remembered
UNION ALL SELECT candidate_id, NULL, 'reject' FROM incoming
WHERE trim(content) = '' OR length(content) > 2000""", "remembered")
def _(spark, sf):
    _, report = remember.remember_batch(facts.memory(spark, sf), _arriving(spark, sf), AS_OF)
    return report.select("seq", "id", "action")


_LEFT_BEHIND = """, held AS (
  SELECT id, arg_max(content, seq) AS content, arg_max(importance, seq) FILTER (importance IS NOT NULL) AS importance,
    CASE WHEN arg_max(action, seq) = 'insert_corroborated' THEN 'new,corroborated' ELSE 'new' END AS tags,
    bool_or(action <> 'update') AS born, any_value(project_id) AS project_id,
    coalesce(bool_or(action <> 'update' AND importance = 'critical'), false) AS pinned
  FROM remembered GROUP BY id)
"""


@query("mut01_remember_table", f"""{_LEFT_BEHIND}
{sql_state({"importance": "coalesce(h.importance, m.importance)",
            "content_md5": "md5(coalesce(h.content, m.content))",
            "tags": "coalesce(h.tags, array_to_string(m.tags, ','))",
            "updated_at": f"CASE WHEN h.id IS NULL THEN {sql_ts('m.updated_at')} ELSE {NOW_TEXT} END"},
           "memory m LEFT JOIN held h USING (id)")}
UNION ALL SELECT id, project_id, pinned, false, 0, coalesce(importance, 'normal'), md5(content), tags,
  {NOW_TEXT}, {NOW_TEXT} FROM held WHERE born""", "remembered")
def _(spark, sf):
    after, _ = remember.remember_batch(facts.memory(spark, sf), _arriving(spark, sf), AS_OF)
    return state(after)


def _arriving(spark, sf):
    return facts.incoming(spark, sf).select(
        F.col("candidate_id").alias("seq"), "project_id", "content", "embedding", "created_by",
        F.array(F.lit("new")).alias("tags"), F.lit(None).cast("string").alias("repo"),
        F.when(F.col("candidate_id") % 3 == 0, "critical").alias("importance"))


@query("mut02_decide_action", """
SELECT i.candidate_id, d.id AS match_id, CASE WHEN d.id IS NULL THEN 'insert'
  WHEN d.created_by = i.author THEN 'update' ELSE 'insert_corroborated' END AS action
FROM incoming i LEFT JOIN dedup d ON d.candidate_id = i.candidate_id AND d.rank = 1""", "dedup")
def _(spark, sf):
    candidates = facts.incoming(spark, sf)
    matches = search.dedup_check(facts.memory(spark, sf), candidates)
    return ingest.decide_action(candidates, matches).select("candidate_id", "match_id", "action")


def _turns(spark, sf):
    """The turns of all conversations as entries of an import, with their vectors."""
    return facts.incoming(spark, sf).select(
        F.col("candidate_id").alias("ordinal"), "content", F.array(F.lit("turn")).alias("tags"),
        F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("importance"),
        "embedding")


def _import(spark, sf):
    return ingest.import_batch(
        facts.memory(spark, sf), _turns(spark, sf), "proj-1", "bob/debugger", AS_OF,
        on_invalid="drop")


@query("mut03_import_batch", """
SELECT ordinal, CASE WHEN accepted THEN 'imported' ELSE 'skipped' END AS outcome FROM imported
UNION ALL SELECT candidate_id, 'error' FROM incoming
WHERE trim(content) = '' OR length(content) > 2000""", "imported")
def _(spark, sf):
    return _import(spark, sf)[1].select("ordinal", "outcome")


_AFTER_IMPORT = """
SELECT project_id, md5(content) AS content_md5, created_by, array_to_string(tags, ',') AS tags FROM memory
UNION ALL SELECT 'proj-1', md5(content), 'bob/debugger',
  CASE WHEN other IS NULL THEN 'turn' ELSE 'turn,corroborated' END FROM imported WHERE accepted"""


def _after_import(df):
    return df.select("project_id", F.md5("content").alias("content_md5"), "created_by",
                     F.array_join("tags", ",").alias("tags"))


@query("mut03_import_rows", _AFTER_IMPORT, "imported")
def _(spark, sf):
    return _after_import(_import(spark, sf)[0])


@query("mut03_import_texts")
def _(spark, sf):
    entries = facts.table(spark, sf, "documents").select(
        F.col("doc_id").alias("ordinal"), F.col("text").alias("content"),
        F.array("lang").alias("tags"), F.col("source").alias("repo"),
        F.lit(None).cast("string").alias("importance"))
    return ingest.import_batch(
        facts.text_memory(spark, sf), entries, "proj-0", "alice/architect", AS_OF,
        max_len=None, on_invalid="drop")[1]


@query("mut04_touch", sql_state({
    "access_count": "cast(m.access_count + CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS int)",
    "last_accessed_at": f"CASE WHEN c.id IS NULL THEN {sql_ts('m.last_accessed_at')} ELSE {NOW_TEXT} END",
}, f"memory m LEFT JOIN {CLICKED} ON c.id = m.id"), "memory")
def _(spark, sf):
    return state(lifecycle.touch(facts.memory(spark, sf), clicked(spark, sf), AS_OF)[0])


@query("mut05_fold_access_log", """
, folded AS (SELECT md5(cast(event_id * 3 % (SELECT count(*) FROM documents) AS varchar)) AS id,
    count(DISTINCT user_id) AS hits, max(ts) AS last_ts FROM events GROUP BY 1)
""" + sql_state({
    "access_count": "cast(m.access_count + coalesce(f.hits, 0) AS int)",
    "last_accessed_at": sql_ts("greatest(m.last_accessed_at, coalesce(f.last_ts, m.last_accessed_at))"),
}, "memory m LEFT JOIN folded f ON f.id = m.id"), "memory")
def _(spark, sf):
    n = facts.size(spark, sf, "documents")
    touches = facts.table(spark, sf, "events").select(
        F.col("user_id").alias("call_id"), "ts",
        F.md5((F.col("event_id") * 3 % n).cast("string")).alias("id"))
    return state(lifecycle.fold_access_log(facts.memory(spark, sf), touches)[0])


def _flagged(column: str, value: str) -> str:
    return sql_state({
        column: f"CASE WHEN c.id IS NULL THEN m.{column} ELSE {value} END",
        "updated_at": f"CASE WHEN c.id IS NULL THEN {sql_ts('m.updated_at')} ELSE {NOW_TEXT} END",
    }, f"memory m LEFT JOIN {CLICKED} ON c.id = m.id")


@query("mut06_set_pinned", _flagged("pinned", "true"), "memory")
def _(spark, sf):
    return state(lifecycle.set_pinned(facts.memory(spark, sf), clicked(spark, sf), True, AS_OF)[0])


@query("mut07_set_archived", _flagged("archived", "false"), "memory")
def _(spark, sf):
    return state(lifecycle.set_archived(facts.memory(spark, sf), clicked(spark, sf), False, AS_OF)[0])


_STALE = f"(NOT m.pinned AND NOT m.archived AND m.last_accessed_at < {NOW} - INTERVAL 30 DAY)"


@query("mut08_archive_stale", sql_state({
    "archived": f"m.archived OR {_STALE}",
    "updated_at": f"CASE WHEN {_STALE} THEN {NOW_TEXT} ELSE {sql_ts('m.updated_at')} END",
}), "memory")
def _(spark, sf):
    return state(lifecycle.archive_stale(facts.memory(spark, sf), AS_OF)[0])


@query("mut08_archive_stale_count",
       f"SELECT count(*) AS affected FROM memory m WHERE {_STALE}", "memory")
def _(spark, sf):
    return lifecycle.archive_stale(facts.memory(spark, sf), AS_OF)[1]


@query("mut09_promote", sql_state({
    "archived": "m.archived AND c.id IS NULL",
    "updated_at": f"CASE WHEN m.archived AND c.id IS NOT NULL THEN {NOW_TEXT} "
                  f"ELSE {sql_ts('m.updated_at')} END",
}, f"memory m LEFT JOIN {CLICKED} ON c.id = m.id"), "memory")
def _(spark, sf):
    return state(lifecycle.promote(facts.memory(spark, sf), clicked(spark, sf), AS_OF)[0])


@query("mut10_forget", sql_state(where="WHERE m.id NOT IN (SELECT id FROM accesses)"), "memory")
def _(spark, sf):
    return state(lifecycle.forget(facts.memory(spark, sf), clicked(spark, sf))[0])


def _corrections(spark, sf):
    return clicked(spark, sf).distinct().select("id", F.concat(F.lit("fixed "), "id").alias("new_content"))


@query("mut11_correct", sql_state({
    "content_md5": "md5(CASE WHEN c.id IS NULL THEN m.content ELSE 'fixed ' || m.id END)",
    "updated_at": f"CASE WHEN c.id IS NULL THEN {sql_ts('m.updated_at')} ELSE {NOW_TEXT} END",
}, f"memory m LEFT JOIN {CLICKED} ON c.id = m.id"), "memory")
def _(spark, sf):
    return state(lifecycle.correct(facts.memory(spark, sf), _corrections(spark, sf), AS_OF)[0])


@query("mut12_refresh_tsv",
       "SELECT id, len(tsv) AS lexemes, md5(array_to_string(list_sort(tsv), ' ')) AS tsv_md5 FROM m_lex",
       "lexed")
def _(spark, sf):
    return textindex.refresh_tsv(facts.memory(spark, sf), "simple").select(
        "id", F.size("tsv").cast("long").alias("lexemes"),
        F.md5(F.array_join(F.array_sort("tsv"), " ")).alias("tsv_md5"))


@query("mut13_re_embed")
def _(spark, sf):
    moved, _ = lifecycle.re_embed(facts.memory(spark, sf), HashedWords(32))
    return moved.select("id", "embedding_model", F.size("embedding").alias("dimensions"),
                        F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query("mut14_replay_events", """
, s AS (SELECT id,
    arg_max(kind = 'pin', seq) FILTER (kind IN ('pin', 'unpin')) AS p,
    arg_max(kind = 'archive', seq) FILTER (kind IN ('archive', 'restore', 'promote')) AS a,
    arg_max(payload, seq) FILTER (kind = 'correct') AS c,
    max(ts) FILTER (kind NOT IN ('touch', 'recall', 'forget')) AS u,
    max(ts) FILTER (kind = 'touch') AS t,
    count(*) FILTER (kind = 'touch') AS n, bool_or(kind = 'forget') AS gone
  FROM changes GROUP BY id)
""" + sql_state({
    "pinned": "coalesce(s.p, m.pinned)", "archived": "coalesce(s.a, m.archived)",
    "content_md5": "md5(coalesce(s.c, m.content))",
    "updated_at": sql_ts("coalesce(s.u, m.updated_at)"),
    "last_accessed_at": sql_ts("greatest(m.last_accessed_at, coalesce(s.t, m.last_accessed_at))"),
    "access_count": "cast(m.access_count + coalesce(s.n, 0) AS int)",
}, "memory m LEFT JOIN s ON s.id = m.id", "WHERE NOT coalesce(s.gone, false)"), "memory", "changes")
def _(spark, sf):
    return state(lifecycle.replay_events(facts.memory(spark, sf), facts.changes(spark, sf))[0])


@query("mut15_set_tags", sql_state({
    "tags": """CASE WHEN c.id IS NULL THEN array_to_string(m.tags, ',') ELSE array_to_string(
      list_filter(list_concat(m.tags, ['reviewed']), lambda x: x <> 'security'), ',') END""",
    "updated_at": f"CASE WHEN c.id IS NULL THEN {sql_ts('m.updated_at')} ELSE {NOW_TEXT} END",
}, f"memory m LEFT JOIN {CLICKED} ON c.id = m.id"), "memory")
def _(spark, sf):
    edits = clicked(spark, sf).distinct().select(
        "id", F.array(F.lit("reviewed")).alias("add"), F.array(F.lit("security")).alias("remove"))
    return state(lifecycle.set_tags(facts.memory(spark, sf), edits, AS_OF)[0])


# --- reports ---------------------------------------------------------------------------------------

_COUNTS = """count(*) FILTER (NOT archived) AS active, count(*) FILTER (archived) AS archived,
count(*) FILTER (pinned) AS pinned"""


@query("agg01_counts", f"SELECT 'proj-1' AS project_id, {_COUNTS} FROM memory WHERE project_id = 'proj-1'",
       "memory")
def _(spark, sf):
    return reports.counts(facts.memory(spark, sf), "proj-1")


@query("agg02_stats_counts",
       f"SELECT project_id, count(*) AS total, {_COUNTS} FROM memory GROUP BY project_id", "memory")
def _(spark, sf):
    return reports.stats_counts(facts.memory(spark, sf))


_BY_ENGINEER = """SELECT project_id, coalesce(engineer, 'auto') AS engineer, count(*) AS count,
count(*) FILTER (pinned) AS pinned FROM memory WHERE NOT archived GROUP BY 1, 2"""
_BY_REPO = """SELECT project_id, coalesce(repo, '(no repo)') AS repo, count(*) AS count
FROM memory WHERE NOT archived GROUP BY 1, 2"""
_TAGS = """SELECT project_id, tag, count(*) AS count
FROM (SELECT project_id, unnest(tags) AS tag FROM memory WHERE NOT archived) GROUP BY 1, 2"""
_METRICS = """count(*) FILTER (NOT pinned AND NOT archived
    AND last_accessed_at < {now} - INTERVAL 20 DAY) AS approaching_stale,
  count(*) FILTER (archived AND updated_at > {now} - INTERVAL 7 DAY) AS archived_last_7_days,
  count(*) FILTER (created_at > date_trunc('day', {now})) AS created_today"""


@query("agg03_by_engineer", _BY_ENGINEER, "memory")
def _(spark, sf):
    return reports.by_engineer(facts.memory(spark, sf))


@query("agg04_by_repo", _BY_REPO, "memory")
def _(spark, sf):
    return reports.by_repo(facts.memory(spark, sf))


@query("agg05_top_tags", f"""
SELECT * FROM ({_TAGS}) WHERE project_id = 'proj-0' ORDER BY count DESC, tag LIMIT 10""", "memory")
def _(spark, sf):
    return reports.top_tags(facts.memory(spark, sf), "proj-0")


@query("agg06_archival_metrics", f"""
SELECT project_id, {_METRICS.format(now=f"TIMESTAMP '{TODAY}'")} FROM memory GROUP BY project_id""",
       "memory")
def _(spark, sf):
    return reports.archival_metrics(facts.memory(spark, sf), TODAY)


@query("agg07_most_accessed", """
SELECT project_id, id, md5(content) AS content_md5, access_count FROM memory
WHERE project_id = 'proj-2' AND NOT archived ORDER BY access_count DESC, id LIMIT 3""", "memory")
def _(spark, sf):
    return reports.most_accessed(facts.memory(spark, sf), "proj-2").select(
        "project_id", "id", F.md5("content").alias("content_md5"), "access_count")


def _listed(inner: str, text: str, order: str, name: str) -> str:
    return (f"{name} AS (SELECT project_id, string_agg({text}, ';' ORDER BY {order}) AS {name} "
            f"FROM ({inner}) GROUP BY project_id)")


@query("agg08_dashboard", f"""
, base AS (SELECT project_id, count(*) AS total, {_COUNTS}, {_METRICS.format(now=NOW)}
  FROM memory GROUP BY project_id),
{_listed(_BY_ENGINEER, "engineer || '=' || count || '/' || pinned", "count DESC, engineer", "by_engineer")},
{_listed(_BY_REPO, "repo || '=' || count", "count DESC, repo", "by_repo")},
{_listed(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY count DESC, tag) AS n FROM ({_TAGS})) WHERE n <= 10",
         "tag || '=' || count", "count DESC, tag", "top_tags")},
{_listed("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY access_count DESC, id) AS n FROM memory WHERE NOT archived) WHERE n <= 3",
         "id || '=' || access_count", "access_count DESC, id", "most_accessed")}
SELECT * FROM base LEFT JOIN by_engineer USING (project_id) LEFT JOIN by_repo USING (project_id)
LEFT JOIN top_tags USING (project_id) LEFT JOIN most_accessed USING (project_id)""", "memory")
def _(spark, sf):
    def text(name, entry):
        return F.array_join(F.transform(name, entry), ";")

    board = reports.dashboard(facts.memory(spark, sf), AS_OF)
    return board.withColumns({
        "by_engineer": text("by_engineer", lambda e: F.concat(
            e["engineer"], F.lit("="), e["count"], F.lit("/"), e["pinned"])),
        "by_repo": text("by_repo", lambda e: F.concat(e["repo"], F.lit("="), e["count"])),
        "top_tags": text("top_tags", lambda e: F.concat(e["tag"], F.lit("="), e["count"])),
        "most_accessed": text("most_accessed", lambda e: F.concat(
            e["id"], F.lit("="), e["access_count"])),
    })


@query("agg09_growth_rate", """
SELECT project_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS facts FROM memory GROUP BY 1, 2""",
       "memory")
def _(spark, sf):
    return reports.growth_rate(facts.memory(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("agg10_search_quality", """
SELECT q.project_id, count(*) AS results, round(avg(similarity), 6) AS mean_similarity
FROM vector_ranked r JOIN questions q USING (query_id) GROUP BY 1""", "vector_ranked")
def _(spark, sf):
    asked = facts.questions(spark, sf)
    found = search.recall_batch(facts.memory(spark, sf), asked)
    return reports.search_quality(found, asked).withColumn(
        "mean_similarity", F.round("mean_similarity", 6))


@query("agg11_archival_health", """
SELECT project_id, active, archived, round(active / nullif(archived, 0), 6) AS active_per_archived
FROM (SELECT project_id, count(*) FILTER (NOT archived) AS active,
        count(*) FILTER (archived) AS archived FROM memory GROUP BY 1)""", "memory")
def _(spark, sf):
    return reports.archival_health(facts.memory(spark, sf)).withColumn(
        "active_per_archived", F.round("active_per_archived", 6))


@query("agg12_hot_memories", """
SELECT id, project_id, access_count FROM memory
WHERE NOT archived AND NOT pinned AND access_count >= 2""", "memory")
def _(spark, sf):
    return reports.hot_memories(facts.memory(spark, sf), 2)


@query("agg13_orphaned", f"""
SELECT {ROW} FROM memory WHERE access_count = 0
AND created_at <= TIMESTAMP '{TODAY}' - INTERVAL 7 DAY""", "memory")
def _(spark, sf):
    return row(reports.orphaned(facts.memory(spark, sf), TODAY))


@query("agg14_corroboration_score", """
SELECT u.id, count(DISTINCT p.other_author) FILTER (p.other_author <> u.created_by) AS score
FROM usable u LEFT JOIN pairs p ON p.id = u.id GROUP BY u.id""", "pairs")
def _(spark, sf):
    return duplicates.corroboration_score(facts.memory(spark, sf))


@query("agg15_event_counts", f"""
SELECT project_id, count(*) FILTER (kind = 'promote') AS promoted_from_archive,
  count(*) FILTER (kind = 'recall' AND ts >= TIMESTAMP '2024-01-10') AS searches_today
FROM changes GROUP BY project_id""", "changes")
def _(spark, sf):
    return reports.event_counts(facts.changes(spark, sf), TODAY)


@query("agg16_tool_log_report", """
SELECT tool, agent_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS hour,
  count(*) AS calls, count(*) FILTER (NOT success) AS failures,
  round(avg(duration_ms), 6) AS mean_ms, round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms,
  round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms, max(duration_ms) AS max_ms,
  round(count(*) FILTER (NOT success) / count(*), 6) AS error_rate
FROM tools GROUP BY 1, 2, 3""", "tools")
def _(spark, sf):
    report = reports.tool_log_report(facts.tool_log(spark, sf))
    return report.withColumns({
        "hour": ts("hour"),
        **{c: F.round(c, 6) for c in ("mean_ms", "p50_ms", "p95_ms", "error_rate")}})


@query("agg17_import_summary", """
SELECT (SELECT count(*) FROM imported WHERE accepted) AS imported,
  (SELECT count(*) FROM imported WHERE NOT accepted) AS skipped,
  (SELECT count(*) FROM incoming WHERE trim(content) = '' OR length(content) > 2000) AS errors""",
       "imported")
def _(spark, sf):
    return ingest.import_summary(_import(spark, sf)[1])


# --- windows, sorts, paging ----------------------------------------------------------------------

@query("win01_rank_per_query",
       "SELECT query_id, rank, id, similarity FROM hybrid_ranked", "hybrid_ranked")
def _(spark, sf):
    found = search.hybrid_recall(facts.memory(spark, sf), facts.questions(spark, sf), config="simple")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", sim())


@query("win02_top_k_per_project", """
SELECT project_id, id, access_count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY access_count DESC, id) AS rank
  FROM memory WHERE NOT archived) WHERE rank <= 3""", "memory")
def _(spark, sf):
    return reports.most_accessed(facts.memory(spark, sf)).select(
        "project_id", "id", "access_count", F.col("rank").cast("long").alias("rank"))


@query("win03_latest_state_per_id", """
SELECT id, arg_max(kind = 'pin', seq) FILTER (kind IN ('pin', 'unpin')) AS new_pinned,
  arg_max(kind = 'archive', seq) FILTER (kind IN ('archive', 'restore', 'promote')) AS new_archived,
  arg_max(payload, seq) FILTER (kind = 'correct') AS new_content,
  count(*) FILTER (kind = 'touch') AS touches, bool_or(kind = 'forget') AS deleted
FROM changes GROUP BY id""", "changes")
def _(spark, sf):
    return lifecycle.latest_state_per_id(facts.changes(spark, sf)).select(
        "id", "new_pinned", "new_archived", "new_content", "touches", "deleted")


@query("srt01_list_memories", f"""
SELECT {ROW}, {sql_ts('last_accessed_at')} AS last_accessed_at FROM memory
WHERE project_id = 'proj-1' AND NOT archived AND NOT pinned AND list_has_all(tags, ['architecture'])
ORDER BY memory.last_accessed_at, id LIMIT 20 OFFSET 5""", "memory")
def _(spark, sf):
    page = listing.list_memories(
        facts.memory(spark, sf), "proj-1", order_by="last_accessed_at", direction="asc",
        offset=5, pinned=False, tags=["architecture"])
    return page.select(*ROW.split(", "), ts("last_accessed_at").alias("last_accessed_at"))


@query("srt01_list_stale", f"""
SELECT {ROW} FROM memory WHERE project_id = 'proj-2' AND NOT archived AND NOT pinned
AND last_accessed_at < {NOW} - INTERVAL 20 DAY ORDER BY created_at DESC, id LIMIT 20""", "memory")
def _(spark, sf):
    return row(listing.list_memories(
        facts.memory(spark, sf), "proj-2", stale=True, archived=True, as_of=AS_OF))


@query("srt02_list_after", f"""
SELECT {ROW} FROM memory WHERE project_id = 'proj-0' AND NOT archived
ORDER BY created_at DESC, id LIMIT 20 OFFSET 20""", "memory")
def _(spark, sf):
    memory = facts.memory(spark, sf)
    last = listing.list_after(memory, "proj-0").select("created_at", "id").tail(1)[0]
    return row(listing.list_after(memory, "proj-0", (str(last.created_at), last.id)))


@query("srt03_sort_toggle", f"""
SELECT {ROW} FROM memory WHERE project_id = 'proj-0' AND NOT archived
ORDER BY last_accessed_at DESC, id LIMIT 20""", "memory")
def _(spark, sf):
    return row(listing.list_memories(facts.memory(spark, sf), "proj-0", order_by="last_accessed_at"))


@query("set01_union_active_archived", """
SELECT id, archived, CASE WHEN archived THEN 1 ELSE 0 END AS branch FROM memory
WHERE project_id = 'proj-0'""", "memory")
def _(spark, sf):
    return listing.union_active_archived(facts.memory(spark, sf), "proj-0").select(
        "id", "archived", "branch")


# --- scalar expressions ----------------------------------------------------------------------------

@query("scl01_cosine_similarity", """
WITH e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS similarity
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def _(spark, sf):
    return _neighbours(spark, sf).select("vec_id", sim())


@query("scl02_parse_format_vector",
       "SELECT vec_id, len(embedding) AS dimensions, true AS same FROM embeddings")
def _(spark, sf):
    e = facts.table(spark, sf, "embeddings")
    back = V.parse_vector(V.format_vector(F.col("embedding")))
    return e.select("vec_id", F.size(back).cast("long").alias("dimensions"),
                    (back == F.col("embedding")).alias("same"))


@query("scl03_l2_normalize", """
WITH e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first,
  round(v[len(v)] / sqrt(list_dot_product(v, v)), 6) AS last FROM e""")
def _(spark, sf):
    unit = V.l2_normalize(F.col("embedding"))
    return facts.table(spark, sf, "embeddings").select(
        "vec_id", F.round(F.element_at(unit, 1), 6).alias("first"),
        F.round(F.element_at(unit, -1), 6).alias("last"))


@query("scl04_utf16_length", f"SELECT doc_id, cast({_UTF16} AS int) AS units FROM documents")
def _(spark, sf):
    return facts.table(spark, sf, "documents").select(
        "doc_id", S.utf16_length(F.col("text")).alias("units"))


@query("scl05_lexemes", r"""
SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))
  .list_sort(), ' ').md5() AS lexemes_md5 FROM documents""")
def _(spark, sf):
    found = F.array_sort(lexemes(F.col("text"), "simple"))
    return facts.table(spark, sf, "documents").select(
        "doc_id", F.md5(F.array_join(found, " ")).alias("lexemes_md5"))


@query("scl05_lexemes_english", r"""
, d_words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS word FROM documents),
d AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT stem)), ' ') AS lexemes
  FROM d_words JOIN lexeme_of USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(lexemes, '') AS lexemes FROM documents LEFT JOIN d USING (doc_id)""", "stems")
def _(spark, sf):
    return facts.table(spark, sf, "documents").select(
        "doc_id", F.array_join(F.array_sort(lexemes(F.col("text"), "english")), " ").alias("lexemes"))


@query("scl05_lexemes_by_dictionary", r"""
, d_words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS word FROM documents),
d AS (SELECT doc_id, md5(array_to_string(list_sort(list(DISTINCT stem)), ' ')) AS lexemes_md5
  FROM d_words JOIN lexeme_of USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(lexemes_md5, md5('')) AS lexemes_md5 FROM documents LEFT JOIN d USING (doc_id)""", "stems")
def _(spark, sf):
    docs = facts.table(spark, sf, "documents").select("doc_id", "text")
    stems = grow_dictionary(docs, "text", fresh_path(spark, "stems"))
    return stem_lexemes(docs, "doc_id", "text", stems).select(
        "doc_id", F.md5(F.array_join("lexemes", " ")).alias("lexemes_md5"))


@query("scl06_short_id", "SELECT id, substring(id, 1, 6) AS short FROM memory", "memory")
def _(spark, sf):
    return facts.memory(spark, sf).select("id", S.short_id(F.col("id")).alias("short"))


_EVENT_NOW = "TIMESTAMP '2024-01-15 12:00:00'"


@query("scl07_relative_time",
       f"SELECT event_id, {_sql_age('ts', _EVENT_NOW, 'just now', ' ago')} AS ago FROM events")
def _(spark, sf):
    events = facts.table(spark, sf, "events")
    now = filters.moment(events, "2024-01-15 12:00:00", "ts")
    return events.select("event_id", S.relative_time(F.col("ts"), now).alias("ago"))


@query("scl08_age", f"SELECT event_id, {_sql_age('ts', _EVENT_NOW)} AS age FROM events")
def _(spark, sf):
    events = facts.table(spark, sf, "events")
    now = filters.moment(events, "2024-01-15 12:00:00", "ts")
    return events.select("event_id", S.age(F.col("ts"), now).alias("age"))


@query("scl09_truncate_text", f"SELECT doc_id, {_sql_line('text', 60)} AS line FROM documents")
def _(spark, sf):
    return facts.table(spark, sf, "documents").select(
        "doc_id", S.truncate_text(F.col("text"), 60).alias("line"))


@query("scl10_format_tags", """
SELECT id, CASE WHEN len(tags) > 0 THEN '[' || array_to_string(tags, ', ') || ']' ELSE '' END AS tags
FROM memory""", "memory")
def _(spark, sf):
    return facts.memory(spark, sf).select("id", S.format_tags(F.col("tags")).alias("tags"))


@query("scl11_format_score_timestamp", """
SELECT event_id, printf('%.2f', value + 0.001) AS score,
  strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS at FROM events""")
def _(spark, sf):
    return facts.table(spark, sf, "events").select(
        "event_id", S.format_score(F.col("value") + 0.001).alias("score"),
        S.format_timestamp(F.col("ts")).alias("at"))


_CSV = "concat(' ', lang, ' , ,', source, CASE WHEN doc_id % 3 = 0 THEN ',' ELSE ', x y ' END)"


@query("scl12_parse_tags", f"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(
    CASE WHEN doc_id % 5 = 0 THEN ' , ' ELSE {_CSV} END, ','), lambda t: trim(t)),
  lambda t: t <> ''), '|') AS tags FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 5 = 0""")
def _(spark, sf):
    csv = F.expr(f"CASE WHEN doc_id % 5 = 0 THEN ' , ' ELSE {_CSV} END")
    return facts.table(spark, sf, "documents").select(
        "doc_id", F.array_join(S.parse_tags(csv), "|").alias("tags"))


@query("scl13_append_corroborated", """
SELECT id, array_to_string(list_append(CASE WHEN pinned THEN [] ELSE tags END, 'corroborated'), ',') AS tags
FROM memory""", "memory")
def _(spark, sf):
    given = F.when(~F.col("pinned"), F.col("tags"))
    return facts.memory(spark, sf).select(
        "id", F.array_join(S.append_corroborated(given), ",").alias("tags"))


@query("scl14_days_before_day_start", """
SELECT event_id, strftime(ts - INTERVAL 20 DAY, '%Y-%m-%d %H:%M:%S.%f') AS earlier,
  strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f') AS day FROM events""")
def _(spark, sf):
    return facts.table(spark, sf, "events").select(
        "event_id", ts(S.days_before(F.col("ts"), 20)).alias("earlier"),
        ts(S.day_start(F.col("ts"))).alias("day"))


@query("scl15_importance", """
SELECT id, importance IN ('normal', 'high', 'critical') AS valid, importance = 'critical' AS pin
FROM memory""", "memory")
def _(spark, sf):
    i = F.col("importance")
    return facts.memory(spark, sf).select(
        "id", S.is_importance(i).alias("valid"), S.pin_on_critical(i).alias("pin"))


@query("scl16_stop_words", """
SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'),
  lambda w: w IN (__WORDS__))) AS stops FROM documents""".replace(
    "__WORDS__", STOP_WORDS))
def _(spark, sf):
    from factlake.functions.text import WORD, stop_words
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    return facts.table(spark, sf, "documents").select(
        "doc_id", F.size(F.filter(words, lambda w: w.isin(*stop_words()))).cast("long").alias("stops"))


# --- streams ---------------------------------------------------------------------------------------

@query("str01_stream_access_fold",
       f"SELECT id, count(*) AS hits, {sql_ts('max(ts)')} AS last_ts FROM accesses GROUP BY id",
       "accesses")
def _(spark, sf):
    stream = _streamed(spark, facts.accesses(spark, sf), "touches")
    out = _finish(spark, streams.access_fold(stream), "touches", "update")
    latest = out.groupBy("id").agg(F.max_by(F.struct("hits", "last_ts"), "batch_id").alias("v"))
    return latest.select("id", "v.hits", ts("v.last_ts").alias("last_ts"))


@query("str02_stream_import", _AFTER_IMPORT, "imported")
def _(spark, sf):
    root = fresh_path(spark, "live")
    tables.write_snapshot(facts.memory(spark, sf), root)
    stream = _streamed(spark, _turns(spark, sf), "entries", "ordinal")
    streams.import_stream(
        stream, root, fresh_path(spark, "import-state"), "proj-1", "bob/debugger", AS_OF
    ).awaitTermination()
    return _after_import(tables.read_snapshot(spark, root))


@query("str03_stream_archive_sweep", f"""
, ordered AS (SELECT id, ts, lead(ts) OVER (PARTITION BY id ORDER BY ts) AS nxt FROM accesses)
SELECT id, {sql_ts('ts')} AS last_ts, {sql_ts("ts + INTERVAL 5 DAY")} AS stale_at FROM ordered
WHERE (nxt IS NULL OR nxt >= ts + INTERVAL 5 DAY)
  AND ts + INTERVAL 5 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM accesses)
  AND id IN (SELECT id FROM memory WHERE NOT pinned AND NOT archived)""", "memory")
def _(spark, sf):
    stream = _streamed(spark, facts.accesses(spark, sf), "accesses")
    out = streams.due_for_archive(
        _finish(spark, streams.archive_sweep(stream, days=5), "sweep"), facts.memory(spark, sf))
    return out.select("id", ts("last_ts").alias("last_ts"), ts("stale_at").alias("stale_at"))


@query("str04_stream_growth", """
SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, project_id, count(*) AS facts
FROM memory GROUP BY 1, 2
HAVING date_trunc('day', min(created_at)) + INTERVAL 1 DAY
  <= (SELECT max(created_at) FROM memory) - INTERVAL 1 DAY""", "memory")
def _(spark, sf):
    rows = facts.memory(spark, sf).select("project_id", "created_at")
    out = _finish(spark, streams.growth(_streamed(spark, rows, "facts")), "growth")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "project_id", "facts")


@query("str05_write_rate_alerts", f"""
, w AS (SELECT agent, unnest(range(
    time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR,
    time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 1 SECOND, INTERVAL 6 HOUR)) AS s FROM changes WHERE kind NOT IN ('touch', 'recall'))
SELECT {sql_ts('s')} AS window_start, {sql_ts('s + INTERVAL 24 HOUR')} AS window_end, agent,
  count(*) AS writes FROM w GROUP BY s, agent
HAVING count(*) > 3 AND s + INTERVAL 24 HOUR <= (SELECT max(ts) FROM changes) - INTERVAL 1 MINUTE""",
       "changes")
def _(spark, sf):
    stream = _streamed(spark, facts.changes(spark, sf), "writes")
    out = _finish(spark, streams.write_rate_alerts(stream, 3, "24 hours", "6 hours"), "alerts")
    return out.select(ts("window_start").alias("window_start"), ts("window_end").alias("window_end"),
                      "agent", "writes")


@query("str06_stream_tool_log", f"""
SELECT {sql_ts("date_trunc('hour', ts)")} AS window_start, tool, count(*) AS calls,
  count(*) FILTER (NOT success) AS failures, round(avg(duration_ms), 6) AS mean_ms,
  max(duration_ms) AS max_ms
FROM tools GROUP BY date_trunc('hour', ts), tool
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR
  <= (SELECT max(ts) FROM tools) - INTERVAL 10 MINUTE""", "tools")
def _(spark, sf):
    stream = _streamed(spark, facts.tool_log(spark, sf), "calls")
    out = _finish(spark, streams.tool_log(stream), "calls")
    return out.select(ts("window_start").alias("window_start"), "tool", "calls", "failures",
                      F.round("mean_ms", 6).alias("mean_ms"), "max_ms")


@query("str07_stream_exactly_once", "SELECT seq, id, kind FROM changes", "changes")
def _(spark, sf):
    events = facts.changes(spark, sf)
    stream = _streamed(spark, events.unionByName(events), "twice")
    return _finish(spark, streams.exactly_once(stream), "once").select("seq", "id", "kind")


# --- functions over columns and SQL --------------------------------------------------------------------

@query("udf01_embed_column")
def _(spark, sf):
    docs, _ = split_blank(facts.table(spark, sf, "documents"), "text")
    return embed_column(docs, "text").select(
        "doc_id", F.size("embedding").alias("dimensions"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query("udf02_similarity_block", """
WITH e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 9) AS x
      FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT vec_id, other, x AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, cast(other AS varchar)) AS n FROM s)
WHERE n <= 5""")
def _(spark, sf):
    from factlake.operators.simjoin import best_hits
    e = facts.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.lit("all").alias("part"),
        F.col("embedding").alias("vec"))
    probes = e.select(F.col("id").alias("query_id"), "part", "vec",
                      F.lit(-1.0).alias("threshold"), F.lit(5).alias("limit"))
    return best_hits(e, probes, exclude_self=True).select(
        F.col("query_id").cast("long").alias("vec_id"), F.col("id").cast("long").alias("other"), sim())


@query("udf03_stem_english", r"""
, d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents)
SELECT word, stem FROM d JOIN stems USING (word)""", "stems")
def _(spark, sf):
    words = facts.table(spark, sf, "documents").select(
        F.explode(lexemes(F.col("text"), "simple")).alias("word")).distinct()
    return words.select("word", F.element_at(stem_english(F.array("word")), 1).alias("stem"))


@query("udf05_sql_recall", """
, usable AS MATERIALIZED (SELECT * FROM memory WHERE embedding IS NOT NULL
    AND project_id = 'proj-0' AND NOT archived AND engineer = 'alice'),
s AS (SELECT m.id, round(list_cosine_similarity(m.embedding, e.embedding::double[]), 9) AS x
  FROM usable m, embeddings e WHERE e.vec_id = 204)
SELECT id, x AS similarity FROM s WHERE x > 0.1 ORDER BY x DESC, id LIMIT 25""", "memory")
def _(spark, sf):
    facts.memory(spark, sf).createOrReplaceTempView("memory")
    sql_functions.register(spark)
    vector = ", ".join(f"float('{x!r}')" for x in _vector(spark, sf))
    return spark.sql(f"""
        SELECT id, similarity
        FROM recall('proj-0', array({vector}), 25, 0.1D, p_engineer => 'alice')""")


@query("udf05_sql_recall_english", """
, usable AS MATERIALIZED (SELECT m.*, coalesce(tsv, []) AS tsv FROM memory m LEFT JOIN m_lex_english USING (id)
  WHERE project_id = 'proj-0' AND NOT archived AND repo = 'src3'),
s AS (SELECT m.id, m.tsv, round(list_cosine_similarity(m.embedding, e.embedding::double[]), 9) AS x
  FROM usable m, embeddings e WHERE e.vec_id = 204)
SELECT id, x AS similarity FROM s WHERE x > 0.2 OR list_contains(tsv, 'thing')
ORDER BY x DESC NULLS LAST, id LIMIT 40""", "lexed_english")
def _(spark, sf):
    facts.memory(spark, sf).createOrReplaceTempView("memory")
    sql_functions.register(spark)
    vector = ", ".join(f"float('{x!r}')" for x in _vector(spark, sf))
    return spark.sql(f"""
        SELECT id, similarity
        FROM recall('proj-0', array({vector}), 40, 0.2D, p_repo => 'src3', p_query_text => 'The things')""")


@query("udf05_sql_touch", f"""
SELECT id, {NOW_TEXT} AS last_accessed_at, cast(access_count + 1 AS int) AS access_count
FROM memory WHERE id IN (md5('1'), md5('2'), md5('no such'))""", "memory")
def _(spark, sf):
    facts.memory(spark, sf).createOrReplaceTempView("memory")
    sql_functions.register(spark)
    return spark.sql(f"""
        SELECT id, last_accessed_at, access_count FROM touch_memories(
          array(md5('1'), md5('2'), md5('no such'), md5('1')), timestamp_ntz'{AS_OF}')
    """).withColumn("last_accessed_at", ts("last_accessed_at"))


@query("udf05_sql_archive_stale", f"""
SELECT id, project_id FROM memory
WHERE NOT pinned AND NOT archived AND last_accessed_at < {NOW} - INTERVAL 20 DAY""", "memory")
def _(spark, sf):
    facts.memory(spark, sf).createOrReplaceTempView("memory")
    sql_functions.register(spark)
    return spark.sql(f"SELECT id, project_id FROM archive_stale(timestamp_ntz'{AS_OF}', 20)")


@query("udf05_sql_dedup_check", """
, usable AS MATERIALIZED (SELECT * FROM memory WHERE embedding IS NOT NULL
    AND project_id = 'proj-0' AND NOT archived),
s AS (SELECT m.id, m.created_by, round(list_cosine_similarity(m.embedding, e.embedding::double[]), 9) AS x
  FROM usable m, embeddings e WHERE e.vec_id = 7)
SELECT id, created_by, x AS similarity FROM s WHERE x > 0.2 ORDER BY x DESC, id LIMIT 3""",
       "memory")
def _(spark, sf):
    facts.memory(spark, sf).createOrReplaceTempView("memory")
    sql_functions.register(spark)
    vector = ", ".join(f"float('{x!r}')" for x in _vector(spark, sf, 7))
    return spark.sql(f"""
        SELECT id, created_by, similarity
        FROM dedup_check('proj-0', array({vector}), 0.2D)""")


# --- the plan for large sides, forced ------------------------------------------------------------------

# Settings with which even small tables are cut into cells and blocks.
_CELLS = {"broadcastRows": "0", "blockRows": "128", "pivots": "16"}


def _in_cells(run):
    """A query with the plan that large tables take."""
    def forced(spark, sf):
        for name, value in _CELLS.items():
            spark.conf.set(f"factlake.similarity.{name}", value)
        try:
            # Written here, while the settings hold.
            return materialize(run(spark, sf), "in-cells")
        finally:
            for name in _CELLS:
                spark.conf.unset(f"factlake.similarity.{name}")
    return forced


for _name in ("jn02_recall_batch", "jn03_hybrid_recall", "jn05_dedup_check", "jn06_near_duplicates",
              "jn07_duplicate_clusters", "jn12_cross_agent_corroboration", "mut03_import_batch"):
    QUERIES[f"{_name}_cells"] = _in_cells(QUERIES[_name])
    ORACLES[f"{_name}_cells"] = ORACLES[_name]
