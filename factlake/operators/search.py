"""Search by vector, by text and by id, for one question or for many at once."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.scalars import contains_all
from factlake.functions.text import lexemes
from factlake.functions.vectors import cosine_similarity, cosine_to
from factlake.operators import filters
from factlake.operators.simjoin import Limits, best_hits, small_table
from factlake.operators.textindex import text_candidates
from factlake.schema import (
    DEDUP_LIMIT,
    DEDUP_THRESHOLD,
    PREFIX_LIMIT,
    RECALL_COLUMNS,
    SEARCH_LIMIT,
    SEARCH_THRESHOLD,
)
from factlake.session import materialize

_SCOPE = ("project_id", "agent", "engineer", "repo", "tags", "include_archived")
# Hits of this many rows at most are broadcast to fetch their wide columns.
_BROADCAST_HITS = 1_000_000
# This many distinct scopes at most are sent to the facts, which list those they fall in.
_MOST_SCOPES = 1_024


def best_first(similarity: str = "similarity") -> list[Column]:
    """Highest similarity first, rows without one last, ties by id."""
    return [F.desc_nulls_last(similarity), F.asc("id")]


# --- one question -------------------------------------------------------------

def recall(
    memory: DataFrame,
    vector: list[float],
    project_id: str,
    limit: int = SEARCH_LIMIT,
    threshold: float = SEARCH_THRESHOLD,
    include_archived: bool = False,
    agent: str | None = None,
    engineer: str | None = None,
    repo: str | None = None,
    tags: list[str] | None = None,
    text: str | None = None,
    config: str = "english",
) -> DataFrame:
    """The facts most similar to ``vector``, or that contain ``text``.

    The threshold is applied after the top-k: a hit outranks every miss, so
    the result is the same and the similarity is computed once per row.
    """
    rows = filters.active(filters.by_project(memory, project_id), include_archived)
    rows = filters.by_agent(rows, agent)
    rows = filters.by_engineer(rows, engineer)
    rows = filters.by_repo(rows, repo)
    rows = filters.has_all_tags(rows, tags)
    rows = rows.withColumn("similarity", cosine_to(F.col("embedding"), vector))
    hit = F.coalesce(F.col("similarity") > F.lit(float(threshold)), F.lit(False))
    if text is not None:
        found = F.col("tsv") if "tsv" in rows.columns else lexemes(F.col("content"), config)
        hit = hit | filters.text_predicate(found, lexemes(F.lit(text), config))
    return (
        rows.select(*RECALL_COLUMNS, hit.alias("_hit"))
        .orderBy(F.desc("_hit"), *best_first())
        .limit(limit)
        .filter("_hit")
        .drop("_hit")
    )


# --- many questions -------------------------------------------------------------

def prepare_queries(queries: DataFrame) -> DataFrame:
    """Scopes normalised and defaults filled in."""
    defaults = {
        "limit": F.lit(SEARCH_LIMIT),
        "threshold": F.lit(SEARCH_THRESHOLD),
        "include_archived": F.lit(False),
    }
    filled = {
        name: F.coalesce(F.col(name), value) if name in queries.columns else value
        for name, value in defaults.items()
    }
    for name, kind in (("agent", "string"), ("engineer", "string"), ("repo", "string"),
                       ("tags", "array<string>")):
        if name not in queries.columns:
            filled[name] = F.lit(None).cast(kind)
    return filters.normalize_scope(queries.withColumns(filled))


def in_scope(row, scope) -> Column:
    """Whether a row satisfies every restriction a scope states."""
    def same(wanted: Column, value: Column) -> Column:
        return wanted.isNull() | (value == wanted)

    return (
        (scope("include_archived") | ~row("archived"))
        & same(scope("agent"), row("created_by"))
        & same(scope("engineer"), row("engineer"))
        & same(scope("repo"), row("repo"))
        & (scope("tags").isNull() | contains_all(row("tags"), scope("tags")))
    )


def _searchable(memory: DataFrame) -> DataFrame:
    return memory.filter(F.col("embedding").isNotNull()).select(
        "id", "project_id", F.col("embedding").alias("vec"), "created_by", "engineer",
        "repo", "tags", "archived",
    )


def _probe_columns(queries: DataFrame, *extra: Column) -> DataFrame:
    return queries.filter(F.col("embedding").isNotNull()).select(
        F.col("query_id").cast("string").alias("query_id"),
        F.col("embedding").alias("vec"), "threshold", "limit", *extra,
    )


def _scope_key() -> Column:
    return F.to_json(F.struct(*_SCOPE))


def scoped_few(memory: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the list of scopes they fall in, for a checked number of scopes.

    The distinct scopes of each project travel as one small broadcast row, so
    the fact table is neither shuffled nor repeated per scope.
    """
    distinct = queries.select(_scope_key().alias("key"), *_SCOPE).distinct()
    numbered = materialize(distinct.withColumn(
        "scope", F.row_number().over(Window.partitionBy("project_id").orderBy("key")) - 1
    ), "scopes")
    per_project = numbered.groupBy("project_id").agg(
        F.collect_list(F.struct("scope", *_SCOPE[1:])).alias("all_scopes")
    )
    matching = F.filter(
        F.col("all_scopes"), lambda s: in_scope(F.col, lambda name: s[name])
    )
    rows = (
        _searchable(memory)
        .join(F.broadcast(per_project), "project_id")
        .select(
            "id", F.col("project_id").alias("part"), "vec",
            F.transform(matching, lambda s: s["scope"].cast("long")).alias("scopes"),
        )
    )
    keyed = queries.withColumn("key", _scope_key()).join(
        F.broadcast(numbered.select("key", "scope")), "key"
    )
    probes = _probe_columns(
        keyed, F.col("project_id").alias("part"), F.col("scope").cast("long").alias("scope")
    )
    return rows, probes


def scoped_many(memory: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows repeated per matching scope, the scope being the part they meet in."""
    scopes = queries.select(_scope_key().alias("part"), *_SCOPE).distinct()
    s, m = scopes.alias("s"), _searchable(memory).alias("m")
    rows = m.join(
        s,
        (F.col("m.project_id") == F.col("s.project_id"))
        & in_scope(lambda c: F.col(f"m.{c}"), lambda c: F.col(f"s.{c}")),
    ).select("m.id", "s.part", "m.vec")
    return rows, _probe_columns(queries, _scope_key().alias("part"))


def scoped(memory: DataFrame, queries: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """Rows and probes that meet in their scopes.

    Many queries mostly share few scopes; only where the scopes themselves are
    many are the rows repeated.
    """
    if not few:
        few = queries.select(*_SCOPE).distinct().limit(_MOST_SCOPES + 1).count() <= _MOST_SCOPES
    return (scoped_few if few else scoped_many)(memory, queries)


def bounded(queries: DataFrame) -> tuple[DataFrame, pa.Table | None]:
    """The queries, held as a local table if their checked number is small."""
    spark = queries.sparkSession
    few = small_table(queries, Limits.of(spark).broadcast_rows)
    if few is None or not few.num_rows:
        return queries, few
    return spark.createDataFrame(few, queries.schema), few


def vector_hits(memory: DataFrame, queries: DataFrame, few: bool) -> DataFrame:
    """``query_id (string), id, similarity``: at most ``limit`` per query."""
    rows, probes = scoped(memory, queries, few)
    return best_hits(rows, probes).select("query_id", "id", "similarity")


def text_only_hits(memory: DataFrame, queries: DataFrame, config: str, dictionary: DataFrame | None) -> DataFrame:
    """Hits by text whose similarity is not above the threshold, best per query."""
    # Two narrow columns of known size, in scope already, decide how the vectors are fetched.
    asked = queries.select(
        "query_id", "project_id", "question", "agent", "engineer", "repo", "tags", "include_archived")
    pairs = materialize(text_candidates(memory, asked, config, dictionary), "text-pairs")
    m = memory.select("id", "embedding").alias("m")
    q = queries.select("query_id", "embedding", "threshold").alias("q")
    similarity = cosine_similarity(F.col("m.embedding"), F.col("q.embedding"))
    found = (
        pairs.alias("p")
        .join(m, F.col("p.id") == F.col("m.id"))
        .join(q, F.col("p.query_id") == F.col("q.query_id"))
        .select(
            F.col("q.query_id").cast("string").alias("query_id"), "m.id",
            similarity.alias("similarity"), "q.threshold",
        )
    )
    return found.filter(
        F.coalesce(F.col("similarity") <= F.col("threshold"), F.lit(True))
    ).drop("threshold")


def unfilled(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """The queries with fewer hits than their limit; only these can take hits by text alone."""
    found = hits.groupBy(F.col("query_id").alias("_found")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        queries.join(found, F.col("query_id").cast("string") == F.col("_found"), "left")
        .filter(F.coalesce("_n", F.lit(0)) < F.col("limit"))
        .drop("_found", "_n")
    )


def rank_per_query(hits: DataFrame, queries: DataFrame, few: pa.Table | None) -> DataFrame:
    """``rank`` from 1 per query, best first, cut at each query's limit."""
    by_query = Window.partitionBy("query_id").orderBy(*best_first())
    ranked = hits.withColumn("rank", F.row_number().over(by_query))
    if few is not None:
        limits = set(few.column("limit").to_pylist()) or {0}
        ranked = ranked.filter(F.col("rank") <= max(limits))
        if len(limits) == 1:
            return ranked
    wanted = queries.select(F.col("query_id").cast("string").alias("query_id"), "limit")
    return ranked.join(wanted, "query_id").filter(F.col("rank") <= F.col("limit")).drop("limit")


def few_hits(few: pa.Table | None) -> bool:
    """Whether all hits together are known to fit a broadcast."""
    return few is not None and sum(few.column("limit").to_pylist()) <= _BROADCAST_HITS


def with_facts(memory: DataFrame, hits: DataFrame, few: bool) -> DataFrame:
    """The wide columns of the hits, fetched once the ranking is done."""
    wide = memory.select(*[c for c in RECALL_COLUMNS if c != "similarity"])
    return wide.join(F.broadcast(hits) if few else hits, "id")


def hybrid_recall(
    memory: DataFrame, queries: DataFrame, config: str | None = "english", dictionary: DataFrame | None = None,
) -> DataFrame:
    """Vector or text search for every query under its own scope and limit.

    ``config=None`` searches by vector only.  ``dictionary`` is a stored table of
    stems for ``english``; without one it is made of the facts' words.  Result:
    ``query_id, rank`` and the recall columns.
    """
    queries, few = bounded(prepare_queries(queries))
    id_type = queries.schema["query_id"].dataType
    hits = vector_hits(memory, queries, few is not None)
    if config is not None:
        # Hits by text alone rank after all hits by vector.
        hits = materialize(hits, "vector-hits")
        lacking = materialize(unfilled(queries, hits), "unfilled")
        if not lacking.isEmpty():
            hits = hits.unionByName(text_only_hits(memory, lacking, config, dictionary))
    ranked = rank_per_query(hits, queries, few)
    if not few_hits(few):
        ranked = materialize(ranked, "hits")
    return with_facts(memory, ranked, few_hits(few)).select(
        F.col("query_id").cast(id_type).alias("query_id"), "rank", *RECALL_COLUMNS
    )


def recall_batch(memory: DataFrame, queries: DataFrame) -> DataFrame:
    return hybrid_recall(memory, queries, config=None)


def recall_with_side_effects(memory: DataFrame, queries: DataFrame, as_of, config: str = "english"):
    """(results, new memory): hits are touched, archived ones found become active.

    The results show the access fields from before the touch; they are written
    once so that both consequences use the same rows.
    """
    from factlake.operators import lifecycle
    from factlake.operators.projections import promote_view

    asked = prepare_queries(queries).select("query_id", "include_archived")
    results = materialize(hybrid_recall(memory, queries, config), "recall")
    touches = results.select(F.col("query_id").alias("call_id"), "id").withColumn(
        "ts", filters.moment(memory, as_of)
    )
    touched, _ = lifecycle.fold_access_log(memory, touches)
    rescued = (
        results.filter("archived").join(asked.filter("include_archived"), "query_id", "left_semi")
        .select("id").distinct()
    )
    promoted, _ = lifecycle.promote(touched, rescued, as_of)
    return promote_view(results), promoted


def dedup_check(
    memory: DataFrame,
    candidates: DataFrame,
    threshold: float = DEDUP_THRESHOLD,
    k: int = DEDUP_LIMIT,
) -> DataFrame:
    """The nearest active facts of each candidate's project, at most ``k``.

    Candidates carry ``candidate_id, project_id, embedding``.
    """
    probes = candidates.filter(F.col("embedding").isNotNull()).select(
        F.col("candidate_id").cast("string").alias("query_id"),
        F.col("project_id").alias("part"), F.col("embedding").alias("vec"),
        F.lit(float(threshold)).alias("threshold"), F.lit(k).alias("limit"),
    )
    # Written, so that the planner knows how few they are and the contents stay in place.
    hits = materialize(best_hits(similarity_rows(filters.active(memory)), probes), "dedup-hits")
    facts = memory.select("id", "content", "created_by")
    id_type = candidates.schema["candidate_id"].dataType
    return hits.join(facts, "id").select(
        F.col("query_id").cast(id_type).alias("candidate_id"),
        "rank", "id", "content", "similarity", "created_by",
    )


def similarity_rows(memory: DataFrame, *extra) -> DataFrame:
    """The narrow side of a similarity join."""
    return memory.filter(F.col("embedding").isNotNull()).select(
        "id", F.col("project_id").alias("part"), F.col("embedding").alias("vec"), *extra
    )


# --- ids --------------------------------------------------------------------------

def get_by_ids(memory: DataFrame, ids: DataFrame):
    """(facts found, ids that do not exist)."""
    wanted = ids.select("id").distinct()
    return memory.join(wanted, "id", "left_semi"), wanted.join(memory, "id", "left_anti")


def resolve_ids(
    memory: DataFrame, keys: DataFrame, project_id: str | None = None, most: int = PREFIX_LIMIT
) -> DataFrame:
    """Exact id, else prefix: ``key, status, id``, at most ``most`` matches a key.

    Prefixes meet ids by equality on the first n characters, one n per key
    length up to six, so no key is compared with every id.
    """
    keys = keys.select("key").distinct()
    exact = keys.join(memory.select(F.col("id").alias("key")), "key", "left_semi").select(
        "key", F.lit("exact").alias("status"), F.col("key").alias("id")
    )
    # Written, so that a few keys reach the ids by broadcast and the ids are not shuffled.
    open_keys = materialize(keys.join(exact.select("key"), "key", "left_anti").withColumn(
        "head", F.substring("key", 1, 6)
    ), "open-keys")
    lengths = sorted(
        r[0] for r in open_keys.filter(F.length("key") > 0)
        .select(F.least(F.length("key"), F.lit(6))).distinct().collect()
    )
    rows = memory if project_id is None else filters.by_project(memory, project_id)
    if not lengths:
        lengths = [6]
    heads = rows.select(
        "id", F.explode(F.array(*[F.substring("id", 1, n) for n in lengths])).alias("head")
    )
    first = Window.partitionBy("key").orderBy("id")
    matches = (
        open_keys.join(heads, "head")
        .filter(F.startswith(F.col("id"), F.col("key")))
        .select("key", "id", F.row_number().over(first).alias("n"))
        .filter(F.col("n") <= most)
    )
    counted = matches.groupBy("key").agg(F.max("n").alias("found"))
    by_prefix = (
        open_keys.select("key").join(counted, "key", "left").join(matches, "key", "left")
        .select(
            "key",
            F.when(F.col("found").isNull(), "missing")
            .when(F.col("found") == 1, "unique")
            .otherwise("ambiguous").alias("status"),
            "id",
        )
    )
    return exact.unionByName(by_prefix)
