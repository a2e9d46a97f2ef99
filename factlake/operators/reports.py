"""Statistics of the pool.  With ``project_id=None`` there is one group per project."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.scalars import day_start, days_before
from factlake.operators import filters
from factlake.operators.filters import moment
from factlake.operators.listing import top_k_per_project
from factlake.schema import STALE_LISTING_DAYS
from factlake.session import materialize


def _rows(memory: DataFrame, project_id: str | None) -> DataFrame:
    return memory if project_id is None else filters.by_project(memory, project_id)


def _grouped(memory: DataFrame, project_id: str | None, aggregates: list[Column]) -> DataFrame:
    """One row for a named project (even an empty one), else one per project."""
    if project_id is None:
        return memory.groupBy("project_id").agg(*aggregates)
    return _rows(memory, project_id).agg(F.lit(project_id).alias("project_id"), *aggregates)


def _count_aggregates() -> list[Column]:
    return [
        F.count_if(~F.col("archived")).alias("active"),
        F.count_if(F.col("archived")).alias("archived"),
        F.count_if(F.col("pinned")).alias("pinned"),
    ]


def counts(memory: DataFrame, project_id: str | None = None) -> DataFrame:
    return _grouped(memory, project_id, _count_aggregates())


def stats_counts(memory: DataFrame, project_id: str | None = None) -> DataFrame:
    return _grouped(
        memory, project_id, [F.count(F.lit(1)).alias("total"), *_count_aggregates()]
    )


def _engineers(rows: DataFrame) -> DataFrame:
    return (
        filters.active(rows)
        .groupBy("project_id", F.coalesce("engineer", F.lit("auto")).alias("engineer"))
        .agg(F.count(F.lit(1)).alias("count"), F.count_if("pinned").alias("pinned"))
    )


def _repos(rows: DataFrame) -> DataFrame:
    return (
        filters.active(rows)
        .groupBy("project_id", F.coalesce("repo", F.lit("(no repo)")).alias("repo"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def by_engineer(memory: DataFrame, project_id: str | None = None) -> DataFrame:
    return _engineers(_rows(memory, project_id)).orderBy("project_id", F.desc("count"), "engineer")


def by_repo(memory: DataFrame, project_id: str | None = None) -> DataFrame:
    return _repos(_rows(memory, project_id)).orderBy("project_id", F.desc("count"), "repo")


def tag_counts(memory: DataFrame, project_id: str | None = None) -> DataFrame:
    """Uses of every tag by active facts; a tag repeated in a fact counts again."""
    return (
        filters.active(_rows(memory, project_id))
        .select("project_id", F.explode("tags").alias("tag"))
        .groupBy("project_id", "tag")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_tags(memory: DataFrame, project_id: str | None = None, k: int = 10) -> DataFrame:
    used = tag_counts(memory, project_id)
    if project_id is not None:
        return used.orderBy(F.desc("count"), "tag").limit(k)
    return top_k_per_project(used, "count", k, tie="tag")


def _metric_aggregates(memory: DataFrame, as_of) -> list[Column]:
    accessed, created = moment(memory, as_of), moment(memory, as_of, "created_at")
    updated = moment(memory, as_of, "updated_at")
    stale = (
        ~F.col("pinned") & ~F.col("archived")
        & (F.col("last_accessed_at") < days_before(accessed, STALE_LISTING_DAYS))
    )
    return [
        F.count_if(stale).alias("approaching_stale"),
        F.count_if(F.col("archived") & (F.col("updated_at") > days_before(updated, 7)))
        .alias("archived_last_7_days"),
        F.count_if(
            F.col("created_at") > day_start(created).cast(memory.schema["created_at"].dataType)
        ).alias("created_today"),
    ]


def archival_metrics(memory: DataFrame, as_of, project_id: str | None = None) -> DataFrame:
    return _grouped(memory, project_id, _metric_aggregates(memory, as_of))


def most_accessed(memory: DataFrame, project_id: str | None = None, k: int = 3) -> DataFrame:
    rows = filters.active(_rows(memory, project_id)).select(
        "project_id", "id", "content", "access_count"
    )
    if project_id is not None:
        return rows.orderBy(F.desc("access_count"), "id").limit(k)
    # Rank on the narrow columns; contents are fetched for the winners alone.
    # Written first, their size is known and the contents are only streamed past.
    top = materialize(top_k_per_project(rows.drop("content"), "access_count", k), "top")
    return top.join(rows.select("id", "content"), "id").select(
        "project_id", "id", "content", "access_count", "rank"
    )


def dashboard(memory: DataFrame, as_of, project_id: str | None = None, tags: int = 10) -> DataFrame:
    """Every project on one row: all counts in one scan, the lists beside them.

    Lists of engineers and repositories are as long as a project has of them;
    take :func:`by_engineer` and :func:`by_repo` where that may be very many.
    """
    memory = _rows(memory, project_id)
    totals = memory.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), *_count_aggregates(),
        *_metric_aggregates(memory, as_of),
    )

    def listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        # (-count, key, ...) sorts the list: most first, ties by key.
        entry = F.struct((-F.col(columns[1])).alias("_order"), *columns)
        kept = F.transform(
            F.sort_array(F.collect_list(entry)),
            lambda e: F.struct(*[e[c].alias(c) for c in columns]),
        )
        return rows.groupBy("project_id").agg(kept.alias(name))

    lists = [
        listed(_engineers(memory), "by_engineer", "engineer", "count", "pinned"),
        listed(_repos(memory), "by_repo", "repo", "count"),
        listed(top_tags(memory, k=tags), "top_tags", "tag", "count"),
        listed(most_accessed(memory), "most_accessed", "id", "access_count", "content"),
    ]
    for one in lists:
        totals = totals.join(one, "project_id", "left")
    return totals


# --- reports over time and quality ---------------------------------------------------

def growth_rate(memory: DataFrame, project_id: str | None = None) -> DataFrame:
    return (
        _rows(memory, project_id)
        .groupBy("project_id", F.to_date("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("facts"))
    )


def search_quality(results: DataFrame, queries: DataFrame, by: str = "project_id") -> DataFrame:
    """Mean similarity of what searches returned, per value of a query column."""
    asked = queries.select("query_id", by)
    return results.join(asked, "query_id").groupBy(by).agg(
        F.count(F.lit(1)).alias("results"), F.avg("similarity").alias("mean_similarity")
    )


def archival_health(memory: DataFrame, project_id: str | None = None) -> DataFrame:
    """Active to archived ratio; NULL while nothing is archived."""
    counted = counts(memory, project_id)
    return counted.select(
        "project_id", "active", "archived",
        F.try_divide(F.col("active").cast("double"), F.col("archived")).alias("active_per_archived"),
    )


def hot_memories(memory: DataFrame, min_hits: int, project_id: str | None = None,
                 k: int | None = None) -> DataFrame:
    """Active, unpinned facts accessed at least ``min_hits`` times: worth a pin."""
    rows = filters.active(_rows(memory, project_id)).filter(
        ~F.col("pinned") & (F.col("access_count") >= min_hits)
    ).select("id", "project_id", "access_count")
    return rows if k is None else rows.orderBy(F.desc("access_count"), "id").limit(k)


def orphaned(memory: DataFrame, as_of, days: int = 7, project_id: str | None = None) -> DataFrame:
    """Never accessed and at least ``days`` old."""
    rows = _rows(memory, project_id)
    old = F.col("created_at") <= days_before(moment(memory, as_of, "created_at"), days)
    return rows.filter((F.col("access_count") == 0) & old)


def event_counts(events: DataFrame, as_of) -> DataFrame:
    """Promotions in all and searches of the current day, per project."""
    today = day_start(moment(events, as_of, "ts")).cast(events.schema["ts"].dataType)
    return events.groupBy("project_id").agg(
        F.count_if(F.col("kind") == "promote").alias("promoted_from_archive"),
        F.count_if((F.col("kind") == "recall") & (F.col("ts") >= today)).alias("searches_today"),
    )


def tool_log_report(log: DataFrame, exact: bool = True) -> DataFrame:
    """Calls, failures and durations per tool, agent and hour.

    Exact percentiles come from a running sum over the counts of the distinct
    durations, so no buffer holds a group; ``exact=False`` takes bounded sketches
    and saves the sort.
    """
    keys = ["tool", "agent_id", "hour"]
    calls = log.withColumn("hour", F.date_trunc("hour", "timestamp"))
    aggregates = [
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("success")).alias("failures"),
        F.avg("duration_ms").alias("mean_ms"),
        F.max("duration_ms").alias("max_ms"),
    ]
    shares = {"p50_ms": 0.5, "p95_ms": 0.95}
    if not exact:
        report = calls.groupBy(*keys).agg(*aggregates, *(
            F.percentile_approx("duration_ms", F.lit(p), F.lit(10_000)).cast("double").alias(name)
            for name, p in shares.items()
        ))
        return report.withColumn("error_rate", F.col("failures") / F.col("calls"))
    values = calls.filter(F.col("duration_ms").isNotNull()).groupBy(*keys, "duration_ms").agg(
        F.count(F.lit(1)).alias("n")
    )
    group = Window.partitionBy(*keys)
    ranked = values.withColumn("upto", F.sum("n").over(group.orderBy("duration_ms"))).withColumn(
        "total", F.sum("n").over(group)
    )

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("duration_ms")))

    def quantile(p: float) -> Column:
        place = (F.col("total") - 1) * p
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * (F.max(place) - F.floor(F.max(place)))

    quantiles = ranked.groupBy(*keys).agg(*(quantile(p).alias(name) for name, p in shares.items()))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys]
    return (
        calls.groupBy(*keys).agg(*aggregates).alias("r").join(quantiles.alias("q"), same, "left")
        .select("r.*", *shares).withColumn("error_rate", F.col("failures") / F.col("calls"))
    )
