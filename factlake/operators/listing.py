"""Listings: filters, sorting, paging, concatenation, top-k per project."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.operators import filters

SORT_COLUMNS = ("created_at", "updated_at", "last_accessed_at")


def _select(
    memory, project_id, archived, stale, agent, engineer, repo, pinned, tags, as_of
) -> DataFrame:
    rows = filters.by_project(memory, project_id)
    if stale:
        rows = filters.approaching_stale(rows, as_of)
    else:
        rows = rows.filter("archived" if archived else "NOT archived")
    rows = filters.by_agent(rows, agent)
    rows = filters.by_engineer(rows, engineer)
    rows = filters.by_repo(rows, repo)
    rows = filters.pinned_is(rows, pinned)
    return filters.has_all_tags(rows, tags or None)


def _order(order_by: str, direction: str):
    if order_by not in SORT_COLUMNS:
        raise ValueError(f"order_by must be one of {SORT_COLUMNS}")
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be 'asc' or 'desc'")
    return [F.asc(order_by) if direction == "asc" else F.desc(order_by), F.asc("id")]


def matching(memory: DataFrame, project_id: str, *, archived=None, stale=False, agent=None,
             engineer=None, repo=None, pinned=None, tags=None, as_of=None) -> DataFrame:
    """All facts a listing pages through; ``stale`` overrides ``archived``.

    ``.count()`` of it is the match count; the length of a page is its own.
    """
    return _select(memory, project_id, archived, stale, agent, engineer, repo, pinned, tags, as_of)


def list_memories(memory: DataFrame, project_id: str, *, order_by="created_at",
                  direction="desc", limit=20, offset=0, **scope) -> DataFrame:
    """One page, sorted by one of three times, ties by id."""
    rows = matching(memory, project_id, **scope)
    rows = rows.select(*[c for c in rows.columns if c != "embedding"])
    return rows.orderBy(*_order(order_by, direction)).offset(offset).limit(limit)


def list_after(memory: DataFrame, project_id: str, cursor: tuple | None = None, *,
               order_by="created_at", direction="desc", limit=20, **scope) -> DataFrame:
    """The page after ``cursor = (sort value, id)`` without reading skipped rows."""
    rows = matching(memory, project_id, **scope)
    rows = rows.select(*[c for c in rows.columns if c != "embedding"])
    if cursor is not None:
        at = filters.moment(memory, cursor[0], order_by)
        key = F.col(order_by)
        beyond = key > at if direction == "asc" else key < at
        rows = rows.filter(beyond | ((key == at) & (F.col("id") > F.lit(cursor[1]))))
    return rows.orderBy(*_order(order_by, direction)).limit(limit)


def union_active_archived(memory: DataFrame, project_id: str | None = None) -> DataFrame:
    """Active facts, then archived ones, told apart and ordered by ``branch``."""
    rows = memory if project_id is None else filters.by_project(memory, project_id)
    return rows.filter("NOT archived").withColumn("branch", F.lit(0)).unionByName(
        rows.filter("archived").withColumn("branch", F.lit(1))
    )


def top_k_per_project(df: DataFrame, column: str, k: int, tie: str = "id") -> DataFrame:
    """The ``k`` rows with the highest ``column`` of every project, with ``rank``."""
    order = Window.partitionBy("project_id").orderBy(F.desc(column), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
