"""Row predicates, optional scopes and validation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.scalars import (
    blank_to_null,
    clean_tags,
    contains_all,
    days_before,
    is_importance,
    trimmed,
    utf16_length,
)
from factlake.functions.text import lexemes
from factlake.schema import ARCHIVE_AFTER_DAYS, MAX_CONTENT_LENGTH, STALE_LISTING_DAYS


def moment(df: DataFrame, as_of, column: str = "last_accessed_at") -> Column:
    """``as_of`` as a literal of the type the table's timestamps have."""
    value = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return value.cast(df.schema[column].dataType)


def by_project(df: DataFrame, project_id: str) -> DataFrame:
    return df.filter(F.col("project_id") == project_id)


def active(df: DataFrame, include_archived: bool = False) -> DataFrame:
    return df if include_archived else df.filter(~F.col("archived"))


def by_agent(df: DataFrame, agent: str | None) -> DataFrame:
    return df if agent is None else df.filter(F.col("created_by") == agent)


def by_engineer(df: DataFrame, engineer: str | None) -> DataFrame:
    return df if engineer is None else df.filter(F.col("engineer") == engineer)


def by_repo(df: DataFrame, repo: str | None) -> DataFrame:
    return df if repo is None else df.filter(F.col("repo") == repo)


def has_all_tags(df: DataFrame, tags: list[str] | None) -> DataFrame:
    if tags is None:
        return df
    wanted = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    return df.filter(contains_all(F.col("tags"), wanted))


def pinned_is(df: DataFrame, pinned: bool | None) -> DataFrame:
    return df if pinned is None else df.filter(F.col("pinned") == pinned)


def _untouched_since(df: DataFrame, as_of, days: int) -> DataFrame:
    cutoff = days_before(moment(df, as_of), days)
    return df.filter(~F.col("pinned") & ~F.col("archived") & (F.col("last_accessed_at") < cutoff))


def approaching_stale(df: DataFrame, as_of, days: int = STALE_LISTING_DAYS) -> DataFrame:
    return _untouched_since(df, as_of, days)


def archival_candidates(df: DataFrame, as_of, days: int = ARCHIVE_AFTER_DAYS) -> DataFrame:
    return _untouched_since(df, as_of, days)


def above_similarity(df: DataFrame, threshold: float, column: str = "similarity") -> DataFrame:
    return df.filter(F.col(column) > F.lit(float(threshold)))


def text_predicate(row_lexemes: Column, query_lexemes: Column) -> Column:
    """All query lexemes are present; a query without lexemes matches nothing."""
    return (F.size(query_lexemes) > 0) & contains_all(row_lexemes, query_lexemes)


def text_match(df: DataFrame, text: str, config: str = "english") -> DataFrame:
    found = F.col("tsv") if "tsv" in df.columns else lexemes(F.col("content"), config)
    return df.filter(text_predicate(found, lexemes(F.lit(text), config)))


def normalize_scope(queries: DataFrame) -> DataFrame:
    """Blank scope texts and tag lists mean no filter, i.e. NULL."""
    return queries.withColumns({
        "agent": blank_to_null(F.col("agent")),
        "engineer": blank_to_null(F.col("engineer")),
        "repo": blank_to_null(F.col("repo")),
        "tags": clean_tags(F.col("tags")),
    })


def content_reason(content: Column, max_len: int | None = MAX_CONTENT_LENGTH) -> Column:
    """Why a content is refused, else NULL; ``max_len=None`` takes any length."""
    reason = F.when(F.coalesce(trimmed(content), F.lit("")) == "", "CONTENT_EMPTY")
    return reason if max_len is None else reason.when(utf16_length(content) > max_len, "CONTENT_TOO_LONG")


def split_by_reason(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a ``reason`` column)."""
    marked = df.withColumn("reason", reason)
    valid = marked.filter(F.col("reason").isNull()).drop("reason")
    return valid, marked.filter(F.col("reason").isNotNull())


def validate_content(df: DataFrame, max_len: int = MAX_CONTENT_LENGTH):
    return split_by_reason(df, content_reason(F.col("content"), max_len))


def validate_importance(df: DataFrame):
    bad = F.col("importance").isNotNull() & ~is_importance(F.col("importance"))
    return split_by_reason(df, F.when(bad, "IMPORTANCE_INVALID"))


def validate_queries(df: DataFrame):
    threshold = F.col("threshold")
    return split_by_reason(
        df,
        F.when(F.coalesce(F.col("question"), F.lit("")) == "", "QUESTION_EMPTY")
        .when(F.col("limit") <= 0, "LIMIT_NOT_POSITIVE")
        .when((threshold < 0) | (threshold > 1), "THRESHOLD_OUT_OF_RANGE"),
    )
