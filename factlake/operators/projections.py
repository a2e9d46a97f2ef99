"""Result shapes: API rows, search rows, display rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions import scalars as S
from factlake.operators.filters import moment
from factlake.schema import RECALL_COLUMNS

# Column of the table -> name in JSON, in output order.
API_NAMES = {
    "id": "id", "project_id": "projectId", "content": "content",
    "created_by": "createdBy", "engineer": "engineer", "agent_type": "agentType",
    "repo": "repo", "tags": "tags", "importance": "importance", "pinned": "pinned",
    "archived": "archived", "created_at": "createdAt", "updated_at": "updatedAt",
    "last_accessed_at": "lastAccessedAt", "access_count": "accessCount",
}
_TIMES = ("created_at", "updated_at", "last_accessed_at")


def with_identity(df: DataFrame, column: str = "created_by") -> DataFrame:
    """``engineer`` and ``agent_type`` derived from the author."""
    parsed = S.parse_agent_id(F.col(column))
    return df.withColumns({
        "engineer": parsed["engineer"], "agent_type": parsed["agent_type"],
    })


def to_api_rows(df: DataFrame) -> DataFrame:
    return df.select(*[
        (S.iso_timestamp(F.col(c)) if c in _TIMES else F.col(c)).alias(name)
        for c, name in API_NAMES.items()
    ])


def to_recall_rows(df: DataFrame, null_similarity_as_zero: bool = True) -> DataFrame:
    """The 13 search columns; missing tags become none, empty scopes NULL."""
    similarity = F.col("similarity")
    if null_similarity_as_zero:
        similarity = F.coalesce(similarity, F.lit(0.0))
    changed = {
        "similarity": similarity,
        "engineer": F.nullif(F.col("engineer"), F.lit("")),
        "repo": F.nullif(F.col("repo"), F.lit("")),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
    }
    kept = [c for c in df.columns if c in ("query_id", "rank")]
    return df.select(*kept, *[changed.get(c, F.col(c)).alias(c) for c in RECALL_COLUMNS])


def promote_view(results: DataFrame) -> DataFrame:
    """Search results as shown after promotion: nothing is archived any more."""
    return results.withColumn("archived", F.lit(False))


def _yes_no(flag):
    return F.when(flag, "yes").otherwise("no")


def display_rows(df: DataFrame, as_of) -> DataFrame:
    """One display line per fact, with a score if the rows have a similarity."""
    now = moment(df, as_of)
    columns = [
        F.col("id"),
        S.short_id(F.col("id")).alias("short_id"),
        S.truncate_text(F.col("content"), 40).alias("content"),
        F.col("created_by"),
        S.format_tags(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"),
        _yes_no(F.col("pinned")).alias("pinned"),
        _yes_no(F.col("archived")).alias("archived"),
        S.age(F.col("created_at"), now).alias("age"),
        S.relative_time(F.col("last_accessed_at"), now).alias("accessed"),
        S.format_timestamp(F.col("last_accessed_at")).alias("accessed_at"),
    ]
    if "similarity" in df.columns:
        columns.append(S.format_score(F.coalesce("similarity", F.lit(0.0))).alias("score"))
    return df.select(*columns)
