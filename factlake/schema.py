"""Table shapes, defaults and closed domains."""

from pyspark.sql import types as T

# Defaults of the operators.
ARCHIVE_AFTER_DAYS = 30
STALE_LISTING_DAYS = 20
DEDUP_THRESHOLD = 0.95
SEARCH_THRESHOLD = 0.3
SEARCH_LIMIT = 10
DEDUP_LIMIT = 3
PREFIX_LIMIT = 10
MAX_CONTENT_LENGTH = 2000
EMBED_CHUNK = 100
IMPORTANCE = ("normal", "high", "critical")
CORROBORATED = "corroborated"

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)
TAGS = T.ArrayType(T.StringType())


def memory_schema(timestamp: T.DataType = T.TimestampType()) -> T.StructType:
    """Schema of the fact table; pass ``TimestampNTZType()`` for wall-clock time."""
    return (
        T.StructType()
        .add("id", T.StringType(), False)
        .add("project_id", T.StringType(), False)
        .add("content", T.StringType(), False)
        .add("embedding", VECTOR)
        .add("created_by", T.StringType(), False)
        .add("engineer", T.StringType())
        .add("agent_type", T.StringType())
        .add("repo", T.StringType())
        .add("tags", TAGS)
        .add("importance", T.StringType(), False)
        .add("pinned", T.BooleanType(), False)
        .add("archived", T.BooleanType(), False)
        .add("created_at", timestamp, False)
        .add("updated_at", timestamp, False)
        .add("last_accessed_at", timestamp, False)
        .add("access_count", T.IntegerType(), False)
    )


MEMORY_SCHEMA = memory_schema()

# Columns a search returns, in order; the vector never leaves the engine.
RECALL_COLUMNS = (
    "id", "content", "similarity", "created_by", "engineer", "repo", "tags",
    "importance", "pinned", "archived", "access_count", "created_at",
    "last_accessed_at",
)

QUERY_SCHEMA = (
    T.StructType()
    .add("query_id", T.LongType(), False)
    .add("project_id", T.StringType(), False)
    .add("question", T.StringType())
    .add("embedding", VECTOR)
    .add("agent", T.StringType())
    .add("engineer", T.StringType())
    .add("repo", T.StringType())
    .add("tags", TAGS)
    .add("limit", T.IntegerType())
    .add("threshold", T.DoubleType())
    .add("include_archived", T.BooleanType())
)

IMPORT_SCHEMA = (
    T.StructType()
    .add("ordinal", T.LongType(), False)
    .add("content", T.StringType(), False)
    .add("tags", TAGS)
    .add("repo", T.StringType())
    .add("importance", T.StringType())
)

TOUCH_SCHEMA = (
    T.StructType()
    .add("call_id", T.LongType(), False)
    .add("id", T.StringType(), False)
    .add("ts", T.TimestampType(), False)
)

EVENT_SCHEMA = (
    T.StructType()
    .add("event_id", T.StringType())
    .add("id", T.StringType())
    .add("project_id", T.StringType())
    .add("kind", T.StringType())
    .add("seq", T.LongType())
    .add("ts", T.TimestampType())
    .add("agent", T.StringType())
    .add("payload", T.StringType())
)

TOOL_LOG_SCHEMA = (
    T.StructType()
    .add("timestamp", T.TimestampType())
    .add("tool", T.StringType())
    .add("agent_id", T.StringType())
    .add("project_id", T.StringType())
    .add("duration_ms", T.LongType())
    .add("success", T.BooleanType())
    .add("error", T.StringType())
    .add("_corrupt_record", T.StringType())
)
