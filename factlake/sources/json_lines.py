"""JSON lines in: import files, tool logs, event streams."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.functions.scalars import is_importance, trimmed, utf16_length
from factlake.schema import EVENT_SCHEMA, MAX_CONTENT_LENGTH, TOOL_LOG_SCHEMA
from factlake.session import materialize


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line`` of the non-blank lines, numbered from 1 in file order.

    Lines carry their place within the split that read them.  They are counted
    in runs of at most 4096, and only these counts are put in order, so a file
    larger than a task is numbered exactly without sorting its lines.
    """
    span = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            F.col("value").alias("line"),
        )
        .filter(trimmed(F.col("line")) != "")
        .withColumn("run", F.floor(F.col("at") / 4096))
    )
    run = ["file", "block", "run"]
    sizes = materialize(span.groupBy(*run).agg(F.count(F.lit(1)).alias("n")), "line-runs")
    # Runs inside a block are numbered there, blocks inside their file, files among each other.
    earlier = (Window.unboundedPreceding, -1)
    in_block = Window.partitionBy("file", "block").orderBy("run").rowsBetween(*earlier)
    blocks = sizes.groupBy("file", "block").agg(F.sum("n").alias("n"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(*earlier)
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    before = _files_before(materialize(files, "line-files"))
    starts = (
        sizes.withColumn("run_start", F.coalesce(F.sum("n").over(in_block), F.lit(0)))
        .join(blocks.withColumn("block_start", F.coalesce(F.sum("n").over(in_file), F.lit(0))).drop("n"),
              ["file", "block"])
        .join(before, "file")
        .select(*run, (F.col("run_start") + F.col("block_start") + F.col("file_start")).alias("start"))
    )
    inside = Window.partitionBy(*run).orderBy("at")
    return (
        span.withColumn("n", F.row_number().over(inside))
        .join(starts, run)
        .select((F.col("start") + F.col("n")).alias("line_no"), "line")
    )


def _files_before(files: DataFrame) -> DataFrame:
    """``file, file_start``: the lines of all files whose name is smaller.

    The names are cut into at most 256 ranges of about equal size.  Files are
    summed up inside their range, and only one total per range meets in one
    place, so nothing is compared pair by pair whatever the number of files.
    """
    count = files.count()
    # The bounds only decide where the work is cut, so an approximate choice is as good as any.
    hashed = max(1, (4096 << 20) // max(1, count))
    chosen = files.filter(F.pmod(F.xxhash64("file"), F.lit(1 << 20)) < min(1 << 20, hashed)).select("file")
    names = sorted(row.file for row in chosen.limit(1 << 14).collect())
    bounds = names[::max(1, len(names) // 255)] if count > 4096 else []
    part = F.lit(0)
    if bounds:
        listed = F.array(*[F.lit(name) for name in bounds])
        part = F.aggregate(listed, F.lit(0), lambda done, bound: done + (bound <= F.col("file")).cast("int"))
    placed = files.withColumn("part", part)
    earlier = (Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(*earlier)
    return placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, "part").select(
        "file", (F.col("part_start") + F.col("inside")).alias("file_start"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def parse_import_lines(lines: DataFrame, max_len: int | None = MAX_CONTENT_LENGTH):
    """(entries, warnings) from ``line_no, line`` rows.

    A bad line is dropped with one warning; a bad optional field is dropped
    with one warning each and the line kept.
    """
    parsed = F.try_parse_json(F.col("line"))

    def field(name: str) -> Column:
        return F.try_variant_get("json", f"$.{name}", "variant")

    staged = lines.withColumn("json", parsed).withColumns({
        "top": _kind(F.col("json")),
        "content_v": field("content"), "tags_v": field("tags"),
        "repo_v": field("repo"), "importance_v": field("importance"),
    })
    # A field that is present as JSON null still has a variant, of type VOID.
    content = F.when(
        _kind(F.col("content_v")) == "STRING", F.try_variant_get("content_v", "$", "string")
    )
    empty_list = F.to_json("tags_v") == "[]"
    tags_ok = F.coalesce(
        ((_kind(F.col("tags_v")) == "ARRAY<STRING>") & ~_has_null_item("tags_v")) | empty_list,
        F.lit(False),
    )
    repo_ok = _kind(F.col("repo_v")) == "STRING"
    importance_ok = (_kind(F.col("importance_v")) == "STRING") & is_importance(
        F.try_variant_get("importance_v", "$", "string")
    )
    staged = staged.withColumn("content", content)
    fatal = (
        F.when(F.col("json").isNull(), "is not valid JSON, skipping")
        .when(~F.startswith(F.col("top"), F.lit("OBJECT")), "is not a JSON object, skipping")
        .when(F.coalesce(trimmed(F.col("content")), F.lit("")) == "",
              'missing or empty "content" field, skipping')
    )
    if max_len is not None:
        fatal = fatal.when(utf16_length(F.col("content")) > max_len,
                           f"content exceeds {max_len} chars, skipping")

    def complaint(value: str, ok: Column, message: str) -> Column:
        return F.when(F.col(value).isNotNull() & ~F.coalesce(ok, F.lit(False)), message)

    minor = F.array_compact(F.array(
        complaint("tags_v", tags_ok, 'has invalid "tags" (expected string[]), ignoring tags'),
        complaint("repo_v", repo_ok, 'has invalid "repo" (expected string), ignoring repo'),
        complaint("importance_v", importance_ok,
                  'has invalid "importance" (expected normal/high/critical), ignoring'),
    ))
    fatal_list = F.array(F.col("fatal"))
    staged = staged.withColumn("fatal", fatal).withColumn(
        "notes", F.when(F.col("fatal").isNotNull(), fatal_list).otherwise(minor)
    )
    entries = staged.filter(F.col("fatal").isNull()).select(
        F.col("line_no").alias("ordinal"), "content",
        F.when(tags_ok, F.try_variant_get("tags_v", "$", "array<string>")).alias("tags"),
        F.when(repo_ok, F.try_variant_get("repo_v", "$", "string")).alias("repo"),
        F.when(importance_ok, F.try_variant_get("importance_v", "$", "string")).alias("importance"),
    )
    warnings = staged.select("line_no", F.explode("notes").alias("note")).select(
        "line_no",
        F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" "), F.col("note"))
        .alias("warning"),
    )
    return entries, warnings


def _has_null_item(column: str) -> Column:
    items = F.try_variant_get(column, "$", "array<string>")
    return F.exists(items, lambda item: item.isNull())


def read_import_jsonl(spark: SparkSession, path: str, max_len: int | None = MAX_CONTENT_LENGTH):
    """(entries, warnings) of one import file; ordinals are its line numbers.

    ``max_len=None`` takes contents of any length.
    """
    return parse_import_lines(numbered_lines(spark, path), max_len)


def read_tool_log(spark: SparkSession, path: str) -> DataFrame:
    """Tool-invocation log; unreadable lines keep their text in ``_corrupt_record``."""
    return spark.read.schema(TOOL_LOG_SCHEMA).json(
        path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record"
    )


def stream_memory_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Operations on facts as an unbounded table, one JSON object per event."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)
