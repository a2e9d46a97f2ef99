"""Streams in, streams out; sinks and triggers are the caller's choice.

State is keyed by id, tool or agent and bounded by watermarks wherever the
result allows it.  Use the RocksDB state store on a cluster.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factlake.functions.embed import Embedder
from factlake.operators.ingest import append_memories, imported_facts
from factlake.schema import ARCHIVE_AFTER_DAYS, DEDUP_THRESHOLD
from factlake.sources.tables import append_snapshot, latest_version, read_snapshot


# Kinds of events that change no content or flag.
READS = ("touch", "recall")


def exactly_once(stream: DataFrame, key: str = "event_id", ts: str = "ts",
                 delay: str = "1 hour") -> DataFrame:
    """Drop redelivered events whose repeat comes within ``delay`` of the first."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def access_fold(touches: DataFrame) -> DataFrame:
    """Running accesses and last access per id, for the update mode.

    A late touch still counts and only ever raises the last access time.
    """
    return touches.groupBy("id").agg(
        F.count(F.lit(1)).alias("hits"), F.max("ts").alias("last_ts")
    )


def growth(facts: DataFrame, ts: str = "created_at", delay: str = "1 day") -> DataFrame:
    """New facts per project and day, each day final once the watermark passes it."""
    return (
        facts.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("w"), "project_id")
        .agg(F.count(F.lit(1)).alias("facts"))
        .select(F.col("w.start").alias("day"), "project_id", "facts")
    )


def write_rate_alerts(writes: DataFrame, most: int, length: str = "1 minute",
                      slide: str = "10 seconds", ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Agents that wrote more than ``most`` facts within a sliding window.

    Events with a ``kind`` that only reads or touches a fact are no writes.
    """
    if "kind" in writes.columns:
        writes = writes.filter(~F.col("kind").isin(*READS))
    return (
        writes.withWatermark(ts, delay)
        .groupBy(F.window(ts, length, slide).alias("w"), "agent")
        .agg(F.count(F.lit(1)).alias("writes"))
        .filter(F.col("writes") > most)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "agent", "writes")
    )


def tool_log(log: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Calls, failures and durations per tool and window, with bounded sketches."""
    return (
        log.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", length).alias("w"), "tool")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(~F.col("success")).alias("failures"),
            F.avg("duration_ms").alias("mean_ms"),
            F.max("duration_ms").alias("max_ms"),
            F.percentile_approx("duration_ms", F.lit(0.95), F.lit(1000)).alias("p95_ms"),
        )
        .select(F.col("w.start").alias("window_start"), "tool", "calls", "failures",
                "mean_ms", "max_ms", "p95_ms")
    )


def archive_sweep(accesses: DataFrame, days: int = ARCHIVE_AFTER_DAYS, ts: str = "ts",
                  delay: str = "0 seconds") -> DataFrame:
    """Facts that fell out of use: ``id, last_ts, stale_at``.

    Accesses (and the creation) of a fact form one session as long as none is
    ``days`` after the one before; when the watermark passes the end of a
    session, the fact has been left alone that long.  :func:`due_for_archive`
    leaves out what the snapshot keeps.  A fact that nobody ever accessed is
    covered by its creation.
    """
    return (
        accesses.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, f"{days} days").alias("s"), "id")
        .agg(F.max(ts).alias("last_ts"))
        .select("id", "last_ts", F.col("s.end").alias("stale_at"))
    )


def due_for_archive(stale: DataFrame, memory: DataFrame) -> DataFrame:
    """Stale facts that the snapshot has as neither pinned nor archived."""
    kept = memory.filter("not pinned and not archived").select("id")
    return stale.join(kept, "id", "left_semi")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window was final, over all batches reported."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress for operator in progress["stateOperators"]
    )


def import_stream(
    entries: DataFrame,
    root: str,
    checkpoint: str,
    project_id: str,
    agent: str,
    as_of,
    embedder: Embedder | None = None,
    threshold: float = DEDUP_THRESHOLD,
) -> StreamingQuery:
    """Import arriving entries against the current snapshot under ``root``.

    Every micro-batch becomes one snapshot version numbered after it, so a
    batch that is replayed after a failure finds its version published.  Only
    its new facts are written.
    """
    spark = entries.sparkSession
    first = latest_version(spark, root)
    if first is None:
        raise ValueError(f"no snapshot under {root} to import into")
    base = _base_version(spark, root, checkpoint, first)

    def store(batch: DataFrame, batch_id: int) -> None:
        version = base + 1 + batch_id
        current = latest_version(spark, root)
        if current is not None and current >= version:
            return
        memory = read_snapshot(spark, root)
        added, _ = imported_facts(
            memory, batch, project_id, agent, as_of, embedder, threshold, on_invalid="drop"
        )
        append_snapshot(append_memories(memory.filter(F.lit(False)), added, as_of), root, version)

    return (
        entries.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _base_version(spark: SparkSession, root: str, checkpoint: str, first: int) -> int:
    """The version the stream started from, remembered beside its checkpoint."""
    path = f"{checkpoint.rstrip('/')}-base"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        spark.range(1).selectExpr(f"{first}L AS version").coalesce(1).write.json(path)
    return spark.read.schema("version long").json(path).first().version


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all available input into a parquet table and return that table.

    In update mode the last value of every key wins in the order of batches,
    so the table carries ``batch_id``.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).outputMode("append").start()
        schema = stream.schema
    else:
        def store(batch: DataFrame, batch_id: int) -> None:
            folder = f"{path}/batch_id={batch_id}"
            batch.write.mode("overwrite").parquet(folder)

        query = writer.foreachBatch(store).outputMode(mode).start()
        schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(path)
