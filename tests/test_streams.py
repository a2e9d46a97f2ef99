from pool import fact, table
from pyspark.sql import functions as F

from factlake.sources import tables
from factlake.streaming import streams


def as_stream(spark, path, batches, schema):
    """One file per batch, read in order."""
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema)
        frame = frame.select(*[F.col(c).cast("timestamp") if c in ("ts", "created_at") else F.col(c)
                               for c in frame.columns])
        frame.coalesce(1).write.parquet(f"{path}/n={n}")
    kinds = frame.schema
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def finish(stream, tmp_path, mode="append"):
    return streams.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"), mode)


def test_late_facts_are_dropped_after_the_watermark(spark, tmp_path):
    stream = as_stream(spark, str(tmp_path / "in"), [
        [("p", "2025-01-01 10:00:00"), ("p", "2025-01-02 10:00:00")],
        [("p", "2025-01-05 10:00:00")], [("p", "2025-01-05 11:00:00")],
        [("p", "2025-01-01 11:00:00"), ("p", "2025-01-09 10:00:00")],
    ], "project_id string, created_at string")
    rows = finish(streams.growth(stream), tmp_path).collect()
    assert {str(r.day)[:10]: r.facts for r in rows} == {"2025-01-01": 1, "2025-01-02": 1, "2025-01-05": 2}


def test_late_touch_only_raises_the_last_access(spark, tmp_path):
    stream = as_stream(spark, str(tmp_path / "in"), [
        [("a", "2025-01-05 00:00:00")], [("a", "2025-01-01 00:00:00")],
    ], "id string, ts string")
    out = finish(streams.access_fold(stream), tmp_path, "update")
    last = out.groupBy("id").agg(F.max_by(F.struct("hits", "last_ts"), "batch_id").alias("v")).first().v
    assert (last.hits, str(last.last_ts)) == (2, "2025-01-05 00:00:00")


def test_sweep_emits_facts_left_alone(spark, tmp_path):
    stream = as_stream(spark, str(tmp_path / "in"), [
        [("a", "2025-01-01 00:00:00"), ("b", "2025-01-01 00:00:00")],
        [("b", "2025-01-20 00:00:00")],
        [("c", "2025-02-10 00:00:00")],
    ], "id string, ts string")
    rows = finish(streams.archive_sweep(stream), tmp_path).collect()
    assert {(r.id, str(r.stale_at)) for r in rows} == {("a", "2025-01-31 00:00:00")}


def test_runaway_agent(spark, tmp_path):
    calm = [("calm", f"2025-01-01 00:0{i}:00") for i in range(5)]
    wild = [("wild", f"2025-01-01 00:00:0{i}") for i in range(5)]
    end = [("x", "2025-01-02 00:00:00")]
    stream = as_stream(spark, str(tmp_path / "in"), [calm + wild, end], "agent string, ts string")
    rows = finish(streams.write_rate_alerts(stream, 3), tmp_path).collect()
    assert {r.agent for r in rows} == {"wild"} and max(r.writes for r in rows) == 5


def test_repeated_events_are_dropped(spark, tmp_path):
    stream = as_stream(spark, str(tmp_path / "in"), [
        [("e1", "2025-01-01 00:00:00")], [("e1", "2025-01-01 00:00:10"), ("e2", "2025-01-01 00:00:20")],
    ], "event_id string, ts string")
    assert finish(streams.exactly_once(stream), tmp_path).count() == 2


def test_import_stream_resumes(spark, tmp_path):
    root, state = str(tmp_path / "live"), str(tmp_path / "state")
    tables.write_snapshot(table(spark, [fact("s", [1, 0])]), root)
    schema = ("ordinal long, content string, tags array<string>, repo string, importance string, "
              "embedding array<float>")
    batches = [
        [(0, "dup", None, None, None, [1.0, 0.0]), (1, "new", None, None, None, [0.0, 1.0])],
        [(2, "dup of new", None, None, None, [0.0, 1.0]), (3, "third", None, None, None, [-1.0, 0.0])],
    ]
    stream = as_stream(spark, str(tmp_path / "in"), batches, schema)
    for _ in range(2):
        streams.import_stream(
            stream, root, state, "p", "alice/coder", "2025-02-01 00:00:00").awaitTermination()
    rows = tables.read_snapshot(spark, root)
    assert sorted(r.content for r in rows.collect()) == ["content s", "new", "third"]
    assert tables.latest_version(spark, root) == 2
