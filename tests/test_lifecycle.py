from pool import fact, table
from pyspark.sql import functions as F

from factlake.operators import lifecycle, listing, search
from factlake.operators.textindex import refresh_tsv

AS_OF = "2025-02-01 00:00:00"


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_touch_counts_an_id_once(spark):
    memory = table(spark, [fact("a", count=2), fact("b")])
    after, report = lifecycle.touch(memory, ids(spark, "a", "a", "zz"), AS_OF)
    rows = by_id(after)
    assert rows["a"].access_count == 3 and str(rows["a"].last_accessed_at) == AS_OF
    assert rows["b"].access_count == 0 and rows["a"].updated_at == rows["b"].updated_at
    assert tuple(report.first()) == (3, 1)


def test_fold_access_log(spark):
    memory = table(spark, [fact("a", accessed="2025-01-10 00:00:00")])
    touches = spark.createDataFrame(
        [(1, "a", "2025-01-05 00:00:00"), (1, "a", "2025-01-06 00:00:00"), (2, "a", "2025-01-07 00:00:00")],
        "call_id long, id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    row = lifecycle.fold_access_log(memory, touches)[0].first()
    assert row.access_count == 2 and str(row.last_accessed_at) == "2025-01-10 00:00:00"


def test_sweep(spark):
    memory = table(spark, [
        fact("edge", accessed="2025-01-02 00:00:00"), fact("stale", accessed="2025-01-01 23:59:59"),
        fact("pinned", accessed="2024-01-01 00:00:00", pinned=True), fact("q", project="q"),
    ])
    swept, report = lifecycle.archive_stale(memory, AS_OF)
    assert report.first().affected == 2
    assert {k for k, r in by_id(swept).items() if r.archived} == {"stale", "q"}
    again, report = lifecycle.archive_stale(swept, AS_OF)
    assert report.first().affected == 0 and by_id(again) == by_id(swept)
    restored, _ = lifecycle.set_archived(swept, ids(spark, "stale"), False, AS_OF)
    assert lifecycle.archive_stale(restored, AS_OF)[1].first().affected == 1
    fresh, _ = lifecycle.set_archived(swept, ids(spark, "stale"), False, AS_OF, reset_clock=True)
    assert lifecycle.archive_stale(fresh, AS_OF)[1].first().affected == 0
    assert lifecycle.archive_stale(memory, AS_OF, project_id="p")[1].first().affected == 1


def test_flags_and_forget(spark):
    memory = table(spark, [fact("a"), fact("b", archived=True)])
    pinned, report = lifecycle.set_pinned(memory, ids(spark, "a", "zz"), True, AS_OF)
    assert by_id(pinned)["a"].pinned and str(by_id(pinned)["a"].updated_at) == AS_OF
    assert {r.id: r.status for r in report.collect()} == {"a": "found", "zz": "missing"}
    promoted, _ = lifecycle.promote(memory, ids(spark, "a", "b"), AS_OF)
    rows = by_id(promoted)
    assert not rows["b"].archived and str(rows["a"].updated_at) != AS_OF
    left, _ = lifecycle.forget(memory, ids(spark, "a"))
    assert set(by_id(left)) == {"b"}


def test_correct(spark):
    memory = refresh_tsv(table(spark, [fact("a", [1, 0], content="old"), fact("b", [1, 0])]), "simple")
    edits = spark.createDataFrame([("a", "brand new"), ("b", " "), ("zz", "x")], "id string, new_content string")
    after, report = lifecycle.correct(memory, edits, AS_OF)
    rows = by_id(refresh_tsv(after, "simple"))
    assert rows["a"].content == "brand new" and rows["a"].tsv == ["brand", "new"]
    assert rows["a"].created_by == "alice/coder" and len(rows["a"].embedding) == 64
    assert rows["b"].content == "content b"
    assert {r.id: (r.status, r.old_content) for r in report.collect()} == {
        "a": ("CORRECTED", "old"), "b": ("CONTENT_EMPTY", "content b"), "zz": ("MISSING", None)}


def test_replay_of_a_life(spark):
    memory = table(spark, [fact("a"), fact("b"), fact("c")])
    log = [("a", "touch", 1, None), ("a", "pin", 2, None), ("a", "correct", 3, "fixed"),
           ("a", "unpin", 4, None), ("b", "forget", 5, None), ("b", "pin", 6, None),
           ("a", "touch", 7, None), ("c", "archive", 8, None)]
    events = spark.createDataFrame(
        [(i, k, s, f"2025-01-1{s} 00:00:00", p) for i, k, s, p in log],
        "id string, kind string, seq long, ts string, payload string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = by_id(lifecycle.replay_events(memory, events)[0])
    assert set(rows) == {"a", "c"} and rows["c"].archived
    a = rows["a"]
    assert (a.content, a.pinned, a.access_count) == ("fixed", False, 2)
    assert str(a.updated_at) == "2025-01-14 00:00:00" and str(a.last_accessed_at) == "2025-01-17 00:00:00"


def test_recall_rescues_from_the_archive(spark):
    memory = table(spark, [fact("a", [1, 0], archived=True, count=4), fact("b", [0, 1])])
    query = spark.createDataFrame(
        [(1, "p", "zzz", [1.0, 0.0], True)],
        "query_id long, project_id string, question string, embedding array<float>, include_archived boolean")
    shown, after = search.recall_with_side_effects(memory, query, AS_OF)
    row = shown.first()
    assert row.access_count == 4 and not row.archived
    rows = by_id(after)
    assert not rows["a"].archived and rows["a"].access_count == 5 and rows["b"].access_count == 0


def test_keyset_pages_cover_the_listing(spark):
    memory = table(spark, [fact(f"{i:02d}", created=f"2025-01-{1 + i % 5:02d} 00:00:00") for i in range(23)])
    whole = [r.id for r in listing.list_memories(memory, "p", limit=100).collect()]
    pages, cursor = [], None
    while page := listing.list_after(memory, "p", cursor, limit=5).collect():
        pages += [r.id for r in page]
        cursor = (str(page[-1].created_at), page[-1].id)
    assert pages == whole and len(whole) == 23
