"""Rows that must not be lost, doubled or corrupted: one case each."""

import numpy as np
import pyarrow as pa
import pytest
from pool import fact, table
from pyspark.sql import functions as F

from factlake.operators import ingest, lifecycle, remember
from factlake.operators.duplicates import duplicate_clusters
from factlake.sources import tables

AS_OF, LATER = "2025-02-05 00:00:00", "2025-03-01 00:00:00"


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_two_corrections_of_one_fact(spark):
    memory = table(spark, [fact("a", [1, 0]), fact("b", [1, 0])])
    changes = spark.createDataFrame([("a", "first", 1), ("a", "second", 2)], "id string, new_content string, seq long")
    after, _ = lifecycle.correct(memory, changes, AS_OF)
    rows = by_id(after)
    assert after.count() == 2 and rows["a"].content == "second"
    unordered, _ = lifecycle.correct(memory, changes.drop("seq"), AS_OF)
    assert unordered.count() == 2


def test_tag_edits_apply_in_order(spark):
    memory = table(spark, [fact("a", [1, 0], tags=["x", "y"]), fact("b", [1, 0], tags=["x"])])
    edits = spark.createDataFrame(
        [("a", ["z"], ["x"], 1), ("a", ["x"], None, 2), ("a", None, ["z"], 3), ("a", None, None, 4)],
        "id string, add array<string>, remove array<string>, seq long",
    )
    after, _ = lifecycle.set_tags(memory, edits, AS_OF)
    rows = by_id(after)
    assert after.count() == 2 and rows["a"].tags == ["y", "x"] and rows["b"].tags == ["x"]
    one, _ = lifecycle.set_tags(memory, edits.drop("seq"), AS_OF)
    assert by_id(one)["a"].tags == ["y"]


def test_replay_renews_vector_and_lexemes(spark):
    memory = table(spark, [fact("a", [1, 0], content="old words")]).withColumn("tsv", F.array(F.lit("old"), F.lit("words")))
    events = spark.createDataFrame(
        [("a", "correct", 1, "fixed text"), ("a", "touch", 2, None)], "id string, kind string, seq long, payload string"
    ).withColumn("ts", F.lit("2000-01-01 00:00:00").cast(memory.schema["updated_at"].dataType))
    before = memory.first()
    row = lifecycle.replay_events(memory, events)[0].first()
    assert row.content == "fixed text" and row.tsv is None and list(row.embedding) != list(before.embedding)
    assert row.last_accessed_at == before.last_accessed_at


def test_same_import_after_archiving_gets_other_ids(spark):
    memory = table(spark, [])
    entries = spark.createDataFrame(
        [(1, "a text", None, None, None)],
        "ordinal long, content string, tags array<string>, repo string, importance string",
    )
    once, _ = ingest.import_batch(memory, entries, "p", "alice/coder", AS_OF)
    archived, _ = lifecycle.set_archived(once, once.select("id"), True, AS_OF)
    twice, outcomes = ingest.import_batch(archived, entries, "p", "alice/coder", LATER)
    assert [r.outcome for r in outcomes.collect()] == ["imported"]
    assert twice.count() == twice.select("id").distinct().count() == 2


def test_texts_without_words_are_all_imported(spark):
    entries = spark.createDataFrame(
        [(1, "!!!"), (2, "???"), (3, "words"), (4, "x" * 5000)], "ordinal long, content string"
    ).withColumns({"tags": F.lit(None).cast("array<string>"), "repo": F.lit(None).cast("string"),
                   "importance": F.lit(None).cast("string")})
    after, outcomes = ingest.import_batch(table(spark, []), entries, "p", "alice/coder", AS_OF, max_len=None)
    assert after.count() == 4 and {r.outcome for r in outcomes.collect()} == {"imported"}


def test_missing_vectors_of_an_import_are_made(spark):
    entries = spark.createDataFrame(
        [(1, "one", None), (2, "two", [0.0, 1.0] + [0.0] * 62)], "ordinal long, content string, embedding array<float>"
    ).withColumns({"tags": F.lit(None).cast("array<string>"), "repo": F.lit(None).cast("string"),
                   "importance": F.lit(None).cast("string")})
    after, _ = ingest.import_batch(table(spark, []), entries, "p", "alice/coder", AS_OF)
    assert after.filter("embedding is null").count() == 0 and after.count() == 2


def test_projects_named_like_numbers(spark, tmp_path):
    memory = table(spark, [fact("a", [1, 0], project="007"), fact("b", [1, 0], project="012")])
    tables.write_memory(memory, str(tmp_path / "m"))
    back = tables.scan_memory(spark, str(tmp_path / "m"))
    assert sorted(r.project_id for r in back.collect()) == ["007", "012"]
    assert tables.scan_memory(spark, str(tmp_path / "m"), "007").count() == 1


def test_zero_vectors_are_no_cluster(spark):
    memory = table(spark, [fact("a", [0, 0]), fact("b", [0, 0]), fact("c", [1, 0]), fact("d", [1, 0])])
    assert {r.id for r in duplicate_clusters(memory).collect()} == {"c", "d"}


def test_near_misses_do_not_hide_a_later_hit():
    from factlake.operators import kernel

    angle = np.arccos(0.95 - 2e-9)
    rows = [[np.cos(angle), np.sin(angle)]] * 7 + [[np.cos(0.1), np.sin(0.1)]]
    probes = kernel.Probes(
        ids=np.array(["q"], dtype=object), parts={"p": np.array([0])}, vectors=np.array([[1.0, 0.0]]),
        threshold=np.array([0.95]), floor=np.array([-2.0]), limit=np.array([1]), before=np.array([100]), scope=None,
    )
    best = kernel.BestHits(probes, by_order=True)
    best.add(pa.table({
        "vec": pa.array(rows, type=pa.list_(pa.float64())), "id": [str(i) for i in range(8)],
        "part": ["p"] * 8, "ord": list(range(8)),
    }))
    assert best.result().column("id").to_pylist() == ["7"]


def test_vectors_with_holes_are_refused():
    from factlake.operators.kernel import unit_matrix

    with pytest.raises(ValueError):
        unit_matrix(pa.array([[1.0, None], [1.0, 2.0]]))
    with pytest.raises(ValueError):
        unit_matrix(pa.array([[1.0, 2.0, 3.0], [1.0]]))
    with pytest.raises(ValueError):
        unit_matrix(pa.array([[1.0, 2.0], None]))


def test_remember_drops_old_lexemes(spark):
    memory = table(spark, [fact("a", [1, 0], content="old words", author="alice/coder")]).withColumn(
        "tsv", F.array(F.lit("old"), F.lit("words")))
    facts = spark.createDataFrame(
        [(1, memory.first().project_id, "alice/coder", "new text", None, None, None, [1.0, 0.0])],
        "seq long, project_id string, created_by string, content string, tags array<string>, repo string, "
        "importance string, embedding array<float>",
    )
    after, report = remember.remember_batch(memory, facts, AS_OF)
    row = after.first()
    assert (row.content, row.tsv, report.first().action) == ("new text", None, "update")
