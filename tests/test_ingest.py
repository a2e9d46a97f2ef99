import numpy as np
import pytest
from pool import clustered, fact, similarities, table
from pyspark.sql import functions as F

from factlake.operators import ingest, remember, search

AS_OF = "2025-02-01 00:00:00"
ENTRY = "ordinal long, content string, tags array<string>, repo string, importance string, embedding array<float>"


def sequential_import(facts, items, agent, threshold):
    """The items one after the other, the author's own row first on a tie."""
    stored = [(f[3], f[4]) for f in facts if f[1] == "p" and not f[11] and f[3] is not None]
    actions = {}
    for ordinal, _, _, _, _, vector in items:
        hits = []
        if stored:
            s = similarities([vector], [v for v, _ in stored])[0]
            hits = [(-x, author != agent) for x, (_, author) in zip(s, stored) if x > threshold]
        if hits and not min(hits)[1]:
            actions[ordinal] = "skip"
            continue
        actions[ordinal] = "insert_corroborated" if hits else "insert"
        stored.append((vector, agent))
    return actions


@pytest.mark.parametrize("seed, threshold", [(1, 0.95), (2, 0.9), (3, 0.8)])
def test_import_is_sequential(spark, seed, threshold):
    rng = np.random.default_rng(seed)
    vectors = clustered(rng, 130, copies=0.15)
    facts = [fact(f"s{i}", vectors[i], author=["alice/coder", "bob/coder"][i % 2],
                  archived=i % 9 == 0, project="p" if i % 5 else "other") for i in range(50)]
    items = [(i, f"text {i}", None, None, None, [float(x) for x in vectors[i]]) for i in range(50, 130)]
    batch = spark.createDataFrame(items, ENTRY)
    decided = ingest.import_decisions(table(spark, facts), batch, "p", "alice/coder", threshold)
    assert {r.ordinal: r.action for r in decided.collect()} == sequential_import(
        facts, items, "alice/coder", threshold)


def test_import_on_large_plan(spark, small_blocks):
    test_import_is_sequential(spark, 5, 0.9)


def test_import_rows_and_summary(spark):
    memory = table(spark, [fact("s", [1, 0], author="bob/coder")])
    entries = spark.createDataFrame([
        (0, "same as bob", ["x"], None, "critical", [1.0, 0.0]),
        (1, "same as bob", None, None, None, [1.0, 0.0]),
        (2, "new", None, "r", None, [0.0, 1.0]),
        (3, "  ", None, None, None, [0.0, 1.0]),
        (4, "y" * 2001, None, None, None, [0.0, 1.0]),
    ], ENTRY)
    after, outcomes = ingest.import_batch(memory, entries, "p", "alice/coder", AS_OF, on_invalid="drop")
    summary = ingest.import_summary(outcomes).first()
    assert (summary.imported, summary.skipped, summary.errors) == (2, 1, 2)
    new = {r.content: r for r in after.filter("id <> 's'").collect()}
    assert new["same as bob"].tags == ["x", "corroborated"] and new["same as bob"].pinned
    assert new["new"].tags == [] and new["new"].repo == "r" and new["new"].engineer == "alice"
    assert not new["new"].pinned and new["new"].access_count == 0
    untouched, outcomes = ingest.import_batch(memory, entries, "p", "alice/coder", AS_OF)
    assert untouched.count() == 1
    assert [r.message for r in ingest.import_errors(outcomes).orderBy("ordinal").collect()] == [
        "Item 3: content must not be empty",
        "Item 4: content exceeds maximum length of 2000 characters"]


def test_import_twice_adds_nothing(spark):
    entries = spark.createDataFrame(
        [(i, f"statement {i} about topic {i * 7}", None, None, None) for i in range(30)],
        "ordinal long, content string, tags array<string>, repo string, importance string")
    empty = table(spark, [])
    once, _ = ingest.import_batch(empty, entries, "p", "alice/coder", AS_OF, threshold=0.999)
    twice, outcomes = ingest.import_batch(once, entries, "p", "alice/coder", AS_OF, threshold=0.999)
    assert ingest.import_summary(outcomes).first().imported == 0
    assert twice.count() == once.count()


def test_remember(spark):
    memory = table(spark, [
        fact("own", [1, 0], author="alice/coder", tags=["keep"]),
        fact("other", [0, 1], author="bob/coder"),
        fact("old", [-1, 0], author="alice/coder", archived=True),
    ])
    facts = spark.createDataFrame([
        (1, "p", "alice/coder", "refined", None, "r1", "critical", [1.0, 0.01]),
        (2, "p", "alice/coder", "confirmed", ["t"], None, None, [0.01, 1.0]),
        (3, "p", "alice/coder", "again", None, None, "critical", [-1.0, 0.0]),
        (4, "q", "alice/coder", "elsewhere", None, None, None, [1.0, 0.0]),
        (5, "p", "alice/coder", "refined", ["late"], None, None, [1.0, 0.01]),
        (6, "p", "alice/coder", "", None, None, None, [1.0, 0.0]),
    ], "seq long, project_id string, created_by string, content string, tags array<string>, "
       "repo string, importance string, embedding array<float>")
    after, report = remember.remember_batch(memory, facts, AS_OF)
    assert {r.seq: r.action for r in report.collect()} == {
        1: "update", 2: "insert_corroborated", 3: "insert", 4: "insert", 5: "update", 6: "reject"}
    rows = {r.content: r for r in after.collect()}
    own = rows["refined"]
    assert own.id == "own" and own.tags == ["late"] and own.repo == "r1"
    assert own.importance == "critical" and not own.pinned and str(own.updated_at) == AS_OF
    assert rows["confirmed"].tags == ["t", "corroborated"]
    assert rows["again"].pinned and rows["elsewhere"].project_id == "q"
    assert after.count() == 6


def test_decision_looks_at_the_nearest_only(spark):
    memory = table(spark, [fact("near", [1, 0.0], author="bob/coder"), fact("own", [1, 0.2])])
    candidates = spark.createDataFrame(
        [(1, "p", [1.0, 0.0], "alice/coder")],
        "candidate_id long, project_id string, embedding array<float>, created_by string")
    matches = search.dedup_check(memory, candidates)
    assert [r.id for r in matches.orderBy("rank").collect()] == ["near", "own"]
    assert ingest.decide_action(candidates, matches).first().action == "insert_corroborated"
    other = candidates.withColumn("created_by", F.lit("bob/coder"))
    assert ingest.decide_action(other, matches, "remember").first().action == "update"
    assert ingest.decide_action(other, matches, "import").first().action == "skip"
