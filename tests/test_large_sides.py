"""What must stay bounded or linear when both sides of a search are large."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pool import fact, table
from pyspark.sql import functions as F

from factlake.functions import embed
from factlake.functions.embed import HashedWords
from factlake.operators import search, simjoin, textindex
from factlake.operators.simjoin import Limits

ASKED = "query_id long, project_id string, question string, embedding array<float>, limit int, threshold double"


def test_a_row_is_copied_to_few_blocks(spark):
    rows = spark.range(4000).select(
        F.col("id").cast("string"), F.lit("p").alias("part"), F.lit(0).alias("cell"), F.lit(0.0).alias("angle"),
        F.array(F.lit(1.0), F.col("id").cast("double")).alias("vec"))
    probes = rows.withColumnRenamed("id", "query_id").withColumn("_nsub", simjoin._blocks(F.lit(4000), 16))
    left, right = simjoin._with_blocks(rows, probes.drop("angle"), Limits(0, 16, 4))
    assert left.count() <= 2 * 4000 and right.count() <= 2 * 4000
    assert left.select("sub").distinct().count() == left.select("qsub").distinct().count() == 2
    sizes = spark.range(1).select(*(simjoin._blocks(F.lit(n), 16).alias(str(n)) for n in (16, 17, 40_000, 1_000_000)))
    assert list(sizes.first()) == [1, 2, 3, 62]


def test_probes_are_copied_to_cells_a_bounded_number_at_a_time():
    rng = np.random.default_rng(1)
    pivots = rng.normal(size=(300, 8))
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]
    batch = pa.record_batch({
        "query_id": [str(i) for i in range(2000)], "vec": pa.array(list(rng.normal(size=(2000, 8)))),
        "threshold": pa.array([-1.0] * 2000)})
    parts = list(simjoin._routes(batch, pivots))
    assert sum(p.num_rows for p in parts) == 2000 * 300
    assert max(p.num_rows for p in parts) <= 1 << 16


def test_texts_are_searched_for_unfilled_questions_alone(spark, monkeypatch):
    memory = table(spark, [fact(f"f{i}", [1, i / 10], content="red fox") for i in range(5)]
                   + [fact("g", [-1, 0], content="red hen"), fact("h", None, content="a red one")])
    project = memory.first().project_id
    asked = spark.createDataFrame(
        [(1, project, "red", [1.0, 0.0], 4, 0.2), (2, project, "red", [1.0, 0.0], 6, 0.2),
         (3, project, "red", [1.0, 0.0], 9, 0.2), (4, project, "red", None, 2, 0.2)], ASKED)
    searched, plain = [], search.text_only_hits
    monkeypatch.setattr(search, "text_only_hits", lambda m, q, *more: (
        searched.extend(r.query_id for r in q.collect()), plain(m, q, *more))[1])
    got = {}
    for r in search.hybrid_recall(memory, asked, "simple").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert sorted(searched) == [2, 3, 4]
    near = ["f0", "f1", "f2", "f3", "f4"]
    assert got == {1: near[:4], 2: near + ["g"], 3: near + ["g", "h"], 4: ["f0", "f1"]}
    searched.clear()
    assert search.hybrid_recall(memory, asked.filter("query_id = 1"), "simple").count() == 4 and not searched


def test_candidates_do_not_carry_the_words_of_their_facts(spark):
    facts = textindex.indexed_facts(table(spark, [fact(f"f{i}", content="red fox " + "w" * i) for i in range(9)]))
    project = facts.first().project_id
    asked = spark.createDataFrame([(1, project, [["red"], ["fox"]])], "query_id long, project_id string, sets array<array<string>>")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = textindex.search_facts(facts, None, asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept[0])
        spark.conf.set("spark.sql.adaptive.enabled", kept[1])
    # The facts' words are in one shuffle, by the facts' ids; none is dealt by question.
    by_question = [line for line in plain_lines(plan) if "Exchange hashpartitioning(query_id" in line]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 4 and len(by_question) == 2
    lines = plain_lines(plan)
    for line in by_question:
        depth, at = len(line) - len(line.lstrip(" :+-|")), lines.index(line)
        below = []
        for other in lines[at + 1:]:
            if len(other) - len(other.lstrip(" :+-|")) <= depth:
                break
            below.append(other)
        assert not any("terms#" in b for b in below)


def plain_lines(plan: str) -> list[str]:
    return plan.splitlines()


def test_a_probe_is_copied_once_per_cell_and_not_per_pivot(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(600, 12))
    vectors[300:320] = vectors[:20]
    rows = spark.createDataFrame(
        [(f"{i:03}", "p", [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, part string, vec array<double>")
    asked = rows.select(
        F.col("id").alias("query_id"), "part", "vec", F.lit(0.5).alias("threshold"), F.lit(4).alias("limit"))
    sides, plain = [], simjoin._with_blocks
    monkeypatch.setattr(simjoin, "_with_blocks", lambda *given: (sides.append(plain(*given)), sides[-1])[1])
    found = {}
    settings = {"broadcastRows": "0", "blockRows": "32", "pivots": "16"}
    for way in ("broadcast", "cells"):
        for name, value in settings.items() if way == "cells" else ():
            spark.conf.set(f"factlake.similarity.{name}", value)
        try:
            hits = simjoin.best_hits(rows, asked).select("query_id", "rank", "id", "similarity").collect()
            edges = simjoin.match_edges(rows, 0.99).collect()
        finally:
            for name in settings:
                spark.conf.unset(f"factlake.similarity.{name}")
        found[way] = sorted(map(tuple, hits)), {frozenset(e) for e in edges}
    assert found["cells"] == found["broadcast"] and len(found["cells"][1]) == 20
    # At home, further and for the edges: 16 pivots lie in 4 or 5 cells, each cut in two at most.
    assert len(sides) == 3
    for _, probes in sides:
        copies = probes.groupBy("query_id", "part").agg(F.count("*").alias("n"), F.countDistinct("cell").alias("cells"))
        assert copies.agg(F.max("cells")).first()[0] <= 5 and copies.filter("n > cells").isEmpty()


def test_facts_are_not_repeated_per_scope_of_many_questions(spark, small_blocks, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(120, 6))
    memory = table(spark, [fact(f"f{i:03}", vectors[i], repo=f"r{i % 3}", tags=["a", "b"][: i % 3]) for i in range(120)])
    project = memory.first().project_id
    asked = spark.createDataFrame(
        [(i, project, "", [float(x) for x in vectors[i]], [None, "r1"][i % 2], [None, ["a"], ["b"]][i % 3], 5, -1.0)
         for i in range(60)],
        "query_id long, project_id string, question string, embedding array<double>, repo string, tags array<string>, "
        "limit int, threshold double")
    rows, _ = search.scoped(memory, search.prepare_queries(asked), False)
    assert rows.count() == 120
    listed = {tuple(r) for r in search.recall_batch(memory, asked).select("query_id", "rank", "id").collect()}
    monkeypatch.setattr(search, "_MOST_SCOPES", 5)
    rows, _ = search.scoped(memory, search.prepare_queries(asked), False)
    assert rows.count() > 120
    assert listed == {tuple(r) for r in search.recall_batch(memory, asked).select("query_id", "rank", "id").collect()}
    similar = vectors @ vectors.T / np.outer(*[np.linalg.norm(vectors, axis=1)] * 2)
    for i in range(60):
        inside = [j for j in range(120) if (i % 2 == 0 or j % 3 == 1) and j % 3 >= i % 3]
        best = sorted(inside, key=lambda j: -similar[i, j])[:5]
        assert {(i, n + 1, f"f{j:03}") for n, j in enumerate(best)} == {r for r in listed if r[0] == i}


def test_texts_leave_their_batch_a_chunk_at_a_time():
    words = HashedWords(8)
    texts = pa.array([f"text{i % 50} " * 1500 for i in range(4000)])
    words.embed(texts.slice(0, 100).to_pylist())
    tracemalloc.start()
    try:
        vectors = embed.embedded(texts, words)
        assert tracemalloc.get_traced_memory()[1] < 8 << 20 < texts.nbytes // 4
    finally:
        tracemalloc.stop()
    wanted = words.embed(texts.slice(3990, 10).to_pylist()).astype("float32")
    assert len(vectors) == 4000 and np.array_equal(np.array(vectors.slice(3990).to_pylist(), dtype="float32"), wanted)
