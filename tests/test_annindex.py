"""The stored index: against plain numpy, against itself written anew, and its versions."""

import os

import numpy as np
import pytest
from pool import clustered, fact, table, unit
from pyspark.sql import functions as F

from factlake.operators import ann, annindex, search


def make(rng, size, copies=0.3):
    vectors = clustered(rng, size, copies=copies)
    return [
        fact(f"{i:04d}", None if i % 31 == 5 else vectors[i], project="big" if i % 4 else "small",
             archived=i % 17 == 3, tags=["a", "b"][: i % 3], repo=f"r{i % 2}")
        for i in range(size)
    ]


def ask(spark, rng, n=30, limit=500):
    vectors = clustered(rng, n, copies=0)
    rows = [(i, ["big", "small"][i % 2], f"q{i}", [float(x) for x in vectors[i]],
             "r1" if i % 4 == 1 else None, ["a"] if i % 6 == 2 else None, limit, -1.0, i % 3 == 0) for i in range(n)]
    return rows, spark.createDataFrame(
        rows, """query_id long, project_id string, question string, embedding array<float>, repo string,
        tags array<string>, limit int, threshold double, include_archived boolean""")


def given_centres(spark, rng, n_coarse=4, n_fine=3, dims=8):
    rows = [(c, f, [float(x) for x in rng.normal(size=dims)]) for c in range(n_coarse) for f in range(-1, n_fine)]
    return rows, spark.createDataFrame(rows, "coarse int, fine int, vec array<double>")


def keys(df):
    return sorted((r.query_id, r["rank"], r.id, r.similarity) for r in df.collect())


def plain_cells(vector, centres, n_coarse, n_probe):
    def near(level):
        level = sorted(level)
        s = np.round(unit([vector]) @ (np.array([c[2] for c in level]) /
                     np.linalg.norm([c[2] for c in level], axis=1, keepdims=True)).T, 9)[0]
        return sorted((-x, c[0], c[1]) for x, c in zip(s, level))

    top = [c for _, c, _ in near([c for c in centres if c[1] == -1])[:n_coarse]]
    return [(c, f) for _, c, f in near([c for c in centres if c[0] in top and c[1] >= 0])[:n_probe]]


@pytest.mark.parametrize("many", [False, True])
def test_search_by_given_centres(spark, tmp_path, monkeypatch, request, many):
    if many:
        request.getfixturevalue("small_blocks")
    monkeypatch.setattr(annindex, "_BLOCK_ROWS", 16)
    rng = np.random.default_rng(11)
    facts = make(rng, 200)
    memory = table(spark, facts)
    centres, frame = given_centres(spark, rng)
    root = str(tmp_path / "index")
    annindex.write_index(memory, root, centres=frame)
    rows, queries = ask(spark, rng)
    got = annindex.indexed_recall(memory, queries, root, n_coarse=2, n_probe=3)
    found = {(r.query_id, r.id) for r in got.collect()}
    home = {f[0]: plain_cells(f[3], centres, 1, 1)[0] for f in facts if f[3] is not None}
    want = set()
    for q in rows:
        cells = plain_cells(q[3], centres, 2, 3)
        want |= {(q[0], f[0]) for f in facts if f[0] in home and home[f[0]] in cells and f[1] == q[1]
                 and (q[8] or not f[11]) and (q[4] is None or f[7] == q[4])
                 and (q[5] is None or set(q[5]) <= set(f[8]))}
    assert found == want
    # What is found is ranked as the exact search ranks it.
    exact = {(r.query_id, r.id): r.similarity for r in search.recall_batch(memory, queries).collect()}
    assert all(exact[r.query_id, r.id] == r.similarity for r in got.collect())


def test_all_learnt_cells_give_the_exact_hits(spark, tmp_path):
    rng = np.random.default_rng(12)
    memory = table(spark, make(rng, 240)).cache()
    root = str(tmp_path / "index")
    annindex.write_index(memory, root, cell_rows=8)
    _, queries = ask(spark, rng, limit=7)
    stored = spark.read.parquet(f"{root}/centres")
    levels = {r.level: r["count"] for r in stored.groupBy((F.col("fine") < 0).alias("level")).count().collect()}
    assert levels[True] >= 4 and levels[False] > levels[True]
    exact = search.recall_batch(memory, queries)
    every = annindex.indexed_recall(memory, queries, root, n_coarse=100, n_probe=1000)
    assert keys(every) == keys(exact)
    some = annindex.indexed_recall(memory, queries, root, n_coarse=2, n_probe=6)
    assert ann.recall_at_k(some, exact).first().recall_at_k > 0.5


def test_updates_equal_an_index_written_anew(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(13)
    before, later = make(rng, 160), make(rng, 200)
    # Of the first 160 some move, some change their scope, some lose their vector, some go.
    state = {f[0]: f for f in before}
    changed = [later[i] for i in (*range(0, 40), *range(160, 200))]
    state.update({f[0]: f for f in changed})
    unlisted = [(f"{i:04d}",) for i in range(100, 120)]
    for (gone,) in unlisted:
        del state[gone]
    _, centres = given_centres(spark, rng)
    root, anew = str(tmp_path / "index"), str(tmp_path / "anew")
    annindex.write_index(table(spark, before), root, centres=centres)
    version = annindex.update_index(table(spark, changed), root, spark.createDataFrame(unlisted, "id string"))
    memory = table(spark, list(state.values()))
    annindex.write_index(memory, anew, centres=centres)
    columns = ["id", "project_id", "vec", "repo", "tags", "archived", "coarse", "fine"]

    def entries(path):
        return sorted(map(str, annindex.read_entries(spark, path).select(columns).collect()))

    assert version == 1 and entries(root) == entries(anew)
    # Only the given facts were written.
    folder = next(f for f in os.listdir(root) if f.startswith("v=1-"))
    assert spark.read.parquet(f"{root}/{folder}/rows").count() == sum(f[3] is not None for f in changed)
    _, queries = ask(spark, rng)
    search_in = lambda path: keys(annindex.indexed_recall(memory, queries, path, 2, 3))
    assert search_in(root) == search_in(anew)
    assert annindex.compact_index(spark, root) == 2
    assert entries(root) == entries(anew)
    # A fact that left may come back, and chains of changes end in a whole version.
    monkeypatch.setattr(annindex, "MOST_CHANGES", 1)
    back = [f for f in before if f[0] == "0100"]
    assert annindex.update_index(table(spark, back), root) == 4
    assert len(annindex._chain(spark, root)) == 1
    assert sum(r.id == "0100" for r in annindex.read_entries(spark, root).collect()) == 1


def test_a_search_reads_the_cells_it_reaches(spark, tmp_path):
    rng = np.random.default_rng(14)
    memory = table(spark, make(rng, 200, copies=0))
    root = str(tmp_path / "index")
    annindex.write_index(memory, root, centres=given_centres(spark, rng)[1])
    kept = annindex.read_entries(spark, root, [1])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "coarse" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.coarse for r in kept.select("coarse").distinct().collect()} == {1}


def test_no_vectors_and_no_queries(spark, tmp_path):
    rng = np.random.default_rng(15)
    _, queries = ask(spark, rng, 4)
    for name, facts in (("none", []), ("null", [fact("a"), fact("b", [0] * 8)])):
        root, memory = str(tmp_path / name), table(spark, facts)
        annindex.write_index(memory, root)
        assert annindex.indexed_recall(memory, queries, root).count() == 0
        with pytest.raises(ValueError):
            annindex.update_index(memory, root)
    root, memory = str(tmp_path / "one"), table(spark, [fact("a", [1] * 8, project="big"), fact("b")])
    annindex.write_index(memory, root)
    assert annindex.indexed_recall(memory, queries.filter("false"), root).count() == 0
    zero = queries.withColumn("embedding", F.array_repeat(F.lit(0.0).cast("float"), 8))
    assert annindex.indexed_recall(memory, zero, root).count() == 0
    assert annindex.indexed_recall(memory, queries.filter("project_id = 'big'"), root).select("id").distinct().count() == 1
