import numpy as np
import pytest
from pool import clustered, fact, similarities, table
from pyspark.sql import functions as F

from factlake.operators import ann, duplicates, search

AUTHORS = ["alice/coder", "bob/coder", "carol/coder"]


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(7)
    vectors = clustered(rng, 240)
    facts = [
        fact(f"{i:04d}", None if i % 31 == 5 else vectors[i], project="big" if i % 4 else "small",
             author=AUTHORS[i % 3], archived=i % 17 == 3, tags=["a", "b"][: i % 3], repo=f"r{i % 2}")
        for i in range(len(vectors))
    ]
    return facts, vectors, table(spark, facts).cache()


def brute_pairs(facts, threshold, strict=True):
    live = [f for f in facts if f[3] is not None and not f[11]]
    s = similarities([f[3] for f in live], [f[3] for f in live])
    return [
        (a[0], b[0], s[i, j], a, b)
        for i, a in enumerate(live) for j, b in enumerate(live)
        if i != j and a[1] == b[1] and s[i, j] > threshold
    ]


def queries_of(spark, rng, n=60):
    vectors = clustered(rng, n, copies=0)
    rows = [
        (i, ["big", "small"][i % 2], f"q{i}", [float(x) for x in vectors[i]],
         AUTHORS[0] if i % 5 == 0 else None, None, "r1" if i % 4 == 1 else None,
         ["a"] if i % 6 == 2 else None, 1 + i % 7, [0.3, 0.6, 0.9][i % 3], i % 3 == 0)
        for i in range(n)
    ]
    schema = """query_id long, project_id string, question string, embedding array<float>,
    agent string, engineer string, repo string, tags array<string>, limit int, threshold double,
    include_archived boolean"""
    return rows, spark.createDataFrame(rows, schema)


def check_recall(spark, pool):
    facts, _, memory = pool
    rows, queries = queries_of(spark, np.random.default_rng(3))
    got = {}
    for r in search.recall_batch(memory, queries).select("query_id", "rank", "id").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q in rows:
        found = [
            (-s, f[0]) for f in facts
            if f[3] is not None and f[1] == q[1] and (q[10] or not f[11])
            and (q[4] is None or f[4] == q[4]) and (q[6] is None or f[7] == q[6])
            and (q[7] is None or set(q[7]) <= set(f[8]))
            and (s := similarities([f[3]], [q[3]])[0, 0]) > q[9]
        ]
        expected = [f for _, f in sorted(found)[: q[8]]]
        assert [i for _, i in sorted(got.get(q[0], []))] == expected, q[0]


def test_recall_broadcast(spark, pool):
    check_recall(spark, pool)


def test_recall_cells(spark, pool, small_blocks):
    check_recall(spark, pool)


def test_batch_equals_single(spark, pool):
    _, _, memory = pool
    rows, queries = queries_of(spark, np.random.default_rng(4), 6)
    batch = search.recall_batch(memory, queries).select("query_id", "rank", "id", "similarity").collect()
    for q in rows:
        single = search.recall(memory, q[3], q[1], q[8], q[9], q[10], q[4], q[5], q[6], q[7])
        assert [(r.id, r.similarity) for r in single.collect()] == [
            (r.id, r.similarity) for r in sorted(batch, key=lambda r: r["rank"]) if r.query_id == q[0]]


def check_near_duplicates(pool):
    facts, _, memory = pool
    expected = {}
    for a, b, s, *_ in brute_pairs(facts, 0.95):
        expected.setdefault(a, []).append((-s, b))
    expected = {a: [b for _, b in sorted(m)[:3]] for a, m in expected.items()}
    got = {}
    for r in duplicates.near_duplicates(memory).collect():
        got.setdefault(r.id, []).append((r["rank"], r.match_id))
    assert {a: [b for _, b in sorted(m)] for a, m in got.items()} == expected


def check_clusters(pool):
    facts, _, memory = pool
    parent = {f[0]: f[0] for f in facts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = brute_pairs(facts, 0.95)
    for a, b, *_ in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    expected = {a: root(a) for a, *_ in pairs}
    got = {r.id: r.cluster_id for r in duplicates.duplicate_clusters(memory).collect()}
    assert got == expected


def check_corroboration(pool):
    facts, _, memory = pool
    best, scores = {}, {f[0]: set() for f in facts if f[3] is not None and not f[11]}
    for a, b, s, fa, fb in brute_pairs(facts, 0.95):
        if fa[4] != fb[4]:
            scores[a].add(fb[4])
            key = (a, fb[4])
            best[key] = min(best.get(key, (0, "~")), (-s, b))
    got = {(r.id, r.other_author): r.match_id
           for r in duplicates.cross_agent_corroboration(memory).collect()}
    assert got == {k: b for k, (_, b) in best.items()}
    got = {r.id: r.score for r in duplicates.corroboration_score(memory).collect()}
    assert got == {k: len(v) for k, v in scores.items()}


@pytest.mark.parametrize("check", [check_near_duplicates, check_clusters, check_corroboration])
def test_duplicates_broadcast(pool, check):
    check(pool)


@pytest.mark.parametrize("check", [check_near_duplicates, check_clusters, check_corroboration])
def test_duplicates_cells(pool, small_blocks, check):
    check(pool)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(
        F.format_string("%04d", "id").alias("src"), F.format_string("%04d", F.col("id") + 1).alias("dst"))
    found = duplicates.connected_components(edges)
    assert found.count() == 201 and found.select("component").distinct().count() == 1


def test_approximate_hits_are_exact_hits(spark, pool):
    _, _, memory = pool
    _, queries = queries_of(spark, np.random.default_rng(5), 20)
    queries = queries.withColumn("limit", F.lit(500))
    exact = search.recall_batch(memory, queries)
    some = ann.ann_recall(memory, queries, n_cells=6, n_probe=2)
    assert some.select("query_id", "id").exceptAll(exact.select("query_id", "id")).count() == 0
    row = ann.recall_at_k(some, exact).first()
    assert 0.2 < row.recall_at_k <= 1


def test_zero_and_missing_vectors_match_nothing(spark):
    memory = table(spark, [fact("a", [0, 0]), fact("b"), fact("c", [1, 0])])
    queries = spark.createDataFrame(
        [(1, "p", "x", [1.0, 0.0]), (2, "p", "y", [0.0, 0.0])],
        "query_id long, project_id string, question string, embedding array<float>")
    found = search.recall_batch(memory, queries.withColumn("threshold", F.lit(0.0)))
    assert [(r.query_id, r.id) for r in found.collect()] == [(1, "c")]


def test_hybrid_order_and_stop_words(spark):
    memory = table(spark, [
        fact("near", [1, 0.1], content="nothing here"),
        fact("text", [0, 1], content="Patrick owns billing"),
        fact("blind", None, content="ask Patrick, billing is theirs"),
        fact("far", [0, 1], content="other"),
    ])
    queries = spark.createDataFrame(
        [(1, "p", "patrick billing", [1.0, 0.0], 10), (2, "p", "the of", [1.0, 0.0], 10),
         (3, "p", "billing patrick", [1.0, 0.0], 2)],
        "query_id long, project_id string, question string, embedding array<float>, limit int")
    found = search.hybrid_recall(memory, queries, "english").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in found] == [
        (1, "near"), (1, "text"), (1, "blind"), (2, "near"), (3, "near"), (3, "text")]


def test_resolve_ids(spark):
    memory = table(spark, [fact("abcdef12"), fact("abcdef34"), fact("bb000000"), fact("bb")])
    keys = spark.createDataFrame([("abcdef",), ("abcdef3",), ("b",), ("bb",), ("zz",), ("",)], "key string")
    got = {}
    for r in search.resolve_ids(memory, keys).collect():
        got.setdefault((r.key, r.status), []).append(r.id)
    assert {k: sorted(v, key=str) for k, v in got.items()} == {
        ("abcdef", "ambiguous"): ["abcdef12", "abcdef34"], ("abcdef3", "unique"): ["abcdef34"],
        ("b", "ambiguous"): ["bb", "bb000000"], ("bb", "exact"): ["bb"], ("zz", "missing"): [None],
        ("", "missing"): [None]}
