"""Near-duplicates across a whole table: who repeats whom, and in what clusters."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.operators import filters
from factlake.operators.simjoin import best_hits, match_edges
from factlake.schema import DEDUP_LIMIT, DEDUP_THRESHOLD
from factlake.session import materialize


def distinct_vectors(memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct vector of a project, each fact with its vector's name).

    Copies are folded before any comparison, so a mass of equal facts costs
    one vector.  A vector is named by its fingerprint, which every fact can
    compute alone: no join is needed to tell a fact its vector.  Both tables
    are written, so later joins know their sizes and split hot vectors.
    """
    # A vector without a length matches nothing, so it is left out.
    has_length = F.exists("embedding", lambda x: x != 0)
    rows = filters.active(memory).filter(F.col("embedding").isNotNull() & has_length).select(
        "id", F.col("project_id").alias("part"), "created_by",
        F.col("embedding").alias("vec"),
    )
    name = F.sha2(F.concat_ws("\u0001", F.col("part"), F.to_json("vec")), 256)
    rows = rows.withColumn("vector", name)
    reps = rows.groupBy("part", "vector").agg(
        F.min("id").alias("id"), F.min_by("vec", "id").alias("vec")
    )
    return materialize(reps, "vectors"), materialize(rows.drop("vec"), "members")


def near_duplicates(
    memory: DataFrame, threshold: float = DEDUP_THRESHOLD, k: int = DEDUP_LIMIT
) -> DataFrame:
    """The duplicate check asked for every active fact: its nearest other facts
    of the project, at most ``k``: ``id, rank, match_id, similarity``.

    Distinct vectors are compared and keep their ``k + 1`` nearest vectors;
    the first ``k + 1`` facts of each of those hold the answer.
    """
    reps, members = distinct_vectors(memory)
    probes = reps.select(
        F.col("id").alias("query_id"), "part", "vec",
        F.lit(float(threshold)).alias("threshold"), F.lit(k + 1).alias("limit"),
    )
    near = best_hits(reps, probes).select(
        F.col("query_id").alias("rep"), F.col("id").alias("near"), "similarity"
    )
    names = reps.select(F.col("id").alias("near"), F.col("vector").alias("near_vector"))
    numbered = members.withColumn(
        "n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    ).filter(F.col("n") <= k + 1)
    facts = numbered.select(F.col("vector").alias("near_vector"), F.col("id").alias("match_id"))
    order = Window.partitionBy("rep").orderBy(F.desc("similarity"), F.asc("match_id"))
    answers = (
        near.join(names, "near").join(facts, "near_vector")
        .withColumn("pos", F.row_number().over(order))
        .filter(F.col("pos") <= k + 1)
        .select("rep", "match_id", "similarity", "pos")
    )
    # A fact is not its own duplicate; at most one of the k + 1 answers drops out.
    listed = answers.groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("pos", "match_id", "similarity"))).alias("answers")
    ).join(reps.select(F.col("id").alias("rep"), "vector"), "rep")
    listed = materialize(listed.select("vector", "answers"), "answers")
    others = F.filter("answers", lambda a: a["match_id"] != F.col("id"))
    return (
        members.select("id", "vector").join(listed, "vector")
        .select("id", F.posexplode(F.slice(others, 1, k)).alias("n", "answer"))
        .select("id", (F.col("n") + 1).alias("rank"), "answer.match_id", "answer.similarity")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node id reachable over ``src - dst``.

    Labels spread over edges and jump to their label's label, so long chains
    close in few rounds; each round is written out, which cuts the lineage.
    """
    both = materialize(
        edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "edges"
    )
    labels = materialize(
        both.groupBy(F.col("src").alias("node"))
        .agg(F.least(F.min("dst"), F.first("src")).alias("component")),
        "labels",
    )
    while True:
        heard = both.join(labels, F.col("dst") == F.col("node")).groupBy(
            F.col("src").alias("node")
        ).agg(F.min("component").alias("heard"))
        spread = labels.join(heard, "node", "left").select(
            "node", F.col("component").alias("old"),
            F.least("component", "heard").alias("component"),
        )
        spread = materialize(spread, "labels")
        onward = spread.select(
            F.col("node").alias("component"), F.col("component").alias("next")
        )
        jumped = materialize(
            spread.join(onward, "component", "left").select(
                "node", "old", F.least("component", F.coalesce("next", "component")).alias("component")
            ),
            "labels",
        )
        labels = jumped.select("node", "component")
        if not jumped.filter(F.col("old") != F.col("component")).limit(1).count():
            return labels


def duplicate_clusters(memory: DataFrame, threshold: float = DEDUP_THRESHOLD) -> DataFrame:
    """``id, project_id, cluster_id``: facts connected by near-duplication.

    The cluster is named after its smallest id.  Facts without a duplicate are
    left out.
    """
    reps, members = distinct_vectors(memory)
    components = connected_components(match_edges(reps, threshold))
    clusters = materialize(
        reps.join(components, F.col("id") == F.col("node"), "left").select(
            "vector", F.coalesce("component", "id").alias("cluster_id")
        ),
        "clusters",
    )
    named = members.join(clusters, "vector").select(
        "id", F.col("part").alias("project_id"), "cluster_id"
    )
    sizes = named.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return named.join(sizes, "cluster_id", "left_semi").select("id", "project_id", "cluster_id")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("project_id", "cluster_id").agg(F.count(F.lit(1)).alias("facts"))


def _author_matches(memory: DataFrame, threshold: float):
    """Per distinct vector and author the nearest fact by that author."""
    reps, members = distinct_vectors(memory)
    # One row per distinct vector and author, not per fact.
    authors = members.groupBy("vector", "created_by").agg(F.min("id").alias("first_id"))
    by_author = authors.join(reps.drop("id"), "vector").select(
        F.col("first_id").alias("id"), "part", "vec", F.col("created_by").alias("label")
    )
    probes = reps.select(
        F.col("vector").alias("query_id"), "part", "vec",
        F.lit(float(threshold)).alias("threshold"), F.lit(1).alias("limit"),
    )
    near = best_hits(by_author, probes).select(
        F.col("query_id").alias("vector"), F.col("label").alias("other_author"),
        F.col("id").alias("match_id"), "similarity",
    )
    return members, materialize(near, "author-matches")


def cross_agent_corroboration(memory: DataFrame, threshold: float = DEDUP_THRESHOLD) -> DataFrame:
    """Who confirmed whom: per fact and other author, that author's nearest fact."""
    members, near = _author_matches(memory, threshold)
    return (
        members.join(near, "vector")
        .filter(F.col("other_author") != F.col("created_by"))
        .select("id", F.col("part").alias("project_id"), "created_by",
                "other_author", "match_id", "similarity")
    )


def corroboration_score(memory: DataFrame, threshold: float = DEDUP_THRESHOLD) -> DataFrame:
    """``id, score``: how many other authors confirm each fact (0 if nobody).

    The authors around each distinct vector are counted once; a fact's own
    author is always among them.
    """
    members, near = _author_matches(memory, threshold)
    # One row per vector and author, so counting rows counts authors.
    counted = materialize(
        near.groupBy("vector").agg(F.count(F.lit(1)).alias("n")), "author-counts"
    )
    return members.join(counted, "vector", "left").select(
        "id", (F.coalesce("n", F.lit(1)) - 1).alias("score")
    )
