"""Approximate search over cells of a clustered vector space, and its quality."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions.vectors import l2_normalize
from factlake.operators.search import (
    bounded,
    few_hits,
    prepare_queries,
    rank_per_query,
    scoped,
    with_facts,
)
from factlake.operators.simjoin import best_hits, with_cell, with_reachable_cells
from factlake.schema import RECALL_COLUMNS
from factlake.session import materialize

# Facts per cell that the centres are learned from.
_TRAINING_ROWS = 256


def train_cells(memory: DataFrame, n_cells: int = 64, seed: int = 42) -> np.ndarray:
    """Unit centres of ``n_cells`` clusters of the embeddings, by cosine distance.

    Learned from a bounded, fixed choice of facts: the centres only say where
    to look first, they decide no result.
    """
    chosen = (
        memory.filter(F.col("embedding").isNotNull())
        .orderBy(F.xxhash64("id")).limit(_TRAINING_ROWS * n_cells)
    )
    unit = chosen.select(l2_normalize(F.col("embedding")).alias("v")).filter("v IS NOT NULL")
    vectors = materialize(unit, "training").select(array_to_vector("v").alias("features"))
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(vectors)
    centres = np.array(model.clusterCenters())
    norms = np.linalg.norm(centres, axis=1)
    return centres[norms > 0] / norms[norms > 0, None]


def _in_cell(df: DataFrame) -> DataFrame:
    """Rows and probes meet only inside a cell of a part."""
    part = F.concat_ws("\u0001", F.col("part"), F.col("cell").cast("string"))
    return df.withColumn("part", part).drop("cell", "angle", "reach")


def ann_recall(
    memory: DataFrame,
    queries: DataFrame,
    n_cells: int = 64,
    n_probe: int = 8,
    centres: np.ndarray | None = None,
) -> DataFrame:
    """Batch recall that looks only into each query's ``n_probe`` nearest cells.

    Similarities are exact, so what is found is right; facts in other cells are
    missed.  Measure the loss with :func:`recall_at_k`.
    """
    queries, few = bounded(prepare_queries(queries))
    id_type = queries.schema["query_id"].dataType
    centres = train_cells(memory, n_cells) if centres is None else centres
    rows, probes = scoped(memory, queries, few is not None)
    hits = best_hits(
        _in_cell(with_cell(rows, centres)),
        _in_cell(with_reachable_cells(probes, centres, nearest=n_probe)),
    )
    ranked = rank_per_query(hits.select("query_id", "id", "similarity"), queries, few)
    return with_facts(memory, ranked, few_hits(few)).select(
        F.col("query_id").cast(id_type).alias("query_id"), "rank", *RECALL_COLUMNS
    )


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, over all queries."""
    found = approx.select("query_id", "id", F.lit(1).alias("found"))
    return (
        exact.select("query_id", "id").join(found, ["query_id", "id"], "left")
        .agg(
            F.count(F.lit(1)).alias("exact_hits"),
            F.count("found").alias("found_hits"),
            F.try_divide(F.count("found"), F.count(F.lit(1))).alias("recall_at_k"),
        )
    )
