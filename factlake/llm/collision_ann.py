"""Nearest neighbours by collision counting on query-centred windows.

Vectors are dealt over shards by hash. In a shard every vector is projected on
FUNCTIONS random directions and each direction keeps its sorted array. A query
looks at a window around its own projection in every array; the window grows
(virtual rehashing) without any array being built anew. A vector that falls into the windows of at least THRESHOLD of
the directions is verified by its true inner product. A query stops when a share
VERIFY of the shard, and never less than MORE times the neighbours asked for,
was verified. Every vector is indexed; equal vectors of a shard are folded into
one entry, so copies cost nothing. Vectors of different lengths are lifted by
one coordinate, so that the largest inner product is the nearest point.

The query set is stated by the caller; queries and shards meet in blocks, so
that the work is queries times vectors over blocks, as any search over all rows
without a global order is. Per block only the best answers of each query leave
the task.

Null or zero vectors, vectors with null or non-finite components, and vectors of
another dimension than the commonest take no part. Rows that repeat a vec_id
count once, with the vector that sorts first. Ties go to the smaller vec_id. A
table without queries or candidates gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.session import materialize

FUNCTIONS = 80
THRESHOLD = 0.65
VERIFY, MORE = 0.1, 25
SHARD_ROWS, QUERY_ROWS = 16384, 4096
# Half the first window's width as a share of the longest vector, and the growth per level.
FIRST_WIDTH, WIDER, LEVELS = 0.1, 1.15, 30


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors that take part, as doubles."""
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).filter(
        F.exists("embedding", lambda x: x != 0)
    )
    sizes = kept.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    return kept.filter(F.size("embedding") == size).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


class CollisionIndex:
    """Sorted projections of one shard."""

    def __init__(self, points: np.ndarray, functions: int, seed: int = 7):
        norms = np.sqrt((points * points).sum(axis=1))
        most = norms.max()
        lifted = np.sqrt(np.maximum(most * most - norms * norms, 0.0))
        self.most = most
        directions = np.random.default_rng(seed).standard_normal((points.shape[1] + 1, functions))
        self.down = directions[:-1]
        projected = points @ directions[:-1] + lifted[:, None] * directions[-1]
        order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=0).T.copy()
        self.n = len(points)
        # Each point's place in each sorted array: a window is a range of places.
        self.place = np.empty((functions, self.n), dtype=np.uint16)
        np.put_along_axis(self.place, order.T, np.arange(self.n, dtype=np.uint16)[None, :], axis=1)
        self._inside, self._hit = np.empty_like(self.place), np.empty(self.place.shape, dtype=bool)

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, ``(query, level, function)``, of every query's windows."""
        norms = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        # The length of a query changes no order; as long as the longest point it lies nearest to them.
        centre = (queries * (self.most / norms)) @ self.down
        widths = self.most * FIRST_WIDTH * WIDER ** np.arange(LEVELS)
        low = np.empty((len(queries), LEVELS, len(self.sorted)), dtype=np.uint16)
        high = np.empty_like(low)
        for j, line in enumerate(self.sorted):
            low[:, :, j] = np.searchsorted(line, centre[:, j, None] - widths)
            high[:, :, j] = np.searchsorted(line, centre[:, j, None] + widths, side="right")
        return low, high

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many functions each point's place lies in the window."""
        # Unsigned: places before the window wrap round and are not below its length.
        np.subtract(self.place, low[:, None], out=self._inside)
        np.less(self._inside, (high - low)[:, None], out=self._hit)
        return np.add.reduce(self._hit.view(np.uint8), axis=0, dtype=np.uint8)

    def candidates(self, low: np.ndarray, high: np.ndarray, first: int, threshold: int, enough: int):
        """Points that collide with a query in ``threshold`` functions, and the level that found them.

        The level is the first at which ``enough`` points collide, sought from ``first`` on.
        """
        if enough >= self.n:
            return np.arange(self.n), first
        level, best = first, None
        while True:
            found = np.flatnonzero(self.collisions(low[level], high[level]) >= threshold)
            if len(found) >= enough:
                best = found
                if level == 0 or len(found) <= 2 * enough:
                    return best, level
                level -= 1
            elif best is not None:
                return best, level + 1
            elif level + 1 == LEVELS:
                return np.arange(self.n), level
            else:
                level += 1


def _search(key, vectors, queries, functions, threshold, verify, k):
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(vectors) and len(queries):
        ids = vectors["vec_id"].to_numpy(dtype=np.int64)
        rows = np.array(vectors["embedding"].tolist(), dtype=np.float64)
        points, where = np.unique(rows, axis=0, return_inverse=True)
        where = where.reshape(-1)
        by_point = np.lexsort((ids, where))
        first = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(points)))])
        index = CollisionIndex(points, functions)
        need = max(int(verify * len(points)), MORE * k)
        asked = np.array(queries["embedding"].tolist(), dtype=np.float64)
        level, many = 0, int(np.ceil(threshold * functions))
        for i, (query_id, query) in enumerate(zip(queries["vec_id"], asked, strict=True)):
            if i % 256 == 0:
                low, high = index.windows(asked[i:i + 256])
            # Begins at the level where the query before ended.
            near, level = index.candidates(low[i % 256], high[i % 256], level, many, need)
            if len(near) > k + 1:  # the query itself may be among them
                about = points[near] @ query
                near = near[about >= -np.partition(-about, k)[k] - 1e-9 * np.abs(about).max()]
            # One order of summation for every row, so that equal vectors tie exactly.
            scores = (points[near] * query).sum(axis=1)
            # Of equal vectors the k + 1 smallest ids are enough.
            copies = [by_point[first[p]:min(first[p + 1], first[p] + k + 1)] for p in near]
            found = ids[np.concatenate(copies)] if copies else ids[:0]
            value = np.repeat(scores, [len(c) for c in copies])
            keep = found != query_id
            found, value = found[keep], value[keep]
            best = np.lexsort((found, -value))[:k]
            out["query_id"].append(np.full(len(best), query_id, np.int64))
            out["vec_id"].append(found[best])
            out["score"].append(value[best])
    return pd.DataFrame({
        name: np.concatenate(parts) if parts else np.zeros(0, np.float64 if name == "score" else np.int64)
        for name, parts in out.items()
    })


def nearest_neighbours(
    vectors: DataFrame, every: int = 20, k: int = 20, functions: int = FUNCTIONS,
    threshold: float = THRESHOLD, verify: float = VERIFY, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each vec_id divisible by ``every``."""
    kept = materialize(usable(vectors), "vectors")
    rows = kept.count()
    asked = kept.filter(F.col("vec_id") % every == 0)
    shards = max(1, -(-rows // shard_rows))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    points = kept.withColumn("shard", shard).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    queries = asked.withColumn("block", block).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    search = partial(_search, functions=functions, threshold=threshold, verify=verify, k=k)

    def searched(key, left, right):
        return search(key, left, right)

    found = points.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(
        searched, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
