"""Exact similarity join: for every probe its best hits among the rows.

Two plans give the same rows:

* **broadcast** - the probes are few (their number is checked), so they go to
  every executor once; the rows are scanned in place and never shuffled, and
  only each task's best hits leave it.
* **cells** - both sides are large.  Rows of a big part are assigned to the
  nearest of a bounded set of pivots; a probe meets only the rows of pivots that
  can hold a hit by the triangle inequality of angles.  Pivots lie in cells of
  what a task may hold, and a probe travels once to each cell with the list of
  the pivots it asks there, so it is copied per cell and not per pivot; larger
  cells are split, so no task ever holds more than one bounded block of each
  side, however skewed the parts are.

Neither plan lists the pairs of a group: a block is multiplied as two matrices
and only the best hits per probe come out.

Rows carry ``id, part, vec`` and optionally ``label, ord, until, scopes``;
probes carry ``query_id, part, vec, threshold, limit`` and optionally ``floor,
before, after, scope``.  Only rows and probes of the same ``part`` meet, rows
whose ``ord`` lies between ``after`` and ``before`` and which last ``until``
the latter at least.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.operators.kernel import (
    EDGE_SCHEMA,
    HIT_SCHEMA,
    BestHits,
    Probes,
    spanning_edges,
    unit_matrix,
)
from factlake.session import materialize, spread

# Angles are widened by this much when cells are ruled out.
_SLACK = 1e-5
_ALL = -1
# Keys of a block, and a bound on the tasks that share them.
_BLOCK = ("part", "cell", "sub", "qsub")
_MOST_TASKS = 20_000
# A side of a cell is cut into this many splits at first; each copies the other side once.
# Only beyond splits of _SPLIT_ROWS or, in cells of many pivots, of _CELL_ROWS, what a
# task may hold, there are more of them.
_SPLITS = 2
_SPLIT_ROWS = 16_384
_CELL_ROWS = 65_536
# A part has this many cells at first.
_CELLS = 4
# Angles of probes or rows to pivots, and so copies of probes, that a task holds at once.
_ANGLES_PER_STEP = 1 << 16
# Hits that the probes of a block may keep at once.
_HITS_AT_ONCE = 1 << 17
# What may be broadcast: probes, or the pivots of all parts.
MOST_BYTES = 64 << 20


@dataclass(frozen=True)
class Limits:
    """Sizes that decide the plan; override through session settings."""

    broadcast_rows: int = 16_384
    block_rows: int = 16_384
    # Most pivots of a part; None lets them grow with the square root of its rows.
    pivots: int | None = None

    @classmethod
    def of(cls, spark: SparkSession) -> "Limits":
        def setting(name: str, default: int | None) -> int | None:
            given = spark.conf.get(f"factlake.similarity.{name}", None)
            return default if given is None else int(given)

        return cls(
            setting("broadcastRows", cls.broadcast_rows),
            setting("blockRows", cls.block_rows),
            setting("pivots", cls.pivots),
        )


def small_table(df: DataFrame, most: int) -> pa.Table | None:
    """The rows as an Arrow table if they are at most ``most`` and MOST_BYTES, else None."""
    table = df.limit(most + 1).toArrow()
    return table if table.num_rows <= most and table.nbytes <= MOST_BYTES else None


def best_hits(
    rows: DataFrame,
    probes: DataFrame,
    by_order: bool = False,
    exclude_self: bool = False,
    table: pa.Table | None = None,
) -> DataFrame:
    """``query_id, id, label, similarity, ord, rank``: the best ``limit`` hits of
    every probe, per label if rows have one, by similarity (or by ``ord``).

    ``table`` is the probes where the caller has them in hand already.
    """
    limits = Limits.of(rows.sparkSession)
    if table is None:
        table = small_table(probes, limits.broadcast_rows)
    if table is not None:
        hits = _broadcast_hits(rows, table, by_order, exclude_self)
    else:
        hits = _cell_hits(rows, probes, limits, by_order, exclude_self)
    return _merge(hits, probes, table, by_order)


def _merge(hits: DataFrame, probes: DataFrame, table: pa.Table | None, by_order: bool) -> DataFrame:
    """The tasks' best hits -> the best hits overall."""
    order = [F.col("ord"), F.col("id")] if by_order else [F.desc("similarity"), F.col("id")]
    ranked = hits.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id", "label").orderBy(*order))
    )
    if table is not None:
        limits = set(table.column("limit").to_pylist()) if table.num_rows else {0}
        if len(limits) == 1:
            return ranked.filter(F.col("rank") <= F.lit(limits.pop()))
        ranked = ranked.filter(F.col("rank") <= F.lit(max(limits)))
    per_probe = probes.select("query_id", F.col("limit").alias("_limit")).distinct()
    return (
        ranked.join(per_probe, "query_id")
        .filter(F.col("rank") <= F.col("_limit"))
        .drop("_limit")
    )


# --- few probes -----------------------------------------------------------------

def _broadcast_hits(rows, table, by_order, exclude_self) -> DataFrame:
    if table.num_rows == 0:
        return rows.sparkSession.createDataFrame([], HIT_SCHEMA)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def scan(batches):
        found = BestHits(Probes.of(shared.value), by_order, exclude_self)
        for batch in batches:
            found.add(pa.table(batch.columns, schema=batch.schema))
        yield from found.result().to_batches()

    return spread(rows).mapInArrow(scan, HIT_SCHEMA)


def _broadcast_edges(rows, table) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def scan(batches):
        probes = Probes.of(shared.value)
        for batch in batches:
            edges = spanning_edges(pa.table(batch.columns, schema=batch.schema), probes)
            yield from edges.to_batches()

    return spread(rows).mapInArrow(scan, EDGE_SCHEMA)


# --- many probes: cells ------------------------------------------------------------

def choose_pivots(rows: DataFrame, count: int, apart: float = 0.0) -> np.ndarray:
    """Unit vectors of the ``count`` rows with the smallest hashes.

    A fixed choice, spread over the data in proportion to its density; a
    bounded top-k, not a full sort.  Of pivots within the angle ``apart`` of
    each other only one is kept.
    """
    picked = (
        rows.select("vec", F.xxhash64("id").alias("_h"))
        .orderBy("_h")
        .limit(count)
        .select("vec")
        .toArrow()
    )
    vectors, usable = unit_matrix(picked.column("vec"))
    pivots = np.unique(np.round(vectors[usable], 12), axis=0)
    # They go to every task, so their size is bounded, not only their number.
    pivots = pivots[:max(1, MOST_BYTES // (8 * max(1, pivots.shape[1])))]
    kept: list[int] = []
    for at in range(len(pivots) if apart > 0 else 0):
        if not kept or _angles(pivots[at:at + 1], pivots[kept]).min() > apart:
            kept.append(at)
    return pivots[kept] if apart > 0 else pivots


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _wider(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` and further columns."""
    schema = T.StructType(list(df.schema.fields))
    kinds = {"int": T.IntegerType(), "double": T.DoubleType()}
    for name, kind in columns.items():
        schema = schema.add(name, kinds[kind])
    return schema


def with_cell(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``df`` with its nearest pivot and the angle to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            for part in _slices(batch, shared.value):
                vectors, _ = unit_matrix(part.column("vec"))
                angles = _angles(vectors, shared.value)
                nearest = angles.argmin(axis=1)
                cell = pa.array(nearest.astype(np.int32))
                angle = pa.array(angles[np.arange(len(vectors)), nearest])
                yield pa.record_batch(
                    [*part.columns, cell, angle], names=[*part.schema.names, "cell", "angle"]
                )

    return df.mapInArrow(assign, _wider(df, cell="int", angle="double"))


def _slices(batch: pa.RecordBatch, pivots: np.ndarray):
    """The batch in slices whose angles to all pivots are at most _ANGLES_PER_STEP."""
    step = max(1, _ANGLES_PER_STEP // max(1, len(pivots)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _reach(batch: pa.RecordBatch) -> np.ndarray:
    """The angle within which the hits of each probe of a batch lie."""
    at_least = batch.column("threshold").to_numpy(zero_copy_only=False).astype(float)
    if "floor" in batch.schema.names:
        at_least = np.maximum(at_least, batch.column("floor").to_numpy(zero_copy_only=False).astype(float))
    return np.arccos(np.clip(at_least - 1e-8, -1.0, 1.0)) + _SLACK


def _routes(batch: pa.RecordBatch, pivots: np.ndarray, nearest: int | None = None):
    """The copies of a batch of probes at the cells they visit, a bounded number at a time."""
    for part in _slices(batch, pivots):
        vectors, usable = unit_matrix(part.column("vec"))
        angles = _angles(vectors, pivots)
        reach = _reach(part)
        if nearest is None:
            chosen = angles <= angles.min(axis=1, keepdims=True) + 2 * reach[:, None]
        else:
            order = angles.argsort(axis=1, kind="stable")[:, :nearest]
            chosen = np.zeros_like(angles, dtype=bool)
            np.put_along_axis(chosen, order, True, axis=1)
        chosen &= usable[:, None]
        row, cell = np.nonzero(chosen)
        taken = pa.table(part.columns, schema=part.schema).take(pa.array(row))
        taken = taken.append_column("cell", pa.array(cell.astype(np.int32)))
        taken = taken.append_column("angle", pa.array(angles[row, cell]))
        taken = taken.append_column("reach", pa.array(reach[row]))
        yield from taken.to_batches()


def with_reachable_cells(
    probes: DataFrame, pivots: np.ndarray, nearest: int | None = None
) -> DataFrame:
    """One row per probe and cell that may hold a hit: ``cell, angle, reach``.

    A row within angle ``reach`` of the probe and nearest to pivot c satisfies
    angle(probe, c) <= angle(probe, nearest pivot) + 2 reach, so other cells
    are skipped.  ``nearest`` keeps the n nearest cells instead (approximate).
    """
    shared = probes.sparkSession.sparkContext.broadcast(pivots)

    def route(batches):
        for batch in batches:
            yield from _routes(batch, shared.value, nearest)

    return probes.mapInArrow(route, _wider(probes, cell="int", angle="double", reach="double"))


def _large_parts(rows: DataFrame, block_rows: int) -> DataFrame:
    """Parts with more rows than one block: at most (all rows / block size) of them."""
    return materialize(
        rows.groupBy("part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > block_rows)
        .select("part", "_n", F.lit(True).alias("_large")),
        "large-parts",
    )


def _pivot_count(large: DataFrame, limits: Limits) -> int:
    """Cells of about half a block in the largest part, within a bound.

    More cells rule out more rows, but a probe is copied to every cell it must
    visit, so cells much smaller than a block only cost copies.  Unless set, the
    bound is the square root of the rows: then finding a row's pivot costs no
    more than comparing it with the rows of its cell.
    """
    most = large.agg(F.max("_n")).first()[0] or 0
    bound = limits.pivots or max(256, math.isqrt(most))
    return int(min(bound, max(1, -(-2 * most // limits.block_rows))))


def _extent(placed: DataFrame, limits: Limits) -> DataFrame:
    """Range of angles per pivot of a part, and the cell that it lies in with its splits.

    Cells hold pivots until they reach what a task may hold: every cell takes a copy
    of the probes that visit any of its pivots.
    """
    pivots = placed.groupBy("part", "pivot").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("angle").alias("_inner"),
        F.max("angle").alias("_outer"),
    )
    part = Window.partitionBy("part")
    up_to = part.orderBy("pivot").rowsBetween(Window.unboundedPreceding, 0)
    size = F.greatest(
        F.lit(limits.block_rows),
        F.least(F.lit(_CELL_ROWS), F.ceil(F.sum("_rows").over(part) / F.lit(_CELLS))),
    )
    middle = F.sum("_rows").over(up_to) - F.col("_rows") / 2
    inside = F.sum("_rows").over(Window.partitionBy("part", "cell"))
    most = max(_CELL_ROWS, limits.block_rows)
    return materialize(
        pivots.withColumn("cell", F.floor(middle / size).cast("int"))
        .withColumn("_nsub", F.greatest(F.lit(1), F.round(inside / F.lit(most))).cast("int"))
        .drop("_rows"),
        "cell-extents",
    )


def _blocks(count, block_rows: int, most: int = _SPLIT_ROWS):
    """Splits of a side of a cell.

    Every split carries a copy of the cell's other side, so small blocks would copy
    as much as the product of both sides; instead blocks grow to what a task may hold.
    """
    held = F.least(F.lit(most), F.ceil(count / F.lit(_SPLITS)))
    return F.ceil(count / F.greatest(F.lit(block_rows), held)).cast("int")


def _placed(rows, large: DataFrame, pivots: np.ndarray, limits: Limits):
    """The rows with their pivots, and the pivots' extents and cells."""
    large = large.select("part", "_large")
    placed = with_cell(rows, pivots).join(large, "part", "left")
    placed = placed.withColumn("pivot", F.when(F.col("_large"), F.col("cell")).otherwise(_ALL))
    placed = materialize(placed.drop("_large", "cell"), "cell-rows")
    return placed, _extent(placed, limits)


def with_angles(probes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``_angles`` of every probe to all pivots, its nearest pivot ``_home`` and its ``_reach``.

    A probe without a length has no hits and is left out.
    """
    shared = probes.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches):
        for batch in batches:
            for part in _slices(batch, shared.value):
                vectors, usable = unit_matrix(part.column("vec"))
                part, vectors = part.filter(pa.array(usable)), vectors[usable]
                angles = _angles(vectors, shared.value)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(angles) + 1, dtype=np.int32) * len(shared.value)), pa.array(angles.ravel()))
                home = pa.array(angles.argmin(axis=1).astype(np.int32)) if len(angles) else pa.array([], pa.int32())
                yield pa.record_batch(
                    [*part.columns, lists, home, pa.array(_reach(part))],
                    names=[*part.schema.names, "_angles", "_home", "_reach"],
                )

    schema = _wider(probes).add("_angles", T.ArrayType(T.DoubleType())).add("_home", T.IntegerType())
    return probes.mapInArrow(measure, schema.add("_reach", T.DoubleType()))


def _visits(probes: DataFrame, pivots: np.ndarray, extent: DataFrame, wanted) -> DataFrame:
    """The probes with the pivots that they ask, ``_spots``, one row per probe.

    A row within angle r of the probe and nearest to pivot c satisfies
    angle(probe, c) <= angle(probe, nearest pivot) + 2 r, and lies in the ring
    of angles of c's rows.  ``wanted`` restricts the pivots of large parts.
    """
    spots = materialize(
        extent.groupBy("part").agg(
            F.collect_list(F.struct("pivot", "cell", "_nsub", "_inner", "_outer")).alias("_spots")
        ), "cell-spots",
    )
    nearest = F.get("_angles", F.col("_home"))

    def visited(spot):
        angle, reach = F.get("_angles", spot["pivot"]), F.col("_reach")
        return (spot["pivot"] == _ALL) | (
            wanted(spot)
            & (angle <= nearest + 2 * reach)
            & (angle - reach <= spot["_outer"])
            & (angle + reach >= spot["_inner"])
        )

    asked = F.transform(F.filter("_spots", visited), lambda s: F.struct(s["pivot"], s["cell"], s["_nsub"]))
    routed = with_angles(probes, pivots).join(spots, "part").withColumn("_spots", asked)
    return materialize(
        routed.filter(F.size("_spots") > 0).drop("_angles", "_home", "_reach"), "cell-probes"
    )


def _meetings(placed: DataFrame, routed: DataFrame, extent: DataFrame, limits: Limits):
    """Both sides by blocks, ready to meet: probes once per cell with its pivots."""
    cells = F.array_distinct(F.transform("_spots", lambda s: F.struct(s["cell"], s["_nsub"])))
    there = F.filter("_spots", lambda s: s["cell"] == F.col("cell"))
    probes = (
        routed.withColumn("_cell", F.explode(cells))
        .withColumns({"cell": F.col("_cell.cell"), "_nsub": F.col("_cell._nsub")})
        .withColumn("pivots", F.transform(there, lambda s: s["pivot"]))
        .drop("_cell", "_spots")
    )
    rows = placed.join(extent.select("part", "pivot", "cell"), ["part", "pivot"])
    left, right = _with_blocks(rows, probes, limits)
    return left.groupBy(*_BLOCK).cogroup(right.groupBy(*_BLOCK))


def _with_blocks(placed: DataFrame, routed: DataFrame, limits: Limits):
    splits = materialize(
        routed.groupBy("part", "cell").agg(
            F.first("_nsub").alias("_nsub"),
            _blocks(F.count(F.lit(1)), limits.block_rows, _CELL_ROWS).alias("_nq"),
        ),
        "cell-splits",
    )
    left = (
        placed.join(splits, ["part", "cell"])
        .withColumn("sub", F.pmod(F.xxhash64("id"), F.col("_nsub")).cast("int"))
        .withColumn("qsub", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
        .drop("_nsub", "_nq", "angle")
    )
    right = (
        routed.drop("_nsub").join(splits, ["part", "cell"])
        .withColumn("qsub", F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int"))
        .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("_nsub") - 1)))
        .drop("_nsub", "_nq")
    )
    # A stated number of partitions: adaptive execution would merge them by
    # their few bytes, but a block's work is the product of its two sides.
    blocks = splits.agg(F.sum(F.col("_nsub").cast("long") * F.col("_nq"))).first()[0] or 1
    tasks = int(min(_MOST_TASKS, max(1, blocks + 3 * min(blocks, 256))))
    return left.repartition(tasks, *_BLOCK), right.repartition(tasks, *_BLOCK)


def _block_hits(row_table: pa.Table, probe_table: pa.Table, by_order: bool, exclude_self: bool) -> pa.Table:
    """The best hits of a block, of as many of its probes at a time as keep _HITS_AT_ONCE."""
    portion = np.cumsum(probe_table.column("limit").to_numpy().astype(np.int64)) // _HITS_AT_ONCE
    starts = np.flatnonzero(np.diff(portion, prepend=-1)) if len(portion) else np.zeros(1, dtype=int)
    found = []
    for start, end in zip(starts, [*starts[1:], probe_table.num_rows], strict=True):
        hits = BestHits(Probes.of(probe_table.slice(start, end - start)), by_order, exclude_self)
        if row_table.num_rows and end > start:
            hits.add(row_table)
        found.append(hits.result())
    return pa.concat_tables(found)


def _cell_hits(rows, probes, limits, by_order, exclude_self) -> DataFrame:
    """Visit each probe's own cell first, then the others it can still gain from.

    A probe that found all its hits at home only looks further as far as its
    worst hit, which in dense regions is much less than its threshold allows.
    """
    # Counted, searched for pivots and placed; derived once.
    rows = materialize(rows, "similarity-rows")
    large = _large_parts(rows, limits.block_rows)
    pivots = choose_pivots(rows, _pivot_count(large, limits))
    if not len(pivots):
        return rows.sparkSession.createDataFrame([], HIT_SCHEMA)
    placed, extent = _placed(rows, large, pivots, limits)

    def block(row_table, probe_table):
        return _block_hits(row_table, probe_table, by_order, exclude_self)

    def visit(asking: DataFrame, wanted) -> DataFrame:
        routed = _visits(asking, pivots, extent, wanted)
        return _meetings(placed, routed, extent, limits).applyInArrow(block, HIT_SCHEMA)

    if by_order or "label" in rows.columns:
        return visit(probes, lambda spot: F.lit(True))
    at_home = materialize(visit(probes, lambda spot: spot["pivot"] == F.col("_home")), "home-hits")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    worst = (
        at_home.withColumn("_n", F.row_number().over(best))
        .join(probes.select("query_id", F.col("limit").alias("_limit")).distinct(), "query_id")
        .filter(F.col("_n") == F.col("_limit"))
        .select("query_id", F.col("similarity").alias("_worst"))
    )
    floor = F.greatest("floor", "_worst") if "floor" in probes.columns else F.col("_worst")
    # Small parts are settled at home.
    divided = probes.join(large.select("part"), "part", "left_semi")
    eager = divided.join(worst, "query_id", "left").withColumn(
        "floor", F.coalesce(floor, F.lit(-2.0))
    )
    return at_home.unionByName(visit(eager.drop("_worst"), lambda spot: spot["pivot"] != F.col("_home")))


def match_edges(rows: DataFrame, threshold: float) -> DataFrame:
    """``src, dst``: edges that connect whatever rows match above ``threshold``.

    The connected components of these edges are those of the full match graph,
    but their number stays linear in the rows of every block.  Rows so close to
    their pivot that any two of them match are tied to one leader without being
    compared at all, so a mass of near copies costs one edge each.
    """
    spark = rows.sparkSession
    limits = Limits.of(spark)
    probes = rows.select(
        F.col("id").alias("query_id"), "part", "vec",
        F.lit(float(threshold)).alias("threshold"), F.lit(1).alias("limit"),
    )
    table = small_table(probes, limits.broadcast_rows)
    if table is not None:
        if table.num_rows == 0:
            return spark.createDataFrame([], EDGE_SCHEMA)
        return _broadcast_edges(rows, table)

    core_angle = float(np.arccos(min(1.0, threshold)) - _SLACK) / 2
    count = _pivot_count(_large_parts(rows, limits.block_rows), limits)
    pivots = choose_pivots(rows, max(count, min(16, limits.pivots or 16)), max(core_angle, 0.0) / 2)
    half = F.lit(core_angle)
    homed = with_cell(rows.select("id", "part", "vec"), pivots).withColumnRenamed("cell", "pivot")
    homed = materialize(homed.withColumn("core", F.col("angle") < half), "cell-rows")
    leaders = homed.filter("core").groupBy("part", "pivot").agg(F.min("id").alias("leader"))
    core_edges = (
        homed.filter("core").join(leaders, ["part", "pivot"])
        .filter(F.col("id") != F.col("leader"))
        .select(F.col("id").alias("src"), F.col("leader").alias("dst"))
    )

    # The two sides of a pivot are parts of their own.  A probe visits pivots not
    # before its own, and the core of its own pivot only from outside the core.
    def side(core):
        return F.concat_ws("\u0001", F.col("part"), core.cast("string"))

    sided = homed.select("id", side(F.col("core")).alias("part"), "pivot", "angle", "vec")
    extent = _extent(sided, limits)
    asking = homed.select(
        F.col("id").alias("query_id"), "part", "vec", F.col("core").alias("home_core"),
        F.lit(float(threshold)).alias("threshold"), F.lit(1).alias("limit"),
        F.explode(F.array(F.lit(True), F.lit(False))).alias("core"),
    ).withColumn("part", side(F.col("core"))).drop("core")
    routed = _visits(
        asking, pivots, extent,
        lambda spot: (spot["pivot"] > F.col("_home")) | ((spot["pivot"] == F.col("_home")) & ~F.col("home_core")),
    ).drop("home_core")

    def block(row_table, probe_table):
        return spanning_edges(row_table, Probes.of(probe_table))

    edges = _meetings(sided, routed, extent, limits).applyInArrow(block, EDGE_SCHEMA)
    return core_edges.unionByName(edges)
