"""A stored approximate index: cells in two levels, kept on disk by coarse cell.

Coarse centres are few (at most MOST_COARSE) and go to every task. Each coarse cell
has fine centres of its own, as many as its distinct vectors ask for, so the number
of cells grows with the facts while no task holds more than one coarse cell's fine
centres. Cells hold whatever falls into them; a cell that many copies fill is split
into blocks when it is written and when it is searched.

Layout of an index under its root::

    centres/                        coarse, fine (-1: the coarse centre), vec
    <folder of a version>/rows/     facts by coarse cell: id, scope, vec, fine
    <folder of a version>/gone/     ids whose entries of earlier versions are void
    published/                      the versions in force, in order

A search reads the coarse cells that its queries reach and no others. An update
assigns the given facts alone; what a version wrote is never changed. Jobs that die
half way publish nothing.

Facts without a vector, or with one of length zero, are in no cell. Vectors are
floats of one length, as in the fact table. Ids are unique among the facts given at once.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.operators.ann import train_cells
from factlake.operators.kernel import unit_matrix
from factlake.operators.search import (
    bounded,
    few_hits,
    prepare_queries,
    rank_per_query,
    scoped,
    with_facts,
)
from factlake.operators.simjoin import best_hits
from factlake.schema import RECALL_COLUMNS
from factlake.session import materialize, spread

# Distinct vectors that a fine cell should hold, and those its centre is learnt from.
CELL_ROWS = 4096
_TRAINING_ROWS = 64
_ROUNDS = 8
# Bounds on the centres that one task holds; cells grow beyond them.
MOST_COARSE = 4096
MOST_FINE = 1024
# Rows of a coarse cell that one task compares with its fine centres.
_BLOCK_ROWS = 16_384
# Versions of changes until the next one is written as a whole.
MOST_CHANGES = 16

_ENTRY = """id string, project_id string, vec array<float>, created_by string, engineer string,
repo string, tags array<string>, archived boolean, fine int, coarse int"""
_CENTRE = "coarse int, fine int, vec array<double>"
_POINTER = "version long, folder string, complete boolean"


# --- centres -------------------------------------------------------------------

def _similar(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rounded, so that equal centres tie and the first of them is taken everywhere."""
    return np.round(vectors @ centres.T, 9)


def _by_similarity(similar: np.ndarray, count: int) -> np.ndarray:
    """The columns of the ``count`` largest numbers of each row, first ones first among equals."""
    if count == 1:
        return similar.argmax(axis=1)[:, None]
    return np.argsort(-similar, axis=1, kind="stable")[:, :count]


def _as_lists(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1]
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * width), pa.array(matrix.reshape(-1)))


def _learn(vectors: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` unit centres of unit vectors, by rounds from a spread start."""
    vectors = np.unique(vectors, axis=0)
    centres = vectors[np.linspace(0, len(vectors) - 1, min(count, len(vectors))).astype(int)]
    for _ in range(_ROUNDS):
        home = _similar(vectors, centres).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _sizes(placed: DataFrame, cell_rows: int) -> DataFrame:
    """Per coarse cell the number of fine centres and the share of vectors to learn from.

    At most MOST_COARSE rows. Copies count once, so they call for no more centres.
    """
    distinct = F.approx_count_distinct(F.xxhash64("vec"), 0.02)
    sizes = placed.groupBy("coarse").agg(distinct.alias("vectors"))
    fine = F.least(F.ceil(F.col("vectors") / cell_rows), F.lit(MOST_FINE)).cast("int")
    return sizes.select(
        "coarse", fine.alias("fines"), (F.lit(_TRAINING_ROWS) * fine / F.col("vectors")).alias("share")
    )


def train_centres(memory: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``coarse, fine, vec``: the centres of both levels, learnt from bounded choices of vectors.

    A coarse cell learns from some _TRAINING_ROWS distinct vectors for each of its fine
    centres, chosen by hash. Centres say where to look first; they decide no similarity.
    """
    spark = memory.sparkSession
    facts = _vectors(memory)
    cells = -(-facts.count() // cell_rows)
    if not cells:
        return spark.createDataFrame([], _CENTRE)
    coarse = train_cells(memory, int(min(MOST_COARSE, max(2, np.ceil(np.sqrt(cells))))))
    placed = materialize(_with_coarse(facts.select("vec"), coarse, 1), "index-training")
    sizes = materialize(_sizes(placed, cell_rows), "index-sizes")
    drawn = F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    chosen = placed.join(F.broadcast(sizes), "coarse").filter(drawn).select("coarse", "fines", "vec").distinct()

    def learn(table):
        units, usable = unit_matrix(table.column("vec"))
        centres = _learn(units[usable], table.column("fines")[0].as_py())
        number = pa.array(np.arange(len(centres), dtype=np.int32))
        cell = pa.array(np.full(len(centres), table.column("coarse")[0].as_py(), dtype=np.int32))
        return pa.table([cell, number, _as_lists(centres)], names=["coarse", "fine", "vec"])

    fine = materialize(chosen.groupBy("coarse").applyInArrow(learn, _CENTRE), "index-fine")
    top = spark.createDataFrame(
        [(at, -1, [float(x) for x in centre]) for at, centre in enumerate(coarse)], _CENTRE)
    # Facts to come may fall where none lies yet.
    alone = top.join(fine.select("coarse").distinct(), "coarse", "left_anti").withColumn("fine", F.lit(0))
    return top.unionByName(fine).unionByName(alone)


def _coarse_centres(spark: SparkSession, root: str) -> np.ndarray:
    rows = spark.read.schema(_CENTRE).parquet(f"{root}/centres").filter("fine = -1").orderBy("coarse")
    found = rows.limit(MOST_COARSE + 1).toArrow()
    if found.num_rows > MOST_COARSE:
        raise ValueError(f"an index has at most {MOST_COARSE} coarse centres")
    if found.column("coarse").to_pylist() != list(range(found.num_rows)):
        raise ValueError("coarse centres must be numbered from 0 without gaps")
    units, usable = unit_matrix(found.column("vec"))
    if not usable.all():
        raise ValueError("a centre must have a length")
    return units


# --- assignment ----------------------------------------------------------------

def _vectors(memory: DataFrame) -> DataFrame:
    return memory.filter(
        F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)
    ).withColumnRenamed("embedding", "vec")


def _with_coarse(df: DataFrame, centres: np.ndarray, nearest: int) -> DataFrame:
    """``df`` once for each of the ``nearest`` coarse cells of its ``vec``."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            units, _ = unit_matrix(batch.column(batch.schema.get_field_index("vec")))
            cells = _by_similarity(_similar(units, shared.value), nearest)
            row = np.repeat(np.arange(len(units)), cells.shape[1])
            taken = pa.table(batch.columns, schema=batch.schema).take(pa.array(row))
            yield from taken.append_column("coarse", pa.array(cells.reshape(-1).astype(np.int32))).to_batches()

    return spread(df).mapInArrow(assign, T.StructType([*df.schema.fields, T.StructField("coarse", T.IntegerType())]))


def _with_fine(df: DataFrame, root: str, nearest: int, key: str) -> DataFrame:
    """``df`` once for each of the ``nearest`` fine cells of its coarse cell, with ``near``.

    A coarse cell's rows are split into blocks, each of which meets its fine centres.
    """
    spark = df.sparkSession
    df = materialize(df, "index-coarse")
    blocks = materialize(
        df.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / _BLOCK_ROWS).cast("int").alias("blocks")), "index-blocks")
    fine = spark.read.schema(_CENTRE).parquet(f"{root}/centres").filter("fine >= 0")
    rows = df.join(F.broadcast(blocks), "coarse").withColumn(
        "block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).select(*df.columns, "block")
    centres = fine.join(F.broadcast(blocks), "coarse").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    schema = T.StructType([*df.schema.fields, T.StructField("fine", T.IntegerType()),
                           T.StructField("near", T.DoubleType())])
    names = df.columns

    def assign(block, centres):
        if not block.num_rows:
            return pa.table(
                [*(pa.array([], block.schema.field(n).type) for n in names), pa.array([], pa.int32()),
                 pa.array([], pa.float64())], names=[*names, "fine", "near"])
        if not centres.num_rows:
            raise ValueError("a coarse cell without fine centres")
        order = np.argsort(centres.column("fine").to_numpy(), kind="stable")
        number = centres.column("fine").to_numpy()[order]
        similar = _similar(unit_matrix(block.column("vec"))[0], unit_matrix(centres.column("vec"))[0][order])
        cells = _by_similarity(similar, nearest)
        row = np.repeat(np.arange(block.num_rows), cells.shape[1])
        taken = block.select(names).take(pa.array(row))
        taken = taken.append_column("fine", pa.array(number[cells.reshape(-1)].astype(np.int32)))
        return taken.append_column("near", pa.array(similar[row, cells.reshape(-1)]))

    return rows.groupBy("coarse", "block").cogroup(centres.groupBy("coarse", "block")).applyInArrow(assign, schema)


# --- versions --------------------------------------------------------------------

def _chain(spark: SparkSession, root: str) -> list:
    """The last whole version and the changes since, at most MOST_CHANGES and a few."""
    pointers = spark.read.schema(_POINTER).json(f"{root}/published")
    start = pointers.filter("complete").agg(F.max("version")).first()[0]
    return pointers.filter(F.col("version") >= start).orderBy("version").collect()


def _publish(spark: SparkSession, root: str, version: int, folder: str, complete: bool) -> None:
    pointer = spark.createDataFrame([(version, folder, complete)], _POINTER)
    pointer.coalesce(1).write.mode("append").json(f"{root}/published")


def _write_rows(entries: DataFrame, root: str, folder: str) -> None:
    names = T._parse_datatype_string(_ENTRY).fieldNames()
    entries.select(*names).write.partitionBy("coarse").parquet(f"{root}/{folder}/rows")


def _entries(facts: DataFrame, root: str) -> DataFrame:
    """The facts that have a vector, each with its cell."""
    scope = [F.col(c) for c in ("id", "project_id", "created_by", "engineer", "repo", "tags", "archived")]
    rows = _vectors(facts).select(*scope, F.col("vec").cast("array<float>").alias("vec"))
    centres = _coarse_centres(facts.sparkSession, root)
    return _with_fine(_with_coarse(rows, centres, 1), root, 1, "id")


def write_index(
    memory: DataFrame, root: str, cell_rows: int = CELL_ROWS, centres: DataFrame | None = None
) -> None:
    """Store a new index of the facts at ``root``, which must not exist yet.

    ``centres`` (``coarse, fine, vec``, with ``fine`` -1 for the coarse ones, which are
    numbered from 0) are learnt unless given; every coarse cell needs a fine centre. An
    index of no vectors at all has no centres and finds nothing.
    """
    spark = memory.sparkSession
    centres = train_centres(memory, cell_rows) if centres is None else centres
    centres.select(
        F.col("coarse").cast("int").alias("coarse"), F.col("fine").cast("int").alias("fine"),
        F.col("vec").cast("array<double>").alias("vec"),
    ).write.parquet(f"{root}/centres")
    folder = f"v=0-{uuid.uuid4().hex}"
    if len(_coarse_centres(spark, root)):
        _write_rows(_entries(memory, root), root, folder)
    else:
        _write_rows(spark.createDataFrame([], _ENTRY), root, folder)
    _publish(spark, root, 0, folder, True)


def update_index(changed: DataFrame, root: str, removed: DataFrame | None = None) -> int:
    """Enter new facts and facts whose vector or scope changed; ``removed`` (``id``) leave.

    Only the given facts are assigned to cells. Returns the version. After MOST_CHANGES
    versions the next one is a whole one. An index without centres has to be written anew.
    """
    spark = changed.sparkSession
    chain = _chain(spark, root)
    if not len(_coarse_centres(spark, root)):
        raise ValueError("the index has no centres; write it anew")
    version = chain[-1].version + 1
    folder = f"v={version}-{uuid.uuid4().hex}"
    gone = changed.select("id")
    if removed is not None:
        gone = gone.unionByName(removed.select("id"))
    gone.distinct().write.parquet(f"{root}/{folder}/gone")
    _write_rows(_entries(changed, root), root, folder)
    _publish(spark, root, version, folder, False)
    if len(chain) >= MOST_CHANGES:
        version = compact_index(spark, root)
    return version


def compact_index(spark: SparkSession, root: str) -> int:
    """Write the entries in force as one whole version; older folders may be deleted then."""
    version = _chain(spark, root)[-1].version + 1
    folder = f"v={version}-{uuid.uuid4().hex}"
    entries = read_entries(spark, root).withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(8)))
    _write_rows(entries.repartition("coarse", "_block"), root, folder)
    _publish(spark, root, version, folder, True)
    return version


def read_entries(spark: SparkSession, root: str, coarse: list[int] | None = None) -> DataFrame:
    """The entries in force, of the given coarse cells alone if any are named."""
    chain = _chain(spark, root)
    parts, gone = [], []
    for at, pointer in enumerate(chain):
        path = f"{root}/{pointer.folder}"
        rows = spark.read.schema(_ENTRY).parquet(f"{path}/rows")
        if coarse is not None:
            rows = rows.filter(F.col("coarse").isin(coarse))
        parts.append(rows.withColumn("_version", F.lit(pointer.version)))
        if at:
            gone.append(spark.read.schema("id string").parquet(f"{path}/gone")
                        .withColumn("_gone", F.lit(pointer.version)))
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    if not gone:
        return entries.drop("_version")
    void = gone[0]
    for part in gone[1:]:
        void = void.unionByName(part)
    last = void.groupBy("id").agg(F.max("_gone").alias("_gone"))
    return (
        entries.join(last, "id", "left")
        .filter(F.col("_gone").isNull() | (F.col("_version") >= F.col("_gone")))
        .drop("_version", "_gone")
    )


# --- search ----------------------------------------------------------------------

_ASKED = ("query_id", "project_id", "embedding", "threshold", "limit", "agent", "engineer", "repo", "tags",
          "include_archived")


def reached_cells(queries: DataFrame, root: str, n_coarse: int, n_probe: int) -> DataFrame:
    """Prepared queries once per cell they search: the ``n_probe`` fine cells nearest to
    them in their ``n_coarse`` nearest coarse cells, ties to the smaller numbers."""
    asked = _vectors(queries.select(*_ASKED))
    routed = _with_coarse(asked, _coarse_centres(queries.sparkSession, root), n_coarse)
    near = _with_fine(routed, root, n_probe, "query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "coarse", "fine")
    return near.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= n_probe).drop("_n", "near")


def indexed_recall(
    memory: DataFrame, queries: DataFrame, root: str, n_coarse: int = 4, n_probe: int = 8
) -> DataFrame:
    """Batch recall through the stored index: ``query_id, rank`` and the recall columns.

    Similarities are exact, facts in cells that are not searched are missed; measure the
    loss with :func:`factlake.operators.ann.recall_at_k`. Scopes are those the index was
    last told of by :func:`update_index`; the other columns come from ``memory``. Equal
    ``query_id`` must not repeat. Facts and queries without a direction find nothing.
    """
    spark = memory.sparkSession
    queries, few = bounded(prepare_queries(queries))
    id_type = queries.schema["query_id"].dataType
    if len(_coarse_centres(spark, root)):
        reached = materialize(reached_cells(queries, root, n_coarse, n_probe), "index-probes")
    else:
        reached = spark.createDataFrame(
            [], T.StructType([*(queries.schema[c] if c != "embedding" else
                                T.StructField("vec", queries.schema[c].dataType) for c in _ASKED),
                              T.StructField("coarse", T.IntegerType()), T.StructField("fine", T.IntegerType())]))
    # At most MOST_COARSE numbers; they prune the folders to read.
    coarse = [row.coarse for row in reached.select("coarse").distinct().collect()]
    cell = F.concat_ws("\u0001", "project_id", F.col("coarse").cast("string"), F.col("fine").cast("string"))
    entries = read_entries(spark, root, coarse).withColumn("project_id", cell).withColumnRenamed("vec", "embedding")
    asked = reached.withColumn("project_id", cell).withColumnRenamed("vec", "embedding")
    rows, probes = scoped(entries, asked, few is not None)
    hits = best_hits(rows, probes).select("query_id", "id", "similarity")
    ranked = rank_per_query(hits, queries, few)
    return with_facts(memory, ranked, few_hits(few)).select(
        F.col("query_id").cast(id_type).alias("query_id"), "rank", *RECALL_COLUMNS
    )
