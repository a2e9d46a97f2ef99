"""The fact table on disk, exports, and snapshots of state."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.operators import filters
from factlake.operators.listing import union_active_archived
from factlake.operators.projections import API_NAMES, to_api_rows
from factlake.schema import memory_schema
from factlake.session import materialize

PARTITIONS = ("project_id", "archived")
# A snapshot's facts of a project lie in buckets of their ids, of about so many rows.
BUCKET_ROWS = 100_000
# After so many versions of changes alone, the next one is complete again.
MOST_CHANGES = 16


def write_memory(
    df: DataFrame, path: str, mode: str = "errorifexists", partitions: tuple[str, ...] = PARTITIONS
) -> None:
    """Parquet by project and archived flag, sorted so that row groups prune by access time.

    Most of it is text, of which zstd leaves about half of what Spark's default does.
    Adaptive execution splits the rows of a large project over as many tasks
    as their size asks for and merges small ones.
    """
    (
        df.hint("rebalance", *partitions)
        .sortWithinPartitions(*partitions, "last_accessed_at")
        .write.mode(mode).option("compression", "zstd").partitionBy(*partitions).parquet(path)
    )


def scan_memory(
    spark: SparkSession, path: str, project_id: str | None = None, archived: bool | None = None
) -> DataFrame:
    """The table, pruned to a project's and state's folders."""
    found = spark.read.option("basePath", path).parquet(path).schema
    # Declared, since folder names such as 007 would be taken for numbers.
    declared = T.StructType([
        T.StructField(f.name, {"project_id": T.StringType(), "archived": T.BooleanType()}.get(f.name, f.dataType))
        for f in found.fields
    ])
    df = spark.read.schema(declared).option("basePath", path).parquet(path)
    if project_id is not None:
        df = filters.by_project(df, project_id)
    if archived is not None:
        df = df.filter("archived" if archived else "NOT archived")
    return df


# --- export ---------------------------------------------------------------------

def export_memories(memory: DataFrame, project_id: str | None = None, scope: str = "all") -> DataFrame:
    """API rows without the vector plus their position in the export.

    Active facts come first, each class newest first, ties by id: sort by
    ``branch`` (0 active, 1 archived), ``createdAt`` descending and ``id``.
    """
    if scope not in ("all", "active", "archived"):
        raise ValueError("scope must be 'all', 'active' or 'archived'")
    rows = union_active_archived(memory, project_id)
    if scope != "all":
        rows = rows.filter(F.col("branch") == (0 if scope == "active" else 1))
    branch = F.when(F.col("archived"), 1).otherwise(0).alias("branch")
    return to_api_rows(rows).select("*", branch)


def write_export(exported: DataFrame, path: str) -> None:
    """JSON lines in export order over as many files as the sort has ranges."""
    exported.orderBy("branch", F.desc("createdAt"), "id").drop("branch").write.json(
        path, ignoreNullFields=False
    )


def restore_export(spark: SparkSession, path: str, timestamp: T.DataType | None = None) -> DataFrame:
    """The facts of a written export with all their fields, whatever their length.

    Vectors are not exported; ``lifecycle.re_embed`` gives them back.
    """
    kinds = memory_schema(timestamp or T.TimestampType())
    names = {name: column for column, name in API_NAMES.items()}
    read = T.StructType([
        T.StructField(name, T.StringType() if isinstance(kinds[column].dataType, (T.TimestampType, T.TimestampNTZType))
                      else kinds[column].dataType)
        for name, column in names.items()
    ])
    rows = spark.read.schema(read).json(path)
    return rows.select(*[
        (F.col(API_NAMES[f.name]) if f.name in API_NAMES else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in kinds.fields
    ])


# --- snapshots -------------------------------------------------------------------
#
# A version is a folder of facts by project, bucket of ids and archived flag. A complete
# version holds them all; a version of changes holds whole new buckets in place of the
# touched ones, or added facts alone. What is read is, per bucket, its last whole content
# and everything added since.

# A complete version states the columns, since a version without facts has no file to take them from.
_POINTER = "version long, folder string, complete boolean, columns string"
_BUCKETS = "folder string, version long, project_id string, bucket int, parts int, whole boolean"
_BUCKETED = ("project_id", "bucket", "archived")


def _filesystem(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _published(spark: SparkSession, root: str) -> DataFrame | None:
    fs, path = _filesystem(spark, f"{root}/published")
    if not fs.exists(path):
        return None
    return spark.read.schema(_POINTER).json(f"{root}/published")


def latest_version(spark: SparkSession, root: str) -> int | None:
    pointers = _published(spark, root)
    return None if pointers is None else pointers.agg(F.max("version")).first()[0]


def _chain(spark: SparkSession, root: str, version: int | None) -> list:
    """The last complete version up to ``version`` and the changes since, at most MOST_CHANGES."""
    pointers = _published(spark, root)
    if pointers is None:
        return []
    upto = pointers if version is None else pointers.filter(F.col("version") <= version)
    start = upto.filter("complete").agg(F.max("version")).first()[0]
    if start is None:
        return []
    rows = upto.filter(F.col("version") >= start).orderBy("version", "folder").collect()
    # A job that was stopped right after it published may have published once more.
    return list({row.version: row for row in reversed(rows)}.values())[::-1]


def _buckets(spark: SparkSession, root: str, chain: list) -> DataFrame:
    """The buckets that a chain of versions wrote, added to or emptied."""
    return spark.read.schema(_BUCKETS).parquet(f"{root}/buckets").filter(
        F.col("folder").isin([row.folder for row in chain])
    )


def _same(left: str, right: str, *names: str):
    found = F.lit(True)
    for name in names:
        found &= F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return found


def _placed(df: DataFrame, parts: DataFrame) -> DataFrame:
    """``df`` with the bucket of each fact; a project that is not listed has one."""
    rows = df.alias("f").join(parts.alias("p"), _same("f", "p", "project_id"), "left")
    bucket = F.pmod(F.xxhash64("f.id"), F.coalesce("p.parts", F.lit(1))).cast("int").alias("bucket")
    return rows.select("f.*", bucket)


def _next(spark: SparkSession, root: str, version: int | None) -> tuple[int, bool]:
    """The version to write, and whether it is still to be written."""
    latest = latest_version(spark, root)
    if version is None:
        return (0 if latest is None else latest + 1), True
    return version, latest is None or version > latest


def _publish(
    spark: SparkSession, root: str, folder: str, version: int, listed: DataFrame, columns: T.StructType | None = None
) -> None:
    listed.select(
        F.lit(folder).alias("folder"), F.lit(version).cast("long").alias("version"),
        "project_id", "bucket", "parts", F.col("whole"),
    ).write.mode("append").parquet(f"{root}/buckets")
    pointer = spark.createDataFrame([(version, folder, columns is not None, columns and columns.json())], _POINTER)
    pointer.coalesce(1).write.mode("append").json(f"{root}/published")


def _folder(version: int) -> str:
    return f"v={version}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, root: str, folder: str, schema: T.StructType) -> DataFrame:
    """A version's facts with their bucket."""
    kept = [f for f in schema.fields if f.name not in _BUCKETED]
    full = T.StructType([*kept, T.StructField("project_id", T.StringType()),
                         T.StructField("bucket", T.IntegerType()), T.StructField("archived", T.BooleanType())])
    path = f"{root}/{folder}"
    return spark.read.schema(full).option("basePath", path).parquet(path)


def write_snapshot(df: DataFrame, root: str, version: int | None = None, bucket_rows: int = BUCKET_ROWS) -> int:
    """Write a complete new version beside the old ones, then publish it.

    Readers follow the published version, so a job that dies half way leaves
    the previous state in force.  A given ``version`` that is already
    published is left alone, which makes a repeated micro-batch harmless.
    Buckets are counted from the version before, or from ``df`` for the first.
    """
    spark = df.sparkSession
    version, wanted = _next(spark, root, version)
    if not wanted:
        return version
    known = df if not _chain(spark, root, None) else read_snapshot(spark, root)
    parts = known.groupBy("project_id").agg(
        F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.count(F.lit(1)) / bucket_rows, F.lit(1.0)))))
        .cast("int").alias("parts")
    )
    parts = materialize(parts, "snapshot-parts")
    folder = _folder(version)
    write_memory(_placed(df, parts), f"{root}/{folder}", partitions=_BUCKETED)
    listed = _written(spark, root, folder, df.schema).select("project_id", "bucket").distinct()
    listed = listed.alias("l").join(parts.alias("p"), _same("l", "p", "project_id"), "left").select(
        "l.*", F.coalesce("p.parts", F.lit(1)).alias("parts"), F.lit(True).alias("whole"))
    _publish(spark, root, folder, version, listed, df.schema)
    return version


def append_snapshot(added: DataFrame, root: str, version: int | None = None) -> int:
    """Publish a version with further facts, whose ids are new; only they are written."""
    spark = added.sparkSession
    version, wanted = _next(spark, root, version)
    if not wanted:
        return version
    chain = _chain(spark, root, None)
    if not chain or len(chain) > MOST_CHANGES:
        return write_snapshot(read_snapshot(spark, root).unionByName(added) if chain else added, root, version)
    parts = _buckets(spark, root, chain).groupBy("project_id").agg(F.max("parts").alias("parts"))
    folder = _folder(version)
    write_memory(_placed(added, parts), f"{root}/{folder}", partitions=_BUCKETED)
    listed = _written(spark, root, folder, added.schema).select("project_id", "bucket").distinct()
    listed = listed.alias("l").join(parts.alias("p"), _same("l", "p", "project_id"), "left").select(
        "l.*", F.coalesce("p.parts", F.lit(1)).alias("parts"), F.lit(False).alias("whole"))
    _publish(spark, root, folder, version, listed)
    return version


def change_snapshot(spark: SparkSession, root: str, ids: DataFrame, change, version: int | None = None) -> int:
    """Publish a version in which ``change`` was applied; only buckets that hold one of ``ids`` are written.

    ``change`` takes facts and returns them changed, as ``lambda facts:
    lifecycle.forget(facts, ids)[0]``.  It may alter or drop facts of ``ids``
    alone; it brings no new ids and moves none to another project.
    """
    version, wanted = _next(spark, root, version)
    if not wanted:
        return version
    chain = _chain(spark, root, None)
    if len(chain) > MOST_CHANGES:
        return write_snapshot(change(read_snapshot(spark, root)), root, version)
    parts = _buckets(spark, root, chain).groupBy("project_id").agg(F.max("parts").alias("parts"))
    held = _placed(read_snapshot(spark, root).select("id", "project_id"), parts)
    touched = materialize(
        held.join(ids.select("id").distinct(), "id", "left_semi").select("project_id", "bucket").distinct(), "touched")
    rows = _current(spark, root, chain, touched)
    folder = _folder(version)
    write_memory(_placed(change(rows), parts), f"{root}/{folder}", partitions=_BUCKETED)
    listed = touched.alias("l").join(parts.alias("p"), _same("l", "p", "project_id"), "left").select(
        "l.*", F.coalesce("p.parts", F.lit(1)).alias("parts"), F.lit(True).alias("whole"))
    _publish(spark, root, folder, version, listed)
    return version


def _current(spark: SparkSession, root: str, chain: list, only: DataFrame | None = None) -> DataFrame:
    """The facts of a chain of versions, or those in the buckets of ``only``."""
    listed = _buckets(spark, root, chain)
    last = listed.groupBy("project_id", "bucket").agg(F.max(F.when(F.col("whole"), F.col("version"))).alias("last"))
    live = listed.alias("b").join(last.alias("l"), _same("b", "l", "project_id", "bucket")).filter(
        F.col("b.version") >= F.coalesce("l.last", F.lit(-1))).select("b.*")
    if only is not None:
        live = live.alias("b").join(only.alias("o"), _same("b", "o", "project_id", "bucket"), "left_semi")
    live = materialize(live.select("folder", "project_id", "bucket"), "live-buckets")
    schema = T.StructType.fromJson(json.loads(chain[0].columns))
    found = None
    for row in chain:
        # The live buckets prune the folder's partitions at run time.
        facts = _written(spark, root, row.folder, schema).alias("f").join(
            live.filter(F.col("folder") == row.folder).alias("b"),
            (F.col("f.bucket") == F.col("b.bucket")) & _same("f", "b", "project_id"), "left_semi",
        ).select("f.*").drop("bucket")
        found = facts if found is None else found.unionByName(facts)
    return found


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The published state, or that of an earlier version."""
    chain = _chain(spark, root, version)
    if not chain or (version is not None and chain[-1].version != version):
        raise ValueError(f"no snapshot {version} under {root}")
    if len(chain) == 1:
        schema = T.StructType.fromJson(json.loads(chain[0].columns))
        return _written(spark, root, chain[0].folder, schema).drop("bucket")
    return _current(spark, root, chain)
