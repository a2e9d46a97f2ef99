"""Session construction and the shared work folder."""

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A table with less than this many bytes per core is spread over the cores.
_SMALL_SPLIT = 16 << 20


def build_session(app: str = "factlake", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and UTC as its time zone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, as
    in local tests, a fresh folder is made once and remembered in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("factlake.local.folder", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="factlake-")
        spark.conf.set("factlake.local.folder", folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/factlake-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the application's part of the shared folder that nothing else uses."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard_intermediates(spark: SparkSession) -> None:
    """Delete the application's intermediate tables once its results are stored.

    Results that were not written yet still read from them.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, survives the loss of an
    executor, and leaves a table with known size for the planner.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a compute-heavy pass over a small table.

    Judged by the planner's size estimate, which costs no job.  A large table
    comes in enough splits of its own and is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * _SMALL_SPLIT else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="factlake-zip-"), "factlake")
    archive = shutil.make_archive(
        target, "zip", root_dir=os.path.dirname(package), base_dir=os.path.basename(package)
    )
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
