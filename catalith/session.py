"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = str(Path(__file__).resolve().parent.parent)
#: Rows of an Arrow batch: Spark's default, and what we take in its place, as whole texts make large batches in the executor and its Python worker both.
BATCH_ROWS, BATCH_DEFAULT, OUR_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def prepare(spark: SparkSession) -> SparkSession:
    """Make sure Python workers can import this package and get batches of bounded size (a session's own choice stays), and return the session."""
    if spark.conf.get(BATCH_ROWS) == BATCH_DEFAULT:
        spark.conf.set(BATCH_ROWS, OUR_BATCH)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])
    return spark


def local_session(cpus: str = "8", partitions: int = 8, memory: str = "8g", name: str = "catalith") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return prepare(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by their keys, for work that costs much for each row: a small file with many rows is one task otherwise, however many cores there are."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: a folder of this machine for a local master, else one in the warehouse, which a cluster shares too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root and app not in _own_folders:
        local = spark.sparkContext.master.startswith("local")
        _own_folders[app] = tempfile.mkdtemp(prefix="catalith-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/catalith-scratch"
    return (root or _own_folders[app]).rstrip("/")


_made: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new name in a folder of this application within the shared one, which goes when the application ends."""
    folder = f"{shared_folder(spark)}/catalith-{spark.sparkContext.applicationId}"
    if folder not in _made:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)  # PySpark has no public way to delete files of a shared store
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _made.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts the lineage and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
