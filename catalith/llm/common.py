"""What the training-data operators share: the scratch folder, written tables, packed rows, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's memo of words may hold; words beyond it are worked out afresh.
MEMO_ENTRIES = 400_000
#: Makes Spark drop a query's shuffle files as soon as the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_roots: dict[str, str] = {}
_made: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: a folder of this machine for a local master, else one in the warehouse,
    which a cluster shares too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    app = spark.sparkContext.applicationId
    if app not in _roots:
        local = spark.sparkContext.master.startswith("local")
        _roots[app] = tempfile.mkdtemp(prefix="catalith-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/catalith-scratch"
    return _roots[app]


def new_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new name in the shared folder. Unless it is to be kept, `released` deletes it, or else the end of the application."""
    path = f"{scratch_root(spark).rstrip('/')}/catalith-{name}-{uuid.uuid4().hex}"
    if not keep:
        _made.append(path)
    return path


def written(df: DataFrame, name: str, keep: bool = False, by: str | None = None, files: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts the lineage and outlives executors. files: into so many at most, for tables of known size."""
    spark = df.sparkSession
    path = new_folder(spark, name, keep)
    write(df.coalesce(files) if files else df, path, by)
    return spark.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write a table; the shuffle files that this took go with the query's end."""
    with shuffles_dropped(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    if path in _made:
        where, files = _hadoop(df.sparkSession, path)
        files.deleteOnExit(where)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the intermediate tables that were written within; for callers that have written what they wanted."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            remove(spark, path)
        del _made[before:]


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # PySpark has no public way to delete files of a shared store
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    where, files = _hadoop(spark, path)
    files.delete(where, True)


def remainder(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(n)


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes, so that Arrow hands it over without decoding; null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def corpus_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


class Memo(dict):
    """A bounded memo of a pure function; what does not fit is computed each time."""

    def __init__(self, function, entries: int = MEMO_ENTRIES, longest: int = 64):
        super().__init__()
        self.function, self.entries, self.longest = function, entries, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(self) < self.entries and len(key) <= self.longest:
            self[key] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def batches_of_documents(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of bounded text, at least one document each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        cuts, room = [0], 0
        for i, n in enumerate(sizes.tolist()):
            if room and room + n > most_bytes:
                cuts.append(i)
                room = 0
            room += n
        for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
            yield batch.slice(a, b - a)


def buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each key: its leading bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def bits_for(total: int, each: int) -> int:
    """So many leading bits that a bucket holds about `each` of `total`."""
    return max(0, int(np.ceil(np.log2(max(1, total / each)))))
