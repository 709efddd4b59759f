"""The decision log as a stream: new log files are merged into a table of latest decisions, one batch at a time.

Each micro-batch folds into the table by (append order), so files that arrive late or out of order end in the same table as one
batch over all of them. A version of the table is written whole before the pointer to it moves; a batch that is run again
writes the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators.decisions import latest, parse_log


def merged(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The latest decision of each part number of both; both have `at`."""
    both = batch if state is None else state.unionByName(batch)
    order = both.withColumn("_at", F.col("at"))
    return latest(order, "part_number", "_at")


def replay(spark: SparkSession, log: str, table: str, checkpoint: str):
    """Start the stream; it takes what is there and ends. Returns the query."""
    source = spark.readStream.schema("value string").text(log).select("value", "_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start")
    lines = source.select("value", F.struct("file_modification_time", "file_name", "file_block_start").alias("at"))

    def fold(batch: DataFrame, number: int) -> None:
        numbered = batch.select("value", F.struct(F.col("at.file_modification_time"), F.col("at.file_name"), F.monotonically_increasing_id().alias("_n")).alias("at"))
        state = spark.read.parquet(f"{table}/v{number - 1}") if number else None
        merged(state, parse_log(numbered)).write.mode("overwrite").parquet(f"{table}/v{number}")

    return lines.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
