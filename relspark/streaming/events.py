"""Event streams: windows with watermarks, deduplication, mergeable statistics and a stream-static key join."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.storage import shared_folder


def read_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """``{folder}/{table}.parquet`` as a stream, a file or folder of files at a time."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{table}.parquet*")


def windowed_counts(stream: DataFrame, ts: str, key: str, value: str, length: str, late: str) -> DataFrame:
    """Tumbling windows a key: count and sum; events later than ``late`` are dropped by the watermark."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", length).alias("w"), key).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("cents"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions a key: events no further apart than ``gap``."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.session_window("__ts", gap).alias("w"), key).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.dropDuplicatesWithinWatermark(keys).drop("__ts")


def running_stats(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum and sum of squares a key: statistics that merge; mean and deviation follow from them."""
    v = F.col(value)
    return stream.groupBy(key).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))


def with_parent(stream: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Each event with its parent row, if it has one."""
    return stream.join(parent, stream[key] == parent[parent_key], "left")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """The result of ``stream`` over all that is there now, through a table in the shared checkpoint folder.

    Each batch has a folder of its own, which it overwrites: a batch that is played again after a failure
    leaves no row twice. In mode complete the last batch is the result.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/none")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'last' if mode == 'complete' else number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
