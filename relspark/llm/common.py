"""Helpers that several of the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.storage import checkpointed, stored

__all__ = ["ascii_lower", "checkpointed", "keyed", "small", "small_batches", "stored", "table", "texts"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows of an Arrow batch: documents are long, and a task holds a batch several times over.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, if they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)


def texts(column: pa.Array, step: int = 128) -> Iterator[str]:
    """The strings of a column, made ``step`` at a time; null is empty."""
    for i in range(0, len(column), step):
        for t in column.slice(i, step).to_pylist():
            yield t or ""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character kept."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


#: Keys of 16 bytes up to which a join with them asks for a broadcast.
MAX_BROADCAST_KEYS = 1_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns as one struct)``, doc_id, text, k1, k2``: rows of equal doc_id and text have equal keys."""
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        "doc_id",
        "text",
        F.xxhash64("doc_id", "text").alias("k1"),
        F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"),
    )


def small(df: DataFrame, most: int = MAX_BROADCAST_KEYS, size: Column | None = None) -> DataFrame:
    """``df`` written once, marked for broadcast if it has at most ``most`` rows and ``size``, if given, sums to no more either."""
    df = checkpointed(df)
    n = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("size") if size is not None else F.lit(0).alias("size")).first()
    return F.broadcast(df) if max(n["rows"], n["size"]) <= most else df
