"""Cutting lineage through the shared checkpoint folder, and row numbers without a single-partition sort."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Whether an action's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    The folder is the session's ``spark.checkpoint.dir``. A session on one machine that names none gets a
    temporary one, as in local tests; on a cluster it is an error, as executors share no local folder.
    """
    shared_folder(df.sparkSession)
    with without_leftovers(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan made here, as the setting counts when a plan is made


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Runs actions whose shuffle files go as each ends: what they made is written elsewhere, and nothing reads those files again."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, True)
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def written(df: DataFrame) -> DataFrame:
    """``df`` as ``stored`` has it if Parquet holds all of its types, else as ``checkpointed`` does: a fixed evaluation of it, for row numbers."""
    flat = df.schema.simpleString()
    if re.search(r"[:<,](void|interval|variant)", flat) or len({c.lower() for c in df.columns}) < len(df.columns):
        return checkpointed(df)
    return stored(df)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "rn", ranged: bool = False) -> DataFrame:
    """``df`` with ``name``: the row's place from 0 in the total order ``order``.

    Rows are range-partitioned and sorted in parallel; only the partitions' sizes meet in one
    place. The sorted rows are written as Parquet, so that sizes and rows come from one evaluation.
    ``ranged`` says that ``df`` is range-partitioned by ``order`` already.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (df if ranged else df.repartitionByRange(parts, *order)).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = written(rows)
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # one row a partition: a small window
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))
    at = (F.col("__before") + F.col("__at") - F.shiftleft(F.col("__part"), 33)).alias(name)
    return rows.withColumn("__part", part).join(offsets, "__part").select(*df.columns, at)


def numbered_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """``df`` with ``name``: the row's place from 0 within its group; a group of any size is sorted by many tasks."""
    return running_within(df, groups, order, {}, place=name)


def running_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], sums: dict[str, str], place: str | None = None, start: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with running sums within groups, a group of any size summed by many tasks.

    ``sums`` names, for each new column, the integer column to sum, in the order ``order`` within ``groups``, the row's own
    value included (a null counts 0). ``place`` is the row's place from 0 in its group, ``start`` the group's first place in the order of all rows:
    a number for the group. ``keep`` are the columns to carry on (default: all; the groups always).

    One range partitioning and sort by (groups, order), then a scan of each partition. A group that goes on from
    partition to partition is carried over by the partitions' last sums, one row a partition. Groups of null are groups; groups are no floats.
    The scanned rows are written as Parquet, so that sums and carries come from one evaluation.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in df.columns if keep is None or c in {*keep, *groups, *sums.values()}]
    rows = df.repartitionByRange(parts, *groups, *order).sortWithinPartitions(*groups, *order).select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    values, n = [*sums.values()], len(sums)
    added = ["__part", "__at", "__head", "__n", *(f"__s{i}" for i in range(n))]
    schema = f"{fields}, __part int, __at long, __head boolean, __n long" + "".join(f", __s{i} long" for i in range(n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, head, last = TaskContext.get().partitionId(), 0, True, None
        run = np.zeros(n + 1, np.int64)
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            new = np.zeros(m, bool)
            for g in groups:
                column = b.column(g)
                differs = lambda x, y: (pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)) | (x.is_null().to_numpy(zero_copy_only=False) != y.is_null().to_numpy(zero_copy_only=False))
                new[1:] |= differs(column.slice(1), column.slice(0, m - 1))
                if last is not None:
                    new[:1] |= differs(column.slice(0, 1), last[g])
            last = {g: b.column(g).slice(m - 1) for g in groups}
            segment = np.cumsum(new)
            starts = np.concatenate(([0], np.flatnonzero(new)))[segment]
            own = np.stack([np.ones(m, np.int64), *(pc.fill_null(b.column(c), 0).cast(pa.int64()).to_numpy() for c in values)])
            total = np.cumsum(own, axis=1)
            local = total - (total - own)[:, starts] + np.where(segment == 0, run[:, None], 0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(m, part, np.int32)), pa.array(at + np.arange(m)), pa.array((segment == 0) & head), *map(pa.array, local)], names=[*kept, *added]
            )
            at, head, run = at + m, head and not segment[-1], local[:, -1]

    rows = written(rows.mapInArrow(scan, schema))
    totals = [f"__{x}" for x in ("n", *(f"s{i}" for i in range(n)))]
    group = F.struct(*groups)
    ends = rows.groupBy("__part").agg(F.count("*").alias("rows"), F.min_by(group, "__at").alias("first"), F.max_by(group, "__at").alias("last"), F.max_by(F.struct(*totals), "__at").alias("run"))
    # two rows a partition: what its first group has before it, and what its last group has in it
    none = F.lit(0).cast("long")
    ask = F.struct(F.col("first").alias("g"), F.lit(0).alias("gives"), "rows", *(none.alias(t) for t in totals))
    give = F.struct(F.col("last").alias("g"), F.lit(1).alias("gives"), none.alias("rows"), *(F.col(f"run.{t}").alias(t) for t in totals))
    both = ends.select("__part", F.explode(F.array(ask, give)).alias("x")).select("__part", "x.*")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.orderBy("__part", "gives").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = both.select("__part", "gives", before("rows", Window.partitionBy()).alias("__before"), *(before(t, Window.partitionBy("g")).alias(f"{t}_before") for t in totals))
    met = rows.join(F.broadcast(carried.filter("gives = 0").drop("gives")), "__part")
    whole = {t: F.col(t) + F.when(F.col("__head"), F.col(f"{t}_before")).otherwise(0) for t in totals}
    out = [F.col(f"`{c}`") for c in kept] + [whole[f"__s{i}"].alias(name) for i, name in enumerate(sums)]
    if place:
        out.append((whole["__n"] - 1).alias(place))
    if start:
        out.append((F.col("__before") + F.col("__at") - whole["__n"] + 1).alias(start))
    return met.select(*out)


#: Rows of one window without groups.
WINDOW_ROWS = 65_536


def sums_before(df: DataFrame, order: str, value: str, name: str, step: int = 1024) -> DataFrame:
    """``df(order long, value)``, one row for each ``order`` at most, with ``name``: the sum of ``value`` over all smaller ``order``.

    More than WINDOW_ROWS rows are summed in blocks of ``step`` first, and the blocks in turn.
    """
    before = lambda w: F.coalesce(F.sum(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if df.count() <= WINDOW_ROWS:
        return df.withColumn(name, before(Window.partitionBy()))
    name_of = f"{order}_block"
    block = F.floor(F.col(order) / step).cast("long").alias(name_of)
    blocks = checkpointed(df.groupBy(block).agg(F.sum(value).alias("total")))
    below = sums_before(blocks, name_of, "total", "below", step).select(name_of, "below").alias("b")
    inside = df.select("*", block).withColumn("inside", before(Window.partitionBy(name_of))).alias("i")
    met = inside.join(below, F.col(f"i.{name_of}") == F.col(f"b.{name_of}"))
    return met.select(*(F.col(f"i.{c}") for c in df.columns), (F.col("inside") + F.col("below")).alias(name))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new folder beside the checkpoints and read back: smaller than a checkpoint, and read by column."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with without_leftovers(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int | None = None, name: str | None = None) -> DataFrame:
    """``df`` as a table of files bucketed and sorted by ``keys`` in the shared checkpoint folder: joins on these keys don't move it again.

    There are as many ``buckets`` as shuffle partitions unless said otherwise, so that the other side of a join is dealt to match.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = uuid.uuid4().hex
    table = name or f"relspark_{unique}"
    rows = df.repartition(n, *keys).sortWithinPartitions(*keys)
    with without_leftovers(spark):
        rows.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", f"{shared_folder(spark)}/bucketed-{unique}").saveAsTable(table)
    return spark.table(table)
