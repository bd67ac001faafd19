"""Epochs of training batches: a store of dense items, dealt out anew each epoch by a permutation that is computed, not sorted.

An item is a seed's context as fixed-length planes. Items have places from 0; position p of an epoch holds the item at place
``permuted(p mod n)``. So a reader knows what its batch holds without reading anything else, and an epoch costs no shuffle of the store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.functions.rng import permuted
from relspark.storage import numbered

#: Parents of a row that a context holds.
MAX_PARENTS = 5
#: Time of a row without one, and of padding: the least number of 32 bits.
NO_TIME = -(2**31)

#: The planes of a sequence, with their types and what stands in padding. ``parents`` has MAX_PARENTS numbers a cell.
PLANES: dict[str, tuple[str, object]] = {
    "node": ("long", -1),
    "parents": ("long", -1),
    "table": ("int", 0),
    "col": ("int", 0),
    "class_value": ("long", -1),
    "sem_type": ("int", 0),
    "number": ("float", 0.0),
    "text": ("long", 0),
    "datetime": ("float", 0.0),
    "boolean": ("float", 0.0),
    "is_target": ("boolean", False),
    "is_task_node": ("boolean", False),
    "is_padding": ("boolean", True),
    "time": ("int", NO_TIME),
}


def rounded_bf16(x: Column) -> Column:
    """``x`` as the nearest number with 8 significant bits (ties to even), as a 16-bit brain float holds it."""
    f = x.cast("float").cast("double")
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(f))) - 7)
    # the logarithm of a number just below a power of two may round up to it: both steps are then multiples of the coarser
    fine = F.when(F.abs(f) < 128 * power, power / 2).otherwise(F.when(F.abs(f) >= 256 * power, power * 2).otherwise(power))
    return F.when((f == 0) | f.isNull() | F.isnan(f) | (F.abs(f) == float("inf")), f).otherwise(F.rint(f / fine) * fine).cast("float")


def dense_items(cells: DataFrame, length: int) -> DataFrame:
    """``seed_key, n`` and the PLANES as arrays of ``length`` (``parents``: MAX_PARENTS times that), one row a sequence.

    ``cells(seed_key, pos, node, parents array, table int, col int, class_value, sem_type, number, text, datetime, boolean, is_target,
    is_task_node, time)``, where ``pos`` counts from 0; a null is what padding holds, values become brain floats, and more than MAX_PARENTS
    parents are an error. Cells from ``length`` on are left out. A sequence is of bounded length, so its group is.
    """
    one = []
    for name, (kind, none) in PLANES.items():
        if name == "is_padding":
            one.append(F.lit(False).alias(name))
        elif name == "parents":
            few = F.when(F.size("parents") > MAX_PARENTS, F.raise_error(F.lit("a row with too many parents")).cast("array<long>")).otherwise(F.coalesce("parents", F.array().cast("array<long>")))
            one.append(F.concat(few, F.array_repeat(F.lit(-1).cast("long"), MAX_PARENTS - F.size(few))).alias(name))
        else:
            value = rounded_bf16(F.col(name)) if kind == "float" else F.col(name).cast(kind)
            one.append(F.coalesce(value, F.lit(none).cast(kind)).alias(name))
    each = F.sort_array(F.collect_list(F.struct("pos", *one)))
    rows = cells.filter(F.col("pos") < length).groupBy("seed_key").agg(each.alias("x"))
    planes = []
    for name, (kind, none) in PLANES.items():
        many = MAX_PARENTS if name == "parents" else 1
        own = F.col(f"x.{name}")
        own = F.flatten(own) if name == "parents" else own
        planes.append(F.concat(own, F.array_repeat(F.lit(none).cast(kind), (length - F.size("x")) * many)).alias(name))
    return rows.select("seed_key", F.size("x").alias("n"), *planes)


def write_items(items: DataFrame, path: str, per_file: int = 256, ranged: bool = False) -> None:
    """A store that ``batches`` and the data source read: items with their place in order of seed_key, ``per_file`` a folder.

    Numbered items are in order, so that a task has whole folders, but for those at the ends of what it reads, which then hold two files.
    ``ranged`` items are range-partitioned by seed_key already, and don't move.
    """
    placed = numbered(items, ["seed_key"], "item", ranged).withColumn("part", F.floor(F.col("item") / per_file).cast("long"))
    n = placed.count()
    placed.sortWithinPartitions("part", "item").write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/items")
    spark = items.sparkSession
    spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(per_file).alias("per_file")).coalesce(1).write.json(f"{path}/about")


def about(spark: SparkSession, path: str) -> tuple[int, int]:
    """How many items a store has, and how many a file."""
    row = spark.read.schema("n long, per_file int").json(f"{path}/about").first()
    return row["n"], row["per_file"]


def positions(spark: SparkSession, n: int, ranks: int, size: int, seed: int, epoch: int) -> DataFrame:
    """``batch, rank, slot, item, own``: which item each slot of an epoch holds; the last batches are filled from the epoch's beginning, where ``own`` is false."""
    per = ranks * size
    total = -(-n // per) * per
    p = F.col("id")
    item = permuted(p % n, n, seed, epoch) if n else F.lit(0).cast("long")
    return spark.range(total).select(F.floor(p / per).cast("long").alias("batch"), F.floor(p % per / size).cast("int").alias("rank"), (p % size).cast("int").alias("slot"), item.alias("item"), (p < n).alias("own"))


def batches(spark: SparkSession, path: str, ranks: int, size: int, seed: int = 0, epoch: int = 0, planes: Sequence[str] = tuple(PLANES)) -> DataFrame:
    """``batch, rank, true_size, items`` and ``planes``, each the ``size`` sequences of a batch one after the other: one record a batch and rank.

    For whole epochs: items meet their positions in a join. The data source looks up a batch's items instead.
    """
    n, _ = about(spark, path)
    # the schema is known, so that no file is opened for it
    kinds = ", ".join(f"{c} array<{PLANES[c][0]}>" for c in planes)
    items = spark.read.schema(f"item long, {kinds}, part long").option("basePath", f"{path}/items").parquet(f"{path}/items").drop("part")
    placed = positions(spark, n, ranks, size, seed, epoch).join(items, "item")
    each = F.sort_array(F.collect_list(F.struct("slot", "own", "item", *planes)))
    rows = placed.groupBy("batch", "rank").agg(each.alias("x"))
    flat = [F.flatten(f"x.{c}").alias(c) for c in planes]
    return rows.select("batch", "rank", F.size(F.filter("x", lambda s: s["own"])).alias("true_size"), F.col("x.item").alias("items"), *flat)
