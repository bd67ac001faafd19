"""Prediction tasks: catalogs of what to predict, splits in time, limits, and the way back from nodes to entities."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from relspark.functions.rng import u32


@dataclass(frozen=True)
class TaskSpec:
    """What to predict: ``kind`` is classification or regression; ``leaks`` are columns hidden on the seed's row and time."""

    db: str
    table: str
    target: str
    kind: str
    leaks: tuple[str, ...] = ()


def feature_tasks(db: str, table: str, df: DataFrame, part: str = "feature") -> list[TaskSpec]:
    """A task for each column whose name contains ``part``: booleans and strings are classes, floating numbers regressions."""
    out = []
    for f in df.schema:
        if part in f.name:
            if isinstance(f.dataType, (T.BooleanType, T.StringType)):
                out.append(TaskSpec(db, table, f.name, "classification"))
            elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                out.append(TaskSpec(db, table, f.name, "regression"))
    return out


def is_synthetic(name: str, prefix: str | None = None) -> bool:
    return "synthetic" in name or prefix is not None and name.startswith(prefix)


def leave_out(tasks: Iterable[TaskSpec], db: str) -> list[TaskSpec]:
    """The tasks of all other databases."""
    return [t for t in tasks if t.db != db]


def limited(tasks: Iterable[TaskSpec], limit: int, seed: int = 0) -> list[TaskSpec]:
    """Of each database and kind up to ``limit // 2`` tasks, drawn by keyed hash."""
    from zlib import crc32

    out, taken = [], {}
    for t in sorted(tasks, key=lambda t: (crc32(f"{seed}|{t.db}|{t.table}|{t.target}".encode()), t.table, t.target)):
        if taken.get((t.db, t.kind), 0) < limit // 2:
            taken[t.db, t.kind] = taken.get((t.db, t.kind), 0) + 1
            out.append(t)
    return out


def first_valid(names: Iterable[str], valid: Iterable[bool], count: int) -> list[str]:
    """The first ``count`` names, in order, of valid databases; too few are an error."""
    good = [n for n, ok in sorted(zip(names, valid, strict=True)) if ok][:count]
    if len(good) < count:
        raise ValueError(f"{count} valid databases are wanted, there are {len(good)}")
    return good


def time_split(ts: Column, val: str, test: str) -> Column:
    """train before ``val``, then val, then test from ``test`` on; null for no time."""
    a, b = F.lit(val).cast("timestamp_ntz"), F.lit(test).cast("timestamp_ntz")
    return F.when(ts < a, "train").when(ts < b, "val").when(ts >= b, "test")


def cut_times(start: str, end: str, val_share: float = 0.8, test_share: float = 0.9) -> tuple[str, str]:
    """The days at these shares of the daily range from ``start`` to ``end``."""
    from datetime import date, timedelta

    a, b = date.fromisoformat(start), date.fromisoformat(end)
    days = (b - a).days + 1
    return tuple((a + timedelta(days=int(days * s))).isoformat() for s in (val_share, test_share))


def limit_per_group(df: DataFrame, groups: list[str], key: str, count: int, seed: int = 0) -> DataFrame:
    """Up to ``count`` rows of each group, drawn by keyed hash; the rank is cut before the exchange too."""
    w = Window.partitionBy(*groups).orderBy(u32(seed, F.col(key)), key)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= count).drop("__n")


def task_tables(infos: DataFrame, tasks: DataFrame) -> DataFrame:
    """``tasks(table, split)`` with node offset and size from ``infos(table, split, first_node, n_rows)``: the whole table ("db") first, else the split's."""
    whole = infos.filter("split = 'db'").select("table", F.col("first_node").alias("f1"), F.col("n_rows").alias("n1"))
    own = infos.filter("split <> 'db'").select("table", "split", F.col("first_node").alias("f2"), F.col("n_rows").alias("n2"))
    met = tasks.join(whole, "table", "left").join(own, ["table", "split"], "left")
    return met.select("table", "split", F.coalesce("f1", "f2").alias("first_node"), F.coalesce("n1", "n2").alias("n_rows"))


def without_database_rows(nodes: DataFrame, split: str = "split") -> DataFrame:
    """Nodes of task tables only; ids were given before, so they stay."""
    return nodes.filter(F.col(split) != "db")


def entity_ids(nodes: DataFrame, node: str, first_node: int) -> DataFrame:
    """Nodes with ``entity_id``: their place in the table whose first node is ``first_node``."""
    return nodes.withColumn("entity_id", F.col(node) - F.lit(first_node))


def full_batches(rows: DataFrame, batch: str, size: int) -> DataFrame:
    """Rows of batches that have all their ``size`` rows."""
    whole = rows.groupBy(batch).agg(F.count("*").alias("__n")).filter(F.col("__n") == size).select(batch)
    return rows.join(whole, batch, "left_semi")


def first_steps(rows: DataFrame, batch: str, steps: int) -> DataFrame:
    """Rows of the first ``steps`` batches, as an evaluation with a step cap sees them."""
    return rows.filter(F.col(batch) < steps)
