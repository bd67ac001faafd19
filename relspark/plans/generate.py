"""Whole databases from a seed: schema graph, foreign keys, causal columns, transforms, gaps and dates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import RelationalDB, TableSpec, entity_tables, topological_generations
from relspark.functions.rng import u32
from relspark.functions.series import even_dates
from relspark.operators.stats import TRANSFORMS, first_of
from relspark.plans.dag import sample_dag
from relspark.plans.hsbm import assign
from relspark.plans.scm import STRATEGIES, Eager, Scm, propagate
from relspark.storage import checkpointed

SCHEMA_LAYOUTS = ("BarabasiAlbert", "ReverseRandomTree", "WattsStrogatz")


@dataclass(frozen=True)
class DatabaseConfig:
    """Ranges, ends included, from which a database is drawn."""

    tables: tuple[int, int] = (3, 20)
    columns: tuple[int, int] = (3, 40)
    entity_rows: tuple[int, int] = (500, 1000)
    activity_rows: tuple[int, int] = (2000, 5000)
    null_share: tuple[float, float] = (0.01, 0.1)
    start: str = "1990-01-01 00:00:00"
    end: str = "2025-01-01 00:00:00"
    transforms: tuple[str, ...] = ("identity", "rank_uniform", "log", "sqrt", "standardize")


@dataclass(frozen=True)
class TablePlan:
    name: str
    n_rows: int
    is_activity: bool
    parents: tuple[str, ...]
    columns: dict[str, int]
    labels: dict[str, tuple[str, ...]]
    seed: int


def plan_schema(config: DatabaseConfig, seed: int) -> dict[str, TablePlan]:
    """A random schema: tables that nothing refers to are activities; column counts follow a power law."""
    r = np.random.default_rng(seed)
    n = int(r.integers(config.tables[0], config.tables[1] + 1))
    dag = sample_dag(n, str(r.choice(SCHEMA_LAYOUTS)), seed)
    sizes = np.arange(config.columns[0], config.columns[1] + 1)
    share = 1.0 / sizes
    out = {}
    for v in range(n):
        activity = not any(a == v for a, _ in dag.edges)
        low, high = config.activity_rows if activity else config.entity_rows
        count = int(r.choice(sizes, p=share / share.sum()))
        columns = {f"feature_{j}": int(r.choice([0, int(r.integers(2, 11))])) for j in range(count)}
        out[f"table_{v}"] = TablePlan(f"table_{v}", int(r.integers(low, high + 1)), activity, tuple(f"table_{p}" for p in dag.parents(v)), columns, {}, seed * 1009 + v)
    return out


def plan_from_ddl(tables: dict, config: DatabaseConfig, seed: int) -> dict[str, TablePlan]:
    """The tables of ``sources.ddl.parse_ddl`` with drawn row counts; enums keep their labels."""
    r = np.random.default_rng(seed)
    specs = {n: t.spec() for n, t in tables.items()}
    entities = entity_tables(specs)
    out = {}
    for k, (n, t) in enumerate(tables.items()):
        low, high = config.entity_rows if n in entities else config.activity_rows
        columns = {c.name: len(c.categories or ()) for c in t.columns if c.kind != "key"}
        labels = {c.name: tuple(map(str, c.categories)) for c in t.columns if c.categories and c.categories != [0, 1]}
        out[n] = TablePlan(n, int(r.integers(low, high + 1)), n not in entities, tuple(sorted(set(specs[n].fkeys.values()))), columns, labels, seed * 1009 + k)
    return out


def _finished(df: DataFrame, plan: TablePlan, config: DatabaseConfig) -> DataFrame:
    """Transforms, then gaps, then categories, after all tables are there: children saw the plain values."""
    r = np.random.default_rng(plan.seed)
    share = float(r.uniform(*config.null_share))
    for c, k in plan.columns.items():
        if k == 0:
            how = str(r.choice(config.transforms))
            if how != "identity":
                df = TRANSFORMS[how](df, c, "row_idx", "__t").drop(c).withColumnRenamed("__t", c)
            df = first_of(df, F.lit(True), share, [u32(plan.seed, c, F.col("row_idx")), F.col("row_idx")], "__gone")
            df = df.withColumn(c, F.when(~F.col("__gone"), F.col(c))).drop("__gone")
        elif c in plan.labels:
            df = df.withColumn(c, F.element_at(F.array(*map(F.lit, plan.labels[c])), (F.col(c) + 1).cast("int")))
        else:
            df = df.withColumn(c, F.col(c) > 0)
    flags = [c for c, k in plan.columns.items() if k and c not in plan.labels]
    if flags:
        varied = df.agg(*(F.countDistinct(c).alias(c) for c in flags)).first()
        df = df.drop(*(c for c in flags if varied[c] < 2))
    return df


def generate(spark: SparkSession, plans: dict[str, TablePlan], config: DatabaseConfig, rows: dict[str, DataFrame] | None = None) -> RelationalDB:
    """The database of ``plans``: tables in topological order, each one map over its rows after the joins with its parents.

    A row is conditioned on all columns of its parents, each encoded for the child. ``rows``: tables whose ``row_idx`` replace generated places 0..n-1 (n is their count). Equal seeds give
    equal databases under any partitioning.
    """
    specs = {n: TableSpec(n, "row_idx", "date" if p.is_activity else None, {f"{q}_id": q for q in p.parents}) for n, p in plans.items()}
    order = sorted(plans, key=lambda n: (topological_generations(specs)[n], n))
    raw: dict[str, DataFrame] = {}
    strategies: dict[str, Eager] = {}
    size = {n: rows[n].count() if rows and n in rows else p.n_rows for n, p in plans.items()}
    for n in order:
        p, r = plans[n], np.random.default_rng(plans[n].seed + 1)
        df = rows[n].select(F.col("row_idx").cast("long")) if rows and n in rows else spark.range(size[n]).withColumnRenamed("id", "row_idx")
        foreign: list[str] = []
        kinds: list[list[int]] = []
        for q in p.parents:
            depth = int(r.integers(1, 4))
            child_levels, parent_levels = r.integers(1, 4, depth).tolist(), r.integers(1, 4, depth).tolist()
            df = assign(df, "row_idx", size[n], size[q], child_levels, parent_levels, int(r.integers(1 << 31)), f"{q}_id")
            take = list(plans[q].columns)
            names = [f"__{q}_{c}" for c in take]
            # codes that were cut from numbers come as numbers, codes of categories as these
            kinds.append([plans[q].columns[c] if strategies[q].codes else 0 for c in take])
            up = raw[q].select(F.col("row_idx").alias(f"{q}_id"), *(F.col(c).cast("double").alias(x) for c, x in zip(take, names, strict=True)))
            df = df.join(up, f"{q}_id")
            foreign += names
        strategy = strategies[n] = STRATEGIES[str(r.choice(sorted(STRATEGIES)))]
        scm = Scm.sample(strategy.modelled(p.columns), p.seed, [k for k in kinds if k])
        made = propagate(df, "row_idx", size[n], scm, foreign).drop(*foreign)
        made = strategy.finished(made, "row_idx", size[n], p.columns, p.seed)
        if p.is_activity:
            made = made.withColumn("date", even_dates(F.col("row_idx").cast("double"), size[n], config.start, config.end))
        raw[n] = checkpointed(made)
    return RelationalDB({n: _finished(raw[n], plans[n], config) for n in order}, {n: specs[n] for n in order})


def make_database(spark: SparkSession, seed: int, config: DatabaseConfig | None = None, ddl: str | None = None) -> RelationalDB:
    """A database drawn from ``seed``; ``ddl`` fixes its schema."""
    config = config or DatabaseConfig()
    if ddl is None:
        plans = plan_schema(config, seed)
    else:
        from relspark.sources.ddl import parse_ddl

        plans = plan_from_ddl(parse_ddl(ddl), config, seed)
    return generate(spark, plans, config)
