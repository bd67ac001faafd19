"""Databases as tables with keys: specs, row counts, graph order and integrity."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.storage import numbered


@dataclass(frozen=True)
class TableSpec:
    """A table's keys: primary key, time column, and foreign keys to parent tables."""

    name: str
    pkey: str | None = None
    time_col: str | None = None
    fkeys: dict[str, str] = field(default_factory=dict)


class SchemaError(ValueError):
    """A schema that cannot be a database: a cycle, a self reference, an unknown parent."""


def topological_generations(specs: dict[str, TableSpec]) -> dict[str, int]:
    """Each table's generation: 0 without parents, else one more than its latest parent's."""
    for s in specs.values():
        for column, parent in s.fkeys.items():
            if parent == s.name:
                raise SchemaError(f"{s.name}.{column} refers to its own table")
            if parent not in specs:
                raise SchemaError(f"{s.name}.{column} refers to {parent}, which is not a table")
    out: dict[str, int] = {}
    while len(out) < len(specs):
        ready = [n for n, s in specs.items() if n not in out and all(p in out for p in s.fkeys.values())]
        if not ready:
            raise SchemaError("foreign keys form a cycle")
        out |= {n: max((out[p] + 1 for p in specs[n].fkeys.values()), default=0) for n in ready}
    return out


def entity_tables(specs: dict[str, TableSpec]) -> set[str]:
    """The tables that some foreign key refers to; all others are activity tables."""
    return {p for s in specs.values() for p in s.fkeys.values()}


def to_dot(specs: dict[str, TableSpec]) -> str:
    """The schema graph, referenced to referencing table, as DOT text."""
    edges = sorted({(p, s.name) for s in specs.values() for p in s.fkeys.values()})
    return "digraph schema {\n" + "".join(f'  "{n}";\n' for n in sorted(specs)) + "".join(f'  "{a}" -> "{b}";\n' for a, b in edges) + "}\n"


class RelationalDB:
    """Named DataFrames with their specs."""

    def __init__(self, tables: dict[str, DataFrame], specs: dict[str, TableSpec]):
        topological_generations(specs)
        self.tables, self.specs = tables, specs
        self._keyed: dict[str, DataFrame] = {}
        self.spark: SparkSession = next(iter(tables.values())).sparkSession

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    def counts(self) -> DataFrame:
        """``table, table_type, generation, n_rows`` in one pass a table."""
        entities, generation = entity_tables(self.specs), topological_generations(self.specs)
        return self._union(
            [
                self.tables[n].agg(F.count("*").alias("n_rows")).select(
                    F.lit(n).alias("table"), F.lit("entity" if n in entities else "activity").alias("table_type"), F.lit(generation[n]).alias("generation"), "n_rows"
                )
                for n in self.specs
            ]
        )

    def offsets(self) -> dict[str, int]:
        """The first node id of each table, tables in order of name."""
        n = {r.table: r.n_rows for r in self.counts().collect()}  # one row a table
        out, at = {}, 0
        for name in sorted(n):
            out[name], at = at, at + n[name]
        return out

    def keyed(self, name: str) -> DataFrame:
        """The table with ``row_key``: its rows' places in the order of the primary key, or of all columns without one; numbered once."""
        df, spec = self.tables[name], self.specs[name]
        if name not in self._keyed:
            self._keyed[name] = numbered(df, [spec.pkey] if spec.pkey else df.columns, "row_key")
        return self._keyed[name]

    def fkeys(self) -> list[tuple[str, str, str]]:
        """(child, column, parent) of every foreign key."""
        return [(s.name, c, p) for s in self.specs.values() for c, p in s.fkeys.items()]

    def integrity(self) -> DataFrame:
        """``child_table, fk_col, parent_table, n_rows, n_null, n_orphan`` of every foreign key."""
        parts = []
        for child, column, parent in self.fkeys():
            keys = self.tables[parent].select(F.col(self.specs[parent].pkey).alias("p")).distinct()
            met = self.tables[child].groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n")).join(keys, F.col("k") == F.col("p"), "left")
            total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
            parts.append(
                met.agg(total(F.lit(True)).alias("n_rows"), total(F.col("k").isNull()).alias("n_null"), total(F.col("k").isNotNull() & F.col("p").isNull()).alias("n_orphan"))
                .select(F.lit(child).alias("child_table"), F.lit(column).alias("fk_col"), F.lit(parent).alias("parent_table"), "n_rows", "n_null", "n_orphan")
            )
        return self._union(parts)

    def degrees(self) -> DataFrame:
        """``parent_table, parent_key, child_table, fk_col, degree`` of every parent row and foreign key, 0 included."""
        parts = []
        for child, column, parent in self.fkeys():
            per = self.tables[child].filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
            keys = self.tables[parent].select(F.col(self.specs[parent].pkey).alias("p"))
            parts.append(
                keys.join(per, F.col("k") == F.col("p"), "left").select(
                    F.lit(parent).alias("parent_table"), F.col("p").cast("long").alias("parent_key"), F.lit(child).alias("child_table"), F.lit(column).alias("fk_col"), F.coalesce("n", F.lit(0)).cast("long").alias("degree")
                )
            )
        return self._union(parts)

    def key_counts(self, most: int = 5) -> DataFrame:
        """``child_table, n_fkeys, n_edges, valid`` of every table with foreign keys: those whose keys are all in their parents, and whether they are at most ``most``."""
        met = self.integrity().groupBy("child_table").agg(F.count("*").alias("n_fkeys"), F.sum(F.col("n_rows") - F.col("n_null") - F.col("n_orphan")).alias("n_edges"))
        return met.withColumn("valid", F.col("n_fkeys") <= most)

    def valid(self, most: int = 5) -> bool:
        """Whether no table has more than ``most`` foreign keys."""
        return all(len(s.fkeys) <= most for s in self.specs.values())


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp, read as UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


#: The test tables as a database.
SPECS = {
    s.name: s
    for s in (
        TableSpec("region", "r_regionkey"),
        TableSpec("nation", "n_nationkey", None, {"n_regionkey": "region"}),
        TableSpec("customer", "c_custkey", None, {"c_nationkey": "nation"}),
        TableSpec("supplier", "s_suppkey", None, {"s_nationkey": "nation"}),
        TableSpec("part", "p_partkey"),
        TableSpec("orders", "o_orderkey", "o_orderdate", {"o_custkey": "customer"}),
        TableSpec("lineitem", None, "l_shipdate", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
        TableSpec("events", "event_id", "ts", {"user_id": "customer"}),
        TableSpec("documents", "doc_id"),
        TableSpec("labels", None, None, {"doc_id": "documents"}),
    )
}


def open_database(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> RelationalDB:
    """The test tables, or those of ``names``, as a database; foreign keys to tables left out are dropped."""
    chosen = names or list(SPECS)
    specs = {n: TableSpec(n, SPECS[n].pkey, SPECS[n].time_col, {c: p for c, p in SPECS[n].fkeys.items() if p in chosen}) for n in chosen}
    return RelationalDB({n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in chosen}, specs)
