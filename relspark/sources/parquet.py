"""Databases as folders of Parquet: tables with key metadata, task splits, and what the row graph writes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import RelationalDB, TableSpec
from relspark.operators import graph
from relspark.storage import without_leftovers

SPLITS = ("train", "val", "test")


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match ``pattern``, in order, by the session's file systems."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def _stem(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].removesuffix(".parquet")


def hyphen_rule(base: str, extra: int = 2, but: str = "rating-") -> Callable[[str], bool]:
    """A test of paths: one with exactly ``extra`` more hyphens than ``base`` is left out, unless its name begins with ``but``."""
    return lambda path: path.count("-") != base.count("-") + extra or path.rpartition("/")[2].startswith(but)


@dataclass(frozen=True)
class TableRules:
    """What to change in a table as it is read: columns to drop, and columns to read as booleans by a cast, or as whether they equal the first row's value."""

    drop: tuple[str, ...] = ()
    as_boolean: tuple[str, ...] = ()
    is_first: tuple[str, ...] = ()


def with_rules(db: RelationalDB, rules: dict[str, TableRules]) -> RelationalDB:
    """``db`` with ``rules`` by table applied; a rule for a table or column that isn't there does nothing."""
    tables = dict(db.tables)
    for name, rule in rules.items():
        if name in tables:
            df = tables[name].drop(*rule.drop)
            for c in set(rule.as_boolean) & set(df.columns):
                df = df.withColumn(c, F.col(c).cast("boolean"))
            for c in set(rule.is_first) & set(df.columns):
                key = db.specs[name].pkey
                first = df.agg(F.min_by(F.col(c).cast("string"), key).alias("v")).first()["v"]
                df = df.withColumn(c, F.col(c).cast("string") == F.lit(first))
            tables[name] = df
    specs = {n: TableSpec(s.name, s.pkey, s.time_col, {c: p for c, p in s.fkeys.items() if c in tables[n].columns}) for n, s in db.specs.items()}
    return RelationalDB(tables, specs)


def write_database(db: RelationalDB, path: str, mode: str = "errorifexists") -> None:
    """Tables under ``db/`` and their keys in ``catalog``, one JSON row a table."""
    for name, df in db.tables.items():
        df.write.mode(mode).parquet(f"{path}/db/{name}.parquet")
    rows = [(s.name, json.dumps({"pkey_col": s.pkey, "time_col": s.time_col, "fkey_col_to_pkey_table": s.fkeys})) for s in db.specs.values()]
    db.spark.createDataFrame(rows, "name string, keys string").coalesce(1).write.mode(mode).parquet(f"{path}/catalog.parquet")


def read_database(spark: SparkSession, path: str, keep: Callable[[str], bool] = lambda name: True, targets: dict[tuple[str, str], str] | None = None) -> RelationalDB:
    """A database: the tables under ``db/``, with the keys in ``catalog`` or, without that, in the files' own footers.

    ``keep`` leaves tables out, with the foreign keys to them; ``targets`` names another parent for some (table, column).
    """
    if _paths(spark, f"{path}/catalog.parquet"):
        keys = {r.name: json.loads(r["keys"]) for r in spark.read.parquet(f"{path}/catalog.parquet").collect() if keep(r.name)}
        found = [TableSpec(n, k["pkey_col"], k["time_col"], k["fkey_col_to_pkey_table"]) for n, k in keys.items()]
    else:
        found = [footer_keys(spark, p) for p in _paths(spark, f"{path}/db/*.parquet") if keep(_stem(p))]
    names, other = {s.name for s in found}, targets or {}
    specs = {s.name: TableSpec(s.name, s.pkey, s.time_col, {c: t for c, p in s.fkeys.items() if (t := other.get((s.name, c), p)) in names}) for s in found}
    return RelationalDB({n: spark.read.parquet(f"{path}/db/{n}.parquet") for n in specs}, specs)


def footer_keys(spark: SparkSession, path: str) -> TableSpec:
    """The keys that a Parquet file's own footer names (``pkey_col``, ``time_col``, ``fkey_col_to_pkey_table``, each JSON).

    The file, or the first of a folder, may be in any store that the session can read; only its footer is.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path((_paths(spark, f"{path}/*.parquet") or [path])[0])
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
    try:
        meta = dict(reader.getFooter().getFileMetaData().getKeyValueMetaData())
    finally:
        reader.close()
    get = lambda k, none: json.loads(meta[k]) if k in meta else none
    return TableSpec(_stem(path), get("pkey_col", None), get("time_col", None), get("fkey_col_to_pkey_table", None) or {})


def read_task(spark: SparkSession, path: str, task: str, keep: Callable[[str], bool] = lambda path: True) -> DataFrame:
    """A task's splits as one table with ``split``; a file of another name is an error. ``keep`` tests paths, see ``hyphen_rule``."""
    found = [p for p in _paths(spark, f"{path}/tasks/{task}/*.parquet") if keep(p)]
    if odd := [p for p in found if _stem(p) not in SPLITS]:
        raise ValueError(f"{odd[0]} is no split")
    if not found:
        raise ValueError(f"no task {task}")
    out = None
    for p in found:
        df = spark.read.parquet(p).withColumn("split", F.lit(_stem(p)))
        out = df if out is None else out.unionByName(df)
    return out


def write_task(df: DataFrame, path: str, task: str, split_col: str = "split") -> None:
    for s in SPLITS:
        df.filter(F.col(split_col) == s).drop(split_col).write.parquet(f"{path}/tasks/{task}/{s}.parquet")


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, dictionary: DataFrame, catalog: DataFrame) -> None:
    """The row graph: cells by node, edges by parent and time, the dictionary and the table list; each range-partitioned on its lookup key."""
    by = [c for c in ("table", "node_key") if c in nodes.columns]
    _append(nodes.repartitionByRange(*by).sortWithinPartitions(*by), f"{path}/nodes.parquet")
    _append(edges.repartitionByRange("parent_table", "parent_key").sortWithinPartitions("parent_table", "parent_key", F.col("child_ts").asc_nulls_first()), f"{path}/edges.parquet")
    _write_lists(path, dictionary, catalog)


def write_database_graph(path: str, db: RelationalDB, dictionary: DataFrame) -> None:
    """A database's row graph, as ``write_graph`` has it: a table's cells and a foreign key's edges at a time, so that one of these is on the move at once.

    Files of nodes hold rows of one table, and files of edges those of one foreign key.
    """
    for name in db.specs:
        _append(graph.cells_by_node(db, name), f"{path}/nodes.parquet")
    for child, column, parent in db.fkeys():
        if graph.is_key(db, child, column):
            # names, the same in all rows, stay out of the shuffle
            own = graph.edges(db, [(child, column)]).select("child_key", "parent_key", "child_ts", "parent_ts")
            own = own.repartitionByRange("parent_key").sortWithinPartitions("parent_key", F.col("child_ts").asc_nulls_first())
            _append(own.select(F.lit(child).alias("child_table"), "child_key", F.lit(column).alias("fk_col"), F.lit(parent).alias("parent_table"), "parent_key", "child_ts", "parent_ts"), f"{path}/edges.parquet")
    _write_lists(path, dictionary, db.counts())


def _append(df: DataFrame, path: str) -> None:
    with without_leftovers(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").parquet(path)


def _write_lists(path: str, dictionary: DataFrame, catalog: DataFrame) -> None:
    dictionary.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/dictionary.parquet")
    catalog.coalesce(1).write.parquet(f"{path}/tables.parquet")


def write_embeddings(vectors: DataFrame, path: str, key: str = "id", vector: str = "embedding") -> None:
    """Vectors of dictionary entries, in order of their ids, as files of id and vector; one id twice is an error of the caller's."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("embedding"))
    rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/embeddings.parquet")


def embedded(cells: DataFrame, spark: SparkSession, path: str, key: str = "class_id") -> DataFrame:
    """Cells with the vector of their dictionary id; null where there is none."""
    stored = spark.read.parquet(f"{path}/embeddings.parquet").withColumnRenamed("id", key)
    return cells.join(stored, key, "left")


def write_predictions(preds: DataFrame, path: str, task: str, split: str = "test") -> None:
    """Predictions of a task's split, one file each split and task; what was there is replaced."""
    preds.write.mode("overwrite").parquet(f"{path}/predictions/{task}/{split}.parquet")


def read_predictions(spark: SparkSession, path: str, task: str, split: str = "test") -> DataFrame:
    return spark.read.parquet(f"{path}/predictions/{task}/{split}.parquet")


def column_id(dictionary: DataFrame, column: str, table: str) -> int:
    """The dictionary id of a column; an unknown one is an error."""
    row = dictionary.filter((F.col("kind") == "column") & (F.col("text") == f"{column} of {table}")).first()
    if row is None:
        raise ValueError(f"no column {column} of {table}")
    return row["id"]


def write_leaderboard(df: DataFrame, path: str) -> None:
    """A few rows of metrics as one CSV file with a header."""
    df.coalesce(1).write.csv(path, header=True)
