"""The row graph: edges of foreign keys, adjacency in time, the dictionary, and typed cells."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.catalog import RelationalDB, epoch_seconds
from relspark.operators.stats import numeric
from relspark.storage import numbered, numbered_within

#: Ordinals of the semantic types of cells.
NUMBER, TEXT, DATETIME, BOOLEAN = range(4)


def is_key(db: RelationalDB, child: str, column: str) -> bool:
    """Whether a foreign key is one: a column of times is none."""
    return not isinstance(db.tables[child].schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def edges(db: RelationalDB, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """``child_table, child_key, fk_col, parent_table, parent_key, child_ts, parent_ts`` of every non-null key that has its parent.

    ``child_key`` is the primary key, or the row key of a table without one, which is numbered once for all its
    foreign keys. A key column that holds times is none and is left out; ``pairs`` of (child, column) leave out all others.
    """
    parts, keyed = [], {}
    for child, column, parent in db.fkeys():
        if pairs is not None and (child, column) not in pairs or not is_key(db, child, column):
            continue
        cs, ps = db.specs[child], db.specs[parent]
        if not cs.pkey and child not in keyed:
            keyed[child] = db.keyed(child)
        rows = db.tables[child] if cs.pkey else keyed[child]
        ts = lambda s: epoch_seconds(F.col(s.time_col)) if s.time_col else F.lit(None).cast("long")
        left = rows.filter(F.col(column).isNotNull()).select(F.col(cs.pkey or "row_key").cast("long").alias("child_key"), F.col(column).cast("long").alias("k"), ts(cs).alias("child_ts"))
        right = db.tables[parent].select(F.col(ps.pkey).cast("long").alias("parent_key"), ts(ps).alias("parent_ts"))
        parts.append(
            left.join(right, F.col("k") == F.col("parent_key")).select(F.lit(child).alias("child_table"), "child_key", F.lit(column).alias("fk_col"), F.lit(parent).alias("parent_table"), "parent_key", "child_ts", "parent_ts")
        )
    return reduce(DataFrame.unionByName, parts)


def adjacency(edge: DataFrame) -> DataFrame:
    """``edges`` with ``rank``: the child's place from 0 among its parent's children, in time order, children without time first.

    Hub parents are sorted by many tasks (see ``numbered_within``).
    """
    groups = ["parent_table", "parent_key", "child_table", "fk_col"]
    return numbered_within(edge, groups, [F.col("child_ts").asc_nulls_first(), F.col("child_key")], "rank")


def dictionary(tables: dict[str, DataFrame]) -> DataFrame:
    """``id, kind, text``: every table name, "column of table" name and distinct string value, numbered in order of kind and text."""
    parts = []
    for name, df in tables.items():
        spark = df.sparkSession
        parts.append(spark.createDataFrame([("table", name), *(("column", f"{c} of {name}") for c in df.columns)], "kind string, text string"))
        strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        if strings:
            parts.append(df.select(F.explode(F.array(*strings)).alias("text")).filter(F.col("text").isNotNull()).distinct().select(F.lit("value").alias("kind"), "text"))
    return numbered(reduce(DataFrame.unionByName, parts).distinct(), ["kind", "text"], "id").select("id", "kind", "text")


def cells(df: DataFrame, table: str, key: str, drop: set[str]) -> DataFrame:
    """``node_key, column, sem_type, num, txt``: a row for every value that is neither null nor NaN, all columns but ``drop``.

    Numbers, booleans (0 or 1) and times (epoch seconds) are in ``num``, strings in ``txt``. One explode of an array of structs.
    """

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            kind, num, txt = TEXT, F.lit(None).cast("double"), c
        elif isinstance(f.dataType, T.BooleanType):
            kind, num, txt = BOOLEAN, c.cast("int").cast("double"), F.lit(None).cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kind, num, txt = DATETIME, epoch_seconds(c).cast("double"), F.lit(None).cast("string")
        elif isinstance(f.dataType, T.NumericType):
            kind, num, txt = NUMBER, numeric(c), F.lit(None).cast("string")
        else:
            raise TypeError(f"{table}.{f.name}: {f.dataType.simpleString()} is no cell type")
        return F.struct(F.lit(f"{f.name} of {table}").alias("column"), F.lit(kind).alias("sem_type"), num.alias("num"), txt.alias("txt"))

    each = [cell(f) for f in df.schema if f.name not in drop]
    flat = df.select(F.col(key).cast("long").alias("node_key"), F.explode(F.array(*each)).alias("x")).select("node_key", "x.*")
    return flat.filter(F.col("num").isNotNull() | F.col("txt").isNotNull())


def table_cells(db: RelationalDB, name: str) -> DataFrame:
    """The cells of a table: features only, as keys are edges and not cells. A table without a primary key goes by its rows' numbers."""
    spec = db.specs[name]
    if spec.pkey:
        return cells(db.tables[name], name, spec.pkey, {spec.pkey, *spec.fkeys})
    return cells(db.keyed(name), name, "row_key", {"row_key", *spec.fkeys})


def database_cells(db: RelationalDB) -> DataFrame:
    """The cells of all tables, with ``table``."""
    return reduce(DataFrame.unionByName, [table_cells(db, n).withColumn("table", F.lit(n)) for n in db.specs])


def cells_by_node(db: RelationalDB, name: str) -> DataFrame:
    """``table_cells`` with ``table``, dealt out and sorted by node: rows are, before they become cells."""
    spec = db.specs[name]
    key = spec.pkey or "row_key"
    rows = db.tables[name] if spec.pkey else db.keyed(name)
    rows = rows.repartitionByRange(key).sortWithinPartitions(key)
    return cells(rows, name, key, {key, *spec.fkeys}).withColumn("table", F.lit(name))


def node_records(cell: DataFrame, edge: DataFrame) -> DataFrame:
    """``table, node_key, cells, parents``: each row's cells in order of column, and its parents in order of foreign key.

    ``cell`` is as ``database_cells`` gives it, ``edge`` as ``edges``. Both arrays are as long as a row is wide at most.
    """
    each = cell.groupBy("table", "node_key").agg(F.array_sort(F.collect_list(F.struct("column", "sem_type", "num", "txt"))).alias("cells"))
    up = edge.groupBy(F.col("child_table").alias("table"), F.col("child_key").alias("node_key")).agg(F.array_sort(F.collect_list(F.struct("fk_col", "parent_table", "parent_key"))).alias("parents"))
    return each.join(up, ["table", "node_key"], "full").withColumn("parents", F.coalesce("parents", F.array().cast(up.schema["parents"].dataType))).withColumn("cells", F.coalesce("cells", F.array().cast(each.schema["cells"].dataType)))


def class_ids(cell: DataFrame, words: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Text cells with the dictionary id of their value, and the columns ``also`` of its entry."""
    values = words.filter("kind = 'value'").select(F.col("id").alias("class_id"), F.col("text").alias("v"), *also)
    return cell.filter(F.col("sem_type") == TEXT).join(values, F.col("txt") == F.col("v")).drop("v")
