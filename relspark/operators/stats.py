"""Column statistics, normalisation, and column transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.catalog import RelationalDB, epoch_seconds
from relspark.storage import numbered


def numeric(c: str | Column) -> Column:
    """A number as double; NaN becomes null, as both mean that there is no value."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, mean, std`` of number columns: without values the mean is 0; a missing or zero sample deviation is 1."""
    one = df.agg(*(f(numeric(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    rows = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"m{i}"), F.lit(0.0)).alias("mean"), F.coalesce(F.when(F.col(f"s{i}") != 0, F.col(f"s{i}")), F.lit(1.0)).alias("std")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def boolean_stats(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``column, mean, std`` of booleans as 0 and 1; a missing deviation is 0."""
    one = df.agg(*(f(b.cast("double")).alias(f"{k}{i}") for i, b in enumerate(columns.values()) for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    rows = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"m{i}"), F.lit(0.0)).alias("mean"), F.coalesce(F.col(f"s{i}"), F.lit(0.0)).alias("std")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def time_stats(db: RelationalDB) -> DataFrame:
    """One row ``n, mean, std`` over the epoch seconds of every time column of every table; the deviation is the population's."""
    parts = [db.tables[n].select(epoch_seconds(F.col(s.time_col)).alias("t")) for n, s in db.specs.items() if s.time_col]
    return reduce(DataFrame.unionByName, parts).agg(F.count("t").alias("n"), F.avg("t").alias("mean"), F.stddev_pop("t").alias("std"))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std, and 0 where the deviation is 0."""
    return F.when(x.isNotNull(), F.coalesce(F.try_divide(x - mean, std), F.lit(0.0)))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_sqrt(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def rank_uniform(df: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """``df`` with ``name``: (distinct rank from 1) / (n + 1); ties in order of ``key``, nulls without rank."""
    some = numbered(df.filter(F.col(column).isNotNull()), [column, key], name)
    n = some.agg(F.count("*").alias("__n"))
    ranked = some.crossJoin(F.broadcast(n)).withColumn(name, (F.col(name) + 1) / (F.col("__n") + 1)).drop("__n")  # one row
    return ranked.unionByName(df.filter(F.col(column).isNull()).withColumn(name, F.lit(None).cast("double")))


def standardized(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``: (x - mean) / max(population deviation, 1e-8)."""
    one = df.agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    return df.crossJoin(F.broadcast(one)).withColumn(name, (F.col(column) - F.col("__m")) / F.greatest("__s", F.lit(1e-8))).drop("__m", "__s")  # one row


#: Column transforms by name: each gives the DataFrame with one more column.
TRANSFORMS = {
    "identity": lambda df, c, key, name: df.withColumn(name, F.col(c)),
    "rank_uniform": rank_uniform,
    "log": lambda df, c, key, name: df.withColumn(name, signed_log(F.col(c))),
    "sqrt": lambda df, c, key, name: df.withColumn(name, signed_sqrt(F.col(c))),
    "standardize": lambda df, c, key, name: standardized(df, c, name),
}


def transformed(df: DataFrame, column: str, key: str, how: str, name: str) -> DataFrame:
    if how not in TRANSFORMS:
        raise ValueError(f"no transform named {how}")
    return TRANSFORMS[how](df, column, key, name)


def first_of(df: DataFrame, mark: Column, share: float, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: whether the row is among the first floor(share n) in ``order`` of the rows that ``mark`` holds for."""
    if not 0 <= share <= 1:
        raise ValueError("a share is from 0 to 1")
    rows = numbered(df.withColumn("__mark", mark), [F.col("__mark").desc(), *order], "__rn")
    n = rows.agg(F.floor(F.lit(share) * F.count(F.when(F.col("__mark"), 1)) + 1e-9).alias("__k"))
    return rows.crossJoin(F.broadcast(n)).withColumn(name, F.col("__mark") & (F.col("__rn") < F.col("__k"))).drop("__mark", "__rn", "__k")  # one row


def binarized(df: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """``df`` with ``name``: whether the value is that of the first row, in order of ``key``, that has one."""
    first = df.agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col(key))).alias("__first"))
    return df.crossJoin(F.broadcast(first)).withColumn(name, F.col(column) == F.col("__first")).drop("__first")  # one row


def quantized(x: Column, bounds: list[float], permutation: list[int] | None = None, reverse: bool = False) -> Column:
    """The number of ``bounds`` that ``x`` exceeds, then looked up in ``permutation`` or counted from the other end."""
    k = sum((F.when(x > b, 1).otherwise(0) for b in bounds), F.lit(0))
    if permutation is not None:
        k = F.element_at(F.array(*map(F.lit, permutation)), k + 1)
    return F.lit(len(bounds)) - k if reverse else k


def category_booleans(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with each coded column as ``code > 0``; columns of a single value are dropped."""
    kinds = df.agg(*((F.min(c) != F.max(c)).alias(f"k{i}") for i, c in enumerate(columns))).first()
    for i, c in enumerate(columns):
        df = df.withColumn(c, F.col(c) > 0) if kinds[f"k{i}"] else df.drop(c)
    return df


def denormalised(z: Column, mean: Column, std: Column) -> Column:
    """The value that ``z_score`` made ``z`` of."""
    return z * std + mean


def booleans(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` as booleans: 0 is false, any other number true, null stays."""
    return df.withColumns({c: F.col(c).cast("boolean") for c in columns})


def first_element(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``: the first element of a list, null for null and empty ones."""
    return df.withColumn(name, F.get(column, F.lit(0)))
