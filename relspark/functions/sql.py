"""The registries as functions of Spark SQL: built-in ones as SQL expressions, a user's own as Arrow aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

#: Aggregations of an array of numbers and transforms of a number, as they read in SQL. Names are those of the registries.
EXPRESSIONS = {
    "agg_sum(xs ARRAY<DOUBLE>)": "aggregate(xs, DOUBLE(0), (a, x) -> a + x)",
    "agg_max(xs ARRAY<DOUBLE>)": "array_max(xs)",
    "agg_product(xs ARRAY<DOUBLE>)": "aggregate(xs, DOUBLE(1), (a, x) -> a * x)",
    "agg_logexp(xs ARRAY<DOUBLE>)": "transform(array(array_max(xs)), top -> top + ln(aggregate(xs, DOUBLE(0), (a, x) -> a + exp(x - top))))[0]",
    "tf_identity(x DOUBLE)": "x",
    "tf_log(x DOUBLE)": "sign(x) * ln(1 + abs(x))",
    "tf_sqrt(x DOUBLE)": "sign(x) * sqrt(abs(x))",
    "tf_sigmoid(x DOUBLE)": "1 / (1 + exp(-x))",
}


def register(spark: SparkSession) -> None:
    """Makes EXPRESSIONS functions of the session: plain expressions, which the optimiser sees through."""
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")


def register_aggregate(spark: SparkSession, name: str, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Makes a user's ``f`` a function of the session from an array of numbers (a group's, by ``collect_list``) to one number.

    ``f(values, starts)`` gets many groups at once, as numpy's ``reduceat`` functions do: their values one after the other, and where each
    group begins; it gives a number a group. An array that is null or has nothing but nulls gives null; other nulls are left out.
    """

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for xs in arrays:
            values = pc.list_flatten(xs)
            there = values.is_valid()
            groups = pc.list_parent_indices(xs).filter(there).to_numpy()
            out = np.zeros(len(xs))
            none = np.ones(len(xs), bool)
            if len(groups):
                starts = np.flatnonzero(np.diff(groups, prepend=-1))
                out[groups[starts]] = f(values.filter(there).cast(pa.float64()).to_numpy(), starts)
                none[groups[starts]] = False
            yield pa.array(out, mask=none)

    spark.udf.register(name, F.arrow_udf(run, "double", ArrowUDFType.SCALAR_ITER))
