"""A data source of training batches: ``spark.read.format("context_batches")`` over a store that ``epochs.write_items`` wrote.

Options: ``path``, ``n`` and ``per_file`` (as ``epochs.about`` gives them), ``ranks``, ``size``, ``seed``, ``epoch``, and ``rank`` to read one rank alone; a filter
on ``rank`` or ``batch`` is pushed into the choice of what is read. A partition is a range of one rank's batches; it works out its
items, and reads just their files and rows. The store is in any file system that Arrow knows by its address.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from relspark.functions.rng import permuted_number
from relspark.operators.epochs import PLANES, about

NAME = "context_batches"
#: Batches of a partition.
RANGE = 16


class Range(InputPartition):
    """Batches of one rank."""

    def __init__(self, rank: int, batches: list[int]):
        self.rank, self.batches = rank, batches


class ContextBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "batch long, rank int, true_size int, items array<long>, " + ", ".join(f"{c} array<{kind}>" for c, (kind, _) in PLANES.items())

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return Reader({k.lower(): v for k, v in self.options.items()})


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        number = lambda name, none=None: int(options.get(name, none))
        self.path = re.sub("^file:/+", "/", options["path"])
        self.n, self.per_file = number("n"), number("per_file")
        self.ranks, self.size, self.seed, self.epoch = number("ranks", 1), number("size", 32), number("seed", 0), number("epoch", 0)
        self.per = self.ranks * self.size
        self.ranks_read = [number("rank")] if "rank" in options else list(range(self.ranks))
        self.batches_read = list(range(-(-self.n // self.per)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        tests = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v}
        for f in filters:
            test = tests.get(type(f))
            if test is None or f.attribute not in (("rank",), ("batch",)):
                yield f
            elif f.attribute == ("rank",):
                self.ranks_read = [x for x in self.ranks_read if test(x, f.value)]
            else:
                self.batches_read = [x for x in self.batches_read if test(x, f.value)]

    def partitions(self) -> list[Range]:
        return [Range(r, self.batches_read[i : i + RANGE]) for r in self.ranks_read for i in range(0, len(self.batches_read), RANGE)] or [Range(0, [])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        system, root = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        for batch in part.batches:
            at = [batch * self.per + part.rank * self.size + i for i in range(self.size)]
            items = [permuted_number(p % self.n, self.n, self.seed, self.epoch) for p in at]
            found: dict[int, dict] = {}
            for k in sorted({i // self.per_file for i in items}):
                wanted = sorted({i for i in items if i // self.per_file == k})
                rows = dataset.dataset(f"{root}/items/part={k}", format="parquet", filesystem=system).to_table(columns=["item", *PLANES], filter=dataset.field("item").isin(wanted))
                found |= {i: rows.slice(j, 1) for j, i in enumerate(rows.column("item").to_pylist())}
            kinds = {"long": pa.int64(), "int": pa.int32(), "float": pa.float32(), "boolean": pa.bool_()}
            columns = [pa.array([batch]), pa.array([part.rank], pa.int32()), pa.array([sum(p < self.n for p in at)], pa.int32()), pa.array([items], pa.list_(pa.int64()))]
            for c, (kind, _) in PLANES.items():
                flat = pa.concat_arrays([found[i].column(c).combine_chunks().flatten() for i in items]).cast(kinds[kind])
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(columns, names=["batch", "rank", "true_size", "items", *PLANES])


def read_batches(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The batches of a store by the data source; ``options`` as in the module's text."""
    spark.dataSource.register(ContextBatches)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    n, per_file = about(spark, path)
    return spark.read.format(NAME).options(path=path, n=n, per_file=per_file, **options).load()
