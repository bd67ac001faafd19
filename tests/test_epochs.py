"""Permutations, dense planes, and the data source against plain loops."""

import random
import struct
import tempfile

import pytest
from pyspark.sql import functions as F

from relspark.functions import rng
from relspark.operators import epochs
from relspark.sources.batches import read_batches


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select("id", rng.permuted(F.col("id"), n, 5, "e").alias("p")).orderBy("id").collect()]
    assert sorted(got) == list(range(n)) and got == [rng.permuted_number(i, n, 5, "e") for i in range(n)]
    if n == 1000:
        assert got != [rng.permuted_number(i, n, 6, "e") for i in range(n)]
        assert abs(sum(abs(a - b) for a, b in zip(got, got[1:], strict=False)) / 999 - n / 3) < n / 20


def bf16(x):
    bits = struct.unpack("<I", struct.pack("<f", x))[0]
    bits = (bits + 0x7FFF + (bits >> 16 & 1)) & 0xFFFF0000
    return struct.unpack("<f", struct.pack("<I", bits))[0]


def test_brain_floats(spark):
    r = random.Random(1)
    xs = [0.0, 1.0, -1.0, 255.5, 256.5, 0.99999994, 1.00390625, 3.3e38, 1e-30, *(r.gauss(0, 10.0 ** r.randrange(-6, 7)) for _ in range(300))]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", epochs.rounded_bf16(F.col("x")).alias("y")).orderBy("i").collect()
    assert [x.y for x in got] == [bf16(x) for x in xs]
    assert spark.range(1).select(epochs.rounded_bf16(F.lit(None).cast("double")).alias("y")).first().y is None


def store(spark, items=37, length=5):
    r, rows = random.Random(2), []
    for k in range(items):
        for p in range(r.randrange(1, 8)):
            rows.append((k * 10, p, k * 100 + p, [1, 2][: r.randrange(3)], 3, p, None, r.randrange(4), r.random(), p, None, None, p == 0, False, None))
    schema = "seed_key long, pos int, node long, parents array<long>, table int, col int, class_value long, sem_type int, number double, text long, datetime double, boolean double, is_target boolean, is_task_node boolean, time long"
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"
    dense = epochs.dense_items(spark.createDataFrame(rows, schema), length)
    epochs.write_items(dense, path, per_file=8)
    return path, rows, {x.seed_key: x for x in dense.collect()}


def test_planes_and_batches(spark):
    path, rows, dense = store(spark)
    for key, x in dense.items():
        own = [r for r in rows if r[0] == key and r[1] < 5]
        assert x.n == len(own) and all(len(x[c]) == 5 * (5 if c == "parents" else 1) for c in epochs.PLANES)
        assert x.node == [r[2] for r in own] + [-1] * (5 - len(own)) and x.is_padding == [False] * len(own) + [True] * (5 - len(own))
        assert x.parents[:5] == own[0][3] + [-1] * (5 - len(own[0][3])) and x.time == [epochs.NO_TIME] * 5 and x.number[0] == bf16(own[0][8])
    made = {(x.batch, x["rank"]): x for x in epochs.batches(spark, path, ranks=2, size=4, seed=9, epoch=3).collect()}
    read = {(x.batch, x["rank"]): x for x in read_batches(spark, path, ranks=2, size=4, seed=9, epoch=3).collect()}
    assert made == read and set(made) == {(b, r) for b in range(5) for r in range(2)}
    keys = sorted(dense)
    for (b, rank), x in made.items():
        at = [b * 8 + rank * 4 + i for i in range(4)]
        assert x["items"] == [rng.permuted_number(p % 37, 37, 9, 3) for p in at] and x.true_size == sum(p < 37 for p in at)
        assert x.node == [v for i in x["items"] for v in dense[keys[i]].node]
    assert sorted(i for x in made.values() for i in x["items"][: x.true_size]) == list(range(37))
    one = read_batches(spark, path, ranks=2, size=4, seed=9, epoch=3, rank=1)
    assert {(x.batch, x["rank"]) for x in one.collect()} == {(b, 1) for b in range(5)}
    few = read_batches(spark, path, ranks=2, size=4, seed=9, epoch=3).filter("rank = 0 AND batch >= 3 AND batch < 9")
    assert {(x.batch, x["rank"]) for x in few.collect()} == {(3, 0), (4, 0)}


def test_some_planes_of_a_store_that_was_in_order(spark):
    """A store of ranged items is that of others; ``batches`` gives the planes asked for, and reads no others."""
    path, rows, dense = store(spark)
    again = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"
    names = ["seed_key", "n", *epochs.PLANES]
    items = spark.createDataFrame([tuple(x[c] for c in names) for x in dense.values()], spark.read.parquet(f"{path}/items").select(*names).schema)
    epochs.write_items(items.repartitionByRange(5, "seed_key"), again, per_file=8, ranged=True)
    want = epochs.batches(spark, path, ranks=2, size=4, seed=9, epoch=3).select("batch", "rank", "true_size", "items", "node")
    got = epochs.batches(spark, again, 2, 4, 9, 3, ["node"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 10
    assert "is_padding" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, read_batches(spark, again, ranks=2, size=4, seed=9, epoch=3).collect())) == sorted(map(tuple, read_batches(spark, path, ranks=2, size=4, seed=9, epoch=3).collect()))
