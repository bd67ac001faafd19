"""Streamed adjacency against the batch one, over a stop and a restart in mid-stream."""

import random
import tempfile

from pyspark.sql import functions as F

from relspark.operators import graph
from relspark.streaming.adjacency import placed_children


def test_places_after_a_restart(spark):
    r = random.Random(8)
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    edges = [(r.choice([1, 1, 1, 2, 3, None]), i, 1_000_000 + 60 * i // 2 + r.randrange(100)) for i in range(120)]
    files = [edges[:40], edges[40:80], [*edges[80:], (None, -1, None)], [(-1, -1, 9_000_000)]]

    def write(k):
        df = spark.createDataFrame(files[k], "p long, c long, s long").select("p", "c", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.parquet(f"{base}/in/{k}")

    def run():
        stream = spark.readStream.schema("p long, c long, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{base}/in")
        made = placed_children(stream, "p", "c", "ts", "5 minutes")
        return made.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()

    write(0)
    run()
    early = spark.read.parquet(f"{base}/out").count()
    for k in (1, 2):
        write(k)
        run()
    write(3)
    run()
    got = {(x.parent_key, x.child_key): x["rank"] for x in spark.read.parquet(f"{base}/out").collect()}
    assert 0 < early < 40
    edge = spark.createDataFrame([("c", c, "p", "p", p, s, None) for p, c, s in edges if p is not None], "child_table string, child_key long, fk_col string, parent_table string, parent_key long, child_ts long, parent_ts long")
    assert got == {(x.parent_key, x.child_key): x["rank"] for x in graph.adjacency(edge).collect()}


def test_many_parents_over_weeks(spark):
    """3000 parents, more than there are groups of state, over ten weeks; a child without a key comes last of its time."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.range(9000).selectExpr("id % 3000 AS p", "IF(id % 5 = 0, NULL, id) AS c", "timestamp_seconds(1000000 + 86400 * (id DIV 3000 * 7 % 70) + 604800 * (id % 10)) AS ts")
    rows.union(spark.sql("SELECT 0L, IF(id = 3, NULL, id), timestamp_seconds(9000000) FROM range(6)")).coalesce(1).write.parquet(f"{base}/in/0")
    stream = spark.readStream.schema("p long, c long, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{base}/in")
    made = placed_children(stream, "p", "c", "ts")
    made.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()
    got = sorted(spark.read.parquet(f"{base}/out").collect(), key=lambda x: (x.parent_key, x["rank"]))
    want = sorted(((x.p, x.ts, x.c is None, x.c or 0) for x in spark.read.parquet(f"{base}/in/0").collect()))
    assert [(x.parent_key, x.child_key is None, x.child_key or 0) for x in got] == [(p, none, c) for p, _, none, c in want]
    assert all(x["rank"] == (0 if i == 0 or got[i - 1].parent_key != x.parent_key else got[i - 1]["rank"] + 1) for i, x in enumerate(got))
