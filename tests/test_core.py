import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.catalog import RelationalDB, TableSpec, open_database
from relspark.functions import rng, series
from relspark.operators import graph, metrics, sampler, stats, tasks
from relspark import queries, storage
from relspark.sources import parquet
from relspark.storage import numbered, numbered_within

SF = "/root/testdata/sf0.001"


def small_db(spark):
    a = spark.createDataFrame([(10, "x", 1.0), (20, "y", float("nan")), (30, None, None)], "k long, s string, v double")
    b = spark.createDataFrame([(1, 10, "2020-01-01", True), (2, 10, None, False), (3, None, "2020-01-03", None), (4, 99, "2020-01-02", True), (5, 20, "2020-01-02", True)], "id long, a_k long, t string, f boolean")
    b = b.withColumn("t", F.col("t").cast("timestamp"))
    return RelationalDB({"a": a, "b": b}, {"a": TableSpec("a", "k"), "b": TableSpec("b", "id", "t", {"a_k": "a"})})


def test_nulls_orphans_and_unaligned_keys(spark):
    db = small_db(spark)
    r = db.integrity().first()
    assert (r.n_rows, r.n_null, r.n_orphan) == (5, 1, 1)
    got = {(e.child_key, e.parent_key, e.child_ts is None) for e in graph.edges(db).collect()}
    assert got == {(1, 10, False), (2, 10, True), (5, 20, False)}
    ranks = {e.child_key: e["rank"] for e in graph.adjacency(graph.edges(db)).collect()}
    assert ranks == {2: 0, 1: 1, 5: 0}
    cells = {(c.node_key, c.column) for c in graph.table_cells(db, "a").collect()}
    assert cells == {(10, "s of a"), (10, "v of a"), (20, "s of a")}
    assert {(d.parent_key, d.degree) for d in db.degrees().collect()} == {(10, 2), (20, 1), (30, 0)}
    assert db.offsets() == {"a": 0, "b": 3} and db.valid()


def test_stats_of_degenerate_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0, True), (float("nan"), None, 5.0, True)], "a double, b double, c double, f boolean")
    got = {r.column: (r["mean"], r["std"]) for r in stats.numeric_stats(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (1.0, 1.0), "b": (0.0, 1.0), "c": (5.0, 1.0)}
    flag = stats.boolean_stats(df, {"f": F.col("f")}).first()
    assert (flag["mean"], flag["std"]) == (1.0, 0.0)
    z = df.select(stats.z_score(F.col("c"), F.lit(5.0), F.lit(0.0)).alias("z")).first()
    assert z.z == 0.0


@pytest.mark.parametrize("how", sorted(stats.TRANSFORMS))
def test_transforms_stay_finite(spark, how):
    for values in ([0.0] * 5, [1e6] * 5, [-1e6] * 5, np.linspace(-1e4, 1e4, 50).tolist(), [None, 1.0, None]):
        df = spark.createDataFrame(list(enumerate(values)), "k long, x double")
        got = [r.y for r in stats.transformed(df, "x", "k", how, "y").collect()]
        assert len(got) == len(values) and all(np.isfinite(v) for v in got if v is not None) and got.count(None) == values.count(None)
    with pytest.raises(ValueError):
        stats.transformed(df, "x", "k", "cube", "y")


def test_row_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), rng.u32(1, F.col("id")).alias("r"))
    want = {r.id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.r, r.id)))}
    for parts in (1, 7):
        assert {r.id: r.rn for r in numbered(df.repartition(parts), ["r", "id"]).collect()} == want
    within = numbered_within(df, ["g"], ["r", "id"]).collect()
    assert all(sorted(r.rn for r in within if r.g == g) == list(range(n)) for g, n in ((0, 334), (1, 333), (2, 333)))


def test_ar1_is_the_recurrence(spark):
    e = np.random.default_rng(0).normal(size=500)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(e)], "i long, e double")
    for rho in (0.0, 0.5, 0.9, 0.999):
        s, want = 0.0, []
        for x in e:
            s = rho * s + x
            want.append(s)
        for block in (7, 64, 4096):
            got = [r.ar for r in series.ar1(df, "i", "e", rho, block=block).orderBy("i").collect()]
            assert np.allclose(got, want)
    with pytest.raises(ValueError):
        series.ar1(df, "i", "e", 1.0)


def test_no_context_sees_the_future_and_physical_order_is_nothing(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    e = o.select((F.col("o_orderkey") + 1000).alias("child_key"), F.col("o_custkey").alias("parent_key"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("child_ts"))
    ts = {r.child_key: r.child_ts for r in e.collect()}
    out = []
    for edges in (e, e.orderBy(F.desc("child_ts")).repartition(5)):
        seeds = edges.select(F.col("child_key").alias("seed_key"), F.col("child_ts").alias("seed_ts"), F.col("child_key").alias("node"))
        out.append({tuple(r) for r in sampler.expand(seeds, edges, 2, 3).collect()})
        assert all(r[3] or ts[r[1]] <= ts[r[0]] for r in out[-1])
    assert out[0] == out[1]


def test_seeds_without_time_see_children_without_time(spark):
    edges = spark.createDataFrame([(1, 9, 5), (2, 9, None), (3, 9, 7)], "child_key long, parent_key long, child_ts long")
    at = spark.createDataFrame([(50, None, 9), (60, 6, 9)], "seed_key long, seed_ts long, node long")
    got = {(r.seed_key, r.child_key) for r in sampler.capped_children(at, edges, 9).collect()}
    assert got == {(50, 2), (60, 1), (60, 2)}


def test_batches_wrap_and_padding(spark):
    got = sampler.batches(spark.range(10), ["id"], ranks=2, size=3).collect()
    assert sorted((r.batch, r["rank"], r["slot"]) for r in got) == [(b, k, s) for b in range(2) for k in range(2) for s in range(3)]
    assert sampler.batches(spark.range(0), ["id"], 2, 3).collect() == []
    seq = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "seq long, pos int, v string")
    assert {r.seq: (r.n, r.v) for r in sampler.padded(seq, "seq", "pos", 3, ["v"]).collect()} == {1: (2, ["a", "b", None]), 2: (1, ["c", None, None])}


def test_metrics_against_brute_force(spark):
    r = np.random.default_rng(2)
    y, s = r.random(300) > 0.6, r.integers(0, 20, 300)
    df = spark.createDataFrame([(bool(a), int(b)) for a, b in zip(y, s, strict=True)], "y boolean, s long")
    p, n = s[y][:, None], s[~y][None, :]
    assert abs(metrics.auc(df, F.col("y"), "s").first().auc - ((p > n).mean() + (p == n).mean() / 2)) < 1e-12
    assert metrics.auc(df.filter("y"), F.col("y"), "s").first().auc is None
    assert metrics.r2(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, p double"), "y", "p").first().r2 is None


def test_power_law_and_choices(spark):
    u = spark.range(4000).select(rng.unit("a", F.col("id")).alias("u"))
    got = [r.k for r in u.select(rng.power_law(F.col("u"), 3, 40, 1.0).alias("k")).collect()]
    assert min(got) == 3 and max(got) == 40 and got.count(3) > 2 * got.count(9)
    with pytest.raises(ValueError):
        rng.power_law(F.col("u"), 0, 3, 1.0)


def test_databases_and_tasks_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    db = small_db(spark)
    parquet.write_database(db, f"{folder}/x")
    back = parquet.read_database(spark, f"{folder}/x")
    assert back.specs == db.specs and sorted(map(str, back.tables["b"].collect())) == sorted(map(str, db.tables["b"].collect()))
    assert parquet.read_database(spark, f"{folder}/x", keep=lambda n: n != "a").specs["b"].fkeys == {}
    task = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "id long, split string")
    parquet.write_task(task, f"{folder}/x", "churn")
    assert sorted(tuple(r) for r in parquet.read_task(spark, f"{folder}/x", "churn").select("id", "split").collect()) == sorted(tuple(r) for r in task.collect())
    with pytest.raises(ValueError):
        parquet.read_task(spark, f"{folder}/x", "none")
    words = graph.dictionary({"a": db.tables["a"]})
    parquet.write_graph(f"{folder}/g", graph.table_cells(db, "a"), graph.edges(db), words, db.counts())
    assert parquet.column_id(words, "s", "a") >= 0 and spark.read.parquet(f"{folder}/g/edges.parquet").count() == 3
    with pytest.raises(ValueError):
        parquet.column_id(words, "nope", "a")


def test_open_database_counts(spark):
    db = open_database(spark, SF, ["orders", "customer"])
    assert {r.table: r.generation for r in db.counts().collect()} == {"customer": 0, "orders": 1}


def test_task_lists(spark):
    df = spark.createDataFrame([(1, 1.0, True, "x", 2)], "id long, feature_a double, feature_b boolean, feature_c string, feature_d int")
    all_tasks = tasks.feature_tasks("d1", "t", df) + tasks.feature_tasks("d2", "t", df)
    assert [(t.target, t.kind) for t in all_tasks[:3]] == [("feature_a", "regression"), ("feature_b", "classification"), ("feature_c", "classification")]
    assert {t.db for t in tasks.leave_out(all_tasks, "d1")} == {"d2"}
    assert len(tasks.limited(all_tasks, 2)) == 4 and tasks.limited(all_tasks, 2) == tasks.limited(all_tasks[::-1], 2)
    assert tasks.first_valid(["b", "a", "c"], [True, False, True], 2) == ["b", "c"]
    with pytest.raises(ValueError):
        tasks.first_valid(["a"], [False], 1)
    assert tasks.is_synthetic("my-synthetic-1") and tasks.is_synthetic("gen_3", "gen_") and not tasks.is_synthetic("shop", "gen_")
    assert tasks.cut_times("2020-01-01", "2020-01-10") == ("2020-01-09", "2020-01-10")
    nodes = spark.createDataFrame([(1, "db"), (2, "train")], "node long, split string")
    assert [r.node for r in tasks.without_database_rows(nodes).collect()] == [2]


def test_a_hub_of_many_children_and_seeds(spark):
    """100,000 children of one parent, each of them a seed: a hop makes width rows a seed, spread over what a seed can see."""
    edges = spark.range(100_000).select(F.col("id").alias("child_key"), F.lit(-1).cast("long").alias("parent_key"), (F.col("id") * 7 % 100_000).alias("child_ts"))
    seeds = edges.select(F.col("child_key").alias("seed_key"), F.col("child_ts").alias("seed_ts"), F.col("parent_key").alias("node"))
    got = sampler.capped_children(seeds, edges, 4)
    n = got.agg(F.count("*").alias("n"), F.count_if(F.col("child_ts") > F.col("seed_ts")).alias("late"), F.avg(F.col("child_ts") / F.greatest("seed_ts", F.lit(1))).alias("mean")).first()
    assert n.n == 4 * 99_997 + 1 + 2 + 3 and n.late == 0 and 0.49 < n["mean"] < 0.51
    assert got.groupBy("seed_key").agg(F.count_distinct("child_key").alias("n")).filter("n < 4").count() == 3


def test_task_rows_are_for_seeds_of_their_table(spark):
    edges = spark.createDataFrame([(1, 0, 5, None), (2, 0, 6, None), (3, 0, 7, None), (10, 0, 1, "a"), (11, 0, 2, "a"), (12, 0, 9, "a"), (20, 0, None, "b")], "child_key long, parent_key long, child_ts long, task string")
    seeds = spark.createDataFrame([(100, 8, 0, "a"), (101, 8, 0, None), (102, 8, 0, "b"), (103, None, 0, "a")], "seed_key long, seed_ts long, node long, task string")
    got = {}
    for r in sampler.capped_children(seeds, edges, 2).collect():
        got.setdefault(r.seed_key, []).append(r.child_key)
    assert sorted(x for x in got[100] if x >= 10) == [10, 11] and sorted(x for x in got[102] if x >= 10) == [20]
    assert all(len([x for x in got[k] if x < 10]) == 2 for k in (100, 101, 102)) and len(got[101]) == 2 and 103 not in got


def test_database_by_footers_and_sinks(spark, tmp_path):
    import json
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    def put(name, table, pkey, time=None, **fkeys):
        os.makedirs(tmp_path / "db", exist_ok=True)
        meta = {"fkey_col_to_pkey_table": json.dumps(fkeys)} | ({"pkey_col": json.dumps(pkey)} if pkey else {}) | ({"time_col": json.dumps(time)} if time else {})
        pq.write_table(table.replace_schema_metadata(meta), tmp_path / "db" / f"{name}.parquet")

    put("a", pa.table({"k": [0, 1]}), "k")
    put("other", pa.table({"k": [0]}), "k")
    put("b", pa.table({"id": [0, 1], "x": [1, 0], "when": pa.array([0, 1], pa.timestamp("us"))}), "id", None, x="other", when="a")
    db = parquet.read_database(spark, str(tmp_path), targets={("b", "x"): "a"})
    assert db.specs["b"].fkeys == {"x": "a", "when": "a"} and db.specs["a"].pkey == "k"
    # a key that holds times is none
    assert {(e.fk_col, e.child_key, e.parent_key) for e in graph.edges(db).collect()} == {("x", 0, 1), ("x", 1, 0)}
    assert set(parquet.read_database(spark, str(tmp_path), keep=lambda n: n != "other").specs) == {"a", "b"}

    vectors = spark.createDataFrame([(2, [1.0, 0.5]), (0, [0.0, 1.0])], "id long, embedding array<double>")
    parquet.write_embeddings(vectors, str(tmp_path))
    cells = spark.createDataFrame([(7, 2), (8, 1)], "node long, class_id long")
    assert {(r.node, tuple(r.embedding or ())) for r in parquet.embedded(cells, spark, str(tmp_path)).collect()} == {(7, (1.0, 0.5)), (8, ())}
    for n in (1, 2):
        parquet.write_predictions(spark.range(n), str(tmp_path), "t")
    assert parquet.read_predictions(spark, str(tmp_path), "t").count() == 2


def test_sums_before_and_steps(spark, monkeypatch):
    from relspark import storage

    monkeypatch.setattr(storage, "WINDOW_ROWS", 5)
    df = spark.range(100).select((F.col("id") * 3).alias("at"), (F.col("id") % 4).alias("v")).repartition(3)
    got = {r["at"]: r.s for r in storage.sums_before(df, "at", "v", "s", 7).collect()}
    assert got == {3 * i: sum(j % 4 for j in range(i)) for i in range(100)}
    assert tasks.first_steps(spark.range(10).withColumnRenamed("id", "batch"), "batch", 3).count() == 3


def test_chained_blocks(spark, monkeypatch):
    monkeypatch.setattr(series, "CHAINED", 3)
    df = spark.range(500).select(F.col("id").alias("i"), (F.col("id") % 7 - 3.0).alias("e"), F.lit("x").alias("__b"))
    state, want = 0.0, []
    for i in range(500):
        state = 0.95 * state + i % 7 - 3.0
        want.append(state)
    got = series.ar1(df, "i", "e", 0.95, block=8).orderBy("i")
    assert got.columns == ["i", "e", "__b", "ar"] and np.allclose([r.ar for r in got.collect()], want)


def test_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from relspark import storage

    none = SimpleNamespace(isEmpty=lambda: True)
    fake = SimpleNamespace(sparkContext=SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))), conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError):
        storage.shared_folder(fake)


def test_running_sums_cross_partitions(spark):
    """One group with most rows, null groups and null values; sums, places and starts against a loop."""
    r = random.Random(1)
    data = [(r.choice([None, "a", "hot", "hot", "hot", "b", ""]), i, r.choice([None, 1, 5, -3])) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, o long, v long")
    want, run, first = {}, {}, {}
    for k, (g, o, v) in enumerate(sorted(data, key=lambda x: (x[0] is not None, x[0] or "", x[1]))):
        n, total = run.get(g, (0, 0))
        run[g] = n + 1, total + (v or 0)
        want[o] = n, total + (v or 0), first.setdefault(g, k)
    got = storage.running_within(df, ["g"], ["o"], {"total": "v"}, place="place", start="start")
    assert {x.o: (x.place, x.total, x.start) for x in got.collect()} == want
    # a hot group is scanned by all tasks
    assert got.filter("g = 'hot'").select(F.spark_partition_id()).distinct().count() > 1
    assert storage.running_within(df.limit(0), ["g"], ["o"], {"total": "v"}).count() == 0


def test_rules_and_paths(spark):
    db = small_db(spark)
    ruled = parquet.with_rules(db, {"a": parquet.TableRules(drop=("v",), is_first=("s",)), "b": parquet.TableRules(drop=("a_k", "nothing")), "c": parquet.TableRules(drop=("x",))})
    assert ruled.tables["a"].columns == ["k", "s"] and [r.s for r in ruled.tables["a"].orderBy("k").collect()] == [True, False, None]
    assert ruled.specs["b"].fkeys == {} and "a_k" not in ruled.tables["b"].columns
    keep = parquet.hyphen_rule("/data/rel-x")
    assert keep("/data/rel-x/tasks/churn/val.parquet") and keep("/data/rel-x/tasks/user-churn/val.parquet")
    assert not keep("/data/rel-x/tasks/user-item-churn/val.parquet") and keep("/data/rel-x/tasks/a/rating-x-val.parquet")


def test_a_users_aggregate_gets_many_groups_at_once(spark):
    from relspark.functions import sql

    def spread(xs, starts):
        assert len(starts) > 1
        return np.maximum.reduceat(xs, starts) - np.minimum.reduceat(xs, starts)

    sql.register_aggregate(spark, "spread_of", spread)
    rows = [(1, [1.0, 4.0]), (2, None), (3, [None]), (4, []), (5, [None, 2.0, 7.5]), (6, [3.0])]
    spark.createDataFrame(rows, "k int, xs array<double>").coalesce(1).createOrReplaceTempView("relspark_arrays")
    assert spark.sql("SELECT spread_of(xs) FROM relspark_arrays ORDER BY k").collect() == [(3.0,), (None,), (None,), (None,), (5.5,), (0.0,)]


def test_sql_functions_of_nulls(spark, tmp_path):
    """A group without a key is a group, and one of nothing but nulls has no sum."""
    rows = [(1, 20.0, 0.1), (1, None, None), (2, None, 0.2), (None, 30.0, 0.0), (None, 10.0, 0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {x.l_orderkey: (x.total, x.middle) for x in queries.queries()["sql_functions"](spark, str(tmp_path)).collect()}
    assert got == {1: (2.0, 2.0), 2: (None, None), None: (4.0, 2.0)}


def test_vectors_do_not_move_with_cells(spark):
    """Cells are dealt out by their text alone; the dictionary has its vectors by then."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        plan = queries.queries()["cell_embeddings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "hashpartitioning(txt" in plan and "hashpartitioning(class_id" not in plan and "hashpartitioning(column_id" not in plan


def test_what_is_written(spark):
    """Row numbers are written as Parquet, or as a checkpoint where it lacks a type; shuffle files go with their action, and the setting stays."""
    rows = spark.range(50).selectExpr("id", "NULL AS none", "INTERVAL 1 DAY AS d", "-0.0D AS z")
    assert sorted(r.rn for r in numbered(rows, ["id"]).collect()) == list(range(50))
    assert not numbered(spark.range(50), ["id"])._jdf.queryExecution().logical().toString().startswith("LogicalRDD")
    before = spark.conf.get(storage.CLEANUP)
    shuffles = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    n = shuffles()
    kept = storage.checkpointed(spark.range(50).repartition(3, "id"))
    storage.stored(spark.range(50).repartition(3, "id"))
    assert shuffles() <= n and kept.count() == 50 and spark.conf.get(storage.CLEANUP) == before


def test_a_database_graph_moves_a_table_at_a_time(spark, monkeypatch):
    """Nodes and edges are those of the whole graph; a file holds one table's or one key's rows, in order."""
    moved, append = [], parquet._append
    monkeypatch.setattr(parquet, "_append", lambda df, path: moved.append(df.select(df.columns[-1] if "nodes" in path else "fk_col").distinct().count()) or append(df, path))
    db, path = open_database(spark, "/root/testdata/sf0.001"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    parquet.write_database_graph(path, db, graph.dictionary(db.tables))
    assert moved == [1] * (len(db.specs) + len(db.fkeys()))
    for part, whole, key in (("nodes", graph.database_cells(db), "node_key"), ("edges", graph.edges(db), "parent_key")):
        made = spark.read.parquet(f"{path}/{part}.parquet")
        assert made.exceptAll(whole.select(made.columns)).count() == 0 and made.count() == whole.count()
        files = made.withColumn("f", F.input_file_name()).groupBy("f").agg(F.collect_list(key).alias("keys"), F.count_distinct("table" if part == "nodes" else "fk_col").alias("n"))
        assert all(x["keys"] == sorted(x["keys"]) and x.n == 1 for x in files.collect())


def test_contexts_move_visits_and_not_cells(spark):
    """Visits become cells after their last exchange."""
    plan = queries._contexts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Generate explode(")]
    assert "Exchange" not in top and "Exchange hashpartitioning(seed_key" in plan
