import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.catalog import SchemaError, TableSpec, entity_tables, to_dot, topological_generations
from relspark.plans import hsbm
from relspark.plans.dag import LAYOUTS, WEIGHTS, sample_dag
from relspark.plans.generate import DatabaseConfig, make_database, plan_schema
from relspark.plans import scm
from relspark.plans.scm import ACTIVATIONS, INITIALISERS, SOURCES, STRATEGIES, Scm, propagate
from relspark.sources.ddl import parse_ddl, schema_edges

SHOP = """
-- a shop
CREATE TABLE people (person_id BIGINT PRIMARY KEY, level TEXT CHECK (level IN ('low', 'mid', 'it''s high')), joined BOOLEAN);
CREATE TABLE items (item_id BIGINT PRIMARY KEY, price NUMERIC(10, 2) NOT NULL);
CREATE TABLE IF NOT EXISTS sales (sale_id BIGINT, person_id BIGINT REFERENCES people(person_id), item_id BIGINT, main_item TEXT, kind TEXT, amount DOUBLE,
    CONSTRAINT pk PRIMARY KEY (sale_id), FOREIGN KEY (item_id) REFERENCES items (item_id), CHECK (main_item IN ('yes', 'no')), CHECK (kind IN ('a')));
"""
SMALL = DatabaseConfig(tables=(3, 4), columns=(3, 5), entity_rows=(20, 30), activity_rows=(40, 60))


def test_ddl():
    t = parse_ddl(SHOP)
    assert [c.categories for c in t["people"].columns] == [None, ["low", "mid", "it's high"], [0, 1]]
    assert t["sales"].pkey == "sale_id" and t["sales"].fkeys == {"person_id": ("people", "person_id"), "item_id": ("items", "item_id")}
    assert {c.name: c.kind for c in t["sales"].columns} == {"sale_id": "key", "person_id": "key", "item_id": "key", "main_item": "categorical", "kind": "categorical", "amount": "numerical"}
    assert schema_edges(t) == {("people", "sales"), ("items", "sales")}
    assert entity_tables({n: x.spec() for n, x in t.items()}) == {"people", "items"}


@pytest.mark.parametrize(
    "sql",
    ["", "CREATE TABLE t (a INT, b INT, PRIMARY KEY (a, b))", "CREATE TABLE t (a DATE)", "CREATE TABLE t (a TEXT)", "DROP TABLE t", "CREATE TABLE t (a INT REFERENCES u(b))", "CREATE TABLE t (a INT PRIMARY KEY, b INT REFERENCES t(a))", "CREATE TABLE t (a INT"],
)
def test_bad_ddl(sql):
    with pytest.raises(SchemaError):
        parse_ddl(sql)


def test_schema_graph():
    specs = {"a": TableSpec("a", "k"), "b": TableSpec("b", "k", None, {"x": "a", "y": "a"}), "c": TableSpec("c", None, None, {"x": "b"})}
    assert topological_generations(specs) == {"a": 0, "b": 1, "c": 2} and '"a" -> "b"' in to_dot(specs)
    with pytest.raises(SchemaError):
        topological_generations(specs | {"a": TableSpec("a", "k", None, {"z": "c"})})


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
@pytest.mark.parametrize("n", [1, 2, 10, 50])
def test_dags(layout, n):
    for seed in range(8):
        g = sample_dag(n, layout, seed)
        assert g.n == n and len(g.components()) == 1 and g.generations()[0]
        assert all(np.isfinite(w) for w in g.edges.values())
        assert sample_dag(n, layout, seed).edges == g.edges


def test_registries():
    x = np.concatenate([np.linspace(-1e4, 1e4, 201), [0.0]])
    for f in ACTIVATIONS.values():
        assert np.isfinite(f(x)).all()
    assert len(ACTIVATIONS) == 29 and len(INITIALISERS) == 6 and len(WEIGHTS) == 4
    assert abs(ACTIVATIONS["gelu"](np.array([1.0]))[0] - 0.8413447) < 1e-6 and ACTIVATIONS["hardswish"](np.array([1.0]))[0] == 4 / 6
    r = np.random.default_rng(0)
    assert all(f(r, 6, 5).shape == (6, 5) for f in INITIALISERS.values()) and (INITIALISERS['sparse'](r, 6, 5) == 0).sum() == 15
    assert len(SOURCES) == 5 and set(STRATEGIES) == {'eager', 'lazy'}
    with pytest.raises(ValueError):
        sample_dag(3, "Ring", 0)


def test_scm_is_finite_and_independent_of_partitions(spark):
    for seed in range(6):
        model = Scm.sample({"n": 0, "c": 3, "m": 0}, seed, parents=[[0]])
        rows = spark.range(200).select(F.col("id").alias("k"), (F.col("id") / 7).alias("up"))
        one = propagate(rows.coalesce(1), "k", 200, model, ["up"]).orderBy("k").collect()
        many = propagate(rows.repartition(7), "k", 200, model, ["up"]).orderBy("k").collect()
        assert all(np.allclose([a.n, a.c, a.m], [b.n, b.c, b.m], rtol=1e-9) for a, b in zip(one, many, strict=True))
        assert all(np.isfinite(r.n) and np.isfinite(r.m) and r.c in (0, 1, 2) for r in one)


@pytest.mark.parametrize(("a", "b"), [(10, 20), (30, 7), (5, 100)])
def test_every_child_draws_one_parent(spark, a, b):
    for levels in ([1], [3], [2, 3]):
        got = [r.parent for r in hsbm.assign(spark.range(b), "id", b, a, levels, levels, 1).collect()]
        assert len(got) == b and all(0 <= p < a for p in got)
    with pytest.raises(ValueError):
        hsbm.level_matrices([2], [2, 2], 0)


def test_generated_databases(spark):
    for seed in (0, 1):
        db = make_database(spark, seed, SMALL)
        assert len(db.tables) == len(plan_schema(SMALL, seed))
        n = {r.table: r.n_rows for r in db.counts().collect()}
        for r in db.integrity().collect():
            assert r.n_orphan == r.n_null == 0 and r.n_rows == n[r.child_table]
        for name, df in db.tables.items():
            assert df.select("row_idx").distinct().count() == df.count() == n[name]
            floats = [c for c, t in df.dtypes if t == "double"]
            if floats:
                worst = df.agg(*(F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in floats)).first()
                gone = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in floats)).first()
                assert not any(worst) and all(g <= 0.1 * n[name] for g in gone)
    again = make_database(spark, 1, SMALL)
    for name in db.tables:
        assert db.tables[name].orderBy("row_idx").collect() == again.tables[name].orderBy("row_idx").collect()


def test_database_from_ddl(spark):
    db = make_database(spark, 3, SMALL, ddl=SHOP)
    assert set(db.tables) == {"people", "items", "sales"}
    assert {r.level for r in db.tables["people"].select("level").distinct().collect()} <= {"low", "mid", "it's high"}
    assert "date" in db.tables["sales"].columns and "date" not in db.tables["items"].columns


def test_scm_is_the_plain_loop():
    """Each row on its own, each node in turn, with scalars."""
    for seed in range(4):
        # two parents: one of a number and a category, one of a category
        m = Scm.sample({"n": 0, "c": 4}, seed, parents=[[0, 3], [5]])
        rows, up = np.arange(3, 40, 3), np.random.default_rng(seed).normal(size=(13, 3))
        up[:, 1], up[:, 2] = np.arange(13) % 3, np.arange(13) % 5
        up[4] = np.nan
        got = m.run(rows, 50, up)
        for i, row in enumerate(rows):
            value = {}
            for v in (v for layer in m.dag.generations() for v in layer):
                if v in m.sources:
                    value[v] = SOURCES[m.sources[v].kind][m.categories[v] > 0](scm.Draws(m.seed, v, np.array([row]), 50), m.sources[v])[0]
                    continue
                each = []
                for p in m.dag.parents(v):
                    x = m.embeddings[p][int(value[p])] if m.categories[p] else np.array([value[p]])
                    each.append(np.clip(m.dag.edges[p, v] * m.encoders[p, v](x[None])[0], -1e4, 1e4))
                for f, share in enumerate((0.5, 0.5, 1.0)):
                    there = not np.isnan(up[i, f])
                    x = np.array([up[i, f] if there else 0.0]) if f == 0 else m.foreign_embeddings[f][int(up[i, f])] if there else np.zeros(scm.EMBEDDING)
                    each.append(np.clip(m.foreign[f](x[None])[0] * (share if m.aggregation[v] == "sum" else 1), -1e4, 1e4))
                met = {"sum": np.sum, "max": np.max, "product": np.prod, "logexp": np.logaddexp.reduce}[m.aggregation[v]](np.array(each), axis=0)
                out = m.decoders[v](np.clip(m.node_noise(v, np.array([row]))[0] + met, -1e6, 1e6)[None])[0]
                value[v] = float(np.argmax(m.embeddings[v] @ out)) if m.categories[v] else out[0]
            assert all(np.isclose(got[c][i], value[v], rtol=1e-6, atol=1e-9) for c, v in m.columns.items())


def test_sources_have_their_distributions():
    rows = np.arange(20_000)
    d = scm.Draws(3, 5, rows, len(rows))
    s = scm.Source("beta", 2.0, 0.3, 0.8, (0.1, 0.6, 0.3))
    x = (SOURCES["beta"][0](d, s) + 1) / 2
    assert abs(x.mean() - 2 / 5) < 0.01 and abs(x.var() - 6 / (25 * 6)) < 0.005
    share = np.bincount(SOURCES["uniform"][1](d, s).astype(int), minlength=3) / len(rows)
    assert np.allclose(share, s.shares, atol=0.02)
    a = d.ar1(4, 0.8)
    assert abs(np.corrcoef(a[1:], a[:-1])[0, 1] - 0.8) < 0.02 and abs(a.std() - 1 / 0.6) < 0.08
    some = np.array([19_999, 5, 700])
    assert np.allclose(scm.Draws(3, 5, some, len(rows)).ar1(4, 0.8), a[some], atol=1e-8)
    for number, category in SOURCES.values():
        x, k = number(d, s), category(d, s)
        assert np.isfinite(x).all() and np.abs(x).max() <= 1 and set(np.unique(k)) <= {0.0, 1.0, 2.0}


def test_bipartite_edges(spark):
    got = hsbm.bipartite(spark.range(60), "id", 60, 30, [2, 3], [2, 3], 4).collect()
    assert len(got) == 60 and sorted(r.child for r in got) == list(range(60)) and all(0 <= r.parent < 30 and r.parent_cluster == r.parent // 5 and r.child_cluster == r.child // 10 for r in got)
    near = sum(r.parent_cluster == r.child_cluster for r in got)
    assert near > 45 and hsbm.pair_weight(4, 4, [2, 3], [2, 3], 4) == 0.9 * 0.9


def test_beta_draws_are_exact_in_the_tails():
    """Where the distribution function is known in full: arcsine, powers, and their mirror images; no draw depends on its batch."""
    n = 200_000
    rows = np.arange(n)
    for a, b, cdf in ((0.5, 0.5, lambda x: 2 / np.pi * np.arcsin(np.sqrt(x))), (0.5, 1, np.sqrt), (3, 1, lambda x: x**3), (1, 4, lambda x: 1 - (1 - x) ** 4)):
        x = scm.beta(7, 3, rows, a, b)
        for at in (1e-8, 1e-6, 1e-4, 1e-2, 0.1, 0.5, 0.9, 0.99, 0.9999):
            want = n * cdf(at)
            assert abs((x < at).sum() - want) < 5 * np.sqrt(want * (1 - cdf(at))) + 1, (a, b, at)
        some = np.array([199_999, 3, 77])
        assert (scm.beta(7, 3, some, a, b) == x[some]).all()


def test_sine_mixtures_are_drawn_for_each_layer():
    r = np.random.default_rng(1)
    mixes = [a for _ in range(200) for a in scm.Mlp.sample(r, 3, 2).activations if not isinstance(a, str)]
    assert len(mixes) > 5 and len({m.phases.tobytes() for m in mixes}) == len(mixes) and {len(m.phases) for m in mixes} <= set(range(3, 8))
    m, x = mixes[0], 0.3
    assert np.isclose(m(np.array([x]))[0], sum(h * np.sin(f * x + p) for h, f, p in zip(m.heights, m.frequencies, m.phases, strict=True)))


@pytest.mark.parametrize("fifth", [0, 4])
def test_all_columns_of_a_parent_count(spark, fifth):
    """A child changes when the fifth column of its parent does, a number or a category."""
    model = Scm.sample({"y": 0, "z": 0}, 5, parents=[[0, 0, 2, 0, fifth]])
    rows = spark.range(60).select(F.col("id").alias("k"), *(F.col("id") % 2 * 1.0 if i == 2 else (F.col("id") / 60).alias("x") for i in range(4)))
    rows = rows.toDF("k", "a", "b", "c", "d")
    other = lambda by: {r.k: (r.y, r.z) for r in propagate(rows.withColumn("e", (F.col("k") + by) % 4 * 1.0), "k", 60, model, ["a", "b", "c", "d", "e"]).collect()}
    one, two = other(0), other(1)
    assert one == other(4) and sum(one[k] != two[k] for k in one) > 50


def test_descent_draws_as_the_whole_table_would(spark):
    """Evenly spaced uniforms fall into the shares of the product of all levels' weights; five levels, and a last cluster that is cut."""
    for levels, parents in (([3, 3, 3, 3, 3], 2430), ([2, 3], 17), ([3, 2, 2], 40)):
        total = int(np.prod(levels))
        size = hsbm._sizes(parents, total)
        rows = hsbm.descent_rows(parents, levels, levels, 4)
        assert len(rows) == total and all(len(s) == len(levels) for _, s in rows)
        for cb in (0, total // 2, total - 1):
            w = np.array([hsbm.pair_weight(a, cb, levels, levels, 4) for a in range(total)]) * size
            shares = spark.createDataFrame([rows[cb]], hsbm.STEPS)
            n = 20_000
            got = spark.range(n).crossJoin(F.broadcast(shares)).select(hsbm.descend(F.col("steps"), (F.col("id") + 0.5) / n).alias("a")).groupBy("a").count().collect()
            count = np.zeros(total)
            for r in got:
                count[r.a] = r["count"]
            # evenly spaced numbers fall into each share to within one
            assert np.abs(count - n * w / w.sum()).max() <= 1.01
