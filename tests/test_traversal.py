"""The traversal against one walker in a plain loop, with the same keyed draws."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from relspark import queries
from relspark.operators import sampler, traversal


def u32(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def draws(seed, key, node, visible, width):
    """Ranks that ``Adjacency.sampled`` draws among a node's visible children."""
    if visible <= width:
        return range(visible)
    edge = [j * visible // width for j in range(width + 1)]
    return [edge[j] + int(u32(seed, "rank", key, node, j) / 2**32 * (edge[j + 1] - edge[j])) for j in range(width)]


def walk(key, ts, task, start, parents, children, sizes, length, width, seed=0):
    stack, levels, low, out, used = [], {0: [start]}, {}, [], 0
    while True:
        if stack:
            d, n = stack.pop()
        else:
            d = min((d for d, x in levels.items() if x), default=None)
            if d is None:
                return out
            n = min(levels[d], key=lambda n: (u32(seed, key, n) if d else 0, n))
            levels[d].remove(n)
        if low.get(n, d + 1) <= d:
            continue
        used += sizes.get(n, 0)
        if used >= length:
            return out
        low[n] = d
        out.append((key, len(out), n, d, used))
        stack += [(d + 1, p) for _, p in sorted(parents.get(n, []))]
        seen = [c for t, c, own in children.get(n, []) if own is None and (t is None or ts is not None and t <= ts)]
        levels.setdefault(d + 1, []).extend(seen[j] for j in draws(seed, key, n, len(seen), width))
        levels[d + 1] += [c for t, c, own in children.get(n, []) if own is not None and own == task and (t is None or ts is not None and t <= ts)]


@pytest.mark.parametrize("case", [(2, 60, 4), (3, 25, 50)])
def test_equals_a_plain_walk(spark, case):
    number, length, width = case
    r = random.Random(number)
    n = 120
    generation = [0 if i < 4 else 1 if i < 20 else 2 if i < 50 else 3 for i in range(n)]
    time = [r.choice([None, r.randrange(50)]) for _ in range(n)]
    task = [r.choice([None, None, "t", "u"]) if generation[i] == 3 else None for i in range(n)]
    edges = []
    for i in range(n):
        below = [p for p in range(n) if generation[p] < generation[i]]
        for pos in range(r.randrange(1, 4) if below else 0):
            hub = generation[i] == 3 and r.random() < 0.4
            edges.append((i, 4 if hub else r.choice(below), time[i], pos, task[i]))
    edges = [e for k, e in enumerate(edges) if (e[0], e[1]) not in {(x[0], x[1]) for x in edges[:k]}]
    sizes = {i: r.randrange(0, 6) for i in range(n) if r.random() < 0.95}
    parents, children = {}, {}
    for c, p, t, pos, own in edges:
        parents.setdefault(c, []).append((pos, p))
        children.setdefault(p, []).append((t, c, own))
    for x in children.values():
        x.sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1]))
    seeds = [(i + 1000, time[i], i, task[i]) for i in range(0, n, 3)]
    want = [v for key, ts, i, own in seeds for v in walk(key, ts, own, i, parents, children, sizes, length, width)]
    got = traversal.traverse(
        spark.createDataFrame(seeds, "seed_key long, seed_ts long, node long, task string").repartition(3),
        spark.createDataFrame(edges, "child_key long, parent_key long, child_ts long, pos int, task string"),
        spark.createDataFrame(list(sizes.items()), "node long, n_cells long"),
        length,
        width,
    )
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_seeds_and_cells_of_visits(spark):
    edges = spark.createDataFrame([(1, 2, 5)], "child_key long, parent_key long, child_ts long")
    sizes = spark.createDataFrame([(1, 2), (2, 1)], "node long, n_cells long")
    none = spark.createDataFrame([], "seed_key long, seed_ts long, node long")
    assert traversal.traverse(none, edges, sizes, 10, 4).count() == 0
    seeds = spark.createDataFrame([(7, 5, 1)], "seed_key long, seed_ts long, node long")
    visits = traversal.traverse(seeds, edges, sizes, 10, 4)
    times = spark.createDataFrame([(1, 5), (2, None)], "node long, ts long")
    cells = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "b", 0)], "node long, column string, cell int")
    got = traversal.visited_cells(visits, seeds, times, cells, "a", ["b"], 2).orderBy("pos").collect()
    assert [(x.pos, x.node, x.column, x.is_target) for x in got] == [(0, 1, "a", True), (1, 2, "b", False)]
    assert [(x.node, x.column) for x in traversal.visited_cells(visits, seeds, times, cells, "a", [], 2).orderBy("pos").collect()] == [(1, "a"), (1, "b")]


def test_a_stored_hop_moves_only_what_it_asks_for(spark):
    """The plan of a hop over bucketed children has an exchange on the side of the asks, and none on the children's."""
    edges = spark.range(2000).selectExpr("id AS child_key", "id % 7 AS parent_key", "id % 50 AS child_ts")
    seeds = spark.range(40).selectExpr("id AS seed_key", "id AS seed_ts", "CAST(NULL AS STRING) AS task", "id % 7 AS node")
    plain, stored = sampler.Adjacency(edges), sampler.Adjacency(edges, stored=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        asks = seeds.select("node", F.col("seed_key").alias("rank"))
        plan = asks.join(stored.children, ["node", "rank"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert asks.join(plain.children, ["node", "rank"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") >= 2
        assert sorted(stored.sampled(seeds, 5).collect()) == sorted(plain.sampled(seeds, 5).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_children_are_sampled_at_their_turn(spark, monkeypatch):
    """A walk that ends among the seed's children asks for those alone, and not for the children of its parents."""
    edges = spark.createDataFrame([(1, 2, 5, 0), (2, 3, 5, 0), *((10 + i, 1, 4, 0) for i in range(5)), *((20 + i, 3, 4, 0) for i in range(50))], "child_key long, parent_key long, child_ts long, pos int")
    sizes = spark.createDataFrame([(i, 10 if 10 <= i < 15 else 1) for i in (1, 2, 3, *range(10, 15), *range(20, 70))], "node long, n_cells long")
    asked, sampled = [], sampler.Adjacency.sampled
    monkeypatch.setattr(sampler.Adjacency, "sampled", lambda self, frontier, *a: asked.append(sorted(r.node for r in frontier.collect())) or sampled(self, frontier, *a))
    got = traversal.traverse(spark.createDataFrame([(7, 5, 1)], "seed_key long, seed_ts long, node long"), edges, sizes, 30, 8).collect()
    assert sorted(r.node for r in got)[:3] == [1, 2, 3] and len(got) == 5 and asked == [[1]]


def test_near_walks_sample_twice(spark, monkeypatch):
    """Visits up to depth 2 need the children of two depths, and no others are sampled."""
    asked, sampled = [], sampler.Adjacency.sampled
    monkeypatch.setattr(sampler.Adjacency, "sampled", lambda self, *a: asked.append(1) or sampled(self, *a))
    got = queries.queries()["temporal_walks_near"](spark, "/root/testdata/sf0.001")
    assert got.agg(F.max("depth")).first()[0] == 2 and len(asked) == 2
