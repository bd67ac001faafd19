"""Context sequences: seeds, temporally filtered hops with a width cap, budgets, leakage filters and batches.

Traversal is level by level: all parents first, then children, in order of a keyed random number. A hop
finds how long the visible prefix of a node's children is, draws ranks from it and looks these up: a
constant number of rows a visit, whatever the node's degree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relspark.functions.rng import u32, unit
from relspark.storage import bucketed, numbered, running_within, written


def visible(child_ts: Column, seed_ts: Column) -> Column:
    """Whether a child may be seen from a seed: it has no time, or none later than the seed's."""
    return child_ts.isNull() | F.coalesce(child_ts <= seed_ts, F.lit(False))


class Adjacency:
    """Edges as they are looked up by parent: children of the database in order of time, with their ranks, and rows of task tables beside them.

    ``edges(parent_key, child_key, child_ts)`` may have ``task``: the name of the task table whose row the child is, null for
    rows of the database. The children are sorted and numbered once, a hub's by many tasks (see ``running_within``). With
    ``stored`` they are kept bucketed by (node, rank), for many hops: a hop then moves what it asks for, and not the children.
    ``carried`` names columns of the edges that come with the children.
    """

    def __init__(self, edges: DataFrame, stored: bool = False, carried: Sequence[str] = ()):
        named = edges if "task" in edges.columns else edges.withColumn("task", F.lit(None).cast("string"))
        self.carried = [*carried]
        flat = named.select(F.col("parent_key").alias("node"), "child_key", "child_ts", "task", *self.carried)
        self.children = running_within(flat.filter("task IS NULL").drop("task"), ["node"], [F.col("child_ts").asc_nulls_first(), "child_key"], {}, place="rank")
        if stored:
            self.children = bucketed(self.children, ["node", "rank"])
        self.tasks = flat.filter("task IS NOT NULL")

    def visible_counts(self, asks: DataFrame) -> DataFrame:
        """``node, seed_ts, visible`` for each of ``asks(node, seed_ts)``: how many first children of the node can be seen from the time.

        Children and asks are sorted together, once; an ask's answer is the running count of children in its node.
        """
        asks = asks.select("node", F.col("seed_ts").alias("ts"), F.lit(1).alias("ask"), F.lit(0).alias("child")).distinct()
        met = self.children.join(asks.select("node").distinct(), "node", "left_semi")
        both = met.select("node", F.col("child_ts").alias("ts"), F.lit(0).alias("ask"), F.lit(1).alias("child")).unionByName(asks)
        counted = running_within(both, ["node"], [F.col("ts").asc_nulls_first(), "ask"], {"visible": "child"})
        return counted.filter("ask = 1 AND visible > 0").select("node", F.col("ts").alias("seed_ts"), "visible")

    def sampled(self, frontier: DataFrame, width: int, seed: int = 0) -> DataFrame:
        """``seed_key, seed_ts, task, node, child_key, child_ts, r`` and what is carried: up to ``width`` visible children of each row of ``frontier(seed_key, seed_ts, task, node)``.

        If there are more, the visible ones are cut into ``width`` stretches of equal length, and one of each is drawn
        by keyed hash: ``width`` rows a frontier row, however many children a hub has. Rows of the seed's own task
        table come besides, without a cap; those of other task tables never do.
        """
        counts = self.visible_counts(frontier)
        same_ts = F.col("f.seed_ts").eqNullSafe(F.col("c.seed_ts"))
        met = frontier.alias("f").join(counts.alias("c"), (F.col("f.node") == F.col("c.node")) & same_ts).select("f.*", "visible")
        # few bytes that become many rows: dealt to all tasks, where adaptive execution would put them into few
        met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seed_key", "node")
        drawn = met.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("visible", F.lit(width).cast("long")) - 1))) if width > 0 else met.withColumn("j", F.lit(0).cast("long")).limit(0)
        edge = lambda j: F.floor(j * F.col("visible") / width).cast("long")
        low, high = edge(F.col("j")), edge(F.col("j") + 1)
        u = unit(seed, "rank", F.col("seed_key"), F.col("node"), F.col("j"))
        rank = F.when(F.col("visible") <= width, F.col("j")).otherwise(low + F.floor(u * (high - low)))
        database = drawn.withColumn("rank", rank).join(self.children, ["node", "rank"])
        own = frontier.filter("task IS NOT NULL").join(self.tasks, ["node", "task"]).filter(visible(F.col("child_ts"), F.col("seed_ts")))
        columns = ["seed_key", "seed_ts", "task", "node", "child_key", "child_ts", *self.carried]
        return database.select(*columns).unionByName(own.select(*columns)).withColumn("r", u32(seed, F.col("seed_key"), F.col("child_key")))


def _with_task(seeds: DataFrame) -> DataFrame:
    return seeds if "task" in seeds.columns else seeds.withColumn("task", F.lit(None).cast("string"))


def capped_children(frontier: DataFrame, edges: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """One hop from ``frontier(seed_key, seed_ts, node)``, which may have ``task``, over ``edges``; see ``Adjacency``."""
    return Adjacency(edges).sampled(_with_task(frontier).select("seed_key", "seed_ts", "task", "node"), width, seed)


def expand(seeds: DataFrame, edges: DataFrame, hops: int, width: int, seed: int = 0, sizes: DataFrame | None = None, length: int = 0) -> DataFrame:
    """``seed_key, node, depth, is_parent, r``: the nodes reached from ``seeds(seed_key, seed_ts, node)`` in up to ``hops`` levels, first visits only.

    ``edges(child_key, parent_key, child_ts)`` hold global node ids; ``seeds`` and ``edges`` may have ``task``, see ``Adjacency``.
    Parents are not filtered by time. With ``sizes(node, n_cells)`` a seed goes no further once its visits have
    ``length`` cells, as what follows would be beyond its budget. Each level is written once; the loop ends early when a level is empty.
    """
    front = _with_task(seeds).select("seed_key", "seed_ts", "task", "node")
    graph = Adjacency(edges)
    seen = written(front.select("seed_key", "node", F.lit(0).alias("depth"), F.lit(True).alias("is_parent"), F.lit(0).cast("long").alias("r")))
    for depth in range(1, hops + 1):
        up = front.join(edges.select("child_key", "parent_key"), F.col("node") == F.col("child_key")).select("seed_key", "seed_ts", "task", F.col("parent_key").alias("node"), F.lit(True).alias("is_parent"), u32(seed, F.col("seed_key"), F.col("parent_key")).alias("r"))
        down = graph.sampled(front, width, seed).select("seed_key", "seed_ts", "task", F.col("child_key").alias("node"), F.lit(False).alias("is_parent"), "r")
        level = up.unionByName(down).groupBy("seed_key", "seed_ts", "task", "node").agg(F.max("is_parent").alias("is_parent"), F.min("r").alias("r"))
        level = written(level.join(seen.select("seed_key", "node"), ["seed_key", "node"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("seed_key", "node", F.lit(depth).alias("depth"), "is_parent", "r"))
        front = level.select("seed_key", "seed_ts", "task", "node")
        if sizes is not None and depth < hops:
            full = seen.join(sizes, "node").groupBy("seed_key").agg(F.sum("n_cells").alias("cells")).filter(F.col("cells") >= length)
            front = written(front.join(full, "seed_key", "left_anti"))
    return seen


def within_budget(visits: DataFrame, n_cells: str, length: int) -> DataFrame:
    """The visits of each seed, in order of depth, parents first, then by draw, while the cells so far stay below ``length``.

    A context has few visits (at most about ``length``), so the running sum's window is small.
    """
    order = [F.col("depth"), F.col("is_parent").desc(), F.col("r"), F.col("node")]
    w = Window.partitionBy("seed_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return visits.withColumn("used", F.sum(n_cells).over(w)).filter(F.col("used") < length)


def leaks(column: Column, dropped: list[str], node: Column, seed: Column, ts: Column, seed_ts: Column) -> Column:
    """Whether a cell must go: its column is listed, and its row is the seed or has the seed's very time (or both have none)."""
    return column.isin(dropped) & ((node == seed) | ts.eqNullSafe(seed_ts))


def contexts(seeds: DataFrame, edges: DataFrame, times: DataFrame, cells: DataFrame, hops: int, width: int, length: int, target: str, dropped: list[str], seed: int = 0, ranged: bool = False) -> DataFrame:
    """``seed_key, node, depth, ts, parents, column, ..., pos, is_target``: each seed's context, its cells in order of column and node.

    ``parents`` holds the nodes that the cell's row refers to.

    ``seeds(seed_key, seed_ts, node)``, ``edges(child_key, parent_key, child_ts)``, ``times(node, ts)`` and
    ``cells(node, column, ...)``. Visits stop before the cells reach ``length``; leaking cells go after that, and at
    most ``length`` remain. Target values of other rows stay visible. Nodes without cells count none. With ``ranged`` contexts are range-partitioned by seed_key.
    """
    each = cells.groupBy("node").agg(F.collect_list(F.struct(*(c for c in cells.columns if c != "node"))).alias("cells"))
    sizes = written(cells.groupBy("node").agg(F.count("*").alias("n_cells")))
    visits = expand(seeds, edges, hops, width, seed, sizes, length)
    seen = within_budget(visits.join(sizes, "node", "left").fillna(0, ["n_cells"]), "n_cells", length).select("seed_key", "node", "depth")
    own = seen.join(seeds.select("seed_key", "seed_ts", F.col("node").alias("seed_node")), "seed_key")
    parents = edges.groupBy(F.col("child_key").alias("node")).agg(F.sort_array(F.collect_set("parent_key")).alias("parents"))
    # visits move to their nodes and back to their seeds, once each, as rows of few bytes: they become cells where they end
    met = own.join(each, "node").join(times, "node", "left").join(parents, "node", "left")
    leak = lambda c: leaks(c["column"], dropped, F.col("node"), F.col("seed_node"), F.col("ts"), F.col("seed_ts"))
    there = met.withColumn("cells", F.filter("cells", lambda c: ~leak(c))).withColumn("at_seed", F.col("node") == F.col("seed_node")).drop("seed_ts", "seed_node")
    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = there.repartitionByRange(parts, "seed_key") if ranged else there.repartition("seed_key")
    flat = dealt.withColumn("cell", F.explode("cells")).select("*", "cell.*").drop("cell", "cells")
    w = Window.partitionBy("seed_key").orderBy("column", "node")
    marked = flat.withColumn("pos", F.row_number().over(w) - 1).filter(F.col("pos") < length)
    return marked.withColumn("is_target", F.col("at_seed") & (F.col("column") == target)).drop("at_seed")


def batches(items: DataFrame, order: list[str], ranks: int, size: int, seed: int = 0) -> DataFrame:
    """``items`` with ``batch, rank, slot``: shuffled by keyed hash, dealt out in turn; the last batch is filled from the start."""
    rows = numbered(items, [u32(seed, *map(F.col, order)), *order], "pos")
    n = rows.count()
    if not n:
        return rows.select(*items.columns, *(F.lit(0).cast("long").alias(c) for c in ("batch", "rank", "slot")))
    per = ranks * size
    total = -(-n // per) * per
    # position p is taken by item p mod n; an item takes every position p, p + n, ... below the total
    again = F.sequence(F.col("pos"), F.lit(total - 1).cast("long"), F.lit(n).cast("long"))
    dealt = rows.select(*items.columns, F.explode(again).alias("p"))
    return dealt.select(
        *items.columns, F.floor(F.col("p") / per).cast("long").alias("batch"), F.floor(F.col("p") % per / size).cast("long").alias("rank"), (F.col("p") % size).cast("long").alias("slot")
    )


def padded(sequences: DataFrame, seq: str, position: str, length: int, columns: list[str]) -> DataFrame:
    """One row a sequence: for each of ``columns`` an array of ``length``, nulls after the sequence's end, and ``n``, its length."""
    each = F.array_sort(F.collect_list(F.struct(position, *columns)))
    rows = sequences.filter(F.col(position) < length).groupBy(seq).agg(each.alias("x"))
    pad = lambda c: F.concat(F.transform("x", lambda s: s[c]), F.array_repeat(F.lit(None), length - F.size("x")))
    return rows.select(seq, F.size("x").alias("n"), *(pad(c).alias(c) for c in columns))


def attention(cells: DataFrame) -> DataFrame:
    """``seq, kind, q, kv``: who attends to whom in each sequence of ``cells(seq, pos, node, col, parents array)``.

    ``feat``: the same row, or a row that q's row refers to; ``nbr``: the reverse of the latter; ``col``: the same
    column. Joins are on (seq, key), so they stay within a context.
    """
    q = cells.select("seq", F.col("pos").alias("q"), F.col("node").alias("qn"), F.col("col").alias("qc"), F.col("parents").alias("qp"))
    kv = cells.select("seq", F.col("pos").alias("kv"), F.col("node").alias("kn"), F.col("col").alias("kc"))
    refers = q.select("seq", "q", F.explode("qp").alias("kn")).join(kv, ["seq", "kn"]).select("seq", "q", "kv")
    same = q.join(kv, [q.seq == kv.seq, F.col("qn") == F.col("kn")]).select(q.seq, "q", "kv")
    cols = q.join(kv, [q.seq == kv.seq, F.col("qc") == F.col("kc")]).select(q.seq, F.lit("col").alias("kind"), "q", "kv")
    feat = same.unionByName(refers).distinct().select("seq", F.lit("feat").alias("kind"), "q", "kv")
    nbr = refers.distinct().select("seq", F.lit("nbr").alias("kind"), F.col("kv").alias("q"), F.col("q").alias("kv"))
    return feat.unionByName(nbr).unionByName(cols)
