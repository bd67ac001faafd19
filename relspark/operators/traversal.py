"""Exact traversal in time: the visits of a seed in the order in which one walker would make them.

A walker goes up before it goes down. It keeps a stack of parents and a list of children for each depth. While the
stack holds anything it takes the last parent; else a random node of the shallowest depth that has any. A node visited
before at no greater depth is skipped; one visited deeper is visited again. A visited node's parents go on the stack
and a sample of its visible children goes to the next depth. The walk ends before the node that would fill the budget of cells.

Children only ever go to depths below the one at work, so a depth's nodes are all known when its turn comes, and random
choices without replacement are a random order: here that of a keyed hash. So all seeds walk in step, a depth a round. In a
round, one join samples the children of the nodes one depth above (no others: most walks end before deeper nodes have their turn),
another fetches what walkers may need (the parents' parents of the depth's first nodes, as far as the budget can
reach), and a cogroup by seed hands it to each walker with what it knows. A walker's memory is its visits and one depth's candidates,
both bounded by the budget.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relspark.catalog import RelationalDB, epoch_seconds
from relspark.operators.sampler import Adjacency
from relspark.storage import bucketed, checkpointed


class NodeSpace:
    """Node ids of a database: a table's integer keys, moved by the table's base. One scan of keys a table, no join."""

    def __init__(self, db: RelationalDB):
        self.db, self.base, self.rows = db, {}, {}
        at = 0
        for name in sorted(db.specs):
            key = db.specs[name].pkey or "row_key"
            self.rows[name] = db.tables[name] if db.specs[name].pkey else db.keyed(name)
            low, high = self.rows[name].agg(F.min(key), F.max(key)).first()
            self.base[name] = at - (low or 0)
            at += (high or 0) - (low or 0) + 1
        #: The first id that no table has.
        self.end = at

    def node(self, table: str, key: Column) -> Column:
        return (key + F.lit(self.base[table])).cast("long")

    def key(self, table: str) -> str:
        return self.db.specs[table].pkey or "row_key"

    def _time(self, table: str) -> Column:
        t = self.db.specs[table].time_col
        return epoch_seconds(F.col(t)) if t else F.lit(None).cast("long")

    def nodes(self) -> DataFrame:
        """``node, table, ts`` of every row of every table."""
        parts = [self.rows[t].select(self.node(t, F.col(self.key(t))).alias("node"), F.lit(t).alias("table"), self._time(t).alias("ts")) for t in self.db.specs]
        return _union(parts)

    def edges(self) -> DataFrame:
        """``child_key, parent_key, child_ts, pos`` of every foreign key that has its parent; ``pos`` is the key's place among its table's."""
        parts = []
        for child, spec in self.db.specs.items():
            for pos, (column, parent) in enumerate(spec.fkeys.items()):
                up = self.db.tables[parent].select(F.col(self.db.specs[parent].pkey).cast("long").alias("p"))
                own = self.rows[child].select(self.node(child, F.col(self.key(child))).alias("child_key"), F.col(column).cast("long").alias("k"), self._time(child).alias("child_ts"))
                met = own.join(up, F.col("k") == F.col("p"))
                parts.append(met.select("child_key", self.node(parent, F.col("p")).alias("parent_key"), "child_ts", F.lit(pos).alias("pos")))
        return _union(parts)


    def sizes(self) -> DataFrame:
        """``node, n_cells`` of every row: its features that are neither null nor NaN."""
        parts = []
        for t, spec in self.db.specs.items():
            valued = [F.when(F.col(f"`{f.name}`").isNotNull() & (~F.isnan(f"`{f.name}`") if f.dataType.typeName() in ("double", "float") else F.lit(True)), 1).otherwise(0) for f in self.db.tables[t].schema if f.name not in {spec.pkey, *spec.fkeys}]
            parts.append(self.rows[t].select(self.node(t, F.col(self.key(t))).alias("node"), sum(valued, F.lit(0)).cast("long").alias("n_cells")))
        return _union(parts)

    def cells(self) -> DataFrame:
        """``node, table, column, cell, sem_type, num, txt`` of every feature value; ``cell`` is the column's place in its row."""
        from relspark.operators import graph

        parts = []
        for t, spec in self.db.specs.items():
            place = F.create_map(*(x for i, f in enumerate(self.db.tables[t].schema) for x in (F.lit(f"{f.name} of {t}"), F.lit(i))))
            flat = graph.cells(self.rows[t], t, self.key(t), {self.key(t), spec.pkey, *spec.fkeys})
            parts.append(flat.select(self.node(t, F.col("node_key")).alias("node"), F.lit(t).alias("table"), "column", place[F.col("column")].alias("cell"), "sem_type", "num", "txt"))
        return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


STEPS = "array<struct<child:long,parent:long,pos:int,cells:long>>"


def ancestors(edges: DataFrame, sizes: DataFrame, generations: int = 16) -> DataFrame:
    """``node, steps``: for every row that refers to another, the edges to its parents, their parents and so on, each with the parent's cells.

    One join a generation, until there are no more; a row has few of them, as schemas are shallow. Made once a graph.
    """
    pos = F.col("pos").cast("int").alias("pos") if "pos" in edges.columns else F.lit(0).alias("pos")
    up = edges.select(F.col("child_key").alias("child"), F.col("parent_key").alias("parent"), pos)
    cells = sizes.select(F.col("node").alias("parent"), F.col("n_cells").cast("long").alias("cells"))
    up = checkpointed(up.join(cells, "parent", "left").select("child", "parent", "pos", F.coalesce("cells", F.lit(0)).alias("cells")))
    step = found = up.select(F.col("child").alias("node"), "*")
    for _ in range(generations - 1):
        front = step.select("node", F.col("parent").alias("child")).distinct()
        step = checkpointed(front.join(up, "child").select("node", "child", "parent", "pos", "cells"))
        if step.isEmpty():
            break
        found = found.unionByName(step)
    return found.groupBy("node").agg(F.collect_set(F.struct("child", "parent", "pos", "cells")).alias("steps"))


VISIT = "seed_key long, at int, node long, depth int, used long"


def _walk(depth: int, length: int):  # noqa: ANN202
    """The walkers' turn at ``depth``: from a seed's visits so far and its candidates, its new visits.

    ``used`` counts the cells up to and with a visit; a last row of node null says that the walk is over.
    """

    def run(known: pa.Table, here: pa.Table) -> pa.Table:
        key = (known if known.num_rows else here).column("seed_key")[0].as_py()
        seen: dict[int, int] = {}
        at, used = 0, 0
        for n, d, a, u in zip(*(known.column(c).to_pylist() for c in ("node", "depth", "at", "used")), strict=True):
            seen[n] = min(d, seen.get(n, d))
            at, used = max(at, a + 1), max(used, u)
        nodes, cells, steps = (here.column(c).to_pylist() for c in ("node", "n_cells", "steps"))
        draws = here.column("r").to_pylist()
        order = sorted(range(len(nodes)), key=lambda i: (draws[i], nodes[i]))
        parents: dict[int, list[tuple[int, int]]] = {}
        size = dict(zip(nodes, cells, strict=True))
        for each in steps:
            for s in each:
                size[s["parent"]] = s["cells"]
                parents.setdefault(s["child"], [])
                if (s["pos"], s["parent"]) not in parents[s["child"]]:
                    parents[s["child"]].append((s["pos"], s["parent"]))
        out: list[tuple[int, int | None, int, int]] = []
        for i in order:
            stack = [(depth, nodes[i])]
            while stack:
                d, n = stack.pop()
                if seen.get(n, d + 1) <= d:
                    continue
                used += size[n]
                if used >= length:
                    out.append((at, None, d, used))
                    stack = None
                    break
                seen[n] = d
                out.append((at, n, d, used))
                at += 1
                stack += [(d + 1, p) for _, p in sorted(parents.get(n, []))]
            if stack is None:
                break
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table(
            {"seed_key": pa.array(np.full(len(out), key, np.int64)), "at": pa.array(columns[0], pa.int32()), "node": pa.array(columns[1], pa.int64()), "depth": pa.array(columns[2], pa.int32()), "used": pa.array(columns[3], pa.int64())}
        )

    return run


def traverse(seeds: DataFrame, edges: DataFrame, sizes: DataFrame, length: int, width: int, seed: int = 0, generations: int = 16, depths: int = 64) -> DataFrame:
    """``seed_key, at, node, depth, used``: each seed's visits in order, ``at`` from 0, while ``used``, the cells so far, stays below ``length``.

    ``seeds(seed_key, seed_ts, node)`` and ``edges(child_key, parent_key, child_ts)`` may have ``task``, as for ``sampler.Adjacency``, which
    draws up to ``width`` children; ``pos`` orders a row's parents. ``sizes(node, n_cells)`` may lack nodes, which count none. A node
    that is found again at a smaller depth is visited again and counts again. Edges form no cycle and are at most
    ``generations`` deep; a walk of more than ``depths`` depths ends there. Without seeds there are no visits; equal inputs give equal visits under any partitioning.
    """
    front = (seeds if "task" in seeds.columns else seeds.withColumn("task", F.lit(None).cast("string"))).select("seed_key", "seed_ts", "task", "node")
    front = checkpointed(front)
    cells = sizes.select("node", F.col("n_cells").cast("long").alias("n_cells"))
    sized = edges.drop("pos").join(cells.withColumnRenamed("node", "child_key"), "child_key", "left").fillna(0, ["n_cells"])
    graph, above = Adjacency(sized, stored=True, carried=["n_cells"]), bucketed(ancestors(edges, sizes, generations), ["node"])
    visits = over = None
    # walkers are dealt to all tasks: their rows are few bytes and much work
    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def reachable(found: DataFrame, depth: int) -> DataFrame:
        """Of ``found(seed_key, node, r, n_cells)`` at ``depth``, what was not visited at such a depth, in order of r as far as its own cells leave any of a seed's budget: a walk goes no further.

        Finds and visits are dealt by seed, once.
        """
        none = lambda kind: F.lit(None).cast(kind)
        both = found.select("seed_key", "node", "r", "n_cells", none("int").alias("low"), none("long").alias("used"))
        both = both.unionByName(visits.select("seed_key", "node", none("long").alias("r"), none("long").alias("n_cells"), F.col("depth").alias("low"), "used"))
        once = both.repartition(parts, "seed_key").groupBy("seed_key", "node").agg(F.max("r").alias("r"), F.max("n_cells").alias("n_cells"), F.min("low").alias("low"), F.max("used").alias("used"))
        new = once.withColumn("used", F.max("used").over(Window.partitionBy("seed_key"))).filter(F.col("r").isNotNull() & (F.col("low").isNull() | (F.col("low") > depth)))
        w = Window.partitionBy("seed_key").orderBy("r", "node").rowsBetween(Window.unboundedPreceding, -1)
        return new.withColumn("before", F.coalesce(F.sum("n_cells").over(w), F.lit(0))).filter(F.col("before") + F.col("used") < length).select("seed_key", "node", "r", "n_cells")

    for depth in range(depths):
        if visits is None:
            known = seeds.sparkSession.createDataFrame([], VISIT)
            here = front.select("seed_key", "node", F.lit(0).cast("long").alias("r")).join(cells, "node", "left").fillna(0, ["n_cells"])
        else:
            known = visits.join(over, "seed_key", "left_anti")
            # a node visited twice has its children at the smaller depth; at the other they would be skipped
            low = checkpointed(known.groupBy("seed_key", "node").agg(F.min("depth").alias("depth")).filter(F.col("depth") >= depth - 1))
            now, later = low.agg(F.count_if(F.col("depth") == depth - 1), F.count_if(F.col("depth") >= depth)).first()
            if not now and not later:
                break
            if not now:
                continue
            asking = low.filter(F.col("depth") == depth - 1).join(front.drop("node"), "seed_key").select("seed_key", "seed_ts", "task", "node")
            found = graph.sampled(asking, width, seed).select("seed_key", F.col("child_key").alias("node"), "r", "n_cells")
            here = reachable(found, depth)
        asked = here.join(above, "node", "left").select(F.col("seed_key").alias("seed_key"), "node", "r", "n_cells", F.coalesce("steps", F.array().cast(STEPS)).alias("steps"))
        walkers = known.repartition(parts, "seed_key").groupBy("seed_key").cogroup(asked.repartition(parts, "seed_key").groupBy("seed_key"))
        new = checkpointed(walkers.applyInArrow(_walk(depth, length), VISIT))
        made, ended = new.filter("node IS NOT NULL"), new.filter("node IS NULL").select("seed_key")
        visits, over = (made, ended) if visits is None else (visits.unionByName(made), over.unionByName(ended))
    return visits if visits is not None else seeds.sparkSession.createDataFrame([], VISIT)


def visited_cells(visits: DataFrame, seeds: DataFrame, times: DataFrame, cells: DataFrame, target: str, dropped: list[str], length: int) -> DataFrame:
    """``seed_key, pos, at, node, ts, column, ..., is_target``: the first ``length`` cells of the nodes in order of their first visits, sorted by column.

    ``cells(node, column, cell int, ...)``: ``cell`` orders a node's cells. ``dropped`` columns are left out at the seed and at rows of its very time (or
    both without one) before cells are counted. Target values of other rows stay.
    """
    first = visits.groupBy("seed_key", "node").agg(F.min("at").alias("at"))
    own = seeds.select("seed_key", "seed_ts", F.col("node").alias("seed_node"))
    rows = first.join(times, "node", "left").join(own, "seed_key").join(cells, "node")
    leak = F.col("column").isin(dropped) & ((F.col("node") == F.col("seed_node")) | F.col("ts").eqNullSafe(F.col("seed_ts")))
    w = Window.partitionBy("seed_key").orderBy("at", "cell")  # a context's visits hold fewer than length cells, so these windows are small
    kept = rows.filter(~leak).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= length)
    pos = F.row_number().over(Window.partitionBy("seed_key").orderBy("column", "__n")) - 1
    is_target = (F.col("node") == F.col("seed_node")) & (F.col("column") == target)
    return kept.withColumn("pos", pos).withColumn("is_target", is_target).drop("__n", "cell", "seed_node", "seed_ts")
