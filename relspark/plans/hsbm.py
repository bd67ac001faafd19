"""Foreign keys by a hierarchical stochastic block model: a descent of the levels for each row, over the shares of its own cluster."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.functions.rng import unit


def base_cluster(i: Column, n: int, hierarchy: list[int]) -> Column:
    """The finest cluster of row ``i`` of ``n``: contiguous blocks of equal size."""
    blocks = math.prod(hierarchy)
    return F.least(F.floor(i / max(1, -(-n // blocks))), F.lit(blocks - 1)).cast("int")


def digits(base: Column, hierarchy: list[int]) -> list[Column]:
    """The cluster at each level, coarsest first: mixed-radix digits of the finest."""
    below = [math.prod(hierarchy[i + 1 :]) for i in range(len(hierarchy))]
    return [(F.floor(base / b) % h).cast("int") for b, h in zip(below, hierarchy, strict=True)]


def level_matrices(parents: list[int], children: list[int], seed: int) -> list[np.ndarray]:
    """Per level the weights of (parent cluster, child cluster): small uniform noise, and 0.9 on the wrapped diagonal."""
    if len(parents) != len(children):
        raise ValueError("hierarchies have the same number of levels")
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(parents, children, strict=True):
        p = rng.uniform(0.001, 0.002, (a, b))
        for j in range(max(a, b)):
            p[j % a, j % b] = 0.9
        out.append(p)
    return out


def _sizes(n: int, blocks: int) -> np.ndarray:
    size = max(1, -(-n // blocks))
    return np.array([max(0, min(n, (k + 1) * size) - k * size) if k < blocks - 1 else max(0, n - k * size) for k in range(blocks)], float)


def descent_rows(n_parents: int, parents: list[int], children: list[int], seed: int) -> list[tuple[int, list[tuple[int, int, list[float], list[float]]]]]:
    """For each finest child cluster a step a level: (branches, edge, shares off the edge, shares on it).

    Shares are running, over the level's parent clusters, weighted by the parents that lie below. Clusters are blocks of equal size but for the last
    that has parents, the edge: a descent that has kept to the edge's branches takes the second shares, any other the first.
    One row a child cluster, each of as many numbers as the levels have clusters.
    """
    levels = level_matrices(parents, children, seed)
    size = _sizes(n_parents, math.prod(parents))
    last = int(np.flatnonzero(size)[-1])
    edge = [last // math.prod(parents[k + 1 :]) % h for k, h in enumerate(parents)]
    out = []
    for cb in range(math.prod(children)):
        off, on, steps = float(size[0]), float(size[last]), []
        for k in reversed(range(len(parents))):
            p = levels[k][:, cb // math.prod(children[k + 1 :]) % children[k]]
            full = p * off
            cut = np.where(np.arange(len(p)) < edge[k], full, 0.0)
            cut[edge[k]] = p[edge[k]] * on
            off, on = float(full.sum()), float(cut.sum())
            running = [(np.cumsum(w) / w.sum()).tolist() for w in (full, cut)]
            # what is left by rounding goes to the last branch
            running[0][-1] = 2.0
            running[1][edge[k] :] = [2.0] * (len(p) - edge[k])
            steps.append((parents[k], edge[k], *running))
        out.append((cb, steps[::-1]))
    return out


STEPS = "cb int, steps array<struct<branches:int,edge:int,off:array<double>,on:array<double>>>"


def descend(steps: Column, u: Column) -> Column:
    """The finest parent cluster that uniform ``u`` leads to: at each level the branch whose share holds it, then what is left of it within that share."""

    def step(at: Column, s: Column) -> Column:
        shares = F.when(at["on"], s["on"]).otherwise(s["off"])
        branch = F.size(F.filter(shares, lambda c: c <= at["u"]))
        low = F.when(branch == 0, 0.0).otherwise(F.try_element_at(shares, branch))
        high = F.least(F.try_element_at(shares, branch + 1), F.lit(1.0))
        return F.struct((at["a"] * s["branches"] + branch).alias("a"), ((at["u"] - low) / F.greatest(high - low, F.lit(1e-300))).alias("u"), (at["on"] & (branch == s["edge"])).alias("on"))

    start = F.struct(F.lit(0).alias("a"), u.alias("u"), F.lit(True).alias("on"))
    return F.aggregate(steps, start, step, lambda at: at["a"])


def assign(children: DataFrame, key: str, n_children: int, n_parents: int, child_levels: list[int], parent_levels: list[int], seed: int = 0, name: str = "parent") -> DataFrame:
    """``children(key: 0-based place)`` with ``name``: the drawn parent's place, one for each row.

    A first uniform descends the levels to the parent cluster, a second picks the parent within it. The shares come by a
    broadcast join on the child's cluster, a table of one row a cluster whatever the tables' sizes; a row takes as many steps as there are levels.
    """
    rows = descent_rows(n_parents, parent_levels, child_levels, seed)
    shares = children.sparkSession.createDataFrame(rows, STEPS)
    block = max(1, -(-n_parents // math.prod(parent_levels)))
    last = math.prod(parent_levels) - 1
    drawn = children.withColumns({"__cb": base_cluster(F.col(key), n_children, child_levels), "__u": unit(seed, "cluster", F.col(key)), "__v": unit(seed, "member", F.col(key))})
    met = drawn.join(F.broadcast(shares), F.col("__cb") == F.col("cb")).withColumn("__ca", descend(F.col("steps"), F.col("__u")).cast("long"))
    first = F.col("__ca") * block
    size = F.when(F.col("__ca") < last, F.least(F.lit(n_parents), first + block)).otherwise(F.lit(n_parents)) - first
    return met.select(*children.columns, (first + F.floor(F.col("__v") * size)).cast("long").alias(name))


def pair_weight(a: int, b: int, parents: list[int], children: list[int], seed: int) -> float:
    """The weight of one pair of finest clusters: the product of the levels' weights of their digits."""
    out = 1.0
    for k, p in enumerate(level_matrices(parents, children, seed)):
        out *= p[a // math.prod(parents[k + 1 :]) % parents[k], b // math.prod(children[k + 1 :]) % children[k]]
    return float(out)


def bipartite(children: DataFrame, key: str, n_children: int, n_parents: int, child_levels: list[int], parent_levels: list[int], seed: int = 0) -> DataFrame:
    """``parent, child`` with the finest cluster of either, ``parent_cluster, child_cluster``: the graph as a table of edges, one for each child."""
    edges = assign(children.select(key), key, n_children, n_parents, child_levels, parent_levels, seed)
    return edges.select("parent", F.col(key).alias("child"), base_cluster(F.col("parent"), n_parents, parent_levels).alias("parent_cluster"), base_cluster(F.col(key), n_children, child_levels).alias("child_cluster"))
