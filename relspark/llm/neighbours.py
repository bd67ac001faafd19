"""Approximate nearest neighbours: randomly rotated one-bit codes, error bounds, exact reranking.

A unit vector o is rotated at random and coded by the signs of its coordinates, packed to bits. With
the code's unit vector c, the inner product of o and a query q is estimated by <c, q> / <c, o>, and it
lies within EPSILON * sqrt((1 - <c, o>^2) / <c, o>^2 / (D - 1)) of that but for a vanishing share of
the pairs. The best estimates are compared exactly first; what their k-th best beats by more than the
error bound is never compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from relspark.llm.common import checkpointed

SEED = 11
EPSILON = 3.0
#: Numbers in a block of vectors, which a task holds, and queries of a block, which it reads in turn.
NUMBERS, QUERIES = 1 << 22, 65_536
#: Vectors of a block at least, as far as more tasks than the cluster runs at once would be made.
LEAST_VECTORS = 4096
#: Pairs whose estimates are held at once.
PAIRS = 1 << 21
#: Allowance for rounding in estimates of single precision.
SLACK = 1e-5


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed sign bits of each rotated row of ``x`` (any length but zero), and <c, o>."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit @ rotation(x.shape[1])
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1])


def turned_queries(queries: np.ndarray) -> np.ndarray:
    """The rotated unit vectors of queries, in single precision."""
    return ((queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ rotation(queries.shape[1])).astype(np.float32)


class Codes:
    """Packed codes and factors of vectors, as they are compared with queries."""

    def __init__(self, packed: np.ndarray, factor: np.ndarray, dim: int):
        self.signs = (np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1).T
        self.scale = (1 / (math.sqrt(dim) * factor)).astype(np.float32)
        self.error = (EPSILON * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1)) + SLACK).astype(np.float32)

    def estimates(self, turned: np.ndarray) -> np.ndarray:
        """Estimated inner products of rotated unit queries (rows) and vectors (columns)."""
        out = turned @ self.signs
        out *= self.scale
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id long, v array`` of the vectors that can take part; floats stay floats, other numbers become doubles.

    Null, empty and zero vectors, those with a null or non-finite component, and null ids are left out.
    """
    kind = vectors.select(vec_col).schema[0].dataType
    kind = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact cosines, each pair computed on its own so that equal vectors tie; first scaled against overflow."""
    q, x = q / np.abs(q).max(), x / np.abs(x).max(axis=1, keepdims=True)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


class Block:
    """A block of vectors: ids, codes, and the vectors themselves for reranking."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        x = v.astype(np.float64)
        self.codes = Codes(*codes(x / np.abs(x).max(axis=1, keepdims=True)), v.shape[1])
        self.alone = len(np.unique(ids)) == len(ids)

    def best(self, at: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The ``k`` best ids, each once, among the vectors ``at``."""
        score = cosine(q, self.v[at].astype(np.float64))
        order = np.lexsort((self.ids[at], -score))
        if self.alone:
            order = order[:k]
        else:
            ids = self.ids[at][order]
            order = order[np.sort(np.unique(ids, return_index=True)[1])[:k]]
        return [(int(self.ids[at[i]]), float(score[i])) for i in order]

    def nearest(self, qid: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """(query, id, score): the k nearest of the block to each query, its own id left out."""
        n = len(self.ids)
        step, first = max(1, PAIRS // n), min(n, 4 * k)
        for a in range(0, len(qid), step):
            own, vec = qid[a : a + step], q[a : a + step].astype(np.float64)
            estimate = self.codes.estimates(turned_queries(vec / np.abs(vec).max(axis=1, keepdims=True)))
            estimate[own[:, None] == self.ids] = -np.inf
            top = np.argpartition(estimate, n - first, axis=1)[:, n - first :]
            estimate += self.codes.error
            for row, near, i, x in zip(estimate, top, own.tolist(), vec, strict=True):
                found = self.best(near[self.ids[near] != i], x, k)
                least = found[-1][1] - SLACK if len(found) == k else -2.0
                # a query's own vectors stand at minus infinity
                for j, s in self.best(np.flatnonzero(row >= least), x, k):
                    yield i, j, s


def _blocks(dim: int) -> tuple:
    """A function over rows sorted by block, vectors before queries, to the pairs found in each block."""

    def run(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        at, ids, raw, block = None, [], [], None
        for b in batches:
            g, asks = b.column("g").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            each, own = b.column("id").to_numpy(), b.column("v")
            v = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (asks[1:] != asks[:-1])) + 1
            found: list[tuple[int, int, float]] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
                if lo == hi:
                    continue
                if g[lo] != at:
                    at, ids, raw, block = g[lo], [], [], None
                if not asks[lo]:
                    ids.append(each[lo:hi])
                    raw.append(v[lo:hi])
                elif ids:
                    block = block or Block(np.concatenate(ids), np.concatenate(raw))
                    found += block.nearest(each[lo:hi], v[lo:hi], k)
            if found:
                q, i, s = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of largest cosine to each query, its own id left out.

    All vectors are coded and searched. Each vector goes to one of several blocks of bounded size, and
    queries pass by every block, so a task holds a block and reads queries in turn. ``score`` is the
    exact cosine in double precision; ties go to the smaller id. Vectors that cannot take part (see
    ``usable``), and those whose length is not the most common one among ``vectors`` (ties: the longest),
    are neither queries nor found. Rows of one id count once, by the nearest pair; fewer than ``k``
    candidates are all returned; an empty table gives an empty result. Columns other than ``id_col``
    and ``vec_col`` are ignored.
    """
    base, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    # repeated rows go before blocks are cut, so that a row repeated many times is one
    base = checkpointed(base.distinct())
    sizes = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim, n = (sizes["dim"], sizes["count"]) if sizes else (1, 0)
    asked = asked.filter(F.size("v") == dim).distinct()
    m = asked.count()
    nb, mb = _cut(n, m, dim, base.sparkSession.sparkContext.defaultParallelism)
    vb = F.pmod(F.xxhash64("id", "v"), F.lit(nb)).cast("int")
    qb = F.pmod(F.xxhash64("id"), F.lit(mb)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = base.filter(F.size("v") == dim).select(vb.alias("vb"), every(mb).alias("qb"), F.lit(False).alias("asks"), "id", "v")
    right = asked.select(every(nb).alias("vb"), qb.alias("qb"), F.lit(True).alias("asks"), "id", "v")
    rows = left.unionByName(right).withColumn("g", F.col("vb") * mb + F.col("qb")).select("g", "asks", "id", "v")
    run = _blocks(dim)
    dealt = rows.repartition(nb * mb, "g").sortWithinPartitions("g", "asks")
    found = dealt.mapInArrow(lambda batches: run(batches, k), "query_id long, vec_id long, score double")
    # at most k rows a query and block
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cut(n: int, m: int, dim: int, cores: int) -> tuple[int, int]:
    """Blocks of vectors and of queries: as few as their bounds allow, or as keep twice the cores busy with the least copying.

    Vectors are copied once a block of queries, and queries once a block of vectors.
    """
    nb, mb = max(1, -(-n * dim // NUMBERS)), max(1, -(-m // QUERIES))
    tasks = min(2 * cores, max(1, n // LEAST_VECTORS))
    if nb * mb < tasks:
        mb = max(mb, round(math.sqrt(tasks * m / max(n, 1))))
        nb = max(nb, -(-tasks // mb))
    return nb, mb
