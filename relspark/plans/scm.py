"""Structural causal models of a table: a frozen graph on the driver, run over rows in Arrow batches.

Randomness is drawn by counter from (seed, node, row), so a value depends neither on batches nor on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.plans.dag import LAYOUTS, Dag, sample_dag
from relspark.storage import checkpointed


def _fold(xs: Column, start: float, step: Callable) -> Column:
    return F.aggregate(xs, F.lit(start), step)


def _logexp(xs: Column) -> Column:
    top = F.array_max(xs)
    return top + F.log(F.aggregate(F.transform(xs, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b))


#: Aggregations of an array of parents' values, by name.
AGGREGATIONS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda xs: _fold(xs, 0.0, lambda a, b: a + b),
    "max": lambda xs: F.array_max(xs),
    "product": lambda xs: _fold(xs, 1.0, lambda a, b: a * b),
    "logexp": _logexp,
}
_ARRAYS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "sum": lambda x: x.sum(axis=0),
    "max": lambda x: x.max(axis=0),
    "product": lambda x: x.prod(axis=0),
    "logexp": lambda x: x.max(axis=0) + np.log(np.exp(x - x.max(axis=0)).sum(axis=0)),
}


def _elu(x: np.ndarray, a: float = 1.0) -> np.ndarray:
    return np.where(x > 0, x, a * np.expm1(np.minimum(x, 0)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function to 2e-7, by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    fold = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - fold * np.exp(-x * x))


#: Activations by name.
ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "relu": lambda x: np.maximum(x, 0),
    "elu": _elu,
    "selu": lambda x: 1.0507009873554805 * _elu(x, 1.6732632423543772),
    "silu": lambda x: x * _sigmoid(x),
    "softsign": lambda x: x / (1 + np.abs(x)),
    "tanh": np.tanh,
    "sigmoid": _sigmoid,
    "hardswish": lambda x: x * np.clip(x + 3, 0, 6) / 6,
    "mish": lambda x: x * np.tanh(_softplus(x)),
    "leaky_relu": lambda x: np.where(x > 0, x, 0.01 * x),
    "gelu": lambda x: x * 0.5 * (1 + _erf(x / math.sqrt(2))),
    "softplus": _softplus,
    "hardsigmoid": lambda x: np.clip(x / 6 + 0.5, 0, 1),
    "hardtanh": lambda x: np.clip(x, -1, 1),
    "celu": _elu,
    "tanhshrink": lambda x: x - np.tanh(x),
    "rrelu": lambda x: np.where(x > 0, x, (1 / 8 + 1 / 3) / 2 * x),
    "logsigmoid": lambda x: -_softplus(-x),
    "softshrink": lambda x: np.sign(x) * np.maximum(np.abs(x) - 0.5, 0),
    "hardshrink": lambda x: np.where(np.abs(x) > 0.5, x, 0),
    "identity": lambda x: x,
    "abs": np.abs,
    "sin": np.sin,
    "cos": np.cos,
    "sign": np.sign,
    "clamp": lambda x: np.clip(x, -1, 1),
    "signed_log": lambda x: np.sign(x) * np.log1p(np.abs(x)),
    "bent_identity": lambda x: (np.sqrt(x * x + 1) - 1) / 2 + x,
}

#: Ranges of a sine mixture: components, frequencies (log-uniform).
SINES, FREQUENCIES = (3, 7), (0.1, 10.0)


@dataclass(frozen=True)
class SineMix:
    """A sum of sine waves whose number, heights, frequencies and phases are drawn once: a function that each layer has of its own."""

    heights: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray

    @classmethod
    def sample(cls, r: np.random.Generator) -> SineMix:
        n = int(r.integers(SINES[0], SINES[1] + 1))
        low, high = map(math.log, FREQUENCIES)
        return cls(r.normal(size=n), np.exp(r.uniform(low, high, n)), r.uniform(0, 2 * np.pi, n))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x, dtype=float)
        for h, f, p in zip(self.heights, self.frequencies, self.phases, strict=True):
            out += h * np.sin(f * x + p)
        return out


#: By this name a layer draws a mixture of its own; called by name it is one fixed mixture.
ACTIVATIONS["sine_mix"] = SineMix.sample(np.random.default_rng(0))


def _layer_activation(r: np.random.Generator) -> str | SineMix:
    """The name of a drawn activation, or a sine mixture of the layer's own."""
    name = str(r.choice(sorted(ACTIVATIONS)))
    return SineMix.sample(r) if name == "sine_mix" else name


def _truncated(r: np.random.Generator, i: int, o: int) -> np.ndarray:
    """Standard normals within two deviations."""
    x = r.normal(size=(i, o))
    while (far := np.abs(x) > 2).any():
        x[far] = r.normal(size=int(far.sum()))
    return x


def _sparse(r: np.random.Generator, i: int, o: int) -> np.ndarray:
    """Small normals, half of each output's inputs zero."""
    x = r.normal(0, 0.01, (i, o))
    x[r.permuted(np.tile(np.arange(i)[:, None], o), axis=0) < -(-i // 2)] = 0
    return x


#: Weight initialisers by name: (generator, inputs, outputs) -> matrix.
INITIALISERS: dict[str, Callable] = {
    "kaiming_normal": lambda r, i, o: r.normal(0, math.sqrt(2 / i), (i, o)),
    "kaiming_uniform": lambda r, i, o: r.uniform(-1, 1, (i, o)) * math.sqrt(6 / i),
    "xavier_normal": lambda r, i, o: r.normal(0, math.sqrt(2 / (i + o)), (i, o)),
    "xavier_uniform": lambda r, i, o: r.uniform(-1, 1, (i, o)) * math.sqrt(6 / (i + o)),
    "trunc_normal": _truncated,
    "sparse": _sparse,
}


def _counter(seed: int, stream: int, rows: np.ndarray) -> np.ndarray:
    """Uniforms in (0, 1) by mixing (seed, stream, row)."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64)) + np.uint64(stream * 0xD6E8FEB86659FD93 % (1 << 64))
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _normal(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


@dataclass
class Mlp:
    weights: list[np.ndarray]
    activations: list[str | SineMix]
    scales: list[float]

    @classmethod
    def sample(cls, r: np.random.Generator, inputs: int, outputs: int, hidden: int = 32) -> Mlp:
        layers = int(r.integers(2, 5))
        sizes = [inputs, *([hidden] * (layers - 1)), outputs]
        density = r.uniform(0.3, 1.0)
        init = INITIALISERS[str(r.choice(sorted(INITIALISERS)))]
        weights = []
        for i, o in zip(sizes, sizes[1:], strict=False):
            weights.append(init(r, i, o) * (r.random((i, o)) < density) / density)
        return cls(weights, [_layer_activation(r) for _ in weights[1:]], [math.exp(r.uniform(-1, 1)) for _ in weights[1:]])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for w, a, s in zip(self.weights, self.activations, self.scales, strict=False):
            x = np.clip(s * (ACTIVATIONS[a] if isinstance(a, str) else a)(x @ w), -1e6, 1e6)
        return np.clip(x @ self.weights[-1], -1e6, 1e6)


def _gamma(shape: float, tries: Callable[[int, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """``n`` exact draws of Gamma(shape), by squeezing a cubed normal and trying again where it is rejected (about one in twenty).

    ``tries(k, at)`` are uniforms of stream ``k`` for the draws ``at``: each draw has streams of its own, so it depends on no other.
    A shape below 1 is drawn one higher and scaled back by a power of a uniform.
    """
    d = (shape if shape >= 1 else shape + 1) - 1 / 3
    c = 1 / math.sqrt(9 * d)
    out, at, k = np.empty(n), np.arange(n), 1
    while len(at):
        x = _normal(tries(k, at), tries(k + 1, at))
        v = (1 + c * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            good = (v > 0) & (np.log(tries(k + 2, at)) < 0.5 * x * x + d * (1 - v + np.log(v)))
        out[at[good]] = d * v[good]
        at, k = at[~good], k + 3
    return out if shape >= 1 else out * tries(0, np.arange(n)) ** (1 / shape)


def beta(seed: int, stream: int, rows: np.ndarray, a: float, b: float) -> np.ndarray:
    """Exact draws of Beta(a, b) for ``rows``, by counter: the share of one gamma draw in two."""
    draw = lambda side: lambda k, at: _counter(seed * 1_000_003 + 2 * k + side + 1, stream, rows[at])
    x, y = (_gamma(shape, draw(side), len(rows)) for side, shape in enumerate((a, b)))
    # both can be nothing when both shapes are small
    return np.divide(x, x + y, out=np.full(len(rows), 0.5), where=x + y > 0)


EMBEDDING = 8
#: Random streams of a node.
STREAMS = 64


@dataclass(frozen=True)
class Source:
    """What a source node draws by row: the parameters of all kinds, of which its kind uses some."""

    kind: str
    a: float
    b: float
    rho: float
    shares: tuple[float, ...]

    @classmethod
    def sample(cls, r: np.random.Generator, categories: int) -> Source:
        shares = r.dirichlet(np.ones(categories)) if categories else ()
        return cls(str(r.choice(sorted(SOURCES))), float(r.uniform(0.5, 5)), float(r.uniform(0.05, 0.5)), float(r.uniform(0, 0.9)), tuple(map(float, shares)))


class Draws:
    """Uniforms of a node's streams for some rows of a table of ``n``."""

    def __init__(self, seed: int, node: int, rows: np.ndarray, n: int):
        self.seed, self.node, self.rows, self.n = seed, node, rows, max(n, 1)

    def uniform(self, stream: int, rows: np.ndarray | None = None) -> np.ndarray:
        return _counter(self.seed, STREAMS * self.node + stream, self.rows if rows is None else rows)

    def normal(self, stream: int, rows: np.ndarray | None = None) -> np.ndarray:
        return _normal(self.uniform(stream, rows), self.uniform(stream + 1, rows))

    def beta(self, stream: int, a: float, b: float) -> np.ndarray:
        return beta(self.seed, STREAMS * self.node + stream, self.rows, a, b)

    def ar1(self, stream: int, rho: float) -> np.ndarray:
        """AR(1) noise at the rows, from as many noises before each as weigh more than 1e-9."""
        taps = rho ** np.arange(1 if rho == 0 else math.ceil(math.log(1e-9) / math.log(rho)))
        low, high = int(self.rows.min()), int(self.rows.max())
        if high - low <= 8 * len(self.rows):
            e = self.normal(stream, np.arange(low - len(taps) + 1, high + 1))
            e[: max(0, len(taps) - 1 - low)] = 0  # before the table
            return np.convolve(e, taps, "valid")[self.rows - low]
        return sum(w * np.where(self.rows >= k, self.normal(stream, self.rows - k), 0) for k, w in enumerate(taps))

    def series(self, stream: int, s: Source, shift: float = 0.0) -> np.ndarray:
        """Trend, cycle and AR(1) noise over the rows' places, each within -1 and 1, averaged."""
        at = self.rows / self.n
        noise = np.clip(s.b * self.ar1(stream, s.rho), -1, 1)
        return (np.minimum(2 * at ** min(s.a + shift, 2.0) - 1, 1) + np.sin(np.pi * (at / s.b + shift)) + noise) / 3


def _category(u: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The first category whose running share exceeds ``u``; ``shares`` are one row for all or one a row."""
    run = np.cumsum(np.atleast_2d(shares), axis=1)
    return np.minimum((u[:, None] >= run / run[:, -1:]).sum(axis=1), run.shape[1] - 1).astype(float)


def _independent(d: Draws, s: Source) -> np.ndarray:
    return _category(d.uniform(6), np.array(s.shares))


def _series_category(d: Draws, s: Source) -> np.ndarray:
    """A draw from the softmax of a series for each category."""
    x = np.exp(np.stack([d.series(8 + 2 * (k % 20), s, k / len(s.shares)) for k in range(len(s.shares))], axis=1))
    return _category(d.uniform(6), x)


def _mixed(d: Draws, s: Source) -> np.ndarray:
    each = [SOURCES[k][0](d, s) for k in ("uniform", "gaussian", "beta")]
    return np.choose(np.floor(3 * d.uniform(7)).astype(int), each)


#: Kinds of source nodes by name: a number in [-1, 1], and a category, from a node's draws.
SOURCES: dict[str, tuple[Callable[[Draws, Source], np.ndarray], Callable[[Draws, Source], np.ndarray]]] = {
    "uniform": (lambda d, s: 2 * d.uniform(0) - 1, _independent),
    "gaussian": (lambda d, s: np.clip(d.normal(1) / 2, -1, 1), _independent),
    "beta": (lambda d, s: 2 * d.beta(3, s.a, 10 * s.b) - 1, _independent),
    "ts": (lambda d, s: d.series(4, s), _series_category),
    "mixed": (_mixed, _independent),
}


@dataclass
class Scm:
    """A table's causal graph. Some nodes are its columns; ``categories`` holds the number of categories, 0 for a number.

    Values are encoded along edges, numbers as they are and categories by an embedding, aggregated with the noise of
    the node, and decoded: a number as an output, a category as that of the most similar embedding.
    """

    seed: int
    dag: Dag
    columns: dict[str, int]
    categories: dict[int, int]
    sources: dict[int, Source]
    embeddings: dict[int, np.ndarray]
    encoders: dict[tuple[int, int], Mlp]
    decoders: dict[int, Mlp]
    aggregation: dict[int, str]
    noise: dict[int, tuple[float, float]]
    foreign: list[Mlp] = field(default_factory=list)
    foreign_embeddings: list[np.ndarray | None] = field(default_factory=list)
    foreign_shares: list[float] = field(default_factory=list)

    @classmethod
    def sample(cls, columns: dict[str, int], seed: int, parents: list[list[int]] | None = None, layout: str | None = None) -> Scm:
        """``columns``: names to numbers of categories (0: a number). ``parents``: for each parent table the numbers of categories of all its columns.

        Each parent column has an encoder for this child, and a categorical one a table of embeddings.
        """
        features = [(k, 1 / len(table)) for table in parents or [] for k in table]
        r = np.random.default_rng(seed)
        n = len(columns) + math.ceil(len(columns) / r.uniform(0.3, 0.9)) + 3
        dag = sample_dag(n, layout or str(r.choice(sorted(LAYOUTS))), seed)
        at = r.choice(n, len(columns), replace=False).tolist()
        categories = {v: int(r.integers(2, 11)) if r.random() < 0.5 else 0 for v in range(n)}
        categories |= dict(zip(at, columns.values(), strict=True))
        roots = [v for v in range(n) if not dag.parents(v)]
        inner = [v for v in range(n) if v not in roots]
        return cls(
            seed, dag, dict(zip(columns, at, strict=True)), categories,
            {v: Source.sample(r, categories[v]) for v in roots},
            {v: r.normal(size=(k, EMBEDDING)) for v, k in categories.items() if k},
            {(p, v): Mlp.sample(r, EMBEDDING if categories[p] else 1, EMBEDDING) for p, v in dag.edges},
            {v: Mlp.sample(r, EMBEDDING, EMBEDDING if categories[v] else 1) for v in inner},
            {v: str(r.choice(sorted(_ARRAYS))) for v in inner},
            {v: (float(r.uniform(0.5, 5)), float(r.uniform(0.5, 5))) for v in inner},
            [Mlp.sample(r, EMBEDDING if k else 1, EMBEDDING) for k, _ in features],
            [r.normal(size=(k, EMBEDDING)) if k else None for k, _ in features],
            [share for _, share in features],
        )

    def encoded(self, p: int, v: int, value: np.ndarray) -> np.ndarray:
        """The embedding of node ``p``'s value on its edge to ``v``."""
        return self.encoders[p, v](self.embeddings[p][value.astype(int)] if self.categories[p] else value[:, None])

    def encoded_parents(self, foreign: np.ndarray) -> list[np.ndarray]:
        """The embeddings of the parents' columns, once for all nodes; a missing number is 0 and a missing category no direction."""
        out = []
        for f, (mlp, table) in enumerate(zip(self.foreign, self.foreign_embeddings, strict=True)):
            x = foreign[:, f]
            if table is None:
                out.append(mlp(np.nan_to_num(x)[:, None]))
            else:
                there = np.isfinite(x)
                code = np.where(there, x, 0).astype(int) % len(table)
                out.append(mlp(table[code] * there[:, None]))
        return out

    def decoded(self, v: int, x: np.ndarray) -> np.ndarray:
        out = self.decoders[v](x)
        return (out @ self.embeddings[v].T).argmax(axis=1).astype(float) if self.categories[v] else out[:, 0]

    def node_noise(self, v: int, rows: np.ndarray) -> np.ndarray:
        """A draw of the node's Beta distribution for each dimension of each row, over their number."""
        d = Draws(self.seed, v, rows, 1)
        return np.stack([d.beta(50 + k, *self.noise[v]) for k in range(EMBEDDING)], axis=1) / EMBEDDING

    def run(self, rows: np.ndarray, n: int, foreign: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """The columns' values for these rows of a table of ``n``; ``foreign`` holds their parents' features. Sources ignore it."""
        values: dict[int, np.ndarray] = {}
        above = self.encoded_parents(foreign) if foreign is not None and self.foreign else []
        for layer in self.dag.generations():
            for v in layer:
                if v in self.sources:
                    s = self.sources[v]
                    values[v] = SOURCES[s.kind][bool(self.categories[v])](Draws(self.seed, v, rows, n), s)
                    continue
                how = self.aggregation[v]
                parts = [self.dag.edges[p, v] * self.encoded(p, v, values[p]) for p in self.dag.parents(v)]
                parts += [(share if how == "sum" else 1.0) * x for share, x in zip(self.foreign_shares, above, strict=False)]
                met = _ARRAYS[how](np.stack([np.clip(x, -1e4, 1e4) for x in parts]))
                values[v] = self.decoded(v, np.clip(self.node_noise(v, rows) + met, -1e6, 1e6))
        return {c: values[v] for c, v in self.columns.items()}


def quantize(rows: DataFrame, key: str, n: int, columns: dict[str, int], seed: int) -> DataFrame:
    """``rows`` with each of ``columns`` (name to number of classes) cut at its values in drawn rows, codes permuted or reversed by chance.

    The driver sees the drawn rows alone: classes - 1 values a column.
    """
    from relspark.operators.stats import quantized

    r = np.random.default_rng(seed)
    for c, k in columns.items():
        at = r.integers(0, max(n, 1), k - 1).tolist()
        values = {x[key]: x[c] for x in rows.filter(F.col(key).isin(at)).select(key, c).collect()}
        bounds = sorted(float(values[a]) for a in at if a in values)
        order = r.permutation(len(bounds) + 1).tolist() if r.random() < r.uniform(0.3, 1.0) else None
        rows = rows.withColumn(c, quantized(F.col(c), bounds, order, bool(r.random() < r.uniform(0.2, 0.8))).cast("long"))
    return rows


class Eager:
    """Categories are nodes of the model and decoded inside it."""

    #: Whether a child sees this table's categories as such.
    codes = True

    def modelled(self, columns: dict[str, int]) -> dict[str, int]:
        """The columns as the model has them."""
        return columns

    def finished(self, rows: DataFrame, key: str, n: int, columns: dict[str, int], seed: int) -> DataFrame:
        """The table, from what the model made."""
        return rows


class Lazy(Eager):
    """The model has numbers only; categories are cut from them afterwards."""

    codes = False

    def modelled(self, columns: dict[str, int]) -> dict[str, int]:
        return dict.fromkeys(columns, 0)

    def finished(self, rows: DataFrame, key: str, n: int, columns: dict[str, int], seed: int) -> DataFrame:
        cut = {c: k for c, k in columns.items() if k}
        return quantize(checkpointed(rows), key, n, cut, seed) if cut else rows


#: How a table's categories come about, by name.
STRATEGIES: dict[str, Eager] = {"eager": Eager(), "lazy": Lazy()}


def propagate(rows: DataFrame, key: str, n: int, scm: Scm, foreign: list[str] | None = None) -> DataFrame:
    """``rows`` (``key``: place from 0; ``foreign``: parents' features) with the model's columns: numbers as double, codes as long.

    Rows are independent, so it is one map without a shuffle.
    """
    shared = rows.sparkSession.sparkContext.broadcast(scm)
    names = list(scm.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if not len(b):
                continue
            at = b.column(key).to_numpy(zero_copy_only=False)
            extra = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in foreign], axis=1) if foreign else None
            out = m.run(at, n, extra)
            cols = [pa.array(out[c].astype(np.int64) if m.categories[m.columns[c]] else out[c]) for c in names]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    kinds = ", ".join(f"`{c}` {'long' if scm.categories[scm.columns[c]] else 'double'}" for c in names)
    return rows.mapInArrow(run, f"{schema}, {kinds}")
