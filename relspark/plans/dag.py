"""Random directed acyclic graphs of a schema's or a causal model's size (driver side: at most some hundred nodes)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Edge = tuple[int, int]


@dataclass
class Dag:
    n: int
    edges: dict[Edge, float] = field(default_factory=dict)

    def parents(self, node: int) -> list[int]:
        return sorted(a for a, b in self.edges if b == node)

    def generations(self) -> list[list[int]]:
        """Nodes by depth; raises on a cycle."""
        depth: dict[int, int] = {}
        while len(depth) < self.n:
            ready = [v for v in range(self.n) if v not in depth and all(p in depth for p in self.parents(v))]
            if not ready:
                raise ValueError("the graph has a cycle")
            depth |= {v: max((depth[p] + 1 for p in self.parents(v)), default=0) for v in ready}
        return [[v for v in range(self.n) if depth[v] == d] for d in range(max(depth.values(), default=-1) + 1)]

    def components(self) -> list[list[int]]:
        low = list(range(self.n))
        for _ in range(self.n):
            for a, b in self.edges:
                low[a] = low[b] = min(low[a], low[b])
        return [[v for v in range(self.n) if low[v] == r] for r in sorted(set(low))]


WEIGHTS: dict[str, Callable[[np.random.Generator], float]] = {
    "gaussian": lambda r: float(r.normal()),
    "lognormal": lambda r: float(r.lognormal()),
    "cauchy": lambda r: float(r.standard_cauchy()),
    "uniform": lambda r: float(r.uniform(-2, 2)),
}


def _connected(n: int, pairs: set[Edge], r: np.random.Generator) -> set[Edge]:
    """Joins components one after the other by a random edge, each oriented from the lower to the higher node."""
    out = {(min(a, b), max(a, b)) for a, b in pairs if a != b}
    parts = Dag(n, dict.fromkeys(out, 0.0)).components()
    for one, two in zip(parts, parts[1:], strict=False):
        a, b = int(r.choice(one)), int(r.choice(two))
        out.add((min(a, b), max(a, b)))
    return out


def erdos_renyi(n: int, r: np.random.Generator, p: float | None = None) -> set[Edge]:
    p = r.uniform(0.3, 0.8) if p is None else p
    return _connected(n, {(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 1 - (1 - p) ** 2}, r)


def barabasi_albert(n: int, r: np.random.Generator, m: int = 2, sink_dropout: float = 0.4, sink_flip: float = 0.0) -> set[Edge]:
    """Preferential attachment, shuffled names; sinks of several parents may lose one in-edge, those of one may flip it."""
    pairs: set[Edge] = set()
    ends: list[int] = list(range(min(m, n)))
    for v in range(min(m, n), n):
        to: set[int] = set()
        while len(to) < min(m, v):
            to.add(int(r.choice(ends)) if ends else int(r.integers(v)))
        pairs |= {(u, v) for u in to}
        ends += [*to, *([v] * len(to))]
    name = r.permutation(n)
    out = {(int(name[a]), int(name[b])) for a, b in _connected(n, pairs, r)}
    sinks = [v for v in range(n) if not any(a == v for a, _ in out)]
    for v in sinks:
        into = sorted(a for a, b in out if b == v)
        if len(into) > 1 and r.random() < sink_dropout:
            trial = out - {(int(r.choice(into)), v)}
            out = trial if len(Dag(n, dict.fromkeys(trial, 0.0)).components()) == 1 else out
        elif len(into) == 1 and r.random() < sink_flip:
            out = out - {(into[0], v)} | {(v, into[0])}
    return out


def _tree(n: int, r: np.random.Generator) -> set[Edge]:
    """A uniform labelled tree, from its Prüfer sequence."""
    if n < 2:
        return set()
    seq = r.integers(0, n, max(0, n - 2)).tolist()
    degree = [1 + seq.count(v) for v in range(n)]
    out = set()
    for v in seq:
        leaf = degree.index(1)
        out.add((leaf, v))
        degree[leaf] -= 1
        degree[v] -= 1
    a, b = [v for v in range(n) if degree[v] == 1]
    return out | {(a, b)}


def random_tree(n: int, r: np.random.Generator) -> set[Edge]:
    """Oriented away from a random root."""
    pairs, root = _tree(n, r), int(r.integers(n))
    out, seen = set(), {root}
    while len(seen) < n:
        step = {(a, b) if a in seen else (b, a) for a, b in pairs if (a in seen) != (b in seen)}
        out |= step
        seen |= {b for _, b in step}
    return out


def reverse_random_tree(n: int, r: np.random.Generator) -> set[Edge]:
    return {(b, a) for a, b in random_tree(n, r)}


def watts_strogatz(n: int, r: np.random.Generator, rewire: float | None = None) -> set[Edge]:
    rewire = r.uniform(0.1, 0.3) if rewire is None else rewire
    k = min(int(r.choice([2, 4])), max(n - 1, 0))
    pairs = {(v, (v + d) % n) for v in range(n) for d in range(1, k // 2 + 1)} if n > 1 else set()
    moved = {(a, int(r.integers(n))) if r.random() < rewire else (a, b) for a, b in sorted(pairs)}
    return _connected(n, moved, r)


def random_cauchy(n: int, r: np.random.Generator) -> set[Edge]:
    a, b, c = float(r.standard_cauchy()), r.standard_cauchy(n), r.standard_cauchy(n)
    p = 1 / (1 + np.exp(-np.clip(a + b[:, None] + c[None, :], -50, 50)))
    return _connected(n, {(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < p[i, j]}, r)


def layered(n: int, r: np.random.Generator, dropout: float = 0.1) -> set[Edge]:
    """Consecutive layers joined but for dropped edges; nodes left without a parent or child get one."""
    depth = min(int(r.integers(2, 9)), n)
    cuts = [0, *sorted(r.choice(np.arange(1, n), depth - 1, replace=False).tolist()), n] if n > 1 else [0, n]
    layers = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    out: set[Edge] = set()
    for up, down in zip(layers, layers[1:], strict=False):
        kept = {(a, b) for a in up for b in down if r.random() >= dropout}
        kept |= {(int(r.choice(up)), b) for b in down if not any(y == b for _, y in kept)}
        kept |= {(a, int(r.choice(down))) for a in up if not any(x == a for x, _ in kept)}
        out |= kept
    return _connected(n, out, r)


LAYOUTS: dict[str, Callable] = {
    "ErdosRenyi": erdos_renyi, "BarabasiAlbert": barabasi_albert, "RandomTree": random_tree, "ReverseRandomTree": reverse_random_tree,
    "WattsStrogatz": watts_strogatz, "RandomCauchy": random_cauchy, "Layered": layered,
}


def sample_dag(n: int, layout: str, seed: int, weights: str | None = None) -> Dag:
    """A connected acyclic graph of ``n`` nodes; one law for all its weights. The same seed gives the same graph, 0 included."""
    if layout not in LAYOUTS:
        raise ValueError(f"no layout named {layout}")
    if n < 1:
        raise ValueError("a graph has a node")
    r = np.random.default_rng(seed)
    pairs = sorted(LAYOUTS[layout](n, r))
    law = WEIGHTS[weights or str(r.choice(sorted(WEIGHTS)))]
    out = Dag(n, {e: law(r) for e in pairs})
    out.generations()
    if len(out.components()) != 1:
        raise ValueError("the graph is not connected")
    return out
