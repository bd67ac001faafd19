"""The trie against dictionaries of prefixes, and contraction against a walk over the tree."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from relspark.llm.trie import rebuilt, subtree_totals, trie, turns_in_order

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h]) + tuple(turns[h:])
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids.get(p, []))
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
    ends = {p: ",".join(map(str, sorted(c for c in cs if made[c] == p))) for p, cs in members.items()}
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), leaves[p], saved[p], sha256(ends[p].encode()).hexdigest()) for p, cs in members.items())


def run(spark, rows):
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    turns = turns_in_order(df)
    got = trie(turns.filter("place = 0").select("conv_id"), rebuilt(turns)).collect()
    return sorted((tuple(x) for x in got), key=lambda x: x[:2])


def test_trie(spark):
    r = random.Random(2)
    rows = []
    for c in [*range(0, 40), *range(95, 106), 205, 206, 300, 301, 10**12]:
        for t in range(r.choice([0, 1, 3, 6, 9])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "éé", "", None])))
    rows += [(5, None, "user", "first"), (5, None, None, None), (5, 1, "user", "bb"), (5, 1, "user", "bb"), (None, 0, "user", "lost")]
    rows += [(400 + i, 0, "user", "short") for i in range(9)]
    rows += [(7, 100 + t, "user", f"t{t}") for t in range(120)] + [(8, 100 + t, "user", f"t{t}") for t in range(120)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    turns = turns_in_order(spark.createDataFrame([], ROWS))
    assert trie(turns.filter("place = 0").select("conv_id"), rebuilt(turns)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest"])
def test_contraction(spark, shape):
    r, n = random.Random(shape), 400
    up = {0: None}
    for i in range(1, n):
        up[i] = {"chain": i - 1, "star": 0 if i % 2 else max(0, i - 2), "random": r.randrange(i), "forest": None if r.random() < 0.1 else r.randrange(max(0, i - 3), i)}[shape]
    value = {i: r.randrange(100) for i in up}
    saved, leaves, kids = dict(value), dict.fromkeys(up, 0), dict.fromkeys(up, 0)
    for i in sorted(up, reverse=True):
        leaves[i] += not kids[i]
        if up[i] is not None:
            saved[up[i]] += saved[i]
            leaves[up[i]] += leaves[i]
            kids[up[i]] += 1
    tree = spark.createDataFrame([(i, up[i], value[i]) for i in up], "id long, parent long, saved long")
    got = {x.id: (x.saved, x.n_leaves, x.n_children) for x in subtree_totals(tree).collect()}
    assert got == {i: (saved[i], leaves[i], kids[i]) for i in up}
