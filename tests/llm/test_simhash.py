import random

import numpy as np
import xxhash

from relspark.llm import simhash


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(rows, radius):
    """doc_id -> smallest reachable, by comparing all pairs."""
    low = {i: d for i, (d, _) in enumerate(rows)}
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if bin(a ^ b).count("1") <= radius:
                    least = min((x for x in (low[i], low[j]) if x is not None), default=None)
                    if (low[i], low[j]) != (least, least):
                        low[i] = low[j] = least
                        changed = True
    return sorted((d, c) for (d, _), c in zip(rows, [low[i] for i in range(len(rows))], strict=True)) if None not in low.values() else low


TEXTS = ["", None, "a", "A  b", "one two three", "One\tTWO three", " \n ", "é x É y", "w " * 400, "same words here again " * 3]


def test_fingerprint_is_the_plain_one():
    rng = np.random.default_rng(0)
    long = " ".join(map(str, rng.integers(0, 50, 70_000)))
    for t in [*TEXTS, long]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def near_fps(n=300, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    out = []
    for _ in range(n):
        x = int(base[rng.integers(20)])
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            x ^= 1 << int(b)
        out.append(x)
    return out


def groups(pairs, nodes):
    low = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_tile_links_span_all_links():
    fps = sorted(set(near_fps()))
    every = [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2]
    for tile in (7, 512):
        src, dst = simhash.tile_links(np.array(fps, np.uint64), 2, tile)
        got = groups(list(zip(src.tolist(), dst.tolist(), strict=True)), fps)
        want = groups(every, fps)
        assert {(a, b) for a in fps for b in fps if want[a] == want[b]} == {(a, b) for a in fps for b in fps if got[a] == got[b]}
        assert len(src) <= len(fps)


def test_links_of_usual_and_hot_buckets(spark):
    fps = sorted(set(near_fps(200, 3)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    want = groups([(a, b) for a, fa in zip(signed, fps, strict=True) for b, fb in zip(signed, fps, strict=True) if bin(fa ^ fb).count("1") <= 2], signed)
    for bucket in (4, 8192):
        pairs = [(r.src, r.dst) for r in simhash.fingerprint_links(df, 2, bucket).collect()]
        assert groups(pairs, signed) == want


def test_near_duplicates_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, "one two three"), (50, "one two three"), (3, "w " * 400)]
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, fp string, root int")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == plain_components([(d, plain_fingerprint(t)) for d, t in rows], 2)


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "c d"), (None, "c d")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str) == [(4, 4), (None, 4), (None, None), (None, None)]


def test_different_texts_of_one_fingerprint_stay(spark):
    """A repeated banner sets every bit of the fingerprint; the texts behind it share next to nothing."""
    r = random.Random(4)
    banner = " ".join(["read this first please now"] * 400)
    rows = [(i, banner + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(300))) for i in range(20)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)] + [(200, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({x.fp for x in simhash.fingerprints(df, 5).collect()}) == 1
    assert sorted(x.doc_id for x in simhash.deduplicated(df).collect()) == list(range(20))
