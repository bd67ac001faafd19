import numpy as np
import pytest

from relspark.llm import neighbours
from relspark.llm.neighbours import cosine, nearest


def brute(rows, asked, k):
    """Best pair of each query id and other id, by comparing all."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 4})
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    best = {}
    for qi, q in [g for g in good if g[0] in asked]:
        for i, s in zip(ids.tolist(), cosine(np.array(q), x).tolist(), strict=True):
            if i != qi:
                best.setdefault(qi, {})[i] = max(s, best.get(qi, {}).get(i, -2))
    return sorted((q, r + 1, i, s) for q, found in best.items() for r, (s, i) in enumerate(sorted(((-s, i) for i, s in found.items()))[:k]) for s in [-s])


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(300)] + [(300 + i, [0.5, 0.5, 0.1, 0.0]) for i in range(60)]
    return rows + [(400, None), (401, []), (402, [0.0] * 4), (403, [1.0, None, 0.0, 0.0]), (404, [float("nan"), 1.0, 1.0, 1.0]), (405, [float("inf"), 1.0, 1.0, 1.0]), (406, [1.0, 2.0]), (407, [1e200, -1e200, 0.0, 1e199]), (None, [1.0] * 4)]


def result(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    rows = rows_of()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, code string")
    if small:
        monkeypatch.setattr(neighbours, "NUMBERS", 400)
        monkeypatch.setattr(neighbours, "QUERIES", 7)
        monkeypatch.setattr(neighbours, "PAIRS", 600)
    assert result(nearest(df, df.filter("vec_id % 20 = 0"), 5)) == brute(rows, set(range(0, 500, 20)), 5)
    few = df.filter("vec_id < 3")
    assert sorted((r.query_id, r["rank"]) for r in nearest(few, few, 5).collect()) == [(i, r) for i in range(3) for r in (1, 2)]
    assert nearest(df.limit(0), df.limit(0)).collect() == []
    assert nearest(df, df.limit(0)).collect() == []


def test_repeated_rows_and_ids_count_once(spark):
    rows = rows_of(2)
    rows = rows * 3 + [(10, [0.1 * j, 0.2, 0.3, 0.4]) for j in range(40)] + rows[:1] * 50
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert result(nearest(df, df.filter("vec_id % 10 = 0"), 5)) == brute(rows, set(range(0, 500, 10)), 5)


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = nearest(df, df.filter("vec_id % 50 = 0"), 5).collect()
    p = df.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    want = set()
    for qi in ids[ids % 50 == 0]:
        s = cosine(x[ids == qi][0], x)
        want |= {(qi, ids[j], s[j]) for j in [j for j in np.lexsort((ids, -s)) if ids[j] != qi][:5]}
    assert len(got) == len(want)
    assert len(want & {(r.query_id, r.vec_id, r.score) for r in got}) / len(want) >= 0.99


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=(20, 64))
    packed, factor = neighbours.codes(x)
    c = neighbours.Codes(packed, factor, 64)
    true = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    far = np.abs(c.estimates(neighbours.turned_queries(q)) - true)
    assert (far <= c.error).mean() > 0.996
    assert packed.shape == (4000, 8)


def test_blocks_stay_bounded_and_copies_few():
    for n in (1, 10_000, 10_000_000, 1_000_000_000):
        nb, mb = neighbours._cut(n, n // 50, 64, 4000)
        assert n * 64 / nb <= neighbours.NUMBERS * 1.01 and n / 50 / mb <= neighbours.QUERIES * 1.01
    nb, mb = neighbours._cut(10_000_000, 200_000, 64, 4000)
    assert mb * 10_000_000 + nb * 200_000 < 40 * 10_000_000
