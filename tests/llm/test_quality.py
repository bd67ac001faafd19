import random
import zlib

import numpy as np

from relspark.llm import labelled, quality


def test_scores_match_plain_least_squares(spark, monkeypatch):
    """The whole fit again with numpy on one table: standardised statistics, cosines, ridge, pooled bins."""
    r = random.Random(3)
    docs, labels = [], []
    for i in range(240):
        y = int(r.random() < 0.6)
        words = r.choices(["plain", "words", "of", "prose."] if y else ["###", "junk|", "AAAA", "99"], k=r.randint(1, 40))
        docs.append((i, " ".join(words) + ("\n" if i % 3 else "")))
        labels.append((i, y))
    df = spark.createDataFrame(docs + [(900, None), (901, "")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in quality.quality(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs]
    x = np.array([quality.statistics(t) for _, t in docs])
    y = np.array([float(v) for _, v in labels])
    train = ~np.array(held)
    mean, std = x[train].mean(axis=0), x[train].std(axis=0)
    rng = np.random.default_rng(quality.SEED)
    w, shift = rng.normal(0, 1 / quality.WIDTH, (quality.STATISTICS, quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(x):
        z = np.clip((x - mean) / np.where(std > 1e-9, std, 1), -8, 8)
        return np.column_stack([np.sqrt(2 / quality.FEATURES) * np.cos(z @ w + shift), np.ones(len(x))])

    z = features(x[train])
    weights = np.linalg.solve(z.T @ z / len(z) + quality.RIDGE * np.eye(z.shape[1]), z.T @ y[train] / len(z))
    ridge = features(x) @ weights
    width = (quality.HIGH - quality.LOW) / labelled.BINS
    bins = np.clip(np.floor((ridge[train] - quality.LOW) / width), 0, labelled.BINS - 1)
    # pooling by the largest mean of upper sets and the smallest of lower ones
    at = np.unique(bins)
    ones, n = np.array([y[train][bins == b].sum() for b in at]), np.array([(bins == b).sum() for b in at])
    level = np.array([min(max(ones[i : k + 1].sum() / n[i : k + 1].sum() for i in range(j + 1)) for k in range(j, len(at))) for j in range(len(at))])
    centre = quality.LOW + (at + 0.5) * width
    points, values = zip(*[((centre[level == v] * n[level == v]).sum() / n[level == v].sum(), v) for v in np.unique(level)], strict=True)
    want = 0.99 * np.interp(ridge, points, values) + 0.01 * np.clip((ridge - quality.LOW) / (quality.HIGH - quality.LOW), 0, 1)
    assert all(got[i].held_out == h for (i, _), h in zip(docs, held, strict=True))
    assert max(abs(got[i].score - s) for (i, _), s in zip(docs, want, strict=True)) < 1e-6
    assert got[900].score == got[901].score
