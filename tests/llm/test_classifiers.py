import zlib

import numpy as np
import pytest

from relspark.llm import labelled, quality, toxicity
from relspark.llm.queries import op2_toxicity, op3_quality

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.mark.parametrize(("query", "label", "folds", "held", "least", "threshold"), [(op2_toxicity, "toxic", 3, 1, 0.97, 0.7), (op3_quality, "quality", 5, 0, 0.97, 0.3)])
def test_held_out_accuracy(spark, query, label, folds, held, least, threshold):
    got = query(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % folds == held for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= threshold) == got.predicted.astype(bool)).all()
    m = got[got.held_out].merge(labels, on="doc_id")
    assert auc(m.score.to_numpy(), m[label].to_numpy()) > least
    assert (m.predicted == m[label]).mean() > 0.97


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_odd_rows(spark, operator):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "some words", 5), (3, "w " * 100_000, 5), (4, "\n \t", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (1, None, None), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = operator(docs, known).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert operator(docs.limit(0), labels).collect() == []


def test_statistics_are_finite():
    for t in ["", " ", "a", "é\n\n!!", "x" * 100_000, "| " * 5]:
        x = quality.statistics(t)
        assert len(x) == quality.STATISTICS and np.isfinite(x).all()


def test_isotonic_rises_and_platt_orders():
    rng = np.random.default_rng(0)
    at = np.arange(20.0)
    counts = np.array([rng.integers(1, 30, 20) + np.arange(20)[::-1], rng.integers(1, 30, 20) + np.arange(20)])
    points, values = labelled.isotonic(counts, at)
    assert (np.diff(points) > 0).all() and (np.diff(values) > 0).all()
    assert abs(values @ np.ones(len(values)) - values.sum()) < 1e-9
    assert labelled.platt(counts, at)[0] > 0
    assert labelled.platt(counts * [[1], [0]], at)[0] == 0
