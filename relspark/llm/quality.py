"""Quality: random Fourier features of document statistics, ridge regression by normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import checkpointed, texts
from relspark.llm.labelled import BINS, fold, histogram, isotonic, labelled

#: Random features, of which pairs of them approximate a Gaussian kernel of this width (in standard deviations).
FEATURES, WIDTH, RIDGE, SEED = 256, 4.0, 1e-3, 7
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Partitions that sum the normal equations; each sends the driver one matrix of half a megabyte.
SUMS = 48
LOW, HIGH = -0.5, 1.5

_KIND = np.zeros(256, np.uint8)  # 0 controls, 1 space, 2 line end, 3 lower, 4 upper, 5 digit, 6 stop and comma, 7 other mark, 8 above ASCII, 9 bar
_KIND[33:127] = 7
_KIND[[9, 32]], _KIND[10] = 1, 2
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 3, 4, 5
_KIND[[44, 46]], _KIND[128:], _KIND[124] = 6, 8, 9
STATISTICS = 22


def statistics(text: str) -> list[float]:
    """Shape, repetition and character statistics of a whole text; all finite, zero where a text is too short for one."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=10)
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    distinct = set(words)
    again = sum(map(eq, words, words[1:]))
    second = sum(map(eq, words, words[2:]))
    lines = text.split("\n")
    stripped = [x for x in map(str.strip, lines) if x]
    m = max(len(stripped), 1)
    widths = np.fromiter(map(len, stripped), np.int64, len(stripped)) if stripped else np.zeros(1)
    letters = max(kinds[3] + kinds[4], 1)
    marked = sum(1 for w in words if not (w[-1].isalnum() or w[-1] in ".,"))
    title = sum(map(str.istitle, distinct))
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        *(kinds[[1, 2, 4, 5, 6, 7, 8, 9]] / size), kinds[4] / letters,
        len(distinct) / n, again / n, second / n, marked / n, title / max(len(distinct), 1),
        len(set(stripped)) / m, np.log1p(widths.mean()), np.log1p(m),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t) for t in texts(b.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y")], names=["x", "y"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    points: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosines of seeded random projections, and a constant."""
        rng = np.random.default_rng(SEED)
        w, shift = rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ w + shift)
        return np.hstack([z, np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated share, with a hundredth of the plain ridge score so that flat stretches keep its order."""
        r = self.ridge(x)
        rising = np.interp(r, self.points, self.values)
        return np.round(0.99 * rising + 0.01 * np.clip((r - LOW) / (HIGH - LOW), 0, 1), 9)


def _batch(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(-1, STATISTICS)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits all labelled documents outside the held-out fold; three passes over their statistics, which are computed once."""
    train = checkpointed(labelled(docs, labels, "quality", FOLDS, HELD_OUT).mapInArrow(_statistics, "x array<double>, y int"))
    each = [F.col("x")[i] for i in range(STATISTICS)]
    got = train.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(each)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(each))).first()
    mean, scale = (np.array([got[f"{k}{i}"] or 0.0 for i in range(STATISTICS)]) for k in "ms")
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            z = model.features(_batch(b))
            total += z.T @ np.hstack([z, b.column("y").to_numpy().astype(np.float64)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in train.repartition(SUMS).mapInArrow(sums, "sums binary").toLocalIterator():
        total += np.frombuffer(r["sums"]).reshape(total.shape)
    n = max(total[-1, -2], 1.0)
    model.weights = np.linalg.solve(total[:, :-1] / n + RIDGE * np.eye(FEATURES + 1), total[:, -1] / n)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.ridge(_batch(b))), b.column("y")], names=["s", "y"])

    counted = histogram(train.mapInArrow(scores, "s double, y int"), LOW, HIGH)
    model.points, model.values = isotonic(counted, LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS)
    return model


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    ``score`` is from 0 to 1, higher where the label 1 is likelier; a null text is scored as an
    empty one. Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0; a
    null doc_id counts as held out. Without labels all scores are 0.5 but for a hundredth. Repeated
    rows get equal scores; an empty table gives an empty result. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select("doc_id", fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scored(shared.value, texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def scored(model: Model, each: Iterable[str | None]) -> np.ndarray:
    x = np.array([statistics(t or "") for t in each], np.float64).reshape(-1, STATISTICS)
    return np.concatenate([model.score(x[i : i + 1024]) for i in range(0, len(x), 1024)] or [np.zeros(0)])


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is at least the threshold.

    Scores are those of ``quality``: a null text counts as empty, repeated rows go or stay together,
    texts of any length are read whole, and without labels all rows stay. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scored(shared.value, texts(b.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
