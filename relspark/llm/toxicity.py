"""Toxicity: class-conditional Kneser-Ney word models, compared by length-normalised log-likelihood.

As in Kneser-Ney smoothing, a count is a number of distinct contexts (here documents), a discount is
taken from each count, and what it takes goes to a backoff distribution. The toxic and the ordinary
model have two levels: a word backs off to its class's probability of the word's beginning of five
characters, and that to the counts that both classes share:

    p(w | c) = max(n_c(w) - d, 0) / N_c + l_c p(w's beginning | c) p(w | w's beginning),
    p(b | c) = max(n_c(b) - d', 0) / B_c + l'_c p(b),

with p(b) and p(w | b) from the shared counts; l_c and l'_c hand on all that the discounts take. The
discount of a count is what its backoff expects and DISCOUNT plus DISCOUNT_SD standard deviations more:
a rare expression, or one that is as common as in the other class, is left to the shared counts whole,
and says nothing for either class. With a single discount the sampling noise of ten thousand ordinary
words outweighs the few toxic ones; the README has figures.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import checkpointed, texts
from relspark.llm.labelled import BINS, fold, histogram, labelled, platt

BEGINNING = 5
DISCOUNT, DISCOUNT_SD = 1.5, 3.0
#: Words added to a text's length when its log-likelihood is normalised, so that a word or two make no mean.
LENGTH = 100
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
WORD = re.compile(r"\w+")
#: Different words that a task counts before it hands them on, and whose weights a worker remembers.
COUNTED, CACHED_WORDS = 300_000, 200_000
#: Weights (32 bytes each) that are broadcast at once; more take one more pass over the texts each.
MAX_WEIGHTS = 2_000_000
LOW, HIGH = -25.0, 75.0
#: The classes a text's own counts can be taken out of: none, ordinary, toxic.
OWN = (None, 0, 1)
WORDS, BEGINNINGS = 0, 1


def term_hash(kind: int, term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"), kind) - (1 << 63)


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``kind, h, parent, n0, n1``: documents of each class with a word or a beginning, summed within the task as far as memory goes."""
    counts = [[Counter(), Counter()], [Counter(), Counter()]]

    def rows() -> Iterator[pa.RecordBatch]:
        for kind, (c0, c1) in enumerate(counts):
            terms = list(c0.keys() | c1.keys())
            for i in range(0, len(terms), 1 << 16):
                part = terms[i : i + (1 << 16)]
                parent = [term_hash(BEGINNINGS, w[:BEGINNING]) if kind == WORDS else 0 for w in part]
                columns = [pa.array([kind] * len(part), pa.int32()), pa.array([term_hash(kind, w) for w in part], pa.int64()), pa.array(parent, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[w] for w in part], pa.int64()) for c in (c0, c1))], names=["kind", "h", "parent", "n0", "n1"])
            c0.clear()
            c1.clear()

    for b in batches:
        for text, y in zip(texts(b.column("text")), b.column("y").to_pylist(), strict=True):
            words = distinct_words(text)
            counts[WORDS][y].update(words)
            counts[BEGINNINGS][y].update({w[:BEGINNING] for w in words})
            if len(counts[WORDS][0]) + len(counts[WORDS][1]) > COUNTED:
                yield from rows()
    yield from rows()


@dataclass
class Level:
    """One level of the models: the classes' totals, and the share that each hands on to its backoff."""

    totals: tuple[float, float]
    left: tuple[float, float] = (1.0, 1.0)

    def kept(self, c: int, parent: Column, own: int | None = None) -> Column:
        """What the discount leaves of class ``c``'s count."""
        n = self._count(own)
        expected = F.lit(self.totals[c] / max(sum(self.totals), 1.0)) * n * parent
        return F.greatest(F.col(f"n{c}") - int(own == c) - expected - DISCOUNT - DISCOUNT_SD * F.sqrt(expected), F.lit(0.0))

    def ratio(self, c: int, parent: Column, own: int | None = None) -> Column:
        """Class ``c``'s probability over the shared one, with that of its backoff being ``parent``; ``own``: without one document of that class."""
        n, total = self._count(own), self.totals[c]
        more = F.when(n > 0, self.kept(c, parent, own) * (sum(self.totals) / total) / n).otherwise(0.0) if total else F.lit(0.0)
        return more + F.lit(self.left[c]) * parent

    def _count(self, own: int | None) -> Column:
        return F.col("n0") + F.col("n1") - int(own is not None)

    @property
    def constant(self) -> float:
        return math.log(self.left[1] / self.left[0])

    def summed(self, sums: tuple[float | None, float | None]) -> None:
        """Sets what is handed on, from the sums of what is kept."""
        self.left = tuple(1 - (s or 0.0) / t if t else 1.0 for s, t in zip(sums, self.totals, strict=True))


def _weights(counts: DataFrame) -> tuple[DataFrame, float]:
    """``h, w0, w1, w2`` (see ``OWN``): what a word or beginning adds to the log-likelihood ratio beyond the constant that any word adds, and that constant."""
    totals = {r.kind: (float(r.a), float(r.b)) for r in counts.groupBy("kind").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).collect()}
    begin, word = Level(totals.get(BEGINNINGS, (0.0, 0.0))), Level(totals.get(WORDS, (0.0, 0.0)))
    one = F.lit(1.0)

    def left(level: Level, rows: DataFrame, parents: list[Column]) -> DataFrame:
        rows = rows.withColumns({f"k{c}": level.kept(c, parents[c]) for c in (0, 1)}).filter("k0 > 0 OR k1 > 0")
        rows = checkpointed(rows)
        level.summed(tuple(rows.agg(F.sum("k0"), F.sum("k1")).first()))
        return rows

    begins = left(begin, counts.filter(F.col("kind") == BEGINNINGS).select("h", "n0", "n1"), [one, one])
    begins = begins.select("h", *(begin.ratio(c, one, own).alias(f"r{i}{c}") for i, own in enumerate(OWN) for c in (0, 1)))
    names = begins.columns[1:]
    words = counts.filter(F.col("kind") == WORDS).select("h", "parent", "n0", "n1")
    parents = begins.withColumnRenamed("h", "parent")
    met = words.join(F.broadcast(parents) if begins.count() <= MAX_WEIGHTS else parents, "parent", "left")
    met = met.select("h", "n0", "n1", *(F.coalesce(c, F.lit(begin.left[int(c[-1])])).alias(c) for c in names))
    words = left(word, met, [F.col("r00"), F.col("r01")])

    def log_ratio(r: list[Column]) -> Column:
        return F.log(r[1]) - F.log(r[0])

    per_begin = [log_ratio([F.col(f"r{i}{c}") for c in (0, 1)]) - begin.constant for i in range(3)]
    per_word = [log_ratio([word.ratio(c, F.col(f"r{i}{c}"), own) for c in (0, 1)]) - word.constant - log_ratio([F.col(f"r{i}{c}") for c in (0, 1)]) for i, own in enumerate(OWN)]
    out = [rows.select("h", *(w.alias(f"w{i}") for i, w in enumerate(per))) for rows, per in ((begins, per_begin), (words, per_word))]
    return checkpointed(out[0].unionByName(out[1])), begin.constant + word.constant


class Weights:
    """A part of the weights on a worker, looked up once for each word that the worker remembers."""

    def __init__(self, h: np.ndarray, w: np.ndarray):
        self.h, self.w = h, w
        self.known: list[dict[str, float]] = [{}, {}, {}]

    def _of(self, hashes: list[int], own: int) -> np.ndarray:
        x = np.array(hashes, np.int64)
        at = np.minimum(np.searchsorted(self.h, x), max(len(self.h) - 1, 0))
        return np.where(self.h[at] == x, self.w[at, own], 0.0) if len(self.h) else np.zeros(len(x))

    def sums(self, words: list[set[str]], own: list[int]) -> list[float]:
        """For each text the sum of its words' weights."""
        for k in set(own):
            known = self.known[k]
            if len(known) > CACHED_WORDS:
                known.clear()
            new = list(set().union(*(w for w, o in zip(words, own, strict=True) if o == k)).difference(known))
            both = self._of([term_hash(WORDS, w) for w in new], k) + self._of([term_hash(BEGINNINGS, w[:BEGINNING]) for w in new], k)
            known.update(zip(new, both.tolist(), strict=True))
        # fsum: the same in any order
        return [math.fsum(map(self.known[o].__getitem__, w)) for w, o in zip(words, own, strict=True)]


@dataclass
class Model:
    """The weights, in parts of at most MAX_WEIGHTS by hash, any word's constant, and the calibration."""

    weights: DataFrame
    constant: float
    slope: float = 0.0
    intercept: float = 0.0

    def parts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        n = self.weights.count()
        many = -(-n // MAX_WEIGHTS) or 1
        out = []
        for p in range(many):
            part = self.weights.filter(F.pmod("h", F.lit(many)) == p).toArrow()
            h = part.column("h").to_numpy()
            order = np.argsort(h)
            out.append((h[order], np.column_stack([part.column(f"w{i}").to_numpy() for i in range(3)])[order]))
        return out

    def score(self, evidence: Column) -> Column:
        z = F.greatest(F.least(F.lit(self.slope) * evidence + F.lit(self.intercept), F.lit(30.0)), F.lit(-30.0))
        return F.round(1 / (1 + F.exp(-z)), 9)


def _scanned(rows: DataFrame, part: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``rows(text, own, ...)`` with ``s, n`` instead of both: the sum of the words' weights in this part, and the number of words."""
    rest = [f for f in rows.schema if f.name not in ("text", "own")]
    shared = rows.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*shared.value)
        for b in batches:
            words = [distinct_words(t) for t in texts(b.column("text"))]
            s = weights.sums(words, b.column("own").to_pylist())
            n = list(map(len, words))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(s, pa.float64()), pa.array(n, pa.int64())], names=[*(f.name for f in rest), "s", "n"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", s double, n long")


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """``rows(text, own int, ...)`` with ``evidence`` instead of both: how much likelier the toxic model makes the text, in nats per hundred words.

    ``own``: 0, or 1 or 2 to leave one ordinary or toxic document, the text's own, out of the counts.
    A text without words is taken for one long text of words that say nothing. Each part of the
    weights is a pass over the texts; their sums meet by the rows' hash.
    """
    rest = [c for c in rows.columns if c not in ("text", "own")]
    parts = model.parts()
    if len(parts) == 1:
        found = _scanned(rows, parts[0])
    else:
        marked = rows.withColumns({"h1": F.xxhash64(*rows.columns), "h2": F.xxhash64(F.lit(1), *rows.columns)})
        passes = [_scanned(marked, p) for p in parts]
        every = passes[0]
        for p in passes[1:]:
            every = every.unionByName(p)
        # a row that is there several times comes several times from each pass
        met = every.groupBy("h1", "h2", *rest).agg(F.sum("s").alias("s"), F.first("n").alias("n"), (F.count("*") / len(parts)).cast("int").alias("copies"))
        found = met.select(*rest, (F.col("s") / F.col("copies")).alias("s"), "n", F.explode(F.sequence(F.lit(1), "copies")))
    mean = (F.col("s") + F.col("n") * model.constant) / (F.col("n") + LENGTH)
    return found.select(*rest, (100 * F.when(F.col("n") > 0, mean).otherwise(model.constant)).alias("evidence"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts over all labelled documents outside the held-out fold, calibrated on the same with their own counts taken out."""
    train = labelled(docs, labels, "toxic", FOLDS, HELD_OUT)
    counts = train.mapInArrow(_count, "kind int, h long, parent long, n0 long, n1 long")
    counts = checkpointed(counts.groupBy("kind", "h").agg(F.first("parent").alias("parent"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    model = Model(*_weights(counts))
    scores = evidence(train.select("text", (F.col("y") + 1).alias("own"), "y"), model)
    counted = histogram(scores.select(F.col("evidence").alias("s"), "y"), LOW, HIGH)
    model.slope, model.intercept = platt(counted, LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS)
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, evidence, score, predicted`` for each row of ``docs``.

    ``score`` is from 0 to 1, higher where the label 1 is likelier; a null, empty or wordless text
    says nothing for either class and gets the same score everywhere. Labels are learned only from rows
    whose crc32(doc_id as text) mod 3 is not 1; a null doc_id counts as held out. If only one class, or
    no label, is known, all scores are the smoothed prior. Texts of any length are read whole. Repeated
    rows get equal scores; an empty table gives an empty result. Columns other than ``doc_id`` and
    ``text`` are ignored.
    """
    model = fit(docs, labels)
    rows = docs.select("doc_id", fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("own"))
    return evidence(rows, model).withColumn("score", model.score(F.col("evidence"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
