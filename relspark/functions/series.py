"""Row-indexed trend, cycle and AR(1) noise as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relspark.storage import checkpointed


def trend(i: Column, n: int, scale: float, alpha: float, low: float = -1.0, high: float = 1.0) -> Column:
    """A power of the row's share of the table, bounded above."""
    return F.least(F.lit(scale) * F.pow(i / F.lit(float(n)), F.lit(alpha)) + F.lit(low), F.lit(high))


def cycle(i: Column, every: float, scale: float, low: float = -1.0, high: float = 1.0) -> Column:
    """A sine of half period ``every`` rows, bounded on both sides."""
    if every <= 0:
        raise ValueError("a cycle needs a positive length")
    return F.greatest(F.lit(low), F.least(F.lit(high), F.lit(scale) * F.sin(i / F.lit(float(every)) * F.lit(math.pi))))


#: Blocks whose end states are chained by one window.
CHAINED = 4096


def ar1(df: DataFrame, order: str, noise: str, rho: float, name: str = "ar", block: int = 256) -> DataFrame:
    """``df(order long from 0, gapless)`` with s(t) = rho s(t-1) + noise(t), s before the first row being 0.

    The series is cut into blocks of rows. Each block is folded on its own from zero. The blocks' end
    states are a series of the same kind, with rho^block, and are chained in the same way; each row then
    adds the decayed state that came in. No window is longer than CHAINED rows, and the result is the whole
    recurrence, not a truncation.
    """
    if not 0 <= rho < 1:
        raise ValueError("rho is at least 0 and below 1")
    row = F.struct((F.col(order) % block).cast("int").alias("j"), F.col(noise).cast("double").alias("e"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    gathered = df.groupBy(F.floor(F.col(order) / block).cast("long").alias("__b")).agg(F.array_sort(F.collect_list(row), lambda x, y: x["j"] - y["j"]).alias("x"))
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["s"] * rho + F.coalesce(x["e"], F.lit(0.0))
        return F.struct(F.array_append(acc["out"], s).alias("out"), s.alias("s"))

    folded = checkpointed(gathered.select("__b", "x", F.aggregate("x", start, step).alias("f")).select("__b", "x", "f.out", F.col("f.s").alias("last")))
    ends, decay = folded.select("__b", "last"), rho**block
    n = ends.count()
    if n > CHAINED:
        states = ar1(ends, "__b", "last", decay, "__in", block).select((F.col("__b") + 1).alias("__b"), "__in")
    else:
        # a state below 1e-300 is no double's concern
        back = 1 if decay == 0 else max(1, math.ceil(-690 / math.log(decay)))
        w = Window.orderBy("__b").rowsBetween(-back, -1)
        states = F.broadcast(ends.select("__b", F.aggregate(F.collect_list("last").over(w), F.lit(0.0), lambda a, x: a * decay + x).alias("__in")))
    met = folded.join(states, "__b", "left").select(F.coalesce("__in", F.lit(0.0)).alias("__in"), F.explode(F.arrays_zip("x", "out")).alias("z"))
    value = F.col("z.out") + F.col("__in") * F.pow(F.lit(rho), F.col("z.x.j") + 1)
    return met.select(F.col("z.x.row").alias("row"), value.alias("__value")).select(*(F.col(f"row.`{c}`") for c in df.columns), F.col("__value").alias(name))


def bounded(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def softmax(*xs: Column) -> Column:
    """The array of exp(x - max) over their sum."""
    top = F.greatest(*xs)
    e = F.array(*(F.exp(x - top) for x in xs))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def draw(u: Column, shares: Column) -> Column:
    """The index, from 0, of the first running sum of ``shares`` above ``u``; the last one if rounding leaves none."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("k"))
    end = F.aggregate(shares, start, lambda a, s: F.struct((a["run"] + s).alias("run"), (a["k"] + F.when(a["run"] + s <= u, 1).otherwise(0)).alias("k")))
    return F.least(end["k"], F.size(shares) - 1)


def even_dates(i: Column, n: int, start: str, end: str) -> Column:
    """The i-th of ``n`` evenly spaced timestamps from ``start`` to ``end``, to the microsecond."""
    a, b = (F.unix_micros(F.lit(x).cast("timestamp")) for x in (start, end))
    return F.timestamp_micros((a + F.floor((b - a) * i / F.lit(max(n - 1, 1)))).cast("long")).cast("timestamp_ntz")
