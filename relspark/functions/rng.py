"""A counter-based random number for any row: the same in every engine, partitioning and run."""

from __future__ import annotations

import math
from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F


def u32(*parts: object) -> Column:
    """The first 32 bits of md5 over the parts, joined by "|"; Columns are cast to text, all else is a literal."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def unit(*parts: object) -> Column:
    """A double in [0, 1) that depends on ``parts`` alone."""
    return u32(*parts) / F.lit(4294967296.0)


def uniform_int(u: Column, low: int, high: int) -> Column:
    """An integer from ``low`` to ``high``, both included."""
    return F.floor(F.lit(low) + u * F.lit(high - low + 1)).cast("long")


def pick(u: Column, values: list) -> Column:
    """One of ``values``, equally likely."""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def power_law(u: Column, low: int, high: int, exponent: float) -> Column:
    """An integer from ``low`` to ``high`` with probability in proportion to its power -``exponent``."""
    if low < 1 or high < low:
        raise ValueError("a power law needs a range of positive integers")
    weights = [x ** -exponent for x in range(low, high + 1)]
    total, run, out = sum(weights), 0.0, None
    for x, w in zip(range(low, high + 1), weights, strict=True):
        run += w
        below = u < F.lit(run / total if x < high else 2.0)
        out = F.when(below, F.lit(x)) if out is None else out.when(below, F.lit(x))
    return out.cast("long")


#: Rounds of the keyed bijection.
ROUNDS = 6


def _sides(n: int) -> tuple[int, int]:
    """The two moduli of the bijection on [0, n): their product is at least ``n``, and less than ``n`` plus the first."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permuted(i: Column, n: int, *key: object) -> Column:
    """The place in [0, n) to which a keyed permutation of [0, n) takes ``i``: arithmetic on one number, no sort.

    A Feistel network with modular addition permutes a slightly larger domain; a result outside [0, n) goes round
    again. That takes few turns; more than WALK, which for n up to 4096 can't be and beyond has a chance below 2^-300, is an error.
    """
    a, b = _sides(n)

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))

        def turn(s: Column, j: Column) -> Column:
            even = j % 2 == 0
            by = u32(*key, j, F.when(even, s["r"]).otherwise(s["l"]))
            return F.struct(F.when(even, (s["l"] + by) % a).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + by) % b).alias("r"))

        rounds = F.array(*(F.lit(j) for j in range(ROUNDS)))
        return F.aggregate(rounds, start, turn, lambda s: s["l"] * b + s["r"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(i.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("the permutation did not end")).cast("long"))


#: Turns after which a walk is given up.
WALK = 64


def permuted_number(i: int, n: int, *key: object) -> int:
    """``permuted`` of one number, for readers that have no columns."""
    a, b = _sides(n)
    while True:
        left, right = divmod(i, b)
        for j in range(ROUNDS):
            by = int(md5("|".join(map(str, (*key, j, right if j % 2 == 0 else left))).encode()).hexdigest()[:8], 16)
            left, right = ((left + by) % a, right) if j % 2 == 0 else (left, (right + by) % b)
        i = left * b + right
        if i < n:
            return i
