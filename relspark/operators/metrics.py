"""Metrics of predictions, and their join with the rows they are for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.storage import numbered, sums_before


def r2(df: DataFrame, y: str, p: str, groups: list[str] | None = None) -> DataFrame:
    """1 - sum of squared errors / sum of squared deviations of ``y``; null where ``y`` does not vary."""
    e = F.col(y) - F.col(p)
    return df.groupBy(*(groups or [])).agg(F.try_divide(-F.sum(e * e), F.count(y) * F.var_pop(y)).alias("__r")).select(*(groups or []), (1 + F.col("__r")).alias("r2"))


def auc(df: DataFrame, label: Column, score: str) -> DataFrame:
    """The area under the ROC curve by average ranks; null if a class is missing.

    Rows are first counted by score, so equal scores cost one row; the distinct scores are
    ranked in parallel.
    """
    per = df.groupBy(F.col(score).alias("s")).agg(F.count(F.when(label, 1)).alias("pos"), F.count(F.when(~label, 1)).alias("neg"))
    rows = numbered(per, ["s"], "rn")
    # pairs won = sum over scores of pos * (negatives below + half of those equal)
    met = sums_before(rows, "rn", "neg", "below")
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return met.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def huber(y: Column, p: Column, delta: float = 1.0) -> Column:
    e = F.abs(y - p)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))


def bce_with_logits(y: Column, z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def sequence_losses(cells: DataFrame, seq: str, masked: str, loss: Column) -> DataFrame:
    """``seq, loss, n_masked``: of each sequence the sum of ``loss`` over its masked cells, over their number; 0 without one."""
    here = F.when(F.col(masked), loss)
    return cells.groupBy(seq).agg((F.coalesce(F.sum(here), F.lit(0.0)) / F.greatest(F.count_if(F.col(masked)), F.lit(1))).alias("loss"), F.count_if(F.col(masked)).alias("n_masked"))


def means(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The mean of ``value`` by ``groups`` (such as split and family), and ``n``; NaN and null count for nothing."""
    x = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*groups).agg(F.avg(x).alias("mean"), F.count(x).alias("n"))


def latency(df: DataFrame, ms: str) -> DataFrame:
    """``mean, std`` of durations, the deviation being that of the population."""
    return df.agg(F.avg(ms).alias("mean"), F.coalesce(F.stddev_pop(ms), F.lit(0.0)).alias("std"))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def best(df: DataFrame, task: str, val: str, test: str, order: str) -> DataFrame:
    """Each task's best validation metric, the first of equals in ``order``, with the test metric at it."""
    key = F.struct(F.col(val), -F.col(order))
    return df.groupBy(task).agg(F.max(val).alias("best_val"), F.max_by(test, key).alias("test_at_best"))


def join_predictions(rows: DataFrame, preds: DataFrame, keys: list[str], pred: str, order: str) -> DataFrame:
    """``rows`` with ``pred``: the last prediction (in ``order``) of the row's keys; null without one."""
    last = preds.groupBy(*keys).agg(F.max_by(pred, order).alias(pred))
    return rows.join(last, keys, "left")


def coverage(df: DataFrame, pred: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count(pred).alias("matched"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, sample deviation (0 for one row), minimum and maximum."""
    c = F.col(column)
    return df.agg(F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
