"""Losses, accuracy and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: keeps the logarithm finite.
LOG_FLOOR = 1e-12


def _mean(x: Column, copies: Column | None) -> Column:
    """Mean of a value that a row has ``copies`` times (once unless given); nulls do not count."""
    return F.avg(x) if copies is None else F.sum(x * copies) / F.sum(F.when(x.isNotNull(), copies))


def cross_entropy_sum(y: Column, p: Column, copies: Column | None = None) -> Column:
    """Aggregate ``-sum(y ln(p + 1e-12))``: a sum, in which only positives count."""
    each = y * F.ln(p + F.lit(LOG_FLOOR))
    return -F.sum(each if copies is None else each * copies)


def cross_entropy_sum_vec(y: Column, p: Column) -> Column:
    """The same for one-hot labels and class probabilities (array columns)."""
    per_row = F.aggregate(F.zip_with(y, p, lambda a, b: a * F.ln(b + F.lit(LOG_FLOOR))), F.lit(0.0), lambda s, v: s + v)
    return -F.sum(per_row)


def log_loss(y: Column, p: Column) -> Column:
    """Mean logistic loss over positives and negatives."""
    one = F.lit(1.0)
    return -F.avg(y * F.ln(p + F.lit(LOG_FLOOR)) + (one - y) * F.ln(one - p + F.lit(LOG_FLOOR)))


def mse(y: Column, p: Column, copies: Column | None = None) -> Column:
    d = y - p
    return _mean(d * d, copies)


def accuracy(y: Column, label: Column, copies: Column | None = None) -> Column:
    """Share of equal labels."""
    return _mean((y == label).cast("double"), copies)


def curve_table(spark: SparkSession, points: list[tuple[str, int, float]], value: str = "accuracy") -> DataFrame:
    """Points of training curves (series, step, value), in order; one row per evaluation."""
    rows = [(s, int(t), float(v)) for s, t, v in points]
    return spark.createDataFrame(rows, f"series string, step int, {value} double").orderBy("series", "step")


def metric_max_so_far(curve: DataFrame, value: str = "accuracy", out: str = "best") -> DataFrame:
    """Best value up to each step. A series has one row per evaluated step."""
    w = Window.partitionBy("series").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return curve.withColumn(out, F.max(value).over(w))
