"""Spark ML models on the revealed table, for comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import sql_number
from ..operators.batches import matrix_of
from ..session import materialise
from .linear import complete


def _assembled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    # The -1 of the two-class coding is 0 to the library.
    y = F.when(F.col(label) == -1, 0.0).otherwise(F.col(label).cast("double"))
    return VectorAssembler(inputCols=features, outputCol="_x").transform(df.withColumn("_y", y))


def newton_lr(df: DataFrame, features: list[str], label: str = "y", start: np.ndarray | None = None, tolerance: float = 1e-10, max_steps: int = 25) -> tuple[np.ndarray, float]:
    """Optimum of unpenalised logistic regression with an intercept, last in the weights.

    Newton steps; tasks add up their part of the gradient and of the normal matrix, features squared
    numbers. Also returns the largest mean gradient, which certifies the optimum when it is near 0: the
    loss is convex. Rows without a label or with a missing feature take no part. Where classes can be
    separated there is no optimum, and the certificate stays above the tolerance.
    """
    frame = complete(df, features, label).select(F.array(*[F.col(f"`{f}`").cast("double") for f in features], F.lit(1.0)).alias("x"), F.col(label).cast("double").alias("y"))
    w = np.zeros(len(features) + 1) if start is None else np.array(start, float)
    for step in range(max_steps + 1):
        sums = np.zeros((len(w), len(w) + 2))
        for r in frame.mapInArrow(_normal(w), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            sums[r["i"], r["j"]] = r["v"]
        matrix, gradient, rows = sums[:, :-2], sums[:, -2], sums[0, -1]
        if not rows:
            raise ValueError("no rows to train on: none has a label and all features")
        worst = float(np.abs(gradient).max() / rows)
        if worst <= tolerance or step == max_steps:
            return w, worst
        w = w - np.linalg.lstsq(matrix, gradient, rcond=None)[0]


def _normal(w: np.ndarray):
    """Arrow function: normal matrix, gradient and row count of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(w), len(w) + 2))
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch, ["x"])
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -500, 500)))
                total[:, :-2] += (x * (p * (1 - p))[:, None]).T @ x
                total[:, -2] += x.T @ (p - batch.column("y").to_numpy(zero_copy_only=False))
                total[0, -1] += len(x)
        i, j = np.indices(total.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    return run


def baseline_lr(train: DataFrame, test: DataFrame, features: list[str], label: str = "y", max_iter: int = 10, certify: bool = False) -> DataFrame:
    """Unpenalised logistic regression; returns the test table with a prediction.

    With ``certify`` Newton steps go on from the library's weights to the optimum, and a column
    ``gradient`` has the largest mean gradient left. Labels are 0 and 1, or -1 and 1. The columns needed
    are written once then, as every step reads them.
    """
    if certify:
        train = materialise(train.select(*features, label), "train")
    given = _assembled(train, features, label)
    fitted = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.0, maxIter=max_iter).fit(given)
    if not certify:
        return fitted.transform(_assembled(test, features, label)).select(*test.columns, "prediction")
    w, worst = newton_lr(given, features, "_y", np.append(fitted.coefficients.toArray(), fitted.intercept))
    margin = F.expr(" + ".join([f"`{f}` * {sql_number(x)}" for f, x in zip(features, w)] + [sql_number(w[-1])]))
    return test.select("*", F.when(margin > 0, 1.0).otherwise(0.0).alias("prediction"), F.lit(worst).alias("gradient"))


def baseline_svm(train: DataFrame, test: DataFrame, features: list[str], label: str = "y", classes: int = 2, max_iter: int = 100) -> DataFrame:
    """Linear SVM, one against the rest for several classes."""
    svm = LinearSVC(featuresCol="_x", labelCol="_y", maxIter=max_iter)
    if classes > 2:
        svm = OneVsRest(classifier=svm, featuresCol="_x", labelCol="_y")
    fitted = svm.fit(_assembled(train, features, label))
    return fitted.transform(_assembled(test, features, label)).select(*test.columns, "prediction")
