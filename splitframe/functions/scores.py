"""Activations, gradients, hessians and label decisions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGISTIC = "logistic"
PIECEWISE = "piecewise"
SOFTMAX = "softmax"
SQUARED = "squared"


def sql_number(x: float) -> str:
    """A double as SQL text."""
    return f"{float(x)!r}D" if math.isfinite(x) else f"double('{float(x)!r}')"


def sigmoid(z: Column, clip: float | None = None) -> Column:
    """``1 / (1 + exp(-z))``; ``clip`` bounds z first (the plain linear model uses 500)."""
    if clip is not None:
        z = F.greatest(F.lit(-float(clip)), F.least(F.lit(float(clip)), z))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def approx_sigmoid(z: Column) -> Column:
    """Piecewise linear stand-in: ``z + 1/2`` cut to ``[0, 1]``."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), z + F.lit(0.5)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also where lambdas repeat it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(z: Column) -> Column:
    """Softmax over an array column, shifted by its maximum."""
    parts = _bound(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top)))

    def normed(e: Column) -> Column:
        return _bound(F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v), lambda total: F.transform(e, lambda v: v / total))

    return _bound(parts, normed)


def activation(objective: str, z: Column) -> Column:
    """Score to prediction for the given objective."""
    if objective == LOGISTIC:
        return sigmoid(z)
    if objective == PIECEWISE:
        return approx_sigmoid(z)
    if objective == SOFTMAX:
        return softmax(z)
    if objective == SQUARED:
        return z
    raise ValueError(f"unknown objective {objective!r}")


def grad_hess_logistic(y: Column, z: Column) -> tuple[Column, Column]:
    p = sigmoid(z)
    return p - y, p * (F.lit(1.0) - p)


def grad_hess_approx(y: Column, z: Column) -> tuple[Column, Column]:
    """Same form on the piecewise sigmoid; the hessian is 0 outside ±1/2."""
    p = approx_sigmoid(z)
    return p - y, p * (F.lit(1.0) - p)


def grad_hess_softmax(y: Column, z: Column) -> tuple[Column, Column]:
    """Per class, on arrays: ``p - y`` and ``p (1 - p)``."""
    p = softmax(z)
    g = F.zip_with(p, y, lambda a, b: a - b)
    h = F.transform(p, lambda v: v * (F.lit(1.0) - v))
    return g, h


def grad_hess_mse(y: Column, z: Column, n: int | Column) -> tuple[Column, Column]:
    """``2 (z - y) / n`` and ``2 / n`` for n rows."""
    rows = n if isinstance(n, Column) else F.lit(float(n))
    return F.lit(2.0) * (z - y) / rows, F.lit(2.0) / rows


def pick_objective(mission: str = "classification", classes: int = 1, share_y: bool = False) -> str:
    """Objective by mission, number of label columns and whether labels are shared.

    Shared labels leave only the piecewise sigmoid; several classes need clear labels.
    """
    if mission == "regression":
        return SQUARED
    if mission != "classification":
        raise ValueError(f"unknown mission {mission!r}")
    if classes > 1:
        if share_y:
            raise ValueError("several classes need labels in clear at their holder")
        return SOFTMAX
    return PIECEWISE if share_y else LOGISTIC


def to_int_labels(p: Column, several: bool = False) -> Column:
    """One column: round half to even. Several (array): position of the first maximum."""
    if several:
        return (F.array_position(p, F.array_max(p)) - 1).cast("int")
    return F.rint(p)


def sign_label(margin: Column, several: bool = False) -> Column:
    """Sign of the margin; several (array): position of the first maximum."""
    if several:
        return to_int_labels(margin, several=True)
    return F.signum(margin)
