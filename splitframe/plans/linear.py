"""Logistic regression and linear SVM by gradient steps; each step is one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators.batches import matrix_of
from ..operators.metrics import accuracy
from ..operators.position import Positioned, position_rows
from ..operators.prep import iter_batches, label_classes
from ..session import materialise
from .store import RunStore

HINGE = "hinge"
INLINE_SUMS = 64
# Rows and steps that are drawn at once at most.
DRAWN_ROWS, DRAWN_STEPS = 50_000, 1_000
# Fixed value: a prime below 2**31, so that a product of two rests fits in a long.
PRIME = 2**31 - 1
ROUNDS = 24


@dataclass
class LinearModel:
    """Weights per feature and class, without intercept: features x classes numbers."""

    features: list[str]
    objective: str
    classes: list | None
    lambda_: float
    weights: np.ndarray
    split_col: int | None = None
    curve: list[tuple[str, int, float]] = field(default_factory=list)
    #: Array column that holds all features in order, instead of columns of their names.
    values: str | None = None

    @property
    def width(self) -> int:
        return self.weights.shape[1]

    def margins(self, features: list[str] | None = None) -> list[Column]:
        """Weighted sum per class, over all features or one party's."""
        chosen = features if features is not None else self.features
        if not chosen:
            return [F.lit(0.0)] * self.width
        at = {f: i for i, f in enumerate(self.features)}
        # One parsed expression per class: a training step builds it anew each time.
        numbers = [[scores.sql_number(self.weights[at[f], c]) for f in chosen] for c in range(self.width)]
        if len(chosen) > INLINE_SUMS or self.values:
            # A long sum is too deep for the parser and for generated code; arrays are flat.
            values = f"array({', '.join(f'cast(`{f}` as double)' for f in chosen)})"
            if self.values:
                places = ", ".join(str(at[f]) for f in chosen)
                whole = f"transform(`{self.values}`, x -> cast(x as double))"
                values = whole if chosen == self.features else f"transform(array({places}), i -> cast(`{self.values}`[i] as double))"
            return [F.expr(f"aggregate(zip_with({values}, array({', '.join(n)}), (x, w) -> x * w), 0.0D, (s, x) -> s + x)") for n in numbers]
        return [F.expr(" + ".join(f"`{f}` * {x}" for f, x in zip(chosen, n)) if n else "0.0D") for n in numbers]

    def score_split(self, df: DataFrame) -> DataFrame:
        """Each party's part of the score, and their sum."""
        cut = self.split_col if self.split_col is not None else len(self.features)
        z_c, z_p = self.margins(self.features[:cut]), self.margins(self.features[cut:])
        pack = (lambda z: z[0]) if self.width == 1 else (lambda z: F.array(*z))
        both = pack([a + b for a, b in zip(z_c, z_p)])
        return df.withColumns({"z_company": pack(z_c), "z_partner": pack(z_p), "z": both})

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Add the label: rounded probability, first best class, or the margin's sign."""
        z = self.margins()
        several = self.width > 1
        z = F.array(*z) if several else z[0]
        if self.objective == HINGE:
            label = scores.sign_label(z, several)
        else:
            p = scores.activation(self.objective, z)
            df = df.withColumn("probability", p)
            label = scores.to_int_labels(F.col("probability"), several)
        if several:
            label = F.element_at(F.array(*map(F.lit, self.classes)), label + 1)
        return df.withColumn(out, label)

    def weight_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f, c, float(self.weights[i, c])) for i, f in enumerate(self.features) for c in range(self.width)]
        return spark.createDataFrame(rows, "feature string, cls int, weight double")

    def weights_split(self, spark: SparkSession, split_col: int | None = None) -> tuple[DataFrame, DataFrame]:
        """First ``split_col`` features' weights to company, the rest to partner."""
        cut = split_col if split_col is not None else self.split_col
        left = F.col("feature").isin(self.features[:cut])
        table = self.weight_table(spark)
        return table.where(left), table.where(~left)


# --- one gradient step ---------------------------------------------------------------------------


def residual_sums(frame: DataFrame, model: LinearModel, label: str) -> tuple[np.ndarray, int]:
    """``X' r`` and the row count; r is p - y, or -y on rows inside the SVM's margin.

    A handful of sums is one aggregate in generated code. Beyond that every task multiplies
    its Arrow batches with NumPy and passes on a single small matrix. Rows without a label or
    with a missing (null or NaN) feature take no part, in the sums or in the count.
    """
    if model.values:
        frame = complete_arrays(frame, model.values, len(model.features), label)
        parts = frame.select(F.col(model.values).alias("values"), F.col(label).alias("label"))
        return _added(model, parts.mapInArrow(_partial_arrays(model), "i int, c int, v double"))
    frame = complete(frame, model.features, label)
    if model.width == 1 and len(model.features) <= INLINE_SUMS:
        r = residual(model, model.margins()[0], F.col(label))
        held = frame.select(*model.features, r.alias("_r"))
        sums = [f"sum(`{f}` * _r) AS s{i}" for i, f in enumerate(model.features)]
        row = held.selectExpr(*sums, "count(1) AS n").first()
        return np.array([[row[f"s{i}"] or 0.0] for i in range(len(model.features))]), row["n"]
    return _added(model, frame.select(*model.features, label).mapInPandas(_partial_sums(model, label), "i int, c int, v double"))


def _added(model: LinearModel, parts: DataFrame) -> tuple[np.ndarray, int]:
    """Partial sums of the tasks together; features x classes numbers come back."""
    sums = np.zeros_like(model.weights)
    rows = 0
    for p in parts.groupBy("i", "c").agg(F.sum("v").alias("v")).collect():
        if p["i"] < 0:
            rows = int(p["v"])
        else:
            sums[p["i"], p["c"]] = p["v"]
    return sums, rows


def complete(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows that have a label and all features."""
    return df.dropna(subset=list(dict.fromkeys([*features, label])))


def complete_arrays(df: DataFrame, values: str, width: int, label: str) -> DataFrame:
    """Rows that have a label and an array of so many values, none of them missing."""
    missing = F.exists(values, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")) & (F.size(values) == width) & ~missing)


def residual(model: LinearModel, z: Column, y: Column) -> Column:
    if model.objective == HINGE:
        return F.when(y * z < 1, -y).otherwise(F.lit(0.0))
    return scores.activation(model.objective, z) - y


def _some(sums: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    if not sums[1]:
        raise ValueError("no rows to train on: none has a label and all features")
    return sums


def _partial_sums(model: LinearModel, label: str) -> Callable:
    names, add, zero = list(model.features), *_adding(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = zero.copy(), 0
        for batch in batches:
            total += add(batch[names].to_numpy(dtype=float), batch[label].to_numpy())
            rows += len(batch)
        yield pd.DataFrame(_long(total, rows))

    return run


def _partial_arrays(model: LinearModel) -> Callable:
    add, zero = _adding(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = zero.copy(), 0
        for batch in batches:
            if batch.num_rows:
                total += add(matrix_of(batch, ["values"]), batch.column("label").to_numpy(zero_copy_only=False))
                rows += batch.num_rows
        found = _long(total, rows)
        yield pa.RecordBatch.from_arrays([pa.array(found["i"].astype(np.int32)), pa.array(found["c"].astype(np.int32)), pa.array(found["v"])], ["i", "c", "v"])

    return run


def _long(total: np.ndarray, rows: int) -> dict[str, np.ndarray]:
    """Sums by place, and the number of rows at feature -1."""
    i, c = np.indices(total.shape)
    return {"i": np.append(i.ravel(), -1), "c": np.append(c.ravel(), 0), "v": np.append(total.ravel(), float(rows))}


def _adding(model: LinearModel) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], np.ndarray]:
    """``X' r`` of some rows, for workers, and sums to start from."""
    w, objective, classes = model.weights.copy(), model.objective, model.classes
    off = -1.0 if objective == HINGE else 0.0

    def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        y = np.where(y[:, None] == np.array(classes)[None, :], 1.0, off) if classes else y[:, None].astype(float)
        z = x @ w
        if objective == HINGE:
            r = np.where(y * z < 1, -y, 0.0)
        elif objective == scores.PIECEWISE:
            r = np.clip(z + 0.5, 0.0, 1.0) - y
        elif objective == scores.SOFTMAX:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            r = e / e.sum(axis=1, keepdims=True) - y
        else:
            r = 1.0 / (1.0 + np.exp(-z)) - y
        return x.T @ r

    return add, np.zeros_like(w)


# --- logistic regression -------------------------------------------------------------------------


def lr_fit(
    df: DataFrame,
    features: list[str],
    label: str = "y",
    classes: list | int | None = None,
    lambda_: float = 0.0,
    lr: float = 0.1,
    n_epochs: int = 10,
    batch_size: int | None = None,
    order_by: list[str] | None = None,
    share_y: bool = False,
    split_col: int | None = None,
    validation: DataFrame | None = None,
    val_steps: int = 1,
    write: bool = True,
    values: str | None = None,
    store: RunStore | None = None,
) -> LinearModel:
    """Gradient descent from zero weights with step ``lr / t`` in epoch t.

    ``w <- (1 - lambda) w - (step / b) X'(p - y)``. ``batch_size=None`` takes one step per
    epoch over all rows, which is the form for large tables; with a batch size, contiguous
    batches in the order of ``order_by`` are cut once and each read by its own row ranges.
    ``values`` names an array column that holds all features in order, instead of named columns.
    With a ``store`` the weights are kept after each epoch, and training goes on after the last one.
    """
    if isinstance(classes, int):
        classes = label_classes(df, label, classes) if classes > 1 else None
    width = len(classes) if classes else 1
    objective = scores.pick_objective("classification", width, share_y)
    df = complete_arrays(df, values, len(features), label) if values else complete(df, features, label)
    model = LinearModel(list(features), objective, classes, lambda_, np.zeros((len(features), width)), split_col, values=values)
    finished, step = store.steps()[:n_epochs] if store else [], 0
    if finished:
        model.weights, step = np.array(finished[-1]["weights"], float), finished[-1]["step"]
        model.curve += [tuple(point) for state in finished for point in state["curve"]]
        if len(finished) == n_epochs:
            return model
    batches = _batches(df, [values] if values else features, label, batch_size, order_by, write)
    for epoch in range(len(finished) + 1, n_epochs + 1):
        points = len(model.curve)
        for batch in batches():
            sums, rows = _some(residual_sums(batch, model, label))
            model.weights = (1.0 - lambda_) * model.weights - (lr / epoch / rows) * sums
            if validation is not None and step % val_steps == 0:
                model.curve.append(("validation", step, evaluate(model, validation, label)))
            step += 1
        if store:
            store.add_step(epoch - 1, {"weights": model.weights.tolist(), "step": step, "curve": model.curve[points:]})
    return model


def _batches(df: DataFrame, features: list[str], label: str, batch_size: int | None, order_by: list[str] | None, write: bool) -> Callable:
    needed = list(dict.fromkeys([*features, label]))
    if batch_size is None:
        frame = df.select(*needed)
        frame = materialise(frame, "train") if write else frame
        return lambda: [frame]
    if not order_by:
        raise ValueError("mini-batches need an order: pass order_by")
    placed = position_rows(df.select(*dict.fromkeys([*order_by, *needed])), *order_by)
    return lambda: iter_batches(placed, batch_size)


def evaluate(model: LinearModel, df: DataFrame, label: str = "y") -> float:
    """Accuracy of the model on a table."""
    row = model.predict(df).agg(accuracy(F.col(label), F.col("prediction")).alias("a")).first()
    return row["a"]


# --- linear SVM ------------------------------------------------------------------------------------


def svm_fit(
    df: DataFrame,
    features: list[str],
    label: str = "y",
    classes: list | int | None = None,
    lambda_: float = 1e-5,
    n_steps: int = 5000,
    batch_size: int | None = 64,
    id: str = "id",
    seed: int = 0,
    validation: DataFrame | None = None,
    val_steps: int = 50,
    write: bool = True,
    values: str | None = None,
) -> LinearModel:
    """Sub-gradient steps with rate ``1 / (lambda t)``; labels -1/+1, or one-vs-rest classes.

    ``w <- (1 - rate lambda) w + (rate / b) sum(y x over rows with y f(x) < 1)``. A batch is
    drawn anew for each step, without replacement, by one law at every size; ``batch_size=None``
    uses all rows in every step. ``values`` names an array column of all features.
    """
    if isinstance(classes, int):
        classes = label_classes(df, label, classes) if classes > 1 else None
    width = len(classes) if classes else 1
    df = complete_arrays(df, values, len(features), label) if values else complete(df, features, label)
    model = LinearModel(list(features), HINGE, classes, lambda_, np.zeros((len(features), width)), values=values)
    needed = list(dict.fromkeys([*([values] if values else features), label]))
    if batch_size is None:
        frame = df.select(*needed)
        frame = materialise(frame, "train") if write else frame
        batches: Iterator[DataFrame] = (frame for _ in range(n_steps))
    else:
        placed = position_rows(df.select(*dict.fromkeys([id, *needed])), id)
        if not placed.rows:
            raise ValueError("no rows to train on: none has a label and all features")
        batches = _drawn(placed, n_steps, batch_size, seed)
    for t, batch in enumerate(batches, start=1):
        sums, rows = _some(residual_sums(batch, model, label))
        rate = 1.0 / (lambda_ * t)
        model.weights = (1.0 - rate * lambda_) * model.weights - (rate / rows) * sums
        if validation is not None and t % val_steps == 0:
            model.curve.append(("validation", t, evaluate(model, validation, label)))
    return model


def draw_keys(seed: int, step: int) -> list[tuple[int, int, int]]:
    """What a step's permutation is made of: for each round a shift, a factor and an addend."""
    rng = np.random.default_rng([seed, step])
    return [(int(rng.integers(2**62)), int(rng.integers(1, PRIME)), int(rng.integers(PRIME))) for _ in range(ROUNDS)]


def permuted(x: str, keys: str, rows: int) -> str:
    """SQL text for the place of ``x`` in a random permutation of the numbers below ``rows``.

    Each round pairs the numbers that add up to its shift and swaps a pair or not, by a hash of its
    larger one. A round undoes itself, so reversed keys give the inverse.
    """
    other = f"pmod(k.shift - x, {rows}L)"
    coin = f"(greatest(x, {other}) % {PRIME}L * k.times + k.plus) % {PRIME}L < {PRIME // 2}L"
    return f"aggregate({keys}, {x}, (x, k) -> if({coin}, {other}, x))"


def _drawn(placed: Positioned, n_steps: int, size: int, seed: int) -> Iterator[DataFrame]:
    """Batches without replacement: step t has the rows whose places a permutation puts below ``size``.

    The inverse permutation names the rows of many small batches at once; those are fetched in one
    scan and written, then read step by step. A batch over ``DRAWN_ROWS`` is a filter on the scan.
    Both ways give the same rows.
    """
    spark = placed.df.sparkSession
    size = min(size, placed.rows)
    numbered = placed.with_position("_pos")
    if size > DRAWN_ROWS:
        for t in range(n_steps):
            keys = ", ".join(f"named_struct('shift', {a}L, 'times', {b}L, 'plus', {c}L)" for a, b, c in draw_keys(seed, t))
            yield numbered.where(f"{permuted('_pos', f'array({keys})', placed.rows)} < {size}L").drop("_pos")
        return
    at_once = min(DRAWN_ROWS // size, DRAWN_STEPS)
    for low in range(0, n_steps, at_once):
        steps = range(low, min(low + at_once, n_steps))
        keys = spark.createDataFrame([(t, draw_keys(seed, t)) for t in steps], "_step int, _keys array<struct<shift:bigint,times:bigint,plus:bigint>>")
        draws = keys.selectExpr("_step", "reverse(_keys) AS _keys", f"explode(sequence(0L, {size - 1}L)) AS _i")
        wanted = F.broadcast(draws.selectExpr("_step", f"{permuted('_i', '_keys', placed.rows)} AS _pos"))  # DRAWN_ROWS at most
        fetched = numbered.join(wanted, "_pos").drop("_pos")
        stored = materialise(fetched.repartition("_step").sortWithinPartitions("_step"), "drawn")
        for t in steps:
            yield stored.where(F.col("_step") == t)
