"""A linear softmax student of hard labels and a teacher's scores, at any student temperature.

The loss is ``(1 - alpha) * CE(z, label) + alpha * T^2 * KL(teacher, softmax(z / T))``, averaged over the rows. Every step sums loss
and gradient over the rows in tasks, a number for each class and feature; Spark adds the tasks' sums, and the driver, which holds one
vector of that size and a few earlier ones, takes an L-BFGS step. Rows never leave their tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.runtime import settle

HISTORY = 10  # steps that L-BFGS remembers


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def loss_and_slope(weights: np.ndarray, x: np.ndarray, label: np.ndarray, teacher: np.ndarray, alpha: float, temperature: float):
    """Sum of the loss over rows ``x`` (last column 1) and its gradient by ``weights`` (classes x columns)."""
    z = x @ weights.T
    hard, soft = _log_softmax(z), _log_softmax(z / temperature)
    at = np.arange(len(x))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(teacher > 0, teacher * np.log(teacher), 0.0).sum()
    kd = entropy - (teacher * soft).sum()
    loss = (1 - alpha) * -hard[at, label].sum() + alpha * temperature**2 * kd
    by_z = (1 - alpha) * np.exp(hard) + alpha * temperature * (np.exp(soft) * teacher.sum(axis=1, keepdims=True) - teacher)
    by_z[at, label] -= 1 - alpha
    return loss, by_z.T @ x


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if column.null_count or any(n != width for n in np.diff(column.offsets.to_numpy())):
        raise ValueError(f"every row needs {width} values")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, alpha: float, temperature: float):
    """Mean loss and gradient over all rows: place -1 holds the loss, -2 the number of rows."""
    classes, width = len(weights), len(mean)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slope, n = 0.0, np.zeros_like(weights), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (_matrix(batch.column("features"), width) - mean) * scale
            x = np.hstack([x, np.ones((len(x), 1))])
            loss, by = loss_and_slope(weights, x, batch.column("label").to_numpy(), _matrix(batch.column("scores"), classes), alpha, temperature)
            total, slope, n = total + loss, slope + by, n + len(x)
        if n:
            sums = np.concatenate([[n, total], slope.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(sums) - 2), pa.int32()), pa.array(sums, pa.float64())], ["place", "value"])

    sums = rows.mapInArrow(add, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = np.zeros(2 + weights.size)
    for row in sums.collect():  # one number for each class and feature
        found[row["place"] + 2] = row["value"]
    n = max(found[0], 1.0)
    return found[1] / n, found[2:].reshape(weights.shape) / n


def minimise(f: Callable, start: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """L-BFGS with step halving; ``f`` gives value and gradient."""
    x, (value, slope) = start, f(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max(initial=0.0) <= tolerance:
            break
        q, shares = slope.copy(), []
        for s, y in reversed(moves):
            shares.append((s * q).sum() / (s * y).sum())
            q -= shares[-1] * y
        if moves:
            s, y = moves[-1]
            q *= (s * y).sum() / (y * y).sum()
        for (s, y), share in zip(moves, reversed(shares)):
            q += s * (share - (y * q).sum() / (s * y).sum())
        step, down = 1.0, (slope * q).sum()
        for _ in range(30):
            there = x - step * q
            new, new_slope = f(there)
            if new <= value - 1e-4 * step * down:
                break
            step /= 2
        else:
            break
        s, y = there - x, new_slope - slope
        if (s * y).sum() > 1e-12 * (y * y).sum():
            moves = [*moves, (s, y)][-HISTORY:]
        gain, x, value, slope = value - new, there, new, new_slope
        if gain <= tolerance * max(abs(value), 1e-6):
            break
    return x


class SoftmaxModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction``, ``probability`` (at temperature 1) and ``prediction``; the weights are a JSON parameter and are saved with it."""

    weights = Param(Params._dummy(), "weights", "weights of every class, the constant last, as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "features column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, weights: str | None = None, featuresCol: str = "features"):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def matrix(self) -> np.ndarray:
        return np.array(json.loads(self.getOrDefault(self.weights)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, matrix = self.getOrDefault(self.featuresCol), self.matrix

        @F.pandas_udf("array<double>")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for features in parts:
                if not len(features):
                    yield pd.Series([], dtype=object)
                    continue
                yield pd.Series(list(np.stack(features.to_numpy()) @ matrix[:, :-1].T + matrix[:, -1]))

        values = F.col(name)
        if dataset.schema[name].dataType.typeName() != "array":
            values = vector_to_array(name)
        top = F.array_max("_z")
        powers = F.transform("_z", lambda z: F.exp(z - top))
        total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
        scored = dataset.withColumn("_z", score(values))
        return scored.withColumns(
            {
                "rawPrediction": array_to_vector("_z"),
                "probability": array_to_vector(F.transform(powers, lambda p: p / total)),
                "prediction": (F.array_position("_z", top) - 1).cast("double"),
            }
        ).drop("_z")


def fit_softmax_student(rows: DataFrame, alpha: float, temperature: float, steps: int = 100, tolerance: float = 1e-5) -> SoftmaxModel:
    """Fit on ``features ARRAY<DOUBLE>, label INT, scores ARRAY<DOUBLE>``; ``scores`` are the teacher's probabilities.

    Features are centred and scaled by all rows first; the weights returned are those of the unscaled ones.
    """
    if not temperature > 0 or not 0 <= alpha <= 1:
        raise ValueError("temperature must be positive and alpha in [0, 1]")
    rows = settle(rows.select(F.col("features").cast("array<double>"), F.col("label").cast("int"), F.col("scores").cast("array<double>")), "student")
    sizes = rows.agg(F.max(F.size("features")).alias("width"), F.max(F.size("scores")).alias("classes")).first()
    if sizes["width"] is None:
        raise ValueError("no rows to learn from")
    width, classes = sizes["width"], sizes["classes"]
    places = rows.select(F.posexplode("features").alias("place", "value")).groupBy("place")
    stats = places.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).collect()  # one row a feature
    mean, scale = np.zeros(width), np.ones(width)
    for row in stats:
        mean[row["place"]] = row["mean"]
        scale[row["place"]] = 1 / row["std"] if row["std"] > 0 else 0.0
    found = minimise(lambda w: _summed(rows, w, mean, scale, alpha, temperature), np.zeros((classes, width + 1)), steps, tolerance)
    weights = found[:, :-1] * scale
    constant = found[:, -1] - weights @ mean
    return SoftmaxModel(weights=json.dumps(np.hstack([weights, constant[:, None]]).tolist()))
