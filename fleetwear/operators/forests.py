"""Random forests on folded rows: the forests of ``random_forest``, for more rows than its cache of single rows holds well.

Rows are binned once; rows with equal bins, label and scenario become one cell with a count. A bootstrap draw of a cell of ``n`` rows
is Poisson of mean ``n``, which is what ``n`` rows drawn one by one add up to, so no row is left out and none is weighed otherwise. One job
serves a level of all trees of all models: tasks sum the classes by (tree, node, feature, bin) over their cells, Spark adds the sums,
and the driver receives splits. Work after the first pass grows with the cells, which the bins bound, and cells are stored, never cached.

As in Spark's forests: Gini gain, at least one drawn row a side, the square root of the features drawn for every node, at most 256 bins,
sibling leaves of one class merged, the mean of the trees' class shares. The draws are others than Spark's.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.runtime import settle

CUT_ROWS = 200_000  # rows that bin borders are taken from, drawn when there are more
BINS = 256
_HELD = 64 << 20  # bytes of sums a task holds


@dataclass(frozen=True)
class Forest:
    trees: int = 20
    depth: int = 5
    bins: int = BINS
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: the children of ``i`` are ``2 i + 1`` and ``2 i + 2``. A leaf has feature -1; values at or below a cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    counts: np.ndarray  # drawn rows of each class

    @classmethod
    def of(cls, depth: int, classes: int) -> Tree:
        nodes = 2 ** (depth + 1) - 1
        return cls(np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes), np.zeros((nodes, classes)))

    def prune(self) -> None:
        """Two leaves of one class become one, from below."""
        for i in range(len(self.feature) // 2 - 1, -1, -1):
            a, b = 2 * i + 1, 2 * i + 2
            if self.feature[i] >= 0 and self.feature[a] < 0 and self.feature[b] < 0 and self.counts[a].argmax() == self.counts[b].argmax():
                self.feature[i] = -1


def leaf_of(feature: np.ndarray, cut: np.ndarray, x: np.ndarray, levels: int) -> np.ndarray:
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(levels):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (x[rows, f] > cut[node]), node)
    return node


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """For sums of (nodes x drawn features x bins x classes): gain, feature's place, cut and class counts below, and all class counts."""
    total = sums[:, 0].sum(1)
    low = np.cumsum(sums, axis=2)[:, :, :-1]
    high = total[:, None, None] - low
    rows = np.maximum(total.sum(-1), 1)[:, None, None]
    alike = lambda s: (s**2).sum(-1) / np.maximum(s.sum(-1), 1)  # noqa: E731  rows less Gini impurity times rows
    gain = (alike(low) + alike(high) - alike(total)[:, None, None]) / rows
    gain = np.where(np.minimum(low.sum(-1), high.sum(-1)) >= 1, gain, 0.0).reshape(len(sums), -1)
    best = gain.argmax(1)
    place, cut = np.divmod(best, low.shape[2])
    at = np.arange(len(sums))
    return gain[at, best], place, cut, low[at, place, cut], total


def _values(rows: DataFrame) -> Column:
    known = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(F.raise_error(F.lit("a training row has no features")))
    return known if rows.schema["features"].dataType.typeName() == "array" else vector_to_array(known)


def _columns(values: Column, width: int) -> list[Column]:
    """The features one by one; a missing one is an error, as in an ML vector made of the array."""
    missing = F.raise_error(F.lit("a feature is missing"))
    return [F.coalesce(F.get(values, F.lit(i)).cast("double"), missing).alias(f"f{i}") for i in range(width)]


def bin_borders(rows: DataFrame, width: int, bins: int, seed: int) -> list[np.ndarray]:
    """Per feature the borders between bins, middles of neighbouring values: all values if they are few; otherwise values that fill a bin
    have one of their own, and the others share the rest evenly."""
    count = rows.count()
    drawn = rows if count <= CUT_ROWS else rows.sample(CUT_ROWS / count, seed)
    cells = drawn.select(F.posexplode(F.array(*[f"f{i}" for i in range(width)])).alias("feature", "v"))

    def cut(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(frame["v"].to_numpy(), return_counts=True)
        if len(values) > bins:
            heavy = counts * bins >= counts.sum()
            light = np.repeat(values[~heavy], counts[~heavy])
            shared = np.quantile(light, np.linspace(0, 1, bins - heavy.sum()), method="nearest")
            values = np.unique(np.append(values[heavy], shared))
        return pd.DataFrame({"feature": [key[0]], "borders": [values[:-1] + (values[1:] - values[:-1]) / 2]})

    found = cells.groupBy("feature").applyInPandas(cut, "feature int, borders array<double>").collect()  # features x bins numbers
    borders = {r["feature"]: np.array(r["borders"], np.float64) for r in found}
    return [borders.get(i, np.zeros(0)) for i in range(width)]


_BLOCK = ("scenarios", "labels", "bins", "counts")


def _blocks(rows: DataFrame, borders: list[np.ndarray]) -> DataFrame:
    """Cells in blocks: ``block`` and the scenarios, labels, bins and counts of its cells."""
    width = len(borders)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("label").null_count:
                raise ValueError("a training row has no label")
            out = np.empty((batch.num_rows, width), np.uint8)
            for i, cut in enumerate(borders):
                v = batch.column(f"f{i}").to_numpy(zero_copy_only=False)
                if np.isnan(v).any():
                    raise ValueError("a feature of a training row is not a number")
                out[:, i] = np.searchsorted(cut, v, side="left")
            ends = pa.py_buffer(np.arange(0, (batch.num_rows + 1) * width, width, dtype=np.int32) if width else np.zeros(batch.num_rows + 1, np.int32))
            bins = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("scenario"), batch.column("label"), bins], names=["scenario", "label", "bins"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scenarios, labels, counts = (batch.column(c).to_numpy() for c in ("scenario", "label", "rows"))
                parts = (scenarios.tobytes(), labels.tobytes(), b"".join(batch.column("bins").to_pylist()), counts.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=list(_BLOCK))

    binned = rows.mapInArrow(to_bins, "scenario int, label int, bins binary")
    cells = binned.groupBy("scenario", "label", "bins").agg(F.count(F.lit(1)).alias("rows"))
    blocks = cells.mapInArrow(pack, ", ".join(f"{c} binary" for c in _BLOCK))
    spread = blocks.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)  # a level is one pass over few, heavy rows
    return settle(spread.withColumn("block", F.monotonically_increasing_id()), "cells")


def _unpack(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        scenarios, labels, bins, counts = (batch.column(c)[i].as_buffer() for c in _BLOCK)
        labels = np.frombuffer(labels, np.int32).astype(np.int64)
        yield batch.column("block")[i].as_py(), np.frombuffer(scenarios, np.int32), labels, np.frombuffer(bins, np.uint8).reshape(len(labels), width), np.frombuffer(counts, np.int64)


def _level(blocks: DataFrame, grown: dict, wanted: dict, sets: Mapping[int, Sequence[int]], cfg: Forest, level: int, classes: int, width: int) -> list:
    """The best split of every wanted node: ``model, tree, node, gain, feature, cut, low, total``. ``wanted``: (model, tree) -> nodes, drawn features."""
    plan = {at: (grown[at].feature, grown[at].cut, nodes, drawn) for at, (nodes, drawn) in wanted.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array([m for m, _ in held], pa.int32()), pa.array([t for _, t in held], pa.int32()), pa.array([s.tobytes() for s in held.values()], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["model", "tree", "sums"])

        for batch in batches:
            for block, scenarios, labels, bins, counts in _unpack(batch, width):
                of = {m: np.flatnonzero(np.isin(scenarios, some)) for m, some in sets.items()}
                for (m, t), (feature, cut, nodes, drawn) in plan.items():
                    rows = of[m]
                    weight = np.random.default_rng([cfg.seed, m, t, block]).poisson(counts[rows])
                    place = np.full(len(feature), -1)
                    place[nodes] = np.arange(len(nodes))
                    place = place[leaf_of(feature, cut, bins[rows], level)]
                    live = np.flatnonzero((place >= 0) & (weight > 0))
                    place, rows, weight = place[live], rows[live], weight[live].astype(np.float64)
                    sums = held.setdefault((m, t), np.zeros(drawn.size * BINS * classes))
                    for j in range(drawn.shape[1]):
                        flat = ((place * drawn.shape[1] + j) * BINS + bins[rows, drawn[place, j]]) * classes + labels[rows]
                        sums += np.bincount(flat, weight, len(sums))
                    if sum(s.nbytes for s in held.values()) > _HELD:
                        yield flush()
        if held:
            yield flush()

    def reduce(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for frame in frames:
            for raw in frame["sums"]:
                total = total + np.frombuffer(raw, np.float64)
        nodes, drawn = wanted[key[0], key[1]]
        gain, place, cut, low, whole = best_splits(total.reshape(*drawn.shape, BINS, classes))
        feature = drawn[np.arange(len(nodes)), place]
        yield pd.DataFrame({"model": key[0], "tree": key[1], "node": nodes, "gain": gain, "feature": feature, "cut": cut, "low": list(low), "total": list(whole)})

    found = blocks.mapInArrow(count, "model int, tree int, sums binary").groupBy("model", "tree")
    return found.applyInPandas(reduce, "model int, tree int, node int, gain double, feature int, cut int, low array<double>, total array<double>").collect()


def fit_forests(rows: DataFrame, sets: Mapping[int, Sequence[int]], cfg: Forest) -> dict[int, ForestModel]:
    """One forest for each model of ``sets``, which names its scenarios, on ``scenario, label, features``; all grown by the same jobs.

    Labels are 0 and up. As Spark's forests do, it refuses rows without a label, and features that are missing or not numbers.
    """
    values = _values(rows)
    first = rows.select(F.size(values).alias("n")).first()
    if first is None:
        raise ValueError("no training rows")
    width = first["n"]
    rows = rows.select(F.col("scenario").cast("int").alias("scenario"), F.col("label").cast("int").alias("label"), *_columns(values, width))
    borders = bin_borders(rows, width, cfg.bins, cfg.seed)
    classes = rows.agg(F.max("label")).first()[0] + 1
    blocks = _blocks(rows, borders)
    grown = {(m, t): Tree.of(cfg.depth, classes) for m in sets for t in range(cfg.trees)}
    size = width if cfg.trees == 1 else math.ceil(math.sqrt(width))
    open_nodes = {at: [0] for at in grown}
    for level in range(cfg.depth):
        draw = lambda m, t, node: np.sort(np.random.default_rng([cfg.seed, m, t, node]).permutation(width)[:size])
        wanted = {(m, t): (np.array(nodes), np.array([draw(m, t, n) for n in nodes])) for (m, t), nodes in open_nodes.items() if nodes}
        if not wanted:
            break
        open_nodes = {at: [] for at in wanted}
        for r in _level(blocks, grown, wanted, sets, cfg, level, classes, width):
            at, node = (r["model"], r["tree"]), r["node"]
            tree, low, total = grown[at], np.array(r["low"]), np.array(r["total"])
            tree.counts[node] = total
            if r["gain"] > 1e-12:
                tree.feature[node], tree.cut[node], tree.gain[node] = r["feature"], r["cut"], r["gain"]
                for child, counts in ((2 * node + 1, low), (2 * node + 2, total - low)):
                    tree.counts[child] = counts
                    if np.count_nonzero(counts) > 1:
                        open_nodes[at].append(child)
    return {m: ForestModel.of([grown[m, t] for t in range(cfg.trees)], borders, cfg.depth) for m in sets}


class ForestModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``prediction``; the trees are a JSON parameter and are saved with it."""

    trees = Param(Params._dummy(), "trees", "features, cuts as values and class counts of every tree, as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "features column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees: str | None = None, featuresCol: str = "features"):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, grown: Sequence[Tree], borders: list[np.ndarray], depth: int) -> ForestModel:
        trees = []
        for t in grown:
            t.prune()
            cut = [float(borders[f][int(b)]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.cut, strict=True)]
            trees.append({"feature": t.feature.tolist(), "cut": cut, "gain": t.gain.tolist(), "counts": t.counts.tolist()})
        return cls(trees=json.dumps({"width": len(borders), "depth": depth, "trees": trees}))

    @property
    def spec(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    @property
    def featureImportances(self) -> list[float]:  # noqa: N802  the name that Spark's tree models give it
        """The mean over trees of each feature's share of the gains, weighted by rows; a pruned node has none."""
        spec = self.spec
        whole = np.zeros(spec["width"])
        for t in spec["trees"]:
            own, live = np.zeros(spec["width"]), [0]
            while live:
                i = live.pop()
                if t["feature"][i] >= 0:
                    own[t["feature"][i]] += t["gain"][i] * sum(t["counts"][i])
                    live += [2 * i + 1, 2 * i + 2]
            whole += own / own.sum() if own.sum() else own
        return (whole / whole.sum() if whole.sum() else whole).tolist()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, spec = self.getOrDefault(self.featuresCol), self.spec
        depth, trees = spec["depth"], []
        for t in spec["trees"]:
            counts = np.array(t["counts"])
            trees.append((np.array(t["feature"]), np.array(t["cut"]), counts / np.maximum(counts.sum(1, keepdims=True), 1)))
        classes = trees[0][2].shape[1]
        shares = [f"p{k}" for k in range(classes)]

        @F.pandas_udf(", ".join(f"{c} double" for c in [*shares, "best"]))
        def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for columns in parts:
                x = np.column_stack([c.to_numpy() for c in columns])
                p = sum(share[leaf_of(feature, cut, x, depth)] for feature, cut, share in trees) / len(trees)
                yield pd.DataFrame(p, columns=shares).assign(best=p.argmax(1).astype(np.float64))

        values = F.col(name) if dataset.schema[name].dataType.typeName() == "array" else vector_to_array(name)
        scored = dataset.withColumn("_scored", score(*_columns(values, spec["width"])))
        probability = array_to_vector(F.array(*[F.col(f"_scored.{c}") for c in shares]))
        return scored.withColumns({"probability": probability, "prediction": F.col("_scored.best")}).drop("_scored")
