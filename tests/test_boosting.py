"""The boosters against a plain booster in memory, leaf-wise growth against one leaf at a time, and odd rows."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fleetwear.operators import boosting
from fleetwear.operators.boosting import LIGHTGBM, XGBOOST, best_split, fit_boosters

WIDTH, CLASSES = 5, 3
SMALL = replace(XGBOOST, classes=CLASSES, rounds=8, depth=3, share=1.0, least_loss=0.0)
LEAFY = replace(LIGHTGBM, classes=CLASSES, rounds=8, leaves=6, least_rows=5, top=None, least_loss=0.0)


def rows(n=240, seed=1):
    """Few values a feature, so that every middle is a border; classes depend on two features at once; some values are missing."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x = [float(rng.randrange(9)) for _ in range(WIDTH)]
        y = int(x[0] > 4) + int(x[0] > 4 and x[1] > 3)
        y = rng.randrange(CLASSES) if rng.random() < 0.1 else y
        x[2] = None if k % 11 == 0 else x[2]
        x[3] = float("nan") if k % 13 == 0 else x[3]
        out.append((k, y, x))
    return out


def scored(model, df):
    return model.transform(df).withColumn("probability", vector_to_array("probability")).orderBy("key").collect()


def frame(spark, data, parts=4):
    return spark.createDataFrame(data, "key long, label int, features array<double>").repartition(parts).withColumn("model", F.lit(0))


class Plain:
    """The same boosting in memory, one node after another, histograms over all rows of a node."""

    def __init__(self, data, cfg):
        x = np.array([[np.nan if v is None else v for v in r[2]] for r in data])
        self.cfg, self.y = cfg, np.array([r[1] for r in data])
        borders = [(np.unique(c)[:-1] + np.unique(c)[1:]) / 2 for c in (x[~np.isnan(x[:, f]), f] for f in range(WIDTH))]
        self.bins = boosting.to_bins(x, borders)
        self.margins = np.zeros((len(data), cfg.classes))
        for _ in range(cfg.rounds):
            p = boosting._probabilities(self.margins)
            step = np.zeros_like(self.margins)
            for k in range(cfg.classes):
                g, h = p[:, k] - (self.y == k), np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)
                step[:, k] = self.leaf_wise(g, h) if cfg.leaves else self.level(g, h, np.arange(len(g)), 0)
            if not step.any():
                break
            self.margins += step

    def sums(self, g, h, of):
        out = np.zeros((WIDTH, 256, 3))
        for f in range(WIDTH):
            np.add.at(out[f], self.bins[of, f], np.stack([g[of], h[of], np.ones(len(of))], 1))
        return out

    def parts(self, s, of):
        b = self.bins[of, s.feature]
        left = np.where(b == 255, s.missing_left, b <= s.cut)
        return of[left], of[~left]

    def value(self, g, h, of):
        return -self.cfg.rate * g[of].sum() / (h[of].sum() + self.cfg.ridge + 1e-12)

    def level(self, g, h, of, depth):
        out = np.zeros(len(g))
        s = best_split(self.sums(g, h, of), self.cfg) if depth < self.cfg.depth else None
        if s is None or s.gain <= self.cfg.least_gain:
            out[of] = self.value(g, h, of) if depth else 0.0
            return out
        return sum(self.level(g, h, part, depth + 1) for part in self.parts(s, of))

    def leaf_wise(self, g, h):
        leaves, made = [(0, np.arange(len(g)))], 1
        while len(leaves) < self.cfg.leaves:
            found = [(best_split(self.sums(g, h, of), self.cfg), n, of) for n, of in leaves]
            s, n, of = max(found, key=lambda t: t[0].gain)
            if s.gain <= self.cfg.least_gain:
                break
            leaves = [leaf for leaf in leaves if leaf[0] != n] + [(made + i, part) for i, part in enumerate(self.parts(s, of))]
            made += 2
        out = np.zeros(len(g))
        for _, of in leaves if len(leaves) > 1 else []:
            out[of] = self.value(g, h, of)
        return out


@pytest.mark.parametrize("cfg", [SMALL, LEAFY], ids=["level", "leaf"])
def test_same_probabilities_as_in_memory(spark, cfg):
    data = rows()
    model = fit_boosters(frame(spark, data), {0: cfg}, WIDTH)[0]
    got = scored(model, frame(spark, data))
    want = boosting._probabilities(Plain(data, cfg).margins)
    assert np.allclose([r.probability for r in got], want, atol=1e-9)
    spec = model.spec
    assert len(spec["rounds"]) == cfg.rounds and sum(model.featureImportances) == pytest.approx(1)


def test_leaves_counted_ahead_change_no_tree(spark):
    data = frame(spark, rows(seed=2))
    one, more = fit_boosters(data, {0: replace(LEAFY, ahead=1)}, WIDTH)[0], fit_boosters(data, {0: replace(LEAFY, ahead=5)}, WIDTH)[0]
    of = lambda m: [r.probability for r in scored(m, data)]
    assert np.allclose(of(one), of(more), atol=1e-12)


def test_models_grown_together_are_those_grown_alone(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_EVERY", 2)
    a, b = frame(spark, rows(seed=3)), frame(spark, rows(90, seed=4))
    alone = [fit_boosters(a, {0: SMALL}, WIDTH)[0].spec, fit_boosters(b, {0: LEAFY}, WIDTH)[0].spec]
    both = fit_boosters(a.unionByName(b.withColumn("model", F.lit(7))), {0: SMALL, 7: LEAFY}, WIDTH)
    for x, y in zip(alone, (both[0].spec, both[7].spec), strict=True):
        assert [[t["feature"] for t in r] for r in x["rounds"]] == [[t["feature"] for t in r] for r in y["rounds"]]


def test_one_sided_sampling_keeps_large_gradients(spark):
    cfg = replace(LIGHTGBM, classes=CLASSES, rounds=8, leaves=8, least_rows=5, rate=0.5, top=0.3, other=0.2, least_loss=0.0)
    data = rows(600, seed=5)
    model = fit_boosters(frame(spark, data), {0: cfg}, WIDTH)[0]
    assert sum(r.label == r.prediction for r in scored(model, frame(spark, data))) > 0.85 * len(data)


def test_stops_early_and_gives_the_best_round(spark):
    train, valid = rows(200, seed=6), [(k, random.Random(k).randrange(CLASSES), x) for k, _, x in rows(100, seed=7)]
    marked = frame(spark, train).withColumn("is_valid", F.lit(False)).unionByName(frame(spark, valid).withColumn("is_valid", F.lit(True)))
    model = fit_boosters(marked, {0: replace(SMALL, rounds=40, patience=2)}, WIDTH)[0]
    assert len(model.spec["rounds"]) < 10


def test_odd_rows(spark, tmp_path):
    data = [(1, None, [1.0] * WIDTH), (2, 1, None), (3, 1, [2.0] * WIDTH), (4, 0, [None] * WIDTH), (5, 2, [1.0]), (5, 2, [1.0])]
    model = fit_boosters(frame(spark, data), {0: SMALL}, WIDTH)[0]
    none = fit_boosters(frame(spark, data).filter("false"), {0: SMALL}, WIDTH)[0]
    got = scored(none, frame(spark, data))
    assert len(got) == 6 and all(r.prediction == 0 and np.allclose(r.probability, 1 / 3) for r in got)
    path = str(tmp_path / "model")
    PipelineModel(stages=[model]).write().save(path)
    assert PipelineModel.load(path).stages[0].spec == model.spec
