"""Forests on folded rows against plain counts, and the scenario loop that uses them."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.ml import PipelineModel

from fleetwear.operators import forests, models
from fleetwear.plans import grids


def scenario_rows(spark, n=4000):
    """Four classes by two of three features; scenario 1 hides the third. Few values, so that many rows are alike."""
    draw = np.random.default_rng(5)
    rows = [(k, int(2 * (a > 4) + (b > 2)), [float(a), float(b), -1.0 if k else float(c)]) for a, b, c in draw.integers(0, [9, 5, 7], (n, 3)).tolist() for k in (0, 1)]
    return spark.createDataFrame(rows, "scenario int, label int, features array<double>")


def accuracy(model, rows):
    return models.predict(model, rows).selectExpr("avg(CAST(label = prediction AS INT)) AS a").first()["a"]


def test_folded_rows_are_whole_and_forests_learn(spark):
    rows = scenario_rows(spark)
    blocks = forests._blocks(rows.selectExpr("scenario", "label", *[f"features[{i}] AS f{i}" for i in range(3)]), [np.arange(8) + 0.5] * 3)
    counts = [np.frombuffer(r["counts"], np.int64) for r in blocks.collect()]
    assert sum(c.sum() for c in counts) == 8000 and sum(map(len, counts)) == rows.distinct().count()
    found = forests.fit_forests(rows, {0: range(1), 1: range(2)}, forests.Forest())
    for model in found.values():
        assert len(model.spec["trees"]) == 20
        assert accuracy(PipelineModel(stages=[model]), rows) == 1.0
        weights = model.featureImportances
        assert weights[2] < 0.1 and sum(weights) == pytest.approx(1.0)
    drawn = [sum(t["counts"][0]) for t in found[1].spec["trees"]]  # 8,000 rows, drawn with replacement
    assert len(set(drawn)) > 1 and np.mean(drawn) == pytest.approx(8000, rel=0.02)


def test_a_split_is_the_best_by_gini():
    sums = np.zeros((1, 2, forests.BINS, 2))
    sums[0, 0, :4] = [[5, 0], [4, 1], [1, 6], [0, 3]]
    sums[0, 1, :2] = [[5, 5], [5, 5]]
    gain, place, cut, low, total = (x[0] for x in forests.best_splits(sums))
    gini = lambda a, b: 1 - (a**2 + b**2) / (a + b) ** 2
    assert (place, cut, low.tolist(), total.tolist()) == (0, 1, [9, 1], [10, 10])
    assert gain == pytest.approx(gini(10, 10) - gini(9, 1) / 2 - gini(1, 9) / 2)


def test_many_rows_are_fitted_together(spark, monkeypatch, tmp_path):
    rows, fits = scenario_rows(spark), []
    real = grids.fit
    monkeypatch.setattr(grids, "fit", lambda *a, **k: fits.append(a) or real(*a, **k))
    monkeypatch.setattr(grids, "FOLD_ABOVE", 1000)
    found, report = grids.train_scenarios("random_forest", rows, rows, range(2), save_to=str(tmp_path))
    assert not fits and {r["scenario"]: r["f1"] for r in report.filter("class = 'macro avg'").collect()} == {0: 1.0, 1: 1.0}
    again = PipelineModel.load(f"{tmp_path}/scen_1")
    assert models.predict(again, rows).collect() == models.predict(found[1], rows).collect()
    grids.train_scenarios("random_forest", rows, rows, [0], params={"impurity": "entropy"})
    monkeypatch.setattr(grids, "FOLD_ABOVE", 10_000)
    grids.train_scenarios("random_forest", rows, rows, [0])
    assert len(fits) == 2  # few rows, and what only Spark's forests have, go to Spark's


@pytest.mark.parametrize("row", [(0, None, [1.0]), (0, 1, None), (0, 1, [None]), (0, 1, [float("nan")])])
def test_rows_that_sparks_forests_refuse(spark, row):
    rows = spark.createDataFrame([(0, 0, [1.0]), row], "scenario int, label int, features array<double>")
    with pytest.raises(Exception, match="a training row has no|is missing|not a number"):
        forests.fit_forests(rows, {0: [0]}, forests.Forest())
