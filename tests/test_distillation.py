"""The student at any temperature, the teacher's loop, and the grid in one scan."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from fleetwear.operators import metrics, models
from fleetwear.operators.distillation import fit_softmax_student, loss_and_slope, minimise
from fleetwear.plans import grids
from fleetwear.queries.files import four_classes


def _rows(n=40, width=3, classes=4, seed=0):
    rng = np.random.default_rng(seed)
    x = np.hstack([rng.normal(size=(n, width)), np.ones((n, 1))])
    teacher = rng.dirichlet(np.ones(classes), n)
    teacher[0] = [0, 0, 1, 0]
    return x, rng.integers(0, classes, n), teacher, rng.normal(size=(classes, width + 1))


@pytest.mark.parametrize("temperature", [0.5, 1.0, 4.0])
@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_slope_by_finite_differences(alpha, temperature):
    x, label, teacher, weights = _rows()
    _, slope = loss_and_slope(weights, x, label, teacher, alpha, temperature)
    for place in np.ndindex(weights.shape):
        step = np.zeros_like(weights)
        step[place] = 1e-5
        up, down = (loss_and_slope(weights + d, x, label, teacher, alpha, temperature)[0] for d in (step, -step))
        assert abs((up - down) / 2e-5 - slope[place]) < 1e-4


def _frame(spark, x, label, teacher):
    rows = [([float(v) for v in f[:-1]], int(c), [float(v) for v in t]) for f, c, t in zip(x, label, teacher)]
    return spark.createDataFrame(rows, "features array<double>, label int, scores array<double>").repartition(3)


def test_student_has_the_least_loss(spark):
    """The distributed fit ends where a plain one on all rows ends, and its loss is the reported one."""
    x, label, teacher, _ = _rows(n=300)
    rows = _frame(spark, x, label, teacher)
    model = fit_softmax_student(rows, 0.5, 4.0, tolerance=1e-9)

    def mean(w):
        loss, slope = loss_and_slope(w, x, label, teacher, 0.5, 4.0)
        return loss / len(x), slope / len(x)

    best = mean(minimise(mean, np.zeros((4, 4)), 500, 1e-12))[0]
    assert abs(mean(model.matrix)[0] - best) < 1e-7
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows).withColumn("z", vector_to_array("rawPrediction"))
    told = metrics.distill_loss(scored, "scores", "z", "label", True, 0.5, 4.0, 4.0).first()["loss"]
    assert abs(told - best) < 1e-6


def test_temperature_one_agrees_with_weighted_rows(spark):
    x, label, teacher, _ = _rows(n=300)
    rows = _frame(spark, x, label, teacher)
    ours = models.PipelineModel(stages=[fit_softmax_student(rows, 0.5, 1.0, tolerance=1e-9)])
    spark_ml = models.fit_student(rows, 0.5, {"tol": 1e-10, "maxIter": 500})
    a, b = (np.stack([r["probability"] for r in models.predict(m, rows).sort("label", F.col("scores")[0]).collect()]) for m in (ours, spark_ml))
    assert np.abs(a - b).max() < 1e-4


def test_student_is_saved_and_no_rows_are_an_error(spark, tmp_path):
    x, label, teacher, _ = _rows()
    rows = _frame(spark, x, label, teacher)
    model = models.fit_student(rows, student_temperature=2.0)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = models.PipelineModel.load(str(tmp_path / "m"))
    pick = lambda m: sorted(map(str, models.predict(m, rows).select("label", "prediction").collect()))
    assert pick(back) == pick(model)
    with pytest.raises(ValueError):
        models.fit_student(rows.limit(0), student_temperature=2.0)


def test_grid_reads_its_rows_once(spark):
    rows = four_classes(spark, SF).withColumn("scenario", F.lit(0))
    few = rows.filter("vec_id < 200")
    fitted = {k: models.fit("logistic_regression", few.filter(f"vec_id % 3 <> {k}")) for k in range(3)}
    preds = models.predict_all(fitted, rows)
    plan = preds._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    for k, model in fitted.items():
        alone = models.predict(model, rows).select("vec_id", "label", "scenario", "prediction")
        assert preds.filter(F.col("model") == k).select(*alone.columns).exceptAll(alone).isEmpty()
    assert preds.count() == 3 * rows.count()
    assert grids.cross_evaluate(fitted, rows).count() == 3


def test_rows_without_a_teacher_are_an_error(spark):
    rows = four_classes(spark, SF).withColumn("scenario", F.lit(0))
    teacher = models.fit("logistic_regression", rows)
    with pytest.raises(Exception, match="no teacher scores"):
        grids.train_distilled({0: teacher}, rows.filter("vec_id > 3").select("vec_id", "scenario", "features"), rows, rows, ["vec_id"], [0])
