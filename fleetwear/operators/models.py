"""Classifiers: a registry of Spark ML estimators and our own boosted trees, early stopping, ensembles, distillation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.functions.columns import clip_normalise, softmax
from fleetwear.operators.boosting import LIGHTGBM, XGBOOST, Booster, fit_boosters
from fleetwear.operators.distillation import fit_softmax_student

CLASSES = 4
# 256 bins, about what native boosting libraries use; Spark's own default of 32 puts borders between classes inside a bin
BINS = 256
BOOSTED = {"maxDepth": 6, "subsamplingRate": 0.9, "maxIter": 20, "stepSize": 0.1, "maxBins": BINS}
#: The boosters that grow one tree a class and round, level-wise and leaf-wise.
BOOSTERS = {"xgboost": XGBOOST, "lightgbm": LIGHTGBM}


def as_ml(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Array features as an ML vector, label as a double."""
    out = df
    if df.schema[features].dataType.typeName() == "array":
        out = out.withColumn(features, array_to_vector(F.col(features).cast("array<double>")))
    return out.withColumn(label, F.col(label).cast("double")) if label in df.columns else out


def _boosted(params: dict, seed: int) -> GBTClassifier:
    return GBTClassifier(seed=seed, **{**BOOSTED, **params})


class BoostedTrees:
    """A booster as an estimator: ``fit`` takes ``label, features`` and, for early stopping, ``is_valid``."""

    def __init__(self, booster: Booster, width: int):
        self.booster, self.width = booster, width

    def fit(self, rows: DataFrame):
        return fit_boosters(rows.withColumn("model", F.lit(0)), {0: self.booster}, self.width)[0]


def booster(name: str, params: dict | None = None, classes: int = CLASSES, seed: int = 42) -> Booster:
    return replace(BOOSTERS[name], classes=classes, seed=seed, **(params or {}))


# name -> builder(params, width, classes, seed); user models are added here
ESTIMATORS: dict[str, Callable] = {
    "xgboost": lambda p, width, classes, seed: BoostedTrees(booster("xgboost", p, classes, seed), width),
    "lightgbm": lambda p, width, classes, seed: BoostedTrees(booster("lightgbm", p, classes, seed), width),
    "gbt": lambda p, width, classes, seed: OneVsRest(classifier=_boosted(p, seed)),
    "mlp": lambda p, width, classes, seed: MultilayerPerceptronClassifier(
        seed=seed, **{"layers": [width, 256, 256, classes], "maxIter": 100, **p}
    ),
    "random_forest": lambda p, width, classes, seed: RandomForestClassifier(seed=seed, **{"maxBins": BINS, **p}),
    "logistic_regression": lambda p, width, classes, seed: LogisticRegression(**p),
    "svm": lambda p, width, classes, seed: OneVsRest(classifier=LinearSVC(**p)),
}


def build_estimator(name: str, params: dict | None = None, width: int = 14, classes: int = CLASSES, seed: int = 42):
    if name not in ESTIMATORS:
        raise KeyError(f"unknown model {name}; known: {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[name](params or {}, width, classes, seed)


def fit_boosted(train: DataFrame, valid: DataFrame, params: dict | None = None, classes: int = CLASSES, seed: int = 42):
    """One boosted binary model per class, each stopped when its loss on ``valid`` no longer falls.

    ``OneVsRest`` does not pass a validation column on, so the class models are fitted here and wrapped again.
    """
    both = as_ml(train).select("label", "features", F.lit(False).alias("is_valid")).unionByName(
        as_ml(valid).select("label", "features", F.lit(True).alias("is_valid"))
    )
    models = []
    for c in range(classes):
        one = _boosted({"validationIndicatorCol": "is_valid", **(params or {})}, seed)
        binary = both.withColumn("label", (F.col("label") == c).cast("double"))
        models.append(one.fit(binary))
    return OneVsRestModel(models=models)


def fit(
    name: str,
    train: DataFrame,
    valid: DataFrame | None = None,
    params: dict | None = None,
    width: int = 14,
    classes: int = CLASSES,
    seed: int = 42,
) -> PipelineModel:
    """Fit a registered model on ``label, features``; boosted models stop early when ``valid`` is given."""
    if valid is not None and name == "gbt":
        return PipelineModel(stages=[fit_boosted(train, valid, params, classes, seed)])
    rows = as_ml(train)
    if valid is not None and name in BOOSTERS:
        held = as_ml(valid).select("label", "features", F.lit(True).alias("is_valid"))
        rows = rows.select("label", "features", F.lit(False).alias("is_valid")).unionByName(held)
    return PipelineModel(stages=[build_estimator(name, params, width, classes, seed).fit(rows)])


def fit_together(sets: Mapping[int, DataFrame], boosters: Mapping[int, Booster], width: int) -> dict[int, PipelineModel]:
    """One booster for each training set of ``label, features``, all grown by the same jobs."""
    rows = None
    for m, one in sets.items():
        one = one.select(F.lit(m).alias("model"), "label", "features")
        rows = one if rows is None else rows.unionByName(one)
    return {m: PipelineModel(stages=[model]) for m, model in fit_boosters(rows, boosters, width).items()}


def predict(model, df: DataFrame) -> DataFrame:
    """Input columns and ``prediction INT``, with ``probability`` as an array where the model has one."""
    scored = model.transform(as_ml(df))
    keep = [F.col(c).cast("int").alias(c) if c == "label" else F.col(c) for c in df.columns if c != "features"]
    if "probability" in scored.columns:
        keep.append(vector_to_array("probability").alias("probability"))
    return scored.select(*keep, F.col("prediction").cast("int").alias("prediction"))


def predict_all(models: Mapping[int, PipelineModel], df: DataFrame) -> DataFrame:
    """``model INT``, the input columns without features, and ``prediction INT``: every model on every row.

    The rows are read once; each model adds its prediction to them, and they become one row a model at the end.
    """
    rows = as_ml(df)
    columns, found = rows.columns, []
    for k, model in models.items():
        found.append(F.struct(F.lit(k).alias("model"), F.col(f"_p{len(found)}").alias("prediction")))
        scored = model.transform(rows)
        rows = scored.select(*rows.columns, F.col("prediction").cast("int").alias(f"_p{len(found) - 1}"))
    keep = [F.col(c).cast("int").alias(c) if c == "label" else F.col(c) for c in columns if c != "features"]
    return rows.select(*keep, F.inline(F.array(*found))).select("model", *[c for c in columns if c != "features"], "prediction")


def feature_importance(model, columns: Sequence[str]) -> DataFrame:
    """``feature, importance`` of a tree model; one-versus-rest models average their class models."""
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    parts = stage.models if isinstance(stage, OneVsRestModel) else [stage]
    weights = [sum(float(part.featureImportances[i]) for part in parts) / len(parts) for i in range(len(columns))]
    from pyspark.sql import SparkSession

    rows = list(zip(columns, weights))
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def fit_prob_ensemble(train: DataFrame, classes: int = CLASSES, params: dict | None = None, seed: int = 42) -> PipelineModel:
    """One boosted regressor per class on the one-hot label; see ``ensemble_scores``."""
    rows, models = as_ml(train), []
    for c in range(classes):
        reg = GBTRegressor(
            seed=seed, labelCol="target", predictionCol=f"score_{c}", **{**BOOSTED, **(params or {})}
        )
        models.append(reg.fit(rows.withColumn("target", (F.col("label") == c).cast("double"))))
    return PipelineModel(stages=models)


def ensemble_scores(model: PipelineModel, df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, scores``: the class regressors clipped from below and normalised to sum 1."""
    scored = model.transform(as_ml(df))
    columns = [F.col(f"score_{c}") for c in range(len(model.stages))]
    return scored.select(*key, clip_normalise(F.array(*columns)).alias("scores"))


def teacher_scores(model: PipelineModel, df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, bool]:
    """``key, scores`` and whether they are probabilities: logits for networks, probabilities otherwise."""
    if isinstance(model.stages[-1], OneVsRestModel):
        raise ValueError("one-versus-rest models have no class scores; use fit_prob_ensemble as the teacher")
    if model.stages[-1].hasParam("predictionCol") and model.stages[-1].getPredictionCol().startswith("score_"):
        return ensemble_scores(model, df, key), True
    network = type(model.stages[-1]).__name__.startswith("MultilayerPerceptron")
    scored = model.transform(as_ml(df))
    column = "rawPrediction" if network else "probability"
    return scored.select(*key, vector_to_array(column).alias("scores")), not network


def fit_student(
    df: DataFrame,
    alpha: float = 0.5,
    params: dict | None = None,
    is_prob: bool = True,
    temperature: float = 1.0,
    student_temperature: float = 1.0,
) -> PipelineModel:
    """Multinomial logistic student of hard and soft labels; ``df`` has ``label, scores, features``.

    Scores of a teacher that gives logits (``is_prob`` false) go through a softmax at ``temperature`` first.
    At student temperature 1 each row becomes one row per class with weight ``(1 - alpha) [label] + alpha * scores``, which is the
    distillation objective there; at any other its gradient is summed over the rows (``distillation``). ``metrics.distill_loss``
    reports the objective.
    """
    weight = F.when(F.col("label") == F.col("_c"), 1 - alpha).otherwise(0.0) + alpha * F.col("_p")
    scores = F.col("scores") if is_prob else softmax(F.col("scores"), temperature)
    if df.select(F.exists(scores, lambda s: (s < 0) | s.isNull()).alias("bad")).filter("bad").take(1):
        raise ValueError("scores are not probabilities; pass is_prob=False for logits")
    if student_temperature != 1.0:
        features = F.col("features") if df.schema["features"].dataType.typeName() == "array" else vector_to_array("features")
        rows = df.select(features.alias("features"), "label", scores.alias("scores"))
        return PipelineModel(stages=[fit_softmax_student(rows, alpha, student_temperature, **(params or {}))])
    rows = df.select("features", "label", F.posexplode(scores).alias("_c", "_p"))
    rows = rows.select("features", F.col("_c").alias("label"), weight.alias("weight")).filter("weight > 0")
    student = LogisticRegression(family="multinomial", weightCol="weight", **(params or {}))
    return PipelineModel(stages=[student.fit(as_ml(rows))])
