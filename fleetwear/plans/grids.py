"""Whole studies: training per scenario, cross-evaluation, augmentation and with/without-SMOTE grids.

The driver loops over a grid of a few dozen models; every fit and every scoring pass is a distributed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.operators.forests import BINS, Forest, fit_forests
from fleetwear.operators.masking import stack
from fleetwear.operators.metrics import class_report, confusion, flat_report
from fleetwear.operators.models import BOOSTERS, booster, build_estimator, fit, fit_student, fit_together, predict, predict_all, teacher_scores
from fleetwear.operators.oversample import Searches, oversample
from fleetwear.operators.scaling import minmax_apply, minmax_fit
from fleetwear.operators.splits import stratified_split, test_rows, train_rows
from fleetwear.runtime import settle
from fleetwear.sources.writers import save_model

FITS_AT_ONCE = 4
FOLD_ABOVE = 1_000_000  # training rows above which forests are grown on folded rows


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _folded_forests(train: DataFrame, sets: Mapping[int, Sequence[int]], params: dict | None = None, seed: int = 42, **_) -> dict[int, PipelineModel] | None:
    """The forests of ``sets`` grown together on folded rows, or none where rows are few or ``params`` asks for what only Spark's forests have."""
    forest = build_estimator("random_forest", params, seed=seed)
    if set(params or {}) - {"numTrees", "maxDepth", "maxBins"} or forest.getMaxBins() > BINS or train.count() <= FOLD_ABOVE:
        return None
    cfg = Forest(forest.getNumTrees(), forest.getMaxDepth(), forest.getMaxBins(), seed)
    return {k: PipelineModel(stages=[model]) for k, model in fit_forests(train, sets, cfg).items()}


def train_scenarios(
    name: str,
    train: DataFrame,
    valid: DataFrame,
    ks: Sequence[int],
    stacked: bool = True,
    save_to: str | None = None,
    **fit_options,
):
    """Fit one model per scenario; returns ``{k: model}`` and the class report of each on its validation rows.

    ``train`` and ``valid`` hold every scenario (``scenario, label, features``) and are stored once. Forests of many rows are grown
    together on folded rows (``operators.forests``); other models are fitted one after another.
    """
    used = ["scenario", "label", "features"]
    train, valid = settle(train.select(*used), "train"), settle(valid.select(*used), "valid")
    pick = stack if stacked else lambda rows, k: rows.filter(F.col("scenario") == k)
    sets = {k: range(k + 1) if stacked else [k] for k in ks}
    together = _folded_forests(train, sets, **fit_options) if name == "random_forest" else None
    models, scored = {}, []
    for k in ks:
        model = together[k] if together else fit(name, pick(train, k), pick(valid, k), **fit_options)
        models[k] = model
        if save_to:
            save_model(model, f"{save_to}/scen_{k}")
        preds = predict(model, pick(valid, k).select("label", "features"))
        scored.append(preds.select("label", "prediction", F.lit(k).alias("scenario")))
    return models, class_report(confusion(_union(scored), ["scenario"]), ["scenario"])


def train_distilled(
    teachers: Mapping[int, object],
    teacher_rows: DataFrame,
    train: DataFrame,
    valid: DataFrame,
    key: Sequence[str],
    ks: Sequence[int],
    stacked: bool = True,
    save_to: str | None = None,
    teacher_temperature: float = 4.0,
    student_temperature: float = 4.0,
    **fit_options,
):
    """The scenario loop with a teacher: a student per scenario, ``{k: model}``, and the class report of each.

    ``teachers[k]`` is the fitted teacher of scenario ``k``. It scores the training rows of its own frame (``teacher_rows``: ``key, scenario,
    features``); its scores are stored by key and scenario and joined to the masked rows that the student sees (``train``: ``key,
    scenario, label, features``). Students are judged on ``valid`` without their teacher. A row that the teacher does not have is an error.
    """
    by = [*key, "scenario"]
    taught, train, valid = settle(teacher_rows, "teacher-rows"), settle(train, "train"), settle(valid, "valid")
    pick = stack if stacked else lambda rows, k: rows.filter(F.col("scenario") == k)
    models, scored = {}, []
    for k in ks:
        scores, is_prob = teacher_scores(teachers[k], pick(taught, k), by)
        known = pick(train, k).join(settle(scores, "teacher-scores"), by, "left")
        checked = F.when(F.col("scores").isNotNull(), F.col("scores")).otherwise(F.raise_error(F.lit("a training row has no teacher scores")))
        rows = settle(known.select("label", "features", checked.alias("scores")), "distilled")
        models[k] = fit_student(rows, is_prob=is_prob, temperature=teacher_temperature, student_temperature=student_temperature, **fit_options)
        if save_to:
            save_model(models[k], f"{save_to}/scen_{k}")
        preds = predict(models[k], pick(valid, k).select("label", "features"))
        scored.append(preds.select("label", "prediction", F.lit(k).alias("scenario")))
    return models, class_report(confusion(_union(scored), ["scenario"]), ["scenario"])


def cross_evaluate(models: dict, scenario_rows: DataFrame) -> DataFrame:
    """Every model on every scenario: ``model_scenario, scenario, accuracy, f1_score, precision, recall``.

    One scan scores all scenarios under all models; only confusion counts are shuffled, once.
    """
    found = predict_all(models, scenario_rows.select("scenario", "label", "features")).withColumnRenamed("model", "model_scenario")
    by = ["model_scenario", "scenario"]
    return flat_report(confusion(found, by), by)


def _together(run: Callable, cells: Sequence) -> list:
    """``run`` for every cell, a few at a time: small fits leave most of a cluster idle."""
    with ThreadPoolExecutor(max_workers=FITS_AT_ONCE) as pool:
        return list(pool.map(run, cells))


def _judged(sets: Mapping[tuple, DataFrame], names: Sequence[str], test: DataFrame, by: Sequence[str], seed: int, params: dict | None = None, width: int | None = None) -> DataFrame:
    """The flat report of every model on every training set; ``by`` names the parts of a set's key.

    The boosters of all sets are grown together, by the same jobs; other models are fitted one after another.
    """
    width = width or test.agg(F.max(F.size("features"))).first()[0] or 1
    cells = list(enumerate((key, name) for key in sets for name in names))
    together = {i: (key, name) for i, (key, name) in cells if name in BOOSTERS}
    fitted = fit_together({i: sets[key] for i, (key, _) in together.items()}, {i: booster(name, params, seed=seed) for i, (_, name) in together.items()}, width) if together else {}
    parts = []
    for i, (key, name) in cells:
        model = fitted[i] if i in fitted else fit(name, sets[key], params=params, width=width, seed=seed)
        marks = [F.lit(v).alias(c) for c, v in zip(by, key, strict=True)]
        preds = predict(model, test.select("label", "features")).select("label", "prediction", *marks, F.lit(name).alias("model"))
        parts.append(confusion(preds, [*by, "model"]))
    return flat_report(_union(parts), [*by, "model"])


def augmentation_study(
    train: DataFrame,
    test: DataFrame,
    key: str,
    models: Sequence[str] = ("lightgbm", "xgboost"),
    methods: Sequence[str] = ("smote", "adasyn", "borderline", "mix"),
    multipliers: Sequence[int] = (1, 3, 5, 10),
    seed: int = 42,
    params: dict | None = None,
) -> DataFrame:
    """``method, multiplier, model, accuracy, f1_macro`` for every cell of the grid."""

    searches = Searches()  # neighbours depend on neither the method nor the multiplier

    def rows(cell: tuple[str, int]) -> DataFrame:
        method, m = cell
        return settle(oversample(train, key, "label", method, "all", m, seed=seed, searches=searches).select("label", "features"), "augmented")

    cells = [(method, m) for method in methods for m in multipliers]
    sets = dict(zip(cells, _together(rows, cells), strict=True))
    found = _judged(sets, models, test, ["method", "multiplier"], seed, params)
    return found.select("method", "multiplier", "model", "accuracy", F.col("f1_score").alias("f1_macro"))


def smote_study(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str = "label",
    models: Sequence[str] = ("lightgbm", "xgboost"),
    test: float = 0.25,
    seed: int = 42,
    fit_scaling_on_train: bool = True,
    params: dict | None = None,
) -> DataFrame:
    """``setting, model, accuracy, macro_f1`` with and without SMOTE on a stratified split.

    Scaling is fitted on the training rows; ``fit_scaling_on_train=False`` fits it on all rows instead.
    """
    split = settle(stratified_split(df, [key], [label], test, seed), "split")
    fitted = train_rows(split) if fit_scaling_on_train else split
    scaled = minmax_apply(split, settle(minmax_fit(fitted, [], features), "minmax"), [], features)
    scaled = settle(scaled.select(key, F.col(label).alias("label"), F.array(*features).alias("features"), "is_test"), "scaled")
    train, held = train_rows(scaled), test_rows(scaled)
    settings = {
        "no_smote": train.select("label", "features"),
        "smote": oversample(train, key, "label", "smote", "not_majority", seed=seed).select("label", "features"),
    }
    sets = {(setting,): settle(rows, setting) for setting, rows in settings.items()}
    found = _judged(sets, models, held, ["setting"], seed, params, len(features))
    return found.select("setting", "model", "accuracy", F.col("f1_score").alias("macro_f1"))
