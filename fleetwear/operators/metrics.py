"""Classification metrics. One pass over the rows makes the confusion counts; the rest works on those few rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.functions.columns import log_softmax, soft_divergence, softmax

METRICS = ["precision", "recall", "f1"]


def confusion(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("rows"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def class_scores(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class that is true or predicted; 0 where undefined."""
    right = F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0)
    roles = F.array(
        F.struct(F.col("label").alias("class"), F.col("rows").alias("t"), F.lit(0).cast("bigint").alias("p"), right.alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("t"), F.col("rows").alias("p"), F.lit(0).cast("bigint").alias("tp")),
    )
    sums = conf.select(*by, F.inline(roles)).groupBy(*by, "class").agg(
        F.sum("t").alias("support"), F.sum("p").alias("_p"), F.sum("tp").alias("_tp")
    )
    precision, recall = _ratio(F.col("_tp"), F.col("_p")), _ratio(F.col("_tp"), F.col("support"))
    f1 = _ratio(2 * F.col("_tp"), F.col("_p") + F.col("support"))
    return sums.select(*by, "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def class_report(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class scores, then ``accuracy``, ``macro avg`` and ``weighted avg`` rows; ``class`` is text.

    The accuracy row carries the accuracy in ``precision``, ``recall`` and ``f1``.
    """
    scores = class_scores(conf, by)
    weight = lambda m: _ratio(F.sum(F.col(m) * F.col("support")), F.sum("support"))
    averages = scores.groupBy(*by).agg(
        F.struct(
            F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in METRICS], F.sum("support").alias("support")
        ).alias("macro"),
        F.struct(
            F.lit("weighted avg").alias("class"), *[weight(m).alias(m) for m in METRICS], F.sum("support").alias("support")
        ).alias("weighted"),
        F.struct(
            F.lit("accuracy").alias("class"), *[weight("recall").alias(m) for m in METRICS], F.sum("support").alias("support")
        ).alias("accuracy"),
    )
    averages = averages.select(*by, F.inline(F.array("accuracy", "macro", "weighted")))
    return scores.withColumn("class", F.col("class").cast("string")).unionByName(averages)


def accuracy(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*by).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def macro_f1(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return report.filter(F.col("class") == "macro avg").select(*by, F.col("f1").alias("macro_f1"))


def flat_report(conf: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by..., accuracy, f1_score, precision, recall`` (macro averages)."""
    scores = class_scores(conf, by)
    overall = _ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support"))
    return scores.groupBy(*by).agg(
        overall.alias("accuracy"),
        F.avg("f1").alias("f1_score"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
    )


def weighted_loss(batches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Size-weighted mean of batch losses (columns ``loss``, ``n``)."""
    return batches.groupBy(*by).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def cross_entropy(preds: DataFrame, probability: str = "probability", label: str = "label") -> DataFrame:
    p = F.element_at(probability, F.col(label) + 1)
    return preds.agg(F.avg(-F.ln(F.greatest(p, F.lit(1e-12)))).alias("cross_entropy"))


def distill_terms(
    df: DataFrame, teacher: str, student: str, label: str, is_prob: bool, t_t: float = 4.0, t_s: float = 4.0
) -> DataFrame:
    """Per row: ``ce``, cross-entropy of the student's logits, and ``kd``, the divergence from the teacher.

    A teacher that gives probabilities is taken as it is; logits are softened by ``t_t``.
    """
    target = F.col(teacher) if is_prob else softmax(F.col(teacher), t_t)
    ce = -F.element_at(log_softmax(F.col(student)), F.col(label) + 1)
    return df.withColumns({"ce": ce, "kd": soft_divergence(target, log_softmax(F.col(student), t_s))})


def distill_loss(
    df: DataFrame, teacher: str, student: str, label: str, is_prob: bool, alpha: float = 0.5, t_t: float = 4.0, t_s: float = 4.0
) -> DataFrame:
    """``(1 - alpha) * ce + alpha * t_s^2 * kd``, averaged over the rows: ``ce, kd, loss``."""
    terms = distill_terms(df, teacher, student, label, is_prob, t_t, t_s).agg(F.avg("ce").alias("ce"), F.avg("kd").alias("kd"))
    return terms.withColumn("loss", (1 - alpha) * F.col("ce") + alpha * F.col("kd") * (t_s**2))


def f1_series(results: DataFrame, model: str) -> DataFrame:
    """Per method, one model's macro F1 by multiplier (a row per run of the study goes in)."""
    points = F.array_sort(F.collect_list(F.struct("multiplier", "f1_macro")))
    return results.filter(F.col("model") == model).groupBy("method").agg(points.alias("series"))
