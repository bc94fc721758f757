"""Report shapes: nested JSON, text tables, long metrics, run manifests and chart tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwear.functions.columns import run_stamp, state_colour
from fleetwear.operators.scaling import mean_curves
from fleetwear.operators.series import state_runs

REPORT_METRICS = ["accuracy", "f1_score", "precision", "recall"]


def nested_by_model(report: DataFrame) -> DataFrame:
    """``model_scenario, scenarios MAP<scenario, metrics>`` of a flat report (one row per model and scenario)."""
    entry = F.struct(F.col("scenario").cast("string").alias("k"), F.struct(*REPORT_METRICS).alias("v"))
    return report.groupBy("model_scenario").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("scenarios"))


def nested_report(report: DataFrame) -> DataFrame:
    """The whole report as one JSON document ``{model: {scenario: metrics}}`` (models x scenarios entries)."""
    entry = F.struct(F.col("model_scenario").cast("string").alias("k"), F.col("scenarios").alias("v"))
    return nested_by_model(report).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))


def text_report(report: DataFrame, by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """``by..., place, line``: the class report as aligned text, classes first, then the averages."""
    place = (
        F.when(F.col("class") == "accuracy", 1_000_000)
        .when(F.col("class") == "macro avg", 1_000_001)
        .when(F.col("class") == "weighted avg", 1_000_002)
        .otherwise(F.col("class").try_cast("int"))
    )
    number = f"%9.{digits}f"
    even = lambda m: F.bround(m, digits)  # ties to even, as C and Python print them
    full = F.format_string(f"%12s  {number} {number} {number} %9d", "class", even("precision"), even("recall"), even("f1"), "support")
    short = F.format_string(f"%12s  %9s %9s {number} %9d", "class", F.lit(""), F.lit(""), even("f1"), "support")
    lines = report.select(*by, place.alias("place"), F.when(F.col("class") == "accuracy", short).otherwise(full).alias("line"))
    head = F.format_string("%12s  %9s %9s %9s %9s", F.lit(""), F.lit("precision"), F.lit("recall"), F.lit("f1-score"), F.lit("support"))
    heads = report.select(*by).distinct() if by else report.limit(1).select()
    return lines.unionByName(heads.select(*by, F.lit(-1).alias("place"), head.alias("line")))


def long_metrics(report: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return report.unpivot(list(ids), list(metrics), "metric", "score")


def run_name(student: Sequence[str], teacher: Sequence[str] | None = None, moment: Column | None = None) -> Column:
    """Column ``frame_model_data[_teacher_frame_model_data]_timestamp``."""
    parts = [F.lit(p) for p in student] + ([F.lit("teacher"), *[F.lit(p) for p in teacher]] if teacher else [])
    return F.concat_ws("_", *parts, run_stamp(F.current_timestamp() if moment is None else moment))


def run_manifest(spark: SparkSession, params: dict, student: Sequence[str], teacher: Sequence[str] | None = None) -> DataFrame:
    """One row ``run, started, params`` to append to a table of runs."""
    return spark.range(1).select(
        run_name(student, teacher).alias("run"),
        F.current_timestamp().alias("started"),
        F.lit(json.dumps(params, sort_keys=True, default=str)).alias("params"),
    )


# chart tables -------------------------------------------------------------------------------------------------------


def metric_table(report: DataFrame, metrics: Sequence[str] = ("accuracy", "f1_score")) -> DataFrame:
    return long_metrics(report, ["model_scenario", "scenario"], metrics)


def run_table(labelled: DataFrame, key: Sequence[str], state: str = "state", **limits) -> DataFrame:
    """Runs of one state per engine with the colour to draw them in; needs ``i``."""
    return state_runs(labelled, key, state, **limits).withColumn("colour", state_colour(F.col(state)))


def curve_table(readings: DataFrame, sensors: Sequence[str]) -> DataFrame:
    return mean_curves(readings, sensors)


def importance_table(importance: DataFrame) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature")


def setting_table(results: DataFrame, setting: str) -> DataFrame:
    return results.filter(F.col("setting") == setting).select("model", "accuracy", "macro_f1")
