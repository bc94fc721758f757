"""Min-max scaling, column statistics and sensor-group means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.runtime import settle


def minmax_fit(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per group with ``<col>_min`` and ``<col>_max``; a partial aggregate, then a tiny shuffle."""
    aggs = [agg(c).alias(f"{c}_{end}") for c in cols for end, agg in (("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def minmax_value(value: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1]; a constant column becomes 0, a missing value stays missing."""
    return F.when(value.isNotNull(), F.coalesce((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)))


def minmax_apply(df: DataFrame, stats: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Scale ``cols`` with fitted ``stats``; pass stats through ``settle`` so that their size decides the join."""
    joined = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # without groups stats is one row
    scaled = {c: minmax_value(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max")) for c in cols}
    return joined.withColumns(scaled).drop(*[f"{c}_{end}" for c in cols for end in ("min", "max")])


def mean_std(df: DataFrame, cols: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """Mean and population deviation (+ ``floor``) of each column, one row."""
    return df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        *[(F.stddev_pop(c) + floor).alias(f"{c}_std") for c in cols],
    )


def group_mean(long_df: DataFrame, key: Sequence[str], value: str = "value", name: str = "y") -> DataFrame:
    """Mean per key over long rows; missing values are skipped."""
    return long_df.groupBy(*key).agg(F.avg(value).alias(name))


def to_long(df: DataFrame, key: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    return df.unpivot(list(key), list(sensors), "sensor", "value")


def mean_curves(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Mean of every sensor per dataset and cycle: ``dataset, cycle, sensor, mean_value``."""
    means = df.groupBy("dataset", "cycle").agg(*[F.avg(s).alias(s) for s in sensors])
    return means.unpivot(["dataset", "cycle"], list(sensors), "sensor", "mean_value")


def auto_tag(curves: DataFrame, rising: float = 0.6, weak: float = 0.2) -> DataFrame:
    """Tag each mean curve by its correlation with the cycle: u rising, d falling, o flat, c anything between."""
    r = F.round(F.corr("cycle", "mean_value"), 6)
    tag = (
        F.when(F.col("r") >= rising, "u")
        .when(F.col("r") <= -rising, "d")
        .when(F.coalesce(F.abs("r"), F.lit(0.0)) < weak, "o")
        .otherwise("c")
    )
    scored = curves.groupBy("dataset", "sensor").agg(r.alias("r"))
    return scored.select("dataset", "sensor", F.when(F.isnan("r"), None).otherwise(F.col("r")).alias("r")).withColumn(
        "tag", tag
    )


def settled_stats(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return settle(minmax_fit(df, by, cols), "minmax")
