"""Missing-sensor scenarios: random and importance-ordered masks, all scenarios in one pass, stacking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.functions.columns import mask_ranked, permutation, ranks


def importance_order(importance: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``place, feature, position``: features by falling importance (ties by name) with their column position.

    Features that are not among ``columns`` are left out.
    """
    named = importance.sparkSession.createDataFrame(
        [(name, place) for place, name in enumerate(columns)], "feature string, position int"
    )
    kept = importance.join(F.broadcast(named), "feature")  # one row per model column
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")
    return kept.select((F.row_number().over(order) - 1).alias("place"), "feature", "position")


def order_ranks(order: DataFrame, width: int) -> list[int]:
    """When each position is masked; positions without an importance are never masked. One row per model column."""
    place = {r["position"]: r["place"] for r in order.select("position", "place").collect()}
    return [place.get(p, width) for p in range(width)]


def _with_random_ranks(df: DataFrame, key: Sequence[str], width: int, seed: int) -> DataFrame:
    drawn = df.withColumn("_p", permutation([F.col(k) for k in key], width, seed))
    return drawn.withColumn("_r", ranks(F.col("_p"), width)).drop("_p")


def mask_random(df: DataFrame, key: Sequence[str], k: int, width: int, seed: int = 42, features: str = "features") -> DataFrame:
    """Hide ``k`` random positions of each row; narrow."""
    ranked = _with_random_ranks(df, key, width, seed)
    return ranked.withColumn(features, mask_ranked(F.col(features), F.col("_r"), k, width)).drop("_r")


def mask_by_importance(df: DataFrame, order: DataFrame, k: int, width: int, features: str = "features") -> DataFrame:
    """Hide the ``k`` most important positions of every row."""
    rank = F.array(*[F.lit(r) for r in order_ranks(order, width)])
    return df.withColumn(features, mask_ranked(F.col(features), rank, k, width))


def scenarios(
    df: DataFrame,
    key: Sequence[str],
    width: int,
    how: str = "random",
    order: DataFrame | None = None,
    seed: int = 42,
    features: str = "features",
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Every scenario 0..width-1 of every row; scenario k hides k positions, and each hides those before it.

    One narrow pass: the order of a row is drawn once, then the row is repeated. With ``names`` the hidden
    sensors are also listed in ``masked_sensors``.
    """
    if how == "random":
        ranked = _with_random_ranks(df, key, width, seed)
    elif how == "importance":
        ranked = df.withColumn("_r", F.array(*[F.lit(r) for r in order_ranks(order, width)]))
    else:
        raise ValueError("how is 'random' or 'importance'")
    out = ranked.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    out = out.withColumn(features, mask_ranked(F.col(features), F.col("_r"), F.col("scenario"), width))
    if names:
        labels = F.array(*[F.lit(n) for n in names])
        hidden = F.zip_with(F.col("_r"), labels, lambda r, n: F.when(r < F.col("scenario"), n))
        out = out.withColumn("masked_sensors", F.array_compact(hidden))
    return out.drop("_r")


def stack(scenario_rows: DataFrame, k: int) -> DataFrame:
    """The cumulative training set of scenario ``k``: all rows of scenarios 0..k, each with its own label."""
    return scenario_rows.filter(F.col("scenario") <= k)
