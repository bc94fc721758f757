"""Health-state labelling of engine cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.operators.scaling import minmax_apply, minmax_fit, settled_stats
from fleetwear.operators.series import by_length, knee_rows, nine_decimals, number_rows, phase_edges, phase_positions
from fleetwear.runtime import settle
from fleetwear.schema import TAGS

ENGINE = ["dataset", "unit"]


def group_profile(readings: DataFrame, tags: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """One row per dataset and tag: ``<s>_lo`` and ``<s>_span`` of the sensors with that tag, null for the others.

    A constant sensor gets an endless span, which scales it to 0. Stored, so that its true size decides the join.
    """
    stats = minmax_fit(readings, ["dataset"], sensors)
    span = lambda s: F.col(f"{s}_max") - F.col(f"{s}_min")
    ends = [
        F.struct(
            F.lit(s).alias("sensor"),
            F.col(f"{s}_min").alias("lo"),
            F.when(span(s) == 0, F.lit(float("inf"))).otherwise(span(s)).alias("span"),
        )
        for s in sensors
    ]
    limits = stats.select("dataset", F.inline(F.array(*ends)))
    tagged = limits.join(tags.filter(F.col("tag").isin(*TAGS)), ["dataset", "sensor"])
    own = [F.max(F.when(F.col("sensor") == s, F.col(c))).alias(f"{s}_{c}") for s in sensors for c in ("lo", "span")]
    return settle(tagged.groupBy("dataset", "tag").agg(*own), "profile")


def group_curves(rows: DataFrame, profile: DataFrame, key: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """``key, tag, y`` per row and tag group of its dataset: the mean of the group's scaled sensors, missing ones skipped.

    The join makes one row per tag, so the code walks the sensors once. The expressions are kept short on purpose: a
    generated method above 8,000 bytes is never compiled by the JVM and runs ten times slower. Rounding to 9
    decimals keeps later comparisons free of the order of summation.
    """
    joined = rows.join(profile, "dataset")
    joined = joined.withColumns({s: nine_decimals((F.col(s) - F.col(f"{s}_lo")) / F.col(f"{s}_span")) for s in sensors})
    total, count = F.lit(0.0), F.lit(0)
    for s in sensors:
        total = total + F.coalesce(F.col(s), F.lit(0.0))
        count = count + F.col(s).isNotNull().cast("int")
    sums = joined.select(*key, "tag", total.alias("_total"), count.alias("_count"))
    mean = F.when(F.col("_count") > 0, nine_decimals(F.col("_total") / F.col("_count")))
    return sums.select(*key, "tag", mean.alias("y"))


def label_states(
    readings: DataFrame,
    tags: DataFrame,
    sensors: Sequence[str],
    shift: int = 0,
    emit: str = "raw",
    sensitivity: float = 2.0,
    **limits,
) -> DataFrame:
    """Health state 0..3 of every cycle, once per tag group of its dataset (so rows repeat per tag).

    ``readings`` needs ``dataset, unit, cycle`` (unique) and the sensors; ``tags`` is ``dataset, sensor, tag``.
    Datasets without tags are skipped. ``emit`` chooses raw or min-max scaled sensors in the output.

    Rows are shuffled by engine and numbered once; curves, knees and labels follow on that partitioning. All tags
    of an engine share its shuffle.
    """
    if emit not in ("raw", "normalized"):
        raise ValueError("emit is 'raw' or 'normalized'")
    profile = group_profile(readings, tags, sensors)
    payload = [c for c in readings.columns if c not in ("i", "n")]
    series = [*ENGINE, "tag"]

    def build(part: DataFrame, chunk: int) -> DataFrame:
        rows = number_rows(part.select(*payload), ENGINE, ["cycle"], chunk)
        curves = group_curves(rows, profile, [*ENGINE, "i", "n"], sensors)
        edges = phase_edges(knee_rows(curves, series, F.col("tag"), sensitivity, chunk))
        one, two, three = phase_positions(F.col("edges"), shift)
        edges = edges.select(
            *ENGINE, F.struct("tag", F.col("n").alias("size"), one.alias("one"), two.alias("two"), three.alias("three")).alias("e")
        )
        edges = edges.groupBy(*ENGINE).agg(F.array_sort(F.collect_list("e")).alias("phases"))
        if chunk:  # few engines are long, so this table is small; stored, it is broadcast by its size
            edges = settle(edges, "edges")
        return rows.drop("n").join(edges, ENGINE).select(*payload, "i", F.inline("phases"))

    labelled = by_length(readings, ENGINE, build, **limits)
    state = (
        F.when((F.col("size") < 2) | (F.col("i") < F.col("one")), 0)
        .when(F.col("i") < F.col("two"), 1)
        .when(F.col("i") < F.col("three"), 2)
        .otherwise(3)
    )
    labelled = labelled.select(*payload, "tag", state.alias("state"))
    if emit == "normalized":
        stats = settled_stats(readings, ["dataset"], sensors)
        labelled = minmax_apply(labelled, stats, ["dataset"], sensors)
        labelled = labelled.withColumns({s: nine_decimals(F.col(s)) for s in sensors})
    return labelled
