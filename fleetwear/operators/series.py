"""Ordered-series operators that hold when one series has a third of all rows.

A series is the rows of one key in an order. Series up to ``MAX_ROWS`` rows take ordinary windows by key:
one shuffle. Longer ones (at most total / MAX_ROWS of them) are cut into chunks of ``CHUNK`` positions; windows run
inside a chunk and a small per-chunk table carries what the next chunk needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.runtime import settle

MAX_ROWS = 1 << 20
CHUNK = 1 << 16


def by_length(
    df: DataFrame,
    key: Sequence[str],
    build: Callable[[DataFrame, int], DataFrame],
    max_rows: int | None = None,
    chunk: int | None = None,
) -> DataFrame:
    """``build(rows, 0)`` for series within ``max_rows``, ``build(rows, chunk)`` for longer ones, united.

    Runs one map-side-combined count; only the keys of long series are stored.
    """
    max_rows = MAX_ROWS if max_rows is None else max_rows
    chunk = CHUNK if chunk is None else chunk
    long_keys = settle(df.groupBy(*key).count().filter(F.col("count") > max_rows).select(*key), "long-series")
    if long_keys.isEmpty():
        return build(df, 0)
    short = build(df.join(long_keys, list(key), "left_anti"), 0)
    return short.unionByName(build(df.join(long_keys, list(key), "left_semi"), chunk))


def nine_decimals(value: Column) -> Column:
    """Rounded to 9 decimals on doubles (``round`` would go through decimals)."""
    return F.rint(value * 1e9) / 1e9


def _whole(key: Sequence[str]):
    return Window.partitionBy(*key)


def _chunked(df: DataFrame, chunk: int, order: str = "i") -> DataFrame:
    return df.withColumn("_c", F.floor(F.col(order) / chunk))


def number_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], chunk: int) -> DataFrame:
    """Add the 0-based position ``i`` and series length ``n``."""
    if not chunk:
        w = _whole(key).orderBy(*order)
        return df.withColumn("i", F.row_number().over(w) - 1).withColumn(
            "n", F.count(F.lit(1)).over(_whole(key)).cast("int")
        )
    # A range shuffle on key and order splits a long series over many tasks. Row ids rise by one inside a task, so
    # the offset of each task's piece turns them into positions in the series.
    ranged = (
        df.repartitionByRange(*key, *order)
        .sortWithinPartitions(*key, *order)
        .withColumns({"_pos": F.monotonically_increasing_id(), "_task": F.spark_partition_id()})
    )
    ranged = settle(ranged, "ranged")
    pieces = ranged.groupBy(*key, "_task").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = _whole(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = settle(
        pieces.withColumn("_offset", F.sum("_rows").over(before) - F.col("_rows")).withColumn(
            "n", F.sum("_rows").over(_whole(key)).cast("int")
        ),
        "pieces",
    )
    return (
        ranged.join(pieces, [*key, "_task"])
        .withColumn("i", (F.col("_offset") + F.col("_pos") - F.col("_first")).cast("int"))
        .drop("_pos", "_task", "_first", "_rows", "_offset")
    )


def with_totals(df: DataFrame, key: Sequence[str], aggs: dict[str, Column], chunk: int) -> DataFrame:
    """Add whole-series aggregates to every row.

    The window is ordered by ``i`` although the frame is the whole series: the later windows then find the rows sorted.
    """
    if not chunk:
        w = _whole(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})
    totals = settle(df.groupBy(*key).agg(*[agg.alias(name) for name, agg in aggs.items()]), "totals")
    return df.join(totals, list(key))


def with_neighbours(df: DataFrame, key: Sequence[str], col: str, prev: str, nxt: str, chunk: int) -> DataFrame:
    """Add the previous and next value of ``col`` in the series (null at its ends)."""
    if not chunk:
        w = _whole(key).orderBy("i")
        return df.withColumns({prev: F.lag(col).over(w), nxt: F.lead(col).over(w)})
    df = _chunked(settle(df, "neighbours"), chunk)
    ends = df.groupBy(*key, "_c").agg(F.min_by(col, "i").alias("_lo"), F.max_by(col, "i").alias("_hi"))
    over = _whole(key).orderBy("_c")
    ends = settle(
        ends.select(*key, "_c", F.lag("_hi").over(over).alias("_before"), F.lead("_lo").over(over).alias("_after")),
        "ends",
    )
    w = _whole([*key, "_c"]).orderBy("i")
    last_of_chunk = F.lead("i").over(w).isNull()
    first_of_chunk = F.lag("i").over(w).isNull()
    return (
        df.join(ends, [*key, "_c"])
        .withColumns(
            {
                prev: F.when(first_of_chunk, F.col("_before")).otherwise(F.lag(col).over(w)),
                nxt: F.when(last_of_chunk, F.col("_after")).otherwise(F.lead(col).over(w)),
            }
        )
        .drop("_c", "_before", "_after")
    )


def with_last(df: DataFrame, key: Sequence[str], cols: dict[str, str], chunk: int) -> DataFrame:
    """Add the latest non-null value up to each row, ``{new name: column}``."""
    to_here = lambda w: w.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not chunk:
        w = to_here(_whole(key))
        return df.withColumns({new: F.last(old, True).over(w) for new, old in cols.items()})
    df = _chunked(settle(df, "last"), chunk)
    tails = df.groupBy(*key, "_c").agg(
        *[F.max_by(old, F.when(F.col(old).isNotNull(), F.col("i"))).alias(f"_t_{new}") for new, old in cols.items()]
    )
    earlier = _whole(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    tails = settle(
        tails.select(*key, "_c", *[F.last(f"_t_{new}", True).over(earlier).alias(f"_t_{new}") for new in cols]),
        "tails",
    )
    w = to_here(_whole([*key, "_c"]))
    return (
        df.join(tails, [*key, "_c"])
        .withColumns({new: F.coalesce(F.last(old, True).over(w), F.col(f"_t_{new}")) for new, old in cols.items()})
        .drop("_c", *[f"_t_{new}" for new in cols])
    )


def with_running_sum(df: DataFrame, key: Sequence[str], col: str, name: str, chunk: int) -> DataFrame:
    to_here = lambda w: w.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not chunk:
        return df.withColumn(name, F.sum(col).over(to_here(_whole(key))))
    df = _chunked(settle(df, "running"), chunk)
    sums = df.groupBy(*key, "_c").agg(F.sum(col).alias("_s"))
    earlier = _whole(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = settle(sums.select(*key, "_c", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s")), "sums")
    return (
        df.join(sums, [*key, "_c"])
        .withColumn(name, F.sum(col).over(to_here(_whole([*key, "_c"]))) + F.col("_s"))
        .drop("_c", "_s")
    )


def index_series(df: DataFrame, key: Sequence[str], order: Sequence[str], **limits) -> DataFrame:
    """Position ``i`` (from 0) and length ``n`` of every row in its series; ``order`` must be unique in a series."""
    return by_length(df, key, lambda part, chunk: number_rows(part, key, order, chunk), **limits)


def ewm(series: DataFrame, key: Sequence[str], alpha: float = 0.05, value: str = "y", name: str = "smooth", **limits) -> DataFrame:
    """Exponential smoothing over ``i``: ``e0 = x0; e = (1 - alpha) e + alpha x``, for any length, gap and ``alpha``.

    A missing value keeps the smoothed one, and what was smoothed before weighs less for every row passed: after a gap
    of ``g`` rows ``e = (w e + alpha x) / (w + alpha)`` with ``w = (1 - alpha) ** g``. Before the first known value it is null.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    known = series.withColumn("_x", F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")))
    if alpha == 1:
        return by_length(known, key, lambda part, chunk: with_last(part, key, {name: "_x"}, chunk).drop("_x"), **limits)
    scan = lambda rows: by_length(rows, key, lambda part, chunk: _smoothed(part, key, alpha, name, chunk), **limits)
    if alpha * CHUNK < SPAN:  # a block would have to be carried into very many others
        return scan(known)
    gaps = settle(known.filter("_x IS NULL").select(*key).distinct(), "series-with-gaps")
    whole = lambda rows: _smoothed_whole(rows.drop("_x"), key, alpha, value, name)
    if gaps.isEmpty():
        return whole(known)
    return whole(known.join(gaps, list(key), "left_anti")).unionByName(scan(known.join(gaps, list(key), "left_semi")))


def _smoothed_whole(series: DataFrame, key: Sequence[str], alpha: float, value: str, name: str) -> DataFrame:
    """Smoothing of series without gaps, where a weight depends on the distance alone.

    The series is cut into blocks short enough that ``(1 - alpha) ** -j`` stays below 1e12. Inside a block the
    smoothing is a weighted running sum; the part of earlier blocks is a per-block sum that decays by 1e-12 per block,
    so 26 blocks back it is below the smallest double.
    """
    keep = 1.0 - alpha
    block = min(CHUNK, max(1, int(math.log(1e12) / -math.log(keep))))
    reach = math.ceil(math.log(1e308) / (-math.log(keep) * block))
    place = (F.col("i") % block).cast("double")
    weighted = F.when(F.col("i") == 0, F.col(value)).otherwise(F.col(value) * alpha)
    rows = series.withColumn("_b", F.floor(F.col("i") / block))
    ends = rows.groupBy(*key, "_b").agg(F.sum(weighted * F.pow(F.lit(keep), block - 1 - place)).alias("_end"))
    carried = (
        ends.select(*key, "_b", "_end", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_d"))
        .groupBy(*key, (F.col("_b") + F.col("_d")).alias("_b"))
        .agg(F.sum(F.col("_end") * F.pow(F.lit(keep**block), F.col("_d") - 1)).alias("_carry"))
    )
    w = _whole([*key, "_b"]).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.pow(F.lit(keep), place) * F.sum(weighted * F.pow(F.lit(keep), -place)).over(w)
    return (
        rows.withColumn("_local", local)
        .join(carried, [*key, "_b"], "left")
        .withColumn(name, F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0.0)) * F.pow(F.lit(keep), place + 1))
        .drop("_b", "_local", "_carry")
    )


SPAN = 400.0  # decay, as a logarithm, that a segment covers: its weights stay within the range of a double
RESET = 800.0  # decay of a row that forgets all before it


def _smoothed(part: DataFrame, key: Sequence[str], alpha: float, name: str, chunk: int) -> DataFrame:
    """Smoothing as the recurrence ``e = a e + b``, whose steps can be joined in any grouping.

    ``d`` is the sum of ``-ln a`` up to a row. Inside a segment (a span of ``d``, and a chunk of a long series) the smoothed value is
    a running sum of ``b exp(d)``; the ends of the segments are joined over distances 1, 2, 4, ...
    """
    part = with_last(part.withColumn("_p", F.when(F.col("_x").isNotNull(), F.col("i"))), key, {"_at": "_p"}, chunk)
    part = with_neighbours(part, key, "_at", "_was", "_then", chunk)
    is_known = F.col("_x").isNotNull()
    fade = -math.log1p(-alpha)
    gap = F.col("i") - F.col("_was")
    weight = F.exp(-fade * gap)
    after_gap = F.when(gap == 1, F.lit(fade)).otherwise(F.least(F.ln(weight + alpha) + fade * gap, F.lit(RESET)))
    cost = F.when(is_known & F.col("_was").isNull(), RESET).when(is_known, after_gap).otherwise(0.0)
    gain = F.when(is_known, F.col("_x") * F.when(F.col("_was").isNull(), 1.0).otherwise(alpha / (weight + alpha))).otherwise(0.0)
    part = part.withColumns({"_cost": cost, "_gain": gain}).drop("_p", "_was", "_then", "_x")
    part = with_running_sum(part, key, "_cost", "_d", chunk).withColumn("_s", F.floor(F.col("_d") / SPAN))
    part = part.withColumn("_piece", F.floor(F.col("i") / chunk) if chunk else F.lit(0).cast("bigint"))
    segment = [*key, "_s", "_piece"]
    inside = F.col("_d") - F.col("_s") * SPAN
    part = part.withColumns({"_up": F.col("_gain") * F.exp(inside), "_down": F.exp(-inside)})
    ends = part.groupBy(*segment).agg(F.max("_d").alias("_last"), (F.sum("_up") * F.min("_down")).alias("_end"))
    ends = settle(ends, "segment-ends")
    most = ends.groupBy(*key).count().agg(F.max("count")).first()[0] or 1
    over, reach = _whole(key).orderBy("_s", "_piece"), 1
    while reach < most:
        far = F.lag("_end", reach).over(over) * F.exp(F.lag("_last", reach).over(over) - F.col("_last"))
        ends = ends.withColumn("_end", F.col("_end") + F.coalesce(far, F.lit(0.0)))
        reach *= 2
    ends = settle(ends.select(*segment, F.lag("_end").over(over).alias("_carry"), F.lag("_last").over(over).alias("_from")), "carried")
    to_here = _whole(segment).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = part.withColumn("_sum", F.when(F.col("_at").isNotNull(), F.sum("_up").over(to_here)))
    rows = part.join(ends, segment)
    smooth = F.col("_sum") * F.col("_down") + F.coalesce(F.col("_carry") * F.exp(F.col("_from") - F.col("_d")), F.lit(0.0))
    return rows.withColumn(name, smooth).drop("_at", "_cost", "_gain", "_d", "_s", "_piece", "_up", "_down", "_carry", "_from", "_sum")


def abs_dev(series: DataFrame, key: Sequence[str], value: str = "y", name: str = "dev", **limits) -> DataFrame:
    """Absolute deviation from the series mean."""

    def build(part: DataFrame, chunk: int) -> DataFrame:
        part = with_totals(part, key, {"_mean": F.avg(value)}, chunk)
        return part.withColumn(name, F.abs(F.col(value) - F.col("_mean"))).drop("_mean")

    return by_length(series, key, build, **limits)


def knee_rows(series: DataFrame, key: Sequence[str], tag: Column, sensitivity: float, chunk: int) -> DataFrame:
    """Knee position (Kneedle, first knee) per series from columns ``i``, ``n``, ``y``.

    Tag u looks for a concave rise, d for a convex fall, any other tag for a concave rise of the distance from the mean.
    Values are rounded to 9 decimals so that the order of summation cannot move a comparison.
    """
    part = series.withColumn("_tag", tag)
    part = with_totals(part, key, {"_mean": F.avg("y")}, chunk)
    part = part.withColumn(
        "_v", F.when(F.col("_tag").isin("u", "d"), F.col("y")).otherwise(nine_decimals(F.abs(F.col("y") - F.col("_mean"))))
    )
    part = with_totals(part, key, {"_lo": F.min("_v"), "_hi": F.max("_v")}, chunk)
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    scaled = (F.col("_v") - F.col("_lo")) / span
    curve = F.when(F.col("_tag") == "d", 1.0 - scaled).otherwise(scaled)
    line = F.col("i") / F.nullif(F.col("n") - 1, F.lit(0))
    part = part.select(*key, "i", "n", nine_decimals(curve - line).alias("_yd"))
    part = with_neighbours(part, key, "_yd", "_prev", "_next", chunk)
    here = F.col("_yd")
    is_max = (here >= F.coalesce("_prev", here)) & (here >= F.coalesce("_next", here))
    is_min = (here <= F.coalesce("_prev", here)) & (here <= F.coalesce("_next", here))
    drop = F.lit(sensitivity) / (F.col("n") - 1)
    part = part.withColumns(
        {
            "_t0": F.when(is_min, F.lit(0.0)).when(is_max, here - drop),
            "_m0": F.when(is_max, F.col("i")),
        }
    )
    part = with_last(part, key, {"_thr": "_t0", "_at": "_m0"}, chunk)
    hit = F.col("_at").isNotNull() & (F.col("_next") < F.col("_thr"))
    return part.groupBy(*key).agg(
        F.max("n").alias("n"),
        F.min_by(F.when(hit, F.col("_at")), F.when(hit, F.col("i"))).alias("knee"),
    )


def knee(series: DataFrame, key: Sequence[str], tag: Column | str, sensitivity: float = 2.0, **limits) -> DataFrame:
    """One row per series: ``n`` and the knee position, null where there is none."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return by_length(series, key, lambda part, chunk: knee_rows(part, key, tag, sensitivity, chunk), **limits)


def phase_edges(knees: DataFrame) -> DataFrame:
    """Add ``edges``: 0, nine sorted positions (the knee and decile fills), and the last position."""
    tenth = lambda m: F.floor(F.col("n") * m / 10).cast("int")
    fills = [tenth(m) for m in range(2, 10)]
    nine = F.array_sort(F.array(F.coalesce(F.col("knee"), tenth(1)), *fills))
    return knees.withColumn("edges", F.concat(F.array(F.lit(0)), nine, F.array(F.col("n") - 1)))


def phase_positions(edges: Column, shift: int = 0) -> list[Column]:
    """Positions where phases 1, 2 and 3 begin."""
    return [F.element_at(edges, min(shift + step, 10) + 1) for step in (3, 6, 9)]


def cut_phases(rows: DataFrame, edges: DataFrame, key: Sequence[str], shift: int = 0) -> DataFrame:
    """State 0..3 of each row by its position ``i``; series shorter than two rows get 0."""
    first, second, third = phase_positions(F.col("edges"), shift)
    state = (
        F.when((F.col("n") < 2) | (F.col("i") < first), 0)
        .when(F.col("i") < second, 1)
        .when(F.col("i") < third, 2)
        .otherwise(3)
    )
    return rows.drop("n").join(edges.select(*key, "n", "edges"), list(key)).withColumn("state", state).drop("n", "edges")


def state_runs(df: DataFrame, key: Sequence[str], state: str, **limits) -> DataFrame:
    """Maximal runs of one state: run number, state, first and last position, length. Needs ``i``.

    A missing state is a state of its own.
    """

    def build(part: DataFrame, chunk: int) -> DataFrame:
        part = with_neighbours(part.select(*key, "i", state), key, state, "_prev", "_next", chunk)
        change = F.when((F.col("i") == 0) | ~F.col("_prev").eqNullSafe(F.col(state)), 1).otherwise(0)
        part = with_running_sum(part.withColumn("_new", change), key, "_new", "run", chunk)
        return part.groupBy(*key, "run").agg(
            F.min_by(state, "i").alias(state),
            F.min("i").alias("run_start"),
            (F.max("i") + 1).alias("run_end"),
            F.count(F.lit(1)).alias("run_rows"),
        )

    return by_length(df, key, build, **limits)
