"""Class rebalancing: SMOTE, borderline SMOTE, ADASYN and their mix, with exact counts.

All draws come from md5 of the seed, the base row and the copy number, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from threading import Lock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.functions.columns import between, hash_number, hash_text, hash_unit
from fleetwear.operators.neighbours import nearest_lists, others
from fleetwear.operators.splits import hash_cut
from fleetwear.runtime import settle

BORDER_NEIGHBOURS = 10


class Searches:
    """Neighbour lists of one table, searched and stored once for all methods and multipliers that ask for them."""

    def __init__(self):
        self._lock, self._stored = Lock(), {}

    def lists(self, by: tuple, search: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            if by not in self._stored:
                self._stored[by] = settle(search(), "nearest")
            return self._stored[by]


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def rarest(counts: DataFrame, label: str) -> DataFrame:
    """The label with the fewest rows; the smallest such label on a tie."""
    first = F.min(F.struct("rows", label)).alias("m")
    return counts.agg(first).select(f"m.{label}", "m.rows")


def targets(counts: DataFrame, label: str, strategy: str, m: float) -> DataFrame:
    """``label, rows, new``: rows to add per class.

    ``rarest`` brings the rarest class to ``int(rows * m)``, ``all`` every class to ``max(int(rows * m), rows + 1)``,
    ``scale`` every class to ``int(rows * m)``, ``not_majority`` every class to the largest.
    """
    scaled = F.floor(F.col("rows") * m)
    if strategy == "rarest":
        counts, goal = rarest(counts, label), scaled
    elif strategy == "all":
        goal = F.greatest(scaled, F.col("rows") + 1)
    elif strategy == "scale":
        goal = scaled
    elif strategy == "not_majority":
        top = counts.agg(F.max("rows").alias("top"))
        counts, goal = counts.crossJoin(F.broadcast(top)), F.col("top")  # top is one row
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return counts.select(label, "rows", F.greatest(goal - F.col("rows"), F.lit(0)).cast("bigint").alias("new"))


def _original(df: DataFrame, key: str, label: str, features: str) -> DataFrame:
    return df.select(
        key, F.lit("").alias("synth_id"), label, F.col(features).cast("array<double>").alias(features), F.lit(False).alias("is_synthetic")
    )


def _spread(bases: DataFrame, per_class: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """``copies`` per base: an even share, and one more for the first ``new % bases`` rows in md5 order."""
    digest = hash_text(seed, "spread", F.col(key))
    take = per_class.select(label, (F.col("new") % F.col("bases")).alias("take")).filter(F.col("take") > 0)
    cut = hash_cut(bases.select(label, digest.alias("h")), take, [label])
    shares = settle(
        per_class.select(label, F.floor(F.col("new") / F.col("bases")).alias("_even")).join(cut, label, "left"), "shares"
    )
    more = F.when(digest <= F.col("cut"), 1).otherwise(0)
    return bases.join(shares, label).withColumn("copies", F.col("_even") + more).drop("_even", "cut")


def foreign_share(near: Column, label: Column) -> Column:
    """Number of neighbours of another class."""
    return F.size(F.filter(near, lambda n: n["tag"] != label))


def _bases(rows: DataFrame, goal: DataFrame, key, label, features, method, k, seed, searches: Searches, by: tuple) -> DataFrame | None:
    """Rows that get synthetic ones, with ``copies``; None when the method finds nothing to work with."""
    wanted = rows.join(goal, label)
    if method == "smote":
        per_class = goal.withColumn("bases", F.col("rows"))
        return _spread(wanted.select(key, label), per_class, key, label, seed)
    reach = BORDER_NEIGHBOURS if method == "borderline" else k
    most = max(BORDER_NEIGHBOURS, k)  # one search serves both methods
    around = searches.lists(("around", most, *by), lambda: nearest_lists(wanted, rows, key, features, most + 1, tag=label))
    judged = wanted.select(key, label, "new").join(around, key)
    foreign = foreign_share(others(F.col("near"), F.col(key), reach), F.col(label))
    judged = settle(judged.select(key, label, "new", foreign.alias("foreign")), "judged")
    if method == "borderline":
        danger = judged.filter((F.col("foreign") * 2 >= reach) & (F.col("foreign") < reach))
        per_class = settle(danger.groupBy(label).agg(F.count(F.lit(1)).alias("bases")).join(goal, label), "danger")
        return _spread(danger.select(key, label), per_class, key, label, seed)
    sums = settle(judged.groupBy(label).agg(F.sum("foreign").alias("all_foreign")), "foreign")
    if not sums.filter("all_foreign = 0").isEmpty():
        return None
    copies = F.rint(F.col("foreign") / F.col("all_foreign") * F.col("new")).cast("bigint")
    return judged.join(sums, label).select(key, label, copies.alias("copies"))


def synthesise(
    df: DataFrame, key: str, label: str, features: str, method: str, strategy: str, m: float, k: int, seed: int, searches: Searches | None = None
) -> DataFrame | None:
    """Only the new rows, or None when the method cannot add any and the input should stay as it is.

    ``searches`` keeps neighbour lists for further calls on the same rows, key, label and features.
    """
    searches = searches or Searches()
    rows = df.select(key, label, features)
    goal = settle(targets(class_counts(rows, label), label, strategy, m).filter("new > 0"), "goal")
    if strategy == "rarest":
        row = goal.first()  # one class
        if row is None or row["rows"] < 2:
            return None
        k = min(k, row["rows"] - 1)
    elif goal.isEmpty() or not goal.filter(F.col("rows") <= k).isEmpty():
        return None
    # which classes get new rows does not depend on m, except under ``scale``
    by = (strategy, m if strategy == "scale" else None)
    bases = _bases(rows, goal, key, label, features, method, k, seed, searches, by)
    if bases is None:
        return None
    members = rows.join(goal.select(label), label)
    # neighbours are sought among all members: a base that gets no copy may still be a partner
    near = searches.lists(("class", k, *by), lambda: nearest_lists(members, members, key, features, k + 1, same=label))
    near = near.select(key, others(F.col("near"), F.col(key), k).alias("near"))
    digest = hash_text(seed, F.col(key), F.col("_j"))
    drawn = (
        bases.filter("copies > 0")
        .join(near, key)
        .select(key, label, "near", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_j"))
        .withColumn("_h", digest)
        .withColumn("_partner", F.element_at("near", (hash_number(F.col("_h")) % F.size("near") + 1).cast("int"))["id"])
        .select(key, label, "_j", "_partner", hash_unit(F.col("_h")).alias("_gap"))
    )
    vector = F.col(features).cast("array<double>")
    start = rows.select(key, vector.alias("_a"))
    partner = rows.select(F.col(key).alias("_partner"), vector.alias("_b"))
    made = drawn.join(start, key).join(partner, "_partner")
    return made.select(
        key,
        F.concat(F.lit(f"{method}:"), F.col("_j").cast("string")).alias("synth_id"),
        label,
        between(F.col("_a"), F.col("_b"), F.col("_gap")).alias(features),
        F.lit(True).alias("is_synthetic"),
    )


def oversample(
    df: DataFrame,
    key: str,
    label: str,
    method: str = "smote",
    strategy: str = "rarest",
    m: float = 5.0,
    k: int = 5,
    seed: int = 42,
    features: str = "features",
    searches: Searches | None = None,
) -> DataFrame:
    """Input rows and synthetic rows: ``key, synth_id, label, features, is_synthetic``.

    Synthetic rows keep the key of their base row and are told apart by ``synth_id``. A multiplier of 1, or a
    method that cannot add rows (a class with too few members, no foreign neighbours), gives the input back.
    ``mix`` adds the new rows of all three methods, each balancing the classes, ``m - 1`` times over. Calls on the same rows may
    share their neighbour ``searches``.
    """
    plain = _original(df, key, label, features)
    searches = searches or Searches()
    if m == 1 and strategy != "not_majority":
        return plain
    if method == "mix":
        parts = [
            part
            for part in (synthesise(df, key, label, features, name, "not_majority", m, k, seed, searches) for name in ("smote", "adasyn", "borderline"))
            if part is not None
        ]
        if not parts:
            return plain
        new = parts[0]
        for part in parts[1:]:
            new = new.unionByName(part)
        new = repeat_rows(new, int(m) - 1)
        new = new.withColumn("synth_id", F.concat_ws(":", "synth_id", F.col("repeat").cast("string"))).drop("repeat")
        return plain.unionByName(new)
    if method not in ("smote", "borderline", "adasyn"):
        raise ValueError(f"unknown method {method}")
    new = synthesise(df, key, label, features, method, strategy, m, k, seed, searches)
    return plain if new is None else plain.unionByName(new)


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, numbered by ``repeat``."""
    if times < 1:
        return df.withColumn("repeat", F.lit(1)).limit(0)
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(times))))
