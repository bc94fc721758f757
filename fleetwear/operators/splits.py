"""Leak-free splits. A split is a cut in md5 order, so rows are only filtered, never sorted or joined by group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.functions.columns import hash_text
from fleetwear.runtime import settle

DIGITS = 4  # hex digits told apart in a round: 65,536 buckets of nearly equal size


def hash_cut(hashed: DataFrame, take: DataFrame, by: Sequence[str] = (), digits: int = DIGITS) -> DataFrame:
    """Per group, the ``take``-th smallest hash: ``by..., cut`` (no row where ``take`` is 0).

    ``hashed`` has ``by`` and hashes ``h``; ``take`` has ``by`` and ``take``. Rows are never ranked: buckets of the hash prefix are
    counted, a running sum over at most ``16 ** digits`` counts a group finds the bucket of the cut, and the rows of that
    bucket alone are counted again by the next digits, until it holds one hash. Every round leaves a 65,536th of the rows.
    """
    if not by:
        one = F.lit(0).alias("_g")
        return hash_cut(hashed.select("h", one), take.select("take", one), ["_g"], digits).drop("_g")
    by, rows, done = list(by), hashed.select(*by, "h"), []
    longest = 32  # hex digits of an md5
    for end in range(digits, longest + digits, digits):
        prefixed = rows.select(*by, "h", F.substring("h", 1, end).alias("_p"))
        counts = prefixed.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("h").alias("_lo"), F.max("h").alias("cut"))
        upto = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        counts = _match(counts.withColumn("_upto", F.sum("_n").over(upto)), take, by)
        hit = counts.filter((F.col("_upto") >= F.col("take")) & (F.col("_upto") - F.col("_n") < F.col("take")))
        hit = settle(hit.select(*by, "_p", "_lo", "cut", (F.col("take") - F.col("_upto") + F.col("_n")).alias("take")), "cut")
        done.append(hit.filter("_lo = cut").select(*by, "cut"))
        further = hit.filter("_lo <> cut")
        if further.isEmpty():
            break
        rows = settle(_match(prefixed, further.select(*by, "_p"), [*by, "_p"]).select(*by, "h"), "bucket")
        take = further.select(*by, "take")
    return reduce(DataFrame.unionByName, done)


def _match(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by columns whose nulls are a value like any other; the columns are kept once."""
    named = right.select(*[F.col(c).alias(f"_{c}") if c in by else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return left.join(named, same, how).drop(*[f"_{c}" for c in by])


def ceil_share(count: Column, share: float) -> Column:
    """``ceil(share * count)``, safe against the last digit of the product."""
    return F.ceil(F.round(count * share, 9)).cast("bigint")


def _mark(df: DataFrame, digest: Column, cut: DataFrame, by: Sequence[str]) -> DataFrame:
    cut = settle(cut, "cut-value")
    if by:
        df = _match(df, cut, list(by), "left")
        return df.withColumn("is_test", F.coalesce(digest <= F.col("cut"), F.lit(False))).drop("cut")
    value = cut.agg(F.max("cut")).first()[0]  # one value
    return df.withColumn("is_test", (digest <= F.lit(value)) if value is not None else F.lit(False))


def group_split(df: DataFrame, groups: Sequence[str] = ("unit",), test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(test * groups)`` whole groups are test.

    The default groups by unit number alone, so same-numbered engines of two datasets stay on one side;
    pass ``["dataset", "unit"]`` to treat them apart.
    """
    digest = hash_text(seed, *[F.col(g) for g in groups])
    hashed = settle(df.select(*groups).distinct().select(digest.alias("h")), "groups")
    take = hashed.agg(ceil_share(F.count(F.lit(1)), test).alias("take"))
    return _mark(df, digest, hash_cut(hashed, take), ())


def random_split(df: DataFrame, key: Sequence[str], test: float = 0.2, seed: int = 42, exact: bool = False) -> DataFrame:
    """Add ``is_test`` row by row: a hash threshold in one pass, or an exact ``ceil(test * rows)``.

    Rows with equal keys share a side: when the cut falls among copies of a key, all of them are test.
    """
    digest = hash_text(seed, *[F.col(k) for k in key])
    if not exact:
        return df.withColumn("is_test", F.substring(digest, 1, 8) < F.lit(f"{int(test * 16**8):08x}"))
    take = df.agg(ceil_share(F.count(F.lit(1)), test).alias("take"))
    return _mark(df, digest, hash_cut(df.select(digest.alias("h")), take), ())


def stratified_take(counts: DataFrame, by: Sequence[str], test: float) -> DataFrame:
    """Test rows per class by largest remainder, so that they add up to ``ceil(test * rows)``; works on class counts."""
    share = F.col("rows") * test
    floors = counts.withColumn("_floor", F.floor(F.round(share, 9))).withColumn(
        "_rest", F.round(share - F.col("_floor"), 9)
    )
    whole = F.struct(F.sum("rows").alias("rows"), F.sum("_floor").alias("floors"))
    short = floors.agg(whole.alias("w")).select((ceil_share(F.col("w.rows"), test) - F.col("w.floors")).alias("_short"))
    # one row per class goes into this window
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), *by))
    ranked = floors.withColumn("_place", place).crossJoin(F.broadcast(short))  # short is one row
    return ranked.select(*by, (F.col("_floor") + F.when(F.col("_place") <= F.col("_short"), 1).otherwise(0)).alias("take"))


def stratified_split(df: DataFrame, key: Sequence[str], by: Sequence[str], test: float = 0.25, seed: int = 42) -> DataFrame:
    """Add ``is_test`` with every class cut in its share; rows of a class with equal keys share a side, as in ``random_split``."""
    by = list(by)
    digest = hash_text(seed, *[F.col(k) for k in key])
    counts = settle(df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")), "classes")
    cut = hash_cut(df.select(*by, digest.alias("h")), stratified_take(counts, by, test), by)
    return _mark(df, digest, cut, by)


def train_rows(split: DataFrame) -> DataFrame:
    return split.filter(~F.col("is_test")).drop("is_test")


def test_rows(split: DataFrame) -> DataFrame:
    return split.filter("is_test").drop("is_test")
