"""Exact cuts in hash order, counted digit by digit."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from fleetwear.operators import splits


@pytest.mark.parametrize("digits", [1, 3, 4])
def test_cut_is_the_nth_hash(spark, digits):
    """Also where many rounds are needed: hashes that share their first digits, and copies of one hash."""
    hashes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(300)]
    groups = {"plain": hashes, "deep": ["00000000" + h[8:] for h in hashes[:40]], "copies": sorted(hashes[:20] + [hashes[7]] * 30), None: hashes[:9]}
    wanted = {"plain": 77, "deep": 13, "copies": 25, None: 9}
    rows = spark.createDataFrame([(g, h) for g, hs in groups.items() for h in hs], "g string, h string").repartition(5)
    take = spark.createDataFrame([*wanted.items(), ("absent", 3)], "g string, take long")
    got = {r["g"]: r["cut"] for r in splits.hash_cut(rows, take, ["g"], digits).collect()}
    assert got == {g: sorted(groups[g])[n - 1] for g, n in wanted.items()}
    one = splits.hash_cut(rows.filter("g = 'plain'").select("h"), spark.createDataFrame([(77,)], "take long"), (), digits)
    assert [r["cut"] for r in one.collect()] == [got["plain"]]


def test_no_rows_nothing_taken(spark):
    rows = spark.createDataFrame([], "g string, h string")
    take = spark.createDataFrame([("a", 0)], "g string, take long")
    assert splits.hash_cut(rows, take, ["g"]).isEmpty()
    some = spark.createDataFrame([("a", "0" * 32)], "g string, h string")
    assert splits.hash_cut(some, take, ["g"]).isEmpty()


def test_copies_of_a_key_share_a_side(spark):
    rows = spark.range(200).select((F.col("id") % 50).alias("k"))
    split = splits.random_split(rows, ["k"], 0.1, exact=True)
    assert split.groupBy("k").agg(F.count_distinct("is_test").alias("n")).filter("n > 1").isEmpty()
    assert 20 <= split.filter("is_test").count() < 24
