"""Residue products against Python integers, and mining against a loop over all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetwear.llm import hard_negatives as mining

SCHEMA = "vec_id long, label int, embedding array<double>, key string, block double"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700), st.integers(0, 40), st.integers(0, 10_000))
def test_products_are_exact(width, bits, seed):
    rng = np.random.default_rng(seed)
    most = 2 ** min(bits, 23)
    x, y = (rng.integers(-most, most + 1, (n, width)).astype(np.float64) for n in (5, 7))
    x[0], y[0] = most, -most
    got = mining.products(x, y, mining.primes(width * most**2))
    want = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in y] for r in x]
    assert got.tolist() == want


def test_products_beyond_a_long_are_held():
    x = np.array([[1e200, 1.0], [-1e200, 0.0], [3.0, 0.0]])
    got = mining.products(x, x, mining.primes(2 * int(1e200) ** 2))
    assert got.tolist() == [[mining.MOST, -mining.MOST, mining.MOST], [-mining.MOST, mining.MOST, -mining.MOST], [mining.MOST, -mining.MOST, 9]]


def test_primes_cover_the_range():
    for most in (0, 1, 300, 2**30, 2**70, 2**900):
        found = mining.primes(most)
        assert math.prod(found) > 2 * most and len(set(found)) == len(found) and all(all(p % k for k in range(2, math.isqrt(p) + 1)) for p in found)


def plain_mine(rows, is_anchor, positives=5, negatives=5):
    clean = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(256 * x) for x in v):
            continue
        clean.append((i, label, tuple(math.floor(256 * x) for x in v)))
    width = max((len(v) for _, _, v in clean), default=0)
    clean = [(i, label, v + (0,) * (width - len(v))) for i, label, v in clean]
    held = lambda s: max(-mining.MOST, min(mining.MOST, s))
    out = []
    for i, label, v in set(r for r in clean if is_anchor(r[0])):
        scored = sorted((-held(sum(a * b for a, b in zip(v, w, strict=True))), j, m) for j, m, w in clean if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            found = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(i, j, k, n, -p, -s) for k, (s, n, _) in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 0.5) for r in rows], SCHEMA).repartition(3)


def vectors(seed: int, n: int = 300) -> list[tuple]:
    """Vectors near a few directions, with ties, copies, repeated ids, nulls, odd numbers and other lengths."""
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(k, rng.randrange(4), [x + rng.gauss(0, 0.05) for x in rng.choice(base)]) for k in range(n)]
    rows += [(n + k, k % 4, list(base[0])) for k in range(40)]  # equal scores
    rows += [rows[0], rows[10], (10, 3, list(base[1])), (20, 1, list(base[2]))]
    rows += [(None, 1, base[0]), (1000, None, base[0]), (1001, 1, None), (1002, 1, [1.0, None]), (1003, 1, [float("nan")]), (1004, 2, [float("inf"), 1.0]), (1005, 2, [1e308])]
    return [*rows, (1010, 1, []), (1020, 2, base[0][:3]), (1030, 2, [0.0] * 8)]


@pytest.mark.parametrize("sizes", [(4096, 2048), (50, 4)])
def test_same_as_a_loop(spark, monkeypatch, sizes):
    monkeypatch.setattr(mining, "BLOCK_ROWS", sizes[0])
    monkeypatch.setattr(mining, "ANCHOR_ROWS", sizes[1])
    rows = vectors(3)
    got = mining.mine(table(spark, rows), F.col("vec_id") % 10 == 0).collect()
    want = plain_mine(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and sorted(map(tuple, got)) == want


def test_large_components_and_few_rows(spark):
    rows = [(0, 1, [1e20, 2.0]), (1, 1, [1.0, 3.0]), (2, 2, [0.9, -1.0]), (3, 2, [1e15, 5.0]), (4, 1, [-7.5, 0.25])]
    got = mining.mine(table(spark, rows), F.col("vec_id") % 2 == 0).collect()
    assert sorted(map(tuple, got)) == plain_mine(rows, lambda i: i % 2 == 0)


def test_no_rows_no_anchors_no_partners(spark):
    rows = vectors(4, 20)
    empty = table(spark, rows).filter("false")
    assert mining.mine(empty, F.col("vec_id") % 10 == 0).collect() == []
    assert mining.mine(table(spark, rows), F.lit(False)).collect() == []
    assert mining.mine(table(spark, [(0, 1, [1.0])]), F.lit(True)).collect() == []
    assert mining.mine(table(spark, [(0, 1, []), (1, 1, [])]), F.lit(True)).collect() == []
