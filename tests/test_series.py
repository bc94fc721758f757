"""Series operators against plain loops, on degenerate series, and with long series cut into chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetwear.operators import series as S
from fleetwear.operators.states import label_states
from fleetwear.queries import views as V
from conftest import SF

CUT = {"max_rows": 20, "chunk": 8}


def frame(spark, rows):
    return spark.createDataFrame(rows, "unit int, t int, y double")


def random_series(spark):
    rng = np.random.default_rng(3)
    rows = [(u, int(t), float(round(rng.random(), 3))) for u, n in ((1, 1), (2, 2), (3, 8), (4, 57), (5, 131)) for t in range(n)]
    rows += [(6, t, 1.0) for t in range(30)]
    return frame(spark, rows)


def rows_of(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def knee_loop(y, tag):
    n = len(y)
    v = np.asarray(y) if tag in "ud" else np.round(np.abs(np.asarray(y) - np.mean(y)), 9)
    if n < 2 or v.max() == v.min():
        return None
    s = (v - v.min()) / (v.max() - v.min())
    yd = np.round((1 - s if tag == "d" else s) - np.arange(n) / (n - 1), 9)
    threshold, at = None, None
    for i in range(n - 1):
        before, after = yd[max(i - 1, 0)], yd[i + 1]
        if yd[i] >= before and yd[i] >= after:
            threshold, at = yd[i] - 2.0 / (n - 1), i
        if yd[i] <= before and yd[i] <= after:
            threshold = 0.0
        if at is not None and after < threshold:
            return at
    return None


@pytest.mark.parametrize("limits", [{}, CUT])
@pytest.mark.parametrize("tag", ["u", "d", "c"])
def test_knee(spark, tag, limits):
    indexed = S.index_series(random_series(spark), ["unit"], ["t"], **limits)
    found = {r["unit"]: r["knee"] for r in S.knee(indexed, ["unit"], tag, **limits).collect()}
    data = rows_of(random_series(spark), "unit", "t")
    assert found == {u: knee_loop(g["y"].to_numpy(), tag) for u, g in data.groupby("unit")}


@pytest.mark.parametrize("limits", [{}, CUT])
def test_index(spark, limits):
    got = rows_of(S.index_series(random_series(spark), ["unit"], ["t"], **limits), "unit", "t")
    assert (got["i"] == got["t"]).all()
    assert (got["n"] == got.groupby("unit")["t"].transform("size")).all()


@pytest.mark.parametrize("alpha", [0.05, 0.5, 0.97, 1.0])
def test_smoothing_equals_pandas(spark, alpha):
    rng = np.random.default_rng(1)
    y = rng.random(3000)
    data = spark.createDataFrame(pd.DataFrame({"unit": 1, "i": np.arange(3000), "y": y}))
    got = rows_of(S.ewm(data, ["unit"], alpha), "i")["smooth"]
    assert np.allclose(got, pd.Series(y).ewm(alpha=alpha, adjust=False).mean(), atol=1e-12)


@pytest.mark.parametrize("limits", [{}, CUT])
@pytest.mark.parametrize("alpha", [1e-6, 0.05, 0.9, 1.0])
def test_smoothing_over_gaps(spark, alpha, limits):
    """Missing values, long gaps, gaps at both ends, a series of nothing else: as a plain loop has it."""
    rng = np.random.default_rng(2)
    long = np.where(rng.random(2500) < 0.3, np.nan, rng.normal(size=2500))
    long[700:1600] = np.nan
    cases = {1: long, 2: np.array([np.nan, np.nan, 1.0, np.nan, 3.0, np.nan]), 3: np.full(4, np.nan), 4: np.array([2.0])}
    rows = [(u, i, None if np.isnan(v) and i % 2 else float(v)) for u, y in cases.items() for i, v in enumerate(y)]
    data = spark.createDataFrame(rows, "unit int, i int, y double")
    got = rows_of(S.ewm(data, ["unit"], alpha, **limits), "unit", "i")
    assert list(got.columns) == ["unit", "i", "y", "smooth"] and len(got) == len(rows)
    for unit, y in cases.items():
        want, e, gap = [], None, 1
        for v in y:
            if not np.isnan(v):
                w = (1 - alpha) ** gap
                e, gap = (v if e is None else (w * e + alpha * v) / (w + alpha)), 0
            gap += 1
            want.append(np.nan if e is None else e)
        mine = got[got["unit"] == unit]["smooth"].to_numpy(dtype=float)
        assert np.allclose(mine, want, atol=1e-9, equal_nan=True), unit


@pytest.mark.parametrize("limits", [{}, CUT])
def test_runs_tile_the_series(spark, limits):
    rows = S.index_series(random_series(spark), ["unit"], ["t"]).withColumn("state", (F.col("y") * 3).cast("int"))
    runs = rows_of(S.state_runs(rows, ["unit"], "state", **limits), "unit", "run_start")
    for _, g in runs.groupby("unit"):
        assert g["run_start"].iloc[0] == 0
        assert (g["run_start"].iloc[1:].to_numpy() == g["run_end"].iloc[:-1].to_numpy()).all()
        assert (g["state"].iloc[1:].to_numpy() != g["state"].iloc[:-1].to_numpy()).all()
        assert (g["run_end"] - g["run_start"] == g["run_rows"]).all()


def test_edges_with_and_without_knee(spark):
    knees = spark.createDataFrame([(1, 20, None), (2, 20, 3), (3, 20, 4)], "unit int, n int, knee int")
    edges = {r["unit"]: list(r["edges"]) for r in S.phase_edges(knees).collect()}
    assert edges[1] == [0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 19]
    assert edges[2] == [0, 3, 4, 6, 8, 10, 12, 14, 16, 18, 19]
    assert edges[3] == [0, 4, 4, 6, 8, 10, 12, 14, 16, 18, 19]  # a knee on a fill stays twice


def test_labels_do_not_depend_on_chunks(spark):
    readings, tags = V.readings(spark, SF), V.tags(spark)
    whole = label_states(readings, tags, V.SENSORS)
    cut = label_states(readings, tags, V.SENSORS, max_rows=50, chunk=16)
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()


def test_missing_constant_and_unmapped(spark):
    rows = [("A", 1, t, None if t == 3 else float(t), 5.0) for t in range(1, 13)] + [("B", 1, 1, 1.0, 1.0)]
    readings = spark.createDataFrame(rows, "dataset string, unit int, cycle int, s2 double, s3 double")
    tags = spark.createDataFrame([("A", "s2", "u"), ("A", "s3", "d"), ("A", "s9", "x")], "dataset string, sensor string, tag string")
    got = label_states(readings, tags, ["s2", "s3"]).toPandas()
    assert set(got["dataset"]) == {"A"} and set(got["tag"]) == {"u", "d"} and len(got) == 24
    assert got["state"].between(0, 3).all()


@pytest.mark.parametrize("limits", [{}, {"max_rows": 2, "chunk": 2}])
def test_a_missing_state_is_a_run_of_its_own(spark, limits):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([None, "a", None, None, "a", "a", "b"])], "k int, i int, s string")
    got = S.state_runs(rows, ["k"], "s", **limits).orderBy("run").collect()
    assert [(r["s"], r["run_rows"]) for r in got] == [(None, 1), ("a", 1), (None, 2), ("a", 2), ("b", 1)]
