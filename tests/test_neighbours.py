"""The tree of cells: exact lists, and few pairs compared."""

from __future__ import annotations

import numpy as np

from fleetwear import runtime
from fleetwear.operators import neighbours


def _rows(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "id long, features array<double>")


def _clustered(spark, clusters=40, each=50, dim=64):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(clusters, dim)) * 4
    x = np.round(np.repeat(centres, each, axis=0) + rng.normal(size=(clusters * each, dim)) * 0.3, 3)
    x[::97] = x[0]  # repeated vectors
    return x, _rows(spark, range(len(x)), x)


def test_cell_tree_compares_few_pairs(spark):
    """On clustered points of 64 dimensions less than a tenth of all pairs is looked at, and the lists are exact."""
    x, rows = _clustered(spark)
    limits = {"block_rows": 64, "fan": 32}
    seen = neighbours.compared_pairs(rows, rows, "id", "features", 5, **limits).first()
    assert 0 < seen["compared"] < seen["pairs"] / 10
    got = neighbours.knn(rows, rows, "id", "features", 5, **limits).toPandas().sort_values(["id", "rank"])
    found = got["neighbour"].to_numpy().reshape(-1, 5)
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert found[i].tolist() == np.lexsort((np.arange(len(x)), d))[:5].tolist(), i


def test_queries_apart_from_the_points(spark):
    """Queries that are no points of the base, far from every cell, and fewer points than asked for."""
    x, rows = _clustered(spark, clusters=10, each=30, dim=6)
    far = np.vstack([x[:40] + 0.05, x[:5] + 300.0])
    asks = _rows(spark, range(10_000, 10_000 + len(far)), far)
    got = neighbours.knn(asks, rows, "id", "features", 3, block_rows=16, fan=4).toPandas().sort_values(["id", "rank"])
    found = got["neighbour"].to_numpy().reshape(-1, 3)
    for i, q in enumerate(far):
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        assert found[i].tolist() == np.lexsort((np.arange(len(x)), d))[:3].tolist(), i
    few = neighbours.knn(asks, rows.filter("id < 2"), "id", "features", 3, block_rows=1, fan=2)
    assert few.groupBy("id").count().filter("count <> 2").count() == 0


def test_tables_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """Where no bound helps every query visits every cell; what is stored stays a multiple of the rows, and the lists are exact."""
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(2500, 16)), 4)
    rows = _rows(spark, range(len(x)), x).repartition(1)
    monkeypatch.setattr(runtime, "scratch_dir", lambda spark: str(tmp_path))
    got = neighbours.knn(rows, rows, "id", "features", 4, block_rows=64).toPandas().sort_values(["id", "rank"])
    stored = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert stored < 20 * x.nbytes, stored
    found = got["neighbour"].to_numpy().reshape(-1, 4)
    for i in range(0, len(x), 50):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert found[i].tolist() == np.lexsort((np.arange(len(x)), d))[:4].tolist(), i
