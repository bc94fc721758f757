"""Approximate nearest neighbours by cosine over balanced posting lists.

A bounded sample is halved again and again, each time along the direction between two means and at the median, until parts are
small; the parts' means are the centroids, so lists come out near equal. Every vector is then assigned: a graph over the centroids is
searched for the nearest ones, and a vector near a boundary goes into several lists, those whose distance is within a factor of
the best. A query searches the same graph and visits the lists within a wider factor, so it reads few lists where the
data have clusters. Where they have none, the factor selects more lists than the search holds; such a query meets every vector once instead,
in bounded parts as well, and so does one whose lists gave fewer than the asked number. Visits meet lists in bounded parts, heavy lists and much asked ones being
split on both sides; each part returns a query's best, rescored in double precision on the original vectors.

Only the sample, the centroids and one count a list reach the driver, all bounded by ``max_lists``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.runtime import settle

SAMPLE_PER_LIST = 16
EVERY_LIST = -1  # the list of a visit that meets all vectors
VISITS_PER_BATCH = 1 << 15


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` near equal parts of ``x``, by halving at medians; unit length where possible."""
    rng = np.random.default_rng(7)
    parts: list[tuple[np.ndarray, int]] = [(np.arange(len(x)), max(1, min(lists, len(x))))]
    done = []
    while parts:
        rows, k = parts.pop()
        if k == 1:
            mean = x[rows].mean(0)
            norm = np.linalg.norm(mean)
            done.append(mean / norm if norm > 1e-12 else x[rows[0]])
            continue
        y = x[rows]
        a, b = y[rng.integers(len(y))], y[rng.integers(len(y))]
        for _ in range(6):
            side = y @ (a - b) > 0
            if side.all() or not side.any():
                break
            a, b = y[side].mean(0), y[~side].mean(0)
        order = np.argsort(y @ (a - b), kind="stable")
        cut = len(rows) * (k // 2) // k
        parts += [(rows[order[:cut]], k // 2), (rows[order[cut:]], k - k // 2)]
    return np.array(done)


class CentroidGraph:
    """Neighbour lists over centroids and a beam search that handles many vectors at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 24):
        self.centroids = centroids.astype(np.float32)
        n = len(centroids)
        near = np.zeros((n, min(degree, n - 1)), np.int64)
        for a in range(0, n, 1024):
            scores = self.centroids[a : a + 1024] @ self.centroids.T
            scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -2
            near[a : a + 1024] = np.argsort(-scores, axis=1, kind="stable")[:, : near.shape[1]]
        far = np.random.default_rng(3).integers(0, n, (n, 8))  # long links keep the graph in one piece
        self.near = np.concatenate([near, far], 1)
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The centroids found nearest to each row, nearest first, and their Euclidean distances; ``beam`` columns at most."""
        n, c = len(x), len(self.centroids)
        beam = min(beam, c)
        rows = np.arange(n)[:, None]
        best = np.full((n, c), np.inf, np.float32)
        opened = np.zeros((n, c), bool)
        x = x.astype(np.float32)
        first = np.broadcast_to(self.entry, (n, len(self.entry)))
        best[rows, first] = self._distance(x, first)
        for _ in range(4 * beam):
            closed = np.where(opened, np.inf, best)
            at = np.argmin(closed, axis=1)
            value = closed[np.arange(n), at]
            kept = np.partition(best, beam - 1, axis=1)[:, beam - 1]
            going = np.flatnonzero(np.isfinite(value) & (value <= kept))
            if not len(going):
                break
            opened[going, at[going]] = True
            others = self.near[at[going]]
            best[going[:, None], others] = self._distance(x[going], others)
        order = np.argsort(best, axis=1, kind="stable")[:, :beam]
        return order, best[rows, order]

    def _distance(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        dots = np.einsum("nd,nkd->nk", x, self.centroids[lists])
        return np.sqrt(np.maximum(2 - 2 * dots, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v array<double>`` of rows with an id and a finite vector that is not zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    return rows.filter(fine & F.exists("v", lambda e: e != 0))


def _visits(rows: DataFrame, graph, beam: int, factor: float, most: int | None) -> DataFrame:
    """``id, v, list``: a row for each list within ``factor`` of a vector's nearest centroid, ``most`` at most.

    Without ``most``, a vector whose last list in the beam is still within ``factor`` gives one row with ``EVERY_LIST``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = graph.value
        step = max(16, (1 << 21) // max(1, len(found.centroids)))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                order, distance = found.search(_unit(_matrix(part.column(1))), beam)
                keep = distance <= factor * distance[:, :1] + 1e-6
                if most is not None:
                    keep[:, most:] = False
                elif order.shape[1] < len(found.centroids):
                    wide = keep[:, -1] | np.isinf(distance[:, -1])
                    keep[wide, 1:] = False
                    order[wide, 0] = EVERY_LIST
                of, k = np.nonzero(keep)
                for b in range(0, len(of), VISITS_PER_BATCH):
                    f, l = of[b : b + VISITS_PER_BATCH], k[b : b + VISITS_PER_BATCH]
                    taken = part.take(pa.array(f))
                    yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(order[f, l].astype(np.int32))], names=["id", "v", "list"])

    return rows.select("id", "v").mapInArrow(work, "id long, v array<double>, list int")


def _best(k: int):
    def work(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if queries.empty or held.empty:
            return none
        held = held.drop_duplicates("id").sort_values("id")
        raw, ids = np.stack(held["v"].to_list()), held["id"].to_numpy()
        unit = _unit(raw)
        out = []
        asked, asking = queries["id"].to_numpy(), np.stack(queries["v"].to_list())
        for a in range(0, len(asked), 256):
            q = _unit(asking[a : a + 256])
            scores = q @ unit.T
            scores[asked[a : a + 256, None] == ids[None, :]] = -np.inf
            bar = np.partition(scores, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
            for r, c in enumerate(scores >= bar[:, None] - 1e-9):
                at = np.flatnonzero(c & (scores[r] > -np.inf))
                exact = cosine(asking[a + r], raw[at])
                top = np.lexsort((ids[at], -exact))[:k]
                out.append(pd.DataFrame({"query_id": asked[a + r], "vec_id": ids[at][top], "score": exact[top]}))
        return pd.concat(out, ignore_index=True) if out else none

    return work


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of ``x`` with every row of ``y``; the same two vectors always give the same bits."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max(axis=1, keepdims=True)
    return (y * x).sum(1) / np.sqrt((x * x).sum() * (y * y).sum(1))


def _meet(queries: DataFrame, held: DataFrame, k: int, part_rows: int) -> DataFrame:
    """``query_id, vec_id, score``: at least the best ``k`` of each query over the lists it visits, both ``id, v, list``."""
    weights = held.groupBy("list").count().withColumnRenamed("count", "rows").join(
        queries.groupBy("list").count().withColumnRenamed("count", "asks"), "list"
    )
    pieces = settle(
        weights.select(
            "list", F.ceil(F.col("rows") / part_rows).cast("int").alias("parts"), F.ceil(F.col("asks") / part_rows).cast("int").alias("turns")
        ),
        "pieces",
    )
    turns = F.explode(F.sequence(F.lit(0), F.col("turns") - 1))
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = queries.join(F.broadcast(pieces), "list").select("id", "v", "list", parts.alias("part"), F.pmod(F.xxhash64("id"), "turns").alias("turn"))
    right = held.join(F.broadcast(pieces), "list").select("id", "v", "list", F.pmod(F.xxhash64("id"), "parts").alias("part"), turns.alias("turn"))
    keys = ["list", "part", "turn"]
    left, right = (d.select("id", "v", "list", F.col("part").cast("int").alias("part"), F.col("turn").cast("int").alias("turn")) for d in (left, right))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_best(k), "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    list_rows: int = 1000,
    max_lists: int = 8192,
    copies: int = 4,
    boundary: float = 1.06,
    visit: float = 1.25,
    beam: int = 256,
    part_rows: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest vectors found for each vector whose id is divisible by ``every``.

    Returns ``query_id, rank, vec_id, score``: nearest first, ties to the smaller id, the score the cosine in double precision on the
    original vectors. Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor
    do rows without an id; rows that repeat an id count once. With fewer than ``k`` other vectors all are returned. ``beam`` bounds the
    lists that are visited one by one, not what a query meets: where the ratio ``visit`` selects more of them, all vectors are scanned for it. The centroids are fitted
    on at most ``16 * max_lists`` vectors, those with the smallest hashes of their ids; every vector is indexed.
    """
    spark = vectors.sparkSession
    rows = settle(usable(vectors, id_col, vector_col).withColumn("size", F.size("v")), "vectors")
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    rows = rows.filter(F.col("size") == sizes["size"]).drop("size")
    lists = int(min(max_lists, max(1, sizes["count"] // list_rows)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_LIST * max(lists, 64)).select("v").toPandas()
    graph = CentroidGraph(balanced_centroids(_unit(np.stack(sample["v"].to_list())), lists))
    shared = spark.sparkContext.broadcast(graph)  # max_lists centroids at most
    held = settle(_visits(rows, shared, max(32, 2 * copies), boundary, copies), "postings")
    queries = settle(_visits(rows.filter(F.col("id") % every == 0), shared, beam, visit, None), "visits")
    held = held.union(rows.select("id", "v", F.lit(EVERY_LIST).alias("list")))
    once = settle(_meet(queries, held, k, part_rows), "found")
    enough = once.groupBy("query_id").count().filter(F.col("count") >= k)
    asked = rows.filter(F.col("id") % every == 0)
    short = settle(asked.join(enough, asked["id"] == enough["query_id"], "left_anti").select("id", "v", F.lit(EVERY_LIST).alias("list")), "short")
    if lists > 1 and short.take(1):
        once = once.union(_meet(short, held, k, part_rows)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
