"""Exact k nearest neighbours without forming all pairs.

Equal vectors are folded first: only the k + 1 smallest ids of a vector can be among anyone's k nearest (ties go to
the smaller id), and equal queries share one search. The points of every group then form a tree: a cell of more than
``block_rows`` points is split among ``fan`` of its own points, level by level, until it is small. The search takes two
rounds. A query is first compared with the cell it falls into, which bounds how far its neighbours can be. Then neighbouring
cells are packed into one row of arrays each, queries too, and every pack of queries meets every pack of points of its group
in a Cartesian product, which reads the stored packs again and shuffles nothing. Inside a pair of packs a query leaves out the
cells whose ball of points its bound rules out; the bound falls from pack to pack, and a task hands on no more than the nearest
rows of each query. So the tables on disk grow with the rows, whatever the number of cells that a query has to visit.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.runtime import settle

BLOCK_ROWS = 2048
FAN = 32
POINT_PACK, ASK_PACK = 4096, 2048  # rows of a pack
PART_ROWS = 65536  # rows of the packs that a task holds
MAX_DEPTH = 12  # cells that are still large below it are searched in blocks, like any other
CELL = ["grp", "cell"]
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"  # a cell is named by its way down the tree


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to the few rows of ``y``."""
    return np.sqrt(np.stack([((x - row) ** 2).sum(axis=1) for row in y], axis=1))


def _nearest(x: np.ndarray, y: np.ndarray, keep: int, bound: np.ndarray | None = None):
    """Per row of ``x`` the ``keep`` nearest rows of ``y``, ties to the earlier: row, place in ``y`` and distance.

    Products of matrices choose candidates within their rounding error; only these get exact distances. Rows of ``y``
    farther than the ``bound`` of a row of ``x`` may be left out.
    """
    middle = y.mean(axis=0)
    xm, ym = x - middle, y - middle
    xx, yy = (xm**2).sum(axis=1), (ym**2).sum(axis=1)
    slack = 1e-14 * (x.shape[1] + 16)
    rows, places, dists = [], [], []
    step = max(1, 2_000_000 // len(y))
    for start in range(0, len(x), step):
        part = slice(start, start + step)
        near = xx[part, None] + yy[None, :] - 2.0 * (xm[part] @ ym.T)
        error = slack * (xx[part] + yy.max())
        within = None if bound is None else near <= (bound[part] ** 2 * (1 + 1e-9) + error)[:, None]
        if within is None or np.count_nonzero(within) > 8 * keep * len(near):
            closest = np.partition(near, keep - 1, axis=1)[:, keep - 1] + error
            within = near <= closest[:, None] if within is None else within & (near <= closest[:, None])
        row, place = np.nonzero(within)
        row += start
        dist = np.empty(len(row))
        for at in range(0, len(row), 50_000):
            some = slice(at, at + 50_000)
            dist[some] = np.sqrt(((x[row[some]] - y[place[some]]) ** 2).sum(axis=1))
        order = np.lexsort((place, dist, row))
        row, place, dist = row[order], place[order], dist[order]
        first = np.searchsorted(row, row, side="left")
        best = np.arange(len(row)) - first < keep
        rows.append(row[best]), places.append(place[best]), dists.append(dist[best])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(dists)


def _compare_blocks(need: int):
    def compare(asks: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if asks.empty or points.empty:
            return pd.DataFrame({"ask": [], "dist": [], "id": [], "tag": []})
        points = points.sort_values("id", kind="stable")  # the earlier row then is the smaller id
        x, y = np.stack(asks["v"].to_numpy()), np.stack(points["v"].to_numpy())
        row, place, dist = _nearest(x, y, min(need, len(y)))
        return pd.DataFrame(
            {"ask": asks["ask"].to_numpy()[row], "dist": dist, "id": points["id"].to_numpy()[place], "tag": points["tag"].to_numpy()[place]}
        )

    return compare


def _assign(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Rows of one cell dealt to its pivots."""
    if rows.empty:
        return rows[["is_ask", "id", "grp", "cell"]]
    pivots = pivots.sort_values("place")
    d = _distances(np.stack(rows["v"].to_numpy()), np.stack(pivots["v"].to_numpy()))
    names = pivots["child"].to_numpy()[d.argmin(axis=1)]
    return pd.DataFrame({"is_ask": rows["is_ask"].to_numpy(), "id": rows["id"].to_numpy(), "grp": rows["grp"].to_numpy(), "cell": names})


def _parts(x: np.ndarray, bound: np.ndarray, y: np.ndarray, leaf: np.ndarray):
    """Rows of ``x`` and places in ``y`` to compare: by cell where the bounds rule out half of all, else all at once."""
    _, code, sizes = np.unique(leaf, return_inverse=True, return_counts=True)
    by_cell = np.argsort(code, kind="stable")
    starts = np.cumsum(sizes) - sizes
    centres = np.add.reduceat(y[by_cell], starts) / sizes[:, None]
    radius = np.maximum.reduceat(np.sqrt(((y - centres[code]) ** 2).sum(axis=1))[by_cell], starts)
    xx, cc = (x**2).sum(axis=1)[:, None], (centres**2).sum(axis=1)[None, :]
    sq = xx + cc - 2.0 * (x @ centres.T) - 1e-14 * (x.shape[1] + 16) * (xx + cc)
    far = np.sqrt(np.maximum(sq, 0.0)) - radius * (1 + 1e-9) > (bound * (1 + 1e-9) + 1e-12)[:, None]
    if 2 * (~far @ sizes).sum() > len(x) * len(y):
        return [(np.arange(len(x)), np.arange(len(y)))]
    cells = [(np.nonzero(~far[:, c])[0], by_cell[starts[c] : starts[c] + sizes[c]]) for c in range(len(sizes))]
    return [(rows, places) for rows, places in cells if len(rows)]


class _Found:
    """The nearest rows found so far for the queries of one pack."""

    def __init__(self, asks: pa.Array, bound: np.ndarray, x: np.ndarray, need: int):
        self.asks, self.bound, self.x, self.need = asks, bound, x, need
        self.row, self.dist, self.ids, self.tags = np.empty(0, np.int64), np.empty(0), None, None

    def add(self, row: np.ndarray, dist: np.ndarray, ids: pa.Array, tags: pa.Array) -> None:
        if self.ids is not None:
            ids, tags = pa.concat_arrays([self.ids, ids]), pa.concat_arrays([self.tags, tags])
        row, dist = np.concatenate([self.row, row]), np.concatenate([self.dist, dist])
        order = np.lexsort((dist, row))
        row, dist = row[order], dist[order]
        last = np.arange(len(row)) - np.searchsorted(row, row, side="left") == self.need - 1
        reach = np.full(len(self.x), np.inf)
        reach[row[last]] = dist[last]
        kept = dist <= reach[row]  # all rows of a tie go on: which of them has the smaller id is told at the end
        place = pa.array(order[kept])
        self.row, self.dist, self.ids, self.tags = row[kept], dist[kept], ids.take(place), tags.take(place)
        self.bound = np.minimum(self.bound, reach)

    def rows(self) -> list[pa.Array]:
        return [self.asks.take(pa.array(self.row)), pa.array(self.dist), self.ids, self.tags]


def _matrix(values: pa.Array, rows: int) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _scan(need: int, counted: bool = False):
    """Pairs of packs, all of one pack of queries after each other, to found rows; or to the number of pairs of rows looked at."""

    def scan(batches):
        no, found = None, None
        for batch in batches:
            get = dict(zip(batch.schema.names, batch.columns))
            seen = []
            for i in range(batch.num_rows):
                cell = lambda name: get[name][i].values  # noqa: B023
                if no != get["no"][i].as_py():
                    if found is not None and found.ids is not None and not counted:
                        yield pa.RecordBatch.from_arrays(found.rows(), names=["ask", "dist", "id", "tag"])
                    no, asks = get["no"][i].as_py(), cell("ask")
                    found = _Found(asks, cell("bound").to_numpy(zero_copy_only=False), _matrix(cell("ask_v"), len(asks)), need)
                ids, tags = cell("id"), cell("tag")
                y = _matrix(cell("v"), len(ids))
                for rows, places in _parts(found.x, found.bound, y, cell("leaf").to_numpy(zero_copy_only=False)):
                    seen.append(len(rows) * len(places))
                    row, place, dist = _nearest(found.x[rows], y[places], min(need, len(places)), found.bound[rows])
                    at = pa.array(places[place])
                    found.add(rows[row], dist, ids.take(at), tags.take(at))
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array([sum(seen)], pa.int64())], names=["n"])
        if found is not None and found.ids is not None and not counted:
            yield pa.RecordBatch.from_arrays(found.rows(), names=["ask", "dist", "id", "tag"])

    return scan


def _salted(rows: DataFrame, name: str, block_rows: int, few: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` dealt into blocks within their cell, and ``few`` (``CELL`` too) repeated for every block."""
    blocks = settle(rows.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks")), "blocks")
    dealt = rows.join(blocks, CELL).withColumn("salt", F.pmod(F.xxhash64(name), "blocks").cast("int")).drop("blocks")
    salts = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("salt")
    return dealt, few.join(blocks, CELL).select(*few.columns, salts)


def _tree(points: DataFrame, asks: DataFrame, block_rows: int, fan: int):
    """``(is_ask, id, grp, cell, v)`` of points and queries in their leaves; None if no cell had to be split.

    One round a level; only cells above ``block_rows`` points go on. A pivot falls to itself, so every child is smaller.
    """
    id_type, grp_type = points.schema["id"].dataType.simpleString(), points.schema["grp"].dataType.simpleString()
    root = F.lit("").alias("cell")
    live = points.select(F.lit(False).alias("is_ask"), "id", "grp", root, "v", "lead").unionByName(
        asks.select(F.lit(True).alias("is_ask"), F.col("ask").alias("id"), "grp", root, "v", F.lit(False).alias("lead"))
    )
    leaves = []
    for _ in range(MAX_DEPTH):
        counts = live.filter("NOT is_ask").groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.count_if("lead").alias("different"))
        wanted = F.least(F.lit(fan), F.ceil(2 * F.col("n") / block_rows)).alias("wanted")  # leaves of about half a block
        large = settle(counts.filter((F.col("n") > block_rows) & (F.col("different") > 1)).select(*CELL, wanted), "large-cells")
        if large.isEmpty():
            break
        leaves.append(live.join(large, CELL, "left_anti"))
        live = live.join(large, CELL, "left_semi")
        place = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.xxhash64("v"), "id"))
        drawn = live.filter("lead").withColumn("place", place).filter(F.col("place") <= fan)
        drawn = drawn.join(large, CELL).filter(F.col("place") <= F.col("wanted"))
        child = F.concat("cell", F.substring(F.lit(DIGITS), F.col("place"), F.lit(1))).alias("child")
        pivots = settle(drawn.select(*CELL, "place", "v", child), "pivots")
        dealt, copies = _salted(live, "id", block_rows, pivots)
        block = [*CELL, "salt"]
        schema = f"is_ask boolean, id {id_type}, grp {grp_type}, cell string"
        placed = dealt.groupBy(*block).cogroup(copies.groupBy(*block)).applyInPandas(_assign, schema)
        placed = settle(live.select("is_ask", "id", "v", "grp", "lead").join(placed, ["is_ask", "id", "grp"]), "level")
        live = placed
    if not leaves:
        return None
    return reduce(DataFrame.unionByName, [*leaves, live]).select("is_ask", "id", "grp", "cell", "v")


def _compared(cells: DataFrame, visits: DataFrame, need: int, block_rows: int, schema: str) -> DataFrame:
    """The ``need`` nearest rows that each block of a visited cell has for each query."""
    splits = cells.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("splits"))
    slices = visits.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("slices"))
    sizes = settle(splits.join(slices, CELL), "sizes")
    spread = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))
    left = visits.join(sizes, CELL).select(
        "ask", "v", *CELL, F.pmod(F.xxhash64("ask"), "slices").alias("slice"), spread(F.col("splits")).alias("split")
    )
    right = cells.join(sizes, CELL).select(
        "id", "tag", "v", *CELL, F.pmod(F.xxhash64("id"), "splits").alias("split"), spread(F.col("slices")).alias("slice")
    )
    block = [*CELL, "split", "slice"]
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(_compare_blocks(need), schema)


def _best(found: DataFrame, need: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("ask").orderBy("dist", "id"))
    return found.withColumn("_n", order).filter(F.col("_n") <= need).drop("_n")


def _packs(rows: DataFrame, key: str, others: list[str], pack_rows: int) -> DataFrame:
    """One row a pack: ``grp``, arrays of ``key``, ``others`` and ``leaf`` ordered by ``key``, and the vectors as one array ``v``.

    A pack holds about ``pack_rows`` rows of cells that follow each other in the tree; a larger cell is dealt to several packs.
    """
    counts = rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("cell")) - F.col("n")  # one row a cell
    places = settle(counts.select(*CELL, "n", before.alias("leaf"), F.ceil(F.col("n") / pack_rows).alias("parts")), "places")
    pack = [F.floor(F.col("leaf") / pack_rows).alias("pack"), F.pmod(F.xxhash64(key), "parts").alias("part")]
    entry = F.sort_array(F.collect_list(F.struct(key, *others, "leaf", "v"))).alias("p")
    packs = rows.join(places, CELL).groupBy("grp", *pack).agg(entry)
    packs = packs.select("grp", *[F.col("p")[c].alias(c) for c in (key, *others, "leaf")], F.flatten(F.col("p")["v"]).alias("v"))
    total = places.agg(F.sum("n")).first()[0] or 0
    tasks = rows.sparkSession.sparkContext.defaultParallelism if key == "ask" else 1
    return settle(packs.repartition(max(tasks, -(-total // PART_ROWS))), "packs")


def _meetings(home: DataFrame, cells: DataFrame, need: int, block_rows: int, schema: str) -> DataFrame:
    """Every pack of queries with every pack of points of its group; ``bound`` is the ``need``-th distance in a query's own cell."""
    first = _best(_compared(cells, home, need, block_rows, schema), need)
    bound = first.groupBy("ask").agg(F.when(F.count(F.lit(1)) >= need, F.max("dist")).alias("bound"))
    asks = home.join(bound, "ask", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    asks = _packs(asks, "ask", ["bound"], ASK_PACK).drop("leaf").withColumnsRenamed({"v": "ask_v", "grp": "of"})
    asks = settle(asks.withColumn("no", F.monotonically_increasing_id()), "ask-packs")
    points = _packs(cells, "id", ["tag"], POINT_PACK)
    # not an equality, which would shuffle the packs of a group to one task
    same = (F.col("of") <= F.col("grp")) & (F.col("of") >= F.col("grp"))
    return asks.hint("shuffle_replicate_nl").join(points, same)


def _search(points: DataFrame, asks: DataFrame, need: int, block_rows: int, fan: int, schema: str):
    """The points in their cells, the queries in theirs, and the packs that meet (None if there is one cell a group)."""
    placed = _tree(points, asks, block_rows, min(fan, len(DIGITS)))
    if placed is None:
        return points.withColumn("cell", F.lit("")), asks.withColumn("cell", F.lit("")), None
    home = settle(placed.filter("is_ask").select(F.col("id").alias("ask"), *CELL, "v"), "home")
    tags = points.select("id", "grp", "tag")
    cells = settle(placed.filter("NOT is_ask").select("id", *CELL, "v").join(tags, ["id", "grp"]), "cells")
    return cells, home, _meetings(home, cells, need, block_rows, schema)


def _folded(queries: DataFrame, base: DataFrame, key: str, vec: str, k: int, same: str | None, tag: str | None):
    """Points (the ``k + 1`` smallest ids of a vector, ``lead`` on the first), queries by row, and different queries."""
    group = F.col(same) if same else F.lit(0)
    tagged = F.col(tag) if tag else F.lit(None).cast("int")
    vector = F.col(vec).cast("array<double>").alias("v")
    place = F.row_number().over(Window.partitionBy("grp", "v").orderBy("id"))
    points = base.select(F.col(key).alias("id"), group.alias("grp"), tagged.alias("tag"), vector)
    points = points.withColumn("_n", place).filter(F.col("_n") <= k + 1)
    points = settle(points.withColumn("lead", F.col("_n") == 1).drop("_n"), "points")
    rows = queries.select(F.col(key).alias("id"), group.alias("grp"), vector)
    return points, rows, settle(rows.groupBy("grp", "v").agg(F.min("id").alias("ask")), "asks")


def _schema(points: DataFrame, asks: DataFrame) -> str:
    of = lambda df, name: df.schema[name].dataType.simpleString()
    return f"ask {of(asks, 'ask')}, dist double, id {of(points, 'id')}, tag {of(points, 'tag')}"


def nearest_lists(
    queries: DataFrame,
    base: DataFrame,
    key: str,
    vec: str,
    need: int,
    same: str | None = None,
    tag: str | None = None,
    block_rows: int = BLOCK_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """``key, near``: the ``need`` nearest rows of ``base``, a row of the same key included, as ``(dist, id, tag)``."""
    points, rows, asks = _folded(queries, base, key, vec, need - 1, same, tag)
    schema = _schema(points, asks)
    cells, home, meetings = _search(points, asks, need, block_rows, fan, schema)
    found = _compared(cells, home, need, block_rows, schema) if meetings is None else meetings.mapInArrow(_scan(need), schema)
    best = _best(found, need).groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("dist", "id", "tag"))).alias("near"))
    return rows.join(asks, ["grp", "v"]).select("id", "ask").join(best, "ask").select(F.col("id").alias(key), "near")


def others(near: Column, key: Column, k: int) -> Column:
    """Of a list of at least ``k + 1`` nearest rows the first ``k`` that have another key."""
    return F.slice(F.filter(F.slice(near, 1, k + 1), lambda n: n["id"] != key), 1, k)


def knn_lists(
    queries: DataFrame,
    base: DataFrame,
    key: str,
    vec: str,
    k: int,
    same: str | None = None,
    tag: str | None = None,
    block_rows: int = BLOCK_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """``key, near``: the k nearest rows of ``base`` other than the row itself, as ``(dist, id, tag)``, nearest first.

    ``same`` restricts neighbours to rows with an equal value in that column; ``tag`` is a column of ``base`` to return.
    """
    lists = nearest_lists(queries, base, key, vec, k + 1, same, tag, block_rows, fan)
    return lists.select(key, others(F.col("near"), F.col(key), k).alias("near"))


def compared_pairs(queries: DataFrame, base: DataFrame, key: str, vec: str, k: int, same: str | None = None, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """One row: ``compared``, pairs whose distance the search looks at, and ``pairs``, all pairs within the groups."""
    points, _, asks = _folded(queries, base, key, vec, k, same, None)
    cells, home, meetings = _search(points, asks, k + 1, block_rows, fan, _schema(points, asks))

    def product(left: DataFrame, right: DataFrame, by: list[str], name: str) -> DataFrame:
        both = left.groupBy(*by).count().join(right.groupBy(*by).agg(F.count(F.lit(1)).alias("others")), by)
        return both.select(F.lit(name).alias("name"), (F.col("count") * F.col("others")).alias("n"))

    sums = product(home, cells, CELL, "compared").unionByName(product(asks, points, ["grp"], "pairs"))
    if meetings is not None:
        sums = sums.unionByName(meetings.mapInArrow(_scan(k + 1, counted=True), "n bigint").select(F.lit("compared").alias("name"), "n"))
    return sums.agg(*[F.sum(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in ("compared", "pairs")])


def knn(queries: DataFrame, base: DataFrame, key: str, vec: str, k: int, same: str | None = None, **limits) -> DataFrame:
    """``key, rank, neighbour, distance``, rank from 1."""
    lists = knn_lists(queries, base, key, vec, k, same, **limits)
    return lists.select(key, F.posexplode("near").alias("_p", "_n")).select(
        key, (F.col("_p") + 1).alias("rank"), F.col("_n.id").alias("neighbour"), F.col("_n.dist").alias("distance")
    )
