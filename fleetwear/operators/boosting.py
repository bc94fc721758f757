"""Boosted trees for several classes: second-order softmax boosting on distributed histograms, level-wise or leaf-wise.

Rows are binned once and stored in blocks with their margins. A job sends the trees under growth to the blocks; every task
sums gradients, Hessians and rows per (class, node, feature, bin) over its rows, Spark adds the sums of the tasks, and the driver
receives split gains, never rows. One job serves a whole level of all classes' trees of all models that are fitted together.

* Level-wise growth finds the best split of a node where the sums meet, so only a few numbers a node travel on.
* Leaf-wise growth splits the leaf that gains most, whichever it is. It asks for the smaller child's sums and gets the sibling's by
  subtraction from the parent's, which the driver keeps for open leaves (leaves x features x bins numbers). Leaves next in line
  are counted ahead, in the same job; a split is kept only when its turn comes, so the tree is that of one leaf at a time.
* One-sided sampling keeps the rows with large gradients and a drawn, heavier weighted share of the others. What is large is told
  from the gradients of the round before, which were counted with that round's roots.
* Boosting ends early when the loss on the validation rows has not fallen for ``patience`` rounds, when no tree can be split, or when
  the training loss is below ``least_loss``.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Generator, Iterator, Mapping
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.runtime import settle

MISSING = 255  # the bin of null and NaN
CUT_ROWS = 200_000  # rows that bin borders are taken from, drawn by hash when there are more
STORE_EVERY = 10  # rounds after which margins are stored anew
CHUNK = 16  # features whose sums travel together
_HELD = 64 << 20  # bytes of sums a task holds


@dataclass(frozen=True)
class Booster:
    """How a model is grown; ``leaves`` asks for leaf-wise growth, ``top`` and ``other`` for one-sided sampling."""

    classes: int = 4
    rounds: int = 500
    rate: float = 0.1
    depth: int = 6
    leaves: int | None = None
    ahead: int = 4
    bins: int = 255
    ridge: float = 1.0
    least_weight: float = 1.0
    least_rows: int = 1
    least_gain: float = 1e-6
    share: float = 1.0
    top: float | None = None
    other: float = 0.1
    patience: int = 10
    least_loss: float = 0.01
    seed: int = 42


XGBOOST = Booster(rate=0.3, share=0.9)
LIGHTGBM = Booster(leaves=31, ridge=0.0, least_weight=1e-3, least_rows=20, depth=64, top=0.2, other=0.1)


@dataclass
class Tree:
    """Nodes in order of making; a leaf has feature -1. ``cut`` is a bin: rows at or below it go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, s: Split, cfg: Booster) -> tuple[int, int]:
        """Gives a leaf two children with the values of their sums."""
        a = len(self.feature)
        self.feature[node], self.cut[node], self.missing_left[node] = s.feature, s.cut, s.missing_left
        self.left[node], self.right[node], self.gain[node] = a, a + 1, s.gain
        for sums in (s.lower, s.total - s.lower):
            for column, first in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.gain, 0.0)):
                column.append(first)
            self.value.append(leaf_value(sums, cfg))
        return a, a + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        feature, cut, go = np.array(self.feature), np.array(self.cut), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        rows = np.arange(len(bins))
        while len(rows := rows[feature[node[rows]] >= 0]):
            at = node[rows]
            b = bins[rows, feature[at]]
            node[rows] = np.where(np.where(b == MISSING, go[at], b <= cut[at]), left[at], right[at])
        return node


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    lower: np.ndarray
    total: np.ndarray


def leaf_value(sums: np.ndarray, cfg: Booster) -> float:
    return float(-cfg.rate * sums[0] / (sums[1] + cfg.ridge + 1e-12))


def best_split(sums: np.ndarray, cfg: Booster, first: int = 0) -> Split:
    """The best split by ``sums`` (features x bins x (gradient, Hessian, rows)); missing values go to the better side.

    Gains that agree in nine digits count as equal: the smaller feature, then the smaller bin wins.
    """
    total = sums[0].sum(0)
    lower = np.cumsum(sums[:, :MISSING], axis=1)[:, :-1]
    missing = sums[:, MISSING][:, None]
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + cfg.ridge + 1e-12)
    best = Split(0.0, -1, 0, False, total * 0, total)
    for to_left in (False, True):
        low = lower + missing if to_left else lower
        high = total - low
        fine = np.minimum(low[..., 1], high[..., 1]) >= cfg.least_weight
        fine &= np.minimum(low[..., 2], high[..., 2]) >= cfg.least_rows
        gain = np.where(fine, (worth(low) + worth(high) - worth(total)) / 2, 0.0)
        gain = np.where(gain > 0, np.round(gain, 9 - int(np.ceil(np.log10(max(gain.max(), 1e-9))))), 0.0)
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[f, b] > best.gain:
            best = Split(float(gain[f, b]), first + int(f), int(b), to_left, low[f, b], total)
    return best


@dataclass
class Request:
    """What a model asks of its rows: the sums of ``nodes`` (class, node), and the spread of gradients beside the roots."""

    trees: list[Tree]
    nodes: list[tuple[int, int]]
    whole: bool
    round: int
    keep_from: float | None = None


Answer = dict  # (class, node) -> Split or sums; "loss" -> training and validation loss; "spread" -> counts
Growth = Generator[Request, Answer, list[list[Tree]]]
_SPREAD = 4096


def _level_wise(cfg: Booster, trees: list[Tree], ask) -> Growth:
    found = yield from ask([(k, 0) for k in range(cfg.classes)], False)
    for level in range(cfg.depth):
        nodes = []
        for (k, node), s in sorted(found.items()):
            if s.gain > cfg.least_gain:
                nodes += [(k, child) for child in trees[k].split(node, s, cfg)]
        if not nodes or level + 1 == cfg.depth:
            return
        found = yield from ask(nodes, False)


@dataclass
class _Leaves:
    """The open leaves of one tree: what each would gain, its sums, and the sums of its children where they are known."""

    queue: list[tuple[float, int]] = field(default_factory=list)
    sums: dict[int, np.ndarray] = field(default_factory=dict)
    splits: dict[int, Split] = field(default_factory=dict)
    children: dict[int, tuple[int, int]] = field(default_factory=dict)
    depth: dict[int, int] = field(default_factory=lambda: {0: 0})
    count: int = 1

    def open(self, node: int, sums: np.ndarray, cfg: Booster) -> None:
        s = best_split(sums, cfg)
        if s.gain > cfg.least_gain and self.depth[node] < cfg.depth:
            heapq.heappush(self.queue, (-s.gain, node))
            self.sums[node], self.splits[node] = sums, s


def _leaf_wise(cfg: Booster, trees: list[Tree], ask) -> Growth:
    every = [_Leaves() for _ in trees]
    found = yield from ask([(k, 0) for k in range(cfg.classes)], True)
    for (k, node), sums in found.items():
        every[k].open(node, sums, cfg)
    while True:
        nodes = {}
        for k, (tree, leaves) in enumerate(zip(trees, every, strict=True)):
            while leaves.queue and leaves.count < cfg.leaves and all(c in leaves.sums for c in leaves.children.get(leaves.queue[0][1], (-1,))):
                _, node = heapq.heappop(leaves.queue)
                for child in leaves.children.pop(node):
                    leaves.open(child, leaves.sums.pop(child), cfg)
                leaves.sums.pop(node), leaves.splits.pop(node)
                leaves.count += 1
            for _, node in heapq.nsmallest(min(cfg.ahead, cfg.leaves - leaves.count), leaves.queue):
                if node not in leaves.children:
                    s = leaves.splits[node]
                    a, b = leaves.children[node] = tree.split(node, s, cfg)
                    leaves.depth[a] = leaves.depth[b] = leaves.depth[node] + 1
                    nodes[k, a if 2 * s.lower[2] <= s.total[2] else b] = node
        if not nodes:
            break
        found = yield from ask(list(nodes), True)
        for (k, child), sums in found.items():
            node, leaves = nodes[k, child], every[k]
            for one in leaves.children[node]:
                leaves.sums[one] = sums if one == child else leaves.sums[node] - sums
    for tree, leaves in zip(trees, every, strict=True):
        for node in leaves.children:  # counted ahead, but its turn did not come
            tree.feature[node] = -1


def _grow(cfg: Booster) -> Growth:
    """The rounds of one model; yields requests and is sent their answers."""
    forest, best, since, spread = [], (np.inf, 0), 0, None
    for r in range(cfg.rounds):
        trees, loss, keep_from = [Tree() for _ in range(cfg.classes)], {}, None
        if cfg.top is not None and r * cfg.rate >= 1:
            above = np.cumsum(spread[::-1])[::-1]
            # The highest border with at least the share ``top`` of the rows above it, by the gradients of the round before.
            keep_from = (int(np.searchsorted(-above, -cfg.top * above[0], side="right")) - 1) * 2.0 / _SPREAD

        def ask(nodes, whole, trees=trees, r=r, keep_from=keep_from, loss=loss):
            answer = yield Request(trees, nodes, whole, r, keep_from)
            loss.setdefault("loss", answer.pop("loss"))
            loss.setdefault("spread", answer.pop("spread", None))
            return answer

        yield from (_leaf_wise if cfg.leaves else _level_wise)(cfg, trees, ask)
        (train, valid), spread = loss["loss"], loss["spread"]  # of the rounds before this one
        if valid is not None:
            best, since = ((valid, r), 0) if valid < best[0] - 1e-6 else (best, since + 1)
            if since >= cfg.patience:
                return forest[: best[1]]
        if train < cfg.least_loss or all(t.feature[0] < 0 for t in trees):
            return forest
        forest.append(trees)
        yield Request([], [], False, r)  # the round is done
    return forest


@dataclass
class _Model:
    """One model's growth: its generator, what it asks now, and the finished rounds that stored margins lack."""

    cfg: Booster
    growth: Growth
    request: Request | None = None
    since: list[list[Tree]] = field(default_factory=list)
    forest: list[list[Tree]] | None = None
    _last: list[Tree] = field(default_factory=list)

    def send(self, answer: Answer | None) -> None:
        try:
            self.request = next(self.growth) if answer is None else self.growth.send(answer)
            while not self.request.nodes and not self.request.trees:
                self.since.append(self._last)
                self.request = self.growth.send({})
            self._last = self.request.trees
        except StopIteration as end:
            self.request, self.forest = None, end.value


def _drawn(block: int, n: int, seed: int, round_: int) -> np.ndarray:
    """A number in [0, 1) for each row of a block and round."""
    with np.errstate(over="ignore"):
        x = (np.arange(n, dtype=np.uint64) + np.uint64(block & 0xFFFFFFFF) * np.uint64(1 << 20)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= np.uint64((seed * 1_000_003 + round_ * 7919 + (block >> 32) * 104_729) & 0xFFFFFFFFFFFFFFFF)
        for _ in range(2):
            x ^= x >> np.uint64(33)
            x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _probabilities(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _margins(stored: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    out = stored.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += np.array(tree.value)[tree.leaf_of(bins)]
    return out


def _unpack(row: dict, width: int, classes: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(row["bins"], np.uint8).reshape(row["n"], width)
    margins = np.frombuffer(row["margins"], np.float64).reshape(row["n"], classes)
    return bins, np.frombuffer(row["labels"], np.int32), np.frombuffer(row["valid"], bool), margins


_SUMS = "model int, class int, node int, chunk int, sums binary"
_PARTIAL = pa.schema([*((c, pa.int32()) for c in ("model", "class", "node", "chunk")), ("sums", pa.binary())])
_BEST = "model int, class int, node int, gain double, feature int, cut int, missing_left boolean, lower array<double>, total array<double>, first int, sums binary"


def _ask(blocks: DataFrame, models: dict[int, _Model], width: int) -> dict[int, Answer]:
    """Serves the requests of all models in one job."""
    asked = {m: (x.cfg, x.request, x.since) for m, x in models.items() if x.request}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            rows = []
            for (m, k, node), s in held.items():
                if node < 0:
                    rows.append((m, k, node, 0, s.tobytes()))
                else:
                    rows += [(m, k, node, c // CHUNK, s[c : c + CHUNK].tobytes()) for c in range(0, max(width, 1), CHUNK)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTIAL, strict=True)], schema=_PARTIAL)

        def add(key: tuple, s: np.ndarray) -> None:
            held[key] = held[key] + s if key in held else s

        for batch in batches:
            for row in batch.to_pylist():
                if row["model"] not in asked:
                    continue
                m, (cfg, request, since) = row["model"], asked[row["model"]]
                bins, labels, valid, stored = _unpack(row, width, cfg.classes)
                p = _probabilities(_margins(stored, bins, since))
                own = p[np.arange(len(p)), labels]
                logs = -np.log(np.maximum(own, 1e-15))
                add((m, -1, -1), np.array([logs[~valid].sum(), (~valid).sum(), logs[valid].sum(), valid.sum()]))
                learn = np.flatnonzero(~valid)
                g = p[learn]
                h = np.maximum(2 * g * (1 - g), 1e-16)
                g[np.arange(len(learn)), labels[learn]] -= 1
                size = np.abs(g).sum(1)
                if cfg.top is not None and request.nodes[0][1] == 0:
                    spread = np.bincount(np.minimum((size * (_SPREAD / 2)).astype(np.int64), _SPREAD - 1), minlength=_SPREAD)
                    add((m, -2, -2), spread.astype(np.float64))
                weight = np.ones(len(learn))
                draw = _drawn(row["block"], len(bins), cfg.seed, request.round)[learn]
                if request.keep_from is not None:
                    rest = size < request.keep_from
                    weight = np.where(rest, np.where(draw < cfg.other / (1 - cfg.top), (1 - cfg.top) / cfg.other, 0.0), 1.0)
                elif cfg.share < 1:
                    weight = (draw < cfg.share).astype(np.float64)
                live = np.flatnonzero(weight)
                learn, g, h, weight = learn[live], g[live], h[live], weight[live]
                places = bins[learn].astype(np.int64) + np.arange(width) * 256
                for k in {k for k, _ in request.nodes}:
                    leaf = request.trees[k].leaf_of(bins[learn])
                    for node in (n for c, n in request.nodes if c == k):
                        of = np.flatnonzero(leaf == node)
                        flat = places[of].ravel()
                        parts = (g[of, k] * weight[of], h[of, k] * weight[of], np.ones(len(of)))
                        s = np.stack([np.bincount(flat, np.repeat(x, width), width * 256).reshape(width, 256) for x in parts], 2)
                        add((m, k, node), s)
                if sum(s.nbytes for s in held.values()) > _HELD:
                    yield flush()
        if held:
            yield flush()

    def reduce(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, k, node, chunk = key
        total = None
        for frame in frames:
            for raw in frame["sums"]:
                s = np.frombuffer(raw, np.float64)
                total = s.copy() if total is None else total + s
        cfg, request, _ = asked[m]
        row = dict.fromkeys(["gain", "feature", "cut", "missing_left", "lower", "total", "sums"]) | {"model": m, "class": k, "node": node, "first": int(chunk) * CHUNK}
        if node < 0 or request.whole:
            row["sums"] = total.tobytes()
        else:
            row |= vars(best_split(total.reshape(-1, 256, 3), cfg, int(chunk) * CHUNK))
        yield pd.DataFrame([row])

    rows = blocks.mapInArrow(count, _SUMS).groupBy("model", "class", "node", "chunk").applyInPandas(reduce, _BEST).collect()
    out: dict[int, Answer] = {m: {} for m in asked}
    for r in sorted(rows, key=lambda r: (r["model"], r["class"], r["node"], r["first"])):
        m, answer = r["model"], out[r["model"]]
        sums = np.frombuffer(r["sums"], np.float64) if r["sums"] is not None else None
        if r["class"] == -1:
            train, n, valid, n_valid = sums
            answer["loss"] = (train / max(n, 1), valid / n_valid if n_valid else None)
        elif r["class"] == -2:
            answer["spread"] = sums
        elif asked[m][1].whole:
            part = sums.reshape(-1, 256, 3)
            at = (r["class"], r["node"])
            answer[at] = np.concatenate([answer[at], part]) if at in answer else part
        else:
            s = Split(r["gain"], r["feature"], r["cut"], r["missing_left"], np.array(r["lower"]), np.array(r["total"]))
            at = (r["class"], r["node"])
            if at not in answer or s.gain > answer[at].gain:
                answer[at] = s
    for m, answer in out.items():
        answer.setdefault("loss", (0.0, None))
        for at in asked[m][1].nodes:  # a node that no drawn row reaches
            answer.setdefault(at, np.zeros((width, 256, 3)) if asked[m][1].whole else Split(0.0, -1, 0, False, np.zeros(3), np.zeros(3)))
    return out


def bin_borders(rows: DataFrame, bins: int) -> dict[int, list[np.ndarray]]:
    """For each model and feature the borders between bins, middles of neighbouring values; all of them if they are few."""
    count = rows.count()
    drawn = rows if count <= CUT_ROWS else rows.filter(F.pmod(F.xxhash64("features"), F.lit(1_000_000)) < int(1_000_000 * CUT_ROWS / count))
    cells = drawn.select("model", F.posexplode("features").alias("feature", "v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))

    def cut(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        v = frame["v"].to_numpy()
        values = np.unique(v)
        if len(values) > bins - 1:
            values = np.unique(np.quantile(v, np.linspace(0, 1, bins - 1), method="nearest"))
            values[-1] = v.max()
        middles = values[:-1] + (values[1:] - values[:-1]) / 2
        return pd.DataFrame({"model": [key[0]], "feature": [key[1]], "borders": [middles]})

    found = cells.groupBy("model", "feature").applyInPandas(cut, "model int, feature int, borders array<double>")
    out: dict[int, list[np.ndarray]] = {}
    for r in found.collect():  # models x features rows of at most `bins` numbers
        have = out.setdefault(r["model"], [])
        have += [np.zeros(0)] * (r["feature"] + 1 - len(have))
        have[r["feature"]] = np.array(r["borders"], np.float64)
    return out


def to_bins(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    out = np.full(x.shape, MISSING, np.uint8)
    for f, cut in enumerate(borders[: x.shape[1]]):
        known = ~np.isnan(x[:, f])
        out[known, f] = np.searchsorted(cut, x[known, f], side="left")
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat, cut = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    count = np.diff(cut)
    out = np.full((len(column), width), np.nan)
    at = np.arange(len(flat)) - np.repeat(cut[:-1] - cut[0], count)
    fits = at < width
    out[np.repeat(np.arange(len(column)), count)[fits], at[fits]] = flat[fits]
    return out


def _blocks(rows: DataFrame, borders: dict[int, list[np.ndarray]], configs: Mapping[int, Booster], width: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(borders)  # models x features x bins numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = batch.column(0).to_numpy(zero_copy_only=False)
            for m in np.unique(model).tolist():
                part = batch.filter(pa.array(model == m))
                bins = to_bins(_matrix(part.column(3), width), shared.value.get(m, []))
                labels, valid = part.column(1).to_numpy(zero_copy_only=False).astype(np.int32), part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                margins = np.zeros((len(bins), configs[m].classes))
                binary = [pa.array([x.tobytes()], pa.binary()) for x in (bins, labels, valid, margins)]
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([len(bins)], pa.int64()), *binary], names=names)

    names = ["model", "n", "bins", "labels", "valid", "margins"]
    stored = rows.select("model", "label", "is_valid", "features").mapInArrow(work, "model int, n long, bins binary, labels binary, valid binary, margins binary")
    return settle(stored.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _restored(blocks: DataFrame, models: dict[int, _Model], width: int) -> DataFrame:
    """The blocks with the margins of all finished rounds."""
    done = {m: (x.cfg, x.since) for m, x in models.items()}
    going = {m for m, x in models.items() if x.request}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in batch.to_pylist() if r["model"] in going]
            for r in rows:
                cfg, since = done[r["model"]]
                bins, _, _, margins = _unpack(r, width, cfg.classes)
                r["margins"] = _margins(margins, bins, since).tobytes()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return settle(blocks.mapInArrow(work, blocks.schema), "blocks")


def fit_boosters(rows: DataFrame, configs: Mapping[int, Booster], width: int) -> dict[int, BoostedTreesModel]:
    """Fits all models of ``configs`` together on ``model, label, features`` and, optionally, ``is_valid`` rows.

    Labels are 0 to ``classes - 1``; rows with a null label or features are left out; null and NaN features are missing values.
    A model without rows says equal probabilities.
    """
    if "is_valid" not in rows.columns:
        rows = rows.withColumn("is_valid", F.lit(False))
    values = F.col("features") if rows.schema["features"].dataType.typeName() == "array" else vector_to_array("features")
    rows = rows.select(F.col("model").cast("int"), F.col("label").cast("int"), F.coalesce("is_valid", F.lit(False)).alias("is_valid"), values.cast("array<double>").alias("features"))
    rows = settle(rows.filter(F.col("label").isNotNull() & F.col("features").isNotNull()), "boosting")
    learn = rows.filter("NOT is_valid")
    borders = bin_borders(learn, max(c.bins for c in configs.values()))
    blocks = _blocks(rows, borders, configs, width)
    models = {m: _Model(cfg, _grow(cfg)) for m, cfg in configs.items()}
    for m, x in models.items():
        x.send(None)
        if m not in borders:
            x.request, x.forest = None, []
    while any(x.request for x in models.values()):
        for m, answer in _ask(blocks, models, width).items():
            models[m].send(answer)
        if max((len(x.since) for x in models.values() if x.request), default=0) >= STORE_EVERY:
            blocks = _restored(blocks, models, width)
            for x in models.values():
                x.since = []
    return {m: BoostedTreesModel.of(x.forest, borders.get(m, []), x.cfg, width) for m, x in models.items()}


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``prediction`` of boosted trees; the trees are a JSON parameter and are saved with it."""

    trees = Param(Params._dummy(), "trees", "cuts as values, children and leaf values of every tree, as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "features column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees: str | None = None, featuresCol: str = "features"):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, forest: list[list[Tree]], borders: list[np.ndarray], cfg: Booster, width: int) -> BoostedTreesModel:
        rounds = []
        for trees in forest:
            rounds.append([])
            for t in trees:
                # A cut after the last bin parts known values from missing ones.
                cut = [float(np.append(borders[f], np.inf)[b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.cut, strict=True)]
                rounds[-1].append(asdict(t) | {"cut": cut, "missing_left": list(map(bool, t.missing_left))})
        return cls(trees=json.dumps({"classes": cfg.classes, "width": width, "rounds": rounds}))

    @property
    def spec(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    @property
    def featureImportances(self) -> list[float]:  # noqa: N802  the name that Spark's tree models give it
        """The share of all split gains that each feature has."""
        spec = self.spec
        gains = np.zeros(spec["width"])
        for t in (t for trees in spec["rounds"] for t in trees):
            for f, g in zip(t["feature"], t["gain"], strict=True):
                if f >= 0:
                    gains[f] += g
        return (gains / gains.sum() if gains.sum() else gains).tolist()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name = self.getOrDefault(self.featuresCol)
        spec = self.spec
        rounds = [[{c: np.array(v) for c, v in t.items()} for t in trees] for trees in spec["rounds"]]
        shared = dataset.sparkSession.sparkContext.broadcast((spec["classes"], spec["width"], rounds))

        @F.pandas_udf("array<double>")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            classes, width, forest = shared.value
            for features in parts:
                x = np.full((len(features), width), np.nan)
                for i, v in enumerate(features):
                    if v is not None:
                        x[i, : len(v)] = v[:width]
                margins = np.zeros((len(x), classes))
                for trees in forest:
                    for k, t in enumerate(trees):
                        margins[:, k] += t["value"][_leaf_by_value(t, x)]
                yield pd.Series(list(_probabilities(margins)))

        values = F.col(name) if dataset.schema[name].dataType.typeName() == "array" else vector_to_array(name)
        scored = dataset.withColumn("probability", score(values.cast("array<double>")))
        # The first of equal probabilities wins.
        best = F.array_position("probability", F.array_max("probability")) - 1
        return scored.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("probability"))


def _leaf_by_value(t: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows := rows[t["feature"][node[rows]] >= 0]):
        at = node[rows]
        v = x[rows, t["feature"][at]]
        node[rows] = np.where(np.where(np.isnan(v), t["missing_left"][at], v <= t["cut"][at]), t["left"][at], t["right"][at])
    return node
