"""A quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees.

Features are plain measures of a text, taken in array passes. Each is cut into bins at quantiles of the training rows.
Boosting goes round the features in turn: a shallow tree on one feature's bins alone is fitted to the current residuals and
a small step of it is added to that feature's lookup table. Pairs of features are then ranked by how much of the residual a
coarse grid over both explains, and the best ones get a table each in the same way. A score is the intercept, one table
entry a feature and one a pair, through the logistic function, so scoring is a handful of vectorised look-ups.

The fit needs a bounded number of rows (``max_rows``): of the labelled rows those with the smallest hash of their id. Features are
computed only for these when fitting, and for every row when scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.llm.words import column_bytes, gram_docs, gram_hashes, runs, words_of

FEATURES = [
    "log_words",
    "word_length",
    "word_length_spread",
    "small_share",
    "capital_share",
    "digit_share",
    "mark_share",
    "symbol_share",
    "high_share",
    "line_words",
    "distinct_words",
    "top_word",
    "repeat_share",
    "adjacent_same",
    "marked_words",
    "bare_marks",
    "capital_words",
    "common_words",
    "stop_share",
]

_KIND = np.full(256, 3, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[32, 9, 10, 11, 12, 13]] = 5
_KIND[[ord(c) for c in "#*$%&|<>"]] = 4
_KIND[128:] = 6


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; an empty text has zeros."""
    offsets = offsets - offsets[0]
    n = len(offsets) - 1
    words = words_of(data, offsets)
    counts = words.counts
    doc = np.repeat(np.arange(n), counts)
    per = np.maximum(counts, 1)
    size = (words.ends - words.starts).astype(np.float64)
    kind = _KIND[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(owner * 7 + kind, minlength=7 * n).reshape(n, 7)
    inked = np.maximum(kinds.sum(1) - kinds[:, 5], 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=flag, minlength=n) / per

    mean = np.bincount(doc, weights=size, minlength=n) / per
    spread = np.sqrt(np.maximum(np.bincount(doc, weights=size * size, minlength=n) / per - mean**2, 0))
    lines = np.bincount(owner, weights=data == 10, minlength=n) + 1
    order = np.lexsort((words.hashes, doc))
    h, d = words.hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[at], times)
    distinct = np.bincount(d[at], minlength=n) / per
    frequent = np.bincount(d[at], weights=np.where(times > 2, times, 0), minlength=n) / per
    places, of = gram_docs(words.first, 3)
    grams = gram_hashes(words.hashes, 3)[places]
    o = np.lexsort((grams, of))
    same = (grams[o][1:] == grams[o][:-1]) & (of[o][1:] == of[o][:-1])
    repeats = np.bincount(of[o][1:], weights=same, minlength=n) / per
    adjacent = np.zeros(len(doc), bool)
    adjacent[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
    first, last = kind[words.starts], kind[words.ends - 1]
    padded = np.append(kind, 5)
    two = (last >= 3) & (padded[np.maximum(words.ends - 2, 0)] >= 3) & (padded[np.maximum(words.ends - 2, 0)] <= 4) & (size > 2) & (last <= 4)
    bare = (size <= 2) & (first >= 3) & (first <= 4) & (last >= 3) & (last <= 4)
    cap = (first == 1) & (padded[np.minimum(words.starts + 1, len(kind) - 1 if len(kind) else 0)] == 1) & (size > 1)
    ended = np.bincount(owner, weights=(data == 46) | (data == 63), minlength=n) / per
    columns = [
        np.log1p(counts),
        mean,
        spread,
        kinds[:, 0] / inked,
        kinds[:, 1] / inked,
        kinds[:, 2] / inked,
        kinds[:, 3] / inked,
        kinds[:, 4] / inked,
        kinds[:, 6] / inked,
        np.minimum(counts / lines, 500.0),
        distinct,
        top / per,
        repeats,
        share(adjacent),
        share(two),
        share(bare),
        share(cap),
        frequent,
        ended,
    ]
    return np.where(counts[:, None] > 0, np.stack(columns, 1), 0.0)


@dataclass
class Model:
    """Cuts and tables; small enough to travel with a task (features x bins numbers)."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]
    coarse: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[b[:, k]]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[_coarse(b[:, i], len(self.cuts[i]), self.coarse), _coarse(b[:, j], len(self.cuts[j]), self.coarse)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _coarse(b: np.ndarray, cuts: int, parts: int) -> np.ndarray:
    return b * parts // (cuts + 1) if cuts + 1 > parts else b


def _shallow(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A tree on ordered bins: at most ``leaves`` runs of bins, each split the one that gains most; a value for each bin."""
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    runs_ = [(0, len(gradient))]

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)

    while len(runs_) < leaves:
        best = (1e-9, None)
        for r, (a, b) in enumerate(runs_):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = np.where((w[m] - w[a] >= least) & (w[b] - w[m] >= least), worth(a, m) + worth(m, b) - worth(a, b), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (r, a, int(m[k]), b))
        if best[1] is None:
            break
        r, a, m, b = best[1]
        runs_[r : r + 1] = [(a, m), (m, b)]
    out = np.zeros(len(gradient))
    for a, b in runs_:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, rate: float = 0.1, leaves: int = 3, pairs: int = 8, coarse: int = 8) -> Model:
    """Fits the model to rows ``x`` and labels ``y`` of 0 and 1; without rows, or with one class, it always says the prior."""
    width = x.shape[1]
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(prior / (1 - prior))), [], [], [], [], coarse)
    for k in range(width):
        cut = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)
        model.cuts.append(cut)
        model.tables.append(np.zeros(len(cut) + 1))
    if len(x) < 2 or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(x), model.intercept)

    def step(flat: np.ndarray, size: int, tree: bool) -> np.ndarray:
        p = 1 / (1 + np.exp(-total))
        grad = np.bincount(flat, weights=y - p, minlength=size)
        hess = np.bincount(flat, weights=p * (1 - p), minlength=size)
        return rate * (_shallow(grad, hess, leaves, 1.0) if tree else grad / (hess + 5.0))

    for _ in range(rounds):
        for k in range(width):
            move = step(b[:, k], len(model.tables[k]), True)
            model.tables[k] += move
            total += move[b[:, k]]
    c = np.stack([_coarse(b[:, k], len(model.cuts[k]), coarse) for k in range(width)], 1)
    residual = y - 1 / (1 + np.exp(-total))
    gains = []
    for i in range(width):
        for j in range(i + 1, width):
            flat = c[:, i] * coarse + c[:, j]
            g = np.bincount(flat, weights=residual, minlength=coarse * coarse)
            n = np.bincount(flat, minlength=coarse * coarse)
            gains.append((float((g * g / (n + 5.0)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:pairs]:
        model.pairs.append((i, j))
        model.grids.append(np.zeros((coarse, coarse)))
    for _ in range(rounds // 3):
        for (i, j), grid in zip(model.pairs, model.grids, strict=True):
            flat = c[:, i] * coarse + c[:, j]
            move = step(flat, coarse * coarse, False)
            grid += move.reshape(coarse, coarse)
            total += move[flat]
    return model


def held_out(id_: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold that is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most ``max_rows`` labelled rows outside the held-out fold, those with the smallest hashes of their ids.

    Repeated labels of one id count once, the largest; labels other than 0 and 1, and rows without text, are left out.
    """
    seen = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).alias("y"))
    chosen = seen.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    rows = documents.select(F.col(id_col), F.col(text_col)).filter(F.col(text_col).isNotNull()).join(F.broadcast(chosen), id_col)  # at most max_rows rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for a, b in runs(offsets):
                x = features(data[offsets[a] : offsets[b]], offsets[a : b + 1])
                inner = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([inner, batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], names=["x", "y", "h"])

    found = rows.select(text_col, F.col("y").cast("int"), F.xxhash64(id_col, text_col).alias("h")).mapInArrow(work, "x array<double>, y int, h long")
    # At most max_rows rows, unless ids repeat; the hash makes their order the same on every run.
    got = found.orderBy("h").limit(max_rows).toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(got["x"].to_list()), got["y"].to_numpy(np.float64))


def classify(documents: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row; a null text is scored as an empty one, whose features are all zero.

    One row for each row of the input, repeated ids included; an empty table gives no rows; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            scores = [np.zeros(0)]
            for a, b in runs(offsets):
                scores.append(shared.value.score(features(data[offsets[a] : offsets[b]], offsets[a : b + 1])))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=names
            )

    names = [id_col, "held_out", "score", "predicted"]
    rows = documents.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col))
    return rows.mapInArrow(work, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns, in one narrow pass."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(at))
            for a, b in runs(offsets):
                score = shared.value.score(features(data[offsets[a] : offsets[b]], offsets[a : b + 1]))
                yield batch.slice(a, b - a).filter(pa.array(score >= threshold))

    return documents.mapInArrow(work, documents.schema)
