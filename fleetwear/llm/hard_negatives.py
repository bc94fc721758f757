"""Hard negatives by exact integer inner products: matrix products modulo small primes, and Chinese remaindering.

Vector components are whole numbers. For each of several primes both matrices are reduced to residues around zero and multiplied in float32, where
every partial sum stays below 2**24 and so is exact; long vectors are taken in stretches for that. The residues of a score
modulo all primes give back the signed score, digit by digit in the mixed radix of the primes, because the primes' product exceeds
twice the largest score that the data allow.

Rows are packed into blocks in one narrow pass. Every block of anchors meets every block of rows once for the positives and once for the
negatives, whose window depends on the positives found. A meeting returns only the best of its own rows for each anchor, or for each
anchor and positive, and a window keeps the best of these. Packed rows are sent once for each block of anchors, and packed anchors
once for each block of rows: a set of queries against all rows, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.runtime import settle

BLOCK_ROWS = 4096
ANCHOR_ROWS = 2048
_AT_ONCE = 1 << 20  # scores held at a time by a meeting of two blocks
#: Scores beyond this are held at it; no sum or product of the window's test then leaves a long.
MOST = 1 << 56


def primes(most: float, below: int = 512) -> list[int]:
    """The largest primes under ``below`` whose product exceeds twice ``most``; further ones above it if these do not do."""
    is_prime = lambda n: n > 1 and all(n % k for k in range(2, math.isqrt(n) + 1))
    found, product, n = [], 1, below - 1
    while product <= 2 * most and n > 1:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 1
    n = below + 1
    while product <= 2 * most:
        if is_prime(n):
            found.append(n)
            product *= n
        n += 1
    return found


def _around_zero(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole numbers, as the ones nearest to zero."""
    r = np.fmod(x, p)
    half = p // 2
    return np.where(r > half, r - p, np.where(r < -half, r + p, r))


def products(x: np.ndarray, y: np.ndarray, moduli: list[int]) -> np.ndarray:
    """``x @ y.T`` of whole float64 numbers, exact, for moduli whose product exceeds twice the largest result; see ``MOST``."""
    digits = []
    for k, p in enumerate(moduli):
        a, b = _around_zero(x, p).astype(np.float32), _around_zero(y, p).astype(np.float32)
        stretch = max(1, ((1 << 24) - 1) // (p // 2) ** 2)
        r = np.zeros((len(x), len(y)))
        for at in range(0, x.shape[1], stretch):
            r += _around_zero((a[:, at : at + stretch] @ b[:, at : at + stretch].T).astype(np.float64), p)
        # What the earlier digits already say is taken off, and the rest divided by the product of their primes.
        weight = 1
        for q, d in zip(moduli, digits, strict=False):
            r = _around_zero(r - d * (weight % p), p)
            weight = weight * q % p
        digits.append(_around_zero(_around_zero(r, p) * pow(weight, -1, p), p))
    out, size = np.zeros((len(x), len(y)), np.int64), np.zeros((len(x), len(y)))
    with np.errstate(over="ignore"):
        for p, d in zip(reversed(moduli), reversed(digits), strict=True):
            out, size = out * p + d.astype(np.int64), size * p + d
    return np.where(np.abs(size) < MOST, out, np.where(size > 0, MOST, -MOST))


def _best(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``most`` highest allowed scores of each row; of equal ones the first columns."""
    low = np.iinfo(np.int64).min
    held = np.where(allowed, scores, low)
    if held.shape[1] > most:
        least = np.partition(held, held.shape[1] - most, axis=1)[:, held.shape[1] - most]
        rows, columns = np.nonzero((held >= least[:, None]) & allowed)
    else:
        rows, columns = np.nonzero(allowed)
    order = np.lexsort((columns, -held[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < most], columns[place < most]


def _packed(rows: DataFrame, vector: str, narrow: bool, width: int, size: int) -> DataFrame:
    """``n`` and every column as bytes: blocks of ``size`` rows at most. Vectors shorter than ``width`` end in zeros."""
    kinds = {c: np.int64 for c in rows.columns} | {vector: np.int16 if narrow else np.float64}

    def matrix(column: pa.Array, kind: type) -> np.ndarray:
        if not pa.types.is_list(column.type):
            return column.to_numpy(zero_copy_only=False).astype(kind)
        flat, cut = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        count = np.diff(cut)
        columns = width if kind is not np.int64 else int(count[0])
        out = np.zeros((len(column), columns), kind)
        out[np.repeat(np.arange(len(column)), count), np.arange(len(flat)) - np.repeat(cut[:-1] - cut[0], count)] = flat
        return out

    def block(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        whole = {c: np.concatenate([p[c] for p in parts]) for c in kinds}
        n = pa.array([len(whole[vector])], pa.int64())
        return pa.RecordBatch.from_arrays([n, *(pa.array([x.tobytes()], pa.binary()) for x in whole.values())], names=["n", *whole])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = {c: matrix(batch.column(c), kind) for c, kind in kinds.items()}
            at = 0
            while at < batch.num_rows:
                end = min(batch.num_rows, at + size - count)
                held.append({c: x[at:end] for c, x in arrays.items()})
                count, at = count + end - at, end
                if count == size:
                    yield block(held)
                    held, count = [], 0
        if count:
            yield block(held)

    return rows.mapInArrow(work, "n long, " + ", ".join(f"{c} binary" for c in rows.columns))


def _meetings(anchors: DataFrame, rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on every block of anchors with every block of rows; both tables are stored."""
    slots = {}
    for name, table in (("a", anchors), ("r", rows)):
        slots[name] = max(1, table.count())
    place = lambda t, name: t.withColumn(name, F.pmod(F.xxhash64("block"), F.lit(slots[name])))
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots[name] - 1).cast("long"))).alias(name)
    left, right = place(anchors, "a").select("*", every("r")), place(rows, "r").select("*", every("a"))
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(work, schema)


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """The highest scored rows of other labels in a window below each of an anchor's highest scored rows of its label.

    Components are ``floor(scale * x)`` in double precision, a score is the integer inner product. ``anchors`` is a condition on the rows. An
    anchor's positives are its ``positives`` highest rows of its label; to each belong the ``negatives`` highest rows of other labels
    with ``low * positive_score <= 100 * negative_score <= high * positive_score``. Higher scores come first, ties by smaller id.
    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, rank from 1.

    Rows take no part if id, label or vector is null or a component null, not finite, or too large to be scaled. A vector shorter than the
    longest one ends in zeros. Rows of the anchor's own id are never its partners. Rows that repeat an id are rows of their own,
    so one id may be a partner twice; an anchor that repeats id, label and vector counts once. Scores beyond ``MOST`` are held at it.
    An empty table, or one without anchors, gives no rows; other columns are not read.
    """
    whole = lambda v: F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v)  # noqa: E731  larger ones are whole
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: whole(x * scale))
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = clean.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd)
    size = F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    width, largest = clean.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(size), F.lit(0.0))).first()
    moduli = primes(width * int(largest) ** 2)
    narrow = largest < 1 << 15
    kind = np.int16 if narrow else np.float64

    asking = clean.filter("asks").select("id", "label", "vector").distinct().withColumn("key", F.monotonically_increasing_id())
    asking = settle(asking.select("key", "id", "label", "vector"), "anchors")
    stored = lambda t, at_once: settle(_packed(t, "vector", narrow, width, at_once).withColumn("block", F.monotonically_increasing_id()), "blocks")
    blocks = stored(clean.select("id", "label", "vector"), BLOCK_ROWS)

    def unpack(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        for r in table.to_pylist():
            out = {c: np.frombuffer(r[c], np.int64) for c in ("key", "id", "label", "bounds") if c in r}
            yield out | {"vector": np.frombuffer(r["vector"], kind).reshape(r["n"], width).astype(np.float64)}

    def meet(left: pa.Table, right: pa.Table) -> Iterator[tuple[dict, dict, slice, np.ndarray]]:
        """Scores of a few anchors with a block of rows in the order of their ids."""
        others = list(unpack(right))
        for ask in unpack(left):
            for row in others:
                order = np.argsort(row["id"], kind="stable")
                row = {c: x[order] for c, x in row.items()}
                step = max(1, _AT_ONCE // max(1, len(order)))
                for at in range(0, len(ask["key"]), step):
                    part = slice(at, at + step)
                    yield ask, row, part, products(ask["vector"][part], row["vector"], moduli)

    def table(parts: list[tuple], names: list[str]) -> pa.Table:
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(names))]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=names)

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for ask, row, part, scores in meet(left, right):
            allowed = (ask["label"][part][:, None] == row["label"]) & (ask["id"][part][:, None] != row["id"])
            i, j = _best(scores, allowed, positives)
            out.append((ask["key"][part][i], ask["id"][part][i], row["id"][j], scores[i, j]))
        return table(out, ["key", "anchor_id", "positive_id", "positive_score"])

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for ask, row, part, scores in meet(left, right):
            other = (ask["label"][part][:, None] != row["label"]) & (ask["id"][part][:, None] != row["id"])
            bounds = ask["bounds"].reshape(len(ask["key"]), positives)[part]
            for k in range(positives):
                top = bounds[:, k : k + 1]
                allowed = other & (top > -MOST - 1) & (100 * scores <= high * top) & (low * top <= 100 * scores)
                i, j = _best(scores, allowed, negatives)
                out.append((ask["key"][part][i], np.full(len(i), k + 1), row["id"][j], scores[i, j]))
        return table(out, ["key", "place", "negative_id", "negative_score"])

    def first(found: DataFrame, by: list[str], score: str, id_: str, place: str, most: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col(score).desc(), id_)
        return found.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= most)

    met = _meetings(stored(asking, ANCHOR_ROWS), blocks, find_positives, "key long, anchor_id long, positive_id long, positive_score long")
    best = settle(first(met, ["key"], "positive_score", "positive_id", "place", positives), "positives")
    # An anchor with fewer positives has bounds that nothing meets in the places that are left.
    bounds = [F.coalesce(F.max(F.when(F.col("place") == k + 1, F.col("positive_score"))), F.lit(-MOST - 1)) for k in range(positives)]
    bounded = asking.join(best.groupBy("key").agg(F.array(*bounds).alias("bounds")), "key")
    met = _meetings(stored(bounded, ANCHOR_ROWS), blocks, find_negatives, "key long, place long, negative_id long, negative_score long")
    chosen = first(met, ["key", "place"], "negative_score", "negative_id", "rank", negatives)
    return chosen.join(best, ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
