"""A toxicity classifier: a factorization machine over hashed terms.

A text's terms are its words and the beginnings of its words, hashed into ``2**BITS`` buckets; a text has a term or not. The score
adds a weight for each term and, for each pair of terms, the product of their factor vectors, so that a pair may say what
neither term says alone: an insult beside the mention of a group, or a harsh word that a neighbour makes harmless. The pairs
are never written out: their sum is half of the squared sum of the vectors less the sum of their squares.

The fit takes a bounded number of labelled rows (``max_rows``), those with the smallest hashes of their ids. Spark finds their terms
and counts in how many rows of either label each bucket occurs; buckets whose counts could be chance are left out, by a likelihood ratio test
that allows for the number of buckets. What is left of the rows, a few dozen numbers each, is fitted on the driver by full
gradient steps that adapt to each parameter. Scoring is one narrow pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.llm.quality_model import held_out
from fleetwear.llm.words import column_bytes, mix, runs, words_of
from fleetwear.runtime import settle

BITS = 18
STEMS = (4, 5, 6)  # bytes of a longer word's beginning that are terms too
RUN_BYTES = 1 << 19
#: Twice the log likelihood ratio that one of 2**BITS buckets without meaning passes with a chance of about one in ten.
LEAST_RATIO = 25.0

# Letters, digits and all bytes above ASCII make words here; other ASCII bytes part them.
_INK = np.full(256, 32, np.uint8)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _INK[_lo:_hi] = np.arange(_lo, _hi)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of every distinct term of every text, in that order."""
    words = words_of(_INK[data], offsets, lower=True)
    text = np.repeat(np.arange(len(offsets) - 1), words.counts)
    size = words.ends - words.starts
    hashes, of = [words.hashes], [text]
    longest = words.starts[size > STEMS[0]]
    value = np.zeros(len(longest), np.uint64)
    room, owner = size[size > STEMS[0]], text[size > STEMS[0]]
    for k in range(STEMS[-1]):
        value = (value << np.uint64(8)) | words.data[np.minimum(longest + k, max(len(words.data) - 1, 0))].astype(np.uint64)
        if k + 1 in STEMS:
            fits = room > k + 1
            hashes.append(mix(value[fits] + (np.uint64(k + 1) << np.uint64(56))))
            of.append(owner[fits])
    bucket = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.sort(np.concatenate(of) << BITS | bucket)
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    key = key[first]
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    """The buckets that count, with a weight and a factor vector each; at most ``2**BITS`` of them."""

    intercept: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, text: np.ndarray, bucket: np.ndarray, texts: int) -> np.ndarray:
        """The probability for each of ``texts`` texts whose terms are given."""
        if len(self.buckets):
            at = np.searchsorted(self.buckets, bucket).clip(0, len(self.buckets) - 1)
            known = self.buckets[at] == bucket
            text, at = text[known], at[known]
        else:
            text, at = text[:0], bucket[:0]
        return 1 / (1 + np.exp(-np.clip(self.logit(text, at, texts)[0], -30, 30)))

    def logit(self, text: np.ndarray, at: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """The log odds of each text and the sum of its terms' vectors."""
        total = self.intercept + np.bincount(text, weights=self.weights[at], minlength=texts)
        rank = self.factors.shape[1]
        sums = np.empty((texts, rank))
        for r in range(rank):
            v = self.factors[at, r]
            sums[:, r] = np.bincount(text, weights=v, minlength=texts)
            total += (sums[:, r] ** 2 - np.bincount(text, weights=v * v, minlength=texts)) / 2
        return total, sums


def fit(text: np.ndarray, at: np.ndarray, y: np.ndarray, buckets: np.ndarray, rank: int = 4, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Fits to rows whose terms are places in ``buckets``; without rows, or with one class, the model always says the prior."""
    prior = (y.sum() + 1) / (len(y) + 2)
    start = np.random.default_rng(7).standard_normal((len(buckets), rank)) * 0.05
    model = Model(float(np.log(prior / (1 - prior))), buckets, np.zeros(len(buckets)), start)
    if len(y) < 2 or y.min() == y.max() or not len(buckets):
        model.factors[:] = 0
        return model
    n, seen = len(y), [1e-4, np.full(len(buckets), 1e-4), np.full(start.shape, 1e-4)]
    for _ in range(steps):
        z, sums = model.logit(text, at, n)
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        of = off[text]
        whole = np.bincount(at, weights=of, minlength=len(buckets))
        grad = whole + decay / 10 * model.weights
        pull = np.stack([np.bincount(at, weights=of * sums[text, r], minlength=len(buckets)) for r in range(rank)], 1)
        pull += decay * model.factors - model.factors * whole[:, None]
        for k, g in enumerate((off.sum(), grad, pull)):
            seen[k] += g * g
        model.intercept -= rate * off.sum() / np.sqrt(seen[0])
        model.weights -= rate * grad / np.sqrt(seen[1])
        model.factors -= rate * pull / np.sqrt(seen[2])
    return model


def _lists(values: np.ndarray, text: np.ndarray, texts: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(texts + 1)), pa.int32()), pa.array(values, pa.int32()))


def _labelled(documents: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``h, y, terms`` of at most ``max_rows`` rows."""
    seen = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).alias("y"))
    chosen = seen.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    rows = documents.select(id_col, text_col).filter(F.col(text_col).isNotNull()).join(F.broadcast(chosen), id_col)  # at most max_rows rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for a, b in runs(offsets, RUN_BYTES):
                text, bucket = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = [batch.column(2).slice(a, b - a), batch.column(1).slice(a, b - a), _lists(bucket, text, b - a)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "y", "terms"])

    hashed = F.xxhash64(id_col, text_col).alias("h")
    found = settle(rows.select(text_col, F.col("y").cast("int"), hashed).mapInArrow(work, "h long, y int, terms array<int>"), "terms")
    # One id may have many texts; those with the smallest hashes stay, each once.
    last = found.select("h").distinct().orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    return found.filter(F.col("h") <= F.lit(last)).dropDuplicates(["h"])


def _counted(rows: DataFrame) -> DataFrame:
    """``bucket, toxic, every``: rows with a term in the bucket, those with label 1 and all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, every = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            lists = batch.column(1)
            bucket, y = lists.flatten().to_numpy(), batch.column(0).to_numpy()
            of = np.repeat(y, np.diff(lists.offsets.to_numpy()))
            every += np.bincount(bucket, minlength=1 << BITS)
            toxic += np.bincount(bucket[of == 1], minlength=1 << BITS)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(toxic[at]), pa.array(every[at])], names=["bucket", "toxic", "every"])

    counts = rows.select("y", "terms").mapInArrow(work, "bucket int, toxic long, every long")
    return counts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("every").alias("every"))


def train(
    documents: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options
) -> Model:
    """Fits on at most ``max_rows`` labelled rows outside the held-out fold, those with the smallest hashes of their ids.

    Repeated labels of one id count once, the largest; labels other than 0 and 1, and rows without text, are left out; a row that
    repeats id and text counts once. Without labelled rows the model says one half. ``options`` are those of ``fit``.
    """
    rows = settle(_labelled(documents, labels, max_rows, id_col, text_col, label_col), "labelled")
    n, positive = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    none = np.zeros(0, np.int64)
    if not n or not 0 < positive < n:
        return fit(none, none, np.full(n, 1.0 if positive else 0.0), none, **options)
    part = lambda seen, of, of_all: F.when(seen > 0, seen * F.log(seen * n / (of * of_all))).otherwise(0.0)
    a, t = F.col("toxic").cast("double"), F.col("every").cast("double")
    other, out = t - a, n - t
    ratio = part(a, t, positive) + part(other, t, n - positive) + part(positive - a, out, positive) + part(out - positive + a, out, n - positive)
    buckets = np.array(sorted(r[0] for r in _counted(rows).filter(2 * ratio > LEAST_RATIO).select("bucket").collect()), np.int64)  # at most 2**BITS
    shared = documents.sparkSession.sparkContext.broadcast(buckets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.full(1 << BITS, -1, np.int64)
        known[shared.value] = np.arange(len(shared.value))
        for batch in batches:
            lists = batch.column(2)
            place = known[lists.flatten().to_numpy()]
            text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[place >= 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(place[place >= 0], text, len(lists))], names=["h", "y", "terms"])

    got = rows.select("h", "y", "terms").mapInArrow(work, "h long, y int, terms array<int>").orderBy("h").toArrow().combine_chunks()  # at most max_rows rows
    lists = got.column("terms").combine_chunks()
    text = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    return fit(text, lists.flatten().to_numpy().astype(np.int64), got.column("y").to_numpy().astype(np.float64), buckets, **options)


def classify(documents: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row; a null or empty text has no terms and gets the intercept's score.

    One row for each row of the input, repeated ids included; an empty table gives no rows; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS buckets
    kind = dict(documents.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            scores = [np.zeros(0)]
            for a, b in runs(offsets, RUN_BYTES):
                scores.append(shared.value.score(*terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a))
            score = np.concatenate(scores)
            columns = [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "held_out", "score", "predicted"])

    rows = documents.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col))
    return rows.mapInArrow(work, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
