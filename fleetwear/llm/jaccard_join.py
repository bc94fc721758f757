"""Jaccard self-join of word shingle sets with adaptive multi-match prefixes, and the components of its links.

1. Every text becomes the set of its shingle hashes. Equal sets are one class, known by a hash of the set.
2. A frequency sketch of fixed size, counted over all texts, gives one order of all shingles: rare ones first, by hash within
   a frequency step. Only the amount of work depends on the sketch.
3. Two sets of ``a`` and ``b`` shingles that are similar enough share ``o = ceil(t * (a + b) / (100 + t))``. So among the first
   ``a - o + m`` of one and the first ``b - o + m`` of the other, in that order, they share at least ``m``. Each class
   weighs, for every ``m`` it may use, the posting entries that its prefix would meet against the candidates these can
   yield at most (entries / m), takes the cheapest ``m``, and asks for ``m`` common shingles before a pair is verified.
4. A shared shingle counts only if the two places of it leave room for enough common shingles before and after. Large groups of near copies do not meet pair by pair: a class that shares half its prefix with one other, its star, is verified
   against that one alone, and the join looks for partners outside the star. A class of a star is from then on its difference to
   the star's set, the shingles that one of the two has alone. What two classes differ by is what their differences differ by, so they are
   similar just when their differences share a number of shingles that grows with the sizes of both (``_needed_apart``); it is 0
   only for two that are similar to the star. Classes that verification leaves in different components take turns: each is
   verified against the few classes of other components that it most likely shares enough with, as long as that joins any. A
   second join, on the differences, covers what is still apart: classes that cannot share enough with any other go before it.
5. Verification counts the intersection of the whole sets, which are made only for classes that are in some pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.llm.components import components
from fleetwear.llm.words import column_bytes, gram_hashes, mix, runs, words_of
from fleetwear.runtime import settle

SKETCH_BITS = 22
MAX_MATCHES = 6
MAX_TURNS = 8  # rounds of tests inside stars; the join after them finds what they have not
TESTS = 3  # classes that a class is verified against in a round
PRUNINGS = 3  # rounds that leave out what cannot be similar before the last join
CHUNK = 1 << 20  # bytes of text worked on at once
_PART = 1 << 14


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, words lower-cased A-Z; a shorter text is one shingle, no words none."""
    words = words_of(data, offsets, lower=True)
    grams = gram_hashes(words.hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            one = np.sort(grams[a : b - size + 1])
            keep = np.empty(len(one), bool)
            keep[0] = True
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            out.append(one[keep])
        elif b > a:
            out.append(gram_hashes(words.hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> int:
    """A hash of a set: sums of two mixings of its members."""
    with np.errstate(over="ignore"):
        total = mix(shingles).sum(dtype=np.uint64) + mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) * np.uint64(3)
        return int(mix(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def _sets_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = column_bytes(batch.column(batch.num_columns - 1))
    for a, b in runs(offsets, CHUNK):
        yield a, shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1], size)


def _classes(documents: DataFrame, size: int) -> DataFrame:
    """``id, text_hash, n_shingles, key`` of every row."""
    kind = dict(documents.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys = [], []
            for _, sets in _sets_of(batch, size):
                n += map(len, sets)
                keys += map(set_key, sets)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "n_shingles", "key"])

    rows = documents.select("id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(work, f"id {kind}, text_hash long, n_shingles long, key long")


def _sketch(documents: DataFrame, size: int, text_col: str) -> np.ndarray:
    """Counts of all shingles in ``2**SKETCH_BITS`` counters. Its size never depends on the data."""
    total, mask = 1 << SKETCH_BITS, np.uint64((1 << SKETCH_BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total, np.uint32)
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for a, b in runs(offsets, CHUNK):
                words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1], lower=True)
                grams = gram_hashes(words.hashes, size)
                np.add.at(sums, (grams & mask).astype(np.int64), np.uint32(1))
        parts = [zlib.compress(sums[k : k + _PART].tobytes(), 1) for k in range(0, total, _PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(key: tuple[int], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(_PART, np.uint64)
        for frame in frames:
            for raw in frame["counts"]:
                sums += np.frombuffer(zlib.decompress(raw), np.uint32)
        yield pd.DataFrame({"part": [key[0]], "counts": [zlib.compress(sums.tobytes(), 1)]})

    schema = "part int, counts binary"
    rows = documents.select(text_col).mapInArrow(count, schema).groupBy("part").applyInPandas(add, schema).collect()
    out = np.zeros(total, np.uint64)
    for part, raw in rows:
        out[part * _PART : (part + 1) * _PART] = np.frombuffer(zlib.decompress(raw), np.uint64)
    return out


def _steps(sketch: np.ndarray) -> np.ndarray:
    """The frequency step of each counter: in quarters of the spread above the median, then eight for each doubling."""
    usual = np.median(sketch)
    steps = np.empty(len(sketch), np.uint8)
    for start in range(0, len(sketch), _PART):  # the driver holds one table, not one for each operation
        above = (sketch[start : start + _PART] - usual) / (np.sqrt(usual) + 1)
        fine, coarse = 1 + np.floor(4 * above), 65 + np.floor(8 * np.log2(np.maximum(above, 16) / 16))
        steps[start : start + _PART] = np.where(above <= 0, 0, np.where(above < 16, fine, coarse)).clip(0, 255)
    return steps


def probe_base(n, t: int):
    """Prefix length less the matches asked for, for a partner of any size; works on numbers and on columns."""
    return n - _ceil(t * n, 100)


def index_base(n, t: int):
    """The same for a partner that is no smaller."""
    return n - _ceil(2 * t * n, 100 + t)


def needed(a: Column, b: Column, t: int) -> Column:
    """The least common shingles of two similar sets of ``a`` and ``b``."""
    return _ceil(t * (a + b), 100 + t)


def _ceil(x, d: int):
    if isinstance(x, Column):
        return F.floor((x + (d - 1)) / d).cast("long")
    return -(-x // d)


def _prefixes(documents: DataFrame, size: int, t: int, steps: np.ndarray, text_col: str) -> DataFrame:
    """``token, key, n, at``: the first shingles of every set in the common order, copies within a task once."""
    shared = documents.sparkSession.sparkContext.broadcast(steps)  # 2**SKETCH_BITS bytes
    mask = np.uint64((1 << SKETCH_BITS) - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, int, int]] = []
            for _, sets in _sets_of(batch, size):
                for one in sets:
                    if not len(one):
                        continue
                    key = set_key(one)
                    if key in seen:
                        continue
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(key)
                    take = min(len(one), probe_base(len(one), t) + MAX_MATCHES)
                    step = table[(one & mask).astype(np.int64)]
                    out.append((one[np.argsort(step, kind="stable")[:take]], key, len(one)))
            if out:
                sizes = np.fromiter((len(x[0]) for x in out), np.int64, len(out))
                at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([x[0] for x in out]).view(np.int64)),
                        pa.array(np.repeat(np.array([x[1] for x in out], np.int64), sizes)),
                        pa.array(np.repeat(np.array([x[2] for x in out], np.int32), sizes)),
                        pa.array(at.astype(np.int32)),
                    ],
                    names=["token", "key", "n", "at"],
                )

    return documents.select(text_col).mapInArrow(work, "token long, key long, n int, at int")


def _packed_sets(documents: DataFrame, size: int, text_col: str) -> DataFrame:
    """``key, shingles binary`` of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets_of(batch, size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    names=["key", "shingles"],
                )

    return documents.select(text_col).mapInArrow(work, "key long, shingles binary")


def _verify(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Those of the pairs (``a``, ``b``) whose whole sets are similar enough."""
    one = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= t * (len(p) + len(q) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _tag(live: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    """Adds the tag of each row's class; a class without one is its own."""
    return live.join(tags.select("key", name), "key", "left").withColumn(name, F.coalesce(name, "key"))


def _candidates(rows: DataFrame, t: int, apart: str) -> DataFrame:
    """``a, b``: pairs with enough shared prefix shingles, from different ``apart``."""
    # A shingle whose holders are all on one side has nothing left to find.
    held = rows.groupBy("token").agg(
        F.min(apart).alias("lo"),
        F.max(apart).alias("hi"),
        F.count_if(F.col("at") < index_base(F.col("n").cast("long"), t) + MAX_MATCHES).alias("entries"),
    )
    rows = settle(rows.join(held.filter("lo != hi").select("token", "entries"), "token"), "open")
    n = F.col("n").cast("long")
    allowed = F.least(F.lit(MAX_MATCHES), _ceil(t * n, 100))
    met_by = [F.sum(F.when(F.col("at") < probe_base(n, t) + m, F.col("entries")).otherwise(0)) for m in range(1, MAX_MATCHES + 1)]
    costs = rows.groupBy("key", "n").agg(*(c.alias(f"e{m}") for m, c in enumerate(met_by, 1)))
    # A posting entry costs 1, reading two sets to verify a candidate about a tenth of their size.
    priced = [F.struct((F.col(f"e{m}") * (1 + n / (10.0 * m))).alias("cost"), F.lit(m).alias("m")) for m in range(1, MAX_MATCHES + 1)]
    chosen = costs.select("key", F.array_min(F.filter(F.array(*priced), lambda x: x["m"] <= allowed))["m"].alias("m"))
    probe = rows.join(chosen, "key").filter(F.col("at") < probe_base(n, t) + F.col("m"))
    of = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("n", "at", "met")]
    probe = probe.select("token", F.col("key").alias("a"), *of("a"), F.col(apart).alias("c_a"), "m")
    index = rows.filter(F.col("at") < index_base(n, t) + MAX_MATCHES).select(
        "token",
        F.col("key").alias("b"),
        *of("b"),
        F.col(apart).alias("c_b"),
        (F.col("at") - index_base(n, t) + 1).alias("level"),
    )
    smaller = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    n_a, n_b = F.col("n_a").cast("long"), F.col("n_b").cast("long")
    # What two sets share lies before this shingle, where only those met can be shared, at it, or after it.
    room = F.least("met_a", "met_b") + F.least(n_a - F.col("at_a"), n_b - F.col("at_b"))
    near = (100 * n_b >= t * n_a) & (room >= needed(n_a, n_b, t))
    pairs = (
        probe.join(index, "token")
        .filter(smaller & near & (F.col("c_a") != F.col("c_b")) & (F.col("level") <= F.col("m")))
        .groupBy("a", "b", "m")
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter(F.col("shared") >= F.col("m"))
        .select("a", "b")
    )
    return settle(pairs, "candidates")


def links(documents: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: pairs of classes with similar sets, enough of them that all components are right.

    A pair that is missing joins two classes of one component.
    """
    t = percent
    steps = _steps(_sketch(documents, size, "text"))
    prefix = _prefixes(documents, size, t, steps, "text")
    shared = prefix.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo != hi")
    live = prefix.join(shared.select("token"), "token").distinct()
    # met: how many shingles before it in its own prefix occur in any other prefix.
    order = Window.partitionBy("key").orderBy("at", "token")
    live = settle(live.withColumn("met", F.row_number().over(order) - 1), "live")
    # Each class first meets one other: the one that at least half of its own prefix points to. A shingle points to the holder with
    # fewest shingles of its own, which in a group of near copies is the one nearest to their common origin.
    # A star has at most twice the shingles of its classes, so their differences to it are in proportion to them.
    pivots = live.groupBy("token").agg(F.min_by(F.struct("key", "n"), F.struct(F.col("at") - F.col("met"), "key")).alias("p"))
    pointed = live.join(pivots, "token").filter("key != p.key and p.n <= 2 * n")
    counted = pointed.groupBy("key", "n", F.col("p.key").alias("pivot")).agg(F.count(F.lit(1)).alias("c"))
    likely = counted.filter(F.col("c") * 2 >= probe_base(F.col("n").cast("long"), t))
    stars = settle(likely.groupBy("key").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("star")), "stars")
    rows = settle(_tag(live, stars, "star"), "tagged")
    first = stars.select(F.col("key").alias("a"), F.col("star").alias("b"))
    pairs = settle(first.union(_candidates(rows, t, "star")), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = classes.join(needed, "key").groupBy("key").agg(F.min(F.struct("id", "text_hash")).alias("one")).select("one.*")
    held = (
        documents.withColumn("text_hash", F.xxhash64("text"))
        .alias("d")
        .join(wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.text_hash") == F.col("w.text_hash")), "left_semi")
        .dropDuplicates(["id", "text_hash"])
    )
    sets = settle(_packed_sets(held, size, "text"), "sets")
    found = settle(_verify(pairs, sets, t), "links")
    # Classes of one star that are still apart have not met each other yet.
    parted = settle(components(found, "a", "b"), "groups").select(F.col("node").alias("key"), "component")
    apart = settle(_differences(_apart(stars, parted), sets, t), "differences")
    for turn in range(MAX_TURNS):
        met = settle(_verify(_partners(_tag(apart, parted, "component"), turn, t), sets, t), "links")
        if met.isEmpty():
            break
        found = found.union(met)
        parted = settle(_merged(parted, met), "groups")
    rest = _overlaps(_tag(apart, parted, "component"), t)
    return found.union(settle(_verify(rest, sets, t), "links"))


def _apart(stars: DataFrame, parted: DataFrame) -> DataFrame:
    """The rows of stars whose classes lie in several components."""
    rows = _tag(stars, parted, "component")
    centre = parted.select(F.col("key").alias("star"), F.col("component").alias("main"))
    open_ = rows.join(centre, "star", "left").filter(F.col("main").isNull() | (F.col("main") != F.col("component")))
    return stars.join(open_.select("star").distinct(), "star")


def _differences(stars: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """``key, star, token, far``: the shingles that a class and its star do not share, and how far these put it from others."""
    one = sets.select("key", F.col("shingles").alias("x"))
    two = sets.select(F.col("key").alias("star"), F.col("shingles").alias("y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, star, x, y in zip(*batch.columns, strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                alone = np.setxor1d(p, q, assume_unique=True).view(np.int64)
                far = (100 + t) * len(alone) - (100 - t) * len(p)
                same = [pa.array(np.full(len(alone), v, np.int64)) for v in (key.as_py(), star.as_py(), far)]
                yield pa.RecordBatch.from_arrays([*same[:2], pa.array(alone), same[2]], names=["key", "star", "token", "far"])

    joined = stars.select("key", "star").join(one, "key").join(two, "star").select("key", "star", "x", "y")
    return joined.mapInArrow(work, "key long, star long, token long, far long")


def _needed_apart(a: Column, b: Column, t: int) -> Column:
    """How many shingles the differences of two classes, ``far`` as ``a`` and ``b`` say, share at least if the two are similar.

    Sets of ``n`` and ``m`` shingles are similar when ``(100 + t) * |x ^ y| <= (100 - t) * (n + m)``, and ``|x ^ y|`` is ``|dx| + |dy| - 2 * |dx & dy|``.
    """
    return _ceil(a + b, 2 * (100 + t))


def _nearest_apart(rows: DataFrame, by: list[Column]) -> DataFrame:
    """Adds ``other``, of the holders of the same shingle in another component the first in the order ``by``; rows without one go."""
    side, held = ["star", "token"], F.struct("key", "component", "far")
    one = rows.groupBy(*side).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(held, F.struct(*by)).alias("one"))
    rows = settle(rows.join(one.filter("lo != hi").select(*side, "one"), side), "open")
    two = rows.filter("component != one.component").groupBy(*side).agg(F.min_by(held, F.struct(*by)).alias("two"))
    other = F.when(F.col("component") != F.col("one.component"), F.col("one")).otherwise(F.col("two"))
    return rows.join(two, side).withColumn("other", other).drop("one", "two")


def _partners(rows: DataFrame, turn: int, t: int) -> DataFrame:
    """``a, b``: for every class of a star the few classes of other components that are most likely similar to it.

    A shingle of its difference points to the holder in another component that lies least far from the star; ``turn`` decides
    ties. A class meets the ``TESTS`` of these with most in common over what similarity needs. Rows and tests grow with the
    classes, whatever the size of a star.
    """
    pointed = _nearest_apart(rows, [F.col("far"), F.xxhash64("key", F.lit(turn)), F.col("key")])
    near = F.count(F.lit(1)) - _needed_apart(F.first("far"), F.first("other.far"), t)
    pairs = pointed.groupBy(F.col("key").alias("a"), F.col("other.key").alias("b")).agg(near.alias("near"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("near"), "b"))
    return settle(pairs.withColumn("place", place).filter(F.col("place") <= TESTS).select("a", "b"), "partners")


def _overlaps(rows: DataFrame, t: int) -> DataFrame:
    """``a, b``: the pairs of one star and different components whose differences can share as many shingles as similarity needs.

    A shingle is no use to a class that, even with the nearest other holder, needs more in common than the class has left; what goes
    leaves less to others, so this is asked ``PRUNINGS`` times. Then the usual prefixes: of ``c`` shingles, rare ones first, of which at
    least ``q`` must be shared, the first ``c - q + 1`` hold one that is.
    """
    whole = Window.partitionBy("key")
    for _ in range(PRUNINGS):
        least = F.greatest(_needed_apart(F.col("far"), F.col("other.far"), t), F.lit(1))
        rows = _nearest_apart(rows, [F.col("far"), F.col("key")]).withColumn("least", least).withColumn("held", F.count(F.lit(1)).over(whole))
        rows = settle(rows.filter("least <= held").select("key", "star", "token", "far", "component", "least"), "near")
    side = ["star", "token"]
    rows = rows.join(rows.groupBy(*side).agg(F.count(F.lit(1)).alias("holders")), side)
    rows = rows.withColumn("at", F.row_number().over(whole.orderBy("holders", "token")))
    rows = rows.withColumn("held", F.count(F.lit(1)).over(whole)).withColumn("least", F.min("least").over(whole))
    rows = settle(rows.filter("at <= held - least + 1").select(*side, "key", "far", "component", "at", "held"), "prefixes")
    of = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("far", "component", "at", "held")]
    one, two = (rows.select(*side, F.col("key").alias(x), *of(x)) for x in ("a", "b"))
    room = F.least("at_a", "at_b") + F.least(F.col("held_a") - F.col("at_a"), F.col("held_b") - F.col("at_b"))
    near = room >= _needed_apart(F.col("far_a"), F.col("far_b"), t)
    pairs = one.join(two, side).filter((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & near)
    return settle(pairs.select("a", "b").distinct(), "candidates")


def _merged(parted: DataFrame, met: DataFrame) -> DataFrame:
    """``key, component`` after further links, which are followed between components only."""
    of = lambda x: parted.select(F.col("key").alias(x), F.col("component").alias(f"{x}_in"))
    ends = met.join(of("a"), "a", "left").join(of("b"), "b", "left")
    own = [F.coalesce(f"{x}_in", x).alias(f"{x}_in") for x in ("a", "b")]
    grown = settle(components(ends.select(*own), "a_in", "b_in"), "groups").select("node", F.col("component").alias("now"))
    every = parted.union(met.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(parted, "key", "left_anti").select("key", F.col("key").alias("component")))
    return every.join(grown, F.col("component") == F.col("node"), "left").select("key", F.coalesce("now", "component").alias("component"))


def near_duplicates(
    documents: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document with the component of documents that it reaches by links of at least ``percent`` similarity.

    Returns ``id_col, n_shingles, component_id, class_key, text_hash``: the set's size, the smallest id reachable by links, itself included,
    the class of equal sets, and Spark's xxhash64 of the text. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than ``size`` words has its whole
    sequence as its only shingle; one without words, or null, has none and is linked with nothing. One row for each row of
    the input; rows that repeat an id count as one document's where their texts are equal. A null id never is a
    component's smallest unless all are. An empty table gives no rows; other columns are not read.
    """
    base = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    classes = settle(_classes(base, size), "classes")
    found = settle(components(links(base, classes, size, percent), "a", "b"), "components")
    full = classes.filter("n_shingles > 0").groupBy("key").agg(F.min("id").alias("least"))
    placed = full.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = settle(placed.join(smallest, "component").select("key", "component_id"), "smallest")
    out = classes.join(by_key, "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.col("key").alias("class_key"),
        "text_hash",
    )
