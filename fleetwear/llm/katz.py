"""A Katz backoff bigram model: Good-Turing discounted counts with exactly normalised backoff weights.

Texts are packed into blocks. Blocks and table partitions exchange packed lists rather than rows, so a count moves in a few bytes:

1. *Words.* Each block sends its distinct words, with their training counts, to partitions by hash. A partition adds them up, numbers
   its words from the most frequent one down, and answers every block with the numbers of its words.
2. *Pairs.* Each block sends its distinct pairs (word before, word) with training counts to partitions by the word before; words
   that come before very often are dealt out over all partitions. A partition adds up, and answers with each pair's count and, for each
   word before, what its backoff weight needs: its count, how many pairs were seen once, twice, ... five times, and the sum
   of the lower-order probabilities of its seen followers.
3. *Scores.* With the counts of counts of all partitions the discounts are known; each block evaluates its tokens: the discounted pair
   where it was seen, else the weight of the word before times the probability of the word alone, where unknown words are one type.

The model is exactly normalised: for every word before, the probabilities of all known words, the end and the unknown type sum to 1.
To the driver go counts of counts, the (bounded) often words, and for each word partition the numbers at which the count changes: at most the
square root of twice its tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.llm.words import column_bytes, mix, runs, words_of
from fleetwear.runtime import settle

BLOCK_BYTES = 6 << 20
PART_BYTES = 16 << 20
MAX_COUNT = 5  # counts up to this are discounted
BEFORE_FIRST, UNKNOWN, FIRST_WORD = 0, 1, 2  # numbers that are no word's
END = np.uint64(0x5851F42D4C957F2D)
OFTEN = 16


def pack(values: np.ndarray) -> bytes:
    """Integers as one byte plane after another, so that small and slowly changing ones compress well."""
    planes = np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def rises(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values[:1] * 0)


def discounts(counts: list[int]) -> np.ndarray:
    """Good-Turing discount factors for counts 1 to 5 from the numbers of types seen 1 to 6 times; 1 beyond.

    Where the estimate leaves (0, 1), as it can on few data, half a count is taken off instead.
    """
    n = [0, *counts]
    out = np.ones(MAX_COUNT + 1)
    common = (MAX_COUNT + 1) * n[MAX_COUNT + 1] / n[1] if n[1] else 1.0
    for r in range(1, MAX_COUNT + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


def held_out(id_: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _pack_blocks(documents: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """``block, ids, held, sizes, texts, bytes``."""
    kind = dict(documents.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        press = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for a, b in runs(offsets, limit):
                whole = pa.array([0, b - a], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.ListArray.from_arrays(whole, batch.column(0).slice(a, b - a)),
                        pa.ListArray.from_arrays(whole, batch.column(1).slice(a, b - a)),
                        pa.array([np.diff(offsets[a : b + 1])], pa.list_(pa.int64())),
                        pa.array([press.compress(data[offsets[a] : offsets[b]].tobytes())], pa.binary()),
                        pa.array([int(offsets[b] - offsets[a])], pa.int64()),
                    ],
                    names=["block", "ids", "held", "sizes", "texts", "bytes"],
                )
                block += 1

    schema = f"block long, ids array<{kind}>, held array<boolean>, sizes array<long>, texts binary, bytes long"
    return documents.select(F.col(id_col), held_out(F.col(id_col)), F.col(text_col)).mapInArrow(work, schema)


class Block:
    """The tokens of a block: hashes in order, each text's words followed by its end."""

    def __init__(self, sizes: pa.Scalar, texts: pa.Scalar, held: pa.Scalar):
        offsets = np.concatenate([[0], np.cumsum(sizes.values.to_numpy(zero_copy_only=False))]).astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(texts.as_buffer()) if offsets[-1] else b""
        data, parts, counts = np.frombuffer(raw, np.uint8), [], []
        for a, b in runs(offsets, 1 << 20):
            words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1], lower=True)
            parts.append(np.insert(words.hashes, words.first[1:], END))
            counts.append(words.counts + 1)
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.held = held.values.to_numpy(zero_copy_only=False).astype(bool)
        self.learn = np.repeat(~self.held, self.counts)
        self.words, self.of = np.unique(self.hashes, return_inverse=True)
        self.times = np.bincount(self.of, weights=self.learn, minlength=len(self.words)).astype(np.int64)


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes, so that parts follow each other in the order of sorted hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _send_words(blocks: DataFrame, parts: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, texts, held in zip(*(batch.column(k) for k in ("block", "sizes", "texts", "held")), strict=True):
                own = Block(sizes, texts, held)
                cuts = np.searchsorted(_part_of(own.words, parts), np.arange(parts + 1))
                rows = [(p, own.words[a:b].tobytes(), pack(own.times[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.as_py()] * len(rows), pa.int64()),
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([r[1] for r in rows], pa.binary()),
                        pa.array([r[2] for r in rows], pa.binary()),
                    ],
                    names=["block", "part", "keys", "times"],
                )

    return blocks.select("block", "sizes", "texts", "held").mapInArrow(work, "block long, part int, keys binary, times binary")


def _number_words(sent: DataFrame, parts: int) -> DataFrame:
    """For every block the numbers of its words; a row with block -1 has a partition's totals and the steps of its counts."""

    def work(key: tuple[int], frame: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        frame = frame.sort_values("block")
        lists = [np.frombuffer(k, np.uint64) for k in frame["keys"]]
        words, of = np.unique(np.concatenate(lists), return_inverse=True)
        times = np.bincount(of, weights=np.concatenate([unpack(t) for t in frame["times"]]), minlength=len(words)).astype(np.int64)
        known = np.flatnonzero(times > 0)
        order = known[np.argsort(-times[known], kind="stable")]
        number = np.full(len(words), UNKNOWN, np.int64)
        number[order] = FIRST_WORD + np.arange(len(order)) * parts + part
        cuts = np.cumsum([0, *map(len, lists)])
        answers = [pack(number[of[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        ranked = times[order]
        step = np.flatnonzero(np.diff(ranked, prepend=-1))
        of_counts = np.bincount(np.minimum(ranked, MAX_COUNT + 2), minlength=MAX_COUNT + 3)[1 : MAX_COUNT + 2]
        total = np.array([ranked.sum(), len(ranked), *of_counts], np.int64)
        rows = pd.DataFrame({"block": frame["block"].to_numpy(), "part": part, "a": answers, "b": [b""] * len(answers)})
        return pd.concat([rows, pd.DataFrame({"block": [-1], "part": [part], "a": [pack(np.concatenate([total, step]))], "b": [pack(ranked[step])]})])

    return sent.groupBy("part").applyInPandas(work, "block long, part int, a binary, b binary")


class Unigrams:
    """Discounted probabilities of words alone, by their numbers."""

    def __init__(self, rows: list, parts: int):
        self.parts = parts
        self.steps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        totals = np.zeros(MAX_COUNT + 3, np.int64)
        for part, a, b in rows:
            a = unpack(a)
            totals += a[: MAX_COUNT + 3]
            self.steps[part] = (a[MAX_COUNT + 3 :], unpack(b))
        self.tokens, self.types = int(totals[0]), int(totals[1])
        self.d = discounts(totals[2:].tolist())
        small = [int(totals[1 + r]) * r for r in range(1, MAX_COUNT + 1)]
        kept = float(np.dot(self.d[1:], small)) + self.tokens - sum(small)
        self.total = self.tokens if kept < self.tokens else self.tokens + 1
        self.unknown = 1 - kept / self.total if self.tokens else 1.0

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts of numbered words; 0 for the unknown and for what comes before the first word."""
        out = np.zeros(len(numbers), np.int64)
        part, rank = (numbers - FIRST_WORD) % self.parts, (numbers - FIRST_WORD) // self.parts
        word = numbers >= FIRST_WORD
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            at = order[a:b]
            at = at[word[at]]
            if len(at):
                step, count = self.steps[p]
                out[at] = count[np.searchsorted(step, rank[at], side="right") - 1]
        return out

    def probability(self, counts: np.ndarray) -> np.ndarray:
        factor = self.d[np.minimum(counts, MAX_COUNT + 0)] * (counts <= MAX_COUNT) + (counts > MAX_COUNT)
        return np.where(counts > 0, factor * counts / max(self.total, 1), self.unknown)


class Pairs:
    """The distinct pairs of a block, in the order of their partitions, then by numbers."""

    def __init__(self, own: Block, numbers: np.ndarray, unigrams: Unigrams):
        now = numbers[own.of]
        before = np.empty(len(now), np.int64)
        before[1:] = now[:-1]
        before[np.cumsum(own.counts) - own.counts] = BEFORE_FIRST
        self.now, self.before = now, before
        self.asked = before != UNKNOWN
        b, w = before[self.asked], now[self.asked]
        often = self.often(b, unigrams)
        parts = unigrams.parts
        spread = (mix((b * 0x1F123BB5 + w).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        part = np.where(often, spread, b % parts)
        order = np.lexsort((w, b, part))
        b, w, part, often = b[order], w[order], part[order], often[order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (w[1:] != w[:-1])
        index = np.cumsum(new) - 1
        self.of = np.empty(len(b), np.int64)
        self.of[order] = index
        self.b, self.w, self.part, self.is_often = b[new], w[new], part[new], often[new]
        self.times = np.bincount(index, weights=own.learn[self.asked][order], minlength=len(self.b)).astype(np.int64)
        self.cuts = np.searchsorted(self.part, np.arange(parts + 1))

    @staticmethod
    def often(b: np.ndarray, unigrams: Unigrams) -> np.ndarray:
        """Words before others more than a sixteenth of a partition's share of tokens: at most 16 for each partition."""
        return (b == BEFORE_FIRST) | (unigrams.counts(b) * OFTEN * unigrams.parts > unigrams.tokens)


def _numbers_of(lists: pa.Scalar) -> np.ndarray:
    answers = sorted(((x["part"].as_py(), x["a"].as_py()) for x in lists), key=lambda x: x[0]) if lists.is_valid else []
    return np.concatenate([unpack(a) for _, a in answers]) if answers else np.zeros(0, np.int64)


def _send_pairs(blocks: DataFrame, shared) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, texts, held, words in zip(*(batch.column(k) for k in ("block", "sizes", "texts", "held", "words")), strict=True):
                pairs = Pairs(Block(sizes, texts, held), _numbers_of(words), shared.value)
                rows = []
                for p, (a, b) in enumerate(zip(pairs.cuts[:-1], pairs.cuts[1:], strict=True)):
                    if b > a:
                        rows.append((p, pack(rises(pairs.b[a:b])), pack(pairs.w[a:b]), pack(pairs.times[a:b])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.as_py()] * len(rows), pa.int64()),
                        pa.array([r[0] for r in rows], pa.int32()),
                        *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)),
                    ],
                    names=["block", "part", "b", "w", "times"],
                )

    return blocks.select("block", "sizes", "texts", "held", "words").mapInArrow(work, "block long, part int, b binary, w binary, times binary")


STATS = MAX_COUNT + 1  # a word's count before others, and its pairs by count; the sum of probabilities goes along as a double


def _add_pairs(sent: DataFrame, shared) -> DataFrame:
    """Answers to blocks: pair counts, and the statistics of their words before; rows with block -1 and -2: often words, counts of counts."""

    def work(key: tuple[int], frame: pd.DataFrame) -> pd.DataFrame:
        part, unigrams = int(key[0]), shared.value
        frame = frame.sort_values("block")
        before = [np.cumsum(unpack(x)) for x in frame["b"]]
        cuts = np.cumsum([0, *map(len, before)])
        b, w = np.concatenate(before), np.concatenate([unpack(x) for x in frame["w"]])
        n = np.concatenate([unpack(x) for x in frame["times"]])
        order = np.lexsort((w, b))
        sb, sw = b[order], w[order]
        new = np.ones(len(b), bool)
        new[1:] = (sb[1:] != sb[:-1]) | (sw[1:] != sw[:-1])
        of = np.empty(len(b), np.int64)
        of[order] = np.cumsum(new) - 1
        tb, tw = sb[new], sw[new]
        count = np.bincount(of, weights=n, minlength=len(tb)).astype(np.int64)
        heads, head = np.unique(tb, return_inverse=True)
        seen = count > 0
        lower = np.where(seen, unigrams.probability(unigrams.counts(tw)), 0.0)
        total = np.bincount(head, weights=count, minlength=len(heads)).astype(np.int64)
        small = [np.bincount(head, weights=count == r, minlength=len(heads)).astype(np.int64) for r in range(1, MAX_COUNT + 1)]
        mass = np.bincount(head, weights=lower, minlength=len(heads))
        table = np.stack([total, *small], 1)
        often = Pairs.often(heads, unigrams)
        answers, stats = [], []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            answers.append(pack(count[of[x:y]]))
            mine = np.searchsorted(heads, np.unique(b[x:y]))
            mine = mine[~often[mine]]
            planes = np.concatenate([table[mine].T.ravel(), mass[mine].view(np.int64)])
            stats.append(pack(planes))
        of_counts = np.bincount(np.minimum(count, MAX_COUNT + 2), minlength=MAX_COUNT + 3)[1 : MAX_COUNT + 2].astype(np.int64)
        out = pd.DataFrame({"block": frame["block"].to_numpy(), "part": part, "a": answers, "b": stats})
        hot = pack(np.concatenate([table[often].T.ravel(), mass[often].view(np.int64)]))
        extra = pd.DataFrame({"block": [-1, -2], "part": [part] * 2, "a": [pack(heads[often]), pack(of_counts)], "b": [hot, b""]})
        return pd.concat([out, extra])

    return sent.groupBy("part").applyInPandas(work, "block long, part int, a binary, b binary")


def _table(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = unpack(raw).reshape(STATS + 1, -1)
    return flat[:STATS].T, flat[STATS].copy().view(np.float64)


def weights(table: np.ndarray, mass: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word before: the divisor of its pair counts, and its backoff weight, from counts and follower mass.

    What the discounts free goes to unseen followers. Where nothing is freed, because every pair was seen often, one more count in the
    divisor frees its share.
    """
    total = table[:, 0].astype(np.float64)
    small = table[:, 1:] * np.arange(1, MAX_COUNT + 1)
    kept = total - small.sum(1) + (small * d[1:]).sum(1)
    divisor = np.where((total > 0) & (kept >= total), total + 1, np.maximum(total, 1))
    return divisor, np.where(total > 0, (1 - kept / divisor) / np.maximum(1 - mass, 1e-300), 1.0)


def score_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """The log10 probability of every text under the model, and under add-one unigrams.

    The model learns from documents whose crc32 of the id as text is not 2 modulo 7. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then
    one end, which is a token. Returns ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``. A null text is one without words and
    has its end alone; a null id is never held out. One row for each row of the input, repeated ids included. Without training
    documents every token is unknown, with probability 1 under the model. Other columns are not read.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[id_col]
    blocks = settle(_pack_blocks(documents, id_col, text_col, block_bytes), "blocks")
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(4, math.ceil(size / part_bytes))
    words = settle(_number_words(_send_words(blocks, parts), parts), "words")
    unigrams = Unigrams([(r["part"], bytes(r["a"]), bytes(r["b"])) for r in words.filter("block = -1").select("part", "a", "b").toLocalIterator()], parts)
    shared = spark.sparkContext.broadcast(unigrams)
    by_block = words.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "a")).alias("words"))
    pairs = settle(_add_pairs(_send_pairs(blocks.join(by_block, "block", "left"), shared), shared), "pairs")
    of_counts, often = np.zeros(MAX_COUNT + 1, np.int64), {}
    for r in pairs.filter("block < 0").select("block", "a", "b").toLocalIterator():  # bounded: 16 words a partition at most
        if r["block"] == -2:
            of_counts += unpack(bytes(r["a"]))
        else:
            table, mass = _table(bytes(r["b"]))
            for h, row, m in zip(unpack(bytes(r["a"])).tolist(), table, mass, strict=True):
                have = often.get(h, (np.zeros(STATS, np.int64), 0.0))
                often[h] = (have[0] + row, have[1] + m)
    d = discounts(of_counts.tolist())
    heads = np.array(sorted(often), np.int64)
    hot_divisor, hot_weight = weights(np.array([often[h][0] for h in heads.tolist()]).reshape(-1, STATS), np.array([often[h][1] for h in heads.tolist()]), d)
    hot = spark.sparkContext.broadcast((heads, hot_divisor, hot_weight))
    answers = pairs.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "a", "b")).alias("pairs"))
    joined = blocks.join(by_block.join(answers, "block", "left"), "block", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, (often_heads, often_divisor, often_weight) = shared.value, hot.value
        for batch in batches:
            for ids, sizes, texts, held, numbers, counted in zip(
                *(batch.column(k) for k in ("ids", "sizes", "texts", "held", "words", "pairs")), strict=True
            ):
                own = Block(sizes, texts, held)
                pair = Pairs(own, _numbers_of(numbers), uni)
                divisor, weight = np.ones(len(pair.b)), np.ones(len(pair.b))
                count = np.zeros(len(pair.b), np.int64)
                for x in counted if counted.is_valid else []:
                    p = x["part"].as_py()
                    a, b = int(pair.cuts[p]), int(pair.cuts[p + 1])
                    count[a:b] = unpack(x["a"].as_py())
                    dv, wt = weights(*_table(x["b"].as_py()), d)
                    plain = np.flatnonzero(~pair.is_often[a:b]) + a
                    _, at = np.unique(pair.b[plain], return_inverse=True)
                    divisor[plain], weight[plain] = dv[at], wt[at]
                at = np.searchsorted(often_heads, pair.b[pair.is_often])
                divisor[pair.is_often], weight[pair.is_often] = often_divisor[at], often_weight[at]
                single = uni.counts(pair.now)
                alone = uni.probability(single)
                value = alone.copy()
                seen = count[pair.of]
                factor = np.where(seen > MAX_COUNT, 1.0, d[np.minimum(seen, MAX_COUNT)])
                value[pair.asked] = np.where(seen > 0, factor * seen / divisor[pair.of], weight[pair.of] * alone[pair.asked])
                base = (single + 1) / (uni.tokens + uni.types + 1)
                doc = np.repeat(np.arange(len(own.counts)), own.counts)
                sums = [np.bincount(doc, weights=v, minlength=len(own.counts)) for v in (np.log10(base), np.log10(value), single > 0)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values,
                        held.values,
                        pa.array(own.counts, pa.int64()),
                        pa.array(sums[2].astype(np.int64)),
                        pa.array(np.full(len(own.counts), uni.tokens, np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                    ],
                    names=names,
                )

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.select("ids", "sizes", "texts", "held", "words", "pairs").mapInArrow(work, schema)
