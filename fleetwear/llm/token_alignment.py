"""Alignment of two tokenizers' tokens by the byte offsets where both end, composed from fragments of byte ranges.

The tokens of a byte range form a fragment: an open prefix up to the first offset where both tokenizers end, the closed
groups between such offsets, and an open suffix after the last one. Fragments of neighbouring ranges compose: the left one's
suffix and the right one's prefix are a group. Composition is associative, so a long text is cut into segments that are
tokenised in different tasks, each segment into ranges, and the ranges' fragments are composed as a tree, ``FAN`` at a time.
The closed groups stay behind in the table of ranges; only open ends and their places go up the tree. Segments begin at a
blank after a visible ASCII character, where neither tokenizer has a token across.

A text of at most ``long_bytes`` is one range, worked on in array passes over a run of many texts.

Links are counted in two steps. Every block of texts, about 0.4 MB, lists its distinct id pairs with the number of its texts
that hold them; these lists are summed, and the sums go back to the blocks that asked. No row is sent for a single
text's pair, and nothing but vocabularies is held by every task. A pair that every block asks for is one row a block,
on the side of the join that Spark splits when it is skewed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.llm.packing import RankCodec
from fleetwear.llm.pretokens import PieceStore, spans
from fleetwear.llm.words import column_bytes, runs
from fleetwear.runtime import settle

LONG_BYTES = 1 << 16
BLOCK_BYTES = 3 << 17  # texts worked on at once; array passes take about a hundred bytes for each of theirs
STORE = {"bits": 19, "pool": 2_000_000}  # a task holds two stores of pieces
FAN = 16
_FOREIGN = 0xFFFF  # stands for a piece whose tokens do not give its bytes back
_SHIFT = np.int64(20)  # bits of an id within a pair
_LOW = np.int64((1 << 20) - 1)


class Aligner:
    """Both tokenizers, their stores of pieces, and the byte length and decimal spelling of every id."""

    def __init__(self, path_a: str, path_b: str):
        codec = RankCodec(path_a)
        self.a = PieceStore(codec.encode_words, **STORE)
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.size_a = np.zeros(_FOREIGN + 1, np.int64)
        for token, i in vocabulary.items():
            self.size_a[i] = len(token)  # one letter stands for one byte
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._bytes(i) for i in range(self.pieces.get_piece_size())]
        self.size_b = np.zeros(_FOREIGN + 1, np.int64)
        self.size_b[: len(self.bytes_b)] = list(map(len, self.bytes_b))
        # A blank after another character begins a token unless a piece of the vocabulary goes over both.
        self.blank_cuts = not any(b" " in p.lstrip(b" ") for p in self.bytes_b)
        self.lone_blank = self.pieces.encode("a ")[len(self.pieces.encode("a")) :]
        self.b = PieceStore(self._encode_b, **STORE)
        self.decimal = [str(i) for i in range(_FOREIGN + 1)]
        self.spelled = [[d + mark for d in self.decimal] for mark in ",|;"]

    def _bytes(self, i: int) -> bytes:
        if self.pieces.is_byte(i):
            return bytes([int(self.pieces.id_to_piece(i)[3:5], 16)])
        if self.pieces.is_control(i) or self.pieces.is_unknown(i):
            return b""
        return self.pieces.id_to_piece(i).replace("▁", " ").encode()

    def _encode_b(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of parts that begin with the blank that the tokenizer adds by itself."""
        found = self.pieces.encode([p[1:].decode() for p in parts])
        found = [ids if len(p) > 1 else self.lone_blank for ids, p in zip(found, parts, strict=True)]  # it adds none to no text
        return [ids if b"".join(map(self.bytes_b.__getitem__, ids)) == p else [_FOREIGN] for ids, p in zip(found, parts, strict=True)]

    def tokens(self, raw: np.ndarray, offsets: np.ndarray) -> Tokens:
        """Tokens of texts that each begin with the added blank; texts that either tokenizer alters have none."""
        first, last, begin = spans(raw, offsets, True)
        ids_a, count = self.a.ids(raw, first, last)
        cut_a = np.concatenate([[0], np.cumsum(count)])[begin]
        starts = np.zeros(len(raw), bool)
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.blank_cuts:
            starts[1:] |= (raw[1:] == 32) & (raw[:-1] != 32)
        first = np.flatnonzero(starts)
        ids_b, count = self.b.ids(raw, first, np.append(first[1:], len(raw)))
        cut_b = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(first, offsets)]
        size = np.diff(offsets)
        of_a, of_b = np.repeat(np.arange(len(size)), np.diff(cut_a)), np.repeat(np.arange(len(size)), np.diff(cut_b))
        fine = np.bincount(of_a, weights=self.size_a[ids_a], minlength=len(size)) == size
        fine &= np.bincount(of_b, weights=ids_b == _FOREIGN, minlength=len(size)) == 0
        fine &= np.bincount(of_b, weights=self.size_b[ids_b], minlength=len(size)) == size
        if not fine.all():
            keep_a, keep_b = fine[of_a], fine[of_b]
            ids_a, of_a, ids_b, of_b = ids_a[keep_a], of_a[keep_a], ids_b[keep_b], of_b[keep_b]
        lost = np.cumsum(np.where(fine, 0, size))  # bytes of texts without tokens, up to and with each text
        end_a, end_b = np.cumsum(self.size_a[ids_a]) + lost[of_a], np.cumsum(self.size_b[ids_b]) + lost[of_b]
        return Tokens(ids_a, end_a, of_a, ids_b, end_b, of_b, fine)


@dataclass
class Tokens:
    """Ids of both sides with the byte offset where each ends and the text it is of."""

    ids_a: np.ndarray
    end_a: np.ndarray
    of_a: np.ndarray
    ids_b: np.ndarray
    end_b: np.ndarray
    of_b: np.ndarray
    fine: np.ndarray


_ready: dict[tuple[str, str], Aligner] = {}


def ready(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ready:
        _ready[path_a, path_b] = Aligner(path_a, path_b)
    return _ready[path_a, path_b]


@dataclass
class Fragment:
    """The open ends of a byte range; without a common offset in it, all its tokens are the prefix.

    ``at`` is the place of the first range with a common offset: the group that the prefix completes ends there.
    """

    pre_a: list[int]
    pre_b: list[int]
    cut: bool
    at: int
    suf_a: list[int]
    suf_b: list[int]


Group = tuple[list[int], list[int], int]


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, Group | None]:
    """The fragment of two neighbouring ranges, and the group that they close between them."""
    if not left.cut:
        return Fragment(left.pre_a + right.pre_a, left.pre_b + right.pre_b, right.cut, right.at, right.suf_a, right.suf_b), None
    if not right.cut:
        return Fragment(left.pre_a, left.pre_b, True, left.at, left.suf_a + right.pre_a, left.suf_b + right.pre_b), None
    whole = Fragment(left.pre_a, left.pre_b, True, left.at, right.suf_a, right.suf_b)
    return whole, (left.suf_a + right.pre_a, left.suf_b + right.pre_b, right.at)


def common_ends(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """The offsets in both; each side's are in order and differ."""
    if not len(end_a) or not len(end_b):
        return end_a[:0]
    low = min(end_a[0], end_b[0])
    ends = np.zeros(int(max(end_a[-1], end_b[-1]) - low) + 1, bool)
    ends[end_a - low] = True
    return end_b[ends[end_b - low]]


def range_fragment(ids_a, end_a, ids_b, end_b, at: int) -> tuple[Fragment, tuple[np.ndarray, ...]]:
    """The fragment of a range and the tokens of its closed groups, each with the number of its group."""
    common = common_ends(end_a, end_b)
    if not len(common):
        return Fragment(ids_a.tolist(), ids_b.tolist(), False, at, [], []), (ids_a[:0], end_a[:0], ids_b[:0], end_b[:0])
    g_a, g_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    n = len(common)
    inner_a, inner_b = (g_a > 0) & (g_a < n), (g_b > 0) & (g_b < n)
    fragment = Fragment(ids_a[g_a == 0].tolist(), ids_b[g_b == 0].tolist(), True, at, ids_a[g_a == n].tolist(), ids_b[g_b == n].tolist())
    return fragment, (ids_a[inner_a], g_a[inner_a] - 1, ids_b[inner_b], g_b[inner_b] - 1)


def linked(ids_a: np.ndarray, g_a: np.ndarray, ids_b: np.ndarray, g_b: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, ...]:
    """Distinct id pairs of each text with their occurrences, by groups numbered from 0; ``text`` is the text of each group.

    Returns the text, the pair and its occurrences, ordered by text and pair, and the links of each text.
    """
    n = len(text)
    n_a, n_b = np.bincount(g_a, minlength=n), np.bincount(g_b, minlength=n)
    times = n_a * n_b
    links = np.zeros(texts, np.int64)
    np.add.at(links, text, times)
    begin_a, begin_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    large = np.flatnonzero(times > 4096)  # these are not written out token by token
    plain = times.copy()
    plain[large] = 0
    group = np.repeat(np.arange(n), plain)
    k = np.arange(len(group)) - np.repeat(np.cumsum(plain) - plain, plain)
    a = ids_a[begin_a[group] + k // n_b[group]].astype(np.int64)
    b = ids_b[begin_b[group] + k % n_b[group]].astype(np.int64)
    keys, count = np.unique(text[group].astype(np.int64) << 40 | a << _SHIFT | b, return_counts=True)
    if len(large):
        every, counts = [keys], [count]
        for g in large.tolist():
            one, of_one = np.unique(ids_a[begin_a[g] : begin_a[g] + n_a[g]].astype(np.int64), return_counts=True)
            two, of_two = np.unique(ids_b[begin_b[g] : begin_b[g] + n_b[g]].astype(np.int64), return_counts=True)
            every.append((np.int64(text[g]) << 40 | one[:, None] << _SHIFT | two[None, :]).ravel())
            counts.append((of_one[:, None] * of_two[None, :]).ravel())
        keys, back = np.unique(np.concatenate(every), return_inverse=True)
        count = np.zeros(len(keys), np.int64)
        np.add.at(count, back, np.concatenate(counts))
    return keys >> 40, keys & np.int64((1 << 40) - 1), count, links


def spell(aligner: Aligner, ids_a: np.ndarray, g_a: np.ndarray, ids_b: np.ndarray, g_b: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
    """Parts of the groups' spelling ``a1,a2|b1;a3|b2;``, one a token, and for each group the place of its first part."""
    n_a, n_b = np.bincount(g_a, minlength=n), np.bincount(g_b, minlength=n)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    mark = np.zeros(len(code), np.int64)
    at_a, at_b = np.arange(len(ids_a)) + first_b[g_a], np.arange(len(ids_b)) + (first_a + n_a)[g_b]
    code[at_a], code[at_b] = ids_a, ids_b
    begin = first_a + first_b
    mark[begin + n_a - 1], mark[begin + n_a + n_b - 1] = 1, 2
    table = [w for words in aligner.spelled for w in words]
    return list(map(table.__getitem__, (code + mark * len(aligner.decimal)).tolist())), begin


def _short(documents: DataFrame, path_a: str, path_b: str, kind: str, digest: bool) -> DataFrame:
    """One row a text with its counts and spelling; a block's first row also has the block's pairs and their texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = ready(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in runs(offsets, BLOCK_BYTES):
                yield _block(aligner, block, batch.column(0).slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], digest)
                block += 1

    schema = f"id {kind}, block long, n_a long, n_b long, n_groups long, n_links long, groups string, places binary, times binary, pairs binary, texts binary"
    return documents.mapInArrow(work, schema)


def _block(aligner: Aligner, block: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, digest: bool) -> pa.RecordBatch:
    n, empty = len(ids), np.diff(offsets) == 0
    # The blank goes in front of every text that has bytes; an empty one has no tokens.
    raw = np.insert(data, offsets[:-1][~empty], 32)
    t = aligner.tokens(raw, offsets + np.concatenate([[0], np.cumsum(~empty)]))
    common = common_ends(t.end_a, t.end_b)
    g_a, g_b = np.searchsorted(common, t.end_a), np.searchsorted(common, t.end_b)
    text = np.zeros(len(common), np.int64)
    text[g_a] = t.of_a
    doc, pair, times, links = linked(t.ids_a, g_a, t.ids_b, g_b, text, n)
    pairs, place, texts = np.unique(pair, return_inverse=True, return_counts=True)
    words, begin = spell(aligner, t.ids_a, g_a, t.ids_b, g_b, len(common))
    lo = np.append(begin, len(words))[np.searchsorted(text, np.arange(n + 1))].tolist()
    spelled = ["".join(words[p:q])[:-1] for p, q in zip(lo[:-1], lo[1:], strict=True)]
    if digest:
        spelled = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled]
    cut = np.searchsorted(doc, np.arange(n + 1)).tolist()
    packed = lambda x, kind: [x[p:q].astype(kind).tobytes() for p, q in zip(cut[:-1], cut[1:], strict=True)]
    once = lambda x: pa.array([x.astype(np.int64).tobytes(), *[None] * (n - 1)], pa.binary())
    count = lambda of: pa.array(np.bincount(of, minlength=n), pa.int64())
    columns = [
        ids,
        pa.array(np.full(n, block), pa.int64()),
        count(t.of_a),
        count(t.of_b),
        count(text),
        pa.array(links, pa.int64()),
        pa.array(spelled, pa.string()),
        pa.array(packed(place, np.int32), pa.binary()),
        pa.array(packed(times, np.int64 if len(times) and times.max() >= 1 << 31 else np.int32), pa.binary()),
        once(pairs),
        once(texts),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["id", "block", "n_a", "n_b", "n_groups", "n_links", "groups", "places", "times", "pairs", "texts"])


def _unpacked(rows: DataFrame, key: str, first: str, second: str, names: tuple[str, str]) -> DataFrame:
    """A row for each entry of two binary columns of long values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, one, two in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                x, y = np.frombuffer(one, np.int64), np.frombuffer(two, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k), pa.int64()), pa.array(x), pa.array(y)], names=[key, *names])

    return rows.select(key, first, second).mapInArrow(work, f"{key} long, {names[0]} long, {names[1]} long")


def _segments(documents: DataFrame, path_a: str, path_b: str, segment: int) -> DataFrame:
    """``key, lo, data``: long texts with the added blank, cut at the first safe blank after every ``segment`` bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts_allowed = ready(path_a, path_b).blank_cuts
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for k, key in enumerate(batch.column(0).to_pylist()):
                raw = np.insert(data[offsets[k] : offsets[k + 1]], 0, 32)
                safe = 1 + np.flatnonzero(cuts_allowed & (raw[1:-1] == 32) & (raw[:-2] > 32) & (raw[:-2] < 127))
                cuts = [0]
                while (p := int(np.searchsorted(safe, cuts[-1] + segment))) < len(safe):
                    cuts.append(int(safe[p]))
                for lo, hi in zip(cuts, [*cuts[1:], len(raw)], strict=True):
                    part = [pa.array([key], pa.int64()), pa.array([lo], pa.int64()), pa.array([raw[lo:hi].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(part, names=["key", "lo", "data"])

    return documents.mapInArrow(work, "key long, lo long, data binary")


_OPEN = "pre_a array<int>, pre_b array<int>, cut boolean, at long, suf_a array<int>, suf_b array<int>"
_CLOSED = "fine boolean, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"
#: A range's or a composed group's row: its text, where it begins, whether it is a range, its open ends, its closed groups.
_PARTS = f"key long, lo long, ranged boolean, {_OPEN}, {_CLOSED}"


def _part(aligner: Aligner, key: int, lo: int, fragment: Fragment | None, fine: bool, closed: tuple[np.ndarray, ...]) -> dict:
    ids_a, g_a, ids_b, g_b = closed
    n = int(g_a[-1]) + 1 if len(g_a) else 0
    _, pairs, times, links = linked(ids_a, g_a, ids_b, g_b, np.zeros(n, np.int64), 1)
    row = {"key": key, "lo": lo, "ranged": fragment is not None, **(vars(fragment) if fragment else dict.fromkeys(["pre_a", "pre_b", "cut", "at", "suf_a", "suf_b"]))}
    text = "".join(spell(aligner, ids_a, g_a, ids_b, g_b, n)[0])
    return row | {"fine": fine, "n_a": len(ids_a), "n_b": len(ids_b), "n_groups": n, "n_links": int(links[0]), "groups": text, "pairs": pairs.tobytes(), "times": times.tobytes()}


def _group_part(aligner: Aligner, key: int, group: Group) -> dict:
    a, b = np.array(group[0], np.int64), np.array(group[1], np.int64)
    # -1 puts the group that ends in a range before the groups that lie in it.
    return _part(aligner, key, 2 * group[2] - 1, None, True, (a, np.zeros(len(a), np.int64), b, np.zeros(len(b), np.int64)))


def _ranges(segments: DataFrame, path_a: str, path_b: str, width: int) -> DataFrame:
    """Tokenises every segment and makes a part of each byte range; ranges end at multiples of ``width`` and with the segment."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = ready(path_a, path_b)
        for frame in frames:
            for key, lo, data in zip(frame["key"], frame["lo"], frame["data"], strict=True):
                raw = np.frombuffer(data, np.uint8)
                t = aligner.tokens(raw, np.array([0, len(raw)]))
                if not t.fine[0]:
                    none = np.zeros(0, np.int64)
                    yield pd.DataFrame([_part(aligner, key, 2 * lo, Fragment([], [], False, lo, [], []), False, (none, none, none, none))])
                    continue
                edges = [lo, *range((lo // width + 1) * width, lo + len(raw), width), lo + len(raw)]
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    a, b = (slice(*np.searchsorted(end, [x - lo, y - lo], side="right")) for end in (t.end_a, t.end_b))
                    fragment, closed = range_fragment(t.ids_a[a], t.end_a[a], t.ids_b[b], t.end_b[b], x)
                    yield pd.DataFrame([_part(aligner, key, 2 * x, fragment, True, closed)])

    return segments.mapInPandas(work, _PARTS)


def _composed(parts: DataFrame, path_a: str, path_b: str, step: int) -> DataFrame:
    """The fragments of ``step`` bytes composed to one, and the groups that this closes."""

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        aligner = ready(path_a, path_b)
        rows = frame.sort_values("lo", kind="stable")
        whole, out = None, []
        for r in rows.itertuples():
            one = Fragment(list(r.pre_a), list(r.pre_b), bool(r.cut), int(r.at), list(r.suf_a), list(r.suf_b))
            if whole is None:
                whole = one
                continue
            whole, group = compose(whole, one)
            if group:
                out.append(_group_part(aligner, key[0], group))
        none = np.zeros(0, np.int64)
        out.append(_part(aligner, key[0], int(rows["lo"].iloc[0]), whole, True, (none, none, none, none)))
        return pd.DataFrame(out)

    node = F.floor(F.col("lo") / (2 * step)).alias("node")
    return parts.filter("ranged").select("*", node).groupBy("key", "node").applyInPandas(work, _PARTS)


def _long(documents: DataFrame, path_a: str, path_b: str, digest: bool, width: int, segment: int) -> tuple[DataFrame, DataFrame]:
    """Rows of long texts by ``key``: their counts and spelling, and their pairs with occurrences."""
    dealt = _segments(documents, path_a, path_b, segment).repartition("key", "lo")
    parts = settle(_ranges(dealt, path_a, path_b, width), "ranges")
    closed, top, step = parts, parts, width * FAN
    longest = parts.agg(F.max("lo")).first()[0] // 2
    while True:
        top = settle(_composed(top, path_a, path_b, step), "composed")
        closed = closed.union(top.filter("NOT ranged"))
        if step > longest:
            break
        step *= FAN

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = ready(path_a, path_b)
        for frame in frames:
            # A text begins and ends where both tokenizers do: its whole prefix is its first group.
            found = [_group_part(aligner, r.key, (list(r.pre_a), list(r.pre_b), int(r.at))) for r in frame.itertuples() if r.cut]
            if found:
                yield pd.DataFrame(found)

    closed = closed.union(top.filter("ranged").mapInPandas(ends, _PARTS))
    sums = closed.groupBy("key").agg(F.min("fine").alias("fine"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")])
    fine = settle(sums, "sums")
    pairs = _unpacked(closed.join(fine.filter("fine").select("key"), "key", "left_semi"), "key", "pairs", "times", ("pair", "times"))
    pairs = settle(pairs.groupBy("key", "pair").agg(F.sum("times").alias("times")), "long-pairs")
    ordered = closed.filter("groups != ''").select("key", "lo", "groups").repartition("key").sortWithinPartitions("key", "lo")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One text after another; of a digest only its state is held."""
        last, held, state = None, "", None

        def take(text: str) -> None:
            state.update(text.encode()) if digest else state.append(text)

        def done() -> pa.RecordBatch:
            take(held[:-1])
            text = state.hexdigest() if digest else "".join(state)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([text], pa.string())], names=["key", "groups"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != last:
                    if state is not None:
                        yield done()
                    last, held, state = key, "", hashlib.sha256() if digest else []
                take(held)
                held = text
        if state is not None:
            yield done()

    texts = ordered.mapInArrow(spelled, "key long, groups string")
    return settle(fine.join(texts, "key", "left"), "long-texts"), pairs


def pair_counts(texts: DataFrame, single: DataFrame | None) -> DataFrame:
    """``pair, count, best``: the texts that hold each pair, and whether no pair with its first id has more."""
    every = texts.groupBy("pair").agg(F.sum("texts").alias("count"))
    if single is not None:
        held = every.union(single.groupBy("pair").agg(F.count(F.lit(1)).alias("count")))
        every = held.groupBy("pair").agg(F.sum("count").alias("count"))
    every = settle(every, "pair-counts")
    a = F.shiftright("pair", 20).alias("a")
    highest = every.groupBy(a).agg(F.max("count").alias("highest"))
    rated = every.select("*", a).join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    return settle(rated, "rated")


def _scored(aligned: DataFrame, answers: DataFrame, kind: str) -> DataFrame:
    """Sums the answers of each block over the pairs of its texts."""
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = np.asarray(right.column("best").to_numpy(), bool)[order]
        n_best, total = [], []
        for places, times in zip(left.column("places").to_pylist(), left.column("times").to_pylist(), strict=True):
            at = np.frombuffer(places, np.int32)
            of = np.frombuffer(times, np.int32 if len(times) == 4 * len(at) else np.int64).astype(np.int64)
            n_best.append(int(of[best[at]].sum()))
            total.append(int((of * count[at]).sum()))
        columns = [left.column(c) for c in names[:5]] + [pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), left.column("groups")]
        return pa.table(columns, names=names)

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    rows = aligned.select("block", *names[:5], "groups", "places", "times")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)


def align_texts(
    documents: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: bool = False,
    long_bytes: int = LONG_BYTES,
) -> DataFrame:
    """Every whole text's groups of tokens between the byte offsets where tokens of both tokenizers end.

    A is a byte-level vocabulary of the tokenizers library and encodes the text after a blank; B is a sentencepiece model, which adds that
    blank itself. Returns ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``: tokens of both, groups, token pairs that share a
    group, those of them whose pair is held by as many texts as any pair of its A id, the sum over links of the texts that
    hold the pair, and the groups as ``a1,a2|b1;a3|b2,b3``; with ``digest``, ``groups_sha256`` instead, its lowercase hex digest, empty for a
    text without tokens. Null and empty texts, and texts whose tokens do not give their bytes back, have no tokens and
    zeros. One row for each row of the input; rows that repeat an id or a text are separate texts, null ids are kept, an empty
    table gives no rows, other columns are not read. Both files must be readable on every executor.
    """
    kind = dict(documents.dtypes)[id_col]
    base = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    aligned = settle(_short(base.filter(~is_long), path_a, path_b, kind, digest), "aligned")
    long = settle(base.filter(is_long).withColumn("key", F.monotonically_increasing_id()), "long")
    asked = _unpacked(aligned.filter("pairs IS NOT NULL"), "block", "pairs", "texts", ("pair", "texts"))
    asked = settle(asked, "asked")
    rows = singles = None
    if not long.isEmpty():
        rows, singles = _long(long.select("key", "text"), path_a, path_b, digest, max(1, long_bytes // 4), long_bytes)
    rated = pair_counts(asked, singles)
    out = _scored(aligned, asked.join(rated, "pair").select("block", "pair", "count", "best"), kind)
    if rows is not None:
        held = singles.join(rated, "pair").groupBy("key").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
        )
        full = long.select("id", "key").join(rows, "key").join(held, "key", "left")
        number = lambda c: F.when(F.col("fine"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
        text = F.when(F.col("fine"), F.coalesce("groups", F.lit(""))).otherwise("").alias("groups")
        out = out.union(full.select("id", *map(number, ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]), text))
    return out.withColumnsRenamed({"id": id_col, "groups": "groups_sha256"} if digest else {"id": id_col})
