"""Removal of repeated passages: windows of words that occur more than once, found by Aho-Corasick automata of recurring phrases.

A window of ``window`` words holds one anchor: the phrase of eight words whose mixed spelling is the least of all that the window holds
(a word's letter is a byte of its hash, a phrase's spelling its eight letters). Equal windows have equal anchors at equal
places, so only phrases that are anchors twice can lie in a repeated window, and anchors are about one word in fifteen.

1. Texts are packed, with their other columns, into blocks of about a megabyte, which all later passes read.
2. Each block reports its anchors with a hash of the whole surroundings that windows around them can reach. Anchors
   reported once are done. Where the surroundings are equal too, every window around is repeated.
3. For anchors with several surroundings, the windows of the unique ones, and of one of each repeated, are counted by hash.
4. Each block then gets its own confirmed phrases, compiles them into one automaton, streams its texts through it and, around
   every occurrence, removes the words of all confirmed windows. A block's automaton is bounded by the block's size, and a passage
   that most documents share reaches each block once: there is no hot key.

All hashes that decide have 64 bits; the spelling only finds candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from fleetwear.llm.words import Words, column_bytes, mix, powers, runs, words_of
from fleetwear.runtime import settle

PHRASE = 8
BLOCK_BYTES = 1 << 20
_TURN = 0xA0761D6478BD642F
WHOLE, EMIT = 1, 2


class Passages:
    """Anchors, surroundings and windows of a block's words."""

    def __init__(self, words: Words, window: int):
        self.words, self.window = words, window
        h, first = words.hashes, words.first
        n = len(h)
        self.doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.letters = (h & np.uint64(0xFF)).astype(np.uint8)
        self.forth, self.back = powers(_TURN, n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.forth[:n], out=self.total[1:])
        self.low, self.high = first[:-1][self.doc], first[1:][self.doc]

    def span_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.back[a] + (b - a).astype(np.uint64))

    def spellings(self) -> np.ndarray:
        n = max(len(self.letters) - PHRASE + 1, 0)
        out = np.zeros(n, np.uint64)
        for k in range(PHRASE):
            out |= self.letters[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        return out

    def starts(self) -> np.ndarray:
        """Where a whole window fits into a text."""
        return np.flatnonzero(np.arange(len(self.doc)) + self.window <= self.high)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window starts, the place of each one's anchor (the leftmost least), and the spelling at every place."""
        starts, spelled = self.starts(), self.spellings()
        if not len(starts):
            return starts, starts, spelled
        order = mix(spelled)
        view = np.lib.stride_tricks.sliding_window_view(order, self.window - PHRASE + 1)
        at = np.empty(len(starts), np.int64)
        for k in range(0, len(starts), 1 << 16):
            part = starts[k : k + (1 << 16)]
            at[k : k + len(part)] = part + view[part[0] : part[-1] + 1].argmin(axis=1)[part - part[0]]
        return starts, at, spelled

    def surroundings(self, at: np.ndarray) -> np.ndarray:
        """A hash of all words that windows around the phrases at ``at`` can hold, and of the phrase's place among them."""
        a = np.maximum(self.low[at], at - (self.window - PHRASE))
        b = np.minimum(self.high[at], at + self.window)
        return mix(self.span_hash(a, b) + (at - a).astype(np.uint64))

    def windows(self, starts: np.ndarray) -> np.ndarray:
        return self.span_hash(starts, starts + self.window)


def _pack_blocks(documents: DataFrame, text_col: str, limit: int) -> DataFrame:
    """``block, rows array<struct of the other columns>, sizes, texts``: texts compressed together."""
    others = [f for f in documents.schema.fields if f.name != text_col]
    schema = StructType(
        [
            StructField("block", LongType()),
            StructField("rows", ArrayType(StructType(others))),
            StructField("sizes", ArrayType(LongType())),
            StructField("texts", BinaryType()),
        ]
    )
    names = [f.name for f in others]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            rows = batch.column(1)
            for a, b in runs(offsets, limit):
                packed = press.compress(data[offsets[a] : offsets[b]].tobytes())
                inner = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.concat_arrays([rows.slice(a, b - a)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        inner,
                        pa.array([np.diff(offsets[a : b + 1])], pa.list_(pa.int64())),
                        pa.array([packed], pa.binary()),
                    ],
                    names=["block", "rows", "sizes", "texts"],
                )
                block += 1

    one = F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.struct(F.lit(0).alias("none"))
    if not names:
        schema["rows"].dataType.elementType.add("none", "int")
    return documents.select(F.col(f"`{text_col}`"), one.alias("row")).mapInArrow(work, schema)


def _open(sizes: pa.Scalar, texts: pa.Scalar, window: int) -> tuple[np.ndarray, np.ndarray, Passages]:
    offsets = np.concatenate([[0], np.cumsum(sizes.values.to_numpy(zero_copy_only=False))]).astype(np.int64)
    raw = zstandard.ZstdDecompressor().decompress(texts.as_buffer(), max_output_size=int(offsets[-1]) or 1) if offsets[-1] else b""
    data = np.frombuffer(raw, np.uint8)
    return data, offsets, Passages(words_of(data, offsets), window)


def _numbers(scalar: pa.Scalar) -> np.ndarray:
    """A list column's values; none for a null."""
    if not scalar.is_valid:
        return np.zeros(0, np.int64)
    return scalar.values.to_numpy(zero_copy_only=False).astype(np.int64)


def _report(blocks: DataFrame, window: int) -> DataFrame:
    """``anchor, around, block, n``: each block's anchors and surroundings, with the number of places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, texts in zip(*(batch.column(k) for k in ("block", "sizes", "texts")), strict=True):
                _, _, found = _open(sizes, texts, window)
                _, at, spelled = found.anchors()
                at = np.unique(at)
                pair = np.empty(len(at), [("a", np.uint64), ("c", np.uint64)])
                pair["a"], pair["c"] = spelled[at], found.surroundings(at)
                once, n = np.unique(pair, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(once["a"].astype(np.uint64).view(np.int64)),
                        pa.array(once["c"].astype(np.uint64).view(np.int64)),
                        pa.array(np.full(len(once), block.as_py(), np.int64)),
                        pa.array(n.astype(np.int64)),
                    ],
                    names=["anchor", "around", "block", "n"],
                )

    return blocks.select("block", "sizes", "texts").mapInArrow(work, "anchor long, around long, block long, n long")


def _windows(blocks: DataFrame, window: int) -> DataFrame:
    """``hash, block, n``: windows under the anchors whose surroundings call for it, from blocks with ``anchors`` to emit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, texts, anchors, arounds in zip(
                *(batch.column(k) for k in ("block", "sizes", "texts", "anchors", "arounds")), strict=True
            ):
                _, _, found = _open(sizes, texts, window)
                starts, at, spelled = found.anchors()
                wanted = np.isin(spelled[at], _numbers(anchors).view(np.uint64))
                starts, at = starts[wanted], at[wanted]
                wanted = np.isin(found.surroundings(at), _numbers(arounds).view(np.uint64))
                once, n = np.unique(found.windows(starts[wanted]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(once.view(np.int64)), pa.array(np.full(len(once), block.as_py(), np.int64)), pa.array(n.astype(np.int64))],
                    names=["hash", "block", "n"],
                )

    columns = blocks.select("block", "sizes", "texts", "anchors", "arounds")
    return columns.mapInArrow(work, "hash long, block long, n long")


def _covered(found: Passages, anchors: np.ndarray, whole: np.ndarray, confirmed: np.ndarray) -> np.ndarray:
    """Which words lie in a confirmed window: the automaton of the block's phrases finds where to look."""
    n = len(found.letters)
    marks = np.zeros(n + 1, np.int64)
    if len(anchors):
        automaton = ahocorasick.Automaton()
        for a in anchors.tolist():
            automaton.add_word((a & (2**64 - 1)).to_bytes(8, "little").decode("latin-1"), 1)
        automaton.make_automaton()
        line = found.letters.tobytes().decode("latin-1")
        at = np.fromiter((end for end, _ in automaton.iter(line)), np.int64) - (PHRASE - 1)
        at = at[at + PHRASE <= found.high[at]] if len(at) else at
        same = np.isin(found.surroundings(at), whole.view(np.uint64)) if len(at) else np.zeros(0, bool)
        for places, test in ((at[same], False), (at[~same], True)):
            low = np.maximum(found.low[places], places - (found.window - PHRASE))
            high = np.minimum(places, found.high[places] - found.window)
            reach = np.maximum(high - low + 1, 0)
            flags = np.zeros(n + 1, np.int64)
            np.add.at(flags, low[reach > 0], 1)
            np.add.at(flags, high[reach > 0] + 1, -1)
            starts = np.flatnonzero(np.cumsum(flags[:n]) > 0) if n else np.zeros(0, np.int64)
            if test and len(starts):
                starts = starts[np.isin(found.windows(starts), confirmed.view(np.uint64))]
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + found.window, -1)
    return np.cumsum(marks[:n]) > 0


def remove_repeats(documents: DataFrame, window: int = 35, text_col: str = "text", digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document without the words of windows that also start anywhere else.

    A window is ``window`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one text, compared unchanged; one that starts at two places, of one text
    or of two, is repeated, and each word under it goes, at all its places. Returns the other columns unchanged, then ``n_words``,
    ``n_removed`` and the new text under ``text_col``: the kept words joined by one blank, or the text as it was if nothing
    goes. With ``digest``, ``kept_sha256`` of the kept words joined by one blank stands in for the text. A null text counts as
    empty. One row for each row of the input: rows that are equal throughout repeat each other. Columns of the input with the name of
    a new one are replaced. An empty table gives no rows. ``window`` is at least 9.
    """
    if window <= PHRASE:
        raise ValueError("window must be more than eight words")
    new = ["n_words", "n_removed", "kept_sha256" if digest else text_col]
    base = documents.drop(*(c for c in documents.columns if c in new and c != text_col))
    others = [f for f in base.schema.fields if f.name != text_col]
    blocks = settle(_pack_blocks(base, text_col, block_bytes), "blocks")
    rows = _report(blocks, window)
    twice = rows.groupBy("anchor").agg(F.sum("n").alias("all")).filter("all > 1").select("anchor")
    live = settle(rows.join(twice, "anchor"), "anchors")
    kinds = live.groupBy("anchor", "around").agg(F.sum("n").alias("n"), F.min("block").alias("first"))
    mixed = live.groupBy("anchor").agg((F.min("around") != F.max("around")).alias("mixed"))
    told = kinds.join(mixed, "anchor").select("anchor", "around", "first", "mixed", (F.col("n") > 1).alias("same"))
    flagged = live.join(told, ["anchor", "around"]).select(
        "block",
        "anchor",
        "around",
        "same",
        (F.col("mixed") & (~F.col("same") | (F.col("block") == F.col("first")))).alias("emit"),
    )
    lists = settle(
        flagged.groupBy("block").agg(
            F.collect_set("anchor").alias("phrases"),
            F.collect_set(F.when(F.col("same"), F.col("around"))).alias("whole"),
            F.collect_set(F.when(F.col("emit"), F.col("anchor"))).alias("anchors"),
            F.collect_set(F.when(F.col("emit"), F.col("around"))).alias("arounds"),
        ),
        "phrases",
    )
    seen = settle(_windows(blocks.join(lists.filter(F.size("anchors") > 0), "block"), window), "windows")
    # Windows under surroundings that are themselves repeated count already; those of one block stand for all of them.
    often = seen.groupBy("hash").agg(F.sum("n").alias("all")).filter("all > 1").select("hash")
    confirmed = seen.join(often, "hash").groupBy("block").agg(F.collect_set("hash").alias("confirmed"))
    work_on = blocks.join(lists.select("block", "phrases", "whole").join(confirmed, "block", "left"), "block", "left")
    tail = StringType()
    out_schema = StructType(
        [StructField("row", blocks.schema["rows"].dataType.elementType), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("out", tail)]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sizes, texts, phrases, whole, sure in zip(
                *(batch.column(k) for k in ("rows", "sizes", "texts", "phrases", "whole", "confirmed")), strict=True
            ):
                data, offsets, found = _open(sizes, texts, window)
                gone = _covered(found, _numbers(phrases), _numbers(whole), _numbers(sure))
                first = found.words.first
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[first[1:]] - total[first[:-1]]
                out = []
                for k in range(len(first) - 1):
                    a, b = int(first[k]), int(first[k + 1])
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    if digest or removed[k]:
                        kept = text.split()
                        if removed[k]:
                            kept = [w for w, g in zip(kept, gone[a:b].tolist(), strict=True) if not g]
                        text = b" ".join(kept)
                    out.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                yield pa.RecordBatch.from_arrays(
                    [row.values, pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())],
                    names=["row", "n_words", "n_removed", "out"],
                )

    done = work_on.select("rows", "sizes", "texts", "phrases", "whole", "confirmed").mapInArrow(work, out_schema)
    return done.select(*(F.col("row").getField(f.name).alias(f.name) for f in others), "n_words", "n_removed", F.col("out").alias(new[2]))
