"""Bounded-space best-fit packing of tokenised documents into sequences of a fixed length.

Tokenising and packing are two narrow passes with one shuffle of small piece rows between them; texts and ids never move.
Within a partition pieces come in order of their document and are placed online: a fixed number of bins is open, a
bitset holds which amounts of free space occur among them, and the lowest set bit at or above a piece's length is
the best fit. When no bin fits and all places are taken, the fullest bin closes first.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.llm.bpe import byte_letters, encode_run
from fleetwear.llm.pretokens import PieceStore
from fleetwear.llm.words import column_bytes, runs

OPEN_BINS = 512


class RankCodec:
    """Encodes pieces of a byte-level vocabulary file of the tokenizers library by ranks.

    Merging the pair whose joined bytes rank lowest gives what the file's merge list gives, because every token of
    such a vocabulary is reached by its own merges; the tests check that for the file in use.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.single = tiktoken.Encoding("file", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.lower, self.spaces = False, True

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        return list(map(self.single, words))

    def normal(self, text: str) -> str:
        return text


_ready: dict[str, tuple[RankCodec, PieceStore]] = {}


def ready(path: str) -> tuple[RankCodec, PieceStore]:
    if path not in _ready:
        codec = RankCodec(path)
        _ready[path] = (codec, PieceStore(codec.encode_words))
    return _ready[path]


class OpenBins:
    """Places pieces one after another; ``width`` is a bin's size and ``places`` the number that may be open."""

    def __init__(self, width: int, places: int):
        self.width, self.places = width, places
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(width + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        one = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return one

    def place(self, size: int) -> tuple[int, int]:
        """The bin for a piece and the piece's place in it."""
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            one = self._take(free)
        else:
            free, one = self.width, self.made
            self.made += 1
        left = free - size
        if left:
            if self.count == self.places:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(one)
            self.bits |= 1 << left
            self.count += 1
        return one, self.width - free


def tokenise(documents: DataFrame, path: str, end_id: int, width: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """One row for each piece of at most ``width`` ids: where it starts, how long it is, the CRC-32 of its ids."""
    kind = dict(documents.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, store = ready(path)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in runs(offsets):
                ids, cut = encode_run(codec, store, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                size = np.diff(cut) + 1
                pieces = -(-size // width)
                head = size - (pieces - 1) * width
                of = np.repeat(np.arange(len(size)), pieces)
                number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(number == 0, 0, head[of] + (number - 1) * width)
                length = np.where(number == 0, head[of], width)
                flat = np.insert(ids.astype("<u4"), cut[1:], end_id).astype("<u4")
                begin = (np.cumsum(size) - size)[of] + start
                raw = flat.tobytes()
                crc = [zlib.crc32(raw[4 * p : 4 * (p + n)]) for p, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [
                    batch.column(0).take(pa.array(of + a)),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.array([flat[p : p + n].astype(np.int32) for p, n in zip(begin, length, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(work, schema)


def pack(pieces: DataFrame, width: int, id_col: str, places: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to piece rows with a ``length`` of at most ``width``."""
    from pyspark.sql.types import LongType, StructType

    # The rule deals pieces out evenly, copies of a document included, and alike on every attempt.
    dealt = pieces.repartition(F.xxhash64(F.col(id_col), "piece", "start", "length", "ids_crc32"))
    ordered = dealt.sortWithinPartitions(id_col, "piece", "ids_crc32")
    schema = StructType(list(ordered.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(width, places)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            sequence = pa.array([base + one for one, _ in placed], pa.int64())
            offset = pa.array([at for _, at in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sequence, offset], names=[*batch.schema.names, "sequence_id", "offset"])

    return ordered.mapInArrow(work, schema)


def pack_documents(
    documents: DataFrame,
    path: str,
    end_id: int = 2,
    width: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    places: int = OPEN_BINS,
    keep_ids: bool = False,
) -> DataFrame:
    """Packs all documents into sequences of at most ``width`` ids.

    A document is the ids of its whole text (a null one: none) and ``end_id``. Only a longer one is cut: its first piece takes
    what is left over by whole pieces of ``width``. Returns ``id_col, piece, start, length, ids_crc32, sequence_id, offset``, with
    ``keep_ids`` also ``ids``. Places in a sequence are gapless from 0. Rows with equal ids are separate documents; a null
    id is kept; an empty table gives no rows; other columns are not read.
    """
    return pack(tokenise(documents, path, end_id, width, id_col, text_col, keep_ids), width, id_col, places)
