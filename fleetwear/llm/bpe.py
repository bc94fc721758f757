"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A list of tokens is what the merge rules make of a word exactly when every two neighbours are compatible: the rules make
the same two tokens of the two spelled out together. So the encoder takes the longest token at each place, found for a
whole batch of words by one Aho-Corasick automaton, checks it against the token before through a pair table that is
filled as pairs turn up, and goes back to shorter tokens where a pair fails. A place that has failed once is never tried
again, so the work for a word is linear in its length.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.llm.pretokens import PieceStore, spans
from fleetwear.llm.words import column_bytes, runs

_END = 0x4000


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte: itself where printable, else the next above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return out


class Codec:
    """A vocabulary file of the tokenizers library (byte letters, merges, optional word ends), ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = '"Lowercase"' in json.dumps(spec.get("normalizer"))
        self.spaces = not self.suffix
        self.joined = spec.get("decoder") is None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.letters: list[str] = [""] * size
        self.pair: dict[tuple[int, int], int] = {}
        made = {a + b for a, b in merges}
        for text, i in vocab.items():
            if text not in made:
                core = text.removesuffix(self.suffix) if self.suffix and text != self.suffix else text
                self.letters[i] = core if core == text else core[:-1] + chr(ord(core[-1]) + _END)
        for r, (a, b) in enumerate(merges):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.rank[t], self.left[t], self.right[t] = r, x, y
            self.letters[t] = self.letters[x] + self.letters[y]
            self.pair[x, y] = r
        self.table: dict[int, bool] = {}
        self._build()
        text_of = [""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            text_of[i] = text
        if self.joined:
            raw = [f" {t}".encode() for t in text_of]
        else:
            back = {c: b for b, c in byte_letters().items()}
            raw = [t.encode() if t in self.special else bytes(back[c] for c in t) for t in text_of]
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.offset = np.cumsum([0, *map(len, raw)])
        self.decimal = [str(i) for i in range(size)]
        letters = byte_letters()
        self.translate = {b: letters[b] for b in range(256)}

    def _build(self) -> None:
        """The automaton over every token that the merges really reach, and each token's longest proper prefix token."""
        alive = [False] * len(self.letters)
        at: dict[str, int] = {}
        for i in sorted((i for i, t in enumerate(self.letters) if t), key=lambda i: self.rank[i]):
            a, b = self.left[i], self.right[i]
            alive[i] = self.rank[i] < 0 or alive[a] and alive[b] and self._fits(a, b, self.rank[i])
            if alive[i]:
                at[self.letters[i]] = i
        self.shorter = [-1] * len(self.letters)
        self.size = [len(t) for t in self.letters]
        self.automaton = ahocorasick.Automaton()
        for text, i in at.items():
            self.automaton.add_word(text, i)
            for k in range(len(text) - 1, 0, -1):
                if (j := at.get(text[:k])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton.make_automaton()

    def _fits(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` comes before rank ``limit``.

        Undoes the merges along the border, the latest first. A merge across happens when its rank is below that of
        the merge undone last, which would have used up one of its sides; of equal ranks the one further left is first.
        """
        rank, pair = self.rank, self.pair
        while True:
            r = pair.get((a, b))
            if r is not None and r < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 4_000_000:
                self.table.clear()
            known = self.table[key] = self._fits(a, b, 1 << 60)
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; a word is one piece of the split pattern and not empty."""
        spelled = [w.decode("latin-1").translate(self.translate) for w in words]
        if self.suffix:
            spelled = [w[:-1] + chr(ord(w[-1]) + _END) for w in spelled]
        line = "\0".join(spelled)
        longest = [-1] * (len(line) + 1)
        size = self.size
        for end, i in self.automaton.iter(line):
            longest[end + 1 - size[i]] = i  # ends only grow, so the longest comes last
        out, at = [], 0
        for w in spelled:
            out.append(self._word(longest, at, at + len(w)))
            at += len(w) + 1
        return out

    def _word(self, longest: list[int], begin: int, stop: int) -> list[int]:
        size, shorter, table = self.size, self.shorter, self.table
        tokens: list[int] = []
        dead: set[int] = set()
        at, token = begin, longest[begin]
        while at < stop:
            last = tokens[-1] if tokens else -1
            while token >= 0:
                if at + size[token] not in dead:
                    if last < 0:
                        break
                    ok = table.get(last << 20 | token)
                    if ok or (ok is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += size[token]
                token = longest[at]
            else:
                if not tokens:
                    raise ValueError("a letter is missing from the vocabulary")
                dead.add(at)
                token = tokens.pop()
                at -= size[token]
        return tokens

    def normal(self, text: str) -> str:
        """NFC and lower case of each character by itself, as the vocabulary asks."""
        if not self.lower:
            return text
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, cut from one blob by the offset table."""
        if not len(ids):
            return b""
        begin = self.offset[ids]
        length = self.offset[ids.astype(np.int64) + 1] - begin
        ends = np.cumsum(length)
        out = self.blob[np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)].tobytes()
        return out[1:] if self.joined else out.decode("utf-8", "replace").encode()


def encode_run(codec: Codec, store: PieceStore, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run of texts and the ``n + 1`` offsets of each text's ids. A special token's spelling gives its id."""
    raw = None
    marks = [s.encode() for s in codec.special]
    if codec.special or codec.lower and len(data) and data.max() >= 128:
        raw = data.tobytes()
    parts = None
    if raw is not None and any(m in raw for m in marks):
        parts = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            parts.append(_split(raw[a:b], codec.special))
    elif codec.lower and raw is not None and len(data) and data.max() >= 128:
        parts = [[raw[a:b]] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    if parts is None:
        low = data
        if codec.lower:
            low = np.where((data >= 65) & (data < 91), data + 32, data).astype(np.uint8)
        first, last, begin = spans(low, offsets, codec.spaces)
        ids, count = store.ids(low, first, last)
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[begin]
    flat = [p for each in parts for p in each]
    texts = [codec.normal(p.decode()).encode() if isinstance(p, bytes) else b"" for p in flat]
    inner = np.cumsum([0, *map(len, texts)])
    low = np.frombuffer(b"".join(texts), np.uint8)
    first, last, begin = spans(low, inner, codec.spaces)
    ids, count = store.ids(low, first, last)
    cuts = np.concatenate([[0], np.cumsum(count)])[begin]
    if any(isinstance(p, int) for p in flat):
        pieces = [ids[cuts[k] : cuts[k + 1]] if isinstance(p, bytes) else np.array([p], ids.dtype) for k, p in enumerate(flat)]
        cuts = np.cumsum([0, *map(len, pieces)])
        ids = np.concatenate(pieces)
    return ids, cuts[np.cumsum([0, *map(len, parts)])]


def _split(text: bytes, special: dict[str, int]) -> list[bytes | int]:
    """``text`` cut at the spellings of special tokens, the leftmost first and of those the longest."""
    out: list[bytes | int] = []
    while True:
        found = [(k, -len(s), i) for s, i in special.items() if (k := text.find(s.encode())) >= 0]
        if not found:
            return [*out, text]
        k, size, i = min(found)
        out += [text[:k], i]
        text = text[k - size :]


_ready: dict[str, tuple[Codec, PieceStore]] = {}


def ready(path: str) -> tuple[Codec, PieceStore]:
    """The codec of a file and its store of pieces, one of each a process."""
    if path not in _ready:
        codec = Codec(path)
        _ready[path] = (codec, PieceStore(codec.encode_words))
    return _ready[path]


def encode_texts(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Every whole text as token ids, and the ids decoded again.

    Returns ``id_col, n_tokens, ids array<int>, decoded string``; with ``digest``, instead of the last two,
    ``ids_sha256`` (of the decimal ids joined by one blank) and ``decoded_sha256``. A null text counts as empty and gives no
    ids. One row for each row of the input, repeated ids included; other columns are not read. The work is one
    narrow pass over the input. ``path`` must be readable on every executor.
    """
    kind = dict(documents.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, store = ready(path)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            counts, one, two = [], [], []
            for a, b in runs(offsets):
                ids, cut = encode_run(codec, store, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts.append(np.diff(cut))
                if digest:
                    words = list(map(codec.decimal.__getitem__, ids.tolist()))
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    text = codec.decode(ids[lo:hi])
                    if digest:
                        one.append(hashlib.sha256(" ".join(words[lo:hi]).encode()).hexdigest())
                        two.append(hashlib.sha256(text).hexdigest())
                    else:
                        one.append(ids[lo:hi].astype(np.int32))
                        two.append(text.decode())
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            first = pa.array(one, pa.string()) if digest else pa.array(one, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), first, pa.array(two, pa.string())], names=out_names)

    out_names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(work, schema)
