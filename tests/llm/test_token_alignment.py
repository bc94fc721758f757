"""Token alignment against whole-text tokenising and the groups written out pair by pair."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetwear.llm import token_alignment as alignment
from fleetwear.llm.bpe import byte_letters
from fleetwear.llm.catalog import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def texts() -> list[str | None]:
    rng = random.Random(3)
    bag = ["foo", "bar's", "naïve", "12345", "  ", "\n", "日本", "!!", "zzzzqqq"]
    odd = ["é▁x", "x\0y  z ", "<s> a</s>", " " * 70, "日本 語" * 40, " ".join(rng.choice(bag) for _ in range(900)), "ab" * 800, " "]
    return plain.texts() + odd


def plain_groups(text: str | None) -> list[tuple[list[int], list[int]]]:
    if not text:
        return []
    byte_level, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    byte_level.encode_special_tokens = True
    back = {c: b for b, c in byte_letters().items()}
    one = byte_level.encode(" " + text, add_special_tokens=False)
    bytes_a = [bytes(back[c] for c in t) for t in one.tokens]
    ids_b = pieces.encode(text)
    spelled = [pieces.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, spelled, strict=True)]
    if not b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
        return []
    ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
    out, lo = [], 0
    for hi in sorted(set(ends_a) & set(ends_b)):
        out.append(([i for i, e in zip(one.ids, ends_a, strict=True) if lo < e <= hi], [i for i, e in zip(ids_b, ends_b, strict=True) if lo < e <= hi]))
        lo = hi
    return out


def plain_rows(all_texts: list[str | None]) -> list[tuple]:
    docs = [plain_groups(t) for t in all_texts]
    count: Counter = Counter()
    for groups in docs:
        count.update({(a, b) for x, y in groups for a in x for b in y})
    top: dict = defaultdict(int)
    for (a, _), c in count.items():
        top[a] = max(top[a], c)
    out = []
    for groups in docs:
        links = [(a, b) for x, y in groups for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        tokens = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups))
        out.append((*tokens, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), text))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    every = [(k % 40 if k % 7 else None, t, "x", 1) for k, t in enumerate(texts())]
    every += every[9:11]
    frame = spark.createDataFrame(every, "doc_id long, text string, block string, key int").repartition(3).cache()
    want = plain_rows([r[1] for r in every])
    return frame, sorted((repr(r[0]), *w) for r, w in zip(every, want, strict=True))


@pytest.mark.parametrize("long_bytes", [1 << 16, 300])
def test_same_groups_and_counts_whole_or_in_fragments(rows, long_bytes):
    frame, want = rows
    got = alignment.align_texts(frame, A, B, long_bytes=long_bytes).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == want


def test_digests(rows):
    frame, want = rows
    got = alignment.align_texts(frame, A, B, digest=True, long_bytes=100).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert sorted((repr(r[0]), r.groups_sha256) for r in got) == sorted((w[0], digest(w[-1])) for w in want)


def test_empty_table(rows):
    frame, _ = rows
    assert alignment.align_texts(frame.filter("false"), A, B).collect() == []


def test_very_long_word(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(6000)) + " " + "end of it " * 300
    got = alignment.align_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B, long_bytes=1024).collect()
    assert [tuple(r)[1:] for r in got] == plain_rows([text])


ends = st.lists(st.integers(1, 60), unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(ends, ends, st.lists(st.integers(1, 60), unique=True, max_size=6).map(sorted), st.integers(0, 5))
def test_fragments_compose_in_any_order(ends_a, ends_b, cuts, pick):
    """Any cut into ranges and any order of composing neighbours gives the groups of the whole."""
    end_a, end_b = np.array([*ends_a, 61], np.int64), np.array([*ends_b, 61], np.int64)
    ids_a, ids_b = np.arange(len(end_a)), 100 + np.arange(len(end_b))

    def closed(parts):
        a, g_a, b, g_b = parts
        return [(a[g_a == g].tolist(), b[g_b == g].tolist()) for g in range(int(g_a[-1]) + 1 if len(g_a) else 0)]

    edges, found, line = [0, *cuts, 61], [], []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        in_a, in_b = (end_a > lo) & (end_a <= hi), (end_b > lo) & (end_b <= hi)
        fragment, inner = alignment.range_fragment(ids_a[in_a], end_a[in_a], ids_b[in_b], end_b[in_b], lo)
        found += closed(inner)
        line.append(fragment)
    while len(line) > 1:
        k = pick % (len(line) - 1)
        line[k], group = alignment.compose(line[k], line.pop(k + 1))
        found += [group[:2]] if group else []
    assert not line[0].suf_a and not line[0].suf_b
    found.append((line[0].pre_a, line[0].pre_b))
    want, lo = [], 0
    for hi in sorted(set(end_a.tolist()) & set(end_b.tolist())):
        want.append((ids_a[(end_a > lo) & (end_a <= hi)].tolist(), ids_b[(end_b > lo) & (end_b <= hi)].tolist()))
        lo = hi
    assert sorted(found) == sorted(want)


def test_large_groups_are_counted_without_writing_their_links():
    ids_a, ids_b = np.array([7] * 100 + [8] * 50), np.array([3] * 60 + [4] * 40)
    doc, pair, times, links = alignment.linked(ids_a, np.zeros(150, np.int64), ids_b, np.zeros(100, np.int64), np.zeros(1, np.int64), 1)
    assert links.tolist() == [15_000] and doc.tolist() == [0] * 4
    assert dict(zip(((int(p) >> 20, int(p) & 0xFFFFF) for p in pair), times.tolist(), strict=True)) == {(7, 3): 6000, (7, 4): 4000, (8, 3): 3000, (8, 4): 2000}
