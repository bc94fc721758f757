"""Small tables with awkward rows, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, block int, score double"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def texts(seed: int = 5) -> list[str | None]:
    """Copies, near copies, shared passages, short, empty, odd and long texts."""
    rng = random.Random(seed)
    bag = [f"w{k}" for k in range(60)] + ["The", "the", "é", "naïve", "x#y", "3.5", "don't"]
    fresh = lambda n: " ".join(rng.choice(bag) for _ in range(n))
    base, passage = fresh(130), fresh(45)
    out: list[str | None] = [None, "", " \n\t ", "one", "one", "Two words", "two  words", "a b c", "A B C", base, base, base.upper()]
    for k in range(8):
        words = base.split()
        words[15 * k] = f"edit{k}"
        out.append(" ".join(words))
    out += [f"{fresh(20)}\n{passage}\n{fresh(30)}" for _ in range(6)]
    out += [fresh(rng.randint(3, 90)) for _ in range(20)]
    out += ["same line\nsame line\n\nsame line \nend", "go go go go go go go go", fresh(3000), " x y\x1cz", "<|endoftext|> a<|startoftext|>"]
    return out


def rows() -> list[tuple]:
    """The texts as documents: with a repeated row, a repeated id, a null id, null columns, and columns named like our own."""
    out = [(k, t, ["en", "fr", None, "xx"][k % 4], None if k % 5 == 0 else "src0", k, "key", 7, 0.5) for k, t in enumerate(texts())]
    return [*out, out[9], (9, "another text under the same id", "en", "s", 1, None, None, None), (None, out[9][1], None, None, None, None, None, None)]


def documents(spark, none: bool = False):
    return spark.createDataFrame([] if none else rows(), SCHEMA).repartition(3)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    under = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(under)


def shingles(text: str | None, size: int) -> frozenset:
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def reachable(sets: list[frozenset], percent: int) -> list[int]:
    """For each set the number of its component, by comparing all pairs."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


def without_repeats(all_texts: list[str | None], window: int) -> list[tuple[list[str], list[bool]]]:
    words = [WORD.findall(t or "") for t in all_texts]
    times = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((w, gone))
    return out


def followers(pairs: Counter) -> dict:
    out: dict = defaultdict(dict)
    for (h, w), c in pairs.items():
        out[h][w] = c
    return out
