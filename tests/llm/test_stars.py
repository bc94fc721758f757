"""Large groups of near copies around the limit: components as by all pairs, and rows joined in proportion to the group."""

from __future__ import annotations

import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from fleetwear.llm import jaccard_join


def copies(n: int, seed: int = 2) -> list[str]:
    """One text of 100 words and copies with one to three words changed, which put pairs on both sides of 80 %."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(100)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3])):
            words[rng.randrange(100)] = f"e{k}x{rng.randrange(1000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("n", [400, 1200])
def test_near_copies_around_the_limit(spark, monkeypatch, n):
    texts = copies(n)
    last = []
    join = jaccard_join._overlaps

    def counted(rows, t):
        found = join(rows, t)
        last.append(found.count())
        return found

    monkeypatch.setattr(jaccard_join, "_overlaps", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    want = plain.reachable([plain.shingles(t, 5) for t in texts], 80)
    assert [got[k] for k in range(n)] == want
    # Without the turns before it, the last join of 400 copies has 19,118 pairs, a ninth of n * n.
    assert len(last) == 1 and last[0] < n * n / 60


def mixed(n: int, seed: int) -> list[str]:
    """Copies of copies of one text of 80 words: words changed, left out, put in, and ends cut off; some copies quote it in twice its length."""
    rng = random.Random(seed)
    out = [[f"w{k}" for k in range(80)]]
    while len(out) < n:
        words = list(out[0] if rng.random() < 0.6 else rng.choice(out))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            k, how = rng.randrange(len(words)), rng.randrange(3)
            words[k : k + (how < 2)] = [f"e{rng.randrange(60)}"] * (how != 1)
        cut = rng.choice([0, 0, 0, 5, 12, 25])
        words = words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]
        if rng.random() < 0.03:
            words = words + [f"x{rng.randrange(10**6)}" for _ in range(2 * len(words))]
        out.append(words[:400] if len(words) > 10 else list(out[0]))
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 5, 80), (2, 3, 90)])
def test_copies_of_copies(spark, seed, size, percent):
    texts = mixed(300, seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs, size, percent).collect()}
    assert [got[k] for k in range(300)] == plain.reachable([plain.shingles(t, size) for t in texts], percent)


def test_copies_that_cannot_be_similar_do_not_meet(spark, monkeypatch):
    """1,500 copies just beyond the limit from their origin: nothing is left for the join inside the star."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base)]
    for k in range(1500):
        words = list(base)
        for at in rng.sample(range(4, 116, 7), 3):
            words[at] = f"e{k}x{at}"
        texts.append(" ".join(words))
    met = []
    join = jaccard_join._overlaps
    monkeypatch.setattr(jaccard_join, "_overlaps", lambda rows, t: met.append(join(rows, t)) or met[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    assert [got[k] for k in range(1501)] == plain.reachable([plain.shingles(t, 5) for t in texts], 80)
    assert met[0].count() <= 1500


def test_steps_hold_one_table():
    """The driver works on the counters piece by piece: at most the copy that the median takes, and the steps."""
    import tracemalloc

    sketch = np.random.default_rng(3).geometric(0.02, jaccard_join._PART * 16).astype(np.uint64)
    tracemalloc.start()
    steps = jaccard_join._steps(sketch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * sketch.nbytes, peak / sketch.nbytes
    above = (sketch - np.median(sketch)) / (np.sqrt(np.median(sketch)) + 1)
    assert (steps[above <= 0] == 0).all() and (np.diff(steps[np.argsort(above)].astype(int)) >= 0).all()
