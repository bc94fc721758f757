"""The factorization machine: its sum over pairs against a loop, its gradient, pairs that a linear score misses, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import plain
import pytest

from fleetwear.llm import toxicity
from fleetwear.llm.words import column_bytes


def test_score_is_the_sum_over_terms_and_pairs():
    rng = np.random.default_rng(1)
    model = toxicity.Model(0.3, np.array([2, 5, 9, 11]), rng.normal(size=4), rng.normal(size=(4, 3)))
    texts = [[2, 9, 40], [], [5, 9, 11, 2], [7]]
    text, bucket = np.repeat(np.arange(4), list(map(len, texts))), np.array([b for t in texts for b in t])
    got = model.score(text, bucket, 4)
    for t, p in zip(texts, got, strict=True):
        at = [model.buckets.tolist().index(b) for b in t if b in model.buckets]
        z = 0.3 + sum(model.weights[i] for i in at) + sum(model.factors[i] @ model.factors[j] for i in at for j in at if i < j)
        assert p == pytest.approx(1 / (1 + np.exp(-z)))


def test_terms_are_words_and_stems_once_each():
    import pyarrow as pa

    data, offsets = column_bytes(pa.array(["Abcdefg, abcdefg! ab", None, "", "abcdxyz é"]))
    text, bucket = toxicity.terms(data, offsets)
    assert np.bincount(text, minlength=4).tolist() == [5, 0, 0, 5]  # abcdefg, abcd, abcde, abcdef, ab; and the same with é for ab
    assert len(set(bucket[text == 0]) & set(bucket[text == 3])) == 1  # abcd
    assert all(np.diff(text << toxicity.BITS | bucket) > 0)


def harsh(n: int, seed: int = 4):
    """Toxic only where an insult and a group occur together; each alone is as common among the harmless."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"filler{rng.randrange(300)}" for _ in range(20)]
        kind = k % 4
        if kind in (0, 1):
            words.insert(rng.randrange(20), "rotten")
        if kind in (0, 2):
            words.insert(rng.randrange(20), "newcomers")
        rows.append((k, " ".join(words), int(kind == 0)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = harsh(2000)
    docs = spark.createDataFrame([(k, t, 0.5, 3) for k, t, _ in rows], "doc_id long, text string, score double, y int").repartition(4)
    return docs.cache(), spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int").cache()


def test_pairs_say_what_single_terms_do_not(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    truth = {k: y for k, _, y in harsh(2000)}
    got = toxicity.classify(docs, model).collect()
    assert len(got) == 2000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) for r in got)
    # The same terms without their vectors cannot: an insult alone and a group alone are then as bad as half of both.
    both, one = (abs(float(toxicity.Model(model.intercept, model.buckets, model.weights, 0 * model.factors).score(*parts, 1)[0])) for parts in terms_of("rotten newcomers", "rotten"))
    full, single = (float(model.score(*parts, 1)[0]) for parts in terms_of("rotten newcomers", "rotten"))
    assert full > 0.5 > single and full - single > both - one


def terms_of(*texts: str):
    import pyarrow as pa

    for t in texts:
        yield toxicity.terms(*column_bytes(pa.array([t])))


def test_held_out_labels_do_not_matter(tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.train(docs, labels, max_rows=300), toxicity.train(docs, flipped, max_rows=300)
    assert one.intercept == two.intercept and (one.factors == two.factors).all()


def test_labels_of_one_class_no_labels_and_odd_rows(spark, tables):
    docs = plain.documents(spark)
    labels = spark.createDataFrame([(k, 1, 1) for k in range(40)] + [(None, 1, 1), (3, 0, None), (4, 0, 7)], "doc_id long, quality int, toxic int")
    for given, expected in ((labels, 1), (labels.filter("false"), 1)):
        got = toxicity.classify(docs, toxicity.train(docs, given)).collect()
        assert len(got) == len(plain.rows()) and {r.predicted for r in got} == {expected}
        assert len({r.score for r in got}) == 1
    none = plain.documents(spark, none=True)
    assert toxicity.classify(none, toxicity.train(none, labels)).collect() == []
    score = lambda t: toxicity.classify(spark.createDataFrame([(1, t)], "doc_id long, text string"), toxicity.train(*tables)).first().score
    assert score(None) == score("") == score(" \n") and 0 < score(None) < 0.5


def test_repeated_ids_with_many_texts_stay_bounded(spark):
    rows = [(1 if k % 2 else k, t, None) for k, t, _ in harsh(400)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    labels = spark.createDataFrame([(k, y) for k, _, y in harsh(400)] + [(1, 1), (1, 0)], "doc_id long, toxic int")
    found = toxicity._labelled(docs, labels, 50, "doc_id", "text", "toxic")
    assert found.count() == 50 and found.select("h").distinct().count() == 50
