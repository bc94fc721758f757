"""The pipeline's stages one after another, each judged on its own input."""

from __future__ import annotations

import plain

import corpus_pipeline
from fleetwear.llm import catalog
from fleetwear.llm.quality_model import classify, train

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    odd = plain.documents(spark).filter("doc_id IS NOT NULL").selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")
    docs = docs.union(odd).cache()
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicate_join", "substring_dedup", "best_fit_packing"]

    kept = steps["quality_rules"](spark, docs, SF).cache()
    assert kept.columns == columns
    counts = [plain.base_counts(r.text) for r in kept.collect()]
    assert counts and all(c[0] >= 50 and 100 * c[4] <= 50 * c[0] for c in counts)

    good = steps["quality_classifier"](spark, kept, SF).cache()
    model = train(kept, catalog.table(spark, SF, "labels"))
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in classify(kept, model).filter("predicted = 1").collect())

    before = good.collect()
    single = steps["near_duplicate_join"](spark, good, SF).cache()
    of = plain.reachable([plain.shingles(r.text, 5) for r in before], 80)
    least: dict[int, int] = {}
    for r, c in zip(before, of, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(least.values()))

    rows = single.collect()
    cut = {r.doc_id: r for r in steps["substring_dedup"](spark, single, SF).collect()}
    for r, (w, gone) in zip(rows, plain.without_repeats([r.text for r in rows], 35), strict=True):
        text = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else r.text
        assert cut[r.doc_id].text == text

    packed = steps["best_fit_packing"](spark, single, SF)
    assert packed.select("doc_id").distinct().count() == single.count()


def test_repeated_rows_and_empty_texts_in_the_near_duplicate_stage(spark):
    rows = [(1, "", None, None, 0), (1, "", None, None, 0), (2, None, None, None, 0), (3, "a b c d e f", "en", "s", 1), (3, "a b c d e f", "en", "s", 1), (4, "a b c d e f", "en", "s", 1), (None, "x y z", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_join(spark, docs, SF).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted([1, 1, 2, 3, None], key=repr)


def test_run_returns_packed_pieces(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
