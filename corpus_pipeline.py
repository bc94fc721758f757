"""A training corpus from raw documents: filter by rules and by a classifier, drop near duplicates, cut repeats, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwear.llm import catalog
from fleetwear.llm.jaccard_join import near_duplicates
from fleetwear.llm.packing import pack_documents
from fleetwear.llm.quality_model import keep_good, train
from fleetwear.llm.quality_rules import judge
from fleetwear.llm.repeats import remove_repeats
from fleetwear.runtime import scratch_path, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents whose id and text hash are in ``chosen``."""
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("c.text_hash"))
    return docs.alias("d").join(chosen.alias("c"), same, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counts or lie too far from their language's histograms go."""
    kept = settle(judge(docs).filter("kept").select("doc_id", "text_hash"), "kept")
    return _rows_of(docs, kept)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores below 0.3 go; it learns from the labels of what the rules left."""
    return keep_good(docs, train(docs, catalog.table(spark, sf_dir, "labels")))


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component under links of five-word shingle sets of at least 80 % similarity stays, the smallest id.

    Documents without words have no links and stay. Of rows that agree in id and text one stays if they have words.
    """
    found = near_duplicates(docs, size=5, percent=80).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = found.groupBy("doc_id", "text_hash").agg(
        F.when(F.max("n_shingles") > 0, F.count(F.lit(1))).otherwise(1).alias("rows")
    )
    chosen = settle(chosen, "chosen")
    single = _rows_of(docs, chosen.filter("rows = 1"))
    return single.union(_rows_of(docs, chosen.filter("rows > 1")).dropDuplicates(["doc_id", "text"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated windows of 35 words go; no document does."""
    cut = remove_repeats(docs, window=35)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of 1024 ids."""
    return pack_documents(docs, catalog.tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicate_join", near_duplicate_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Byte-pair ids and the fitted model have no SQL form; the stages are tested one by one against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
