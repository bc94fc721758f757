"""The queries of this subpackage, each over a whole given table, with the same query as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwear.llm import toxicity
from fleetwear.llm.bpe import encode_texts
from fleetwear.llm.hard_negatives import mine
from fleetwear.llm.jaccard_join import near_duplicates
from fleetwear.llm.katz import score_texts
from fleetwear.llm.kd_shards import shard_documents
from fleetwear.llm.packing import pack_documents
from fleetwear.llm.posting_lists import nearest
from fleetwear.llm.quality_model import classify, train
from fleetwear.llm.quality_rules import judge
from fleetwear.llm.repeats import remove_repeats
from fleetwear.llm.token_alignment import align_texts
from fleetwear.llm.url_rules import filter_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is installed; the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repetition counts of every document, and the verdict of the histogram distances."""
    return judge(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op2_adaptive_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under links of three-word shingle sets of at least 90 % similarity."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90).drop("class_key", "text_hash")


@query
def op3_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


@query
def op4_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word-end vocabulary, as digests."""
    return encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), digest=True)


@query
def op5_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth embedding."""
    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op6_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by an additive model learned from the labels outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    return classify(documents, train(documents, table(spark, sf_dir, "labels")))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op8_repeated_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows of 35 words, as a digest."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35, digest=True)


@query
def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability under the Katz backoff bigrams of the training documents."""
    return score_texts(table(spark, sf_dir, "documents"))


@query
def op10_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the listed rules and the rules mined from the labels."""
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query
def op11_residue_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding and its five best rows of its label; each seventh row's label is moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLES["op11_residue_gemm"] = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM (SELECT * FROM e WHERE id % 100 = 0) a JOIN e b ON a.id <> b.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


@query
def op12_fragment_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups of tokens of two tokenizers, with the corpus-wide counts of the linked id pairs."""
    documents = table(spark, sf_dir, "documents")
    return align_texts(documents, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), digest=True)


@query
def op13_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score by a factorization machine learned from the labels outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.classify(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))
