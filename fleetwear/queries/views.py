"""The shared test tables seen as sensor data: Spark frames, and the same views as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwear.operators.series import index_series
from fleetwear.runtime import scratch_dir, settle

SENSORS = ["s2", "s3", "s4", "s7"]
ENGINE = ["dataset", "unit"]

# Tags of the stand-in fleets; FD004 is left unmapped on purpose.
TAG_MAP = {
    "FD001": {"s2": "u", "s3": "d", "s4": "o", "s7": "u"},
    "FD002": {"s2": "c", "s3": "c", "s4": "c", "s7": "c"},
    "FD003": {"s2": "u", "s3": "d", "s4": "u", "s7": "d"},
}

TAG_ROWS = ", ".join(f"('{d}', '{s}', '{t}')" for d, sensors in TAG_MAP.items() for s, t in sensors.items())

_settled: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Store a view once per session and folder; every query then scans the stored table."""
    key = (spark.sparkContext.applicationId, scratch_dir(spark), sf_dir, name)
    if key not in _settled:
        _settled[key] = settle(build(), name)
    return _settled[key]


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dataset, unit, cycle, s2, s3, s4, s7`` from ``lineitem``, one engine per supplier."""

    def build() -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").select(
            F.concat(F.lit("FD00"), 1 + F.col("l_suppkey") % 4).alias("dataset"),
            F.col("l_suppkey").alias("unit"),
            "l_shipdate",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            F.col("l_quantity").alias("s2"),
            F.col("l_extendedprice").alias("s3"),
            F.col("l_discount").alias("s4"),
            F.col("l_tax").alias("s7"),
        )
        order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", *SENSORS]
        return index_series(rows, ["dataset", "unit"], order).select(
            "dataset", "unit", (F.col("i") + 1).alias("cycle"), *SENSORS
        )

    return _once(spark, sf_dir, "readings", build)


READINGS = """
readings AS (
  SELECT concat('FD00', CAST(1 + l_suppkey % 4 AS VARCHAR)) AS dataset, l_suppkey AS unit,
    CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
      l_quantity, l_extendedprice, l_discount, l_tax) AS INTEGER) AS cycle,
    l_quantity AS s2, l_extendedprice AS s3, l_discount AS s4, l_tax AS s7
  FROM lineitem)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``unit, i, n, y, state`` from ``events``, one series per user."""

    def build() -> DataFrame:
        rows = table(spark, sf_dir, "events").select(
            F.col("user_id").alias("unit"), "ts", "event_id", F.col("value").alias("y"), F.col("event_type").alias("state")
        )
        return index_series(rows, ["unit"], ["ts", "event_id"]).select("unit", "i", "n", "y", "state")

    return _once(spark, sf_dir, "series", build)


SERIES = """
series AS (
  SELECT user_id AS unit, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i,
    CAST(count(*) OVER (PARTITION BY user_id) AS INTEGER) AS n, value AS y, event_type AS state
  FROM events)"""


def tags(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {TAG_ROWS} AS tags(dataset, sensor, tag)")


TAGS = f"\ntags(dataset, sensor, tag) AS (VALUES {TAG_ROWS})"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, features ARRAY<DOUBLE>, label``."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label")
    )


VECTORS = """
vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS features, CAST(label AS INTEGER) AS label FROM embeddings)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, scenario, label, prediction``: a fixed rule that errs more as the scenario grows."""
    rows = vectors(spark, sf_dir).select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("scenario"))
    wrong = (F.col("vec_id") % (7 - F.col("scenario"))) == 0
    return rows.withColumn("prediction", ((F.col("label") + F.when(wrong, 1).otherwise(0)) % 10).cast("int"))


PREDICTIONS = (
    VECTORS
    + """,
predictions AS (
  SELECT vec_id, label, scenario,
    CAST((label + CASE WHEN vec_id % (7 - scenario) = 0 THEN 1 ELSE 0 END) % 10 AS INTEGER) AS prediction
  FROM vectors, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS scenario) g)"""
)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, teacher, student``: slices of the vector as four-class scores, label folded to 0..3."""
    return vectors(spark, sf_dir).select(
        "vec_id",
        (F.col("label") % 4).cast("int").alias("label"),
        F.slice("features", 1, 4).alias("teacher"),
        F.slice("features", 5, 4).alias("student"),
    )


LOGITS = (
    VECTORS
    + """,
logits AS (
  SELECT vec_id, CAST(label % 4 AS INTEGER) AS label, features[1:4] AS teacher, features[5:8] AS student FROM vectors)"""
)
