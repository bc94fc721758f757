"""Readers: sensor text, CSV, JSON, tag maps, scenario tables, embeddings, importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwear.schema import reading_schema

WHITE = "\t\n\x0b\f\r"  # what counts as a blank in sensor text, beside the blank itself
IMPORTANCE_SCHEMA = "feature string, importance double"
TAG_MAP_TYPE = "map<string,map<string,string>>"


def read_sensor_text(spark: SparkSession, paths: str | Sequence[str], sensors: int = 21) -> DataFrame:
    """Headerless blank-separated readings; ``dataset`` comes from the last ``train_<dataset>`` in the path.

    Runs of blanks count as one, a missing or unreadable field becomes null.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    # Lines without a first field are told from the text, and lines are cut at single blanks: a pattern would be compiled for each.
    lines = spark.read.text(paths).filter(~F.trim("value").rlike(r"^(\s|$)"))
    blanks = F.translate("value", WHITE, " " * len(WHITE))
    lines = lines.select(
        F.array_remove(F.split(blanks, " "), "").alias("p"),
        F.regexp_extract(F.col("_metadata.file_path"), ".*train_([A-Za-z]+[0-9]+)", 1).alias("dataset"),
    )
    fields = [
        F.try_element_at("p", F.lit(place)).try_cast(field.dataType).alias(field.name)
        for place, field in enumerate(reading_schema(sensors).fields, start=1)
    ]
    return lines.select("dataset", *fields)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header; without a schema it is inferred, which reads the file twice (exploration only)."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = True) -> DataFrame:
    """JSON records: one array per file, or one object per line when ``multi_line`` is false (splittable)."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def explode_tags(maps: DataFrame, column: str) -> DataFrame:
    """``dataset, sensor, tag`` rows of nested JSON maps held as text."""
    nested = maps.select(F.explode(F.from_json(column, TAG_MAP_TYPE)).alias("dataset", "_m"))
    return nested.select("dataset", F.explode("_m").alias("sensor", "tag"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """A ``{dataset: {sensor: tag}}`` JSON file as rows."""
    return explode_tags(spark.read.text(path, wholetext=True), "value")


def read_scenarios(
    spark: SparkSession, root: str, source: str = "RAW", phase: str = "train", scenario: int | None = None, stack: bool = False
) -> DataFrame:
    """Rows of one scenario, of all scenarios up to it (``stack``), or of every scenario.

    The table is partitioned by ``source, scenario, phase``, so only the wanted folders are read.
    """
    rows = spark.read.parquet(root).filter((F.col("source") == source) & (F.col("phase") == phase))
    if scenario is None:
        return rows
    return rows.filter(F.col("scenario") <= scenario if stack else F.col("scenario") == scenario)


def read_embeddings(spark: SparkSession, path: str, key: str, vector: str = "embedding") -> DataFrame:
    """``key, embedding ARRAY<FLOAT>``; rows are matched by key, never by position."""
    return spark.read.parquet(path).select(key, F.col(vector).cast("array<float>").alias("embedding"))


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, IMPORTANCE_SCHEMA)


# source name -> reader of one stored scenario; a user adds an embedding source here
SCENARIO_READERS = {name: read_scenarios for name in ("RAW", "BERT", "GPT2", "GEMMA3", "ELECTRA", "T5")}
