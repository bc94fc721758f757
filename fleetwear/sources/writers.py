"""Writers: tables in any format, scenario layout, tag maps, models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from threading import Lock

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCENARIO_LAYOUT = ["source", "scenario", "phase"]
OPEN_FILES = 16  # files a task may write at a time
_OPEN_FILES_CONF = "spark.sql.maxConcurrentOutputFileWriters"
_setting = Lock()


@contextmanager
def _files_side_by_side(spark: SparkSession) -> Iterator[None]:
    """Tasks keep a file open for each folder instead of sorting all their rows by folder; beyond ``OPEN_FILES`` they sort."""
    with _setting:
        before = spark.conf.get(_OPEN_FILES_CONF)
        spark.conf.set(_OPEN_FILES_CONF, str(max(OPEN_FILES, int(before))))
        try:
            yield
        finally:
            spark.conf.set(_OPEN_FILES_CONF, before)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write parquet, csv (with header), json or text."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if not partition_by:
        writer.save(path)
        return
    with _files_side_by_side(df.sparkSession):
        writer.partitionBy(*partition_by).save(path)


def write_scenarios(df: DataFrame, root: str, source: str, phase: str, mode: str = "append") -> None:
    """Add scenario rows to the ``source / scenario / phase`` layout.

    Each scenario is stored once; stacked sets are read by filter, so no scenario is ever rewritten.
    """
    marked = df.withColumns({"source": F.lit(source), "phase": F.lit(phase)})
    write_table(marked, root, partition_by=SCENARIO_LAYOUT, mode=mode)


def tag_maps(tags: DataFrame) -> DataFrame:
    """One row per dataset: ``dataset, tags MAP<sensor, tag>``, sensors in order."""
    pairs = F.array_sort(F.collect_list(F.struct("sensor", "tag")))
    return tags.groupBy("dataset").agg(F.map_from_entries(pairs).alias("tags"))


def merge_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """All old tags, and the new ones of sensors that had none."""
    return old.select("dataset", "sensor", "tag").unionByName(untagged(new, old).select("dataset", "sensor", "tag"))


def untagged(df: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows whose ``(dataset, sensor)`` has no tag yet."""
    return df.join(tags.select("dataset", "sensor"), ["dataset", "sensor"], "left_anti")


def mapped_only(df: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows of datasets that have tags."""
    return df.join(tags.select("dataset").distinct(), "dataset", "left_semi")


def join_tags(long_df: DataFrame, tags: DataFrame) -> DataFrame:
    """Long readings with the tag of their sensor; sensors without a tag are dropped."""
    return long_df.join(tags, ["dataset", "sensor"])


def write_tags(tags: DataFrame, path: str) -> None:
    """The map as one JSON document (a document of datasets x sensors, not of rows)."""
    document = tag_maps(tags).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("dataset", "tags")))).alias("value"))
    document.write.mode("overwrite").text(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str, kind=PipelineModel):
    return kind.load(path)
