"""Shards of near equal bytes by a k-d tree over the documents' metadata.

Documents with equal texts are one unit and stay together; a group that alone outweighs a quarter of a shard is dealt out
over units of at most an eighth. A unit has a place in every dimension: language, source, size, length in characters, and the hash of its text.
A node that is to hold several shards is split, along the dimension in which its units lie widest, where the weights to the left
make up the left shards' part. That weighted quantile is found by histograms: Spark sums the weights of some thousand bins of each
node, the bin that holds the quantile is cut into bins again, until the bin weighs next to nothing. Only bins and cuts, whose number
depends on the number of shards alone, reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwear.runtime import settle

BINS = 2048
_HIGH, _LOW = 20, 40  # a place: its dimension's value in 20 bits, then 40 bits of the unit's hash


@dataclass
class Node:
    """A part of the tree: ``leaves`` shards from ``first`` on; a split one has a dimension, a cut and two children."""

    first: int
    leaves: int
    dim: int = -1
    cut: int = 0
    children: tuple[Node, Node] | None = None

    def open(self) -> list[Node]:
        if self.children:
            return [n for c in self.children for n in c.open()]
        return [self] if self.leaves > 1 else []


def _place(value: Column, unit: Column) -> Column:
    """``value`` from 0 to 1 and the unit's hash as one long, so that no two units share a place and any cut is possible."""
    high = F.least(F.floor(F.greatest(value, F.lit(0.0)) * (1 << _HIGH)), F.lit((1 << _HIGH) - 1)).cast("long")
    return F.shiftleft(high, _LOW) + F.pmod(unit, F.lit(1 << _LOW))


def _named(name: str, text: Column) -> Column:
    """A category's place: its hash, from 0 to 1."""
    return (F.pmod(F.xxhash64(F.lit(name), text), F.lit(1 << _HIGH)) / (1 << _HIGH)).cast("double")


def _leaf(tree: Node, dims: list[str]) -> Column:
    """The number of the first shard of the node that a unit falls into."""
    if tree.children is None:
        return F.lit(tree.first)
    return F.when(F.col(dims[tree.dim]) < tree.cut, _leaf(tree.children[0], dims)).otherwise(_leaf(tree.children[1], dims))


def _split(units: DataFrame, tree: Node, dims: list[str], tolerance: int) -> None:
    """Splits every open node once."""
    nodes = {n.first: n for n in tree.open()}
    tagged = units.withColumn("node", _leaf(tree, dims)).filter(F.col("node").isin(list(nodes)))
    spans = {
        r["node"]: r
        for r in tagged.groupBy("node")
        .agg(F.sum("weight").alias("weight"), *(f(d).alias(f"{g}{k}") for k, d in enumerate(dims) for f, g in ((F.min, "lo"), (F.max, "hi"))))
        .collect()
    }
    search: dict[int, list[int]] = {}
    for first, node in nodes.items():
        span = spans.get(first)
        if span is None:  # no units: any cut will do
            node.dim = 0
            continue
        # Widest by value; dimensions without any width have only their hash bits.
        node.dim = max(range(len(dims)), key=lambda k: (span[f"hi{k}"] - span[f"lo{k}"], -k))
        goal = span["weight"] * (node.leaves // 2) // node.leaves
        search[first] = [span[f"lo{node.dim}"], span[f"hi{node.dim}"] + 1, 0, goal]
    active = dict(search)
    while active:
        value, low, step = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")
        width = {first: max(1, -(-(hi - lo) // BINS)) for first, (lo, hi, _, _) in active.items()}
        for first, (lo, hi, _, _) in active.items():
            here = F.col("node") == first
            place = F.col(dims[nodes[first].dim])
            value = F.when(here & (place >= lo) & (place < hi), place).otherwise(value)
            low, step = F.when(here, F.lit(lo)).otherwise(low), F.when(here, F.lit(width[first])).otherwise(step)
        bins = tagged.select("node", "weight", value.alias("value"), low.alias("low"), step.alias("step")).filter("value IS NOT NULL")
        sums = bins.groupBy("node", ((F.col("value") - F.col("low")) / F.col("step")).cast("long").alias("bin")).agg(F.sum("weight").alias("weight"))
        found: dict[int, list[tuple[int, int]]] = {}
        for node, bin_, weight in sums.collect():  # at most BINS rows a node
            found.setdefault(node, []).append((bin_, weight))
        for first in list(active):
            lo, hi, before, goal = active[first]
            inside = before
            for bin_, weight in sorted(found[first]):
                if inside + weight > goal:
                    break
                inside += weight
            left = lo + bin_ * width[first]
            if width[first] == 1 or weight <= tolerance:
                near = goal - inside > inside + weight - goal
                search[first] = active[first] = [left + width[first] if near else left, 0, 0, 0]
                del active[first]
            else:
                active[first] = search[first] = [left, left + width[first], inside, goal]
    for first, node in nodes.items():
        node.cut = search[first][0] if first in search else 0
        half = node.leaves // 2
        node.children = (Node(node.first, half), Node(node.first + half, node.leaves - half))


def shard_documents(
    documents: DataFrame,
    shards: int | None = 24,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    slot_rows: int = 200_000,
) -> DataFrame:
    """Puts every document into one of ``shards`` shards of near equal bytes, or as many as ``target_bytes`` a shard asks for.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``: size is the UTF-8 bytes of the text (null: none) plus 8,
    the law is ``bytes``, slots count a shard's rows without gaps from 0, and ``grown_shard`` is null. Equal texts share a shard, unless their
    group weighs over a quarter of a shard. Null languages and sources are values of their own. One row for each row of
    the input, repeated rows included; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = documents.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.length(text).cast("long").alias("chars"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text, F.reverse(text)).alias("text_key"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
    )
    meta = settle(meta, "metadata")
    total, rows = meta.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if shards is None:
        shards = max(1, math.ceil(total / max(1, target_bytes or total)))
    leaf = max(1, total // shards)
    # At most four groups a shard are as heavy as this, so their table is small whatever the data.
    heavy = meta.groupBy("text_key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > leaf / 4)
    parts = heavy.select("text_key", F.ceil(F.col("bytes") * 8 / leaf).alias("parts"))
    dealt = meta.join(F.broadcast(parts), "text_key", "left").withColumn(
        "unit", F.when(F.col("parts").isNull(), F.col("text_key")).otherwise(F.xxhash64("text_key", F.pmod(F.xxhash64("id", "source"), "parts")))
    )
    dealt = settle(dealt.drop("parts"), "dealt")
    units = dealt.groupBy("unit").agg(
        F.sum("size").alias("weight"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("size").alias("size"), F.min("chars").alias("chars")
    )
    values = [
        _named("lang", F.col("lang")),
        _named("source", F.col("source")),
        F.log2(F.col("size").cast("double")) / 48,
        F.log2(F.col("chars") + 1.0) / 48,
        F.pmod(F.xxhash64(F.col("unit")), F.lit(1 << _HIGH)) / float(1 << _HIGH),
    ]
    dims = [f"d{k}" for k in range(len(values))]
    units = settle(units.select("unit", "weight", *(_place(v, F.col("unit")).alias(d) for v, d in zip(values, dims, strict=True))), "units")
    tree = Node(0, shards)
    while tree.open():
        _split(units, tree, dims, max(1, leaf // 1000))
    placed = dealt.join(units.select("unit", _leaf(tree, dims).alias("shard")), "unit")
    # Slots: a shard's rows in buckets of bounded size; each bucket begins where the ones before it end.
    buckets = max(1, -(-rows // (shards * slot_rows)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "crc", "source"), F.lit(buckets)).cast("int"))
    placed = settle(placed.select("id", "size", "crc", "shard", "bucket"), "placed")
    counts = placed.groupBy("shard", "bucket").count()
    begins = counts.select(
        "shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("begin")
    )
    numbered = placed.join(settle(begins, "begins"), ["shard", "bucket"])
    in_bucket = Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size")
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("begin") + F.row_number().over(in_bucket) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
