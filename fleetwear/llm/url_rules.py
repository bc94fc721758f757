"""URL filtering: listed rules by host and path first, then association rules that FP-growth mines from labelled URLs.

A URL is a basket of tokens: its scheme, every suffix of its host from two labels on, the words of compound labels, its path segments by place, and the
pairs of its query. No token is implied by another, so that item sets stay few. FP-growth runs over the baskets of labelled URLs together with the label as one more token. Of the rules with
a label on their right side those are kept whose support and confidence hold, the latter also at the lower end of its
interval, and that no shorter rule already covers. A kept rule stands in an inverted index under its rarest token, so a URL
meets a rule only where it holds that token. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwear.runtime import settle

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "=block", "=allow"

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its own; the longest wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``; null where none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL. Runs of digits count as one token, so that numbered pages share it."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    parts = F.split(host, r"\.")
    size = F.size(parts)
    hosts = F.transform(
        F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(parts, k, size), "."))
    )
    compound = F.filter(parts, lambda x: x.rlike("[-_]"))
    words = F.flatten(F.transform(compound, lambda x: F.transform(F.split(x, "[-_]"), lambda w: F.concat(F.lit("word:"), w))))
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda x: x != ""),
        lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), F.regexp_replace(x, r"[0-9]+", "0")),
    )
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    values = F.transform(pairs, lambda x: F.concat(F.lit("pair:"), F.regexp_replace(x, r"[0-9]+", "0")))
    scheme = F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1))
    found = F.concat(F.array(scheme), hosts, words, segments, values)
    return F.when(url.contains("://"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules from baskets (``tokens``, ``label``): ``items, verdict, confidence, support, n``.

    The interval is Wilson's at two standard errors; its lower end must exceed the share of the label among all
    baskets and one half.
    """
    baskets = labelled.select(F.concat("tokens", F.array("label")).alias("items"), "label")
    baskets = settle(baskets, "baskets")
    total = baskets.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("label") == BLOCK).alias("blocked")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.get("consequent", F.lit(0)).isin(BLOCK, ALLOW))
    rules = rules.crossJoin(F.broadcast(total))  # one row
    n = F.greatest(F.round(F.col("support") * F.col("all") / F.col("confidence")), F.lit(1.0))
    p = F.col("confidence")
    low = (p + 2 / n - 2 * F.sqrt(p * (1 - p) / n + 1 / (n * n))) / (1 + 4 / n)
    prior = F.when(F.get("consequent", F.lit(0)) == BLOCK, F.col("blocked")).otherwise(F.col("all") - F.col("blocked")) / F.col("all")
    kept = rules.filter(low > F.greatest(prior, F.lit(0.5)))
    return kept.select(
        F.array_sort("antecedent").alias("items"),
        F.translate(F.get("consequent", F.lit(0)), "=", "").alias("verdict"),
        "confidence",
        "support",
        n.cast("long").alias("n"),
    )


def index_rules(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Each rule under its rarest token, without those that a shorter rule with no less confidence covers."""
    listed_ = settle(rules.withColumn("rule_id", F.xxhash64("items", "verdict")), "rules")
    tokens = listed_.select("rule_id", F.explode("items").alias("token")).join(counts, "token", "left")
    rarest = tokens.groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("key"))
    keyed = settle(listed_.join(rarest, "rule_id"), "index")
    parts = keyed.select("rule_id", "items", "verdict", "confidence", F.explode("items").alias("key"))
    wider = (
        parts.alias("a")
        .join(keyed.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.rule_id") != F.col("b.rule_id")))
        .filter((F.size("b.items") < F.size("a.items")) & (F.col("b.verdict") == F.col("a.verdict")))
        .filter((F.col("b.confidence") >= F.col("a.confidence")) & (F.size(F.array_except("b.items", "a.items")) == 0))
        .select(F.col("a.rule_id").alias("rule_id"))
        .distinct()
    )
    return keyed.join(wider, "rule_id", "left_anti")


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    min_support: float = 0.002,
    min_confidence: float = 0.6,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
) -> DataFrame:
    """A verdict for every page: the longest listed rule's, else the best mined rule's, else ``allow``.

    ``labels`` holds ``label_id, quality, toxic``; a page with its id is a labelled one, blocked when its quality is 0 or it is
    toxic. Returns ``id_col, host, path, rule, verdict, mined array<string>`` (the tokens of the mined rule used, else null). The best
    mined rule has the highest confidence, then support, then most tokens. A null url, or one without ``://``, has empty host and path, no
    tokens and the verdict ``allow``. One row for each row of ``pages``, repeated rows included; without labelled rows nothing is
    mined; other columns are not read.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    marked = labels.select(
        F.col(label_id).alias("id"),
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), BLOCK).otherwise(ALLOW).alias("label"),
    ).filter(F.col("id").isNotNull())
    seen = base.filter(F.col("url").contains("://")).join(marked, "id").select(tokens_of(F.col("url")).alias("tokens"), "label")
    found = settle(mine(seen, min_support, min_confidence), "mined")
    urls = settle(
        base.filter(F.col("url").contains("://"))
        .filter(listed(host_of(F.col("url")), path_of(F.col("url")), rules).isNull())
        .groupBy("url")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("tokens", tokens_of(F.col("url"))),
        "urls",
    )
    token_rows = urls.select("url", "tokens", F.explode("tokens").alias("key"))
    counts = token_rows.groupBy(F.col("key").alias("token")).count()
    needed = found.select(F.explode("items").alias("token")).distinct()
    index = settle(index_rules(found, settle(counts.join(needed, "token"), "counts")), "pruned")
    hits = (
        token_rows.join(index, "key")
        .filter(F.size(F.array_except("items", "tokens")) == 0)
        .groupBy("url")
        .agg(F.max(F.struct("confidence", "support", F.size("items").alias("n"), "verdict", "items")).alias("best"))
        .select("url", F.col("best.verdict").alias("mined_verdict"), F.col("best.items").alias("mined"))
    )
    told = base.join(settle(hits, "hits"), "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    told = told.withColumn("host", host).withColumn("path", path).withColumn("by", listed(F.col("host"), F.col("path"), rules))
    return told.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("by.rule").alias("rule"),
        F.coalesce("by.verdict", "mined_verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("by").isNull(), F.col("mined")).alias("mined"),
    )
