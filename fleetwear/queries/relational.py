"""Projections, filters, joins, aggregates, sorts, set operations and scalar functions on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwear.functions import columns as C
from fleetwear.operators import frames, masking, metrics, neighbours, oversample, reports, scaling, splits
from fleetwear.operators.series import index_series
from fleetwear.queries import views as V
from fleetwear.queries.files import (
    FLAT,
    IMPORTANCE,
    MODEL_VIEWS,
    READING_KEY,
    REPORT_ROWS,
    REPORT_SQL,
    ROUND_FLAT,
    importance,
    model_flat,
    parts,
    report,
    rounded,
)
from fleetwear.queries.registry import query, sql
from fleetwear.schema import PHYSICAL_NAMES
from fleetwear.sources import writers

# projections --------------------------------------------------------------------------------------------------------


@query("p1_drop_columns", sql("SELECT s2, s3, s4, s7 FROM readings", V.READINGS))
def drop_columns(spark, sf):
    return frames.drop_flat(V.readings(spark, sf).withColumns({"set1": F.lit(0.0), "s1": F.lit(1.0), "state": F.lit(0)}))


@query(
    "p2_rename",
    sql(
        "SELECT dataset AS dataset_id, unit AS engine_id, cycle AS flight_cycle, "
        + ", ".join(f'{s} AS "{PHYSICAL_NAMES[s]}"' for s in V.SENSORS)
        + " FROM readings",
        V.READINGS,
    ),
)
def rename(spark, sf):
    return frames.rename_sensors(V.readings(spark, sf))


@query(
    "p3_choose_sensors",
    sql(
        """SELECT r.dataset, r.sensor, count(*) AS rows, round(sum(r.value), 2) AS total
FROM (UNPIVOT (SELECT *, 1.0::DOUBLE AS s5 FROM readings) ON s2, s3, s4, s5, s7 INTO NAME sensor VALUE value) r
JOIN tags USING (dataset, sensor) WHERE r.sensor <> 's5' GROUP BY r.dataset, r.sensor""",
        V.READINGS,
        V.TAGS,
    ),
)
def choose_sensors(spark, sf):
    rows = V.readings(spark, sf).withColumn("s5", F.lit(1.0))
    chosen = frames.sensor_columns(rows, tags=["s2", "s3", "s4", "s7"])
    long_rows = scaling.to_long(rows, READING_KEY, chosen)
    named = long_rows.filter(C.is_sensor_name(F.col("sensor")))
    return writers.join_tags(named, V.tags(spark)).groupBy("dataset", "sensor").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "p4_round_floats",
    "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half, round_even(l_extendedprice, 0) AS price FROM lineitem",
)
def round_floats(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 2).alias("half"), F.col("l_extendedprice").alias("price")
    )
    return frames.round_floats(rows, 0)


@query(
    "p4_round_floats_5",
    "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 7, 5) AS seventh, round_even(l_extendedprice / 7, 5) AS price FROM lineitem",
)
def round_floats_5(spark, sf):
    # sevenths have no short decimals, so none lies on a tie
    rows = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 7).alias("seventh"), (F.col("l_extendedprice") / 7).alias("price")
    )
    return frames.round_floats(rows)


@query("p5_columns_by_type", sql("SELECT s2, s3, s4, s7 FROM readings", V.READINGS))
def columns_by_type(spark, sf):
    rows = V.readings(spark, sf)
    return rows.select(*frames.columns_of_type(rows, T.DoubleType))


@query("p6_constant_column", "SELECT event_id, 'FD001' AS dataset FROM events")
def constant_column(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.lit("FD001").alias("dataset"))


@query("p7_feature_vector", sql("SELECT dataset, unit, cycle, s2 AS f1, s3 AS f2, s4 AS f3, s7 AS f4 FROM readings", V.READINGS))
def feature_vector(spark, sf):
    return parts(frames.to_features(V.readings(spark, sf), V.SENSORS).select(*READING_KEY, "features"))


@query(
    "p8_group_mean",
    sql(
        """SELECT dataset, unit, cycle, tag, round(avg(value), 6) AS y
FROM (UNPIVOT readings ON s2, s3, s4, s7 INTO NAME sensor VALUE value) JOIN tags USING (dataset, sensor)
GROUP BY dataset, unit, cycle, tag""",
        V.READINGS,
        V.TAGS,
    ),
)
def group_mean(spark, sf):
    long_rows = writers.join_tags(scaling.to_long(V.readings(spark, sf), READING_KEY, V.SENSORS), V.tags(spark))
    return rounded(scaling.group_mean(long_rows, [*READING_KEY, "tag"]), "y")


@query("p9_label_column", "SELECT vec_id, label FROM embeddings")
def label_column(spark, sf):
    rows = V.table(spark, sf, "embeddings").withColumnRenamed("label", "state")
    return frames.with_label(rows, "state").select("vec_id", "label")


# filters ------------------------------------------------------------------------------------------------------------


@query("f1_membership", sql("SELECT * FROM readings WHERE dataset IN ('FD001', 'FD003')", V.READINGS))
def membership(spark, sf):
    return V.readings(spark, sf).filter(F.col("dataset").isin("FD001", "FD003"))


@query(
    "f2_equality",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND user_id = 7",
)
def equality(spark, sf):
    rows = V.table(spark, sf, "events").filter((F.col("event_type") == "click") & (F.col("user_id") == 7))
    return rows.select("event_id", "user_id", "value")


@query("f3_mapped_only", sql("SELECT * FROM readings WHERE dataset IN (SELECT dataset FROM tags)", V.READINGS, V.TAGS))
def mapped_only(spark, sf):
    return writers.mapped_only(V.readings(spark, sf), V.tags(spark))


@query(
    "f4_untagged",
    sql(
        """SELECT dataset, sensor, count(*) AS rows
FROM (UNPIVOT readings ON s2, s3, s4, s7 INTO NAME sensor VALUE value) r
WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.dataset = r.dataset AND t.sensor = r.sensor) GROUP BY dataset, sensor""",
        V.READINGS,
        V.TAGS,
    ),
)
def untagged(spark, sf):
    long_rows = scaling.to_long(V.readings(spark, sf), READING_KEY, V.SENSORS)
    return writers.untagged(long_rows, V.tags(spark)).groupBy("dataset", "sensor").agg(F.count(F.lit(1)).alias("rows"))


@query("f5_interval", sql("SELECT dataset, unit, cycle, s2 FROM readings WHERE cycle >= 10 AND cycle < 40", V.READINGS))
def interval(spark, sf):
    rows = V.readings(spark, sf).filter((F.col("cycle") >= 10) & (F.col("cycle") < 40))
    return rows.select("dataset", "unit", "cycle", "s2")


@query(
    "f6_synthetic_only",
    """WITH c AS (SELECT label, count(*) AS rows FROM embeddings GROUP BY label)
SELECT CAST(label AS INTEGER) AS label, CAST(4 * rows AS BIGINT) AS synthetic FROM c ORDER BY rows, label LIMIT 1""",
)
def synthetic_only(spark, sf):
    rows = oversample.oversample(V.vectors(spark, sf), "vec_id", "label")
    return rows.filter("is_synthetic").groupBy("label").agg(F.count(F.lit(1)).alias("synthetic"))


# joins --------------------------------------------------------------------------------------------------------------


@query(
    "j1_sensor_tags",
    sql(
        """SELECT dataset, unit, cycle, sensor, value, tag
FROM (UNPIVOT readings ON s2, s3, s4, s7 INTO NAME sensor VALUE value) JOIN tags USING (dataset, sensor)""",
        V.READINGS,
        V.TAGS,
    ),
)
def sensor_tags(spark, sf):
    return writers.join_tags(scaling.to_long(V.readings(spark, sf), READING_KEY, V.SENSORS), V.tags(spark))


def raw_and_embedding(spark, sf):
    """The first 14 values stand for raw features, all 64 for the embedding of the same row."""
    vectors = V.vectors(spark, sf)
    raw = vectors.select("vec_id", "label", F.slice("features", 1, 14).alias("features"))
    return raw, V.table(spark, sf, "embeddings").select("vec_id", "embedding")


def totals(df, *names):
    """Width and sum of arrays, to compare plain values."""
    for name in names:
        df = df.withColumns({f"{name}_n": F.size(name).cast("bigint"), f"{name}_sum": F.round(C.total(F.col(name)), 6)})
    return df.drop(*names)


@query(
    "j2_raw_with_embedding",
    sql(
        """SELECT vec_id, label, CAST(len(features) + 14 AS BIGINT) AS features_n,
round(list_sum(features[1:14]) + list_sum(features), 6) AS features_sum FROM vectors""",
        V.VECTORS,
    ),
)
def raw_with_embedding(spark, sf):
    raw, emb = raw_and_embedding(spark, sf)
    return totals(frames.assemble(raw, emb, ["vec_id"], "EMBEDDING_MIX_RAW", 78), "features")


@query(
    "j4_raw_and_scaled",
    sql(
        """, stats AS (SELECT dataset, min(s2) AS lo, max(s2) AS hi FROM readings GROUP BY dataset)
SELECT dataset, unit, cycle, s2, round(coalesce((s2 - lo) / nullif(hi - lo, 0), 0), 6) AS scaled FROM readings JOIN stats USING (dataset)""",
        V.READINGS,
    ),
)
def raw_and_scaled(spark, sf):
    rows = V.readings(spark, sf).select(*READING_KEY, "s2", F.col("s2").alias("scaled"))
    stats = scaling.settled_stats(rows, ["dataset"], ["scaled"])
    return rounded(scaling.minmax_apply(rows, stats, ["dataset"], ["scaled"]), "scaled")


@query("j5_model_scenario_grid", sql(f"SELECT model_scenario, scenario, {ROUND_FLAT} FROM flat", *MODEL_VIEWS))
def model_scenario_grid(spark, sf):
    return rounded(model_flat(spark, sf), *FLAT)


KNN = """
pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbour, a.label, b.label AS other,
    sqrt(list_sum(list_transform(list_zip(a.features, b.features), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
  FROM vectors a JOIN vectors b ON {on} a.vec_id <> b.vec_id),
near AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM pairs) r
  WHERE rank <= {k})"""
KNN_CLASS = KNN.format(on="a.label = b.label AND", k=5)
KNN_ALL = KNN.format(on="", k=10)


@query("j6_neighbours_in_class", sql("SELECT vec_id, rank, neighbour, round(distance, 6) AS distance FROM near", V.VECTORS, KNN_CLASS))
def neighbours_in_class(spark, sf):
    rows = V.vectors(spark, sf)
    return rounded(neighbours.knn(rows, rows, "vec_id", "features", 5, same="label"), "distance")


@query("j6_neighbours_in_all", sql("SELECT vec_id, rank, neighbour, round(distance, 6) AS distance FROM near", V.VECTORS, KNN_ALL))
def neighbours_in_all(spark, sf):
    rows = V.vectors(spark, sf)
    return rounded(neighbours.knn(rows, rows, "vec_id", "features", 10), "distance")


@query("j6_neighbours_in_class_cells", sql("SELECT vec_id, rank, neighbour, round(distance, 6) AS distance FROM near", V.VECTORS, KNN_CLASS))
def neighbours_in_class_cells(spark, sf):
    """The same with small blocks, so that pivots and cells are used at this size."""
    rows = V.vectors(spark, sf)
    return rounded(neighbours.knn(rows, rows, "vec_id", "features", 5, same="label", block_rows=64), "distance")


@query("j7_feature_positions", sql("SELECT place, feature, position FROM mask_order", V.READINGS, IMPORTANCE))
def feature_positions(spark, sf):
    return masking.importance_order(importance(spark, sf), V.SENSORS)


@query(
    "j8_teacher_student",
    sql(
        """SELECT vec_id, label, 14::BIGINT AS teacher_features_n, round(list_sum(features[1:14]), 6) AS teacher_features_sum,
78::BIGINT AS student_features_n, round(list_sum(features[1:14]) + list_sum(features), 6) AS student_features_sum FROM vectors""",
        V.VECTORS,
    ),
)
def teacher_student(spark, sf):
    raw, emb = raw_and_embedding(spark, sf)
    rows = frames.teacher_student_frames(raw, emb, ["vec_id"], "RAW_LOGITS", "EMBEDDING_MIX_LOGITS")
    return totals(rows, "teacher_features", "student_features")


# group split: ceil(0.2 * groups) groups with the smallest md5 are test
GROUP_SPLIT = """
sides AS (
  SELECT unit, row_number() OVER (ORDER BY md5(concat('42:', unit))) <= ceil(round(0.2 * count(*) OVER (), 9)) AS is_test
  FROM (SELECT DISTINCT unit FROM readings) u)"""


@query(
    "j9_train_and_test_rows",
    sql(
        """SELECT dataset, unit, cycle, 'test' AS side FROM readings SEMI JOIN (SELECT unit FROM sides WHERE is_test) USING (unit)
UNION ALL SELECT dataset, unit, cycle, 'train' FROM readings ANTI JOIN (SELECT unit FROM sides WHERE is_test) USING (unit)""",
        V.READINGS,
        GROUP_SPLIT,
    ),
)
def train_and_test_rows(spark, sf):
    split = splits.group_split(V.readings(spark, sf).select(*READING_KEY))
    train, test = splits.train_rows(split), splits.test_rows(split)
    return test.withColumn("side", F.lit("test")).unionByName(train.withColumn("side", F.lit("train")))


# aggregates ---------------------------------------------------------------------------------------------------------


@query(
    "a1_mean_curves",
    sql(
        """SELECT dataset, sensor, cycle, round(avg(value), 6) AS mean_value
FROM (UNPIVOT readings ON s2, s3, s4, s7 INTO NAME sensor VALUE value) GROUP BY dataset, sensor, cycle""",
        V.READINGS,
    ),
)
def mean_curves(spark, sf):
    return rounded(scaling.mean_curves(V.readings(spark, sf), V.SENSORS), "mean_value")


@query(
    "a2_minmax_scale",
    sql(
        ", stats AS (SELECT dataset, "
        + ", ".join(f"min({s}) AS {s}_lo, max({s}) AS {s}_hi" for s in V.SENSORS)
        + " FROM readings GROUP BY dataset) SELECT dataset, unit, cycle, "
        + ", ".join(f"round(coalesce(({s} - {s}_lo) / nullif({s}_hi - {s}_lo, 0), 0), 6) AS {s}" for s in V.SENSORS)
        + ", 0.0::DOUBLE AS flat FROM readings JOIN stats USING (dataset)",
        V.READINGS,
    ),
)
def minmax_scale(spark, sf):
    rows = V.readings(spark, sf).withColumn("flat", F.lit(3.0))
    cols = [*V.SENSORS, "flat"]
    return rounded(scaling.minmax_apply(rows, scaling.settled_stats(rows, ["dataset"], cols), ["dataset"], cols), *cols)


@query("a3_class_counts", "SELECT quality, count(*) AS rows FROM labels GROUP BY quality")
def class_counts(spark, sf):
    return oversample.class_counts(V.table(spark, sf, "labels"), "quality")


@query(
    "a4_rarest_class",
    "SELECT CAST(label AS INTEGER) AS label, count(*) AS rows FROM embeddings GROUP BY label ORDER BY rows, label LIMIT 1",
)
def rarest_class(spark, sf):
    return oversample.rarest(oversample.class_counts(V.vectors(spark, sf), "label"), "label")


@query(
    "a5_target_counts",
    """WITH c AS (SELECT CAST(label AS INTEGER) AS label, count(*) AS rows FROM embeddings GROUP BY label)
SELECT 'all' AS strategy, label, rows, CAST(greatest(floor(rows * 2.5), rows + 1) - rows AS BIGINT) AS new FROM c
UNION ALL SELECT 'scale', label, rows, CAST(floor(rows * 5.0) - rows AS BIGINT) FROM c
UNION ALL SELECT 'not_majority', label, rows, (SELECT max(rows) FROM c) - rows FROM c
UNION ALL (SELECT 'rarest', label, rows, CAST(floor(rows * 5.0) - rows AS BIGINT) FROM c ORDER BY rows, label LIMIT 1)""",
)
def target_counts(spark, sf):
    counts = oversample.class_counts(V.vectors(spark, sf), "label")
    made = [
        oversample.targets(counts, "label", name, m).select(F.lit(name).alias("strategy"), "*")
        for name, m in (("all", 2.5), ("scale", 5.0), ("not_majority", 1.0), ("rarest", 5.0))
    ]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


@query(
    "a6_distinct",
    sql("SELECT dataset, count(DISTINCT unit) AS engines, count(DISTINCT s2) AS levels FROM readings GROUP BY dataset", V.READINGS),
)
def distinct(spark, sf):
    return V.readings(spark, sf).groupBy("dataset").agg(
        F.count_distinct("unit").alias("engines"), F.count_distinct("s2").alias("levels")
    )


@query("a6_distinct_values", "SELECT DISTINCT event_type FROM events")
def distinct_values(spark, sf):
    return V.table(spark, sf, "events").select("event_type").distinct()


@query(
    "a7_confusion",
    sql("SELECT scenario, label, prediction, count(*) AS rows FROM predictions GROUP BY scenario, label, prediction", V.PREDICTIONS),
)
def confusion(spark, sf):
    return metrics.confusion(V.predictions(spark, sf), ["scenario"])


@query(
    "a8_class_report",
    sql(
        "SELECT scenario, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report",
        V.PREDICTIONS,
        REPORT_SQL,
        REPORT_ROWS,
    ),
)
def class_report(spark, sf):
    return rounded(report(spark, sf), "precision", "recall", "f1")


@query(
    "a9_accuracy",
    sql("SELECT scenario, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM predictions GROUP BY scenario", V.PREDICTIONS),
)
def accuracy(spark, sf):
    return rounded(metrics.accuracy(V.predictions(spark, sf), ["scenario"]), "accuracy")


@query("a10_macro_f1", sql("SELECT scenario, round(f1_score, 6) AS macro_f1 FROM flat", V.PREDICTIONS, REPORT_SQL))
def macro_f1(spark, sf):
    return rounded(metrics.macro_f1(report(spark, sf), ["scenario"]), "macro_f1")


# teacher logits as probabilities
PROBABILITIES = """
powers AS (SELECT *, list_transform(teacher, lambda v: exp(v - list_max(teacher))) AS e FROM logits),
probs AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS p FROM powers)"""


@query(
    "a11_losses",
    sql(
        """SELECT label, round(sum(loss * n) / sum(n), 6) AS loss FROM (
  SELECT label, vec_id % 5 AS batch, avg(-ln(greatest(p[label + 1], 1e-12))) AS loss, count(*) AS n FROM probs GROUP BY ALL) b
GROUP BY label UNION ALL SELECT -1, round(avg(-ln(greatest(p[label + 1], 1e-12))), 6) FROM probs""",
        V.LOGITS,
        PROBABILITIES,
    ),
)
def losses(spark, sf):
    rows = V.logits(spark, sf).withColumn("probability", C.softmax(F.col("teacher")))
    loss = -F.ln(F.greatest(F.element_at("probability", F.col("label") + 1), F.lit(1e-12)))
    batches = rows.groupBy("label", (F.col("vec_id") % 5).alias("batch")).agg(
        F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n")
    )
    whole = metrics.cross_entropy(rows).select(F.lit(-1).alias("label"), F.col("cross_entropy").alias("loss"))
    return rounded(metrics.weighted_loss(batches, ["label"]).unionByName(whole), "loss")


@query(
    "a12_mean_std",
    sql(
        "SELECT "
        + ", ".join(f"round(avg({s}), 9) AS {s}_mean, round(stddev_pop({s}) + 1e-6, 9) AS {s}_std" for s in ("s2", "s4"))
        + " FROM readings",
        V.READINGS,
    ),
)
def mean_std(spark, sf):
    row = scaling.mean_std(V.readings(spark, sf), ["s2", "s4"])
    return row.select(*[F.round(c, 9).alias(c) for c in row.columns])


@query("a13_row_counts", sql("SELECT dataset, count(*) AS rows, 7 AS columns FROM readings GROUP BY dataset", V.READINGS))
def row_counts(spark, sf):
    rows = V.readings(spark, sf)
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.lit(len(rows.columns)).alias("columns"))


# eight-dimensional token vectors, four hex digits of one md5 per value
TOKENS = """
tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_.]+')) AS token FROM documents),
token_values AS (
  SELECT doc_id, dim, CAST(('0x' || substr(md5(concat(token, ':0')), CAST(1 + 4 * dim AS INTEGER), 4)) AS INTEGER) / 32768.0::DOUBLE - 1.0 AS v
  FROM tokens, (SELECT unnest(range(0, 8)) AS dim) d)"""


@query(
    "a14_pool_tokens",
    sql("SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS value FROM token_values GROUP BY doc_id, dim", TOKENS),
)
def pool_tokens(spark, sf):
    docs = V.table(spark, sf, "documents")
    tokens = docs.select("doc_id", F.posexplode(frames.words(F.col("text"))).alias("pos", "token"))
    tokens = frames.with_token_vector(tokens.withColumn("mask", F.lit(1)), "token", 8)
    return rounded(frames.pool_tokens(tokens, ["doc_id"]), "value")


@query(
    "a15_f1_series",
    sql(
        """SELECT CAST(model_scenario AS VARCHAR) AS method, scenario AS multiplier, round(f1_score, 6) AS f1_macro
FROM flat WHERE model_scenario < 2""",
        *MODEL_VIEWS,
    ),
)
def f1_series(spark, sf):
    results = model_flat(spark, sf).select(
        F.col("model_scenario").cast("string").alias("method"),
        F.when(F.col("model_scenario") < 2, "lightgbm").otherwise("xgboost").alias("model"),
        F.col("scenario").alias("multiplier"),
        F.col("f1_score").alias("f1_macro"),
    )
    series = metrics.f1_series(results, "lightgbm")
    return rounded(series.select("method", F.inline("series")), "f1_macro")


# sorts and top-k ----------------------------------------------------------------------------------------------------


@query(
    "o1_sort_in_engine",
    sql("SELECT dataset, unit, cycle, CAST(cycle - 1 AS INTEGER) AS i, s2 FROM readings", V.READINGS),
)
def sort_in_engine(spark, sf):
    rows = V.readings(spark, sf).select(*READING_KEY, "s2")
    return index_series(rows, ["dataset", "unit"], ["cycle"]).drop("n")


@query(
    "o2_sort_importance",
    sql("SELECT feature, round(importance, 9) AS importance FROM importance ORDER BY importance DESC, feature", V.READINGS, IMPORTANCE),
)
def sort_importance(spark, sf):
    return reports.importance_table(importance(spark, sf)).withColumn("importance", F.round("importance", 9))


HASHES = "list_transform(range(1, 13), lambda i: CAST(('0x' || substr(md5(concat(event_id, ':', i)), 1, 8)) AS BIGINT))"


@query(
    "o3_nine_smallest",
    f"SELECT event_id, unnest(list_sort({HASHES})[1:9]) AS v FROM events",
)
def nine_smallest(spark, sf):
    drawn = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: C.hash_number(C.hash_text(F.col("event_id"), i)))
    return V.table(spark, sf, "events").select("event_id", F.explode(C.smallest(drawn, 9)).alias("v"))


PERMS = """
perms AS (
  SELECT event_id, list_transform(list_sort(list_transform(range(0, 14), lambda i:
    {'h': md5(concat_ws(':', '42', event_id, i)), 'i': i})), lambda d: d.i) AS perm FROM events)"""


@query(
    "o4_permutation",
    sql(
        "SELECT event_id, CAST(place AS INTEGER) AS place, CAST(perm[place + 1] AS INTEGER) AS position "
        "FROM perms, (SELECT unnest(range(0, 14)) AS place) g",
        PERMS,
    ),
)
def permutation(spark, sf):
    perm = C.permutation([F.col("event_id")], 14, 42)
    return V.table(spark, sf, "events").select("event_id", F.posexplode(perm).alias("place", "position"))


@query("o5_first_k", sql("SELECT event_id, CAST(unnest(perm[1:3]) AS INTEGER) AS position FROM perms", PERMS))
def first_k(spark, sf):
    perm = C.permutation([F.col("event_id")], 14, 42)
    return V.table(spark, sf, "events").select("event_id", F.explode(C.first_k(perm, 3)).alias("position"))


@query(
    "o6_argmax",
    sql("SELECT vec_id, CAST(list_position(teacher, list_max(teacher)) - 1 AS INTEGER) AS best FROM logits", V.LOGITS),
)
def argmax(spark, sf):
    return V.logits(spark, sf).select("vec_id", C.argmax(F.col("teacher")).alias("best"))


# set operations -----------------------------------------------------------------------------------------------------


@query(
    "u1_union",
    sql("SELECT dataset, unit, cycle FROM readings WHERE dataset IN ('FD001', 'FD003')", V.READINGS),
)
def union(spark, sf):
    rows = V.readings(spark, sf).select(*READING_KEY)
    return rows.filter("dataset = 'FD001'").unionByName(rows.filter("dataset = 'FD003'"))


@query("u3_repeat_rows", "SELECT event_id, CAST(repeat AS INTEGER) AS repeat FROM events, (SELECT unnest(range(1, 4)) AS repeat) g")
def repeat_rows(spark, sf):
    return oversample.repeat_rows(V.table(spark, sf, "events").select("event_id"), 3)


@query(
    "u4_original_and_synthetic",
    """WITH c AS (SELECT CAST(label AS INTEGER) AS label, count(*) AS rows FROM embeddings GROUP BY label)
SELECT label, false AS is_synthetic, rows FROM c
UNION ALL SELECT label, true, (SELECT max(rows) FROM c) - rows FROM c WHERE rows < (SELECT max(rows) FROM c)""",
)
def original_and_synthetic(spark, sf):
    rows = oversample.oversample(V.vectors(spark, sf), "vec_id", "label", strategy="not_majority")
    return rows.groupBy("label", "is_synthetic").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "u5_long_metrics",
    sql(
        """SELECT model_scenario, scenario, metric, round(score, 6) AS score
FROM (UNPIVOT flat ON accuracy, f1_score INTO NAME metric VALUE score)""",
        *MODEL_VIEWS,
    ),
)
def long_metrics(spark, sf):
    return rounded(reports.long_metrics(model_flat(spark, sf), ["model_scenario", "scenario"], ["accuracy", "f1_score"]), "score")


# scalar functions ---------------------------------------------------------------------------------------------------


@query("x1_row_json", sql("SELECT dataset, unit, cycle, s2, s3, s4, s7 FROM readings", V.READINGS))
def row_json(spark, sf):
    text = frames.rows_to_json(V.readings(spark, sf), V.SENSORS).select(*READING_KEY, "text")
    return frames.rows_from_json(text, V.SENSORS)


@query("x2_parse_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,bigint>")["k"].alias("k"))


@query(
    "x3_mask_positions",
    sql(
        """SELECT event_id, CAST(i AS INTEGER) AS i, CASE WHEN list_contains(perm[1:5], i) THEN -1.0 ELSE i + 0.5 END::DOUBLE AS v
FROM perms, (SELECT unnest(range(0, 14)) AS i) g""",
        PERMS,
    ),
)
def mask_positions(spark, sf):
    values = F.array(*[F.lit(i + 0.5) for i in range(14)])
    masked = C.mask(values, C.permutation([F.col("event_id")], 14, 42), 5)
    return V.table(spark, sf, "events").select("event_id", F.posexplode(masked).alias("i", "v"))


@query(
    "x4_x5_x6_numbers",
    """SELECT event_id, abs(value - 10) AS distance, CAST(trunc(value - 10) AS INTEGER) AS whole, least(value, 10.0) AS capped
FROM events""",
)
def numbers(spark, sf):
    v = F.col("value")
    return V.table(spark, sf, "events").select(
        "event_id", F.abs(v - 10).alias("distance"), C.trunc(v - 10).alias("whole"), C.cap(v, 10.0).alias("capped")
    )


def four(name):
    return ", ".join(f"round({name}[{n}], 6) AS f{n}" for n in range(1, 5))


def four_cells(df, name):
    return rounded(parts(df, name), "f1", "f2", "f3", "f4")


@query(
    "x7_clip_normalise",
    sql(
        ", c AS (SELECT vec_id, list_transform(teacher, lambda v: greatest(v, 1e-12)) AS p FROM logits)"
        ", d AS (SELECT vec_id, list_transform(p, lambda v: v / list_sum(p)) AS p FROM c) SELECT vec_id, " + four("p") + " FROM d",
        V.LOGITS,
    ),
)
def clip_normalise(spark, sf):
    return four_cells(V.logits(spark, sf).select("vec_id", C.clip_normalise(F.col("teacher")).alias("p")), "p")


SOFT = """
e AS (SELECT vec_id, label, student, list_transform(teacher, lambda v: exp((v - list_max(teacher)) / 4)) AS e,
  list_transform(student, lambda v: (v - list_max(student)) / 4) AS s, list_transform(student, lambda v: v - list_max(student)) AS s1 FROM logits),
soft AS (SELECT vec_id, label, list_transform(e, lambda v: v / list_sum(e)) AS p,
  list_transform(s, lambda v: v - ln(list_sum(list_transform(s, lambda w: exp(w))))) AS q,
  list_transform(s1, lambda v: v - ln(list_sum(list_transform(s1, lambda w: exp(w))))) AS q1 FROM e)"""


@query("x8_softmax", sql("SELECT vec_id, " + four("p") + " FROM soft", V.LOGITS, SOFT))
def softmax(spark, sf):
    return four_cells(V.logits(spark, sf).select("vec_id", C.softmax(F.col("teacher"), 4.0).alias("p")), "p")


@query("x9_log_softmax", sql("SELECT vec_id, " + four("q") + " FROM soft", V.LOGITS, SOFT))
def log_softmax(spark, sf):
    return four_cells(V.logits(spark, sf).select("vec_id", C.log_softmax(F.col("student"), 4.0).alias("q")), "q")


@query(
    "x10_distill_loss",
    sql(
        """, t AS (SELECT -q1[label + 1] AS ce, list_sum(list_transform(list_zip(p, q), lambda z: z[1] * (ln(z[1]) - z[2]))) AS kd FROM soft)
SELECT round(avg(ce), 6) AS ce, round(avg(kd), 6) AS kd, round(0.5 * avg(ce) + 0.5 * avg(kd) * 16, 6) AS loss FROM t""",
        V.LOGITS,
        SOFT,
    ),
)
def distill_loss(spark, sf):
    return rounded(metrics.distill_loss(V.logits(spark, sf), "teacher", "student", "label", is_prob=False), "ce", "kd", "loss")


@query(
    "x11_clean_tag",
    """SELECT event_id, CASE WHEN lower(left(event_type, 1)) IN ('u', 'd', 'c', 'o') THEN lower(left(event_type, 1)) ELSE 'o' END AS tag
FROM events""",
)
def clean_tag(spark, sf):
    answer = F.concat(F.lit("  "), F.upper(F.substring("event_type", 1, 1)), F.lit(" "))
    return V.table(spark, sf, "events").select("event_id", C.clean_tag(answer).alias("tag"))


@query("x12_sensor_name", "SELECT event_id, regexp_full_match(concat(CASE WHEN user_id % 2 = 0 THEN 's' ELSE 'set' END, user_id), 's[0-9]+') AS is_sensor FROM events")
def sensor_name(spark, sf):
    name = F.concat(F.when(F.col("user_id") % 2 == 0, "s").otherwise("set"), F.col("user_id").cast("string"))
    return V.table(spark, sf, "events").select("event_id", C.is_sensor_name(name).alias("is_sensor"))


@query(
    "x13_names",
    """SELECT doc_id, concat(doc_id, '_', lang, '.json') AS base, concat('out/', source, '/', doc_id, '_', lang, '.jpg') AS image
FROM documents""",
)
def names(spark, sf):
    path = F.concat(F.lit("out/"), "source", F.lit("/"), F.concat_ws("_", F.col("doc_id").cast("string"), "lang"), F.lit(".json"))
    return V.table(spark, sf, "documents").select(
        "doc_id", C.base_name(path).alias("base"), C.swap_suffix(path, ".json", ".jpg").alias("image")
    )


@query("x14_run_stamp", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def run_stamp(spark, sf):
    return V.table(spark, sf, "events").select("event_id", C.run_stamp(F.col("ts")).alias("stamp"))


@query(
    "x15_state_colour",
    """SELECT event_id, coalesce(['#8fd175', '#fff07e', '#f6b08c', '#d9534f'][CAST(user_id % 6 + 1 AS INTEGER)], 'black') AS colour
FROM events""",
)
def state_colour(spark, sf):
    return V.table(spark, sf, "events").select("event_id", C.state_colour((F.col("user_id") % 6).cast("int")).alias("colour"))


@query(
    "x16_distance",
    sql(
        "SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(teacher, student), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS distance FROM logits",
        V.LOGITS,
    ),
)
def distance(spark, sf):
    return rounded(V.logits(spark, sf).select("vec_id", C.distance(F.col("teacher"), F.col("student")).alias("distance")), "distance")


@query(
    "x17_between",
    sql(
        """, b AS (SELECT vec_id, list_transform(list_zip(teacher, student), lambda p: p[1]
  + CAST(('0x' || substr(md5(concat('42:', vec_id)), 9, 8)) AS BIGINT) / 4294967296.0::DOUBLE * (p[2] - p[1])) AS p FROM logits)
SELECT vec_id, """
        + four("p")
        + " FROM b",
        V.LOGITS,
    ),
)
def between(spark, sf):
    gap = C.hash_unit(C.hash_text(42, F.col("vec_id")))
    return four_cells(V.logits(spark, sf).select("vec_id", C.between(F.col("teacher"), F.col("student"), gap).alias("p")), "p")
