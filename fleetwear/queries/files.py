"""Sources and sinks: every query writes a table in the format under test and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwear.operators import frames, masking, metrics, models, reports
from fleetwear.queries import views as V
from fleetwear.queries.registry import query, sql
from fleetwear.runtime import scratch_path
from fleetwear.schema import SENSOR_COLUMNS, SETTING_COLUMNS, reading_schema
from fleetwear.sources import readers, writers

# a tag per dataset and sensor worked out from the readings themselves
DERIVED_TAGS = """
derived_tags AS (
  SELECT dataset, sensor, substr('udco', CAST(1 + sum(CAST(round(value * 100) AS BIGINT)) % 4 AS INTEGER), 1) AS tag
  FROM (UNPIVOT readings ON s2, s3, s4, s7 INTO NAME sensor VALUE value) GROUP BY dataset, sensor)"""


def derived_tags(spark, sf):
    rows = V.readings(spark, sf).unpivot(["dataset"], V.SENSORS, "sensor", "value")
    place = (F.sum(F.round(F.col("value") * 100).cast("bigint")) % 4 + 1).cast("int")
    return rows.groupBy("dataset", "sensor").agg(place.alias("p")).select(
        "dataset", "sensor", F.substring(F.lit("udco"), F.col("p"), F.lit(1)).alias("tag")
    )


def text_lines(readings):
    """Readings as blank-separated text with the blanks such files have."""
    constant = [F.lit("0.5").alias(c) for c in SETTING_COLUMNS]
    sensors = [F.col(c).cast("string") if c in V.SENSORS else F.lit("1.0") for c in SENSOR_COLUMNS]
    line = F.concat_ws(" ", F.col("unit").cast("string"), F.concat(F.lit("  "), F.col("cycle").cast("string")), *constant, *sensors)
    return readings.select("dataset", F.concat(F.lit(" "), line, F.lit("  ")).alias("value"))


@query(
    "s1_read_sensor_text",
    sql("SELECT CAST(unit AS INTEGER) AS unit, cycle, 0.5::DOUBLE AS set1, s2, s3, s4, s7, 1.0::DOUBLE AS s21 FROM readings", V.READINGS),
)
def read_text(spark, sf):
    path = scratch_path(spark, "lines")
    writers.write_table(text_lines(V.readings(spark, sf)).select("value"), path, "text")
    return readers.read_sensor_text(spark, path).select("unit", "cycle", "set1", "s2", "s3", "s4", "s7", "s21")


@query(
    "s2_read_fleet_files",
    sql(
        """SELECT dataset, CAST(unit AS INTEGER) AS unit, cycle, s2, s7 FROM readings
WHERE dataset IN (SELECT dataset FROM tags)""",
        V.READINGS,
        V.TAGS,
    ),
)
def read_fleet(spark, sf):
    path = scratch_path(spark, "fleet")
    lines = text_lines(V.readings(spark, sf)).withColumn("file", F.concat(F.lit("train_"), "dataset")).drop("dataset")
    writers.write_table(lines, path, "text", ["file"])
    paths = [f"{path}/file=train_FD00{n}" for n in (1, 2, 3, 4)]
    readings = readers.read_sensor_text(spark, paths)
    return writers.mapped_only(readings, V.tags(spark)).select("dataset", "unit", "cycle", "s2", "s7")


@query("s3_read_csv", sql("SELECT dataset, unit, cycle, s2, s3, s4, s7 FROM readings", V.READINGS))
def read_csv(spark, sf):
    path = scratch_path(spark, "csv")
    readings = V.readings(spark, sf)
    writers.write_table(readings, path, "csv")
    return readers.read_csv(spark, path, readings.schema)


@query("s4_read_tags", sql("SELECT dataset, sensor, tag FROM derived_tags", V.READINGS, DERIVED_TAGS))
def read_tags(spark, sf):
    path = scratch_path(spark, "tags")
    writers.write_tags(derived_tags(spark, sf), path)
    return readers.read_tags(spark, path)


REPORT_SQL = """
scores AS (
  SELECT scenario, class, coalesce(tp / nullif(p, 0), 0) AS precision, coalesce(tp / nullif(t, 0), 0) AS recall,
    coalesce(2 * tp / nullif(p + t, 0), 0) AS f1, CAST(t AS BIGINT) AS support
  FROM (
    SELECT scenario, class, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(t) AS DOUBLE) AS t
    FROM (
      SELECT scenario, label AS class, 1 AS t, 0 AS p, CASE WHEN label = prediction THEN 1 ELSE 0 END AS tp FROM predictions
      UNION ALL SELECT scenario, prediction, 0, 1, 0 FROM predictions) r
    GROUP BY scenario, class) s),
flat AS (
  SELECT scenario, sum(recall * support) / sum(support) AS accuracy, avg(f1) AS f1_score, avg(precision) AS precision,
    avg(recall) AS recall
  FROM scores GROUP BY scenario)"""


def flat(spark, sf):
    return metrics.flat_report(metrics.confusion(V.predictions(spark, sf), ["scenario"]), ["scenario"])


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


FLAT = ("accuracy", "f1_score", "precision", "recall")
ROUND_FLAT = ", ".join(f"round({m}, 6) AS {m}" for m in FLAT)


@query("s5_read_json", sql(f"SELECT scenario, {ROUND_FLAT} FROM flat", V.PREDICTIONS, REPORT_SQL))
def read_json(spark, sf):
    path = scratch_path(spark, "json")
    report = flat(spark, sf)
    writers.write_table(report, path, "json")
    return rounded(readers.read_json(spark, path, report.schema, multi_line=False), *FLAT)


# scenario tables: the four sensors as features, masked by md5 order --------------------------------------------------

SCENARIOS = """
perms AS (
  SELECT dataset, unit, cycle, [s2, s3, s4, s7] AS f,
    list_transform(list_sort(list_transform(range(0, 4), lambda i:
      {'h': md5(concat_ws(':', '42', dataset, unit, cycle, i)), 'i': i})), lambda d: d.i) AS perm
  FROM readings),
scenarios AS (
  SELECT dataset, unit, cycle, scenario,
    list_transform(f, lambda v, i: CASE WHEN list_contains(perm[1:scenario], i - 1) THEN -1.0 ELSE v END) AS features
  FROM perms, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS scenario) g)"""

READING_KEY = ["dataset", "unit", "cycle"]
PARTS = ", ".join(f"features[{n}] AS f{n}" for n in range(1, 5))


def features(spark, sf):
    return frames.to_features(V.readings(spark, sf), V.SENSORS).select(*READING_KEY, "features")


def scenario_rows(spark, sf):
    return masking.scenarios(features(spark, sf), READING_KEY, 4)


def parts(df, name="features", n=4):
    """Array cells as columns, to compare plain values."""
    return df.select("*", *[F.col(name)[i].alias(f"f{i + 1}") for i in range(n)]).drop(name)


def stored_scenarios(spark, sf):
    path = scratch_path(spark, "layout")
    writers.write_scenarios(scenario_rows(spark, sf), path, "RAW", "train")
    return path


@query("s6_load_scenario", sql(f"SELECT dataset, unit, cycle, {PARTS} FROM scenarios WHERE scenario = 2", V.READINGS, SCENARIOS))
def load_scenario(spark, sf):
    rows = readers.read_scenarios(spark, stored_scenarios(spark, sf), "RAW", "train", 2)
    return parts(rows.select(*READING_KEY, "features"))


@query("s7_load_stack", sql(f"SELECT dataset, unit, cycle, scenario, {PARTS} FROM scenarios WHERE scenario <= 2", V.READINGS, SCENARIOS))
def load_stack(spark, sf):
    rows = readers.read_scenarios(spark, stored_scenarios(spark, sf), "RAW", "train", 2, stack=True)
    return parts(rows.select(*READING_KEY, "scenario", "features"))


@query(
    "s8_read_embeddings",
    "SELECT vec_id, len(embedding) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
)
def read_embeddings(spark, sf):
    rows = readers.read_embeddings(spark, f"{sf}/embeddings.parquet", "vec_id")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return rows.select("vec_id", F.size("embedding").cast("bigint").alias("width"), F.round(total, 6).alias("total"))


# importance of a sensor: its share of distinct values in the readings; one name is not a model column
IMPORTANCE = """
importance AS (
  SELECT sensor AS feature, count(DISTINCT value) / CAST(count(*) AS DOUBLE) AS importance
  FROM (UNPIVOT (SELECT *, s2 AS s99 FROM readings) ON s2, s3, s4, s7, s99 INTO NAME sensor VALUE value) GROUP BY sensor),
mask_order AS (
  SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) - 1 AS INTEGER) AS place, feature,
    CAST(list_position(['s2', 's3', 's4', 's7'], feature) - 1 AS INTEGER) AS position
  FROM importance WHERE feature IN ('s2', 's3', 's4', 's7'))"""


def importance(spark, sf):
    rows = V.readings(spark, sf).withColumn("s99", F.col("s2"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(c) for c in [*V.SENSORS, "s99"]]
    )
    shares = counts.select(*[(F.col(c) / F.col("n")).alias(c) for c in [*V.SENSORS, "s99"]])
    return shares.unpivot([], [*V.SENSORS, "s99"], "feature", "importance")


@query("s9_read_importance", sql("SELECT place, feature, position FROM mask_order", V.READINGS, IMPORTANCE))
def read_importance(spark, sf):
    path = scratch_path(spark, "importance")
    writers.write_table(importance(spark, sf), path, "csv")
    return masking.importance_order(readers.read_importance(spark, path), V.SENSORS)


def four_classes(spark, sf):
    """Vectors folded to four classes, each moved 20 along its own dimension.

    The classes lie apart by a wide margin, so that every right learner gives back the label of every row and SQL can
    state what it predicts. The four dimensions are rounded to hundredths: they then have fewer values than a tree learner has bins.
    """
    label = F.col("label") % 4
    moved = F.transform("features", lambda v, i: F.when(i < 4, F.round(v, 2)).otherwise(v) + F.when(i == label, 20.0).otherwise(0.0))
    return V.vectors(spark, sf).select("vec_id", moved.alias("features"), label.alias("label"))


LEARNED = "SELECT vec_id, CAST(label % 4 AS INTEGER) AS label, CAST(label % 4 AS INTEGER) AS prediction FROM embeddings"


def stored_model(spark, sf):
    path = scratch_path(spark, "model")
    rows = four_classes(spark, sf)
    writers.save_model(models.fit("logistic_regression", rows), path)
    return rows, path


@query("s10_load_model", LEARNED)
def load_model(spark, sf):
    rows, path = stored_model(spark, sf)
    return models.predict(writers.load_model(path), rows).select("vec_id", "label", "prediction")


@query("k1_write_csv", sql("SELECT dataset, count(*) AS rows, round(sum(s3), 2) AS total FROM readings GROUP BY dataset", V.READINGS))
def write_csv(spark, sf):
    path = scratch_path(spark, "csv")
    readings = V.readings(spark, sf)
    writers.write_table(readings, path, "csv")
    back = readers.read_csv(spark, path, readings.schema)
    return back.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("s3"), 2).alias("total"))


@query(
    "k2_write_scenarios",
    sql(
        """SELECT 'RAW' AS source, scenario, 'train' AS phase, count(*) AS rows,
CAST(sum(len(list_filter(features, lambda v: v = -1.0))) AS BIGINT) AS hidden FROM scenarios GROUP BY scenario""",
        V.READINGS,
        SCENARIOS,
    ),
)
def write_layout(spark, sf):
    rows = spark.read.parquet(stored_scenarios(spark, sf))
    hidden = F.size(F.filter("features", lambda v: v == -1.0))
    return rows.groupBy("source", "scenario", "phase").agg(F.count(F.lit(1)).alias("rows"), F.sum(hidden).alias("hidden"))


@query(
    "k3_write_embeddings",
    "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first_value, CAST(embedding[64] AS DOUBLE) AS last_value FROM embeddings",
)
def write_embeddings(spark, sf):
    path = scratch_path(spark, "vectors")
    writers.write_table(readers.read_embeddings(spark, f"{sf}/embeddings.parquet", "vec_id"), path)
    back = readers.read_embeddings(spark, path, "vec_id")
    cell = lambda place: F.element_at("embedding", place).cast("double")
    return back.select("vec_id", cell(1).alias("first_value"), cell(64).alias("last_value"))


@query("k4_write_report_json", sql(f"SELECT 1 AS model_scenario, scenario, {ROUND_FLAT} FROM flat", V.PREDICTIONS, REPORT_SQL))
def write_report(spark, sf):
    path = scratch_path(spark, "report")
    report = flat(spark, sf).select(F.lit(1).alias("model_scenario"), "*")
    writers.write_table(report, path, "json")
    return rounded(readers.read_json(spark, path, report.schema, multi_line=False), *FLAT)


# models x scenarios: every model judges every row of every scenario; model m errs on other rows than the next
MODEL_FLAT = REPORT_SQL.replace("scenario", "model_scenario, scenario")

MODELS_SQL = """
predictions AS (
  SELECT model_scenario, vec_id, label, scenario,
    CAST((label + CASE WHEN (vec_id + model_scenario) % (7 - scenario) = 0 THEN 1 + model_scenario ELSE 0 END) % 10 AS INTEGER) AS prediction
  FROM vectors, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS scenario) g, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS model_scenario) m)"""
MODEL_VIEWS = (V.VECTORS, MODELS_SQL, MODEL_FLAT)


def model_flat(spark, sf):
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    rows = V.vectors(spark, sf).select("vec_id", "label", upto(3).alias("scenario")).select("*", upto(2).alias("model_scenario"))
    wrong = (F.col("vec_id") + F.col("model_scenario")) % (7 - F.col("scenario")) == 0
    preds = rows.withColumn("prediction", ((F.col("label") + F.when(wrong, 1 + F.col("model_scenario")).otherwise(0)) % 10).cast("int"))
    by = ["model_scenario", "scenario"]
    return metrics.flat_report(metrics.confusion(preds, by), by)


@query(
    "k5_nested_report",
    sql(f"SELECT CAST(model_scenario AS VARCHAR) AS model_scenario, CAST(scenario AS VARCHAR) AS scenario, {ROUND_FLAT} FROM flat", *MODEL_VIEWS),
)
def nested(spark, sf):
    document = reports.nested_report(model_flat(spark, sf))
    metric = "struct<accuracy:double,f1_score:double,precision:double,recall:double>"
    maps = document.select(F.explode(F.from_json("value", f"map<string,map<string,{metric}>>")).alias("model_scenario", "m"))
    rows = maps.select("model_scenario", F.explode("m").alias("scenario", "v")).select("model_scenario", "scenario", "v.*")
    return rounded(rows, *FLAT)


REPORT_ROWS = """
report AS (
  SELECT scenario, CAST(class AS VARCHAR) AS class, precision, recall, f1, support FROM scores
  UNION ALL SELECT scenario, 'accuracy', sum(recall * support) / sum(support), sum(recall * support) / sum(support),
    sum(recall * support) / sum(support), CAST(sum(support) AS BIGINT) FROM scores GROUP BY scenario
  UNION ALL SELECT scenario, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT)
    FROM scores GROUP BY scenario
  UNION ALL SELECT scenario, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM scores GROUP BY scenario)"""


def report(spark, sf):
    return metrics.class_report(metrics.confusion(V.predictions(spark, sf), ["scenario"]), ["scenario"])


@query(
    "k6_text_report",
    sql(
        """SELECT scenario, -1 AS place, printf('%12s  %9s %9s %9s %9s', '', 'precision', 'recall', 'f1-score', 'support') AS line
FROM (SELECT DISTINCT scenario FROM report) s
UNION ALL SELECT scenario, CASE class WHEN 'accuracy' THEN 1000000 WHEN 'macro avg' THEN 1000001
    WHEN 'weighted avg' THEN 1000002 ELSE TRY_CAST(class AS INTEGER) END,
  CASE WHEN class = 'accuracy' THEN printf('%12s  %9s %9s %9.3f %9d', class, '', '', f1, support)
    ELSE printf('%12s  %9.3f %9.3f %9.3f %9d', class, precision, recall, f1, support) END
FROM report""",
        V.PREDICTIONS,
        REPORT_SQL,
        REPORT_ROWS,
    ),
)
def text_report(spark, sf):
    path = scratch_path(spark, "text-report")
    lines = reports.text_report(report(spark, sf), ["scenario"])
    writers.write_table(lines.select("line", "scenario", "place"), path, "text", ["scenario", "place"])
    return spark.read.text(path).select("scenario", "place", F.col("value").alias("line"))


@query(
    "k7_run_manifest",
    """SELECT concat('RAW_RAW_xgboost_RAW_', strftime(max(ts), '%Y%m%d_%H%M%S')) AS run, user_id, count(*) AS events
FROM events GROUP BY user_id""",
)
def manifest(spark, sf):
    per_user = V.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("events"))
    path = scratch_path(spark, "runs")
    runs = per_user.select(reports.run_name(["RAW_RAW", "xgboost", "RAW"], moment=F.col("ts")).alias("run"), "user_id", "events")
    writers.write_table(runs, path, mode="append")
    return spark.read.schema(runs.schema).parquet(path)


@query(
    "k7_run_settings",
    """SELECT concat('{"events": ', count(*), ', "users": ', count(DISTINCT user_id), '}') AS params, true AS named FROM events""",
)
def run_settings(spark, sf):
    """A manifest row with the settings of a run, appended to a table of runs and read back."""
    events = V.table(spark, sf, "events")
    counts = events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users")).first().asDict()
    path = scratch_path(spark, "manifests")
    rows = reports.run_manifest(spark, counts, ["RAW_RAW", "xgboost", "RAW"])
    writers.write_table(rows, path, mode="append")
    return spark.read.schema(rows.schema).parquet(path).select("params", F.col("run").rlike("^RAW_RAW_xgboost_RAW_[0-9]{8}_[0-9]{6}$").alias("named"))


@query(
    "s5_read_json_arrays",
    sql(f"SELECT 1 AS model_scenario, scenario, {ROUND_FLAT} FROM flat", V.PREDICTIONS, REPORT_SQL),
)
def read_json_arrays(spark, sf):
    """Reports as files that hold one array of records each."""
    path = scratch_path(spark, "arrays")
    report = flat(spark, sf).select(F.lit(1).alias("model_scenario"), "*")
    lines = report.groupBy("model_scenario").agg(F.to_json(F.collect_list(F.struct(*report.columns))).alias("value"))
    writers.write_table(lines.select("value").coalesce(1), path, "text")
    return rounded(readers.read_json(spark, path, report.schema), *FLAT)


@query(
    "k8_save_model",
    "SELECT CAST(label % 4 AS INTEGER) AS label, CAST(label % 4 AS INTEGER) AS prediction, count(*) AS rows FROM embeddings GROUP BY ALL",
)
def save_model(spark, sf):
    rows, path = stored_model(spark, sf)
    first = models.predict(writers.load_model(path), rows)
    return first.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "k9_merge_tags",
    sql(
        """SELECT dataset, sensor, tag FROM tags
UNION ALL SELECT dataset, sensor, tag FROM derived_tags d WHERE NOT EXISTS (
  SELECT 1 FROM tags t WHERE t.dataset = d.dataset AND t.sensor = d.sensor)""",
        V.READINGS,
        V.TAGS,
        DERIVED_TAGS,
    ),
)
def merge_tags(spark, sf):
    path = scratch_path(spark, "merged")
    writers.write_tags(writers.merge_tags(V.tags(spark), derived_tags(spark, sf)), path)
    return readers.read_tags(spark, path)
