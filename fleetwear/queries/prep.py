"""Time-series and dataset-preparation queries."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from fleetwear.functions import columns as C
from fleetwear.operators import frames, masking, oversample, scaling, series, splits
from fleetwear.operators.states import label_states
from fleetwear.queries import views as V
from fleetwear.queries.files import (
    IMPORTANCE,
    PARTS,
    READING_KEY,
    SCENARIOS,
    features,
    importance,
    parts,
    rounded,
    scenario_rows,
)
from fleetwear.queries.registry import ORACLES, query, sql
from fleetwear.queries.relational import KNN_ALL, KNN_CLASS, TOKENS, raw_and_embedding, totals
from fleetwear.sources import writers

# knee detection as SQL: source has the key columns, tag, i, n, y -----------------------------------------------------


def knee_sql(source: str, *key: str) -> str:
    k = ", ".join(key)
    return f"""
k1 AS (SELECT *, CASE WHEN tag IN ('u', 'd') THEN y
    ELSE round_even(abs(y - avg(y) OVER (PARTITION BY {k})) * 1e9, 0) / 1e9 END AS v FROM {source}),
k2 AS (SELECT *, (v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) AS s FROM k1 WINDOW w AS (PARTITION BY {k})),
k3 AS (SELECT {k}, tag, i, n, round_even((CASE WHEN tag = 'd' THEN 1.0 - s ELSE s END
    - CAST(i AS DOUBLE) / nullif(n - 1, 0)) * 1e9, 0) / 1e9 AS yd FROM k2),
k4 AS (SELECT *, lag(yd) OVER w AS p, lead(yd) OVER w AS q FROM k3 WINDOW w AS (PARTITION BY {k} ORDER BY i)),
k5 AS (SELECT *, yd >= coalesce(p, yd) AND yd >= coalesce(q, yd) AS mx, yd <= coalesce(p, yd) AND yd <= coalesce(q, yd) AS mn FROM k4),
k6 AS (SELECT *, CASE WHEN mn THEN 0.0 WHEN mx THEN yd - 2.0::DOUBLE / (n - 1) END AS t0, CASE WHEN mx THEN i END AS m0 FROM k5),
k7 AS (SELECT *, last_value(t0 IGNORE NULLS) OVER w AS thr, last_value(m0 IGNORE NULLS) OVER w AS ti FROM k6
  WINDOW w AS (PARTITION BY {k} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
knees AS (SELECT {k}, CAST(max(n) AS INTEGER) AS n,
    min(ti) FILTER (i = first_hit) AS knee
  FROM (SELECT *, min(i) FILTER (ti IS NOT NULL AND q < thr) OVER (PARTITION BY {k}) AS first_hit FROM k7) h GROUP BY {k}),
edges AS (SELECT *, list_concat([0], list_sort([coalesce(knee, CAST(floor(n / 10) AS INTEGER)),
    {", ".join(f"CAST(floor(n * {m} / 10) AS INTEGER)" for m in range(2, 10))}]), [n - 1]) AS edges FROM knees)"""


SERIES_TAGGED = """
tagged AS (SELECT *, CASE unit % 3 WHEN 0 THEN 'u' WHEN 1 THEN 'd' ELSE 'c' END AS tag FROM series)"""


def unit_tag():
    return F.when(F.col("unit") % 3 == 0, "u").when(F.col("unit") % 3 == 1, "d").otherwise("c")


@query("w1_index", sql("SELECT unit, i, n, y FROM series", V.SERIES))
def index(spark, sf, **limits):
    rows = V.table(spark, sf, "events").select(F.col("user_id").alias("unit"), "ts", "event_id", F.col("value").alias("y"))
    return series.index_series(rows, ["unit"], ["ts", "event_id"], **limits).select("unit", "i", "n", "y")


@query(
    "w2_smooth",
    sql(
        """SELECT unit, i, round(pow(0.95::DOUBLE, i) * sum(CASE WHEN i = 0 THEN y / 7 ELSE 0.05 * y / 7 END * pow(0.95::DOUBLE, -i))
  OVER (PARTITION BY unit ORDER BY i), 6) AS smooth FROM series""",
        V.SERIES,
    ),
)
def smooth(spark, sf):
    # sevenths have no short decimals, so no smoothed value lies on a rounding tie
    rows = V.series(spark, sf).withColumn("y", F.col("y") / 7)
    return rounded(series.ewm(rows, ["unit"]).select("unit", "i", "smooth"), "smooth")


@query("w3_deviation", sql("SELECT unit, i, round(abs(y - avg(y) OVER (PARTITION BY unit)), 9) AS dev FROM series", V.SERIES))
def deviation(spark, sf, **limits):
    return series.abs_dev(V.series(spark, sf), ["unit"], **limits).select("unit", "i", F.round("dev", 9).alias("dev"))


@query("w4_knee", sql("SELECT unit, n, knee FROM knees", V.SERIES, SERIES_TAGGED, knee_sql("tagged", "unit")))
def knee(spark, sf, **limits):
    return series.knee(V.series(spark, sf), ["unit"], unit_tag(), **limits)


@query(
    "w5_phase_edges",
    sql(
        "SELECT unit, CAST(place - 1 AS INTEGER) AS place, edges[place] AS edge FROM edges, (SELECT unnest(range(1, 12)) AS place) g",
        V.SERIES,
        SERIES_TAGGED,
        knee_sql("tagged", "unit"),
    ),
)
def phase_edges(spark, sf):
    knees = series.knee(V.series(spark, sf), ["unit"], unit_tag())
    return series.phase_edges(knees).select("unit", F.posexplode("edges").alias("place", "edge"))


CUT = """
cut AS (SELECT unit, i, CASE WHEN e.n < 2 OR i < edges[{a}] THEN 0 WHEN i < edges[{b}] THEN 1 WHEN i < edges[{c}] THEN 2 ELSE 3 END AS state
  FROM series JOIN edges e USING (unit))"""


@query(
    "w6_cut_phases",
    sql("SELECT unit, i, state FROM cut", V.SERIES, SERIES_TAGGED, knee_sql("tagged", "unit"), CUT.format(a=4, b=7, c=10)),
)
def cut_phases(spark, sf):
    rows = V.series(spark, sf)
    edges = series.phase_edges(series.knee(rows, ["unit"], unit_tag()))
    return series.cut_phases(rows.select("unit", "i"), edges, ["unit"])


@query(
    "j3_phase_interval_shifted",
    sql("SELECT unit, i, state FROM cut", V.SERIES, SERIES_TAGGED, knee_sql("tagged", "unit"), CUT.format(a=6, b=9, c=11)),
)
def cut_phases_shifted(spark, sf):
    rows = V.series(spark, sf)
    edges = series.phase_edges(series.knee(rows, ["unit"], unit_tag()))
    return series.cut_phases(rows.select("unit", "i"), edges, ["unit"], shift=2)


RUNS = """
runs AS (
  SELECT unit, run, min(state) AS state, CAST(min(i) AS INTEGER) AS run_start, CAST(max(i) + 1 AS INTEGER) AS run_end, count(*) AS run_rows
  FROM (
    SELECT *, CAST(sum(CASE WHEN p IS NULL OR p <> state THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY i) AS BIGINT) AS run
    FROM (SELECT *, lag(state) OVER (PARTITION BY unit ORDER BY i) AS p FROM series) a) b
  GROUP BY unit, run)"""


@query("w7_state_runs", sql("SELECT * FROM runs", V.SERIES, RUNS))
def state_runs(spark, sf, **limits):
    return series.state_runs(V.series(spark, sf), ["unit"], "state", **limits)


# The same queries with every series of more than 40 rows taken for a long one, so that chunks meet the same SQL.
for _name, _build in (("w1_index", index), ("w3_deviation", deviation), ("w4_knee", knee), ("w7_state_runs", state_runs)):
    query(f"{_name}_chunked", ORACLES[_name])(partial(_build, max_rows=40, chunk=16))


@query("w8_importance_rank", sql("SELECT feature, place FROM mask_order", V.READINGS, IMPORTANCE))
def importance_rank(spark, sf):
    return masking.importance_order(importance(spark, sf), V.SENSORS).select("feature", "place")


# health states ------------------------------------------------------------------------------------------------------

CURVES = """
cells AS (SELECT * FROM (UNPIVOT readings ON s2, s3, s4, s7 INTO NAME sensor VALUE value)),
limits AS (SELECT dataset, sensor, min(value) AS lo, max(value) AS hi FROM cells GROUP BY dataset, sensor),
scaled AS (SELECT dataset, unit, cycle, sensor, tag,
    round_even(coalesce((value - lo) / nullif(hi - lo, 0), 0) * 1e9, 0) / 1e9 AS v
  FROM cells JOIN limits USING (dataset, sensor) JOIN tags USING (dataset, sensor)),
curves AS (SELECT dataset, unit, tag, cycle,
    round_even(list_reduce(list(v ORDER BY sensor), lambda a, b: a + b) / count(*) * 1e9, 0) / 1e9 AS y
  FROM scaled GROUP BY dataset, unit, tag, cycle),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset, unit, tag ORDER BY cycle) - 1 AS INTEGER) AS i,
    CAST(count(*) OVER (PARTITION BY dataset, unit, tag) AS INTEGER) AS n FROM curves)"""

STATES = (
    V.READINGS,
    V.TAGS,
    CURVES,
    knee_sql("placed", "dataset", "unit", "tag"),
    """
labelled AS (
  SELECT r.*, p.tag, CASE WHEN e.n < 2 OR p.i < edges[4] THEN 0 WHEN p.i < edges[7] THEN 1 WHEN p.i < edges[10] THEN 2 ELSE 3 END AS state
  FROM readings r JOIN placed p USING (dataset, unit, cycle) JOIN edges e ON e.dataset = r.dataset AND e.unit = r.unit AND e.tag = p.tag)""",
)


@query("d1_label_states", sql("SELECT dataset, unit, cycle, s2, s3, s4, s7, tag, state FROM labelled", *STATES))
def states(spark, sf):
    return label_states(V.readings(spark, sf), V.tags(spark), V.SENSORS)


@query(
    "d1_label_states_scaled",
    sql(
        """, wide AS (PIVOT (SELECT dataset, unit, cycle, sensor, v FROM scaled) ON sensor IN ('s2', 's3', 's4', 's7') USING max(v)
  GROUP BY dataset, unit, cycle)
SELECT dataset, unit, cycle, w.s2, w.s3, w.s4, w.s7, tag, state
FROM labelled JOIN wide w USING (dataset, unit, cycle)""",
        *STATES,
    ),
)
def states_scaled(spark, sf):
    return label_states(V.readings(spark, sf), V.tags(spark), V.SENSORS, emit="normalized")


def labelled(spark, sf):
    """The labelled readings, stored once per session for the queries that start from them."""
    return V._once(spark, sf, "labelled", lambda: states(spark, sf))


@query(
    "d2_auto_tag",
    sql(
        """, curve AS (SELECT dataset, sensor, cycle, avg(value) AS m
  FROM (UNPIVOT readings ON s2, s3, s4, s7 INTO NAME sensor VALUE value) GROUP BY dataset, sensor, cycle),
scored AS (SELECT dataset, sensor, round(corr(cycle, m), 6) AS r FROM curve GROUP BY dataset, sensor)
SELECT *, CASE WHEN r >= 0.6 THEN 'u' WHEN r <= -0.6 THEN 'd' WHEN coalesce(abs(r), 0) < 0.2 THEN 'o' ELSE 'c' END AS tag FROM scored""",
        V.READINGS,
    ),
)
def auto_tag(spark, sf):
    return scaling.auto_tag(scaling.mean_curves(V.readings(spark, sf), V.SENSORS))


# splits -------------------------------------------------------------------------------------------------------------


def group_split_sql(*key: str) -> str:
    text = " || ':' || ".join(["'42'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return sql(
        f"""SELECT dataset, unit, cycle, is_test FROM readings JOIN (
  SELECT {", ".join(key)}, row_number() OVER (ORDER BY md5({text})) <= ceil(round(0.2 * count(*) OVER (), 9)) AS is_test
  FROM (SELECT DISTINCT {", ".join(key)} FROM readings) g) s USING ({", ".join(key)})""",
        V.READINGS,
    )


@query("d3_group_split", group_split_sql("unit"))
def group_split(spark, sf):
    return splits.group_split(V.readings(spark, sf).select(*READING_KEY))


@query("d3_group_split_by_engine", group_split_sql("dataset", "unit"))
def group_split_by_engine(spark, sf):
    return splits.group_split(V.readings(spark, sf).select(*READING_KEY), ["dataset", "unit"])


@query(
    "d4_random_split",
    "SELECT event_id, CAST(('0x' || substr(md5(concat('42:', event_id)), 1, 8)) AS BIGINT) < floor(0.2 * 4294967296) AS is_test FROM events",
)
def random_split(spark, sf):
    return splits.random_split(V.table(spark, sf, "events").select("event_id"), ["event_id"])


@query(
    "d4_random_split_exact",
    """SELECT event_id, row_number() OVER (ORDER BY md5(concat('42:', event_id))) <= ceil(round(0.2 * count(*) OVER (), 9)) AS is_test
FROM events""",
)
def random_split_exact(spark, sf):
    return splits.random_split(V.table(spark, sf, "events").select("event_id"), ["event_id"], exact=True)


@query(
    "d5_stratified_split",
    """WITH c AS (SELECT quality, toxic, count(*) AS rows FROM labels GROUP BY quality, toxic),
f AS (SELECT *, floor(round(rows * 0.25, 9)) AS fl, round(rows * 0.25 - floor(round(rows * 0.25, 9)), 9) AS rest FROM c),
t AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, quality, toxic)
  <= ceil(round(sum(rows) OVER () * 0.25, 9)) - sum(fl) OVER () THEN 1 ELSE 0 END AS take FROM f)
SELECT doc_id, l.quality, l.toxic,
  row_number() OVER (PARTITION BY l.quality, l.toxic ORDER BY md5(concat('42:', doc_id))) <= take AS is_test
FROM labels l JOIN t ON l.quality = t.quality AND l.toxic = t.toxic""",
)
def stratified_split(spark, sf):
    rows = V.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return splits.stratified_split(rows, ["doc_id"], ["quality", "toxic"])


# masks and scenarios ------------------------------------------------------------------------------------------------


@query("d6_mask_random", sql(f"SELECT dataset, unit, cycle, {PARTS} FROM scenarios WHERE scenario = 3", V.READINGS, SCENARIOS))
def mask_random(spark, sf):
    return parts(masking.mask_random(features(spark, sf), READING_KEY, 3, 4))


BY_IMPORTANCE = """
places AS (SELECT list(place ORDER BY position) AS r FROM mask_order),
ordered AS (
  SELECT dataset, unit, cycle, scenario,
    list_transform([s2, s3, s4, s7], lambda v, i: CASE WHEN r[i] < scenario THEN -1.0 ELSE v END) AS features,
    list_aggregate(list_filter([CASE WHEN r[1] < scenario THEN 's2' END, CASE WHEN r[2] < scenario THEN 's3' END,
      CASE WHEN r[3] < scenario THEN 's4' END, CASE WHEN r[4] < scenario THEN 's7' END], lambda s: s IS NOT NULL), 'string_agg', ',') AS hidden
  FROM readings, places, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS scenario) g)"""


@query("d7_mask_by_importance", sql(f"SELECT dataset, unit, cycle, {PARTS} FROM ordered WHERE scenario = 2", V.READINGS, IMPORTANCE, BY_IMPORTANCE))
def mask_by_importance(spark, sf):
    order = masking.importance_order(importance(spark, sf), V.SENSORS)
    return parts(masking.mask_by_importance(features(spark, sf), order, 2, 4))


@query("d8_scenarios_random", sql(f"SELECT dataset, unit, cycle, scenario, {PARTS} FROM scenarios", V.READINGS, SCENARIOS))
def scenarios_random(spark, sf):
    return parts(scenario_rows(spark, sf))


@query(
    "d8_scenarios_by_importance",
    sql(f"SELECT dataset, unit, cycle, scenario, {PARTS}, coalesce(hidden, '') AS hidden FROM ordered", V.READINGS, IMPORTANCE, BY_IMPORTANCE),
)
def scenarios_by_importance(spark, sf):
    order = masking.importance_order(importance(spark, sf), V.SENSORS)
    rows = masking.scenarios(features(spark, sf), READING_KEY, 4, "importance", order, names=V.SENSORS)
    return parts(rows.withColumn("hidden", F.array_join("masked_sensors", ",")).drop("masked_sensors"))


STACKED = """
stacked AS (SELECT k, s.* FROM scenarios s JOIN (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS k) g ON scenario <= k)"""


@query("d9_stack", sql("SELECT k, scenario, count(*) AS rows FROM stacked GROUP BY k, scenario", V.READINGS, SCENARIOS, STACKED))
def stack(spark, sf):
    rows = scenario_rows(spark, sf)
    sets = [masking.stack(rows, k).select(F.lit(k).alias("k"), "scenario") for k in range(4)]
    every = sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(sets[3])
    return every.groupBy("k", "scenario").agg(F.count(F.lit(1)).alias("rows"))


@query("u2_append_scenarios", sql(f"SELECT dataset, unit, cycle, scenario, {PARTS} FROM stacked WHERE k = 1", V.READINGS, SCENARIOS, STACKED))
def append_scenarios(spark, sf):
    return parts(masking.stack(scenario_rows(spark, sf), 1))


# oversampling: bases(vec_id, label, copies) and the class neighbours give the synthetic rows ------------------------

COUNTS = """
classes AS (SELECT label, count(*) AS rows FROM vectors GROUP BY label),
goals AS (SELECT label, rows, CAST({goal} AS BIGINT) - rows AS new FROM classes)"""
ALL_CLASSES = COUNTS.format(goal="greatest(floor(rows * 2.5), rows + 1)")
TO_MAJORITY = COUNTS.format(goal="(SELECT max(rows) FROM classes)")


def spread_sql(source: str) -> str:
    """Even copies over the rows of ``source``, one more for the first of each class in md5 order."""
    return f"""
{source}_copies AS (
  SELECT vec_id, label, CAST(new // size + CASE WHEN place <= new % size THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM (SELECT s.vec_id, s.label, g.new, count(*) OVER (PARTITION BY s.label) AS size,
      row_number() OVER (PARTITION BY s.label ORDER BY md5(concat('42:spread:', s.vec_id))) AS place
    FROM {source} s JOIN goals g ON s.label = g.label) r)"""


def made_sql(copies: str, method: str) -> str:
    return f"""
drawn AS (
  SELECT c.vec_id, c.label, j, md5(concat_ws(':', '42', c.vec_id, j)) AS h
  FROM (SELECT *, unnest(range(1, copies + 1)) AS j FROM {copies}) c),
made AS (
  SELECT d.vec_id, concat('{method}:', j) AS synth_id, d.label, true AS is_synthetic,
    list_transform(list_zip(a.features, b.features),
      lambda p: p[1] + CAST(('0x' || substr(h, 9, 8)) AS BIGINT) / 4294967296.0::DOUBLE * (p[2] - p[1])) AS features
  FROM drawn d JOIN near n ON n.vec_id = d.vec_id AND n.rank = CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 5 + 1
  JOIN vectors a ON a.vec_id = d.vec_id JOIN vectors b ON b.vec_id = n.neighbour),
augmented AS (SELECT vec_id, '' AS synth_id, label, false AS is_synthetic, features FROM vectors
  UNION ALL SELECT vec_id, synth_id, label, is_synthetic, features FROM made)"""


CELLS = ", ".join(f"round(features[{n}], 6) AS f{n}" for n in range(1, 65))
AUGMENTED = f"SELECT vec_id, synth_id, label, is_synthetic, {CELLS} FROM augmented"
AROUND = KNN_ALL.replace("pairs", "all_pairs").replace("near AS", "around AS")
JUDGED = """
judged AS (SELECT vec_id, label, count(*) FILTER (other <> label) AS strangers FROM around WHERE rank <= {k} GROUP BY vec_id, label)"""
DANGER = JUDGED.format(k=10) + ",\ndanger AS (SELECT * FROM judged WHERE strangers * 2 >= 10 AND strangers < 10)"
ADASYN_COPIES = (
    JUDGED.format(k=5)
    + """,
adasyn_copies AS (
  SELECT j.vec_id, j.label, CAST(round_even(CAST(strangers AS DOUBLE) / sum(strangers) OVER (PARTITION BY j.label) * new, 0) AS BIGINT) AS copies
  FROM judged j JOIN goals g ON j.label = g.label)"""
)


def augmented(spark, sf, method, strategy="all", m=2.5):
    rows = oversample.oversample(V.vectors(spark, sf), "vec_id", "label", method, strategy, m)
    cells = [F.round(F.get("features", F.lit(n - 1)), 6).alias(f"f{n}") for n in range(1, 65)]
    return rows.select("vec_id", "synth_id", "label", "is_synthetic", *cells)


@query("d10_smote", sql(AUGMENTED, V.VECTORS, ALL_CLASSES, KNN_CLASS, spread_sql("vectors"), made_sql("vectors_copies", "smote")))
def smote(spark, sf):
    return augmented(spark, sf, "smote")


RAREST = (
    COUNTS.format(goal="floor(rows * 5.0)")
    .replace("goals AS", "every_goal AS")
    + ",\ngoals AS (SELECT * FROM every_goal ORDER BY rows, label LIMIT 1)"
)


@query("d10_smote_rarest", sql(AUGMENTED, V.VECTORS, RAREST, KNN_CLASS, spread_sql("vectors"), made_sql("vectors_copies", "smote")))
def smote_rarest(spark, sf):
    return augmented(spark, sf, "smote", "rarest", 5.0)


@query("d11_borderline_smote", sql(AUGMENTED, V.VECTORS, ALL_CLASSES, AROUND, DANGER, KNN_CLASS, spread_sql("danger"), made_sql("danger_copies", "borderline")))
def borderline(spark, sf):
    return augmented(spark, sf, "borderline")


@query("d12_adasyn", sql(AUGMENTED, V.VECTORS, ALL_CLASSES, AROUND, ADASYN_COPIES, KNN_CLASS, made_sql("adasyn_copies", "adasyn")))
def adasyn(spark, sf):
    return augmented(spark, sf, "adasyn")


@query(
    "d13_mix",
    sql(
        """, border AS (SELECT DISTINCT label FROM (
    SELECT vec_id, label, count(*) FILTER (other <> label) AS strangers FROM around GROUP BY vec_id, label) b
  WHERE strangers * 2 >= 10 AND strangers < 10),
parts AS (SELECT label, rows FROM classes UNION ALL SELECT label, 2 * new FROM goals
  UNION ALL SELECT label, 2 * new FROM goals SEMI JOIN border USING (label)
  UNION ALL SELECT label, 2 * copies FROM adasyn_copies)
SELECT label, CAST(sum(rows) AS BIGINT) AS rows FROM parts GROUP BY label""",
        V.VECTORS,
        TO_MAJORITY,
        AROUND,
        ADASYN_COPIES.replace("JOIN goals g ON j.label = g.label", "JOIN goals g ON j.label = g.label WHERE new > 0"),
    ),
)
def mix(spark, sf):
    rows = oversample.oversample(V.vectors(spark, sf), "vec_id", "label", "mix", "all", 3)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query("d14_unchanged_input", sql("SELECT label, count(*) AS rows, 0::BIGINT AS synthetic FROM vectors GROUP BY label", V.VECTORS))
def unchanged_input(spark, sf):
    rows = oversample.oversample(V.vectors(spark, sf), "vec_id", "label", "adasyn", "all", 1)
    synthetic = F.sum(F.col("is_synthetic").cast("bigint")).alias("synthetic")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), synthetic)


# model inputs -------------------------------------------------------------------------------------------------------


@query(
    "d15_assemble",
    sql(
        """SELECT 'RAW_RAW' AS frame, vec_id, label, 14::BIGINT AS features_n, round(list_sum(features[1:14]), 6) AS features_sum FROM vectors
UNION ALL SELECT 'EMBEDDING_RAW', vec_id, label, 64, round(list_sum(features), 6) FROM vectors
UNION ALL SELECT 'EMBEDDING_MIX_RAW', vec_id, label, 78, round(list_sum(features[1:14]) + list_sum(features), 6) FROM vectors""",
        V.VECTORS,
    ),
)
def assemble(spark, sf):
    raw, emb = raw_and_embedding(spark, sf)
    made = [
        frames.assemble(raw, emb, ["vec_id"], kind, frames.input_width(kind, 14, 64)).withColumn("frame", F.lit(kind))
        for kind in ("RAW_RAW", "EMBEDDING_RAW", "EMBEDDING_MIX_RAW")
    ]
    return totals(made[0].unionByName(made[1]).unionByName(made[2]), "features")


@query(
    "d16_teacher_student",
    sql(
        """SELECT vec_id, label, 64::BIGINT AS teacher_features_n, round(list_sum(features), 6) AS teacher_features_sum,
14::BIGINT AS student_features_n, round(list_sum(features[1:14]), 6) AS student_features_sum FROM vectors""",
        V.VECTORS,
    ),
)
def teacher_student(spark, sf):
    raw, emb = raw_and_embedding(spark, sf)
    return totals(frames.teacher_student_frames(raw, emb, ["vec_id"], "EMBEDDING_LOGITS", "RAW_LOGITS"), "teacher_features", "student_features")


@query(
    "d17_rows_to_json",
    sql(f"SELECT dataset, unit, cycle, scenario, {PARTS} FROM scenarios", V.READINGS, SCENARIOS),
)
def rows_to_json(spark, sf):
    masked = parts(scenario_rows(spark, sf))
    names = ["f1", "f2", "f3", "f4"]
    text = frames.rows_to_json(masked, names).select(*READING_KEY, "scenario", "text")
    return frames.rows_from_json(text, names)


@query(
    "d18_embed_text",
    sql(
        """SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(coalesce(value, 0), 6) AS value
FROM documents CROSS JOIN (SELECT unnest(range(0, 8)) AS dim) d
LEFT JOIN (SELECT doc_id, dim, avg(v) AS value FROM token_values GROUP BY doc_id, dim) p USING (doc_id, dim)""",
        TOKENS,
    ),
)
def embed_text(spark, sf):
    rows = frames.embed_text(V.table(spark, sf, "documents"), ["doc_id"], "text", 8)
    return rounded(rows.select("doc_id", F.posexplode("embedding").alias("dim", "value")), "value")


LETTERS = "aeiou"


def letter_counts():
    """A model that embeds a text by its vowels; made once a worker, called with arrays of texts."""

    def embed(texts):
        return np.array([[(t or "").count(c) for c in LETTERS] for t in texts.ravel()], dtype="float32").reshape(-1, len(LETTERS))

    return embed


@query(
    "d18_embed_with",
    f"""SELECT doc_id, CAST(i AS INTEGER) AS dim, CAST(len(coalesce(text, '')) - len(replace(coalesce(text, ''), substr('{LETTERS}', i + 1, 1), '')) AS DOUBLE) AS value
FROM documents CROSS JOIN (SELECT CAST(unnest(range(0, {len(LETTERS)})) AS INTEGER) AS i) d""",
)
def embed_with(spark, sf):
    rows = frames.embed_with(V.table(spark, sf, "documents").select("doc_id", "text"), "text", letter_counts, batch_size=64)
    return rows.select("doc_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))
