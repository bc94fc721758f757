"""Splits, masks, neighbours, oversampling, metrics and readers on small cases."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from fleetwear.functions import columns as C
from fleetwear.operators import frames, masking, metrics, models, neighbours, oversample, splits
from fleetwear.operators.reports import nested_report
from fleetwear.runtime import scratch_path
from fleetwear.sources import readers, writers

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(groups=st.integers(1, 40), share=st.sampled_from([0.1, 0.2, 0.5]), seed=st.integers(0, 99))
def test_group_split_is_exact_and_whole(spark, groups, share, seed):
    rows = spark.range(groups * 3).select((F.col("id") % groups).alias("unit"), "id")
    got = splits.group_split(rows, ["unit"], share, seed).toPandas()
    assert (got.groupby("unit")["is_test"].nunique() == 1).all()
    assert got[got["is_test"]]["unit"].nunique() == int(np.ceil(round(share * groups, 9)))


def test_exact_and_stratified_counts(spark):
    rows = spark.range(101).select("id", (F.col("id") % 10 > 7).cast("int").alias("c"))
    assert splits.random_split(rows, ["id"], exact=True).filter("is_test").count() == 21
    split = splits.stratified_split(rows, ["id"], ["c"], 0.25)
    counts = {r["c"]: r["count"] for r in split.filter("is_test").groupBy("c").count().collect()}
    assert sum(counts.values()) == 26 and abs(counts[1] - 5) <= 1
    again = splits.stratified_split(rows.repartition(7), ["id"], ["c"], 0.25)
    assert split.exceptAll(again).isEmpty()


def test_masks_are_nested(spark):
    rows = spark.range(20).select("id", F.array(*[F.lit(float(i)) for i in range(14)]).alias("features"))
    made = masking.scenarios(rows, ["id"], 14).toPandas()
    for _, g in made.groupby("id"):
        hidden = [set(np.flatnonzero(np.asarray(f) == -1.0)) for f in g.sort_values("scenario")["features"]]
        assert [len(h) for h in hidden] == list(range(14))
        assert all(a < b for a, b in zip(hidden, hidden[1:]))


def vectors(spark, n=90, copies=40):
    """Random vectors of two classes, with a block of equal ones."""
    rng = np.random.default_rng(0)
    x = np.round(rng.random((n, 3)), 3)
    x[:copies] = 0.5
    data = pd.DataFrame({"id": np.arange(n), "label": (np.arange(n) % 3 == 0).astype(int), "features": list(x)})
    rows = data.assign(features=[list(map(float, v)) for v in x])
    return data, spark.createDataFrame(rows, "id long, label long, features array<double>")


@pytest.mark.parametrize("limits", [{}, {"block_rows": 8, "fan": 4}])
@pytest.mark.parametrize("same", [None, "label"])
def test_neighbours_equal_brute_force(spark, same, limits):
    data, rows = vectors(spark)
    got = neighbours.knn(rows, rows, "id", "features", 4, same, **limits).toPandas().sort_values(["id", "rank"])
    x = np.stack(data["features"])
    for i in range(len(data)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        pool = [j for j in range(len(data)) if j != i and (same is None or data["label"][j] == data["label"][i])]
        best = sorted(pool, key=lambda j: (d[j], j))[:4]
        assert got[got["id"] == i]["neighbour"].tolist() == best


def test_smote_counts_and_segments(spark):
    data, rows = vectors(spark, copies=0)
    got = oversample.oversample(rows, "id", "label", "smote", "not_majority").toPandas()
    assert got.groupby("label").size().nunique() == 1
    members = np.stack(data[data["label"] == 1]["features"])
    own = dict(zip(data["id"], data["features"]))
    for r in got[got["is_synthetic"]].itertuples():
        p, a = np.asarray(r.features), np.asarray(own[r.id])
        gaps = [np.linalg.norm(p - a) + np.linalg.norm(b - p) - np.linalg.norm(b - a) for b in members]
        assert min(gaps) < 1e-9


def test_oversampling_gives_input_back(spark):
    rows = spark.createDataFrame([(i, int(i == 0), [float(i), 1.0]) for i in range(9)], "id int, label int, features array<double>")
    for method, strategy in (("smote", "rarest"), ("smote", "all"), ("adasyn", "all"), ("mix", "all")):
        assert oversample.oversample(rows, "id", "label", method, strategy, 3).count() == 9


def test_report_with_unseen_classes(spark):
    preds = spark.createDataFrame([(0, 0), (0, 1), (2, 0)], "label int, prediction int")
    report = metrics.class_report(metrics.confusion(preds)).toPandas().set_index("class")
    assert report.loc["1", "precision"] == 0 and report.loc["2", "recall"] == 0 and report.loc["1", "support"] == 0
    assert abs(report.loc["accuracy", "f1"] - 1 / 3) < 1e-12


def test_probabilities_sum_to_one(spark):
    row = spark.range(1).select(F.array(F.lit(-1.0), F.lit(2.0), F.lit(0.0)).alias("z"))
    for made in (C.softmax(F.col("z"), 4.0), C.clip_normalise(F.col("z"))):
        assert abs(sum(row.select(made.alias("p")).first()["p"]) - 1) < 1e-12


def test_sensor_text_with_blanks(spark):
    path = scratch_path(spark, "train_FD001")
    lines = [("  1   2  0.5 0.5 100.0 " + " ".join(["7.5"] * 20) + "   ",), ("",), ("2 1 x",)]
    writers.write_table(spark.createDataFrame(lines, "value string"), path, "text")
    got = readers.read_sensor_text(spark, path).orderBy("unit").collect()
    assert [(r["dataset"], r["unit"], r["cycle"]) for r in got] == [("FD001", 1, 2), ("FD001", 2, 1)]
    assert got[0]["s20"] == 7.5 and got[0]["s21"] is None and got[1]["set1"] is None


def test_scenario_layout_prunes(spark):
    path = scratch_path(spark, "layout")
    rows = spark.range(4).select("id", F.col("id").cast("int").alias("scenario"))
    writers.write_scenarios(rows, path, "RAW", "train")
    assert readers.read_scenarios(spark, path, scenario=2, stack=True).count() == 3
    plan = readers.read_scenarios(spark, path, scenario=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_importance_ignores_unknown_names(spark):
    known = spark.createDataFrame([("s2", 0.1), ("s9", 0.9), ("s3", 0.5)], "feature string, importance double")
    order = masking.importance_order(known, ["s2", "s3", "s4"])
    assert masking.order_ranks(order, 3) == [1, 0, 3]


def test_token_limit_and_empty_text(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, ""), (3, "a b")], "id int, text string")
    limited = {r["id"]: r["embedding"] for r in frames.embed_text(docs, ["id"], "text", 8, 2).collect()}
    assert limited[1] == limited[3] and limited[2] == [0.0] * 8


def test_student_and_nested_report(spark):
    rows = spark.createDataFrame(
        [(i % 2, [1.0 - i % 2, float(i % 2)], [float(i % 2), float(i)]) for i in range(20)],
        "label int, scores array<double>, features array<double>",
    )
    student = models.fit_student(rows, params={"maxIter": 5})
    assert models.predict(student, rows).filter("label = prediction").count() == 20
    flat = spark.createDataFrame([(0, 1, 0.5, 0.5, 0.5, 0.5)], "model_scenario int, scenario int, accuracy double, f1_score double, precision double, recall double")
    assert nested_report(flat).first()["value"].startswith('{"0":{"1":{"accuracy":0.5')


def test_null_classes_are_split_like_any_other(spark):
    rows = spark.createDataFrame([(k, None if k % 2 else "c") for k in range(40)], "id int, c string")
    got = splits.stratified_split(rows, ["id"], ["c"], 0.25).filter("is_test").groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in got} == {None: 5, "c": 5}


def test_hashed_keys_do_not_collide_by_spelling(spark):
    rows = [(None, "x"), ("x", None), ("a:b", "c"), ("a", "b:c"), ("a\\", ":c"), ("\\N", "x")]
    table = spark.createDataFrame(rows, "a string, b string")
    assert table.select(C.hash_text(1, F.col("a"), F.col("b")).alias("h")).distinct().count() == len(rows)


def test_student_of_logits(spark):
    rows = [(float(k % 2), [float(k % 2), 1.0], [-4.0 + 3 * (k % 2), -3.0 + k % 2 * 2]) for k in range(160)]
    table = spark.createDataFrame(rows, "label double, features array<double>, scores array<double>")
    fitted = models.predict(models.fit_student(table, is_prob=False), table)
    assert fitted.filter("label != prediction").count() == 0
    with pytest.raises(ValueError):
        models.fit_student(table)


def test_one_search_serves_all_methods(spark, monkeypatch):
    """The three methods of a mix, and further multipliers, share two searches; the rows are those of separate calls."""
    seen = []
    search = oversample.nearest_lists
    monkeypatch.setattr(oversample, "nearest_lists", lambda *a, **kw: seen.append(1) or search(*a, **kw))
    rows = spark.createDataFrame([(i, int(i % 3 == 0), [float(i * 7 % 11), float(i * 5 % 13)]) for i in range(30)], "id long, label int, features array<double>")
    searches = oversample.Searches()
    mixed = oversample.oversample(rows, "id", "label", "mix", "all", 3, k=3, searches=searches)
    oversample.oversample(rows, "id", "label", "mix", "all", 5, k=3, searches=searches)
    assert len(seen) == 2
    parts = [oversample.synthesise(rows, "id", "label", "features", method, "not_majority", 3, 3, 42) for method in ("smote", "adasyn", "borderline")]
    want = sum(part.count() for part in parts if part is not None)
    assert mixed.filter("is_synthetic").count() == 2 * want


def test_mask_draws_its_order_once_a_row(spark):
    """Also an order that differs at every evaluation hides exactly k positions."""
    values, order = F.array(*[F.lit(i + 0.5) for i in range(14)]), F.shuffle(F.sequence(F.lit(0), F.lit(13)))
    rows = spark.range(200).select(C.mask(values, order, 5).alias("v"))
    assert rows.filter(F.size(F.filter("v", lambda v: v == -1.0)) != 5).count() == 0


def test_partitioned_writes_keep_files_open(spark, tmp_path, monkeypatch):
    """Rows are not sorted by folder in the tasks; the setting ends with the write."""
    seen, save, name = [], DataFrameWriter.save, "spark.sql.maxConcurrentOutputFileWriters"
    monkeypatch.setattr(DataFrameWriter, "save", lambda self, path: seen.append(spark.conf.get(name)) or save(self, path))
    before = spark.conf.get(name)
    rows = spark.range(100).select("id", (F.col("id") % 20).cast("int").alias("scenario"))
    writers.write_scenarios(rows, str(tmp_path / "w"), "RAW", "train")
    assert int(seen[0]) >= 4 and spark.conf.get(name) == before
    back = readers.read_scenarios(spark, str(tmp_path / "w"), "RAW", "train", 7)
    assert sorted(r["id"] for r in back.collect()) == [7, 27, 47, 67, 87]


def test_sensor_text_is_cut_once(spark, tmp_path):
    """Lines are cut once, at runs of any blanks; lines without a first field are left out."""
    folder = tmp_path / "train_FD007"
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"  1\t 2  0.5 \n\n   \n\t3 4 5\n6 x\x0b7\f \n")
    rows = readers.read_sensor_text(spark, str(folder), 2)
    got = rows.select("dataset", "unit", "cycle", "set1", "set2").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [("FD007", 1, 2, 0.5, None), ("FD007", 6, None, 7.0, None)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_json_rows_are_parsed_only_where_they_must(spark):
    """Cutting at the commas gives what a JSON parser gives, also for texts that a cut does not fit."""
    numbers = [0.0, -0.0, -1.0, 6299.35, 1e-300, 1.7976931348623157e308, 5e-324, float("inf"), float("nan"), None]
    made = [(a, b, c) for a in numbers for b in numbers for c in (-1.5, None, float("-inf"))]
    texts = frames.rows_to_json(spark.createDataFrame(made, "f1 double, f2 double, `f,3` double"), ["f1", "f2", "f,3"]).select("text")
    odd = ['{"f2":2,"f1":1,"f,3":3}', '{"f1": 1.0, "f2":2.0,"f,3":3.0 }', '{"f1":1.0,"f2":2.0,"f,3":3.0,"z":4.0}', '{"f1":1.0}', "{}", "", "x,y,z", None]
    odd += ['{"f1":1,"f2":2e3,"f,3":-3E-2}', '{"f1":1.0}2,"f2":2.0,"f,3":3.0}', '{"f1":1.0,"f2":"2.0","f,3":3.0}', '{"f1":1.0,"f2":[2.0],"f,3":3.0']
    texts = texts.union(spark.createDataFrame([(t,) for t in odd], "text string"))
    for cols in (["f1", "f2", "f,3"], ["f1", "f2"], ["f1"], ["f2", "f1"]):
        schema = ", ".join(f"`{c}` double" for c in cols)
        parsed = texts.select("text", F.from_json("text", schema).alias("v")).select("text", *[F.col("v").getField(c).alias(c) for c in cols])
        got = frames.rows_from_json(texts.withColumn("kept", F.col("text")), cols).withColumnRenamed("kept", "text")
        bits = lambda df: sorted(map(repr, df.collect()))
        assert bits(got) == bits(parsed)
    plain = texts.select(F.col("text").alias("kept"), "text")
    assert "ELSE from_json" in frames.rows_from_json(plain, ["f1", "f2"])._jdf.queryExecution().optimizedPlan().toString()
