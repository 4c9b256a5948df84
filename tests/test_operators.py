"""Behaviour that the SQL comparison doesn't show."""

import math

import pytest
from pyspark.sql import functions as F

from rolegrain.functions import expressions as X
from rolegrain.operators import categorical, dates, insight, metrics, models, numeric, reader, relational, report, target
from rolegrain.plans import jobs, pipelines
from rolegrain.plans.roles import NAMES, Role, RoleFrame
from rolegrain.sources import io
from rolegrain.streaming.apply import transform_stream


def test_out_of_fold_encoding_differs_from_full(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", i % 3, int(i % 4 == 0 or i < 7)) for i in range(61)], "id int, c string, fold int, y int")
    model, scores = target.fit_te(df, ["c"], "fold", "y")
    prior = 0.25
    train = target.apply_te(df, model, ["c"], prior, "fold")
    new = target.apply_te(df.withColumn("c", F.when(F.col("id") == 0, "z").otherwise(F.col("c"))), model, ["c"], prior)
    assert train.count() == 61 and scores.count() == 8
    assert new.where("id = 0").first()["oof__c"] == prior
    assert train.select("c", "oof__c").distinct().count() > new.where("c <> 'z'").select("c", "oof__c").distinct().count()


def test_null_intersections_share_no_bucket(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "x string, y string")
    out, names = categorical.with_intersections(df, ["x", "y"])
    codes = categorical.label_encode(out, categorical.fit_labels(out, names), names)
    assert [r[0] for r in codes.select(f"`le__{names[0]}`").orderBy("x", "y").collect()] == [0, 0, 1]


def test_ordinal_passes_numbers_and_puts_nan_last(spark):
    df = spark.createDataFrame([("b", 7), ("a", 8), ("NaN", 9), (None, 1)], "s string, n int")
    model = categorical.fit_labels(df, ["s"], order="alphabetAsc", nan_last=True)
    rows = {r["s"]: (r["ord__s"], r["ord__n"]) for r in categorical.ordinal_encode(df, model, ["s", "n"]).collect()}
    assert rows == {"a": (1.0, 8.0), "b": (2.0, 7.0), "NaN": (3.0, 9.0), None: (0.0, 1.0)}


def test_bins_keep_nan_at_zero_when_quantiles_coincide(spark):
    df = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,), (math.nan,)], "x double")
    out = numeric.quantile_bin(df, numeric.fit_bins(df, ["x"], 5))
    assert {r["x"]: r["qntl__x"] for r in out.where("not isnan(x)").collect()}[1.0] >= 1
    assert out.where("isnan(x)").first()["qntl__x"] == 0


def test_scaler_without_spread(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r[0] for r in numeric.standard_scale(df, numeric.fit_numeric(df, ["x"])).select("scaler__x").collect()] == [0.0, 0.0]


def test_averages(spark):
    df = spark.range(1).select(F.array(F.lit(None).cast("double"), F.lit(2.0)).alias("a"), F.array(F.lit(None).cast("array<double>")).alias("v"))
    r = df.select(X.scalar_average(F.col("a")), X.vector_average(F.col("v"), 2), X.weighted_average([F.lit(None).cast("double"), F.lit(4.0)], [0.9, 0.1])).first()
    assert (r[0], r[1], r[2]) == (2.0, [0.0, 0.0], 4.0)


def test_date_replacement_clamps(spark):
    df = spark.range(1).select(F.to_date(F.lit("2024-02-29")).alias("a"), F.to_date(F.lit("2023-01-31")).alias("b"))
    r = df.select(X.replace_year(F.col("a"), F.lit(2023)).cast("string"), X.replace_month(F.col("b"), F.lit(2)).cast("string"), X.replace_weekday(F.col("b"), F.lit(0)).cast("string")).first()
    assert tuple(r) == ("2023-02-28", "2023-02-28", "2023-01-30")


def test_holidays_of_all_types(spark):
    df = spark.sql("select 1609372800 as a, '2020-12-31' as b, date'2022-03-08' as c, timestamp'2020-12-31 10:00:00' as d union all select 0, 'x', date'2022-03-09', null")
    days = spark.createDataFrame([(c, d) for c in "abcd" for d in ("2020-12-31", "2022-03-08")], "col string, day string")
    out = dates.is_holiday(df, days, list("abcd")).select(*[f"season_hol__{c}" for c in "abcd"]).collect()
    assert sorted(map(tuple, out)) == [(False,) * 4, (True,) * 4]


def test_degenerate_alphas_are_penalised(spark):
    df = spark.createDataFrame([(i, str(i % 2), i % 2, i % 2) for i in range(40)], "id int, c string, fold int, y int")
    assert all(r["score"] is not None and r["score"] > 0 for r in target.alpha_scores(df, ["c"], "fold", "y").collect())


def test_permutation_keeps_the_values(spark):
    df = spark.range(200).select("id", (F.col("id") * 2).alias("x"))
    out = insight.permute(df, "x", "id")
    rows = out.collect()
    assert sorted(r["x"] for r in rows) == [2 * i for i in range(200)]
    assert sum(r["x"] == 2 * r["id"] for r in rows) < 20


def test_roles_and_frames_survive_saving(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, i % 3, float(i)) for i in range(10)], "_id int, y int, fold int, `scaler__inter__(A__B)` double")
    frame = RoleFrame(df, "_id", {"scaler__inter__(A__B)": Role.of("Numeric", force_input=True)}, "y", "fold")
    io.save_frame(frame, str(tmp_path / "f"), partitions=3)
    back = io.load_frame(spark, str(tmp_path / "f"))
    assert back.roles == frame.roles and sorted(map(tuple, back.df.collect())) == sorted(map(tuple, df.collect()))
    for n in NAMES:
        assert Role.from_json(Role.of(n, seasonality=("y", "m")).to_json()) == Role.of(n, seasonality=("y", "m"))
    with pytest.raises(ValueError):
        io.read(spark, "x.feather")


def test_csv_and_models_as_tables(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "k string, v int").write.csv(str(tmp_path / "x.csv"), header=True)
    assert io.read(spark, str(tmp_path / "x.csv"), ["k"]).first()[0] == "a"
    io.save_model({"labels": spark.range(3).toDF("idx")}, str(tmp_path / "m"), {"kind": "le"})
    tables, about = io.load_model(spark, str(tmp_path / "m"))
    assert tables["labels"].count() == 3 and about["kind"] == "le"


def test_plan_layers_and_new_data_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i), i % 2, i % 3) for i in range(30)], "id int, c string, x double, y int, fold int")
    frame = RoleFrame(df, "id", {"c": Role.of("Category"), "x": Role.of("Numeric")}, "y", "fold")
    plan = pipelines.linear(frame)
    out = plan.fit_transform(frame)
    assert out.columns[:3] == ["id", "y", "fold"] and out.count() == 30
    a = pipelines.Step("a", ["x"], ["m"], None)
    b = pipelines.Step("b", ["m"], ["n"], None)
    assert [[s.name for s in layer] for layer in pipelines.layers([b, a])] == [["a"], ["b"]]
    with pytest.raises(ValueError):
        pipelines.layers([pipelines.Step("a", ["n"], ["m"], None), b])
    df.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    q = transform_stream(plan, stream, ["id"]).writeStream.format("memory").queryName("planned").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("planned").count() == 30


def test_slots_keep_order_and_raise():
    assert jobs.run_parallel([lambda i=i: i * i for i in range(5)], 3) == [0, 1, 4, 9, 16]
    with pytest.raises(ZeroDivisionError):
        jobs.run_parallel([lambda: 1, lambda: 1 / 0], 2)
    assert jobs.Deadline(0).over() and not jobs.Deadline(60).over()


def test_persistence_scopes(spark):
    p = jobs.Persistence()
    with p.scope():
        assert p.persist("a", spark.range(3)).count() == 3 and "a" in p.kept
    assert not p.kept


def test_selection_and_search():
    imp = {"a": 3.0, "b": 0.0, "c": 1.0}
    assert models.cutoff(imp, forced=("b",)) == ["a", "b", "c"] and models.cutoff(imp) == ["a", "c"]
    assert models.forward_selection(imp, lambda f: len(set(f) & {"a", "c"}) - 0.1 * len(f)) == ["a", "c"]
    best, score, tried = models.random_search(lambda p: -abs(p["x"] - 0.5), {"x": lambda r: r.random()}, 20)
    assert score == max(s for _, s in tried) and abs(best["x"] - 0.5) < 0.2
    assert [models.trials_for(n) for n in (1, 20_000, 50_000, 10**6)] == [100, 50, 10, 5]
    with pytest.raises(NotImplementedError):
        models.estimator("cb", "reg", "y")


def test_weights_are_honoured(spark):
    df = spark.createDataFrame([(i, float(i), float(-i), float(i)) for i in range(50)], "id int, good double, bad double, y double")
    w = models.fit_weights(df, ["good", "bad"], "reg", "y", rounds=2)
    assert w == [1.0, 0.0]


def test_columns_by_wildcard_and_validation_marks(spark):
    df = spark.createDataFrame([(1, 2, None)], "a_x int, a_y int, fold int")
    assert relational.select_columns(df, ["a_*"], ["zz", "fold"]).columns == ["a_x", "a_y", "fold"]
    assert relational.mark_validation(df, "fold", 0).first()["is_val"] == 1


def test_role_guesses(spark):
    df = spark.sql("select cast(null as string) as empty, true as b, map('a', 1) as m, array(1.0D) as v, cast(1.5 as decimal(3,1)) as d, 'x' as s")
    roles = {r["col"]: r["role"] for r in reader.guess_roles(df.drop("m"), ["empty", "b", "v", "d", "s"]).collect()}
    assert roles == {"empty": "Drop", "b": "Category", "v": "NumericVectorOrArray", "d": "Numeric", "s": "Category"}


def test_metrics_leave_out_nulls(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (None, 0.9), (1, None)], "y int, s double")
    assert metrics.log_loss(df, "y", "s").first()[0] == pytest.approx(math.log(2))
    assert metrics.regression(df, "y", "s").first()["mae"] == 0.5 and metrics.confusion(df, "y", "s").count() == 2


def test_metrics_on_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert metrics.auc(df, "y", "s").first()[0] == pytest.approx(0.875)
    assert "<table>" in report.render("r", {"auc": metrics.auc(df, "y", "s")})
