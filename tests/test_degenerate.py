"""Estimators and metrics where something that they divide by is 0 or missing."""

import math

from tickweave.ml import evaluation as ev
from tickweave.plans import model_specs, panels
from tickweave.stats import metric_bootstrap, regression


def test_metrics_of_groups_without_calls_or_labels(spark):
    rows = spark.createDataFrame([(1, 1, 0.2), (1, 0, 0.1), (2, 0, 0.9), (3, 0, 0.1)], "g int, y int, s double")
    got = {r.g: r for r in ev.metrics(rows, "s", "y", 0.5, ["g"]).collect()}
    assert math.isnan(got[1].precision) and got[1].recall == 0 and got[1].f1 == 0
    assert got[2].precision == 0 and math.isnan(got[2].recall) and math.isnan(got[3].f1)
    ap = {r.g: r.ap for r in ev.average_precision(rows, "s", "y", ["g"]).collect()}
    assert ap[1] == 1 and math.isnan(ap[2]) and math.isnan(ev.average_precision(rows.where("y = 0"), "s", "y").first().ap)
    assert math.isnan({r.g: r.auc for r in ev.roc_auc(rows, "s", "y", ["g"]).collect()}[2])


def _of(rows):
    return lambda spark, d, spec: spark.createDataFrame(rows, "market string, dy long, y double, x1 double, x2 double")


def test_models_whose_second_regressor_is_constant(spark, monkeypatch):
    monkeypatch.setattr(model_specs, "_sample", _of([(m, i % 3, float(i * i % 7), float(i), 0.0) for m in "ab" for i in range(9)]))
    out = model_specs._family({"one": model_specs.SENSITIVITY["80_log"]})(spark, "").collect()
    assert [r.term for r in out] == ["x1", "x2", "sum"]
    assert all(math.isnan(r.estimate) and math.isnan(r.error) and r.clusters == 3 for r in out)


def test_models_of_an_outcome_that_does_not_vary(spark, monkeypatch):
    monkeypatch.setattr(model_specs, "_sample", _of([(m, i % 3, 1.0, float(i), float(i * i % 5)) for m in "ab" for i in range(9)]))
    out = model_specs._family({"one": model_specs.TWO_PART["any"]})(spark, "").collect()
    assert [(r.term, r.estimate, r.error) for r in out] == [("x1", 0, 0), ("x2", 0, 0), ("sum", 0, 0)]
    fit = regression.Fit(model_specs._sample(spark, "", None), "y", ["x1", "x2"])
    assert fit.identified and math.isnan(fit.contrast([1.0, 0.0], fit.bread * 0, 3)[2])


def test_models_of_a_single_day(spark, monkeypatch):
    monkeypatch.setattr(model_specs, "_sample", _of([(m, 0, float(i * i % 7), float(i), float(i * i % 5)) for m in "ab" for i in range(9)]))
    out = model_specs._family({"one": model_specs.TWO_PART["size"]})(spark, "").collect()
    assert [r.term for r in out] == ["x1", "x2", "sum"]
    assert all(math.isfinite(r.estimate) and not math.isfinite(r.error) and r.clusters == 1 for r in out)
    fit = regression.Fit(model_specs._sample(spark, "", None), "y", ["x1", "x2"])
    assert all(map(math.isnan, fit.contrast([1.0, 0.0], fit.bread, 1)[2:]))


def test_increments_without_a_score_at_the_threshold(spark):
    rows = spark.createDataFrame([(i % 5, i % 2, i / 40, (i * 7 % 20) / 40) for i in range(20)], "c int, y int, a double, b double")
    assert {r.metric for r in metric_bootstrap.increments(rows, "c", "y", "a", "b", 0.9, draws=9).collect()} == {"average_precision", "brier"}
    few = spark.createDataFrame([(i % 5, i % 2, 0.95 if i == 0 else i / 40, 0.95 if i < 5 else 0.1) for i in range(20)], "c int, y int, a double, b double")
    found = metric_bootstrap.draws_of(few, "c", "y", {"base": "a", "full": "b"}, 0.9, draws=9).collect()
    without = {r.draw for r in found if r.model == "base" and r.f1 is None}
    assert without == {k for k in range(9) if metric_bootstrap.times_drawn(k, 5)[0] == 0} and without


def test_scaling_of_a_column_without_values(spark):
    rows = spark.createDataFrame([("a", None, 1.0), ("b", None, None), ("c", None, 3.0)], "key string, u double, v double")
    got = sorted((r.key, r.u, r.u_missing, r.v) for r in ev.robust_scaled(rows, ["u", "v"]).collect())
    assert got == [("a", None, 1, -1.0), ("b", None, 1, 0.0), ("c", None, 1, 1.0)]


def test_cell_support_lists_every_market_of_an_hour(spark):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        return
    found = panels.cell_support(spark, folder).collect()
    four = {(r.bucket, r.market) for r in found if r.least == 4}
    assert len(four) > 4 and len(four) == sum(r.least == 4 for r in found)
    assert {r.least for r in found} <= set(panels.SUPPORT) and four <= {(r.bucket, r.market) for r in found if r.least == 2}


def test_a_small_table_for_models_has_few_partitions(spark, monkeypatch):
    from tickweave.ml import models

    seen = []
    fit = models._fit_scores
    monkeypatch.setattr(models, "_fit_scores", lambda train, *more: (seen.append(train.rdd.getNumPartitions()), fit(train, *more))[1])
    rows = spark.range(240).selectExpr("id % 8 AS dy", "id AS at", "cast(id * 7 % 3 = 0 AS int) AS label", "cast(id % 11 AS double) AS x").repartition(64)
    out = models.holdout_scores(rows, "logistic", models.LOGISTIC[:1], ["x"], "label", "dy", "at")
    assert out.count() == 60 and max(seen) == 1


def test_the_index_of_stages_is_not_made_in_one_task_of_many_partitions(spark, tmp_path):
    from tickweave.sources import stages

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        spark.range(40).selectExpr("cast(id % 2 AS string) AS k", "id").write.partitionBy("k").parquet(f"{tmp_path}/in")
        store = spark._jvm.org.apache.spark.sql.classic.SparkSession.active().sharedState().statusStore()
        known = store.executionsCount()
        stages.staged(spark, f"{tmp_path}/store", "s", "1", f"{tmp_path}/in", "k", lambda rows: rows.groupBy("k").count()).collect()
        plans = [store.execution(i).get().physicalPlanDescription() for i in range(known, store.executionsCount()) if store.execution(i).isDefined()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    index = [p for p in plans if "InsertIntoHadoopFs" in p and "/index" in p]
    assert index and not any("Coalesce (" in p for p in index)


def test_nested_folds_of_a_small_table_have_few_partitions(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tickweave.ml import models

    seen = []
    monkeypatch.setattr(models, "_fit_scores", lambda train, test, *more: (seen.append((train.rdd.getNumPartitions(), test.rdd.getNumPartitions())), test.withColumn("score", F.col("x") / 11))[1])
    rows = spark.range(240).selectExpr("id % 8 AS dy", "cast(id * 7 % 3 = 0 AS int) AS label", "cast(id % 11 AS double) AS x").repartition(64)
    out = models.nested_scores(rows, "forest", models.FOREST[:1], ["x"], "label", "dy", outer=2, inner=2)
    assert out.count() == 240 and len(seen) == 2 * 3 and set(seen) == {(1, 1)}


def test_family_ablation_makes_its_samples_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tickweave.ml import models
    from tickweave.plans import estimators

    made, rows = [], spark.range(240).selectExpr("id % 8 AS dy", "id AS bucket", "cast(id * 7 % 3 = 0 AS int) AS label", *[f"cast(id % {n} AS double) AS {f}" for n, f in ((11, "gross"), (7, "size"), (5, "n_wallets"))])
    monkeypatch.setattr(estimators, "_samples", lambda *_: (made.append(1), rows.repartition(64))[1])
    monkeypatch.setattr(models, "holdout_scores", lambda rows, kind, grid, features, label, *more: rows.select(label, (F.col(features[0]) / 11).alias("score"), F.lit(0.5).alias("cut")))
    out = estimators.family_ablation(spark, "").collect()
    assert len(made) == 1 and len(out) == 6 * 4 and {r.without for r in out} == {"none", *estimators.FAMILIES}
