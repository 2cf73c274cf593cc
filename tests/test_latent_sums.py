"""The head from sums over pairs, against Spark ML's regression and against fits of their own."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from shelfwise.operators import latent as LT
from shelfwise.operators.cf import CFModel
from shelfwise.operators.evaluation import fold_assign


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(0)
    users, items = rng.normal(size=(30, 4)), rng.normal(size=(20, 4)) + 0.5
    make = lambda m, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, features array<double>").checkpoint()
    cf = CFModel(make(users, "user_id"), make(items, "book_id"))
    rows = [(int(u), int(i), float(users[u] @ items[i] + users[u, 0] + rng.normal())) for u in range(30) for i in rng.choice(20, 9, replace=False)]
    return cf, spark.createDataFrame(rows + [(99, 1, 1.0), (1, 99, 1.0)], "user_id long, book_id long, strength double").repartition(3).checkpoint()


def test_solution_is_spark_mls(spark, pairs):
    cf, m = pairs
    x = F.concat(F.zip_with("p", "q", lambda a, b: a * b), "p", "q")
    rows = (m.join(cf.users.withColumnRenamed("features", "p"), "user_id").join(cf.items.withColumnRenamed("features", "q"), "book_id")
            .select(array_to_vector(x).alias("x"), "strength"))
    sums = LT.head_sums(m, cf)
    assert sums.n == 270
    for reg in (0.0, 1e-5, 0.1, 3.0):
        fit = LinearRegression(featuresCol="x", labelCol="strength", regParam=reg, solver="normal").fit(rows)
        coef, intercept = sums.solve(reg)
        assert np.allclose(coef, fit.coefficients.toArray(), atol=1e-6) and intercept == pytest.approx(fit.intercept, abs=1e-6)
        assert sums.mse(coef, intercept) == pytest.approx(fit.summary.meanSquaredError, rel=1e-8)


def test_sums_of_nothing_and_of_constants(spark, pairs):
    cf, m = pairs
    none = LT.head_sums(m.limit(0), cf)
    assert none.n == 0 and math.isnan(none.mse([], 0.0))
    with pytest.raises(ValueError):
        none.solve(0.1)
    coef, intercept = LT.head_sums(m.withColumn("strength", F.lit(2.0)), cf).solve(0.1)
    assert coef == [0.0] * 12 and intercept == pytest.approx(2.0)


def test_grid_equals_fits_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(u), int(b), float(rng.integers(1, 6)), "rating", f"2024-01-{1 + i % 28:02d} 10:00:00") for i, (u, b) in
            enumerate((u, b) for u in range(25) for b in rng.choice(30, 8, replace=False))]
    log = spark.createDataFrame(rows, "user_id long, book_id long, strength double, type string, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")).checkpoint()
    fits = []
    train = LT.als_train
    monkeypatch.setattr(LT, "als_train", lambda *a, **b: fits.append(b) or train(*a, **b))
    got = LT.grid_search(log, {"reg": [1e-5, 0.3], "rank": [3], "max_iter": [4]}, n_splits=2).collect()
    assert len(fits) == 2  # one for each fold
    for r, reg in zip(got, (1e-5, 0.3)):
        errors = []
        for f in range(2):
            folds = fold_assign(log, 2, 42)
            model = LT.latent_train(folds.where(f"fold <> {f}").drop("fold"), rank=3, max_iter=4, reg=reg, seed=42 + f)
            test = LT.agg_strength(folds.where(f"fold = {f}").drop("fold"))
            errors.append(math.sqrt(model.predict(test).agg(F.avg((F.col("strength") - F.col("prediction")) ** 2)).first()[0]))
        assert r["avg_score"] == pytest.approx(sum(errors) / 2, abs=1e-6)
    assert [r["is_best"] for r in got] == [got[0]["avg_score"] <= got[1]["avg_score"], got[0]["avg_score"] > got[1]["avg_score"]]


def test_folds_metrics_are_made_fold_by_fold(spark):
    rows = [(u, (u * 7 + j * 3) % 20, float(1 + (u + j) % 5), "rating", f"2024-01-{1 + (u + j) % 28:02d} 10:00:00") for u in range(20) for j in range(6)]
    log = spark.createDataFrame(rows, "user_id long, book_id long, strength double, type string, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")).checkpoint()
    out = LT.cross_validate(log, n_splits=2, rank=2, max_iter=2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan  # else all folds' joins run at once, at the end
    found = {(r["fold"], r["metric"]): r["value"] for r in out.collect()}
    assert {m for _, m in found} == {"mse", "rmse", "hit_rate@10", "coverage@10"} and len(found) == 8


def test_predictions_join_no_factors(spark, pairs):
    cf, m = pairs
    model = LT.LatentModel(cf, [0.5, 0.1, 0.2, 0.3] * 3, 0.7, m.select("user_id", "book_id"))
    out = model.predict(m)
    assert out.columns == ["book_id", "user_id", "strength", "prediction"] and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    u, v = ({r[0]: np.array(r["features"]) for r in x.collect()} for x in (cf.users, cf.items))
    h = np.array([0.5, 0.1, 0.2, 0.3])
    assert all(r.prediction == pytest.approx((u[r.user_id] * v[r.book_id]) @ h + u[r.user_id] @ h + v[r.book_id] @ h + 0.7) for r in out.collect())
    assert out.count() == 270
