"""Rules that rows alone do not show: exact sample sizes under ties, weights that come back, bounds of quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.functions.distributions import create_custom_distribution
from coppice.functions.metrics import PITRecalibrator, ks_statistic, reliability_diagram
from coppice.functions.quantiles import kth_smallest
from coppice.operators.validation import ValidationError
from coppice.plans.boosting import DART, GradientBoosting
from coppice.plans.callbacks import EarlyStopping
from coppice.plans.distributional import NaturalBoost
from coppice.plans.gam import AdditiveModel
from coppice.plans.tuning import get_param_grid, suggest_params


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 2))
    y = x[:, 0] + 0.5 * rng.normal(size=2000)
    rows = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x0 double, x1 double, y double").cache()


@pytest.mark.parametrize("loss", ["mae", "quantile", "mse"])
def test_goss_keeps_the_same_number_of_rows_under_ties(data, loss, monkeypatch):
    seen = []
    inner = GradientBoosting._round

    def spy(self, matrix, pending, r, n, now=None):
        out = inner(self, matrix, pending, r, n, now)
        gradient = out.gradient

        def work(block):
            yield "n", np.array([(gradient(block)[1][0] > 0).sum()])

        seen.append(matrix.sums(work, {"n": (1,)})["n"])
        return out

    monkeypatch.setattr(GradientBoosting, "_round", spy)
    GradientBoosting(n_trees=2, max_depth=1, loss=loss, subsample_strategy="goss", goss_top_rate=0.2, goss_other_rate=0.1).fit(data, ["x0", "x1"], "y", id_col="id")
    assert [int(n[0]) for n in seen] == [400 + 160] * 2


def test_dart_restores_the_weights_of_the_best_round(data):
    train, held = data.filter("id < 200"), data.filter("id >= 200 and id < 400")
    model = DART(n_trees=25, max_depth=4, learning_rate=0.5, dropout_rate=0.5)
    model.fit(train, ["x0", "x1"], "y", eval_set=[held], callbacks=[EarlyStopping(patience=4)])
    found = model.predict(held).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    assert found == pytest.approx(model.best_score_, rel=1e-6)


def test_empirical_fisher_does_not_depend_on_blocks(spark, data):
    def family():
        return create_custom_distribution(["mu"], ["identity"], lambda y, p: 0.5 * (y - p["mu"]) ** 2, init_fn=lambda s: [s["mean"]])

    few = NaturalBoost(n_trees=3, max_depth=2, distribution=family()).fit(data.coalesce(1), ["x0", "x1"], "y")
    many = NaturalBoost(n_trees=3, max_depth=2, distribution=family()).fit(data.repartition(7), ["x0", "x1"], "y")
    a, b = ([r[0] for r in m.predict(data).orderBy("id").select("prediction").collect()] for m in (few, many))
    assert np.allclose(a, b)


def test_models_that_do_not_sample_say_so(data):
    with pytest.raises(ValidationError):
        AdditiveModel(n_trees=2, subsample=0.5).fit(data, ["x0", "x1"], "y")


def test_kth_smallest_is_exact(spark):
    values = [1e300, -1e300, 0.0, 1e-300, 5.0, 5.0, 5.0, -3.0, None, 7.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(v for v in values if v is not None)
    assert [kth_smallest(df, F.col("v"), k + 1) for k in range(len(ordered))] == ordered


def test_calibration_of_pit_values(spark):
    rng = np.random.default_rng(1)
    u = rng.uniform(size=500) ** 2
    df = spark.createDataFrame([(float(v),) for v in u], "u double")
    ordered = np.sort(u)
    want = max(np.abs(np.arange(1, 501) / 500 - ordered).max(), np.abs(np.arange(500) / 500 - ordered).max())
    assert ks_statistic(df, F.col("u"))[0] == pytest.approx(want)
    fixed = PITRecalibrator.fit(df, F.col("u"))
    assert np.allclose(fixed.transform(ordered), (np.arange(1, 501) - 0.5) / 500)
    got = [r[0] for r in df.orderBy("u").select(fixed.column(F.col("u"))).collect()]
    assert np.allclose(got, (np.arange(1, 501) - 0.5) / 500)
    levels = [r["nominal"] for r in reliability_diagram(df, F.col("u"), 4).orderBy("nominal").collect()]
    assert levels == [0.125, 0.375, 0.625, 0.875]


def test_suggestions_and_grids(spark, data):
    small = suggest_params(data.limit(500), ["x0", "x1"], "y")
    assert (small["n_estimators"], small["reg_lambda"], small["min_child_weight"], small["max_depth"]) == (100, 10.0, 3.0, 4)
    assert suggest_params(data, ["x0"] * 120, "y", style="core") == {"n_trees": 200, "learning_rate": 0.1, "max_depth": 5, "reg_lambda": 1.0, "min_child_weight": 1.0, "colsample_bytree": 0.6}
    uneven = data.withColumn("c", (F.col("id") < 100).cast("int"))
    assert suggest_params(uneven, ["x0"], "c", "classification") | {"n_estimators": 300, "learning_rate": 0.05} == suggest_params(uneven, ["x0"], "c", "classification")
    assert get_param_grid("classification")["max_depth"] == [3, 5, 7] and "subsample" not in get_param_grid("distributional")
    with pytest.raises(ValueError):
        get_param_grid("other")
