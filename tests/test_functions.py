import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.functions import losses, metrics, ops
from coppice.functions.distributions import CustomDistribution, DistributionOutput, beta_cdf, gamma_cdf, get_distribution, list_distributions, register_distribution


def test_special_functions():
    x = np.array([0.01, 0.5, 1.0, 3.7, 50.0, 1000.0])
    assert np.allclose(ops.lgamma(x), [math.lgamma(v) for v in x], atol=1e-8)
    h = 1e-4
    assert np.allclose(ops.digamma(x[1:]), [(math.lgamma(v + h) - math.lgamma(v - h)) / 2 / h for v in x[1:]], atol=1e-5)
    assert ops.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6)
    z = np.linspace(-5, 5, 41)
    assert np.allclose(ops.erf(z), [math.erf(v) for v in z], atol=1e-9)
    assert gamma_cdf(2.0, 1.0) == pytest.approx(1 - math.exp(-2)) and gamma_cdf(30.0, 5.0) == pytest.approx(1, abs=1e-6)
    assert beta_cdf(0.3, 2.0, 1.0) == pytest.approx(0.09)


def test_columns_equal_arrays(spark):
    p, y = np.array([-3.0, -0.5, 0.0, 0.4, 2.0]), np.array([0.0, 1.0, 1.0, 0.0, 1.0])
    df = spark.createDataFrame(list(zip(p.tolist(), y.tolist())), "p double, y double")
    for name in sorted(losses.BUILTIN):
        loss = losses.get_loss(name)
        g, h = loss(F.col("p"), F.col("y"))
        got = df.select(g, h, loss.monitored(F.col("p"), F.col("y"))).toPandas().to_numpy().T
        want = [np.broadcast_to(v, p.shape) for v in (*loss(p, y), loss.monitored(p, y))]
        assert np.allclose(got, want), name
    z = spark.range(-40, 41).select(F.col("id") / 10).toDF("z")
    got = z.select("z", ops.normal_cdf(F.col("z")).alias("c")).toPandas()
    assert np.allclose(got["c"], [0.5 * (1 + math.erf(v / math.sqrt(2))) for v in got["z"]], atol=2e-7)


@pytest.mark.parametrize("name", list_distributions())
def test_gradients_are_slopes_of_the_likelihood(name):
    family = get_distribution(name)
    raw = np.array([[0.3, -0.2], [0.1, 0.4], [1.0, 2.0]])[: len(family.names)]
    y = np.array([2.0, 1.0])
    got = family.gradient(y, family.params(raw))
    for i, g in enumerate(got):
        if name == "tweedie" and i == 1:
            continue  # the dispersion follows the deviance, not the series
        h = 1e-5
        up, down = raw.copy(), raw.copy()
        up[i] += h
        down[i] -= h
        slope = (family.nll(y, family.params(up)) - family.nll(y, family.params(down))) / (2 * h)
        assert np.allclose(g, slope, atol=1e-3), (name, i)


@pytest.mark.parametrize("name", list_distributions())
def test_quantiles_invert_and_draws_agree(name):
    family = get_distribution(name)
    raw = np.array([[0.7] * 3000, [0.2] * 3000, [2.0] * 3000])[: len(family.names)]
    p = family.params(raw)
    draws = family.sample(p, 1, np.random.default_rng(3))[:, 0]
    assert draws.mean() == pytest.approx(float(np.asarray(family.mean(p))[0]), rel=0.25, abs=0.15)
    one = {k: v[:1] for k, v in p.items()}
    if family.task not in ("count", "nonnegative"):
        assert family.cdf(family.quantile(one, 0.8), one)[0] == pytest.approx(0.8, abs=1e-3)
    else:
        assert family.cdf(family.quantile(one, 0.8), one)[0] >= 0.8 - 1e-6


def test_custom_distribution_and_registry():
    c = CustomDistribution(["loc"], ["identity"], lambda y, p: 0.5 * (y - p["loc"]) ** 2)
    raw = np.array([[1.0, 2.0]])
    assert np.allclose(c.gradient(np.array([0.0, 5.0]), c.params(raw))[0], [1.0, -3.0], atol=1e-4)

    class Mine(type(get_distribution("normal"))):
        pass

    register_distribution("Mine", override=True)(Mine)
    assert isinstance(get_distribution("MINE"), Mine)
    with pytest.raises(ValueError):
        register_distribution("mine")(Mine)


def test_distribution_output_and_pit(spark):
    df = spark.range(200).select(F.lit(1.0).alias("loc"), F.lit(2.0).alias("scale"), ((F.col("id") - 100) / 25.0).alias("y"))
    out = DistributionOutput(df, get_distribution("normal"), {"loc": "loc", "scale": "scale"})
    row = out.interval(0.1).first()
    assert row["upper"] - 1 == pytest.approx(2 * 1.6448536, abs=1e-5)
    a, b = (out.sample(3, 5).toPandas()["samples"].tolist() for _ in range(2))
    assert np.array_equal(np.array(a), np.array(b)) and len(a[0]) == 3
    pit = metrics.pit_values(out, "y")
    assert pit.filter("pit between 0 and 1").count() == 200
    assert metrics.pit_histogram(pit, F.col("pit"), 10).agg(F.sum("count")).first()[0] == 200
    d, p = metrics.ks_statistic(pit, F.col("pit"))
    assert 0 < d < 1 and 0 <= p <= 1
    fixed = metrics.PITRecalibrator.fit(pit, F.col("pit"))
    even = pit.withColumn("pit", fixed.column(F.col("pit")))
    assert metrics.ks_statistic(even, F.col("pit"))[0] < 0.05 < d


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0.9, 1.0), (0.0, 0.8, 1.0), (1.0, 0.8, 2.0), (0.0, 0.1, 1.0)], "y double, p double, w double")
    y, p, w = F.col("y"), F.col("p"), F.col("w")
    assert metrics.roc_auc_score(df, y, p) == pytest.approx(3.5 / 4)
    assert metrics.roc_auc_score(df, y, p, w) == pytest.approx((1 * 2 + 2 * 1.5) / 6)
    hard = (p > 0.5).cast("double")
    assert metrics.f1_score(df, y, hard) == pytest.approx(0.8)
    assert metrics.precision_score(df, y, hard) == pytest.approx(2 / 3)
    assert metrics.recall_score(df, y, hard, "macro") == pytest.approx(0.75)
    assert df.agg(metrics.r2_score(F.lit(1.0), p)).first()[0] == 0
    ece = metrics.expected_calibration_error(df, y, p, 2, "quantile").first()[0]
    assert 0 <= ece <= 1


def test_calibration_edges_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.10001,), (1.0,)], "p double")
    assert [r[0] for r in df.select(metrics.probability_bin(F.col("p"), 10)).collect()] == [0, 0, 1, 9]
