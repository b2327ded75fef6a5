import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.functions.losses import register_loss, unregister_loss
from coppice.operators.growth import GrowthStrategy, LevelWise, get_growth_strategy, register_growth_strategy
from coppice.operators.splits import GrowthConfig, best_split
from coppice.operators.tree import Split, Tree
from coppice.operators.validation import ValidationError, validate_predict_input
from coppice.plans.boosting import DART, GradientBoosting, MultiClassGradientBoosting, TreeModel
from coppice.plans.callbacks import Callback, EarlyStopping, HistoryCallback, LearningRateScheduler, ProfilingCallback
from coppice.plans.distributional import NaturalBoostNormal, NaturalBoostPoisson
from coppice.plans.estimators import Classifier, GAMClassifier, LinearLeafRegressor, Regressor
from coppice.plans.gam import AdditiveModel, pava, smoothed
from coppice.plans.importance import compute_feature_importances, importance_table
from coppice.plans.linear_leaf import LinearLeafGBDT
from coppice.plans.tuning import ConfigBatch, cross_val_predict_interval, cross_val_predict_proba, fit_batch

FEATURES = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.RandomState(42)
    x = r.randn(400, 3)
    y = x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.1 * r.randn(400)
    rows = [(i, *map(float, v), float(t), float(t > 0.5), int(np.argmax(v)), float(r.poisson(np.exp(0.3 * v[0])))) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, x0 double, x1 double, x2 double, y double, b double, c int, n double").repartition(3).cache()


def boosted(x, y, rounds, depth, rate, lam=1.0, weight=1.0):
    """Squared-error boosting on one machine, level by level, over bins of the sorted distinct values' quantiles."""
    bins = []
    for column in x.T:
        edges = np.unique(np.percentile(column, np.linspace(0, 100, 255)[1:-1]))
        bins.append(np.minimum(np.searchsorted(edges, column, "right"), len(edges) - 1))
    bins = np.array(bins)
    p = np.full(len(y), y.mean())
    for _ in range(rounds):
        g = p - y

        def grow(rows, d):
            G, H = g[rows].sum(), float(len(rows))
            best = (0.0, None, None)
            if d < depth:
                for f in range(len(bins)):
                    for t in range(255):
                        left = rows[bins[f][rows] <= t]
                        hl, hr = len(left), len(rows) - len(left)
                        if hl < weight or hr < weight:
                            continue
                        gl = g[left].sum()
                        gain = gl**2 / (hl + lam) + (G - gl) ** 2 / (hr + lam) - G**2 / (H + lam)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, t)
            if best[1] is None:
                p[rows] += rate * -G / (H + lam)
                return
            inside = bins[best[1]][rows] <= best[2]
            grow(rows[inside], d + 1)
            grow(rows[~inside], d + 1)

        grow(np.arange(len(y)), 0)
    return p


def test_levelwise_equals_one_machine(spark, data):
    pdf = data.orderBy("id").limit(120).toPandas()
    df = spark.createDataFrame(pdf).repartition(3)
    expected = boosted(pdf[FEATURES].to_numpy(), pdf["y"].to_numpy(), 2, 2, 0.3)
    model = GradientBoosting(n_trees=2, max_depth=2, learning_rate=0.3).fit(df, FEATURES, "y")
    got = model.predict(df).orderBy("id").toPandas()["prediction"].to_numpy()
    assert np.allclose(got, expected)
    native = df.withColumn("e", model.expression(df)).orderBy("id").toPandas()["e"].to_numpy()
    assert np.allclose(native, expected)


@pytest.mark.parametrize("growth", ["levelwise", "leafwise", "symmetric"])
def test_growth_strategies_learn(data, growth):
    h = HistoryCallback()
    GradientBoosting(n_trees=4, max_depth=3, growth=growth, learning_rate=0.3).fit(data, FEATURES, "y", callbacks=[h])
    assert h.train_loss[-1] < 0.6 * h.train_loss[0]


def test_split_missing_categorical_and_ties():
    hist = np.zeros((1, 256, 3))
    hist[0, 0] = (-5, 5, 5)
    hist[0, 1] = (5, 5, 5)
    assert best_split(hist, GrowthConfig()).threshold == 0
    hist[0, 255] = (8, 4, 4)
    s = best_split(hist, GrowthConfig())
    assert (s.threshold, s.missing_left) == (0, False)
    cat = np.zeros((1, 256, 3))
    for code, g in enumerate((4.0, -4.0, 4.0, -4.0)):
        cat[0, code] = (g, 4, 4)
    s = best_split(cat, GrowthConfig(), [4])
    assert s.is_categorical and s.cat_mask in (0b0101, 0b1010)
    assert not best_split(hist, GrowthConfig(min_gain=1e9)).valid
    assert not best_split(hist, GrowthConfig(min_child_weight=100)).valid
    assert best_split(np.stack([hist[0], hist[0]]), GrowthConfig()).feature == 0


def test_routing_expression_equals_arrays(spark):
    t = Tree()
    for v, d in ((0, 0), (1, 1), (0, 1), (2, 2), (3, 2)):
        t.add(float(v), 0, d)
    t.split(0, Split(0, -1, 1.0, False, True, (1 << 3) | (1 << 63)), 1, 2)
    t.split(2, Split(1, 9, 1.0, True), 3, 4)
    rows = [(a, b) for a in (0, 3, 63, 64, 100, 255) for b in (0, 9, 10, 255)]
    df = spark.createDataFrame(rows, "a short, b short")
    got = [r[0] for r in df.select(t.expression([F.col("a"), F.col("b")])).collect()]
    assert got == t.predict(np.array(rows, np.uint8).T).tolist()


def test_multiclass_dart_and_files(spark, data, tmp_path):
    m = MultiClassGradientBoosting(n_classes=3, n_trees=4, max_depth=3, learning_rate=0.4).fit(data, FEATURES, "c")
    assert m.predict(data).filter("prediction = c").count() > 320
    m.save(str(tmp_path / "m"))
    again = TreeModel.load(spark, str(tmp_path / "m"))
    a, b = (x.predict_proba(data).orderBy("id").toPandas()["probability"].tolist() for x in (m, again))
    assert np.allclose(a, b)
    d = DART(n_trees=4, max_depth=2, dropout_rate=0.5).fit(data, FEATURES, "y")
    assert len(d.trees_.rates) == 4 and min(d.trees_.rates) < 0.1
    with pytest.raises(FileExistsError):
        m.save(str(tmp_path / "m"))
    with pytest.raises(ValidationError):
        GradientBoosting.load(spark, str(tmp_path / "m"))


def test_weights_equal_repeated_rows(spark, data):
    small = data.filter("id < 60")
    weighted = small.withColumn("w", F.when(F.col("id") == 3, 2.0).otherwise(1.0))
    repeated = small.union(small.filter("id = 3"))
    a = GradientBoosting(n_trees=1, max_depth=2, n_bins=254).fit(weighted, FEATURES, "y", weight="w")
    b = GradientBoosting(n_trees=1, max_depth=2, n_bins=254).fit(repeated, FEATURES, "y")
    assert abs(a.trees_.rounds[0][0].cover[0] - b.trees_.rounds[0][0].cover[0]) < 1e-9


def test_sampling_goss_and_columns(data):
    for extra in ({"subsample_strategy": "goss"}, {"subsample": 0.5, "colsample_bytree": 0.5}):
        a, b = (GradientBoosting(n_trees=2, max_depth=2, random_state=7, **extra).fit(data, FEATURES, "y", id_col="id") for _ in range(2))
        assert [t.rows() for r in a.trees_.rounds for t in r] == [t.rows() for r in b.trees_.rounds for t in r]


def test_custom_loss_and_strategy(data):
    def half(p, y):
        return 0.5 * (p - y), 0.5 + 0 * p

    register_loss("half", half)
    try:
        with pytest.raises(ValueError):
            register_loss("half", half)
        GradientBoosting(n_trees=1, loss="half").fit(data, FEATURES, "y")
    finally:
        unregister_loss("half")

    @register_growth_strategy("stump", override=True)
    class Stump(GrowthStrategy):
        def grow(self, round):
            round.config = GrowthConfig(max_depth=1)
            return LevelWise().grow(round)

    assert GradientBoosting(n_trees=1, growth="stump").fit(data, FEATURES, "y").trees_.rounds[0][0].depth == 1
    with pytest.raises(ValueError):
        get_growth_strategy("none such")


def test_early_stopping_schedule_and_profile(data, tmp_path):
    train, val = data.filter("id % 4 <> 0"), data.filter("id % 4 = 0")
    m = GradientBoosting(n_trees=30, max_depth=4, learning_rate=0.9).fit(train, FEATURES, "y", eval_set=[val], callbacks=[EarlyStopping(2)])
    assert len(m.trees_.rounds) == m.best_iteration_ + 1 < 30
    p = ProfilingCallback(str(tmp_path))
    m = GradientBoosting(n_trees=2, max_depth=1).fit(train, FEATURES, "y", callbacks=[LearningRateScheduler(lambda r: 0.5**r), p])
    assert m.trees_.rates == [0.1, 0.05] and p.report["rounds"] == 2

    class Stop(Callback):
        needs_loss = False

        def on_round_end(self, state):
            return state.round_idx < 1

    assert len(GradientBoosting(n_trees=9, max_depth=1).fit(train, FEATURES, "y", callbacks=[Stop()]).trees_.rounds) == 2


def test_natural_boosting(data):
    m = NaturalBoostNormal(n_trees=15, learning_rate=0.2).fit(data, FEATURES, "y")
    out = m.predict_interval(data, 0.1)
    share = out.filter("y between lower and upper").count() / 400
    assert 0.8 < share <= 1.0 and set(out.columns) == {*data.columns, "lower", "upper"}
    assert m.nll(data) < NaturalBoostNormal(n_trees=1, max_depth=1).fit(data, FEATURES, "y").nll(data)
    exposed = data.withColumn("e", F.lit(2.0))
    p = NaturalBoostPoisson(n_trees=3, max_depth=2).fit(exposed, FEATURES, "n", exposure="e")
    double = p.predict(exposed.withColumn("e", F.lit(4.0)), "q").select("id", "q").join(p.predict(exposed).select("id", "prediction"), "id")
    assert double.filter("abs(q / prediction - 2) > 1e-9").count() == 0


def test_additive_model(spark, data, tmp_path):
    h = HistoryCallback()
    m = AdditiveModel(n_trees=30, learning_rate=0.2, interactions=1, interaction_rounds=3, monotone={"x0": 1}, smoothing=1.0).fit(data, FEATURES, "y", callbacks=[h])
    assert h.train_loss[-1] < 0.3 * h.train_loss[0] and len(m.pairs_) == 1
    size = len(m.binner_.edges["x0"])
    assert (np.diff(m.get_shape_function("x0")[:size]) >= -1e-12).all()
    with pytest.raises(KeyError):
        m.get_pair_shape_function("x0", "x0")
    m.save(str(tmp_path / "g"))
    again = TreeModel.load(spark, str(tmp_path / "g"))
    assert np.allclose(again.shapes_, m.shapes_)
    assert pava(np.array([3.0, 1, 2]), np.ones(3)).tolist() == [2, 2, 2]
    u, w, s = np.array([1.0, 5, 2, 0]), np.array([1.0, 2, 1, 3]), 0.7
    d = np.diff(np.eye(4), axis=0)
    assert np.allclose(smoothed(u, w, s), np.linalg.solve(np.diag(w) + s * d.T @ d, w * u))


def test_linear_leaves(spark, data, tmp_path):
    lin = data.withColumn("y", 3 * F.col("x0") - 2)
    m = LinearLeafGBDT(n_trees=5, max_depth=1, learning_rate=0.9, max_features_linear=None).fit(lin, FEATURES, "y")
    assert m.score(lin) > 0.999
    m.save(str(tmp_path / "l"))
    assert TreeModel.load(spark, str(tmp_path / "l")).score(lin, "y") == pytest.approx(m.score(lin))


def test_estimators_importance_and_tuning(data):
    words = data.withColumn("k", F.when(F.col("b") > 0, "yes").otherwise("no"))
    c = Classifier(n_estimators=4, max_depth=3, learning_rate=0.4).fit(words, FEATURES, "k")
    assert c.classes_ == ["no", "yes"] and c.score(words) > 0.85
    assert sum(c.feature_importances_.values()) == pytest.approx(1)
    assert GAMClassifier(n_estimators=5, learning_rate=0.3).fit(words, FEATURES, "k").score(words) > 0.7
    r = Regressor(n_estimators=3, max_depth=3).fit(data, FEATURES, "y")
    assert r.score(data) > 0.2 and compute_feature_importances(r.model_, "gain")["x0"] > 0.3
    assert importance_table(r.model_, "cover", top_n=2).count() == 2
    assert LinearLeafRegressor(n_estimators=2).fit(data, FEATURES, "y").score(data) > 0.1
    models = fit_batch(data, FEATURES, "y", ConfigBatch.from_grid((1, 2), n_rounds=1))
    assert [m.trees_.rounds[0][0].depth for m in models] == [1, 2]
    alone = [GradientBoosting(n_trees=25, max_depth=2, reg_lambda=x).fit(data, FEATURES, "y") for x in (0.1, 10.0)]
    batch = fit_batch(data, FEATURES, "y", ConfigBatch.from_grid((2,), (0.1, 10.0), n_rounds=25))
    for one, other in zip(alone, batch, strict=True):
        both = one.predict(data).select("id", "prediction").join(other.predict(data).select("id", F.col("prediction").alias("p")), "id")
        assert both.filter("abs(prediction - p) > 1e-9").count() == 0 and both.count() == 400
    out = cross_val_predict_proba(GradientBoosting(n_trees=1, max_depth=1, loss="logloss"), data, FEATURES, "b", "id", cv=2)
    assert out.count() == 400 and out.select("id").distinct().count() == 400
    out = cross_val_predict_interval(NaturalBoostNormal(n_trees=1), data, FEATURES, "y", "id", cv=2)
    assert out.filter("lower < upper").count() == 400


def test_bad_inputs(spark, data):
    with pytest.raises(ValidationError):
        GradientBoosting().fit(data, ["nope"], "y")
    with pytest.raises(ValidationError):
        GradientBoosting().fit(data.filter("id < 0"), FEATURES, "y")
    with pytest.raises(ValidationError):
        GradientBoosting(loss="logloss").fit(data, FEATURES, "y")
    with pytest.raises(ValidationError):
        GradientBoosting(subsample=0).fit(data, FEATURES, "y")
    with pytest.raises(ValidationError):
        GradientBoosting().fit(data.withColumn("x0", F.lit(float("inf"))), FEATURES, "y")
    with pytest.raises(ValidationError):
        GradientBoosting().predict(data)
    with pytest.raises(TypeError):
        GradientBoosting(none_such=1)
    with pytest.raises(ValidationError, match="evaluation table 0"):
        GradientBoosting(n_trees=1).fit(data, FEATURES, "y", eval_set=data.withColumn("y", F.lit(None).cast("double")))
    model = GradientBoosting(n_trees=1, max_depth=1).fit(data, FEATURES, "y")
    with pytest.raises(ValueError, match="another type"):
        model.predict(data.withColumn("x0", F.array("x0")))
    assert validate_predict_input(data, FEATURES) == 400
    with pytest.raises(ValidationError):
        validate_predict_input(data.withColumn("x0", F.lit(float("inf"))), FEATURES)
