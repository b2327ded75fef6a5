"""Registered queries over the driver's tables, one an operator, and the same results as DuckDB SQL."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import losses, metrics
from .functions.distributions import get_distribution
from .operators import relational as R
from .operators import sampling
from .operators.tree import Split, Tree
from .oracles import boosting_sql, digamma_sql, normal_cdf_sql, trigamma_sql
from .plans.boosting import DART, GradientBoosting, MultiClassGradientBoosting
from .plans.distributional import NaturalBoostGamma, NaturalBoostNormal
from .plans.gam import AdditiveModel
from .plans.importance import importance_table
from .plans.linear_leaf import LinearLeafGBDT
from .plans.tuning import ConfigBatch, cross_val_predict, get_param_grid, suggest_params
from .sources.binner import Binner

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# -- binning -------------------------------------------------------------------------------------------------------
FEATURES = ["l_quantity", "l_discount", "l_tax"]
N_BINS = 16
_points = [float(x) for x in np.linspace(0, 1, N_BINS + 1)[1:-1]]


def _edges_sql(column: str, points=tuple(_points)) -> str:
    return f"list_sort(list_distinct(quantile_cont({column}, [{', '.join(map(repr, points))}])))"


def _bin_sql(column: str, edges: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 255 ELSE least(len(list_filter({edges}, lambda q: q <= {column})), len({edges}) - 1) END"


#: Binned lineitem, with gradient g of squared error around 25 and hessian 1.
_BINNED = f"""e AS (SELECT {', '.join(f'{_edges_sql(f)} AS e{i}' for i, f in enumerate(FEATURES))} FROM lineitem),
b AS (SELECT *, {', '.join(f'{_bin_sql(f, f"e{i}")} AS b{i}' for i, f in enumerate(FEATURES))}, 25.0 - l_extendedprice / 1000 AS g, 1.0 AS h FROM lineitem, e)"""
_FLAT = """f AS (SELECT *, 0 AS feature, b0 AS bin FROM b UNION ALL SELECT *, 1, b1 FROM b UNION ALL SELECT *, 2, b2 FROM b)"""


def _binned(spark, sf_dir: str, df: DataFrame | None = None) -> DataFrame:
    df = read(spark, sf_dir, "lineitem") if df is None else df
    keep = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", (25.0 - F.col("l_extendedprice") / 1000).alias("g"), F.lit(1.0).alias("h")]
    return Binner.fit(df, FEATURES, N_BINS).transform(df, keep)


@query(f"WITH {_BINNED} SELECT b0::BIGINT AS b0, b1::BIGINT AS b1, b2::BIGINT AS b2, count(*) AS n FROM b GROUP BY ALL")
def bin_numeric(spark, sf_dir):
    return _binned(spark, sf_dir).groupBy(*(F.col(b).cast("long").alias(b) for b in ("b0", "b1", "b2"))).agg(F.count("*").alias("n"))


_GAPS = "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS v FROM events"


@query(f"WITH v AS ({_GAPS}), e AS (SELECT {_edges_sql('v')} AS q FROM v) SELECT ({_bin_sql('v', 'q')})::BIGINT AS bin, count(*) AS n FROM v, e GROUP BY 1")
def bin_missing(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("v"))
    return Binner.fit(df, ["v"], N_BINS).transform(df).groupBy(F.col("b0").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS code, p_brand, count(*) AS n FROM part GROUP BY p_brand")
def bin_categorical(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    return Binner.fit(df, ["p_brand"]).transform(df, ["p_brand"]).groupBy(F.col("b0").cast("long").alias("code"), "p_brand").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1) AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand < 'Brand#4'))
SELECT coalesce(code, 255)::BIGINT AS code, count(*) AS n FROM part LEFT JOIN k USING (p_brand) GROUP BY 1""")
def bin_transform_unseen(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    fitted = Binner.fit(df.filter("p_brand < 'Brand#4'"), ["p_brand"])
    return fitted.transform(df).groupBy(F.col("b0").cast("long").alias("code")).agg(F.count("*").alias("n"))


# -- histograms ----------------------------------------------------------------------------------------------------
def _hist_out(df: DataFrame, by=(), digits: int = 4) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) for c in (*by, "feature", "bin")), rounded("g", digits).alias("g"), rounded("h", 4).alias("h"), F.col("n").cast("long").alias("n"))


_HIST = "round(sum(g), 4) + 0.0 AS g, round(sum(h), 4)::DOUBLE AS h, count(*)::BIGINT AS n"


@query(f"WITH {_BINNED}, {_FLAT} SELECT feature::BIGINT AS feature, bin::BIGINT AS bin, {_HIST} FROM f GROUP BY 1, 2")
def hist_root(spark, sf_dir):
    return _hist_out(R.build_histogram(_binned(spark, sf_dir), ["b0", "b1", "b2"]))


_NODE = "CASE WHEN l_returnflag = 'A' THEN 3 WHEN l_returnflag = 'N' THEN 4 ELSE 5 END"


def _noded(spark, sf_dir):
    return _binned(spark, sf_dir).withColumn("node", F.expr(_NODE))


@query(f"WITH {_BINNED}, {_FLAT} SELECT ({_NODE})::BIGINT AS node, feature::BIGINT AS feature, bin::BIGINT AS bin, {_HIST} FROM f WHERE {_NODE} IN (3, 5) GROUP BY 1, 2, 3")
def hist_node(spark, sf_dir):
    return _hist_out(R.build_node_histograms(_noded(spark, sf_dir), ["b0", "b1", "b2"], [3, 5]), ["node"])


@query(f"WITH {_BINNED}, {_FLAT} SELECT feature::BIGINT AS feature, bin::BIGINT AS bin, round(sum(CASE WHEN l_linestatus <> 'F' THEN g ELSE 0 END), 2) + 0.0 AS g, round(sum(CASE WHEN l_linestatus <> 'F' THEN h ELSE 0 END), 4)::DOUBLE AS h, count(*) FILTER (l_linestatus <> 'F')::BIGINT AS n FROM f GROUP BY 1, 2")
def hist_subtract(spark, sf_dir):
    rows, bins = _binned(spark, sf_dir), ["b0", "b1", "b2"]
    return _hist_out(R.subtract_histograms(R.build_histogram(rows, bins), R.build_histogram(rows.filter("l_linestatus = 'F'"), bins)), digits=2)


# -- splits --------------------------------------------------------------------------------------------------------
def _score(g: str, h: str) -> str:
    return f"coalesce(({g}) * ({g}) / nullif(({h}) + 1.0, 0), 0)"


def _split_sql(rows: str, by: str = "", weight: float = 1.0, order: str = "bin", more: str = "") -> str:
    """Best split of each group of rows (by, feature, bin, g, h)."""
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {k}feature"
    return f"""hist AS (SELECT {k}feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {rows} GROUP BY ALL),
tot AS (SELECT *, sum(g) OVER ({part}) AS tg, sum(h) OVER ({part}) AS th, sum(CASE WHEN bin = 255 THEN g ELSE 0 END) OVER ({part}) AS mg,
  sum(CASE WHEN bin = 255 THEN h ELSE 0 END) OVER ({part}) AS mh, sum(CASE WHEN bin = 255 THEN n ELSE 0 END) OVER ({part}) AS mn FROM hist),
pre AS (SELECT *, sum(g) OVER ({part} ORDER BY {order}, bin ROWS UNBOUNDED PRECEDING) AS pg, sum(h) OVER ({part} ORDER BY {order}, bin ROWS UNBOUNDED PRECEDING) AS ph{more} FROM tot WHERE bin <> 255),
side AS (SELECT *, true AS missing_left, pg + mg AS gl, ph + mh AS hl FROM pre UNION ALL SELECT *, false, pg, ph FROM pre WHERE mn > 0),
cut AS (SELECT *, {_score('gl', 'hl')} + {_score('tg - gl', 'th - hl')} - {_score('tg', 'th')} AS gain FROM side WHERE hl >= {weight} AND th - hl >= {weight}),
best AS (SELECT * FROM cut WHERE gain > 0 QUALIFY row_number() OVER ({f'PARTITION BY {by}' if by else ''} ORDER BY round(gain, 9) DESC, feature, {order}, bin, missing_left DESC) = 1)"""


def _split_out(best: DataFrame, by=(), mask=False) -> DataFrame:
    cut = [F.col("cat_mask").alias("cat_mask")] if mask else [F.col("threshold").cast("long").alias("threshold")]
    return best.select(*by, F.col("feature").cast("long").alias("feature"), *cut, "missing_left", rounded("gain", 2).alias("gain"), rounded("gl", 3).alias("gl"), rounded("hl", 3).alias("hl"))


_BEST = "feature::BIGINT AS feature, bin::BIGINT AS threshold, missing_left, round(gain, 2) AS gain, round(gl, 3) + 0.0 AS gl, round(hl, 3)::DOUBLE AS hl FROM best"


@query(f"WITH {_BINNED}, {_FLAT}, {_split_sql('f')} SELECT {_BEST}")
def split_numeric(spark, sf_dir):
    return _split_out(R.find_splits(R.build_histogram(_binned(spark, sf_dir), ["b0", "b1", "b2"])))


@query(f"WITH {_BINNED}, {_FLAT}, {_split_sql('f', 'l_returnflag', 200.0)} SELECT l_returnflag, {_BEST}")
def split_min_child_weight(spark, sf_dir):
    hist = R.build_histogram(_binned(spark, sf_dir), ["b0", "b1", "b2"], by=["l_returnflag"])
    return _split_out(R.find_splits(hist, ["l_returnflag"], min_child_weight=200.0), ["l_returnflag"])


_MISSED = "f AS (SELECT g, h, 0 AS feature, CASE WHEN l_extendedprice > 40000 AND l_orderkey % 3 = 0 THEN 255 ELSE b0 END AS bin FROM b)"


@query(f"WITH {_BINNED}, {_MISSED}, {_split_sql('f')} SELECT {_BEST}")
def split_missing(spark, sf_dir):
    rows = _binned(spark, sf_dir).withColumn("b0", F.when((F.col("l_extendedprice") > 40000) & (F.col("l_orderkey") % 3 == 0), 255).otherwise(F.col("b0")))
    return _split_out(R.find_splits(R.build_histogram(rows, ["b0"])))


_BRANDS = """k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS bin FROM (SELECT DISTINCT p_brand FROM part)),
f AS (SELECT p_retailprice / 100 - 12.0 - (bin % 7) AS g, 1.0 AS h, 0 AS feature, bin FROM part JOIN k USING (p_brand))"""


@query(f"WITH {_BRANDS}, {_split_sql('f', '', 1.0, 'CASE WHEN h > 1e-10 THEN -g / (h + 1.0) ELSE 0.0 END', ', list(bin) OVER (PARTITION BY feature ORDER BY CASE WHEN h > 1e-10 THEN -g / (h + 1.0) ELSE 0.0 END, bin ROWS UNBOUNDED PRECEDING) AS codes')} SELECT feature::BIGINT AS feature, list_sum(list_transform(codes, lambda c: (1::BIGINT << c::INT)))::BIGINT AS cat_mask, missing_left, round(gain, 2) AS gain, round(gl, 3) + 0.0 AS gl, round(hl, 3)::DOUBLE AS hl FROM best")
def split_categorical(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    rows = Binner.fit(df, ["p_brand"]).transform(df, ["p_retailprice"])
    rows = rows.select((F.col("p_retailprice") / 100 - 12.0 - F.col("b0") % 7).alias("g"), F.lit(1.0).alias("h"), "b0")
    return _split_out(R.find_splits(R.build_histogram(rows, ["b0"]), categorical=[0]), mask=True)


@query(f"""WITH {_BINNED}, {_FLAT}, n AS (SELECT *, {_NODE} AS node FROM f),
hist AS (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h FROM n GROUP BY ALL),
grid AS (SELECT t.node, t.feature, c.bin, t.tg, t.th, coalesce(h.g, 0) AS g, coalesce(h.h, 0) AS h FROM (SELECT node, feature, sum(g) AS tg, sum(h) AS th FROM hist GROUP BY ALL) t
  JOIN (SELECT DISTINCT feature, bin FROM hist) c USING (feature) LEFT JOIN hist h ON h.node = t.node AND h.feature = t.feature AND h.bin = c.bin),
pre AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl FROM grid WINDOW w AS (PARTITION BY node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
s AS (SELECT feature, bin, sum(CASE WHEN hl >= 1 AND th - hl >= 1 THEN {_score('gl', 'hl')} + {_score('tg - gl', 'th - hl')} - {_score('tg', 'th')} ELSE 0 END) AS gain FROM pre GROUP BY ALL)
SELECT feature::BIGINT AS feature, bin::BIGINT AS threshold, round(gain, 2) AS gain FROM s ORDER BY round(gain, 9) DESC, feature, bin LIMIT 1""")
def split_symmetric_level(spark, sf_dir):
    hist = R.build_histogram(_noded(spark, sf_dir), ["b0", "b1", "b2"], by=["node"])
    return R.level_split(hist).select(F.col("feature").cast("long").alias("feature"), F.col("threshold").cast("long").alias("threshold"), rounded("gain", 2).alias("gain"))


# -- routing and leaves --------------------------------------------------------------------------------------------
_ROUTED = f"""WITH {_BINNED}, r AS (SELECT *, CASE WHEN b0 <= 7 THEN CASE WHEN b1 <= 3 THEN 3 ELSE 4 END ELSE CASE WHEN b2 <= 2 THEN 5 ELSE 6 END END AS node FROM b)"""


def _routed(spark, sf_dir):
    rows = R.route(R.init_nodes(_binned(spark, sf_dir)), {0: {"bin": "b0", "threshold": 7}})
    return R.route(rows, {1: {"bin": "b1", "threshold": 3}, 2: {"bin": "b2", "threshold": 2}})


@query(_ROUTED + " SELECT node::BIGINT AS node, count(*) AS n FROM r GROUP BY 1")
def route_numeric(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy(F.col("node").cast("long").alias("node")).agg(F.count("*").alias("n"))


@query(f"WITH v AS ({_GAPS}), e AS (SELECT {_edges_sql('v')} AS q FROM v), b AS (SELECT {_bin_sql('v', 'q')} AS b0 FROM v, e) SELECT CASE WHEN b0 = 255 THEN 2 WHEN b0 <= 5 THEN 1 ELSE 2 END::BIGINT AS node, count(*) AS n FROM b GROUP BY 1")
def route_missing(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("v"))
    rows = R.route(R.init_nodes(Binner.fit(df, ["v"], N_BINS).transform(df)), {0: {"bin": "b0", "threshold": 5, "missing_left": False}})
    return rows.groupBy(F.col("node").cast("long").alias("node")).agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS c FROM (SELECT DISTINCT p_brand FROM part)) SELECT CASE WHEN c < 64 AND (9437332::BIGINT >> c::INT) & 1 = 1 THEN 1 ELSE 2 END::BIGINT AS node, count(*) AS n FROM part JOIN k USING (p_brand) GROUP BY 1")
def route_bitset(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    rows = R.route(R.init_nodes(Binner.fit(df, ["p_brand"]).transform(df)), {0: {"bin": "b0", "cat_mask": 9437332}})
    return rows.groupBy(F.col("node").cast("long").alias("node")).agg(F.count("*").alias("n"))


def _leaves(alpha):
    def run(spark, sf_dir):
        out = R.compute_leaf_values(_routed(spark, sf_dir), reg_lambda=2.0, reg_alpha=alpha)
        return out.select(F.col("node").cast("long").alias("node"), rounded("value").alias("value"), F.col("n").cast("long").alias("n"))

    return run


for _name, _alpha in (("leaf_values_l2", 0.0), ("leaf_values_l1", 50.0)):
    query(_ROUTED + f" SELECT node::BIGINT AS node, round(-sign(sum(g)) * greatest(abs(sum(g)) - {_alpha}, 0) / (sum(h) + 2.0), 6) + 0.0 AS value, count(*)::BIGINT AS n FROM r GROUP BY 1", _name)(_leaves(_alpha))


def _fixed_tree() -> Tree:
    t = Tree()
    for value, depth in ((0, 0), (0, 1), (0, 1), (1.5, 2), (-2.0, 2), (0.25, 2), (4.0, 2)):
        t.add(value, 0.0, depth)
    t.split(0, Split(0, 7, 1.0), 1, 2)
    t.split(1, Split(1, 3, 1.0), 3, 4)
    t.split(2, Split(2, 2, 1.0), 5, 6)
    return t


@query(_ROUTED + " SELECT l_returnflag, round(sum(CASE node WHEN 3 THEN 1.5 WHEN 4 THEN -2.0 WHEN 5 THEN 0.25 ELSE 4.0 END), 4)::DOUBLE AS total, count(*) AS n FROM r GROUP BY 1")
def tree_predict(spark, sf_dir):
    value = _fixed_tree().expression([F.col(f"b{i}") for i in range(3)])
    return _binned(spark, sf_dir).groupBy("l_returnflag").agg(rounded(F.sum(value), 4).alias("total"), F.count("*").alias("n"))


@query(f"WITH {_BINNED} SELECT ((b0 > 7)::INT * 4 + (b1 > 3)::INT * 2 + (b2 > 2)::INT)::BIGINT AS leaf, count(*) AS n FROM b GROUP BY 1")
def symmetric_predict(spark, sf_dir):
    leaf = R.symmetric_leaf([F.col(f"b{i}") for i in range(3)], [7, 3, 2])
    return _binned(spark, sf_dir).groupBy(leaf.cast("long").alias("leaf")).agg(F.count("*").alias("n"))


# -- losses: raw prediction p and label y from lineitem ------------------------------------------------------------
_P, _Y = "(l_discount * 20 - 1)", "(l_quantity / 25)"
_B = "(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END)"
_S = f"(1 / (1 + exp(-{_P})))"
_C = f"greatest(least({_S}, 1 - 1e-15), 1e-15)"
_D = f"({_P} - {_Y})"
_LOSSES = {
    "mse": (_Y, {}, _D, "1.0", f"{_D} * {_D}"),
    "logloss": (_B, {}, f"{_S} - {_B}", f"greatest(least({_S} * (1 - {_S}), 1 - 1e-6), 1e-6)", f"-({_B} * ln({_C}) + (1 - {_B}) * ln(1 - {_C}))"),
    "huber": (_Y, {"delta": 0.75}, f"greatest(least({_D}, 0.75), -0.75)", f"CASE WHEN abs({_D}) <= 0.75 THEN 1.0 ELSE 1e-6 END", f"CASE WHEN abs({_D}) <= 0.75 THEN 0.5 * {_D} * {_D} ELSE 0.75 * (abs({_D}) - 0.375) END"),
    "mae": (_Y, {}, f"sign({_D})", "1.0", f"abs({_D})"),
    "quantile": (_Y, {"alpha": 0.3}, f"CASE WHEN {_D} > 0 THEN 0.7 ELSE -0.3 END", "1.0", f"CASE WHEN {_Y} >= {_P} THEN 0.3 * -{_D} ELSE 0.7 * {_D} END"),
    "poisson": (_Y, {}, f"exp({_P}) - {_Y}", f"greatest(exp({_P}), 1e-6)", f"exp({_P}) - {_Y} * {_P}"),
    "gamma": (_Y, {}, f"1 - {_Y} * exp(-{_P})", f"greatest({_Y} * exp(-{_P}), 1e-6)", f"{_P} + {_Y} * exp(-{_P})"),
    "tweedie": (_Y, {"rho": 1.3}, f"exp(0.7 * {_P}) - {_Y} * exp(-0.3 * {_P})", f"greatest(0.7 * exp(0.7 * {_P}), 1e-6)", f"exp(0.7 * {_P}) / 0.7 + {_Y} * exp(-0.3 * {_P}) / 0.3"),
}


def _loss_query(name, y, params):
    def run(spark, sf_dir):
        loss, p, t = losses.get_loss(name, **params), F.expr(_P), F.expr(y).cast("double")
        g, h = loss(p, t)
        rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag")
        return rows.agg(rounded(F.avg(g)).alias("g"), rounded(F.avg(h)).alias("h"), rounded(F.avg(loss.monitored(p, t))).alias("value"), F.count("*").alias("n"))

    return run


for _name, (_y, _params, _g, _h, _v) in _LOSSES.items():
    query(f"SELECT l_returnflag, round(avg({_g}), 6) + 0.0 AS g, round(avg({_h}), 6)::DOUBLE AS h, round(avg({_v}), 6) + 0.0 AS value, count(*) AS n FROM lineitem GROUP BY 1", f"loss_{_name}")(_loss_query(_name, _y, _params))

_R = "[l_discount * 20 - 1, l_tax * 20, l_quantity / 25]"


@query(f"WITH r AS (SELECT l_returnflag, {_R} AS raw FROM lineitem), e AS (SELECT l_returnflag, list_transform(raw, lambda v: exp(v - list_max(raw))) AS e FROM r), s AS (SELECT l_returnflag, e, list_sum(e) + 1e-10 AS t FROM e) SELECT l_returnflag, round(avg(e[1] / t), 6) AS p0, round(avg(e[2] / t), 6) AS p1, round(avg(e[3] / t), 6) AS p2, round(avg(greatest(e[1] / t * (1 - e[1] / t), 1e-6)), 6) AS h0 FROM s GROUP BY 1")
def loss_softmax(spark, sf_dir):
    raw = F.array(*(F.expr(x).cast("double") for x in ("l_discount * 20 - 1", "l_tax * 20", "l_quantity / 25")))
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", losses.softmax_columns(raw).alias("p"))
    p0 = F.col("p")[0]
    return rows.groupBy("l_returnflag").agg(*(rounded(F.avg(F.col("p")[i])).alias(f"p{i}") for i in range(3)), rounded(F.avg(F.greatest(p0 * (1 - p0), F.lit(1e-6)))).alias("h0"))


# -- distributions: gradients and natural gradients ----------------------------------------------------------------
_R0, _R1 = "(l_discount * 5)", "(l_tax * 2 - 0.3)"
_E0, _E1 = f"exp({_R0})", f"exp({_R1})"
_Z = f"(({_Y} - {_R0}) / {_E1})"
_LZ = f"((ln({_Y}) - {_R0}) / {_E1})"
_DEV = f"(2 * ({_Y} ** 0.5 / (-0.25) + {_Y} * {_E0} ** (-0.5) / 0.5 + {_E0} ** 0.5 / 0.5))"
#: Gamma: concentration exp(raw 0), rate exp(raw 1); its Fisher matrix is full and solved for the natural gradient.
_G0, _G1 = f"{_E0} * ({digamma_sql(_E0)} - {_R1} - ln({_Y}))", f"{_E1} * {_Y} - {_E0}"
_F11 = f"({_E0} * {_E0} * {trigamma_sql(_E0)})"
_DET = f"({_F11} * {_E0} - {_E0} * {_E0})"
_GAMMA = (_G0, _G1, f"({_E0} * ({_G0}) + {_E0} * ({_G1})) / {_DET}", f"({_F11} * ({_G1}) + {_E0} * ({_G0})) / {_DET}")
#: Student's t: location raw 0, scale exp(raw 1), 2 + softplus(8) degrees of freedom.
_V = "(2 + ln(1 + exp(8.0)))"
_T0, _T1 = f"-({_V} + 1) / ({_V} + {_Z} * {_Z}) * {_Z} / {_E1}", f"1 - ({_V} + 1) / ({_V} + {_Z} * {_Z}) * {_Z} * {_Z}"
_T2 = f"0.5 * ({digamma_sql(f'({_V} / 2)')} - {digamma_sql(f'({_V} / 2 + 0.5)')} + 1 / {_V} + ln(1 + {_Z} * {_Z} / {_V}) - ({_V} + 1) * {_Z} * {_Z} / ({_V} * ({_V} + {_Z} * {_Z}))) / (1 + exp(-8.0))"
_STUDENT = (_T0, _T1, f"({_T0}) * ({_V} + 3) * {_E1} * {_E1} / ({_V} + 1)", f"({_T1}) / 2", _T2, f"({_T2}) / 0.1")
#: Negative binomial of ceil(y): mean exp(raw 0), size exp(raw 1).
_N, _Q = f"ceil({_Y})", f"({_E1} / ({_E1} + {_E0}))"
_B0 = f"({_E0} - {_N}) * {_Q}"
_B1 = f"-{_E1} * ({digamma_sql(f'({_N} + {_E1})')} - {digamma_sql(_E1)} + ln({_Q}) + 1 - {_Q} - {_N} / ({_E1} + {_E0}))"
_NEGBIN = (_B0, _B1, f"({_B0}) / greatest({_E0} * {_Q}, 1e-10)", f"({_B1}) / greatest(least({_E1} * {trigamma_sql(_E1)}, 10.0), 0.1)")
_FAMILIES = {
    "normal": (f"-{_Z} / {_E1}", f"1 - {_Z} * {_Z}", f"-{_Z} * {_E1}", f"(1 - {_Z} * {_Z}) / 2"),
    "lognormal": (f"-{_LZ} / {_E1}", f"1 - {_LZ} * {_LZ}", f"-{_LZ} * {_E1}", f"(1 - {_LZ} * {_LZ}) / 2"),
    "poisson": (f"{_E0} - {_Y}", None, f"({_E0} - {_Y}) / {_E0}", None),
    "tweedie": (f"{_E0} * ({_E0} ** (-0.5) - {_Y} * {_E0} ** (-1.5)) / {_E1}", f"1 - {_DEV} / (2 * {_E1})", f"({_E0} * ({_E0} ** (-0.5) - {_Y} * {_E0} ** (-1.5)) / {_E1}) / ({_E0} ** 0.5 / {_E1})", f"(1 - {_DEV} / (2 * {_E1})) / 0.5"),
    "gamma": _GAMMA, "studentt": _STUDENT, "negativebinomial": _NEGBIN,
}


def _family_query(name):
    def run(spark, sf_dir):
        family = get_distribution(name)
        raw = [F.expr(_R0).cast("double"), F.expr(_R1).cast("double"), F.lit(8.0)][: len(family.names)]
        y = F.ceil(F.expr(_Y)).cast("double") if name == "negativebinomial" else F.expr(_Y)
        p = family.params(raw)
        outs = {f"g{i}": x for i, x in enumerate(family.gradient(y, p))} | {f"n{i}": x for i, x in enumerate(family.natural(y, p))}
        return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(rounded(F.avg(x), 5).alias(k) for k, x in outs.items()))

    return run


for _name, _sql in _FAMILIES.items():
    _outs = ", ".join(f"round(avg({x}), 5) + 0.0 AS {k}" for k, x in zip(("g0", "g1", "n0", "n1", "g2", "n2"), _sql, strict=False) if x) if _sql else None
    query(f"SELECT l_returnflag, {_outs} FROM lineitem GROUP BY 1" if _outs else None, f"dist_{_name}")(_family_query(_name))

# -- metrics -------------------------------------------------------------------------------------------------------
_PRED, _TRUE = "(l_quantity * 1000)", "l_extendedprice"
_W = "(1 + l_linenumber)"
_PROB = "(l_discount * 8 + 0.1)"
_HARD = "(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)"


@query(f"""WITH m AS (SELECT *, sum({_W} * {_TRUE}) OVER () / sum({_W}) OVER () AS wm, avg({_TRUE}) OVER () AS am FROM lineitem)
SELECT round(avg(({_PRED} - {_TRUE}) ** 2), 2) AS mse, round(sqrt(avg(({_PRED} - {_TRUE}) ** 2)), 4) AS rmse, round(avg(abs({_PRED} - {_TRUE})), 4) AS mae,
round(1 - sum(({_PRED} - {_TRUE}) ** 2) / sum(({_TRUE} - am) ** 2), 6) AS r2, round(sum({_W} * ({_PRED} - {_TRUE}) ** 2) / sum({_W}), 2) AS wmse,
round(1 - sum({_W} * ({_PRED} - {_TRUE}) ** 2) / sum({_W} * ({_TRUE} - wm) ** 2), 6) AS wr2 FROM m""")
def metric_regression(spark, sf_dir):
    y, p, w = F.expr(_TRUE), F.expr(_PRED), F.expr(_W).cast("double")
    return read(spark, sf_dir, "lineitem").agg(
        rounded(metrics.mse_score(y, p), 2).alias("mse"), rounded(metrics.rmse_score(y, p), 4).alias("rmse"), rounded(metrics.mae_score(y, p), 4).alias("mae"),
        rounded(metrics.r2_score(y, p)).alias("r2"), rounded(metrics.mse_score(y, p, w), 2).alias("wmse"), rounded(metrics.r2_score(y, p, w)).alias("wr2"),
    )


_CP = f"greatest(least({_PROB}, 1 - 1e-15), 1e-15)"


@query(f"SELECT round(avg(({_HARD} = {_B})::INT), 6) AS accuracy, round(sum({_W} * ({_HARD} = {_B})::INT) / sum({_W}), 6) AS waccuracy, round(avg(-({_B} * ln({_CP}) + (1 - {_B}) * ln(1 - {_CP}))), 6) AS logloss, round(avg(({_PROB} - {_B}) ** 2), 6) AS brier FROM lineitem")
def metric_classification(spark, sf_dir):
    y, p, hard = F.expr(_B).cast("double"), F.expr(_PROB).cast("double"), F.expr(_HARD).cast("double")
    return read(spark, sf_dir, "lineitem").agg(
        rounded(metrics.accuracy_score(y, hard)).alias("accuracy"), rounded(metrics.accuracy_score(y, hard, F.expr(_W))).alias("waccuracy"),
        rounded(metrics.log_loss_score(y, p)).alias("logloss"), rounded(metrics.brier_score(y, p)).alias("brier"),
    )


@query(f"WITH s AS (SELECT {_PROB} AS p, {_B} AS y FROM lineitem), r AS (SELECT y, avg(rn) OVER (PARTITION BY p) AS rank FROM (SELECT *, row_number() OVER (ORDER BY p) AS rn FROM s)) SELECT round((sum(CASE WHEN y = 1 THEN rank ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def metric_auc(spark, sf_dir):
    out = metrics.roc_auc(read(spark, sf_dir, "lineitem"), F.expr(_B), F.expr(_PROB))
    return out.select(rounded("auc").alias("auc"))


@query(f"""WITH c AS (SELECT {_B}::INT AS y, {_HARD} AS p FROM lineitem), k AS (SELECT class, count(*) FILTER (y = class AND p = class) AS tp, count(*) FILTER (y <> class AND p = class) AS fp, count(*) FILTER (y = class AND p <> class) AS fn FROM c, (VALUES (0), (1)) v(class) GROUP BY 1),
s AS (SELECT *, tp / (tp + fp) AS pr, tp / (tp + fn) AS re, 2 * tp / (2 * tp + fp + fn) AS f1 FROM k)
SELECT round(max(pr) FILTER (class = 1), 6) AS precision, round(max(re) FILTER (class = 1), 6) AS recall, round(max(f1) FILTER (class = 1), 6) AS f1, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM s""")
def metric_f1(spark, sf_dir):
    df, y, p = read(spark, sf_dir, "lineitem").cache(), F.expr(_B).cast("int"), F.expr(_HARD)
    row = {}
    for name, f in (("precision", metrics.precision_score), ("recall", metrics.recall_score), ("f1", metrics.f1_score)):
        row[name], row[f"macro_{name}"] = f(df, y, p), f(df, y, p, "macro")
    row["micro_f1"] = metrics.f1_score(df, y, p, "micro")
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row)).select(*(rounded(k).alias(k) for k in row))


@query(f"SELECT round(avg(CASE WHEN {_TRUE} >= {_PRED} THEN 0.9 * ({_TRUE} - {_PRED}) ELSE -0.1 * ({_TRUE} - {_PRED}) END), 4) AS pinball, round(avg(30000 + 20 * (greatest(0, {_PRED} - 10000 - {_TRUE}) + greatest(0, {_TRUE} - {_PRED} - 20000))), 4) AS interval, round(avg(({_TRUE} BETWEEN {_PRED} - 10000 AND {_PRED} + 20000)::INT), 6) AS coverage, round(avg(0.5 * ln(2 * pi()) + ln(5000.0) + 0.5 * (({_TRUE} - {_PRED}) / 5000) ** 2), 6) AS nll FROM lineitem")
def metric_probabilistic(spark, sf_dir):
    y, p = F.expr(_TRUE), F.expr(_PRED)
    return read(spark, sf_dir, "lineitem").agg(
        rounded(metrics.pinball_loss(y, p, 0.9), 4).alias("pinball"), rounded(metrics.interval_score(y, p - 10000, p + 20000, 0.1), 4).alias("interval"),
        rounded(metrics.evaluate_coverage(y, p - 10000, p + 20000)[0]).alias("coverage"), rounded(metrics.negative_log_likelihood(y, p, F.lit(5000.0))).alias("nll"),
    )


_BINS10 = f"greatest(0, least(9, ceil({_PROB} * 10) - 1))"


@query(f"SELECT ({_BINS10})::BIGINT AS bin, round(avg({_B}), 6)::DOUBLE AS fraction, round(avg({_PROB}), 6) AS mean_predicted, count(*) AS count FROM lineitem GROUP BY 1")
def calibration_curve(spark, sf_dir):
    out = metrics.calibration_curve(read(spark, sf_dir, "lineitem"), F.expr(_B).cast("double"), F.expr(_PROB).cast("double"))
    return out.select(F.col("bin").cast("long").alias("bin"), rounded("fraction").alias("fraction"), rounded("mean_predicted").alias("mean_predicted"), "count")


@query(f"WITH c AS (SELECT {_BINS10} AS bin, avg({_B}) AS f, avg({_PROB}) AS m, count(*) AS n FROM lineitem GROUP BY 1) SELECT round(sum(abs(f - m) * n) / sum(n), 6) AS ece FROM c")
def metric_ece(spark, sf_dir):
    return metrics.expected_calibration_error(read(spark, sf_dir, "lineitem"), F.expr(_B).cast("double"), F.expr(_PROB).cast("double")).select(rounded("ece").alias("ece"))


@query("""WITH s AS (SELECT vec_id, list_sort(embedding::DOUBLE[]) AS x, label / 10 AS y FROM embeddings), t AS (SELECT *, len(x) AS n FROM s)
SELECT round(avg(list_sum(list_transform(x, lambda v: abs(v - y))) / n - list_sum(list_transform(x, lambda v, i: v * (2 * i - n - 1))) / (n * n)), 5) AS crps FROM t""")
def metric_crps_empirical(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    return df.agg(rounded(metrics.crps_empirical(F.col("label") / 10, F.col("embedding").cast("array<double>")), 5).alias("crps"))


@query("SELECT least(19, floor((l_quantity - 0.5) / 50 * 20))::BIGINT AS bin, count(*) AS count FROM lineitem GROUP BY 1 UNION ALL SELECT i, 0 FROM range(20) r(i) WHERE i NOT IN (SELECT least(19, floor((l_quantity - 0.5) / 50 * 20)) FROM lineitem)")
def metric_pit_histogram(spark, sf_dir):
    out = metrics.pit_histogram(read(spark, sf_dir, "lineitem"), (F.col("l_quantity") - 0.5) / 50)
    return out.select(F.col("bin").cast("long").alias("bin"), "count")


@query("SELECT round((i + 0.5) / 10, 6)::DOUBLE AS nominal, round(avg(((l_quantity - 0.5) / 50 <= (i + 0.5) / 10)::INT), 6) AS observed FROM lineitem, range(10) r(i) GROUP BY i")
def metric_reliability(spark, sf_dir):
    out = metrics.reliability_diagram(read(spark, sf_dir, "lineitem"), (F.col("l_quantity") - 0.5) / 50)
    return out.select(rounded("nominal").alias("nominal"), rounded("observed").alias("observed"))


@query(f"WITH z AS (SELECT ({_TRUE} - {_PRED}) / 5000 AS z, count(*) AS n FROM lineitem GROUP BY 1) SELECT round(sum(n * 5000 * (z * (2 * {normal_cdf_sql('z')} - 1) + 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1 / sqrt(pi()))) / sum(n), 2) AS crps FROM z")
def metric_crps_gaussian(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(rounded(metrics.crps_gaussian(F.expr(_TRUE), F.expr(_PRED), F.lit(5000.0)), 2).alias("crps"))


# -- models --------------------------------------------------------------------------------------------------------
MODEL_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _training(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)


@query(f"""WITH {_BINNED.replace('25.0 - l_extendedprice / 1000', '(SELECT avg(l_extendedprice / 1000) FROM lineitem) - l_extendedprice / 1000')}, {_FLAT}, {_split_sql('f')},
t AS (SELECT feature AS sf, bin AS sb, -gl / (hl + 1.0) AS lv, -(tg - gl) / (th - hl + 1.0) AS rv FROM best)
SELECT l_returnflag, round(avg((SELECT avg(l_extendedprice / 1000) FROM lineitem) + 0.5 * CASE WHEN CASE sf WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END <= sb THEN lv ELSE rv END), 6) AS prediction, count(*) AS n FROM b, t GROUP BY 1""")
def gbdt_stump(spark, sf_dir):
    df = _training(spark, sf_dir)
    model = GradientBoosting(n_trees=1, max_depth=1, learning_rate=0.5, n_bins=N_BINS).fit(df, FEATURES, "y")
    return model.predict(df).groupBy("l_returnflag").agg(rounded(F.avg("prediction")).alias("prediction"), F.count("*").alias("n"))


def _predicted(out: DataFrame, *columns: str) -> DataFrame:
    return out.groupBy("l_linenumber").agg(*(rounded(F.avg(c), 4).alias(c) for c in columns), F.count("*").alias("n"))


_LINES = "SELECT *, l_extendedprice / 1000 AS y FROM lineitem"
_MEAN = "(SELECT avg(y) FROM src)"
_SQUARED = [("p0 - y", "1.0")]


def _model_sql(*columns: str) -> str:
    return f" SELECT l_linenumber, {', '.join(columns)}, count(*) AS n FROM model GROUP BY 1"


@query(boosting_sql(_LINES, MODEL_FEATURES, [_MEAN], _SQUARED, 10, 4) + _model_sql("round(avg(p0), 4) AS prediction"))
def gbdt_regression(spark, sf_dir):
    df = _training(spark, sf_dir)
    return _predicted(GradientBoosting(n_trees=10, max_depth=4).fit(df, MODEL_FEATURES, "y").predict(df), "prediction")


@query()
def gbdt_leafwise_goss(spark, sf_dir):
    df = _training(spark, sf_dir)
    model = GradientBoosting(n_trees=4, max_depth=4, growth="leafwise", max_leaves=8, subsample_strategy="goss").fit(df, MODEL_FEATURES, "y")
    return _predicted(model.predict(df), "prediction")


@query(boosting_sql(_LINES, MODEL_FEATURES, [_MEAN], _SQUARED, 5, 4, symmetric=True) + _model_sql("round(avg(p0), 4) AS prediction"))
def gbdt_symmetric(spark, sf_dir):
    df = _training(spark, sf_dir)
    return _predicted(GradientBoosting(n_trees=5, max_depth=4, growth="symmetric").fit(df, MODEL_FEATURES, "y").predict(df), "prediction")


_LOGIT = "(SELECT ln(avg(y) / (1 - avg(y))) FROM src)"
_LOGISTIC = [("1 / (1 + exp(-p0)) - y", "greatest(1 / (1 + exp(-p0)) * (1 - 1 / (1 + exp(-p0))), 1e-6)")]


@query(boosting_sql(f"SELECT *, {_B}::DOUBLE AS y FROM lineitem", [*MODEL_FEATURES, "l_returnflag"], [_LOGIT], _LOGISTIC, 5, 3, texts=("l_returnflag",)) + _model_sql("round(avg(1 / (1 + exp(-p0))), 4) AS probability"))
def gbdt_logloss(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("y", F.expr(_B).cast("double"))
    return _predicted(GradientBoosting(n_trees=5, max_depth=3, loss="logloss").fit(df, [*MODEL_FEATURES, "l_returnflag"], "y").predict_proba(df), "probability")


_SHARES = [f"(exp(p{k}) / (exp(p0) + exp(p1) + exp(p2)))" for k in range(3)]
_SOFTMAX = [(f"{p} - (y = {k})::INT", f"greatest({p} * (1 - {p}), 1e-6)") for k, p in enumerate(_SHARES)]


@query(boosting_sql(f"SELECT *, {_NODE} - 3 AS y FROM lineitem", [*MODEL_FEATURES, "l_linestatus"], ["0", "0", "0"], _SOFTMAX, 3, 3, texts=("l_linestatus",)) + _model_sql("round(avg(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END), 4) AS prediction"))
def gbdt_multiclass(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("y", F.expr(_NODE) - 3)
    return _predicted(MultiClassGradientBoosting(n_classes=3, n_trees=3, max_depth=3).fit(df, [*MODEL_FEATURES, "l_linestatus"], "y").predict(df), "prediction")


@query()
def dart_regression(spark, sf_dir):
    df = _training(spark, sf_dir)
    return _predicted(DART(n_trees=5, max_depth=3, dropout_rate=0.3).fit(df, MODEL_FEATURES, "y").predict(df), "prediction")


_NORMAL = [("greatest(least(p0 - y, 100), -100)", "1.0"), ("greatest(least((1 - ((y - p0) / exp(p1)) ** 2) / 2, 100), -100)", "1.0")]
_INTERVAL = [f"round(avg(p0 {s} 1.6448536269514722 * exp(p1)), 4) AS {n}" for s, n in (("-", "lower"), ("+", "upper"))]


@query(boosting_sql(_LINES, MODEL_FEATURES, [_MEAN, "(SELECT ln(stddev_pop(y) + 1e-6) FROM src)"], _NORMAL, 4, 3) + _model_sql(*_INTERVAL))
def naturalboost_normal(spark, sf_dir):
    df = _training(spark, sf_dir)
    return _predicted(NaturalBoostNormal(n_trees=4, max_depth=3).fit(df, MODEL_FEATURES, "y").predict_interval(df), "lower", "upper")


@query()
def naturalboost_gamma(spark, sf_dir):
    df = _training(spark, sf_dir)
    return _predicted(NaturalBoostGamma(n_trees=3, max_depth=3).fit(df, MODEL_FEATURES, "y").predict(df), "prediction")


@query()
def gam_regression(spark, sf_dir):
    df = _training(spark, sf_dir)
    return _predicted(AdditiveModel(n_trees=20, learning_rate=0.1, interactions=1, interaction_rounds=3).fit(df, MODEL_FEATURES, "y").predict(df), "prediction")


@query()
def linear_leaf_regression(spark, sf_dir):
    df = _training(spark, sf_dir)
    return _predicted(LinearLeafGBDT(n_trees=4, max_depth=2).fit(df, MODEL_FEATURES, "y").predict(df), "prediction")


@query(boosting_sql(_LINES, MODEL_FEATURES, [_MEAN], _SQUARED, 3, 3) + f" SELECT name AS feature, (SELECT count(*) FROM splits s WHERE s.feature = f.i)::DOUBLE / (SELECT count(*) FROM splits) AS importance FROM (VALUES {', '.join(str((i, n)) for i, n in enumerate(MODEL_FEATURES))}) f(i, name)")
def importance_frequency(spark, sf_dir):
    df = _training(spark, sf_dir)
    return importance_table(GradientBoosting(n_trees=3, max_depth=3).fit(df, MODEL_FEATURES, "y"), "frequency")


@query()
def cross_validation(spark, sf_dir):
    df = read(spark, sf_dir, "orders").withColumn("y", F.col("o_totalprice") / 1000)
    out = cross_val_predict(GradientBoosting(n_trees=2, max_depth=2), df, ["o_orderpriority", "o_custkey"], "y", "o_orderkey", cv=3)
    return out.groupBy("fold").agg(F.count("*").alias("n"), rounded(F.avg("prediction"), 4).alias("prediction"))


@query("SELECT (row_number() OVER (ORDER BY d, l, w, r) - 1)::BIGINT AS config_id, d::BIGINT AS max_depth, l::DOUBLE AS reg_lambda, w::DOUBLE AS min_child_weight, r::DOUBLE AS learning_rate FROM (VALUES (4), (6)) a(d), (VALUES (0.1), (1.0), (10.0)) b(l), (VALUES (1.0)) c(w), (VALUES (0.05), (0.1)) e(r)")
def config_grid(spark, sf_dir):
    grid = ConfigBatch.from_grid((4, 6), (0.1, 1.0, 10.0), (1.0,), (0.05, 0.1)).table(spark)
    return grid.select(F.col("config_id").cast("long").alias("config_id"), F.col("max_depth").cast("long").alias("max_depth"), "reg_lambda", "min_child_weight", "learning_rate")


_SUGGESTED = """SELECT '{task}' AS task, greatest(least(trees + extra, 500), 0)::BIGINT AS n_estimators, (CASE WHEN trees >= 300 OR extra > 0 THEN 0.05 ELSE 0.1 END)::DOUBLE AS learning_rate,
{depth}::BIGINT AS max_depth, (CASE WHEN n < 1000 THEN 10.0 WHEN n < 10000 THEN 1.0 ELSE 0.1 END)::DOUBLE AS reg_lambda, (CASE WHEN n < 1000 THEN 3.0 ELSE 1.0 END)::DOUBLE AS min_child_weight,
(CASE WHEN n > 10000 THEN 0.8 END)::DOUBLE AS subsample FROM (SELECT n, CASE WHEN n < 1000 THEN 100 WHEN n < 10000 THEN 200 WHEN n < 100000 THEN 300 ELSE 500 END AS trees,
CASE WHEN {imbalance} > 5 THEN 100 ELSE 0 END AS extra FROM (SELECT count(*) AS n FROM {table}))"""


@query(" UNION ALL ".join([
    _SUGGESTED.format(task="regression", depth="least(8, 4 + 4 // 20)", imbalance="1", table="lineitem"),
    _SUGGESTED.format(task="classification", depth="least(8, 4 + 1 // 20)", imbalance="(SELECT max(c) / min(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus))", table="orders"),
    _SUGGESTED.format(task="distributional", depth="least(5, 3 + 1 // 50)", imbalance="1", table="events"),
]))
def suggested_params(spark, sf_dir):
    rows = []
    for task, name, features, label in (("regression", "lineitem", MODEL_FEATURES, "l_extendedprice"), ("classification", "orders", ["o_totalprice"], "o_orderstatus"), ("distributional", "events", ["value"], "value")):
        s = suggest_params(read(spark, sf_dir, name), features, label, task)
        rows.append((task, s["n_estimators"], s["learning_rate"], s["max_depth"], s["reg_lambda"], s["min_child_weight"], s.get("subsample")))
    return spark.createDataFrame(rows, "task string, n_estimators long, learning_rate double, max_depth long, reg_lambda double, min_child_weight double, subsample double")


@query("""SELECT task, name, unnest(vals)::DOUBLE AS value FROM (VALUES
('regression', 'n_estimators', [100, 300, 500]), ('regression', 'max_depth', [4, 6, 8]), ('regression', 'learning_rate', [0.01, 0.05, 0.1]),
('regression', 'subsample', [0.7, 0.8, 1.0]), ('regression', 'colsample_bytree', [0.7, 0.8, 1.0]), ('regression', 'reg_lambda', [0.1, 1.0, 10.0]),
('classification', 'n_estimators', [100, 300, 500]), ('classification', 'max_depth', [3, 5, 7]), ('classification', 'learning_rate', [0.01, 0.05, 0.1]),
('classification', 'subsample', [0.7, 0.8, 1.0]), ('classification', 'colsample_bytree', [0.7, 0.8, 1.0]), ('classification', 'reg_lambda', [0.1, 1.0, 10.0]),
('distributional', 'n_estimators', [100, 200, 500]), ('distributional', 'max_depth', [3, 4, 5]), ('distributional', 'learning_rate', [0.05, 0.1, 0.2]),
('distributional', 'reg_lambda', [0.1, 1.0, 5.0])) g(task, name, vals)""")
def param_grids(spark, sf_dir):
    rows = [(task, name, float(v)) for task in ("regression", "classification", "distributional") for name, values in get_param_grid(task).items() for v in values]
    return spark.createDataFrame(rows, "task string, name string, value double")


# -- sampling ------------------------------------------------------------------------------------------------------
@query("WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY abs(value) DESC, event_id) AS rn, count(*) OVER () AS n FROM events) SELECT event_id FROM r WHERE rn <= floor(n * 0.2)")
def goss_top_part(spark, sf_dir):
    out = sampling.goss_sample(read(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id", sampling.GOSSConfig(0.2, 0.1, 5))
    return out.filter("goss_weight = 1.0").select("event_id")


@query("SELECT greatest(1, floor(count(*) * 0.25))::BIGINT AS n, greatest(1, floor(count(*) * 0.25))::BIGINT AS ids FROM events")
def random_sample_size(spark, sf_dir):
    return sampling.random_sample(read(spark, sf_dir, "events"), "event_id", 0.25, 3).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("SELECT c_mktsegment, f::BIGINT AS fold, count(*) // 5 + (count(*) % 5 > any_value(f))::BIGINT AS n FROM customer, range(5) r(f) GROUP BY 1, 2")
def stratified_fold_balance(spark, sf_dir):
    folds = sampling.stratified_folds(read(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 5)
    return folds.groupBy("c_mktsegment", F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))
