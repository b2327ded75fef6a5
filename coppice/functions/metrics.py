"""Metrics as aggregate expressions (for df.agg) where one aggregate will do, and as functions of a DataFrame else.

y, p and w are Columns; w None means weight 1. Ranks and bins are found by grouping on the score or by quantiles, so
that no metric gathers its rows in one task.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ops import clip, normal_cdf
from .quantiles import quantile


def _mean(e: Column, w: Column | None) -> Column:
    return F.avg(e) if w is None else F.try_divide(F.sum(w * e), F.sum(w))


def accuracy_score(y: Column, p: Column, w: Column | None = None) -> Column:
    return _mean((y == p).cast("double"), w)


def mse_score(y: Column, p: Column, w: Column | None = None) -> Column:
    return _mean((y - p) * (y - p), w)


def rmse_score(y: Column, p: Column, w: Column | None = None) -> Column:
    return F.sqrt(mse_score(y, p, w))


def mae_score(y: Column, p: Column, w: Column | None = None) -> Column:
    return _mean(F.abs(y - p), w)


def r2_score(y: Column, p: Column, w: Column | None = None) -> Column:
    """1 - SSE / SST; 0 if the label is constant."""
    one = F.lit(1.0) if w is None else w
    sse = F.sum(one * (y - p) * (y - p))
    mean = F.sum(one * y) / F.sum(one)
    sst = F.var_pop(y) * F.count(y) if w is None else F.sum(w * y * y) - mean * F.sum(w * y)
    return F.when(sst > 0, 1.0 - F.try_divide(sse, sst)).otherwise(0.0)


def log_loss_score(y: Column, p: Column, w: Column | None = None) -> Column:
    q = clip(p, 1e-15, 1 - 1e-15)
    return _mean(-(y * F.ln(q) + (1.0 - y) * F.ln(1.0 - q)), w)


brier_score = mse_score


def pinball_loss(y: Column, p: Column, quantile: float = 0.5, w: Column | None = None) -> Column:
    return _mean(F.when(y >= p, quantile * (y - p)).otherwise((quantile - 1) * (y - p)), w)


def interval_score(y: Column, lower: Column, upper: Column, alpha: float = 0.1, w: Column | None = None) -> Column:
    zero = F.lit(0.0)
    return _mean((upper - lower) + 2 / alpha * (F.greatest(zero, lower - y) + F.greatest(zero, y - upper)), w)


def negative_log_likelihood(y: Column, mean: Column, std: Column, w: Column | None = None) -> Column:
    s = F.greatest(std, F.lit(1e-10))
    return _mean(0.5 * math.log(2 * math.pi) + F.ln(s) + 0.5 * F.pow((y - mean) / s, F.lit(2)), w)


def crps_gaussian(y: Column, mean: Column, std: Column, w: Column | None = None) -> Column:
    s = F.greatest(std, F.lit(1e-10))
    z = (y - mean) / s
    density = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    return _mean(s * (z * (2.0 * normal_cdf(z) - 1.0) + 2.0 * density - 1 / math.sqrt(math.pi)), w)


def crps_empirical(y: Column, samples: Column, w: Column | None = None) -> Column:
    """E|X - y| - E|X - X'| / 2 of an array column of samples, by sorting it."""
    n = F.size(samples)
    ordered = F.array_sort(samples)
    near = F.aggregate(F.transform(samples, lambda x: F.abs(x - y)), F.lit(0.0), lambda a, v: a + v) / n
    spread = F.aggregate(F.transform(ordered, lambda x, i: x * (2 * (i + 1) - n - 1)), F.lit(0.0), lambda a, v: a + v) / (n * n)
    return _mean(near - spread, w)


def evaluate_coverage(y: Column, lower: Column, upper: Column, rows: int = 0) -> list[Column]:
    """coverage, mean_width, median_width (of tables of more than EXACT_ROWS `rows` by a sketch)."""
    width = upper - lower
    return [F.avg(((y >= lower) & (y <= upper)).cast("double")).alias("coverage"), F.avg(width).alias("mean_width"), quantile(width, 0.5, rows).alias("median_width")]


def confusion(df: DataFrame, y: Column, p: Column, w: Column | None = None) -> DataFrame:
    """(class, tp, fp, fn, support): one pass over (label, prediction) cells, then over the classes."""
    one = F.lit(1.0) if w is None else w
    cells = df.groupBy(y.cast("string").alias("y"), p.cast("string").alias("p")).agg(F.sum(one).alias("n"))
    sides = F.explode(F.array(F.struct(F.col("y").alias("class"), F.lit(True).alias("own")), F.struct(F.col("p").alias("class"), F.lit(False).alias("own"))))
    rows = cells.withColumn("s", sides).select("n", "y", "p", "s.*").filter("own or y <> p")
    hit = F.col("y") == F.col("p")
    return rows.groupBy("class").agg(
        F.sum(F.when(F.col("own") & hit, F.col("n")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(~F.col("own"), F.col("n")).otherwise(0.0)).alias("fp"),
        F.sum(F.when(F.col("own") & ~hit, F.col("n")).otherwise(0.0)).alias("fn"),
        F.sum(F.when(F.col("own"), F.col("n")).otherwise(0.0)).alias("support"),
    )


def _averaged(df, y, p, average, w, score) -> float:
    cells = confusion(df, y, p, w)
    if average == "binary":
        cells = cells.filter("try_cast(class as double) = 1")
    if average in ("binary", "micro"):
        row = cells.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in ("tp", "fp", "fn"))).first()
        return float(score(*row))
    rows = cells.collect()  # one a class
    weights = [r["support"] if average == "weighted" else 1.0 for r in rows]
    total = sum(weights)
    return sum(a * score(r["tp"], r["fp"], r["fn"]) for a, r in zip(weights, rows, strict=True)) / total if total else 0.0


def precision_score(df: DataFrame, y: Column, p: Column, average: str = "binary", w: Column | None = None) -> float:
    return _averaged(df, y, p, average, w, lambda tp, fp, fn: tp / (tp + fp) if tp + fp else 0.0)


def recall_score(df: DataFrame, y: Column, p: Column, average: str = "binary", w: Column | None = None) -> float:
    return _averaged(df, y, p, average, w, lambda tp, fp, fn: tp / (tp + fn) if tp + fn else 0.0)


def f1_score(df: DataFrame, y: Column, p: Column, average: str = "binary", w: Column | None = None) -> float:
    return _averaged(df, y, p, average, w, lambda tp, fp, fn: 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0)


def roc_auc(df: DataFrame, y: Column, p: Column, w: Column | None = None) -> DataFrame:
    """One row, auc: pairs of a positive and a negative in the right order, ties half. Scores are grouped first, and
    their running sums are taken in two steps over ranges of scores, so that no task sees all of them."""
    one = F.lit(1.0) if w is None else w
    by = df.select(p.cast("double").alias("s"), y.cast("double").alias("y"), one.alias("w")).groupBy("s")
    by = by.agg(F.sum(F.when(F.col("y") > 0, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") > 0, 0.0).otherwise(F.col("w"))).alias("neg"))
    # Ranges hold about as many scores each, whatever their scale; there are as many as partitions.
    by = by.repartitionByRange("s").withColumn("range", F.spark_partition_id())
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    parts = by.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0.0)))
    ranges = parts.groupBy("range").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("own"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range of scores
    total = ranges.withColumn("before", F.coalesce(F.sum("neg").over(over), F.lit(0.0)))
    return total.agg(F.try_divide(F.sum(F.col("own") + F.col("pos") * F.col("before")), F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_auc_score(df: DataFrame, y: Column, p: Column, w: Column | None = None) -> float:
    return roc_auc(df, y, p, w).first()[0]


def probability_bin(p: Column, n_bins: int, edges: list[float] | None = None) -> Column:
    """Right-closed bins 0 .. n_bins - 1 of probabilities; the first is closed on the left too."""
    if edges is None:
        return F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), F.ceil(p * n_bins) - 1)).cast("int")
    inner = F.array(*map(F.lit, edges[1:-1])) if len(edges) > 2 else F.array().cast("array<double>")
    return F.size(F.filter(inner, lambda e: e < p))


def calibration_curve(df: DataFrame, y: Column, p: Column, n_bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """(bin, fraction, mean_predicted, count) of the bins that hold rows. quantile: edges at equal shares of rows."""
    edges = None
    if strategy == "quantile":
        at = [i / n_bins for i in range(n_bins + 1)]
        edges = df.agg(quantile(p, at, df.count())).first()[0]
    elif strategy != "uniform":
        raise ValueError(f"unknown strategy {strategy!r}")
    rows = df.select(y.cast("double").alias("y"), p.alias("p"), probability_bin(p, n_bins, edges).alias("bin"))
    return rows.groupBy("bin").agg(F.avg("y").alias("fraction"), F.avg("p").alias("mean_predicted"), F.count("*").alias("count"))


def expected_calibration_error(df: DataFrame, y: Column, p: Column, n_bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """One row, ece: the mean over rows of |fraction - mean prediction| of their bin."""
    bins = calibration_curve(df, y, p, n_bins, strategy)
    return bins.agg((F.sum(F.abs(F.col("fraction") - F.col("mean_predicted")) * F.col("count")) / F.sum("count")).alias("ece"))


def pit_values(output, label: str, seed: int = 0, name: str = "pit") -> DataFrame:
    """Probability integral transform of each row of a DistributionOutput: its distribution function at the label; for
    counts (and the zero mass of Tweedie) drawn evenly between the values below and at it, by seeded hash."""
    kind = output.family.task
    if kind not in ("count", "nonnegative"):
        return output.cdf(label, name)
    low = output.df.withColumn("_below", F.col(label) - 1 if kind == "count" else F.when(F.col(label) > 0, F.col(label)).otherwise(-1.0))
    both = type(output)(type(output)(low, output.family, output.columns).cdf("_below", "_a"), output.family, output.columns).cdf(label, "_b")
    u = F.pmod(F.xxhash64(F.col(label), *output.columns.values(), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return both.withColumn(name, F.col("_a") + u * (F.col("_b") - F.col("_a"))).drop("_below", "_a", "_b")


def pit_histogram(df: DataFrame, pit: Column, n_bins: int = 20) -> DataFrame:
    """(bin, count) of all bins of 0..1."""
    own = df.select(F.least(F.lit(n_bins - 1), F.floor(pit * n_bins)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))
    every = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(own, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def ks_statistic(df: DataFrame, pit: Column) -> tuple[float, float]:
    """Kolmogorov-Smirnov distance of PIT values from the uniform distribution, exactly, and its p-value. Values are
    grouped, and counted in ranges first, so that no task sees all of them."""
    by = df.select(pit.cast("double").alias("u")).filter("u is not null").groupBy("u").agg(F.count("*").alias("n"))
    by = by.withColumn("range", F.floor(F.col("u") * 4096))
    within = F.sum("n").over(Window.partitionBy("range").orderBy("u").rowsBetween(Window.unboundedPreceding, 0))
    steps = by.withColumn("upto", within)
    totals = by.groupBy("range").agg(F.sum("n").alias("all"))
    before = totals.withColumn("before", F.sum("all").over(Window.orderBy("range")) - F.col("all")).drop("all")  # 4097 rows
    n = int(by.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    if not n:
        return 0.0, 1.0
    end = F.col("before") + F.col("upto")
    far = F.greatest(end / n - F.col("u"), F.col("u") - (end - F.col("n")) / n)
    worst = float(steps.join(F.broadcast(before), "range").agg(F.max(far)).first()[0])
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * worst
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)) if x > 0.2 else 1.0
    return worst, min(1.0, max(0.0, p))


def pit_uniformity(df: DataFrame, pit: Column, n_bins: int = 20) -> tuple[list[float], list[int], float, float]:
    """(edges, counts, statistic, p): pit_histogram() and ks_statistic() at once."""
    counts = [r["count"] for r in sorted(pit_histogram(df, pit, n_bins).collect(), key=lambda r: r["bin"])]
    return [i / n_bins for i in range(n_bins + 1)], counts, *ks_statistic(df, pit)


def reliability_diagram(df: DataFrame, pit: Column, n_bins: int = 10) -> DataFrame:
    """(nominal, observed): the share of PIT values at or below each level, the middles of n_bins equal parts of 0..1."""
    levels = [(i + 0.5) / n_bins for i in range(n_bins)]
    row = df.agg(F.array(*(F.struct(F.lit(q).alias("nominal"), F.avg((pit <= q).cast("double")).alias("observed")) for q in levels)).alias("a"))
    return row.select(F.explode("a").alias("s")).select("s.*")


class PITRecalibrator:
    """A monotone map of 0..1 onto 0..1, piecewise linear between fitted points and level beyond them."""

    def __init__(self, xs: list[float], ys: list[float]):
        self.xs, self.ys = xs, ys

    @classmethod
    def fit(cls, df: DataFrame, pit: Column, points: int = 2000) -> PITRecalibrator:
        """Isotonic regression of even plotting positions, (rank - 1/2) / n, on the PIT values of a calibration set, which
        are monotone already but for ties, that share their mean. Of more than `points` different values, so many
        quantiles take part."""
        rows = df.select(pit.cast("double").alias("u")).filter("u is not null")
        n = rows.count()
        if n < 2:
            raise ValueError(f"at least 2 calibration values are needed, not {n}")
        found = rows.groupBy("u").agg(F.count("*").alias("n")).limit(points + 1).collect()
        if len(found) <= points:
            found.sort(key=lambda r: r["u"])
            ends = list(itertools.accumulate(r["n"] for r in found))
            return cls([float(r["u"]) for r in found], [(e - r["n"] / 2) / n for e, r in zip(ends, found, strict=True)])
        levels = [(i + 0.5) / points for i in range(points)]
        merged: dict[float, list[float]] = {}
        for x, y in zip(rows.agg(quantile(F.col("u"), levels, n)).first()[0], levels, strict=True):
            merged.setdefault(float(x), []).append(y)
        return cls(list(merged), [sum(y) / len(y) for y in merged.values()])

    def transform(self, values) -> np.ndarray:
        return np.clip(np.interp(np.asarray(values, float), self.xs, self.ys), 0.0, 1.0)

    def column(self, pit: Column) -> Column:
        """transform() of a Column: the two points around each value are found by binary search over the fitted ones."""
        xs, ys = self.xs, self.ys

        @F.pandas_udf("double")
        def mapped(u: pd.Series) -> pd.Series:
            return pd.Series(np.clip(np.interp(u, xs, ys), 0.0, 1.0)).where(u.notna().to_numpy())

        return mapped(pit.cast("double"))
