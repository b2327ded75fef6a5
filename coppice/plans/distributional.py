"""Distributional boosting: a tree for each parameter a round, on plain or natural gradients."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import DistributionOutput, Tweedie, get_distribution
from ..functions.metrics import crps_gaussian, interval_score, pinball_loss
from ..functions.quantiles import quantile
from ..operators.growth import scores
from .boosting import TreeModel


class DistributionalGBDT(TreeModel):
    """Boosting of all parameters of a distribution. exposure (of fit): a column that multiplies the mean; its log is
    added to the raw value of the family's exposure parameter."""

    natural = False
    WATCHED = -1

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | dict(distribution="normal", power=1.5)

    @property
    def family(self):
        return Tweedie(self.power) if self.distribution == "tweedie" else get_distribution(self.distribution)

    @property
    def task(self):
        return {"nonnegative": "regression"}.get(self.family.task, self.family.task)

    def _outputs(self):
        return len(self.family.names)

    def _offset_all(self):
        return False

    def _base(self, df, label, weight):
        y = F.col(f"`{label}`").cast("double")
        logy = F.ln(F.greatest(y, F.lit(1e-10)))
        row = df.agg(F.avg(y), F.stddev_pop(y), quantile(y, 0.5, df.count()), F.avg(logy), F.stddev_pop(logy)).first()
        s = dict(zip(("mean", "std", "median", "log_mean", "log_std"), map(float, row), strict=True))
        return np.array(self.family.initial(s), float)

    def _linked(self):
        family, index = self.family, None
        if self.exposure_ and family.exposure:
            index, sign = family.names.index(family.exposure[0]), family.exposure[1]
        elif self.exposure_:
            raise ValueError(f"{type(family).__name__} takes no exposure")

        def linked(block, raw):
            if index is not None:
                raw = raw.copy()
                raw[index] = raw[index] + sign * block.columns["offset"]
            return family.params(raw)

        return family, linked

    def _gradient(self):
        family, linked = self._linked()
        natural, squares = self.natural, getattr(self, "squares_", None)

        def gradient(block, raw):
            p, y = linked(block, raw), block.columns["y"]
            if squares is not None:
                g = np.array([np.broadcast_to(x, y.shape) for x in family.gradient(y, p)])
                f = np.maximum(squares, 1e-6)[:, None]
                return (np.clip(np.nan_to_num(g / f), -100, 100), np.ones_like(g)) if natural else (np.nan_to_num(g), np.broadcast_to(f, g.shape))
            if natural:
                g = np.array([np.broadcast_to(x, y.shape) for x in family.natural(y, p)])
                return np.clip(np.nan_to_num(g), -100, 100), np.ones_like(g)
            g = np.array([np.broadcast_to(x, y.shape) for x in family.gradient(y, p)])
            h = np.array([np.broadcast_to(x, y.shape) for x in family.hessian(y, p)])
            return np.nan_to_num(g), np.maximum(np.nan_to_num(h), 1e-6)

        return gradient

    def _round(self, matrix, pending, r, n, now=None):
        """A family whose Fisher information is empirical has the mean squares of its gradients over all rows summed
        first."""
        self.squares_ = None
        if self.family.empirical:
            family, linked = self._linked()
            raw = now or (lambda block: scores(block, pending))

            def work(block):
                g = np.array([np.broadcast_to(x, (block.n,)) for x in family.gradient(block.columns["y"], linked(block, raw(block)))])
                yield "s", np.append((np.nan_to_num(g) ** 2).sum(1), block.n)

            total = matrix.sums(work, {"s": (len(family.names) + 1,)})["s"]
            self.squares_ = total[:-1] / max(1.0, total[-1])
        return super()._round(matrix, pending, r, n, now)

    def _monitored(self):
        family, linked = self._linked()
        return lambda block, raw: family.nll(block.columns["y"], linked(block, raw))

    def _with_exposure(self, raw: Column, offset: Column) -> Column:
        name, sign = self.family.exposure
        at = self.family.names.index(name)
        return F.transform(raw, lambda v, i: F.when(i == at, v + sign * offset).otherwise(v))

    def predict_params(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """df with a column for each parameter."""
        raw = df.withColumn("_raw", self._raw_column(df))
        p = self.family.params([F.col("_raw")[i] for i in range(self._outputs())])
        return raw.withColumns({f"{prefix}{n}": p[n] for n in self.family.names}).drop("_raw")

    def predict_distribution(self, df: DataFrame) -> DistributionOutput:
        return DistributionOutput(self.predict_params(df, "_"), self.family, {n: f"_{n}" for n in self.family.names})

    def _plain(self, out: DataFrame) -> DataFrame:
        return out.drop(*(f"_{n}" for n in self.family.names))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """df with the mean."""
        return self._plain(self.predict_distribution(df).mean(output))

    def predict_quantile(self, df: DataFrame, q: float, output: str = "quantile") -> DataFrame:
        return self._plain(self.predict_distribution(df).quantile(q, output))

    def predict_interval(self, df: DataFrame, alpha: float = 0.1, lower: str = "lower", upper: str = "upper") -> DataFrame:
        return self._plain(self.predict_distribution(df).interval(alpha, lower, upper))

    def sample(self, df: DataFrame, n_samples: int = 1, seed: int = 0, output: str = "samples") -> DataFrame:
        return self._plain(self.predict_distribution(df).sample(n_samples, seed, output))

    def score(self, df: DataFrame, label: str | None = None, metric: str = "nll", quantiles=(0.1, 0.5, 0.9), alpha: float = 0.1) -> float:
        """Mean negative log-likelihood, or crps (normal), pinball or interval_score."""
        label = label or self.label_
        out = self.predict_distribution(df)
        y = F.col(label).cast("double")
        if metric == "nll":
            row = out.nll(label).agg(F.avg("nll")).first()
        elif metric == "crps":
            row = out.mean("_m").withColumn("_s", F.sqrt(self.family.variance({n: F.col(f"_{n}") for n in self.family.names}))).agg(crps_gaussian(y, F.col("_m"), F.col("_s"))).first()
        elif metric == "interval_score":
            row = out.interval(alpha).agg(interval_score(y, F.col("lower"), F.col("upper"), alpha)).first()
        elif metric == "pinball":
            values = [out.quantile(q, "_q").agg(pinball_loss(y, F.col("_q"), q)).first()[0] for q in quantiles]
            return float(np.mean(values))
        else:
            raise ValueError(f"unknown metric {metric!r}")
        return float(row[0]) if row[0] is not None else math.nan

    def nll(self, df: DataFrame, label: str | None = None) -> float:
        return self.score(df, label)


class NaturalBoost(DistributionalGBDT):
    """Natural gradients with unit hessians; trees of depth 4 by default."""

    natural = True

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | dict(max_depth=4)


def _factory(name: str):
    def make(**kwargs) -> NaturalBoost:
        return NaturalBoost(distribution=name, **kwargs)

    make.__doc__ = f"NaturalBoost of the {name} family."
    return make


NaturalBoostNormal, NaturalBoostLogNormal, NaturalBoostGamma = map(_factory, ("normal", "lognormal", "gamma"))
NaturalBoostPoisson, NaturalBoostStudentT, NaturalBoostNegBin = map(_factory, ("poisson", "studentt", "negativebinomial"))


def NaturalBoostTweedie(power: float = 1.5, **kwargs) -> NaturalBoost:
    """NaturalBoost of the Tweedie family at a power."""
    return NaturalBoost(distribution="tweedie", power=power, **kwargs)
