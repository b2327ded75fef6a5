"""Distribution families: parameters on their links, gradients in link space, Fisher information, moments and draws.

Gradients and densities are written on functions.ops, so the same formula serves DataFrames and training blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ops import clip, digamma, engine, lgamma, normal_cdf, sigmoid, softplus, trigamma

LINKS: dict[str, Callable] = {
    "identity": lambda x: x,
    "exp": lambda x: engine(x).exp(clip(x, -20, 20)),
    "softplus": softplus,
    "sigmoid": sigmoid,
    "square": lambda x: x * x,
}


def _stack(*xs):
    like = next(x for x in xs if np.ndim(x))
    return np.stack([np.broadcast_to(np.asarray(x, float), np.shape(like)) for x in xs])


class Distribution:
    """names: parameters; links: their link functions. gradient(y, params) is that of the negative log-likelihood by
    raw parameter; fisher(params) its diagonal; initial(stats) raw starting values from moments of the target."""

    names: tuple[str, ...] = ()
    links: tuple[str, ...] = ()
    task = "regression"
    #: The parameter that an exposure multiplies, and the sign of its log in link space; None: no exposure.
    exposure: tuple[str, int] | None = None
    #: Whether the Fisher information is the mean square of the gradients over all rows.
    empirical = False

    def params(self, raw) -> dict:
        """Linked parameters from raw ones, in order."""
        return {n: self.link(n)(raw[i]) for i, n in enumerate(self.names)}

    def link(self, name: str) -> Callable:
        return LINKS[self.links[self.names.index(name)]]

    def gradient(self, y, p) -> list:
        raise NotImplementedError

    def fisher(self, p, y=None) -> list:
        raise NotImplementedError

    def natural(self, y, p) -> list:
        """Natural gradient: the gradient over the diagonal of the Fisher information."""
        return [g / engine(f).maximum(f, 1e-10) if not np.isscalar(f) else g / f for g, f in zip(self.gradient(y, p), self.fisher(p, y), strict=True)]

    def hessian(self, y, p) -> list:
        return self.fisher(p, y)

    def nll(self, y, p):
        raise NotImplementedError

    def mean(self, p):
        raise NotImplementedError

    def variance(self, p):
        raise NotImplementedError

    def quantile(self, p: dict, q: float) -> np.ndarray:
        """By bisection on the distribution function; on arrays."""
        center, spread = np.asarray(self.mean(p), float), np.sqrt(np.maximum(np.asarray(self.variance(p), float), 1e-12))
        low, high = center - 12 * spread, center + 12 * spread
        if self.task in ("positive", "count"):
            low, high = np.zeros_like(center), center + 40 * spread + 1
        for _ in range(80):
            mid = (low + high) / 2
            below = self.cdf(mid, p) < q
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        return np.ceil(high - 1e-9) if self.task == "count" else (low + high) / 2

    def cdf(self, y, p) -> np.ndarray:
        """Numerically, from the density on a grid of 256 points; families override it."""
        center, spread = np.asarray(self.mean(p), float), np.sqrt(np.asarray(self.variance(p), float))
        grid = center + np.linspace(-8, 8, 256)[:, None] * spread
        density = np.exp(-np.asarray(self.nll(grid, {k: np.asarray(v)[None] for k, v in p.items()})))
        total = np.concatenate([np.zeros((1, len(center))), np.cumsum((density[1:] + density[:-1]) / 2, 0)])
        total = total / np.maximum(total[-1], 1e-300)
        return np.array([np.interp(a, g, t) for a, g, t in zip(np.broadcast_to(y, center.shape), grid.T, total.T, strict=True)])

    def sample(self, p: dict, n: int, rng: np.random.Generator) -> np.ndarray:
        """(rows, n) draws, by inverting the distribution function."""
        rows = len(np.asarray(self.mean(p)))
        return np.stack([np.array([self.quantile({k: v[i : i + 1] for k, v in p.items()}, q)[0] for i, q in enumerate(rng.random(rows))]) for _ in range(n)], 1)

    def initial(self, s: dict) -> list[float]:
        raise NotImplementedError


class Normal(Distribution):
    names, links = ("loc", "scale"), ("identity", "exp")

    def gradient(self, y, p):
        z = (y - p["loc"]) / p["scale"]
        return [-z / p["scale"], 1.0 - z * z]

    def fisher(self, p, y=None):
        return [1.0 / (p["scale"] * p["scale"]), engine(p["scale"]).full(p["scale"], 2)]

    def nll(self, y, p):
        z = (y - p["loc"]) / p["scale"]
        return 0.5 * math.log(2 * math.pi) + engine(p["scale"]).log(p["scale"]) + 0.5 * z * z

    def mean(self, p):
        return p["loc"]

    def variance(self, p):
        return p["scale"] * p["scale"]

    def cdf(self, y, p):
        return normal_cdf((y - p["loc"]) / p["scale"])

    def quantile(self, p, q):
        return p["loc"] + p["scale"] * NormalDist().inv_cdf(q)

    def sample(self, p, n, rng):
        return rng.normal(np.asarray(p["loc"])[:, None], np.asarray(p["scale"])[:, None], (len(p["loc"]), n))

    def initial(self, s):
        return [s["mean"], math.log(s["std"] + 1e-6)]


class LogNormal(Normal):
    task = "positive"

    def gradient(self, y, p):
        return super().gradient(engine(y).log(engine(y).maximum(y, 1e-10)), p)

    def nll(self, y, p):
        t = engine(y).log(engine(y).maximum(y, 1e-10))
        return super().nll(t, p) + t

    def mean(self, p):
        return engine(p["loc"]).exp(p["loc"] + 0.5 * p["scale"] * p["scale"])

    def variance(self, p):
        m, v = engine(p["loc"]), p["scale"] * p["scale"]
        return (m.exp(v) - 1.0) * m.exp(2.0 * p["loc"] + v)

    def cdf(self, y, p):
        return super().cdf(np.log(np.maximum(y, 1e-300)), p)

    def quantile(self, p, q):
        return np.exp(super().quantile(p, q))

    def sample(self, p, n, rng):
        return np.exp(super().sample(p, n, rng))

    def initial(self, s):
        return [s["log_mean"], math.log(s["log_std"] + 1e-6)]


class Gamma(Distribution):
    """concentration and rate; their Fisher information is not diagonal, so the natural gradient solves 2 x 2."""

    names, links, task, exposure = ("concentration", "rate"), ("exp", "exp"), "positive", ("rate", -1)

    def gradient(self, y, p):
        a, b, m = p["concentration"], p["rate"], engine(y)
        return [a * (digamma(a) - m.log(b) - m.log(m.maximum(y, 1e-10))), b * y - a]

    def fisher(self, p, y=None):
        a = p["concentration"]
        return [clip(a * a * trigamma(a), 0.1, 100.0), a]

    def natural(self, y, p):
        a = p["concentration"]
        g1, g2 = self.gradient(y, p)
        f11, f12, f22 = a * a * trigamma(a), -a, a
        det = engine(a).maximum(f11 * f22 - f12 * f12, 1e-10)
        return [(f22 * g1 - f12 * g2) / det, (f11 * g2 - f12 * g1) / det]

    def nll(self, y, p):
        a, b, m = p["concentration"], p["rate"], engine(y)
        return lgamma(a) - a * m.log(b) - (a - 1.0) * m.log(m.maximum(y, 1e-10)) + b * y

    def mean(self, p):
        return p["concentration"] / p["rate"]

    def variance(self, p):
        return p["concentration"] / (p["rate"] * p["rate"])

    def cdf(self, y, p):
        return gamma_cdf(np.maximum(y, 0) * p["rate"], p["concentration"])

    def sample(self, p, n, rng):
        return rng.gamma(np.asarray(p["concentration"])[:, None], 1 / np.asarray(p["rate"])[:, None], (len(p["rate"]), n))

    def initial(self, s):
        var = max(s["std"] ** 2, 1e-6)
        return [math.log(max(s["mean"] ** 2 / var, 1e-6)), math.log(max(s["mean"] / var, 1e-6))]


class Poisson(Distribution):
    names, links, task, exposure = ("rate",), ("exp",), "count", ("rate", 1)

    def gradient(self, y, p):
        return [p["rate"] - y]

    def fisher(self, p, y=None):
        return [p["rate"]]

    def nll(self, y, p):
        return p["rate"] - y * engine(y).log(p["rate"]) + lgamma(y + 1.0)

    def mean(self, p):
        return p["rate"]

    variance = mean

    def cdf(self, y, p):
        k = np.floor(y)
        return np.where(k < 0, 0.0, 1 - gamma_cdf(np.asarray(p["rate"], float), np.maximum(k, 0) + 1))

    def sample(self, p, n, rng):
        return rng.poisson(np.asarray(p["rate"])[:, None], (len(p["rate"]), n)).astype(float)

    def initial(self, s):
        return [math.log(s["mean"] + 1e-6)]


class StudentT(Distribution):
    """loc, scale and degrees of freedom, 2 + softplus of the raw value."""

    names, links = ("loc", "scale", "df"), ("identity", "exp", "softplus")

    def params(self, raw):
        return {"loc": raw[0], "scale": LINKS["exp"](raw[1]), "df": 2.0 + softplus(raw[2])}

    def gradient(self, y, p):
        v, m = p["df"], engine(y)
        z = (y - p["loc"]) / p["scale"]
        w = (v + 1.0) / (v + z * z)
        d = 0.5 * (digamma(0.5 * v) - digamma(0.5 * (v + 1.0)) + 1.0 / v + m.log(1.0 + z * z / v) - (v + 1.0) * z * z / (v * (v + z * z)))
        # by the chain rule: the derivative of softplus at df - 2
        return [-w * z / p["scale"], 1.0 - w * z * z, d * (1.0 - m.exp(-(v - 2.0)))]

    def fisher(self, p, y=None):
        m, v = engine(p["df"]), p["df"]
        return [(v + 1.0) / ((v + 3.0) * p["scale"] * p["scale"]), m.full(v, 2), m.full(v, 0.1)]

    def nll(self, y, p):
        v, m = p["df"], engine(y)
        z = (y - p["loc"]) / p["scale"]
        return lgamma(0.5 * v) - lgamma(0.5 * (v + 1.0)) + 0.5 * m.log(v * math.pi) + m.log(p["scale"]) + 0.5 * (v + 1.0) * m.log(1.0 + z * z / v)

    def mean(self, p):
        return p["loc"]

    def variance(self, p):
        return p["scale"] * p["scale"] * p["df"] / (p["df"] - 2.0 + 1e-10)

    def cdf(self, y, p):
        z, v = (np.asarray(y) - p["loc"]) / p["scale"], p["df"]
        tail = 0.5 * beta_cdf(v / (v + z * z), v / 2, np.full(np.shape(v), 0.5))
        return np.where(z > 0, 1 - tail, tail)

    def sample(self, p, n, rng):
        return np.asarray(p["loc"])[:, None] + np.asarray(p["scale"])[:, None] * rng.standard_t(np.asarray(p["df"])[:, None], (len(p["df"]), n))

    def initial(self, s):
        return [s["median"], math.log(s["std"] + 1e-6), math.log(math.expm1(8.0))]


class Tweedie(Distribution):
    """Mean and dispersion at a fixed power between 1 and 2; the likelihood is the compound Poisson-gamma series."""

    names, links, task, exposure = ("mu", "phi"), ("exp", "exp"), "nonnegative", ("mu", 1)

    def __init__(self, power: float = 1.5):
        if not 1 < power < 2:
            raise ValueError("power must lie between 1 and 2")
        self.power = power

    def deviance(self, y, mu):
        m, r = engine(y), self.power
        zero = 2.0 * m.power(mu, 2.0 - r) / (2.0 - r)
        pos = m.maximum(y, 1e-10)
        some = 2.0 * (m.power(pos, 2.0 - r) / ((1.0 - r) * (2.0 - r)) - y * m.power(mu, 1.0 - r) / (1.0 - r) + m.power(mu, 2.0 - r) / (2.0 - r))
        return m.where(y > 0, some, zero)

    def gradient(self, y, p):
        m, r = engine(y), self.power
        return [p["mu"] * (m.power(p["mu"], 1.0 - r) - y * m.power(p["mu"], -r)) / p["phi"], 1.0 - self.deviance(y, p["mu"]) / (2.0 * p["phi"])]

    def fisher(self, p, y=None):
        m = engine(p["mu"])
        return [m.power(p["mu"], 2.0 - self.power) / p["phi"], m.full(p["mu"], 0.5)]

    def nll(self, y, p):
        """On arrays; terms of the series within the range that matters around its peak."""
        y, mu, phi, r = np.asarray(y, float), np.asarray(p["mu"], float), np.asarray(p["phi"], float), self.power
        y, mu, phi = np.broadcast_arrays(y, mu, phi)
        rate, shape, scale = mu ** (2 - r) / (phi * (2 - r)), (2 - r) / (r - 1), phi * (r - 1) * mu ** (r - 1)
        out = rate.copy()
        some = y > 0
        if some.any():
            ys, lam, th = y[some], rate[some], scale[some]
            peak = np.maximum(1, np.round(ys ** (2 - r) / ((2 - r) * phi[some])))
            half = int(min(10_000, max(30, 8 * np.sqrt(peak.max()) + 30)))
            top, total = np.full(len(ys), -np.inf), np.zeros(len(ys))
            for k in range(-half, half + 1):
                j = peak + k
                ok = j >= 1
                jj = np.maximum(j, 1)
                t = np.where(ok, jj * np.log(lam) - lgamma(jj + 1) + shape * jj * np.log(ys / th) - lgamma(shape * jj) - np.log(ys) - ys / th, -np.inf)
                new = np.maximum(top, t)
                total = total * np.exp(np.where(np.isfinite(top), np.where(np.isfinite(top), top, 0) - np.where(np.isfinite(new), new, 0), 0)) + np.exp(np.where(np.isfinite(t), t, -np.inf) - np.where(np.isfinite(new), new, 0))
                top = new
            out[some] = lam - top - np.log(total)
        return out

    def mean(self, p):
        return p["mu"]

    def variance(self, p):
        return p["phi"] * engine(p["mu"]).power(p["mu"], self.power)

    def cdf(self, y, p):
        """Zero mass, and above it a gamma with the moments of the positive part."""
        mu, phi, r = np.asarray(p["mu"], float), np.asarray(p["phi"], float), self.power
        zero = np.exp(-(mu ** (2 - r)) / (phi * (2 - r)))
        m = mu / np.maximum(1 - zero, 1e-12)
        v = np.maximum((phi * mu**r + mu * mu) / np.maximum(1 - zero, 1e-12) - m * m, 1e-12)
        return np.where(np.asarray(y) < 0, 0.0, zero + (1 - zero) * gamma_cdf(np.maximum(y, 0) * m / v, m * m / v))

    def quantile(self, p, q):
        mu, phi = np.asarray(p["mu"], float), np.asarray(p["phi"], float)
        low, high = np.zeros_like(mu), mu + 40 * np.sqrt(phi * mu**self.power) + 1
        for _ in range(80):
            mid = (low + high) / 2
            below = self.cdf(mid, p) < q
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        return np.where(self.cdf(np.zeros_like(mu), p) >= q, 0.0, (low + high) / 2)

    def sample(self, p, n, rng):
        mu, phi, r = np.asarray(p["mu"], float)[:, None], np.asarray(p["phi"], float)[:, None], self.power
        counts = rng.poisson(mu ** (2 - r) / (phi * (2 - r)), (len(mu), n))
        return np.where(counts > 0, rng.gamma(np.maximum(counts, 1e-12) * (2 - r) / (r - 1), phi * (r - 1) * mu ** (r - 1)), 0.0)

    def initial(self, s):
        mean = max(s["mean"], 1e-6)
        return [math.log(mean), math.log(max(s["std"] ** 2 / mean**self.power, 1e-6))]


class NegativeBinomial(Distribution):
    names, links, task, exposure = ("mu", "r"), ("exp", "exp"), "count", ("mu", 1)

    def gradient(self, y, p):
        mu, r, m = p["mu"], p["r"], engine(y)
        q = r / (r + mu)
        return [(mu - y) * q, -r * (digamma(y + r) - digamma(r) + m.log(q) + (1.0 - q) - y / (r + mu))]

    def fisher(self, p, y=None):
        q = p["r"] / (p["r"] + p["mu"])
        return [p["mu"] * q, clip(p["r"] * trigamma(p["r"]), 0.1, 10.0)]

    def nll(self, y, p):
        mu, r, m = p["mu"], p["r"], engine(y)
        return lgamma(r) + lgamma(y + 1.0) - lgamma(y + r) - r * m.log(r / (r + mu)) - y * m.log(m.maximum(mu / (r + mu), 1e-300))

    def mean(self, p):
        return p["mu"]

    def variance(self, p):
        return p["mu"] + p["mu"] * p["mu"] / p["r"]

    def cdf(self, y, p):
        k = np.floor(y)
        return np.where(k < 0, 0.0, beta_cdf(p["r"] / (p["r"] + p["mu"]), np.asarray(p["r"], float), np.maximum(k, 0) + 1))

    def prob_exceed(self, p, threshold) -> np.ndarray:
        return 1 - self.cdf(threshold, p)

    def sample(self, p, n, rng):
        r, mu = np.asarray(p["r"], float)[:, None], np.asarray(p["mu"], float)[:, None]
        return rng.negative_binomial(r, r / (r + mu), (len(r), n)).astype(float)

    def initial(self, s):
        mean = max(s["mean"], 1e-6)
        over = max(s["std"] ** 2 - mean, 1e-6)
        return [math.log(mean), math.log(min(max(mean * mean / over, 0.1), 1000.0))]


@dataclass
class CustomDistribution(Distribution):
    """A family from its negative log-likelihood nll_fn(y, params): gradients by central differences in parameter space
    and the link's chain rule; the Fisher diagonal is the mean square of the gradients, 1e-6 at least."""

    param_names: list[str] = field(default_factory=list)
    link_functions: list[str] = field(default_factory=list)
    nll_fn: Callable | None = None
    mean_fn: Callable | None = None
    variance_fn: Callable | None = None
    init_fn: Callable | None = None
    eps: float = 1e-5
    empirical = True

    def __post_init__(self):
        self.names, self.links = tuple(self.param_names), tuple(self.link_functions)

    def params(self, raw):
        return {n: self.link(n)(raw[i]) for i, n in enumerate(self.names)} | {"_raw": raw}

    def gradient(self, y, p):
        out = []
        for i, n in enumerate(self.names):
            step = self.eps
            up, down = ({k: v for k, v in p.items() if k != "_raw"} for _ in range(2))
            up[n], down[n] = p[n] + step, p[n] - step
            slope = (self.nll_fn(y, up) - self.nll_fn(y, down)) / (2 * step)
            raw = p["_raw"][i]
            chain = (self.link(n)(raw + step) - self.link(n)(raw - step)) / (2 * step)
            out.append(clip(slope * chain, -1e6, 1e6))
        return out

    def fisher(self, p, y=None):
        """Of arrays that hold all rows. Training sums the squares over all blocks instead; Columns need an aggregate."""
        g = self.gradient(y, p)
        if any(isinstance(x, Column) for x in g):
            raise TypeError("aggregate the squares of gradient(): the Fisher information is their mean over all rows")
        return [np.full(len(x), max(float(np.mean(x * x)), 1e-6)) for x in g]

    def nll(self, y, p):
        return self.nll_fn(y, p)

    def mean(self, p):
        return self.mean_fn(p) if self.mean_fn else p[self.names[0]]

    def variance(self, p):
        return self.variance_fn(p) if self.variance_fn else p[self.names[-1]] * p[self.names[-1]]

    def initial(self, s):
        return list(self.init_fn(s)) if self.init_fn else [0.0] * len(self.names)


def create_custom_distribution(param_names, link_functions, nll_fn, mean_fn=None, variance_fn=None, init_fn=None) -> CustomDistribution:
    return CustomDistribution(list(param_names), list(link_functions), nll_fn, mean_fn, variance_fn, init_fn)


_FAMILIES: dict[str, type] = {"normal": Normal, "lognormal": LogNormal, "gamma": Gamma, "poisson": Poisson, "studentt": StudentT, "tweedie": Tweedie, "negativebinomial": NegativeBinomial}
_ALIASES = {"gaussian": "normal", "log_normal": "lognormal", "student_t": "studentt", "student": "studentt", "t": "studentt", "negbin": "negativebinomial", "negative_binomial": "negativebinomial", "nb": "negativebinomial"}


def get_distribution(name) -> Distribution:
    if isinstance(name, Distribution):
        return name
    key = _ALIASES.get(name.lower(), name.lower())
    if key not in _FAMILIES:
        raise ValueError(f"unknown distribution {name!r}; known: {', '.join(list_distributions())}")
    return _FAMILIES[key]()


def register_distribution(name: str, *, override: bool = False):
    """Class decorator: make a family available by name, whatever its case."""

    def add(cls):
        if name.lower() in _FAMILIES and not override:
            raise ValueError(f"distribution {name!r} is registered; pass override=True to replace it")
        _FAMILIES[name.lower()] = cls
        return cls

    return add


def list_distributions() -> list[str]:
    return sorted(_FAMILIES)


def gamma_cdf(x, a) -> np.ndarray:
    """Regularised lower incomplete gamma function, by its series or continued fraction."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float))
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - lgamma(a))
    small = x < a + 1
    term = total = 1 / a
    for n in range(1, 400):
        term = term * x / (a + n)
        total = total + term
    low = front * total
    b, c, d = x + 1 - a, np.full(x.shape, 1e300), 1 / np.where(np.abs(x + 1 - a) < 1e-300, 1e-300, x + 1 - a)
    h = d.copy()
    for n in range(1, 400):
        an = -n * (n - a)
        b = b + 2
        d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
        c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
        h = h * d * c
    return np.where(x <= 0, 0.0, np.clip(np.where(small, low, 1 - front * h), 0, 1))


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    x = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(x), 1 / tiny(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for coefficient in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / tiny(1 + coefficient * d), tiny(1 + coefficient / c)
            h = h * d * c
    out = np.clip(front * h, 0, 1)
    return np.where(flip, 1 - out, out)


class DistributionOutput:
    """A DataFrame with a column for each parameter of a family, and what follows from them as further columns."""

    def __init__(self, df: DataFrame, family: Distribution, columns: dict[str, str]):
        self.df, self.family, self.columns = df, family, columns

    def _params(self) -> dict[str, Column]:
        return {n: F.col(c) for n, c in self.columns.items()}

    def mean(self, output: str = "mean") -> DataFrame:
        return self.df.withColumn(output, self.family.mean(self._params()))

    def variance(self, output: str = "variance") -> DataFrame:
        return self.df.withColumn(output, self.family.variance(self._params()))

    def std(self, output: str = "std") -> DataFrame:
        return self.df.withColumn(output, F.sqrt(self.family.variance(self._params())))

    def _arrays(self, work, kind: str) -> Column:
        names = list(self.columns)

        @F.pandas_udf(kind)
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(list(work({n: c.to_numpy() for n, c in zip(names, columns, strict=True)})))

        return run(*(F.col(c) for c in self.columns.values()))

    def quantile(self, q: float, output: str = "quantile") -> DataFrame:
        family = self.family
        return self.df.withColumn(output, self._arrays(lambda p: np.asarray(family.quantile(p, q), float), "double"))

    def interval(self, alpha: float = 0.1, lower: str = "lower", upper: str = "upper") -> DataFrame:
        out = DistributionOutput(self.quantile(alpha / 2, lower), self.family, self.columns)
        return out.quantile(1 - alpha / 2, upper)

    def sample(self, n: int = 1, seed: int = 0, output: str = "samples") -> DataFrame:
        family, names = self.family, list(self.columns)

        @F.pandas_udf("array<double>")
        def draw(key: pd.Series, *columns: pd.Series) -> pd.Series:
            # seeded by the rows themselves, so that a retried task draws the same
            rng = np.random.default_rng([seed & 0xFFFFFFFF, *(key.to_numpy()[:4].astype(np.int64).view(np.uint64) & 0xFFFFFFFF).tolist(), len(key)])
            return pd.Series(list(family.sample({m: c.to_numpy() for m, c in zip(names, columns, strict=True)}, n, rng)))

        return self.df.withColumn(output, draw(F.xxhash64(*self.columns.values()), *(F.col(c) for c in self.columns.values())))

    def nll(self, label: str, output: str = "nll") -> DataFrame:
        family, names = self.family, [*self.columns, "_y"]

        @F.pandas_udf("double")
        def run(*columns: pd.Series) -> pd.Series:
            p = {n: c.to_numpy() for n, c in zip(names, columns, strict=True)}
            return pd.Series(np.asarray(family.nll(p.pop("_y"), p), float))

        return self.df.withColumn(output, run(*(F.col(c) for c in self.columns.values()), F.col(label).cast("double")))

    def cdf(self, label: str, output: str = "cdf") -> DataFrame:
        family, names = self.family, [*self.columns, "_y"]

        @F.pandas_udf("double")
        def run(*columns: pd.Series) -> pd.Series:
            p = {n: c.to_numpy() for n, c in zip(names, columns, strict=True)}
            return pd.Series(np.asarray(family.cdf(p.pop("_y"), p), float))

        return self.df.withColumn(output, run(*(F.col(c) for c in self.columns.values()), F.col(label).cast("double")))
