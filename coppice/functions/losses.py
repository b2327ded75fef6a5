"""Losses: gradient and hessian of a raw prediction, as Columns or on arrays, and the value that is monitored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .ops import clip, engine, sigmoid

FLOOR = 1e-6


def mse(p, y):
    m = engine(p)
    return p - y, m.full(p, 1)


def logloss(p, y):
    s = sigmoid(p)
    return s - y, clip(s * (1.0 - s), FLOOR, 1.0 - FLOOR)


def huber(p, y, delta=1.0):
    m, d = engine(p), p - y
    return clip(d, -delta, delta), m.where(m.abs(d) <= delta, 1.0, FLOOR)


def mae(p, y):
    m = engine(p)
    return m.sign(p - y) * 1.0, m.full(p, 1)


def quantile(p, y, alpha=0.5):
    """Here the residual is y - p: an underestimate pushes up with weight alpha."""
    m = engine(p)
    return m.where(p - y > 0, 1.0 - alpha, -alpha), m.full(p, 1)


def poisson(p, y):
    m = engine(p)
    e = m.exp(clip(p, -20, 20))
    return e - y, m.maximum(e, FLOOR)


def gamma(p, y):
    m = engine(p)
    r = y * m.exp(-clip(p, -20, 20))
    return 1.0 - r, m.maximum(r, FLOOR)


def tweedie(p, y, rho=1.5):
    m = engine(p)
    q = clip(p, -20, 20)
    a = m.exp(q * (2.0 - rho))
    return a - y * m.exp(q * (1.0 - rho)), m.maximum((2.0 - rho) * a, FLOOR)


def _value_mse(p, y):
    return (p - y) * (p - y)


def _value_logloss(p, y):
    m = engine(p)
    s = clip(sigmoid(p), 1e-15, 1 - 1e-15)
    return -(y * m.log(s) + (1.0 - y) * m.log(1.0 - s))


def _value_huber(p, y, delta=1.0):
    m = engine(p)
    d = m.abs(p - y)
    return m.where(d <= delta, 0.5 * d * d, delta * (d - 0.5 * delta))


def _value_mae(p, y):
    return engine(p).abs(p - y)


def _value_quantile(p, y, alpha=0.5):
    m = engine(p)
    return m.where(y >= p, alpha * (y - p), (alpha - 1.0) * (y - p))


def _value_poisson(p, y):
    return engine(p).exp(clip(p, -20, 20)) - y * p


def _value_gamma(p, y):
    return p + y * engine(p).exp(-clip(p, -20, 20))


def _value_tweedie(p, y, rho=1.5):
    m, q = engine(p), clip(p, -20, 20)
    return m.exp(q * (2.0 - rho)) / (2.0 - rho) - y * m.exp(q * (1.0 - rho)) / (1.0 - rho)


@dataclass(frozen=True)
class Loss:
    """gradient(p, y) -> (g, h); value(p, y), or None for the mean of g^2 / 2h."""

    name: str
    gradient: Callable
    value: Callable | None = None
    builtin: bool = True
    params: dict = field(default_factory=dict)

    def __call__(self, p, y):
        return self.gradient(p, y, **self.params)

    def monitored(self, p, y):
        if self.value is not None:
            return self.value(p, y, **self.params)
        g, h = self(p, y)
        return g * g / (2.0 * engine(p).maximum(h, 1e-10))


_REGISTRY: dict[str, Loss] = {}
_PARAMS = {"huber": ("delta",), "quantile": ("alpha",), "tweedie": ("rho",)}
for _names, _g, _v in (
    (("mse", "squared_error"), mse, _value_mse),
    (("logloss", "binary_crossentropy"), logloss, _value_logloss),
    (("huber",), huber, _value_huber),
    (("mae", "l1", "absolute_error"), mae, _value_mae),
    (("poisson",), poisson, _value_poisson),
    (("gamma",), gamma, _value_gamma),
    (("quantile",), quantile, _value_quantile),
    (("tweedie",), tweedie, _value_tweedie),
):
    for _n in _names:
        _REGISTRY[_n] = Loss(_names[0], _g, _v)
BUILTIN = frozenset(_REGISTRY)
LOG_LOSSES = ("logloss",)


def register_loss(name: str, fn: Callable, *, value: Callable | None = None, override: bool = False) -> None:
    """Make fn(p, y) -> (g, h) available by name. It must work on numpy arrays; if it is written with functions.ops it
    works on Columns too. A name in use raises unless override; overriding drops the old value function."""
    if name in _REGISTRY and not override:
        raise ValueError(f"loss {name!r} is registered; pass override=True to replace it")
    _REGISTRY[name] = Loss(name, fn, value, builtin=False)


def unregister_loss(name: str) -> None:
    _REGISTRY.pop(name, None)


def is_builtin_loss(loss) -> bool:
    return isinstance(loss, str) and loss in BUILTIN and _REGISTRY[loss].builtin


def get_loss(loss, **params) -> Loss:
    """A Loss from a name, a callable (p, y) -> (g, h) or a Loss. params: delta, alpha or rho where the loss has it."""
    if isinstance(loss, Loss):
        return loss
    if callable(loss):
        return Loss(getattr(loss, "__name__", "custom"), loss, getattr(loss, "loss_value", None), builtin=False)
    if loss not in _REGISTRY:
        raise ValueError(f"unknown loss {loss!r}; known: {', '.join(sorted(_REGISTRY))}")
    found = _REGISTRY[loss]
    own = {k: v for k, v in params.items() if k in _PARAMS.get(found.name, ()) and v is not None}
    return Loss(found.name, found.gradient, found.value, found.builtin, own)


def softmax_arrays(raw):
    """(classes, rows) raw scores -> probabilities."""
    import numpy as np

    e = np.exp(raw - raw.max(0))
    return e / (e.sum(0) + 1e-10)


def softmax_columns(raw):
    """Array column of raw scores -> array column of probabilities."""
    from pyspark.sql import functions as F

    top = F.array_max(raw)
    e = F.transform(raw, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v) + 1e-10
    return F.transform(e, lambda v: v / total)
