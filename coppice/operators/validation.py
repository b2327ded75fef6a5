"""Checks of inputs and parameters; each table check is one aggregate."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ValidationError(ValueError):
    """An input that a model cannot be trained on or applied to."""


def _feature_check(df: DataFrame, features: list[str], allow_missing: bool = True):
    """Aggregates over df, and what is made of their values."""
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ValidationError(f"missing features: {absent}")
    if not features:
        raise ValidationError("no features")
    odd = [T.ArrayType, T.MapType, T.StructType, T.BinaryType]
    bad = [f for f in features if type(df.schema[f].dataType) in odd]
    if bad:
        raise ValidationError(f"features must be numbers, booleans or strings: {bad}")
    real = [f for f in features if isinstance(df.schema[f].dataType, (T.FloatType, T.DoubleType))]
    infinite = F.count_if(F.greatest(*(F.when(F.abs(F.col(f"`{f}`")) == float("inf"), 1).otherwise(0) for f in real), F.lit(0), F.lit(0)) > 0)
    missing = [F.col(f"`{f}`").isNull() | (F.isnan(F.col(f"`{f}`")) if f in real else F.lit(False)) for f in features]
    some = missing[0]
    for m in missing[1:]:
        some = some | m

    def verdict(n, inf, gaps):
        if not n:
            raise ValidationError("the table is empty")
        if inf:
            raise ValidationError(f"{inf} rows hold infinite features")
        if gaps and not allow_missing:
            raise ValidationError(f"{gaps} rows hold missing features")

    return [F.count("*"), infinite, F.count_if(some)], verdict


def _label_check(df: DataFrame, label: str, task: str = "regression", n_classes: int | None = None):
    if label not in df.columns:
        raise ValidationError(f"no label column {label!r}")
    y = F.col(f"`{label}`").cast("double")
    rules = {
        "binary": y.isin(0.0, 1.0),
        "multiclass": (y == F.floor(y)) & (y >= 0) & (y < (n_classes or 1 << 31)),
        "positive": y > 0,
        "count": (y >= 0) & (F.abs(y - F.rint(y)) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(y))),
    }
    ok = y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))

    def verdict(bad, off):
        if bad:
            raise ValidationError(f"{bad} labels are null, NaN or infinite")
        if off:
            raise ValidationError(f"{off} labels do not fit the task {task!r}")

    return [F.count_if(~ok), F.count_if(ok & ~rules.get(task, F.lit(True)))], verdict


def _weight_check(df: DataFrame, weight: str, positive: bool = False):
    if weight not in df.columns:
        raise ValidationError(f"no column {weight!r}")
    w = F.col(f"`{weight}`").cast("double")

    def verdict(bad):
        if bad:
            raise ValidationError(f"{bad} values of {weight!r} are null, not finite or {'not positive' if positive else 'negative'}")

    return [F.count_if(w.isNull() | F.isnan(w) | (w == float("inf")) | ((w <= 0) if positive else (w < 0)))], verdict


def _run(df: DataFrame, checks: list) -> list:
    """All checks by one aggregate; the values of the first."""
    values = list(df.agg(*(c for columns, _ in checks for c in columns)).first())
    first = values[: len(checks[0][0])]
    for columns, verdict in checks:
        verdict(*values[: len(columns)])
        values = values[len(columns) :]
    return first


def validate_features(df: DataFrame, features: list[str], allow_missing: bool = True) -> int:
    """Rows of df; raises on absent features, infinite values, an empty table, or missing values if not allowed."""
    return _run(df, [_feature_check(df, features, allow_missing)])[0]


def validate_label(df: DataFrame, label: str, task: str = "regression", n_classes: int | None = None) -> None:
    """No null, NaN or infinite label; for binary 0 or 1; for multiclass whole numbers from 0 to n_classes - 1; for
    positive above 0; for count whole numbers from 0."""
    _run(df, [_label_check(df, label, task, n_classes)])


def validate_weight(df: DataFrame, weight: str, positive: bool = False) -> None:
    """Non-negative (or positive, as exposures are) and finite."""
    _run(df, [_weight_check(df, weight, positive)])


def validate_training(df: DataFrame, features: list[str], label: str, task: str = "regression", n_classes: int | None = None, weight: str | None = None, exposure: str | None = None) -> int:
    """Rows of df; validate_features(), validate_label() and validate_weight() in one pass over the table."""
    checks = [_feature_check(df, features), _label_check(df, label, task, n_classes)]
    checks += [_weight_check(df, weight)] if weight else []
    checks += [_weight_check(df, exposure, positive=True)] if exposure else []
    return _run(df, checks)[0]


def validate_eval_set(eval_set: list[DataFrame], features: list[str], label: str, weight: str | None = None, exposure: str | None = None) -> None:
    """Each table has the columns of training, some rows, and finite labels; one pass a table."""
    for i, e in enumerate(eval_set):
        try:
            validate_training(e, features, label, weight=weight, exposure=exposure)
        except ValidationError as error:
            raise ValidationError(f"evaluation table {i}: {error}") from error


def validate_predict_input(df: DataFrame, features: list[str]) -> int:
    """Rows of df; what training asks of features, before a model is applied. Scoring itself takes no pass of its own: it
    checks columns and types only, and an infinite value falls into the first or last bin."""
    return validate_features(df, features)


def validate_hyperparameters(n_trees: int, max_depth: int, learning_rate: float, min_child_weight: float = 1.0, reg_lambda: float = 1.0, subsample: float = 1.0, n_rows: int | None = None) -> None:
    if n_trees < 1 or max_depth < 1:
        raise ValidationError("n_trees and max_depth must be 1 at least")
    if learning_rate <= 0:
        raise ValidationError("learning_rate must be positive")
    if min_child_weight < 0 or reg_lambda < 0:
        raise ValidationError("min_child_weight and reg_lambda must not be negative")
    if not 0 < subsample <= 1:
        raise ValidationError("subsample must be above 0 and at most 1")
    if learning_rate > 1:
        warnings.warn("a learning_rate above 1 rarely converges", stacklevel=3)
    if max_depth > 15:
        warnings.warn("trees deeper than 15 levels are slow and overfit", stacklevel=3)
    if n_rows is not None and n_rows < 20:
        warnings.warn(f"only {n_rows} rows to train on", stacklevel=3)


def check_is_fitted(model, attribute: str = "trees_") -> None:
    if getattr(model, attribute, None) is None:
        raise ValidationError(f"{type(model).__name__} is not fitted")
