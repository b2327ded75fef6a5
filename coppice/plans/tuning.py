"""Parameter suggestions, grids, cross-validation and training of many configurations."""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import hashed_folds, stratified_folds
from .boosting import GradientBoosting

#: A label of more values is not one of classes.
MOST_CLASSES = 50


def suggest_params(df: DataFrame, features: list[str], label: str, task: str = "regression", n_estimators_cap: int = 500, style: str = "sklearn") -> dict:
    """Starting parameters from the number of rows and features and, for classes, their number and balance. style: "core"
    names the trees n_trees, as the models here do, "sklearn" n_estimators. Two small aggregates; a label of more than 50
    different values is taken for none of classes."""
    n, p = df.count(), len(features)
    sizes = []
    if task == "classification":
        sizes = [r["count"] for r in df.groupBy(f"`{label}`").count().limit(MOST_CLASSES + 1).collect()]
        sizes = sizes if len(sizes) <= MOST_CLASSES else []
    step = sum(n >= bound for bound in (1000, 10_000, 100_000))
    trees = min((100, 200, 300, 500)[step], n_estimators_cap)
    out = {"trees": trees, "learning_rate": 0.05 if trees >= 300 else 0.1}
    if task == "distributional":
        out["max_depth"] = min(5, 3 + p // 50)
    else:
        out["max_depth"] = min(6, 4 + p // 100) if p > 100 else min(8, 4 + p // 20)
    out["reg_lambda"], out["min_child_weight"] = ((10.0, 3.0), (1.0, 1.0), (0.1, 1.0))[min(step, 2)]
    if n > 10_000:
        out["subsample"] = out["colsample_bytree"] = 0.8
    if p > 100:
        out["colsample_bytree"] = 0.6
    if sizes and max(sizes) > 5 * min(sizes):
        out |= {"trees": min(trees + 100, n_estimators_cap), "learning_rate": 0.05}
    if len(sizes) > 10:
        out["max_depth"] = min(out["max_depth"], 6)
    return {("n_trees" if style == "core" else "n_estimators"): out.pop("trees")} | out


#: The parameter grids by task.
GRIDS = {
    "regression": {"n_estimators": [100, 300, 500], "max_depth": [4, 6, 8], "learning_rate": [0.01, 0.05, 0.1], "subsample": [0.7, 0.8, 1.0], "colsample_bytree": [0.7, 0.8, 1.0], "reg_lambda": [0.1, 1.0, 10.0]},
    "classification": {"n_estimators": [100, 300, 500], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1], "subsample": [0.7, 0.8, 1.0], "colsample_bytree": [0.7, 0.8, 1.0], "reg_lambda": [0.1, 1.0, 10.0]},
    "distributional": {"n_estimators": [100, 200, 500], "max_depth": [3, 4, 5], "learning_rate": [0.05, 0.1, 0.2], "reg_lambda": [0.1, 1.0, 5.0]},
}


def get_param_grid(task: str = "regression", style: str = "sklearn") -> dict[str, list]:
    """The grid of a task. style "core" names the trees n_trees, for the models here."""
    if task not in GRIDS:
        raise ValueError(f"unknown task {task!r}; one of {sorted(GRIDS)}")
    return {("n_trees" if style == "core" and k == "n_estimators" else k): list(v) for k, v in GRIDS[task].items()}


def _out_of_fold(folds: DataFrame, cv: int, fit, apply) -> DataFrame:
    """Each fold scored by the model of the others; the folded table is cached while models train."""
    folds = folds.persist()
    try:
        parts = [apply(fit(folds.filter(F.col("fold") != k).drop("fold")), folds.filter(F.col("fold") == k)) for k in range(cv)]
    finally:
        folds.unpersist()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_val_predict(model: GradientBoosting, df: DataFrame, features: list[str], label: str, id_col: str, cv: int = 5, seed: int = 42) -> DataFrame:
    """df with fold and prediction, each row predicted by a model that did not see it."""
    fit = lambda d: type(model)(**model.get_params()).fit(d, features, label)
    return _out_of_fold(hashed_folds(df, id_col, cv, seed), cv, fit, lambda m, d: m.predict(d))


def cross_val_predict_proba(model: GradientBoosting, df: DataFrame, features: list[str], label: str, id_col: str, cv: int = 5, seed: int = 42) -> DataFrame:
    """The same with probabilities, on folds that hold the same share of each class."""
    fit = lambda d: type(model)(**model.get_params()).fit(d, features, label)
    return _out_of_fold(stratified_folds(df, label, id_col, cv, seed), cv, fit, lambda m, d: m.predict_proba(d))


def cross_val_predict_interval(model, df: DataFrame, features: list[str], label: str, id_col: str, alpha: float = 0.1, cv: int = 5, seed: int = 42) -> DataFrame:
    """The same with lower and upper from a distributional model."""
    fit = lambda d: type(model)(**model.get_params()).fit(d, features, label)
    return _out_of_fold(hashed_folds(df, id_col, cv, seed), cv, fit, lambda m, d: m.predict_interval(d, alpha))


@dataclass
class ConfigBatch:
    """Configurations to train on one table."""

    configs: list[dict]
    n_rounds: int = 100

    def __post_init__(self):
        if not self.configs or self.n_rounds < 1:
            raise ValueError("at least one configuration and one round are needed")

    @classmethod
    def from_grid(cls, max_depth=(6,), reg_lambda=(1.0,), min_child_weight=(1.0,), learning_rate=(0.1,), n_rounds: int = 100) -> ConfigBatch:
        names = ("max_depth", "reg_lambda", "min_child_weight", "learning_rate")
        return cls([dict(zip(names, c, strict=True)) for c in itertools.product(max_depth, reg_lambda, min_child_weight, learning_rate)], n_rounds)

    @classmethod
    def from_lists(cls, max_depths, reg_lambdas, min_child_weights, learning_rates, n_rounds: int = 100) -> ConfigBatch:
        names = ("max_depth", "reg_lambda", "min_child_weight", "learning_rate")
        return cls([dict(zip(names, c, strict=True)) for c in zip(max_depths, reg_lambdas, min_child_weights, learning_rates, strict=True)], n_rounds)

    def __len__(self):
        return len(self.configs)

    def table(self, spark) -> DataFrame:
        rows = [(i, int(c["max_depth"]), float(c["reg_lambda"]), float(c["min_child_weight"]), float(c["learning_rate"])) for i, c in enumerate(self.configs)]
        return spark.createDataFrame(rows, "config_id int, max_depth int, reg_lambda double, min_child_weight double, learning_rate double")


def fit_batch(df: DataFrame, features: list[str], label: str, batch: ConfigBatch, parallelism: int = 4, **params) -> list[GradientBoosting]:
    """A model for each configuration. Those that differ only in how trees grow share one pass over the table, its bins and
    its blocks; jobs of several models share the cluster."""
    models = [GradientBoosting(n_trees=batch.n_rounds, **c, **params) for c in batch.configs]
    groups: dict[str, list[GradientBoosting]] = {}
    for m in models:
        groups.setdefault(repr([(k, v) for k, v in m.get_params().items() if k not in m.GROWTH_ONLY]), []).append(m)
    for group in groups.values():
        lead = group[0]
        build, n = lead._prepared(df, features, label)
        matrix = build(df)
        try:
            with ThreadPoolExecutor(max(1, parallelism)) as pool:
                list(pool.map(lambda m, lead=lead, matrix=matrix, n=n: m.fit_on(lead, matrix, n), group))
        finally:
            matrix.release()
    return models
