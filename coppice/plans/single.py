"""Single trees on given gradients, for boosting schemes of one's own, and histograms in row batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.growth import Round, get_growth_strategy
from ..operators.matrix import Matrix, node_histogram
from ..operators.sampling import uniform
from ..operators.splits import GrowthConfig
from ..operators.tree import Tree
from ..operators.validation import validate_features, validate_weight
from ..sources.binner import Binner


@dataclass
class FittedTree:
    """One tree and the bins it was grown on."""

    tree: Tree
    binner: Binner

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """df with the value of each row's leaf."""
        self.binner.check(df)
        tree, binner = self.tree, self.binner

        @F.pandas_udf("double")
        def value(*columns: pd.Series) -> pd.Series:
            return pd.Series(tree.predict(binner.bins([c.to_numpy() for c in columns])))

        return df.withColumn(output, value(*(F.col(f"`{f}`") if f in binner.categories else F.col(f"`{f}`").cast("double") for f in binner.features)))

    def leaf(self, df: DataFrame) -> Column:
        """Leaf number as nested CASE over the features' bins."""
        return self.tree.expression([self.binner.column(df, f) for f in self.binner.features], leaf=True)


def fit_tree(
    df: DataFrame, features: list[str], grad: str, hess: str, *, max_depth: int = 6, min_child_weight: float = 1.0, reg_lambda: float = 1.0, reg_alpha: float = 0.0, min_gain: float = 0.0,
    growth: str = "levelwise", max_leaves: int | None = None, subsample: float = 1.0, colsample_bytree: float = 1.0, n_bins: int = 254, categorical=(), seed: int = 0, binner: Binner | None = None, id_col: str | None = None,
) -> FittedTree:
    """Grow one tree on columns of gradients and hessians. Rows that subsample leaves out weigh nothing."""
    validate_features(df, features)
    validate_weight(df, hess)
    binner = binner or Binner.fit(df, features, n_bins, list(categorical))
    matrix = Matrix.build(df, binner, {"g": F.col(f"`{grad}`"), "h": F.col(f"`{hess}`")}, id_col)

    def gradient(block):
        w = (uniform(block.ids, seed) < subsample) if subsample < 1 else 1.0
        return (block.columns["g"] * w)[None], (block.columns["h"] * w)[None]

    allowed = None
    if colsample_bytree < 1:
        mask = np.zeros(len(features), bool)
        mask[np.random.default_rng(seed).choice(len(features), max(1, int(len(features) * colsample_bytree)), replace=False)] = True
        allowed = [mask]
    config = GrowthConfig(max_depth, max_leaves, min_child_weight, reg_lambda, reg_alpha, min_gain, subsample, colsample_bytree, growth)
    try:
        return FittedTree(get_growth_strategy(growth).grow(Round(matrix, gradient, config, 1, allowed))[0], binner)
    finally:
        matrix.release()


def batched_histogram(df: DataFrame, features: list[str], grad: str, hess: str, binner: Binner | None = None, build=node_histogram) -> np.ndarray:
    """(features, 256, 3) sums of gradient, hessian and rows, block by block of each partition; memory does not grow
    with rows. build(bins, g, h, node, nodes) may be replaced by a kernel of one's own."""
    binner = binner or Binner.fit(df, features)
    matrix = Matrix.build(df, binner, {"g": F.col(f"`{grad}`"), "h": F.col(f"`{hess}`")})

    def work(block):
        yield "h", build(block.bins, block.columns["g"], block.columns["h"], np.zeros(block.n, np.int64), 1)[0]

    try:
        return matrix.sums(work, {"h": (len(features), 256, 3)})["h"]
    finally:
        matrix.release()
