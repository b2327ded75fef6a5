"""Boosted trees whose leaves hold ridge regressions on a few features each."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.growth import scores
from ..operators.matrix import Matrix
from ..operators.splits import GrowthConfig
from ..operators.tree import Tree
from .boosting import RENEW, GradientBoosting


class LinearTree(Tree):
    """A tree with, at each leaf, features and weights of a linear function; the last weight is the intercept."""

    def __init__(self, tree: Tree, models: dict[int, tuple[list[int], list[float]]]):
        super().__init__(**tree.__dict__)
        self.__dict__["models"] = models

    def predict_values(self, bins: np.ndarray, x: np.ndarray) -> np.ndarray:
        """x: raw feature values (features, rows), missing as 0."""
        leaf = self.route(bins)
        out = np.zeros(len(leaf))
        for node, (used, w) in self.models.items():
            at = leaf == node
            if at.any():
                out[at] = w[-1] + (np.array(w[:-1]) @ x[np.ix_(used, np.flatnonzero(at))] if used else 0.0)
        return out


class LinearLeafGBDT(GradientBoosting):
    """max_features_linear: sqrt, log2, a number or None for all numeric features: the most a leaf's regression takes,
    those best correlated with its target -g/h. Leaves of fewer than min_samples_leaf rows hold their weighted mean."""

    WATCHED = -1

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | dict(max_depth=4, min_samples_leaf=20, reg_lambda_tree=1.0, reg_lambda_linear=0.1, max_features_linear="sqrt")

    def _config(self):
        return GrowthConfig(self.max_depth, self.max_leaves, self.min_samples_leaf, self.reg_lambda_tree, self.reg_alpha, self.gamma, self.subsample, self.colsample_bytree, self.growth)

    def _numeric(self) -> list[int]:
        return [i for i, f in enumerate(self.features_) if f in self.binner_.edges]

    def _columns(self, df, label, weight, exposure) -> dict[str, Column]:
        out = super()._columns(df, label, weight, exposure)
        for i in self._numeric():
            out[f"x{i}"] = F.coalesce(F.nanvl(F.col(f"`{self.features_[i]}`").cast("double"), F.lit(0.0)), F.lit(0.0))
        return out

    def _now(self, pending):
        """Raw scores of a block under trees with linear leaves."""
        numeric, p = self._numeric(), len(self.features_)

        def now(block):
            if not pending:
                return block.raw
            x = np.zeros((p, block.n))
            for i in numeric:
                x[i] = block.columns[f"x{i}"]
            raw = block.raw.copy()
            for rate, trees in pending:
                raw[0] += rate * trees[0].predict_values(block.bins, x)
            return raw

        return now

    def _train(self, matrix, watched, manager, n):
        from ..operators.growth import get_growth_strategy
        from .callbacks import TrainingState

        state = TrainingState(self, n_rounds=self.n_trees)
        manager.begin(state)
        strategy, pending, ahead = get_growth_strategy(self.growth), [], []
        for r in range(self.n_trees):
            state.round_idx, self.round_rate_ = r, self.learning_rate
            manager.round_begin(state)
            drawn = self._round(matrix, pending, r, n, self._now(list(pending)))
            tree = self._with_leaves(matrix, strategy.grow(drawn)[0], drawn.gradient)
            self.trees_.rounds.append([tree])
            self.trees_.rates.append(self.round_rate_)
            pending.append((self.round_rate_, [tree]))
            ahead.append((self.round_rate_, [tree]))
            if manager.needs_loss:
                state.train_loss = self._plain_loss(matrix, pending)
                state.val_loss = self._plain_loss(watched, ahead) if watched else None
            go_on = manager.round_end(state)
            if len(pending) >= RENEW and r + 1 < self.n_trees:
                matrix.__dict__.update(matrix.advanced(self._now(list(pending))).__dict__)
                pending.clear()
                if watched:
                    watched.__dict__.update(watched.advanced(self._now(list(ahead))).__dict__)
                    ahead.clear()
            if not go_on:
                break
        manager.end(state)

    def _plain_loss(self, matrix, pending):
        now = self._now(list(pending))

        def work(block):
            w, y = block.columns["w"], block.columns["y"]
            yield "s", np.array([((now(block)[0] - y) ** 2 * w).sum(), w.sum()])

        total = matrix.sums(work, {"s": (2,)})["s"]
        return float(total[0] / total[1])

    def _with_leaves(self, matrix: Matrix, tree: Tree, weighted) -> LinearTree:
        leaves = [i for i, f in enumerate(tree.feature) if f < 0]
        numeric = self._numeric()
        m, k = len(numeric), len(leaves)
        slot = np.full(len(tree.feature), -1)
        slot[leaves] = np.arange(k)

        def moments(block):
            """For each leaf: the weighted moments of (1, x..., target)."""
            g, h = (x[0] for x in weighted(block))
            target = np.where(h > 0, -g / np.maximum(h, 1e-12), 0.0)
            rows = np.vstack([np.ones(block.n), *(block.columns[f"x{i}"] for i in numeric), target])
            at = slot[tree.route(block.bins)]
            out, counts = np.zeros((k, m + 2, m + 2)), np.bincount(at, None, k)
            for leaf in np.flatnonzero(counts):
                own = rows[:, at == leaf]
                out[leaf] = (own * h[at == leaf]) @ own.T
            yield "m", out
            yield "n", counts

        # One pass: the moments hold what the correlations and the normal equations of any choice of features need.
        got = matrix.sums(moments, {"m": (k, m + 2, m + 2), "n": (k,)})
        most = {"sqrt": max(1, int(math.sqrt(m))), "log2": max(1, int(math.log2(max(2, m)))), None: m}.get(self.max_features_linear, self.max_features_linear)
        models = {}
        for leaf, node in enumerate(leaves):
            models[node] = self._ridge(got["m"][leaf], got["n"][leaf], numeric, int(most))
        return LinearTree(tree, models)

    def _ridge(self, moment, n, numeric, most) -> tuple[list[int], list[float]]:
        total = moment[0, 0]
        mean = float(moment[0, -1] / total) if total > 0 else 0.0
        if n < self.min_samples_leaf or not numeric or total <= 0:
            return [], [mean]
        average = moment[0] / total
        cov = moment / total - np.outer(average, average)
        spread = np.sqrt(np.maximum(np.diag(cov), 0))
        corr = np.abs(cov[1:-1, -1]) / np.where(spread[1:-1] * spread[-1] > 1e-12, spread[1:-1] * spread[-1], np.inf)
        used = [int(i) for i in np.argsort(-corr, kind="stable")[:most] if corr[i] > 0]
        if not used:
            return [], [mean]
        at = [0, *(i + 1 for i in used)]
        left, right = moment[np.ix_(at, at)].copy(), moment[at, -1]
        left[np.arange(1, len(at)), np.arange(1, len(at))] += self.reg_lambda_linear
        try:
            w = np.linalg.solve(left, right)
        except np.linalg.LinAlgError:
            return [], [mean]
        return [numeric[i] for i in used], [*map(float, w[1:]), float(w[0])]

    def _scorer(self, rounds=None):
        trees, base, numeric, p = self.trees_, float(self.base_[0]), self._numeric(), len(self.features_)

        def score(bins, columns):
            x = np.zeros((p, bins.shape[1]))
            for i in numeric:
                x[i] = np.nan_to_num(np.asarray(columns[i], dtype=float))
            out = np.full(bins.shape[1], base)
            for rate, own in list(zip(trees.rates, trees.rounds, strict=True))[:rounds]:
                out += rate * own[0].predict_values(bins, x)
            return out[None]

        return score

    def score(self, df: DataFrame, label: str | None = None) -> float:
        """R squared; 0 if the label is constant."""
        from ..functions.metrics import r2_score

        return float(self.predict(df, "_p").agg(r2_score(F.col(label or self.label_).cast("double"), F.col("_p"))).first()[0])

    def _extra(self):
        return {"models": [{str(n): m for n, m in own[0].models.items()} for own in self.trees_.rounds]}

    def _load_extra(self, extra):
        self.trees_.rounds = [[LinearTree(own[0], {int(n): (m[0], m[1]) for n, m in models.items()})] for own, models in zip(self.trees_.rounds, extra["models"], strict=True)]
