"""Additive models: a value for each bin of each feature, and for pairs of bins of chosen pairs of features.

A round is one pass: the histogram of all features gives every shape its update at once. Nothing but the shapes, whose
size does not depend on rows, goes back to the workers.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.losses import LOG_LOSSES
from ..functions.ops import sigmoid
from ..operators.growth import FittedTrees
from ..operators.matrix import Matrix
from ..operators.validation import ValidationError, check_is_fitted
from .boosting import GradientBoosting
from .callbacks import TrainingState

#: Rows that pairs are ranked on: a bounded sample, drawn by hash.
PAIR_ROWS = 50_000


def pava(values: np.ndarray, weights: np.ndarray, increasing: bool = True) -> np.ndarray:
    """Weighted monotone fit by pooling adjacent violators."""
    sign = 1.0 if increasing else -1.0
    pools: list[list[float]] = []
    for v, w in zip(values * sign, np.maximum(weights, 1e-12), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return sign * np.concatenate([np.full(int(n), v) for v, _, n in pools])


def smoothed(updates: np.ndarray, hess: np.ndarray, smoothing: float) -> np.ndarray:
    """Updates penalised by the squares of steps between neighbouring bins: a tridiagonal solve."""
    n = len(updates)
    if smoothing <= 0 or n < 2:
        return updates
    weight = np.maximum(hess, 1e-12)
    diagonal = weight + smoothing * np.r_[1, np.full(n - 2, 2.0), 1] if n > 2 else weight + smoothing
    c, d = np.zeros(n), np.zeros(n)
    right = weight * updates
    c[0], d[0] = -smoothing / diagonal[0], right[0] / diagonal[0]
    for i in range(1, n):
        bottom = diagonal[i] + smoothing * c[i - 1]
        c[i] = -smoothing / bottom
        d[i] = (right[i] + smoothing * d[i - 1]) / bottom
    out = d.copy()
    for i in range(n - 2, -1, -1):
        out[i] = d[i] - c[i] * out[i + 1]
    return out


class AdditiveModel(GradientBoosting):
    """Generalised additive model by cyclic-free boosting. interactions: how many pairs of features get a table.
    monotone: {feature: 1 or -1}. smoothing: penalty on steps between neighbouring bins."""

    WATCHED = -1
    SAMPLES = False

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | dict(n_trees=1000, learning_rate=0.01, interactions=0, interaction_rounds=None, smoothing=0.0, monotone=None)

    def state(self):
        return self.shapes_, self.pairs_

    def restore(self, kept):
        self.shapes_, self.pairs_ = kept

    def _score_of(self, shapes, pairs):
        base = float(self.base_[0])

        def score(bins):
            out = np.full(bins.shape[1], base)
            for f in range(len(shapes)):
                out += shapes[f][bins[f]]
            for (i, j), table in pairs.items():
                out += table[bins[i], bins[j]]
            return out[None]

        return score

    def _train(self, matrix, watched, manager, n):
        state = TrainingState(self, n_rounds=self.n_trees)
        p = len(self.features_)
        self.shapes_, self.pairs_ = np.zeros((p, 256)), {}
        self.trees_ = FittedTrees()
        manager.begin(state)
        counts = None
        stopped = False
        for r in range(self.n_trees):
            state.round_idx, self.round_rate_ = r, self.learning_rate
            manager.round_begin(state)
            g, h, c = self._sums(matrix)
            counts = c if counts is None else counts
            update = np.where(h > 0, -g / np.maximum(h + self.reg_lambda, 1e-12), 0.0)
            for f in range(p):
                size = max(1, len(self.binner_.edges.get(self.features_[f], [])))
                if self.smoothing and self.features_[f] in self.binner_.edges:
                    update[f, :size] = smoothed(update[f, :size], h[f, :size], self.smoothing)
            self.shapes_ = self.shapes_ + self.round_rate_ * update
            self._apply_monotone(counts)
            if not self._told(manager, state, matrix, watched):
                stopped = True
                break
        if self.interactions and not stopped:
            self._boost_pairs(matrix, watched, manager, state, n)
        manager.end(state)

    def _sums(self, matrix: Matrix):
        """Gradient, hessian and row sums of every bin of every feature."""
        gradient, score, p = self._gradient(), self._score_of(self.shapes_, self.pairs_), len(self.features_)

        def work(block):
            g, h = gradient(block, score(block.bins))
            w = block.columns["w"]
            yield "h", np.array([[np.bincount(b, x, 256) for b in block.bins] for x in (g[0] * w, h[0] * w, None)])

        return matrix.sums(work, {"h": (3, p, 256)})["h"]

    def _told(self, manager, state, matrix, watched) -> bool:
        if manager.needs_loss:
            state.train_loss = self._shape_loss(matrix)
            state.val_loss = self._shape_loss(watched) if watched else None
        return manager.round_end(state)

    def _shape_loss(self, matrix):
        score, value = self._score_of(self.shapes_, self.pairs_), self._monitored()

        def work(block):
            w = block.columns["w"]
            yield "s", np.array([(value(block, score(block.bins)) * w).sum(), w.sum()])

        total = matrix.sums(work, {"s": (2,)})["s"]
        return float(total[0] / total[1])

    def _apply_monotone(self, counts):
        for name, sign in (self.monotone or {}).items():
            f = self.features_.index(name)
            size = max(1, len(self.binner_.edges.get(name, [])))
            self.shapes_[f, :size] = pava(self.shapes_[f, :size], counts[f, :size], sign > 0)

    def _boost_pairs(self, matrix, watched, manager, state, n):
        gradient, p, lam = self._gradient(), len(self.features_), self.reg_lambda
        pairs = list(itertools.combinations(range(p), 2))
        score = self._score_of(self.shapes_, self.pairs_)
        from ..operators.sampling import uniform

        share, seed = min(1.0, PAIR_ROWS / max(1, n)), self.random_state

        # A pass ranks the pairs, a group of them at a time so that their tables stay small.
        gains = {}
        for lo in range(0, len(pairs), 16):
            own = pairs[lo : lo + 16]

            def work(block, own=own):
                g, h = gradient(block, score(block.bins))
                w = block.columns["w"] * (uniform(block.ids, seed, 77) < share)
                for k, (i, j) in enumerate(own):
                    at = block.bins[i].astype(np.int64) * 256 + block.bins[j]
                    yield str(k), np.array([np.bincount(at, x, 65536).reshape(256, 256) for x in (g[0] * w, h[0] * w)])

            got = matrix.sums(work, {str(k): (2, 256, 256) for k in range(len(own))})
            for k, pair in enumerate(own):
                g, h = got[str(k)]
                one = lambda a, b: float((a * a / (b + lam + 1e-12)).sum())
                gains[pair] = one(g, h) - one(g.sum(1), h.sum(1)) - one(g.sum(0), h.sum(0))
        chosen = sorted(pairs, key=lambda q: (-gains[q], q))[: int(self.interactions)]
        self.pairs_ = {q: np.zeros((256, 256)) for q in chosen}
        rounds = self.interaction_rounds or max(1, self.n_trees // 4)
        for r in range(rounds):
            state.round_idx = len(range(self.n_trees)) + r
            for i, j in chosen:  # one after the other within a round
                score = self._score_of(self.shapes_, self.pairs_)

                def work(block, i=i, j=j, score=score):
                    g, h = gradient(block, score(block.bins))
                    at = block.bins[i].astype(np.int64) * 256 + block.bins[j]
                    w = block.columns["w"]
                    yield "t", np.array([np.bincount(at, x, 65536).reshape(256, 256) for x in (g[0] * w, h[0] * w)])

                g, h = matrix.sums(work, {"t": (2, 256, 256)})["t"]
                self.pairs_[i, j] = self.pairs_[i, j] + self.learning_rate * np.where(h > 0, -g / np.maximum(h + lam, 1e-12), 0.0)
            if not self._told(manager, state, matrix, watched):
                break

    def _scorer(self, rounds=None):
        score = self._score_of(self.shapes_, self.pairs_)
        return lambda bins, columns: score(bins)

    def get_feature_importance(self) -> dict[str, float]:
        """Variance of each shape over its 256 entries."""
        check_is_fitted(self)
        return {f: float(np.var(s)) for f, s in zip(self.features_, self.shapes_, strict=True)}

    def get_shape_function(self, feature: str) -> np.ndarray:
        return self.shapes_[self.features_.index(feature)].copy()

    def get_pair_shape_function(self, a: str, b: str) -> np.ndarray:
        i, j = self.features_.index(a), self.features_.index(b)
        if (i, j) in self.pairs_:
            return self.pairs_[i, j].copy()
        if (j, i) in self.pairs_:
            return self.pairs_[j, i].T.copy()
        raise KeyError((a, b))

    def shape_table(self, feature: str) -> DataFrame:
        """(bin, x, value): what a plot of the shape would show; x is the bin's lower edge or its category."""
        f = self.features_.index(feature)
        edges = self.binner_.edges.get(feature)
        known = ["-inf", *map(repr, edges[:-1])] if edges else list(map(str, self.binner_.categories.get(feature, [])))
        rows = [(i, x, float(self.shapes_[f, i])) for i, x in enumerate(known)] + [(255, "missing", float(self.shapes_[f, 255]))]
        return self.spark_.createDataFrame(rows, "bin int, x string, value double")

    def predict_proba(self, df: DataFrame, output: str = "probability") -> DataFrame:
        if self._loss_of().name not in LOG_LOSSES:
            raise ValidationError("probabilities need a log loss")
        return df.withColumn(output, sigmoid(self._raw_column(df)[0]))

    def _extra(self):
        return {"shapes": self.shapes_.tolist(), "pairs": [[i, j, t.tolist()] for (i, j), t in self.pairs_.items()]}

    def _load_extra(self, extra):
        self.shapes_ = np.array(extra["shapes"])
        self.pairs_ = {(i, j): np.array(t) for i, j, t in extra["pairs"]}
