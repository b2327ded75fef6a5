"""Gradient boosting on scalar losses: one output, or one for each class."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.losses import LOG_LOSSES, get_loss, softmax_arrays, softmax_columns
from ..functions.ops import sigmoid
from ..operators.growth import FittedTrees, Round, get_growth_strategy, scores
from ..operators.matrix import Block, Matrix
from ..operators.sampling import GOSSConfig, uniform
from ..operators.splits import GrowthConfig
from ..operators.validation import ValidationError, check_is_fitted, validate_eval_set, validate_hyperparameters, validate_training
from ..sources.binner import Binner
from ..sources.persistence import load_model, save_model
from .callbacks import CallbackManager, TrainingState, warn_without_eval

#: Rounds between two renewals of the cached raw scores.
RENEW = 20
#: Bits of a key told apart in one pass of smallest().
DIGIT = 16


def smallest(matrix: Matrix, keys, wanted: int) -> tuple[np.uint32, int, int]:
    """(cut, how many rows at the cut are among the `wanted` of smallest key, how many there are), in two passes over the
    bits of the keys. keys(block): 32-bit numbers of the rows that count."""
    cut, below, there = 0, 0, 0
    for step in range(2):
        high = np.uint32(cut)

        def work(block, step=step, high=high):
            k = keys(block)
            part = k >> np.uint32(DIGIT) if not step else k[k >> np.uint32(DIGIT) == high] & np.uint32(0xFFFF)
            yield "n", np.bincount(part, minlength=1 << DIGIT)

        counts = matrix.sums(work, {"n": (1 << DIGIT,)})["n"]
        upto = np.cumsum(counts)
        at = min(int(np.searchsorted(upto, wanted - below)), (1 << DIGIT) - 1)
        below, there = below + (int(upto[at - 1]) if at else 0), int(counts[at])
        cut = at if not step else (cut << DIGIT) | at
    return np.uint32(cut), wanted - below, there


class TreeModel:
    """What all boosted models share: parameters, the loop over rounds, scoring and files.

    fit(df, ...) takes a DataFrame; features are columns by name, strings and booleans are categorical. Missing values
    are null or NaN. Training reads the table twice (bins, blocks) and then works on cached blocks.
    """

    PARAMS: tuple[str, ...] = ()
    #: Which eval set callbacks watch: the first or the last.
    WATCHED = 0
    #: Whether rows and features can be sampled.
    SAMPLES = True
    #: Parameters that neither bins nor base scores depend on.
    GROWTH_ONLY = frozenset(("n_trees", "max_depth", "learning_rate", "min_child_weight", "reg_lambda", "reg_alpha", "gamma", "subsample", "colsample_bytree", "growth", "max_leaves", "random_state"))

    def __init__(self, **params):
        unknown = set(params) - set(self.defaults())
        if unknown:
            raise TypeError(f"{type(self).__name__} has no parameter {sorted(unknown)}")
        for k, v in (self.defaults() | params).items():
            setattr(self, k, v)
        self.trees_: FittedTrees | None = None
        self.round_rate_ = None

    @classmethod
    def defaults(cls) -> dict:
        return dict(n_trees=100, max_depth=6, learning_rate=0.1, min_child_weight=1.0, reg_lambda=1.0, reg_alpha=0.0, gamma=0.0, subsample=1.0, colsample_bytree=1.0, n_bins=254, growth="levelwise", max_leaves=None, random_state=0, categorical=(), approximate_bins=None)

    def get_params(self) -> dict:
        return {k: getattr(self, k) for k in self.defaults()}

    def set_params(self, **params):
        for k, v in params.items():
            if k not in self.defaults():
                raise TypeError(f"{type(self).__name__} has no parameter {k!r}")
            setattr(self, k, v)
        return self

    def state(self):
        """What early stopping keeps of the best round."""
        return self.trees_

    def restore(self, kept) -> None:
        self.trees_ = kept

    def _config(self) -> GrowthConfig:
        return GrowthConfig(self.max_depth, self.max_leaves, self.min_child_weight, self.reg_lambda, self.reg_alpha, self.gamma, self.subsample, self.colsample_bytree, self.growth)

    # -- to be given by each model --
    task = "regression"

    def _outputs(self) -> int:
        return 1

    def _base(self, df: DataFrame, label: str, weight: str | None) -> np.ndarray:
        raise NotImplementedError

    def _gradient(self):
        """A function (block, raw) -> (g, h), each (outputs, rows), without weights."""
        raise NotImplementedError

    def _monitored(self):
        """A function (block, raw) -> the value of each row that is averaged as the loss."""
        raise NotImplementedError

    def _columns(self, df: DataFrame, label: str, weight: str | None, exposure: str | None) -> dict[str, Column]:
        one = F.lit(1.0)
        return {"y": F.col(f"`{label}`"), "w": F.col(f"`{weight}`") if weight else one, "offset": F.ln(F.col(f"`{exposure}`")) if exposure else F.lit(0.0)}

    # -- the loop --
    def fit(self, df: DataFrame, features: list[str], label: str, weight: str | None = None, eval_set: list[DataFrame] | DataFrame | None = None, callbacks=None, id_col: str | None = None, exposure: str | None = None):
        """Train on df. eval_set: DataFrames of the same columns. id_col: a key of the rows, for seeded sampling."""
        eval_set = [eval_set] if isinstance(eval_set, DataFrame) else list(eval_set or [])
        if not self.SAMPLES and (self.subsample != 1 or self.colsample_bytree != 1 or getattr(self, "subsample_strategy", "none") != "none"):
            raise ValidationError(f"{type(self).__name__} takes all rows and features; it has no subsample, colsample_bytree or subsample_strategy")
        validate_eval_set(eval_set, features, label, weight, exposure)
        warn_without_eval(callbacks, eval_set)
        build, n = self._prepared(df, features, label, weight, id_col, exposure)
        matrix = build(df)
        watched = build(eval_set[self.WATCHED]) if eval_set else None
        try:
            self._grown(matrix, watched, callbacks, n)
        finally:
            matrix.release()
            if watched:
                watched.release()
        return self

    def _prepared(self, df: DataFrame, features: list[str], label: str, weight: str | None = None, id_col: str | None = None, exposure: str | None = None):
        """Check the table and fit the bins and the base score; a function that makes blocks of such tables, and the rows."""
        n = validate_training(df, features, label, self.task, getattr(self, "n_classes", None), weight, exposure)
        validate_hyperparameters(self.n_trees, self.max_depth, self.learning_rate, self.min_child_weight, self.reg_lambda, self.subsample, n)
        self.spark_ = df.sparkSession
        self.features_, self.label_, self.exposure_ = list(features), label, exposure
        self.binner_ = Binner.fit(df, features, self.n_bins, list(self.categorical), self.approximate_bins)
        self.base_ = np.broadcast_to(np.asarray(self._base(df, label, weight), float), (self._outputs(),)).copy()
        build = lambda d: Matrix.build(d, self.binner_, self._columns(d, label, weight, exposure), id_col, self._outputs(), self.base_, "offset" if exposure and self._offset_all() else None)
        return build, n

    def fit_on(self, lead: TreeModel, matrix: Matrix, n: int):
        """Train on the blocks that lead has prepared (n rows) for models that differ from it in GROWTH_ONLY alone."""
        validate_hyperparameters(self.n_trees, self.max_depth, self.learning_rate, self.min_child_weight, self.reg_lambda, self.subsample, n)
        for name in ("spark_", "features_", "label_", "exposure_", "binner_", "base_"):
            setattr(self, name, getattr(lead, name))
        own = matrix.lent()
        try:
            return self._grown(own, None, None, n)
        finally:
            own.release()

    def _grown(self, matrix: Matrix, watched: Matrix | None, callbacks, n: int):
        self.trees_ = FittedTrees()
        self._train(matrix, watched, CallbackManager(callbacks), n)
        return self

    def _offset_all(self) -> bool:
        return True

    def _train(self, matrix: Matrix, watched: Matrix | None, manager: CallbackManager, n: int) -> None:
        state = TrainingState(self, n_rounds=self.n_trees)
        manager.begin(state)
        strategy = get_growth_strategy(self.growth)
        pending: list = []
        ahead: list = []
        for r in range(self.n_trees):
            state.round_idx, self.round_rate_ = r, self.learning_rate
            manager.round_begin(state)
            trees = strategy.grow(self._round(matrix, list(pending), r, n))
            trees = self._finished(matrix, pending, trees, r)
            self.trees_.rounds.append(trees)
            self.trees_.rates.append(self.round_rate_)
            pending.append((self.round_rate_, trees))
            ahead.append((self.round_rate_, trees))
            if manager.needs_loss:
                state.train_loss = self._loss(matrix, pending)
                state.val_loss = self._loss(watched, ahead) if watched else None
            go_on = manager.round_end(state)
            if len(pending) >= RENEW and r + 1 < self.n_trees:
                done = list(pending)
                matrix.__dict__.update(matrix.advanced(lambda block: scores(block, done)).__dict__)
                pending.clear()
                if watched:
                    seen = list(ahead)
                    watched.__dict__.update(watched.advanced(lambda block: scores(block, seen)).__dict__)
                    ahead.clear()
            if not go_on:
                break
        manager.end(state)

    def _finished(self, matrix, pending, trees, r):
        return trees

    def _round(self, matrix: Matrix, pending: list, r: int, n: int, now=None) -> Round:
        """What grows the next trees. now: raw scores of a block, of the pending trees unless given."""
        now = now or (lambda block: scores(block, pending))
        gradient, seed, rate = self._gradient(), self.random_state, self.subsample
        goss = self._goss_cut(matrix, now, r, n)

        def weighted(block: Block):
            g, h = gradient(block, now(block))
            w = block.columns["w"]
            if goss:
                w = w * goss(block, g)
            elif rate < 1:
                # Rows that are not drawn weigh nothing, but are still routed and predicted.
                w = w * (uniform(block.ids, seed, r, 1) < rate)
            return g * w, h * w

        allowed = None
        if self.colsample_bytree < 1:
            p = len(self.features_)
            rng = np.random.default_rng([seed & 0xFFFFFFFF, r])
            allowed = []
            for _ in range(self._outputs()):
                mask = np.zeros(p, bool)
                mask[rng.choice(p, max(1, int(p * self.colsample_bytree)), replace=False)] = True
                allowed.append(mask)
        return Round(matrix, weighted, self._config(), self._outputs(), allowed)

    def _goss_cut(self, matrix, now, r, n):
        """None, or a function (block, gradient) -> the factor of each row's weight: 1 for the int(n * top_rate) rows of
        largest |gradient| (one at least), the configured one for int(rest * other_rate) of the rest, 0 for the others.
        Ties, and the rest, go by seeded hash."""
        if getattr(self, "subsample_strategy", "none") != "goss":
            return None
        config = GOSSConfig(self.goss_top_rate, self.goss_other_rate, self.random_state, self.goss_correction)
        gradient, seed = self._gradient(), self.random_state
        top = max(1, int(n * config.top_rate))
        rest = int((n - top) * config.other_rate)

        def size(g):
            """Large gradients first: the bits of a float sort as it does."""
            return ~np.abs(g).sum(0).astype(np.float32).view(np.uint32)

        def drawn(block, k):
            return (uniform(block.ids, seed, r, k) * 2.0**32).astype(np.uint32)

        cut, wanted, there = smallest(matrix, lambda block: size(gradient(block, now(block))[0]), top)
        last = None
        if wanted < there:
            tied = lambda block: drawn(block, 3)[size(gradient(block, now(block))[0]) == cut]
            last = smallest(matrix, tied, wanted)[0]

        def first(block, g):
            key = size(g)
            return key <= cut if last is None else (key < cut) | ((key == cut) & (drawn(block, 3) <= last))

        other = smallest(matrix, lambda block: drawn(block, 2)[~first(block, gradient(block, now(block))[0])], rest)[0] if rest else None

        def factor(block, g):
            own = first(block, g)
            more = drawn(block, 2) <= other if other is not None else np.zeros(len(own), bool)
            return np.where(own, 1.0, np.where(more, config.weight, 0.0))

        return factor

    def _loss(self, matrix: Matrix, pending: list) -> float:
        value, now = self._monitored(), list(pending)

        def work(block):
            w = block.columns["w"]
            yield "sum", np.array([(value(block, scores(block, now)) * w).sum(), w.sum()])

        total = matrix.sums(work, {"sum": (2,)})["sum"]
        return float(total[0] / total[1]) if total[1] else math.nan

    # -- scoring --
    def _raw_column(self, df: DataFrame, rounds: int | None = None) -> Column:
        """Raw scores as an array column, by a vectorised function over the feature columns."""
        check_is_fitted(self)
        self.binner_.check(df)
        binner, score, k = self.binner_, self._scorer(rounds), self._outputs()

        @F.pandas_udf("array<double>")
        def raw(*columns: pd.Series) -> pd.Series:
            bins = binner.bins([c.to_numpy() for c in columns])
            return pd.Series(list(score(bins, columns).T.reshape(-1, k)))

        out = raw(*(F.col(f"`{f}`") if f in binner.categories else F.col(f"`{f}`").cast("double") for f in binner.features))
        if self.exposure_:
            if self.exposure_ not in df.columns:
                raise ValidationError(f"the model was trained with an exposure; {self.exposure_!r} is missing")
            out = self._with_exposure(out, F.ln(F.col(f"`{self.exposure_}`")))
        return out

    def _with_exposure(self, raw: Column, offset: Column) -> Column:
        return F.transform(raw, lambda v: v + offset)

    def _scorer(self, rounds: int | None = None):
        trees, base = self.trees_, self.base_
        return lambda bins, columns: trees.raw(bins, base, rounds)

    def predict_raw(self, df: DataFrame, output: str = "raw") -> DataFrame:
        return df.withColumn(output, self._raw_column(df))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """df with the raw score of the one output."""
        return df.withColumn(output, self._raw_column(df)[0])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.predict(df)

    def expression(self, df: DataFrame) -> Column:
        """The raw score of the first output as Spark functions alone, for small ensembles and for SQL engines."""
        check_is_fitted(self)
        bins = [self.binner_.column(df, f) for f in self.binner_.features]
        out = F.lit(float(self.base_[0]))
        for rate, trees in zip(self.trees_.rates, self.trees_.rounds, strict=True):
            out = out + F.lit(float(rate)) * trees[0].expression(bins)
        return out

    # -- files --
    def _meta(self) -> dict:
        plain = {k: v for k, v in self.get_params().items() if isinstance(v, (int, float, str, bool, list, tuple, dict, type(None)))}
        return {"class": type(self).__name__, "params": plain, "features": self.features_, "label": self.label_, "exposure": self.exposure_, "base": [float(x) for x in self.base_], "rates": [float(x) for x in self.trees_.rates], "binner": self.binner_.to_dict(), "extra": self._extra()}

    def _extra(self) -> dict:
        return {}

    def _load_extra(self, extra: dict) -> None: ...

    def save(self, path: str, overwrite: bool = False) -> None:
        check_is_fitted(self)
        save_model(self.spark_, path, self._meta(), self.trees_.rounds, overwrite)

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        """A model from its folder; of a subclass, whichever it was saved as."""
        meta, rounds = load_model(spark, path)
        kinds = {}

        def known(c):
            kinds[c.__name__] = c
            for s in c.__subclasses__():
                known(s)

        known(TreeModel)
        kind = kinds.get(meta["class"])
        if kind is None or not issubclass(kind, cls):
            raise ValidationError(f"{path} holds a {meta['class']}, not a {cls.__name__}")
        model = kind(**{k: v for k, v in meta["params"].items() if k in kind.defaults()})
        model.spark_, model.features_, model.label_, model.exposure_ = spark, meta["features"], meta["label"], meta["exposure"]
        model.base_, model.binner_ = np.array(meta["base"]), Binner.from_dict(meta["binner"])
        model.trees_ = FittedTrees(rounds, meta["rates"])
        model._load_extra(meta["extra"])
        return model


class GradientBoosting(TreeModel):
    """Boosted trees on a scalar loss.

    loss: a name (mse, logloss, huber, mae, quantile, poisson, gamma, tweedie), a registered one or a function
    (prediction, label) -> (gradient, hessian). loss_params: delta, alpha or rho.
    """

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | dict(loss="mse", loss_params=None, subsample_strategy="none", goss_top_rate=0.2, goss_other_rate=0.1, goss_correction="published")

    @property
    def task(self):
        return {"logloss": "binary"}.get(self._loss_of().name, "regression")

    def _loss_of(self):
        return get_loss(self.loss, **(self.loss_params or {}))

    def _base(self, df, label, weight):
        """Log-odds of the clipped mean for log losses, else the plain mean; weights do not count."""
        mean = float(df.agg(F.avg(F.col(f"`{label}`").cast("double"))).first()[0])
        if self._loss_of().name in LOG_LOSSES:
            p = min(max(mean, 1e-7), 1 - 1e-7)
            return math.log(p / (1 - p))
        return mean

    def _gradient(self):
        loss = self._loss_of()

        def gradient(block, raw):
            g, h = loss(raw[0], block.columns["y"])
            return np.asarray(g, float)[None], np.broadcast_to(np.asarray(h, float), raw[0].shape)[None]

        return gradient

    def _monitored(self):
        loss = self._loss_of()
        return lambda block, raw: loss.monitored(raw[0], block.columns["y"])

    def predict_proba(self, df: DataFrame, output: str = "probability") -> DataFrame:
        """df with the probability of class 1; log losses only."""
        if self._loss_of().name not in LOG_LOSSES:
            raise ValidationError("probabilities need a log loss")
        return df.withColumn(output, sigmoid(self._raw_column(df)[0]))

    def predict_label(self, df: DataFrame, threshold: float = 0.5, output: str = "prediction") -> DataFrame:
        return self.predict_proba(df, "_p").withColumn(output, (F.col("_p") >= threshold).cast("int")).drop("_p")


class MultiClassGradientBoosting(TreeModel):
    """A tree for each class a round, on softmax gradients; raw scores start at 0. Labels are 0 .. n_classes - 1."""

    task = "multiclass"

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | dict(n_classes=2, subsample_strategy="none", goss_top_rate=0.2, goss_other_rate=0.1, goss_correction="published")

    def _outputs(self):
        return self.n_classes

    def _base(self, df, label, weight):
        return 0.0

    def _gradient(self):
        k = self.n_classes

        def gradient(block, raw):
            p = softmax_arrays(raw)
            hot = np.arange(k)[:, None] == block.columns["y"][None, :]
            return p - hot, np.maximum(p * (1 - p), 1e-6)

        return gradient

    def _monitored(self):
        return lambda block, raw: -np.log(np.maximum(softmax_arrays(raw)[block.columns["y"].astype(int), np.arange(block.n)], 1e-15))

    def predict_proba(self, df: DataFrame, output: str = "probability") -> DataFrame:
        return df.withColumn("_raw", self._raw_column(df)).withColumn(output, softmax_columns(F.col("_raw"))).drop("_raw")

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """The class of the largest score, the first of equal ones."""
        return df.withColumn("_raw", self._raw_column(df)).withColumn(output, (F.array_position("_raw", F.array_max("_raw")) - 1).cast("int")).drop("_raw")


class DART(GradientBoosting):
    """Boosting with dropout: each round leaves out some earlier trees, and the new tree shares their weight.

    normalize: "stored" keeps the weights k / (k + 1) and 1 / (k + 1) in the trees; "reference" uses them while training
    and predicts with all weights at 1; None leaves weights alone. skip_drop: chance that a round drops nothing.
    """

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | dict(dropout_rate=0.1, skip_drop=0.0, normalize="stored", sample_type="uniform")

    def _train(self, matrix, watched, manager, n):
        state = TrainingState(self, n_rounds=self.n_trees)
        manager.begin(state)
        strategy = get_growth_strategy(self.growth)
        rng = np.random.default_rng(self.random_state)
        weights = self.weights_ = []
        for r in range(self.n_trees):
            state.round_idx, self.round_rate_ = r, self.learning_rate
            manager.round_begin(state)
            dropped = self._dropped(rng, len(weights))
            rounds = self.trees_.rounds
            kept = [(self.trees_.rates[i] * weights[i], rounds[i]) for i in range(r) if i not in dropped]
            rounds.append(strategy.grow(self._round(matrix, kept, r, n)))
            self.trees_.rates.append(self.round_rate_)
            k = len(dropped)
            weights.append(1.0)
            if k and self.normalize:
                weights[-1] = 1 / (k + 1)
                for i in dropped:
                    weights[i] *= k / (k + 1)
            if manager.needs_loss:
                now = [(a * w, t) for a, w, t in zip(self.trees_.rates, weights, rounds, strict=True)]
                state.train_loss = self._loss(matrix, now)
                state.val_loss = self._loss(watched, now) if watched else None
            if not manager.round_end(state):
                break
        manager.end(state)
        if self.normalize == "stored":
            self.trees_.rates = [a * w for a, w in zip(self.trees_.rates, self.weights_, strict=True)]

    def state(self):
        return self.trees_, self.weights_

    def restore(self, kept):
        """Later rounds have scaled the weights of earlier trees: those of the best round come back with its trees."""
        self.trees_, self.weights_ = kept

    def _dropped(self, rng, n: int) -> set[int]:
        if not n or rng.random() < self.skip_drop:
            return set()
        return set(rng.choice(n, min(n, max(1, int(n * self.dropout_rate))), replace=False).tolist())
