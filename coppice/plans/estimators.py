"""Estimators with one interface for every model: n_estimators, early stopping, class labels of any type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import accuracy_score, r2_score
from .boosting import DART, GradientBoosting, MultiClassGradientBoosting, TreeModel
from .callbacks import EarlyStopping, Logger
from .distributional import DistributionalGBDT, NaturalBoost
from .gam import AdditiveModel
from .importance import compute_feature_importances
from .linear_leaf import LinearLeafGBDT


class Estimator:
    """fit(df, features, label) -> self, predict(df) -> df with `prediction`, score(df). Parameters go to the model."""

    model_class: type = GradientBoosting
    fixed: dict = {}

    def __init__(self, n_estimators: int = 100, early_stopping_rounds: int | None = None, verbose: int = 0, **params):
        self.n_estimators, self.early_stopping_rounds, self.verbose, self.params = n_estimators, early_stopping_rounds, verbose, params
        self.model_: TreeModel | None = None

    def get_params(self) -> dict:
        return {"n_estimators": self.n_estimators, "early_stopping_rounds": self.early_stopping_rounds, "verbose": self.verbose, **self.params}

    def set_params(self, **params):
        for k, v in params.items():
            if k in ("n_estimators", "early_stopping_rounds", "verbose"):
                setattr(self, k, v)
            else:
                self.params[k] = v
        return self

    def _callbacks(self, given):
        out = list(given or [])
        if self.early_stopping_rounds:
            out.append(EarlyStopping(self.early_stopping_rounds))
        if self.verbose:
            out.append(Logger(self.verbose))
        return out

    def fit(self, df: DataFrame, features: list[str], label: str, weight: str | None = None, eval_set=None, callbacks=None, **more):
        self.label_ = label
        self.model_ = self.model_class(n_trees=self.n_estimators, **self.fixed, **self.params)
        self.model_.fit(df, features, label, weight=weight, eval_set=eval_set, callbacks=self._callbacks(callbacks), **more)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model_.predict(df)

    def score(self, df: DataFrame) -> float:
        """R squared."""
        return float(self.predict(df).agg(r2_score(F.col(self.label_).cast("double"), F.col("prediction"))).first()[0])

    @property
    def feature_importances_(self) -> dict[str, float]:
        return compute_feature_importances(self.model_)

    def save(self, path: str, overwrite: bool = False) -> None:
        self.model_.save(path, overwrite)


class Regressor(Estimator):
    pass


class DARTRegressor(Estimator):
    model_class = DART


class LinearLeafRegressor(Estimator):
    model_class = LinearLeafGBDT


class GAMRegressor(Estimator):
    model_class = AdditiveModel

    @property
    def feature_importances_(self):
        return self.model_.get_feature_importance()


class Classifier(Estimator):
    """Two classes: log loss; more: softmax. Classes are the sorted distinct labels, of any type."""

    def fit(self, df, features, label, weight=None, eval_set=None, callbacks=None, **more):
        found = [r[0] for r in df.select(F.col(label)).filter(F.col(label).isNotNull()).distinct().limit(1001).collect()]
        if not 2 <= len(found) <= 1000:
            raise ValueError(f"{len(found)} classes; from 2 to 1000 are possible")
        self.classes_, self.label_ = sorted(found), label
        sets = [eval_set] if isinstance(eval_set, DataFrame) else list(eval_set or [])
        binary = len(self.classes_) == 2
        self.model_ = self._model(binary)
        encoded = [d.withColumn("_class", self._code(d)) for d in [df, *sets]]
        self.model_.fit(encoded[0], features, "_class", weight=weight, eval_set=encoded[1:], callbacks=self._callbacks(callbacks), **more)
        return self

    def _model(self, binary: bool):
        if binary:
            return GradientBoosting(n_trees=self.n_estimators, loss="logloss", **self.params)
        return MultiClassGradientBoosting(n_classes=len(self.classes_), n_trees=self.n_estimators, **self.params)

    def _code(self, df):
        lookup = F.create_map(*(x for i, c in enumerate(self.classes_) for x in (F.lit(c), F.lit(i))))
        return F.element_at(lookup, F.col(self.label_)).cast("double")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with probability: an array in the order of classes_."""
        if len(self.classes_) > 2:
            return self.model_.predict_proba(df)
        out = self.model_.predict_proba(df, "_p")
        return out.withColumn("probability", F.array(1.0 - F.col("_p"), F.col("_p"))).drop("_p")

    def predict(self, df: DataFrame) -> DataFrame:
        names = F.array(*map(F.lit, self.classes_))
        top = F.when(F.col("probability")[1] >= 0.5, 2).otherwise(1) if len(self.classes_) == 2 else F.array_position("probability", F.array_max("probability"))
        return self.predict_proba(df).withColumn("prediction", F.element_at(names, top.cast("int"))).drop("probability")

    def score(self, df: DataFrame) -> float:
        """Accuracy."""
        return float(self.predict(df).agg(accuracy_score(F.col(self.label_), F.col("prediction"))).first()[0])


class GAMClassifier(Classifier):
    def _model(self, binary: bool):
        if not binary:
            raise ValueError("additive classifiers take two classes")
        return AdditiveModel(n_trees=self.n_estimators, loss="logloss", **self.params)


class DistributionalRegressor(Estimator):
    """use_natural_gradient picks NaturalBoost; score is the mean negative log-likelihood, the lower the better."""

    def __init__(self, distribution: str = "normal", use_natural_gradient: bool = True, **params):
        super().__init__(**params)
        self.distribution, self.use_natural_gradient = distribution, use_natural_gradient
        self.model_class = NaturalBoost if use_natural_gradient else DistributionalGBDT
        self.fixed = {"distribution": distribution}

    def predict_interval(self, df: DataFrame, alpha: float = 0.1) -> DataFrame:
        return self.model_.predict_interval(df, alpha)

    def predict_quantile(self, df: DataFrame, q: float) -> DataFrame:
        return self.model_.predict_quantile(df, q)

    def sample(self, df: DataFrame, n_samples: int = 1, seed: int = 0) -> DataFrame:
        return self.model_.sample(df, n_samples, seed)

    def score(self, df: DataFrame) -> float:
        return self.model_.nll(df)
