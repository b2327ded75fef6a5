"""Feature importance from the nodes of an ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.persistence import tree_table

KINDS = ("frequency", "gain", "cover")


def importance_table(model, kind: str = "frequency", normalize: bool = True, top_n: int | None = None) -> DataFrame:
    """(feature, importance), the largest first: number of splits, their gains, or the hessian of their rows."""
    if kind not in KINDS:
        raise ValueError(f"unknown importance {kind!r}; known: {', '.join(KINDS)}")
    nodes = tree_table(model.spark_, model.trees_.rounds).filter("feature >= 0")
    value = {"frequency": F.count("*").cast("double"), "gain": F.sum("gain"), "cover": F.sum("cover")}[kind]
    own = nodes.groupBy("feature").agg(value.alias("importance"))
    names = model.spark_.createDataFrame(list(enumerate(model.features_)), "feature int, name string")
    out = names.join(own, "feature", "left").select(F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))
    if normalize:
        total = out.agg(F.sum("importance")).first()[0] or 0.0
        out = out.withColumn("importance", F.col("importance") / total if total else F.lit(0.0))
    out = out.orderBy(F.desc("importance"), "feature")
    return out.limit(top_n) if top_n else out


def compute_feature_importances(model, kind: str = "frequency", normalize: bool = True) -> dict[str, float]:
    return {r[0]: r[1] for r in importance_table(model, kind, normalize).collect()}


def plot_feature_importances(model, kind: str = "frequency", top_n: int = 20, ax=None):
    """A bar chart, where matplotlib is installed."""
    import matplotlib.pyplot as plt

    rows = importance_table(model, kind, True, top_n).collect()
    ax = ax or plt.gca()
    ax.barh([r[0] for r in rows][::-1], [r[1] for r in rows][::-1])
    ax.set_xlabel(kind)
    return ax
