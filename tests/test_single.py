import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.operators import relational as R
from coppice.plans.single import batched_histogram, fit_tree


def test_single_tree_and_batched_histogram(spark):
    df = spark.range(300).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), F.when(F.col("id") < 100, -1.0).otherwise(0.5).alias("g"), F.lit(1.0).alias("h"))
    fitted = fit_tree(df, ["x", "z"], "g", "h", max_depth=1, n_bins=64)
    assert fitted.tree.feature[0] == 0 and fitted.tree.n_leaves == 2
    got = fitted.predict(df).select("prediction", fitted.leaf(df).alias("leaf")).distinct().collect()
    assert len(got) == 2
    hist = batched_histogram(df, ["x", "z"], "g", "h", fitted.binner)
    rows = R.build_histogram(fitted.binner.transform(df, ["g", "h"]), ["b0", "b1"]).collect()
    for r in rows:
        assert tuple(hist[r["feature"], r["bin"]]) == pytest.approx((r["g"], r["h"], r["n"]))
    assert hist[0].sum(0)[2] == 300 and np.isclose(hist[1].sum(0)[0], 0.0 + 200 * 0.5 - 100)
    half = fit_tree(df, ["x", "z"], "g", "h", max_depth=2, subsample=0.5, colsample_bytree=0.5, seed=3)
    assert 80 < half.tree.cover[0] < 220
