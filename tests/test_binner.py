import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.sources.binner import Binner
from coppice.sources.persistence import read_binned, write_binned


def bins(df, binner):
    return [list(r) for r in binner.transform(df.orderBy("id")).collect()]


def test_quantile_bins_match_numpy(spark):
    x = np.random.RandomState(42).randn(200)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, x double")
    binner = Binner.fit(df, ["x"], 16)
    edges = np.unique(np.percentile(x, np.linspace(0, 100, 17)[1:-1]))
    assert np.allclose(binner.edges["x"], edges)
    expected = np.minimum(np.searchsorted(edges, x, "right"), len(edges) - 1)
    assert [b[0] for b in bins(df, binner)] == expected.tolist()
    assert binner.bins([x])[0].tolist() == expected.tolist()


def test_missing_constant_and_out_of_range(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, None, 5.0), (2, float("nan"), 5.0), (3, 3.0, 5.0)], "id int, x double, c double")
    binner = Binner.fit(df, ["x", "c"])
    out = bins(df, binner)
    assert [b[0] for b in out][1:3] == [255, 255] and {b[1] for b in out} == {0}
    assert binner.has_missing == {"x": True, "c": False}
    far = spark.createDataFrame([(0, -10.0, 0.0), (1, 10.0, 9.0)], "id int, x double, c double")
    low, high = bins(far, binner)
    assert low[0] == 0 and high[0] == len(binner.edges["x"]) - 1


def test_categories_and_unseen(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, ""), (3, None), (4, "b")], "id int, s string")
    binner = Binner.fit(df, ["s"])
    assert binner.categories["s"] == ["a", "b"]
    assert [b[0] for b in bins(df, binner)] == [1, 0, 255, 255, 1]
    assert [b[0] for b in bins(spark.createDataFrame([(0, "z")], "id int, s string"), binner)] == [255]


def test_too_many_categories_and_bins(spark):
    df = spark.range(600).withColumn("s", F.col("id").cast("string"))
    with pytest.raises(ValueError, match="categories"):
        Binner.fit(df, ["s"])
    with pytest.warns(UserWarning):
        Binner.fit(df, ["id"], 300)


def test_binned_files(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 1.5)
    binner = Binner.fit(df, ["x"], 8)
    write_binned(df, binner, str(tmp_path / "m"), ["id"])
    rows, again = read_binned(spark, str(tmp_path / "m"))
    assert again.edges == binner.edges and rows.count() == 50 and rows.columns == ["id", "b0"]


def test_empty_feature(spark):
    df = spark.createDataFrame([(0, None), (1, None)], "id int, x double")
    binner = Binner.fit(df, ["x"])
    assert [b[0] for b in bins(df, binner)] == [255, 255]
