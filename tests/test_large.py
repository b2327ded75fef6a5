"""Tables of more rows than one exact aggregate takes: quantiles stay exact, and queries equal their SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.functions import quantiles
from coppice.queries import ORACLES, QUERIES
from coppice.sources.binner import Binner

ROWS = 1_100_000


def mixed(factor: int, size: int):
    """Values in 0..size - 1, nearly all different, in no order of the ids."""
    return F.pmod(F.col("id") * factor, F.lit(size)).cast("double")


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """lineitem and events; the gradients 25 - price / 1000 are eighths, so that their sums are exact."""
    folder = tmp_path_factory.mktemp("large")
    ids = spark.range(ROWS, numPartitions=5)
    flags = [F.element_at(F.array(*map(F.lit, "ANR")), (F.col("id") % 3 + 1).cast("int")).alias("l_returnflag"), F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("l_linestatus")]
    numbers = [(mixed(7919, 1000003) / 100).alias("l_quantity"), (mixed(104729, 999983) / 64).alias("l_discount"), (F.col("id") % 9 / 100).alias("l_tax")]
    ids.select(F.col("id").alias("l_orderkey"), *numbers, (125.0 * (F.col("id") % 800)).alias("l_extendedprice"), *flags).write.parquet(str(folder / "lineitem.parquet"))
    ids.select(F.col("id").alias("event_id"), (mixed(7919, 1000003) / 100).alias("value")).write.parquet(str(folder / "events.parquet"))
    return str(folder)


def assert_equals_sql(spark, folder: str, name: str, table: str):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLES[name]).df()
    columns = list(want.columns)
    assert sorted(got.columns) == sorted(columns)
    a, b = (x[columns].sort_values(columns).to_numpy().tolist() for x in (got, want))
    assert a == b


def test_quantiles_are_exact_at_any_number_of_rows(spark):
    df = spark.range(ROWS, numPartitions=5).select(mixed(7919, 1000003).alias("x"), F.when(F.col("id") % 10 != 0, mixed(104729, 999983)).alias("y"))
    x, y = (np.array([v for v in c if not math.isnan(v)]) for c in df.toPandas().to_numpy().T)
    binner = Binner.fit(df, ["x", "y"], 16)
    for name, values in (("x", x), ("y", y)):
        assert np.allclose(binner.edges[name], np.percentile(values, np.linspace(0, 100, 17)[1:-1]), rtol=1e-12, atol=0)
    assert binner.has_missing == {"x": False, "y": True}


def test_quantiles_of_odd_columns(spark):
    rows = [(float(i), 5.0, None, [-math.inf, -0.0, 0.0, math.inf][i % 4], 3.0 if i == 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    points = [0.1, 0.25, 0.5, 0.9]
    got = quantiles.exact_quantiles(df, [F.col(c) for c in df.columns], points)
    assert got[0] == pytest.approx(np.percentile(range(40), [10, 25, 50, 90]).tolist())
    assert got[1:] == [[5.0] * 4, [], [-math.inf, -math.inf, 0.0, math.inf], [3.0] * 4]


def test_ranks_that_the_sketch_misses_are_found(spark, monkeypatch):
    df = spark.range(1000, numPartitions=3).select((F.col("id") * 37 % 1000).cast("double").alias("v"))
    want = np.percentile(range(1000), [10, 50, 90]).tolist()
    far = [([700.0], [710.0]), ([2e9], [3e9]), ([-9.0, 499.0], [-8.0, 499.5]), ([], [])]
    for lows, highs in far:
        monkeypatch.setattr(quantiles, "_brackets", lambda rows, points, lows=lows, highs=highs: ([1000], [(np.array(lows), np.array(highs))]))
        assert quantiles.exact_quantiles(df, [F.col("v")], [0.1, 0.5, 0.9])[0] == pytest.approx(want)


def test_bin_numeric_equals_sql_on_many_rows(spark, large):
    assert_equals_sql(spark, large, "bin_numeric", "lineitem")


def test_bin_missing_equals_sql_on_many_rows(spark, large):
    assert_equals_sql(spark, large, "bin_missing", "events")


def test_hist_root_equals_sql_on_many_rows(spark, large):
    assert_equals_sql(spark, large, "hist_root", "lineitem")


def test_hist_node_equals_sql_on_many_rows(spark, large):
    assert_equals_sql(spark, large, "hist_node", "lineitem")


def test_hist_subtract_equals_sql_on_many_rows(spark, large):
    assert_equals_sql(spark, large, "hist_subtract", "lineitem")


def test_hist_subtract_rounds_once(spark, tmp_path):
    rows = [(i, float(i % 5), 0.01, 0.02, 25000.0 - 1000 * g, "A", s) for i, (g, s) in enumerate([(0.004996, "O"), (1.5, "F"), (0.25, "F"), (0.5, "O"), (0.125, "F")])]
    df = spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_discount double, l_tax double, l_extendedprice double, l_returnflag string, l_linestatus string")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert_equals_sql(spark, str(tmp_path), "hist_subtract", "lineitem")
