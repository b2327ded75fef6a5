"""Quantiles that hold at any number of rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many rows one aggregate gives exact quantiles: Spark's exact percentile gathers a column's different values.
EXACT_ROWS = 1_000_000
#: Accuracy of the mergeable sketch beyond: ranks are off by one in so many rows at most.
ACCURACY = 20_000
#: Parts that kth_smallest() cuts the range of values into on each pass.
PARTS = 4096


def quantile(value: Column, points, rows: int, accuracy: int | None = None) -> Column:
    """Aggregate: quantiles of a column by linear interpolation, exact up to EXACT_ROWS rows, else by a sketch that gives
    values of the column. accuracy: of the sketch whatever the rows; 0: exact whatever the rows."""
    exact = rows <= EXACT_ROWS if accuracy is None else not accuracy
    return F.percentile(value, points) if exact else F.percentile_approx(value, points, accuracy or ACCURACY)


def exact_quantiles(df: DataFrame, values: list[Column], points: list[float]) -> list[list[float]]:
    """Quantiles of several numeric columns by linear interpolation, exact at any number of rows; nulls are left out, and
    a column without values gives [].

    A sketch brackets each rank between two values. One pass then counts the rows between the brackets, and the rows of
    each different value within them. A rank that the sketch missed is looked for again between the brackets beside it.
    """
    rows = df.select(*(v.cast("double").alias(f"v{i}") for i, v in enumerate(values)))
    sizes, brackets = _brackets(rows, points)
    at = [[p * (n - 1) for p in points] if n else [] for n in sizes]
    todo = {(i, k) for i, places in enumerate(at) for x in places for k in (math.floor(x), math.ceil(x))}
    found: dict = {}
    while todo:
        hits, brackets = _ranked(rows, brackets, todo)
        found |= hits
        todo -= hits.keys()

    def between(i: int, x: float) -> float:
        lo, hi = math.floor(x), math.ceil(x)
        a, b = found[i, lo], found[i, hi]
        return a if a == b else (hi - x) * a + (x - lo) * b

    return [[between(i, x) for x in places] for i, places in enumerate(at)]


def _brackets(rows: DataFrame, points: list[float]) -> tuple[list[int], list]:
    """Of each column: its size, and sorted lows and highs of the brackets that its quantiles lie in."""
    far = 2 / ACCURACY
    ends = [max(0.0, p - far) for p in points] + [min(1.0, p + far) for p in points]
    row = rows.agg(*(F.count(c) for c in rows.columns), *(F.percentile_approx(c, ends, ACCURACY) for c in rows.columns)).first()
    m = len(rows.columns)
    return list(row[:m]), [(np.sort(e[: len(points)]), np.sort(e[len(points) :])) for e in (np.array(x or [], float) for x in row[m:])]


def _counts(brackets: list):
    """For mapInArrow: (feature, part, value, n). Part 2j + 1 is bracket j, whose values are told apart; the others lie
    below, between and above the brackets and have no value. A value in several brackets belongs to the last."""

    def batch_of(feature, part, value, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), feature), pa.int32()), pa.array(part, pa.int32()), pa.array(value, pa.float64(), from_pandas=True), pa.array(n, pa.int64())], ["feature", "part", "value", "n"])

    def work(batches):
        beside = [np.zeros(len(lows) + 1, np.int64) for lows, _ in brackets]
        for batch in batches:
            for i, (lows, highs) in enumerate(brackets):
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                at = np.searchsorted(lows, x, "right")
                inside = x <= np.append(np.nan, highs)[at]
                beside[i] += np.bincount(at[~inside], minlength=len(lows) + 1)
                value, n = np.unique(x[inside], return_counts=True)
                if len(n):
                    yield batch_of(i, 2 * np.searchsorted(lows, value, "right") - 1, value, n)
        for i, n in enumerate(beside):
            yield batch_of(i, 2 * np.arange(len(n)), np.full(len(n), np.nan), n)

    return work


def _ranked(rows: DataFrame, brackets: list, todo: set) -> tuple[dict, list]:
    """The values at those (column, rank from 0) that lie in brackets, and brackets for the others."""
    counts = rows.mapInArrow(_counts(brackets), "feature int, part int, value double, n long")
    counts = counts.groupBy("feature", "part", "value").agg(F.sum("n").alias("n")).persist()
    try:
        sizes = [np.zeros(2 * len(lows) + 1, np.int64) for lows, _ in brackets]
        for r in counts.groupBy("feature", "part").agg(F.sum("n").alias("n")).collect():  # a row a bracket
            sizes[r["feature"]][r["part"]] = r["n"]
        upto = [np.cumsum(s) for s in sizes]
        inside, wider = [], [set() for _ in brackets]
        for i, k in sorted(todo):
            part = int(np.searchsorted(upto[i], k, "right"))
            if part % 2:
                inside.append((i, part, k, int(k - (upto[i][part] - sizes[i][part]))))
            else:
                lows, highs = brackets[i]
                wider[i].add((float(highs[part // 2 - 1]) if part else -math.inf, float(lows[part // 2]) if part // 2 < len(lows) else math.inf))
        hits = {}
        if inside:
            wanted = rows.sparkSession.createDataFrame(inside, "feature int, part int, rank long, place long")
            last = F.sum("n").over(Window.partitionBy("feature", "part").orderBy("value"))
            ranked = counts.filter("part % 2 = 1").withColumn("last", last).join(F.broadcast(wanted), ["feature", "part"])
            hits = {(r["feature"], r["rank"]): r["value"] for r in ranked.filter("place < last and place >= last - n").collect()}
    finally:
        counts.unpersist()
    return hits, [tuple(np.array(x, float) for x in zip(*sorted(w))) if w else (np.array([]), np.array([])) for w in wider]


def kth_smallest(df: DataFrame, value: Column, k: int) -> float | None:
    """The k-th smallest (from 1) of a numeric column, exactly, whatever its distribution: each pass counts the values in
    PARTS parts of the range that is left and goes on in the part that holds it."""
    rows = df.select(value.cast("double").alias("v")).filter("v is not null")
    lo, hi = rows.agg(F.min("v"), F.max("v")).first()
    while lo is not None and lo < hi:
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * PARTS))
        counts = rows.filter(F.col("v").between(lo, hi)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in sorted(counts.collect(), key=lambda r: r["part"]):  # PARTS rows at most
            lo, hi = r["lo"], r["hi"]
            if k <= r["n"]:
                break
            k -= r["n"]
    return lo
