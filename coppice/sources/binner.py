"""Quantile and category binning: raw feature columns to bin numbers 0..254, with 255 for missing values."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import EXACT_ROWS, exact_quantiles, quantile

MISSING = 255
MOST_BINS = 254


def is_missing(df: DataFrame, name: str) -> Column:
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    if isinstance(kind, T.StringType):
        return c.isNull() | c.isin("", "nan")
    return c.isNull()


@dataclass
class Binner:
    """Fitted bins of named features.

    edges: of numeric features, sorted quantile edges; a value's bin is the number of edges at or below it, at most the
    last edge's index. categories: of categorical features, sorted values; a value's bin is its index, 255 if unseen.
    """

    features: list[str]
    edges: dict[str, list[float]] = field(default_factory=dict)
    categories: dict[str, list] = field(default_factory=dict)
    has_missing: dict[str, bool] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], n_bins: int = MOST_BINS, categorical: list[str] = (), approximate: int | None = None) -> Binner:
        """String columns are categorical. Numeric quantiles are exact: of tables of up to EXACT_ROWS rows all come from one
        aggregate, of larger ones from exact_quantiles(). approximate: from a mergeable sketch of that accuracy instead."""
        if n_bins > MOST_BINS:
            warnings.warn(f"n_bins={n_bins} is above {MOST_BINS}, which is used", stacklevel=2)
        n_bins = max(2, min(n_bins, MOST_BINS))
        absent = [f for f in features if f not in df.columns]
        if absent or not features:
            raise ValueError(f"no such feature: {absent}" if absent else "no features")
        out = cls(list(features))
        points = [float(q) for q in np.linspace(0, 1, n_bins + 1)[1:-1]]
        text = [f for f in features if isinstance(df.schema[f].dataType, (T.StringType, T.BooleanType))]
        grouped = [f for f in features if f in set(categorical) | set(text)]
        large = not approximate and df.count() > EXACT_ROWS
        apart = [f for f in features if f not in grouped] if large else []
        values = {f: F.when(~is_missing(df, f), F.col(f"`{f}`").cast("double")) for f in features if f not in grouped}
        sums = [F.max(is_missing(df, f)).alias(f"m{i}") for i, f in enumerate(features)]
        for i, f in enumerate(features):
            if f in grouped:
                sums.append(F.array_sort(F.collect_set(F.when(~is_missing(df, f), F.col(f"`{f}`")))).alias(f"v{i}"))
            elif not large:
                sums.append(quantile(values[f], points, 0, approximate).alias(f"v{i}"))
        # A feature of too many categories would make its set large: counted first, without keeping the values.
        if grouped:
            counts = df.agg(*(F.approx_count_distinct(f"`{f}`").alias(f"c{i}") for i, f in enumerate(grouped))).first()
            for f, n in zip(grouped, counts, strict=True):
                if n > 4 * MOST_BINS:
                    raise ValueError(f"{f} has about {n} categories; at most {MOST_BINS} are allowed")
        row = df.agg(*sums).first()
        exact = dict(zip(apart, exact_quantiles(df, [values[f] for f in apart], points), strict=True)) if apart else {}
        for i, f in enumerate(features):
            out.has_missing[f] = bool(row[f"m{i}"])
            if f in grouped:
                if len(row[f"v{i}"]) > MOST_BINS:
                    raise ValueError(f"{f} has {len(row[f'v{i}'])} categories; at most {MOST_BINS} are allowed")
                out.categories[f] = list(row[f"v{i}"])
            else:
                out.edges[f] = [float(x) for x in np.unique((exact[f] if large else row[f"v{i}"]) or [])]
        return out

    def column(self, df: DataFrame, name: str) -> Column:
        """The bin of a feature, as an expression of Spark functions."""
        c = F.col(f"`{name}`")
        if name in self.categories:
            known = self.categories[name]
            if not known:
                return F.lit(MISSING).cast("short")
            lookup = F.create_map(*(x for i, v in enumerate(known) for x in (F.lit(v), F.lit(i))))
            found = F.when(~is_missing(df, name), F.element_at(lookup, c))
            return F.coalesce(found, F.lit(MISSING)).cast("short")
        edges = self.edges[name]
        if not edges:
            return F.when(is_missing(df, name), MISSING).otherwise(0).cast("short")
        value, last = c.cast("double"), len(edges) - 1

        def below(lo: int, hi: int) -> Column:
            """The number of edges at or below the value, between lo and hi: nested comparisons, by halves."""
            if lo == hi:
                return F.lit(min(lo, last))
            mid = (lo + hi) // 2
            return F.when(value < edges[mid], below(lo, mid)).otherwise(below(mid + 1, hi))

        return F.when(is_missing(df, name), MISSING).otherwise(below(0, len(edges))).cast("short")

    def transform(self, df: DataFrame, keep: list = ()) -> DataFrame:
        """keep, then b0, b1, ...: the bins of the features in order."""
        self.check(df)
        return df.select(*keep, *(self.column(df, f).alias(f"b{i}") for i, f in enumerate(self.features)))

    def check(self, df: DataFrame) -> None:
        absent = [f for f in self.features if f not in df.columns]
        if absent:
            raise ValueError(f"missing features: {absent}")
        odd = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
        wrong = [f for f in self.features if isinstance(df.schema[f].dataType, odd if f in self.categories else (*odd, T.StringType))]
        if wrong:
            raise ValueError(f"features of another type than in training: {wrong}")

    def bins(self, columns: list) -> np.ndarray:
        """The same bins on arrays: one pyarrow or numpy column per feature -> uint8 (features, rows)."""
        n = len(columns[0]) if columns else 0
        out = np.full((len(self.features), n), MISSING, np.uint8)
        for i, (f, c) in enumerate(zip(self.features, columns, strict=True)):
            if f in self.categories:
                values = c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, from_pandas=True)
                found = pc.index_in(values, pa.array(self.categories[f], values.type)) if self.categories[f] and not pa.types.is_null(values.type) else None
                if found is not None:
                    out[i] = pc.fill_null(found, MISSING).to_numpy(zero_copy_only=False) if isinstance(found, pa.Array) else pc.fill_null(found, MISSING).to_numpy()
            else:
                x = np.asarray(c.to_numpy(zero_copy_only=False) if hasattr(c, "to_pylist") else c, dtype=np.float64)
                edges = np.asarray(self.edges[f])
                bins = np.minimum(np.searchsorted(edges, x, "right"), max(0, len(edges) - 1))
                out[i] = np.where(np.isnan(x), MISSING, bins)
        return out

    def n_categories(self) -> list[int]:
        """Of each feature: its number of categories, 0 if numeric."""
        return [len(self.categories[f]) if f in self.categories else 0 for f in self.features]

    def to_dict(self) -> dict:
        return {"features": self.features, "edges": self.edges, "categories": self.categories, "has_missing": self.has_missing}

    @classmethod
    def from_dict(cls, d: dict) -> Binner:
        return cls(**d)
