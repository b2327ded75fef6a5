"""Row sampling: by seeded hash of the row's id, so that reruns and retried tasks agree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import kth_smallest


class SamplingStrategy(Enum):
    NONE = "none"
    RANDOM = "random"
    GOSS = "goss"


@dataclass(frozen=True)
class GOSSConfig:
    """Keep the top_rate rows of largest |gradient| and other_rate of the rest. correction: (1 - a) / b as published
    with the part drawn from the rest, or 1 / b, which makes that part stand for all of the rest."""

    top_rate: float = 0.2
    other_rate: float = 0.1
    seed: int = 0
    correction: str = "published"

    def __post_init__(self):
        if not (0 < self.top_rate <= 1 and 0 <= self.other_rate <= 1 and self.top_rate + self.other_rate <= 1):
            raise ValueError("rates must lie in 0..1 and add up to 1 at most")

    @property
    def effective_sample_rate(self) -> float:
        return self.top_rate + self.other_rate * (1 - self.top_rate)

    @property
    def weight(self) -> float:
        if not self.other_rate:
            return 0.0
        return (1.0 if self.correction == "unbiased" else 1 - self.top_rate) / self.other_rate


@dataclass(frozen=True)
class MiniBatchConfig:
    batch_size: int = 100_000
    shuffle: bool = False
    seed: int = 0


def batches_of(n: int, config: MiniBatchConfig) -> Iterator[np.ndarray]:
    """Index batches of n rows, the last one shorter; shuffled by the seed if asked for."""
    order = np.random.default_rng(config.seed).permutation(n) if config.shuffle else np.arange(n)
    for lo in range(0, n, config.batch_size):
        yield order[lo : lo + config.batch_size]


def uniform(ids: np.ndarray, *seed: int) -> np.ndarray:
    """A number in 0..1 for each id, fixed by id and seed."""
    x = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for s in seed:
            x = (x ^ np.uint64(s & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            x = x ^ (x >> np.uint64(29))
    return (x >> np.uint64(11)) / float(1 << 53)


#: Hash ranges that the rows of a label are numbered in.
FOLD_RANGES = 4096


def random_sample(df: DataFrame, id_col: str, rate: float, seed: int = 0) -> DataFrame:
    """max(1, int(n * rate)) rows exactly, those of the smallest seeded hash. A total order is only taken of the rows
    near the cut: the others are told apart by their hash alone."""
    n = df.count()
    if not n:
        return df
    keep = max(1, int(n * rate))
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40))
    near = int((1 << 40) * min(1.0, (keep + 6 * (keep**0.5) + 10) / n))
    return df.withColumn("_u", u).filter(F.col("_u") < near).orderBy("_u", id_col).limit(keep).drop("_u")


def goss_sample(df: DataFrame, grad: str, id_col: str, config: GOSSConfig) -> DataFrame:
    """df with a column goss_weight: int(n * top_rate) rows of largest |gradient| at weight 1 and int(rest * other_rate)
    of the rest, by seeded hash, at the configured weight; other rows are left out. Ties go by id.

    Only the cuts are global: each is found by counting passes over one column and settled among its ties.
    """
    n = df.count()
    top = int(n * config.top_rate)
    rest = int((n - top) * config.other_rate)
    size = F.abs(F.col(grad))
    ranked = _cut(df.withColumn("_size", -size), "_size", id_col, top, "_top")
    others = _cut(ranked.withColumn("_u", F.when(~F.col("_top"), F.pmod(F.xxhash64(F.col(id_col), F.lit(config.seed)), F.lit(1 << 52)).cast("double"))), "_u", id_col, rest, "_rest")
    weight = F.when(F.col("_top"), 1.0).when(F.col("_rest"), config.weight)
    return others.withColumn("goss_weight", weight).filter("goss_weight is not null").drop("_size", "_top", "_u", "_rest")


def _cut(df: DataFrame, key: str, id_col: str, keep: int, flag: str) -> DataFrame:
    """flag: whether a row is among the `keep` smallest by (key, id)."""
    n = df.filter(F.col(key).isNotNull()).count()
    if keep <= 0 or not n:
        return df.withColumn(flag, F.lit(False))
    if keep >= n:
        return df.withColumn(flag, F.col(key).isNotNull())
    cut = kth_smallest(df, F.col(key), keep)
    below = df.filter(F.col(key) < cut).count()
    ties = df.filter(F.col(key) == cut)
    equal = ties.count()
    last = None if equal == keep - below else ties.select(id_col).orderBy(id_col).limit(keep - below).agg(F.max(id_col)).first()[0]
    if equal == keep - below:
        return df.withColumn(flag, F.coalesce(F.col(key) <= cut, F.lit(False)))
    own = F.col(key) < cut if last is None else (F.col(key) < cut) | ((F.col(key) == cut) & (F.col(id_col) <= F.lit(last)))
    return df.withColumn(flag, F.coalesce(own, F.lit(False)))


def apply_sampling(df: DataFrame, strategy: str | SamplingStrategy, *, grad: str, hess: str, id_col: str, rate: float = 1.0, goss: GOSSConfig | None = None, seed: int = 0) -> DataFrame:
    """df under a strategy, with grad and hess weighted."""
    strategy = SamplingStrategy(strategy)
    if strategy is SamplingStrategy.NONE:
        return df
    if strategy is SamplingStrategy.RANDOM:
        return random_sample(df, id_col, rate, seed)
    out = goss_sample(df, grad, id_col, goss or GOSSConfig(seed=seed))
    return out.withColumns({grad: F.col(grad) * F.col("goss_weight"), hess: F.col(hess) * F.col("goss_weight")}).drop("goss_weight")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """df with a column fold 0..k-1: of the rows of a label, fold f has those numbered f, f + k, f + 2k and so on in the
    order of a seeded hash. They are numbered within (label, hash range) first, then ranges before each other, so that a
    frequent label does not meet in one task."""
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(FOLD_RANGES << 20))
    rows = df.withColumns({"_u": u, "_range": F.floor(u / (1 << 20))})
    sizes = rows.groupBy(F.col(f"`{label}`").alias("_label"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_label").orderBy("_r")) - F.col("_n")
    place = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_u", id_col)) - 1
    sizes = sizes.select("_label", "_r", before.alias("_before"))
    placed = rows.withColumn("_place", place).join(sizes, F.col(f"`{label}`").eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_r")))
    return placed.withColumn("fold", F.pmod(F.col("_place") + F.col("_before"), F.lit(k)).cast("int")).select(*df.columns, "fold")


def hashed_folds(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """df with a column fold 0..k-1 by hash of the id: no shuffle."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(k)).cast("int"))
