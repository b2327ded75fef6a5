"""The boosting operators as plain relational queries: histograms, splits, routing and leaves over DataFrames.

Training uses the block engine; these are the same operators for use inside other queries, all in Spark functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.binner import MISSING
from .tree import MASK_BITS


def init_nodes(df: DataFrame) -> DataFrame:
    return df.withColumn("node", F.lit(0))


def build_histogram(df: DataFrame, bins: list[str], grad: str = "g", hess: str = "h", by: list[str] = ()) -> DataFrame:
    """(by..., feature, bin, g, h, n): sums over rows for each feature's bins; feature is the position in bins.

    unpivot emits a row a feature within a partition; partial aggregation then leaves at most features * 256 rows of
    each node to shuffle, whatever the number of rows.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(b).cast("int").alias("bin")) for i, b in enumerate(bins)))).alias("s")
    flat = df.select(*by, F.col(grad).alias("g"), F.col(hess).alias("h"), pairs).select(*by, "g", "h", "s.feature", "s.bin")
    return flat.groupBy(*by, "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def build_node_histograms(df: DataFrame, bins: list[str], nodes: list[int], grad: str = "g", hess: str = "h") -> DataFrame:
    """Histograms of the listed nodes: (node, feature, bin, g, h, n)."""
    return build_histogram(df.filter(F.col("node").isin(nodes)), bins, grad, hess, ["node"])


def subtract_histograms(parent: DataFrame, child: DataFrame) -> DataFrame:
    """(feature, bin, g, h, n) of the sibling: the parent's less the child's; bins that become empty stay, at 0."""
    c = child.select("feature", "bin", *(F.col(x).alias(f"c_{x}") for x in "ghn"))
    return parent.join(c, ["feature", "bin"], "left").select("feature", "bin", *((F.col(x) - F.coalesce(F.col(f"c_{x}"), F.lit(0))).alias(x) for x in "ghn"))


def gain(gl: Column, hl: Column, gr: Column, hr: Column, reg_lambda: float = 1.0) -> Column:
    lam = F.lit(float(reg_lambda))

    def part(g, h):
        return F.coalesce(F.try_divide(g * g, h + lam), F.lit(0.0))

    return part(gl, hl) + part(gr, hr) - part(gl + gr, hl + hr)


def split_candidates(hist: DataFrame, by: list[str] = (), reg_lambda: float = 1.0, min_child_weight: float = 1.0, categorical: list[int] = ()) -> DataFrame:
    """Every cut that leaves min_child_weight on either side: (by..., feature, threshold, missing_left, gain, gl, hl, nl,
    codes). Missing values go left first; right is tried only where the feature has some. codes: for categorical
    features the codes of the left side, ordered by -g / (h + lambda)."""
    keys = [*by, "feature"]
    whole = Window.partitionBy(*keys)
    is_cat = F.col("feature").isin(list(categorical)) if categorical else F.lit(False)
    score = F.when(F.col("h") > 1e-10, -F.col("g") / (F.col("h") + reg_lambda)).otherwise(0.0)
    rows = hist.withColumns({"order": F.when(is_cat, score).otherwise(F.col("bin").cast("double"))})
    for x in "ghn":
        rows = rows.withColumn(f"m{x}", F.sum(F.when(F.col("bin") == MISSING, F.col(x)).otherwise(0)).over(whole)).withColumn(f"t{x}", F.sum(x).over(whole))
    up = Window.partitionBy(*keys).orderBy("order", "bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.filter(F.col("bin") != MISSING)
    rows = rows.select("*", *(F.sum(x).over(up).alias(f"p{x}") for x in "ghn"), F.when(is_cat, F.collect_list("bin").over(up)).alias("codes"))
    side = F.explode(F.when(F.col("mn") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("missing_left")
    rows = rows.select("*", side)
    sums = {f"{x}l": F.col(f"p{x}") + F.when(F.col("missing_left"), F.col(f"m{x}")).otherwise(0) for x in "ghn"}
    rows = rows.withColumns(sums)
    ok = (F.col("hl") >= min_child_weight) & (F.col("th") - F.col("hl") >= min_child_weight) & (F.col("th") >= min_child_weight)
    value = gain(F.col("gl"), F.col("hl"), F.col("tg") - F.col("gl"), F.col("th") - F.col("hl"), reg_lambda)
    return rows.filter(ok).select(*by, "feature", F.col("bin").alias("threshold"), "missing_left", value.alias("gain"), "gl", "hl", "nl", "tg", "th", "codes", "order")


def find_splits(hist: DataFrame, by: list[str] = (), reg_lambda: float = 1.0, min_child_weight: float = 1.0, min_gain: float = 0.0, categorical: list[int] = ()) -> DataFrame:
    """The best split of each group: one row each, none where no split gains above 0 and min_gain. Ties: the lowest
    feature, then the lowest bin, then missing to the left."""
    cuts = split_candidates(hist, by, reg_lambda, min_child_weight, categorical).filter((F.col("gain") > 0) & (F.col("gain") >= min_gain))
    top = F.min(F.struct((-F.round("gain", 9)).alias("loss"), "feature", "order", "threshold", (~F.col("missing_left")).alias("right"), "gain", "gl", "hl", "nl", "tg", "th", "codes")).alias("s")
    best = cuts.groupBy(*by).agg(top) if by else cuts.agg(top).filter("s is not null")
    mask = F.aggregate(F.filter(F.coalesce("s.codes", F.array().cast("array<int>")), lambda c: c < MASK_BITS), F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)))
    return best.select(*by, "s.feature", "s.threshold", (~F.col("s.right")).alias("missing_left"), "s.gain", "s.gl", "s.hl", (F.col("s.tg") - F.col("s.gl")).alias("gr"), (F.col("s.th") - F.col("s.hl")).alias("hr"), F.when(F.col("s.codes").isNotNull(), mask).alias("cat_mask"))


def goes_left(b: Column, threshold: int, missing_left: bool = True, cat_mask: int | None = None) -> Column:
    if cat_mask is None:
        test = b <= threshold
    else:
        signed = cat_mask - (1 << 64) if cat_mask >= 1 << 63 else cat_mask
        test = F.when(b < MASK_BITS, F.lit(signed).cast("long").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))) != 0).otherwise(False)
    return F.when(b == MISSING, F.lit(missing_left)).otherwise(test)


def route(df: DataFrame, splits: dict[int, dict]) -> DataFrame:
    """Move rows of split nodes to 2i + 1 or 2i + 2. splits: node -> {bin (column), threshold, missing_left, cat_mask}."""
    node, out = F.col("node"), None
    for i, s in splits.items():
        left = goes_left(F.col(s["bin"]), s.get("threshold", -1), s.get("missing_left", True), s.get("cat_mask"))
        child = F.when(left, 2 * i + 1).otherwise(2 * i + 2)
        out = F.when(node == i, child) if out is None else out.when(node == i, child)
    return df if out is None else df.withColumn("node", out.otherwise(node))


def leaf_value(g: Column, h: Column, reg_lambda: float = 1.0, reg_alpha: float = 0.0) -> Column:
    soft = F.signum(g) * F.greatest(F.abs(g) - reg_alpha, F.lit(0.0))
    return F.coalesce(-F.try_divide(soft, h + reg_lambda), F.lit(0.0))


def compute_leaf_values(df: DataFrame, grad: str = "g", hess: str = "h", reg_lambda: float = 1.0, reg_alpha: float = 0.0) -> DataFrame:
    """(node, value, n)."""
    sums = df.groupBy("node").agg(F.sum(grad).alias("_g"), F.sum(hess).alias("_h"), F.count("*").alias("n"))
    return sums.select("node", leaf_value(F.col("_g"), F.col("_h"), reg_lambda, reg_alpha).alias("value"), "n")


def symmetric_leaf(bins: list[Column], thresholds: list[int]) -> Column:
    """Leaf number of an oblivious tree: a bit a level, 1 where the bin is above the threshold."""
    out = F.lit(0)
    for b, t in zip(bins, thresholds, strict=True):
        out = out * 2 + (b > t).cast("int")
    return out


def level_split(hist: DataFrame, reg_lambda: float = 1.0, min_child_weight: float = 1.0) -> DataFrame:
    """The one numeric split of a level, from (node, feature, bin, g, h, n): the largest sum of the nodes' gains, missing
    values going right. Nodes that cannot be cut there add nothing."""
    filled = hist.filter(F.col("bin") != MISSING)
    totals = hist.groupBy("node", "feature").agg(F.sum("g").alias("tg"), F.sum("h").alias("th"))
    # Every node meets every bin that any node has: levels hold few nodes, and bins are 255 at most.
    grid = totals.join(filled.select("feature", "bin").distinct(), "feature")
    rows = grid.join(filled, ["node", "feature", "bin"], "left").fillna(0.0, ["g", "h"])
    up = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"gl": F.sum("g").over(up), "hl": F.sum("h").over(up)})
    ok = (F.col("hl") >= min_child_weight) & (F.col("th") - F.col("hl") >= min_child_weight)
    own = F.when(ok, gain(F.col("gl"), F.col("hl"), F.col("tg") - F.col("gl"), F.col("th") - F.col("hl"), reg_lambda)).otherwise(0.0)
    sums = rows.groupBy("feature", F.col("bin").alias("threshold")).agg(F.sum(own).alias("gain"))
    return sums.orderBy(F.desc(F.round("gain", 9)), "feature", "threshold").limit(1)
