"""Trees as flat arrays, their routing on arrays and as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.binner import MISSING

#: Category codes from here on always go right: a split's left set is one 64-bit mask.
MASK_BITS = 64


def get_children(node: int) -> tuple[int, int]:
    return 2 * node + 1, 2 * node + 2


def get_parent(node: int) -> int:
    if node <= 0:
        raise ValueError("the root has no parent")
    return (node - 1) // 2


def get_nodes_at_depth(depth: int) -> list[int]:
    return list(range(2**depth - 1, 2 ** (depth + 1) - 1))


@dataclass
class Split:
    """A split of a node. left: (grad, hess, rows) of the left child; cat_mask holds the codes that go left."""

    feature: int = -1
    threshold: int = -1
    gain: float = 0.0
    missing_left: bool = True
    is_categorical: bool = False
    cat_mask: int = 0
    left: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def valid(self) -> bool:
        return self.feature >= 0 and self.gain > 0


@dataclass
class Tree:
    """Nodes in order of creation; node 0 is the root and -1 stands for none. Leaves have feature -1."""

    feature: list[int] = field(default_factory=list)
    threshold: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    is_categorical: list[bool] = field(default_factory=list)
    cat_mask: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    depth_of: list[int] = field(default_factory=list)

    def add(self, value: float = 0.0, cover: float = 0.0, depth: int = 0) -> int:
        for name, v in (("feature", -1), ("threshold", -1), ("left", -1), ("right", -1), ("value", value), ("missing_left", True), ("is_categorical", False), ("cat_mask", 0), ("gain", 0.0), ("cover", cover), ("depth_of", depth)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def split(self, node: int, s: Split, left: int, right: int) -> None:
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = s.feature, s.threshold, left, right
        self.missing_left[node], self.is_categorical[node], self.cat_mask[node], self.gain[node] = s.missing_left, s.is_categorical, s.cat_mask, s.gain

    @property
    def n_leaves(self) -> int:
        return sum(f < 0 for f in self.feature)

    @property
    def depth(self) -> int:
        return max(self.depth_of, default=0)

    def arrays(self) -> tuple:
        return tuple(np.array(x, d) for x, d in ((self.feature, np.int32), (self.threshold, np.int32), (self.left, np.int32), (self.right, np.int32), (self.missing_left, bool), (self.is_categorical, bool), (self.cat_mask, np.uint64)))

    def route(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row; bins is uint8 (features, rows)."""
        feature, threshold, left, right, missing_left, cat, mask = self.arrays()
        node = np.zeros(bins.shape[1], np.int32)
        rows = np.arange(bins.shape[1])
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            at = node[inner]
            b = bins[f[inner], rows[inner]]
            goes = b <= threshold[at]
            if cat.any():
                code = np.minimum(b, MASK_BITS - 1).astype(np.uint64)
                goes = np.where(cat[at], (b < MASK_BITS) & (((mask[at] >> code) & np.uint64(1)) == 1), goes)
            goes = np.where(b == MISSING, missing_left[at], goes)
            node[inner] = np.where(goes, left[at], right[at])
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.route(bins)]

    def goes_left(self, node: int, bins: list[Column]) -> Column:
        b = bins[self.feature[node]]
        if self.is_categorical[node]:
            mask = self.cat_mask[node]
            signed = mask - (1 << 64) if mask >= 1 << 63 else mask
            # The shift count wraps at 64, so codes above the mask are tested first.
            test = F.when(b < MASK_BITS, F.lit(signed).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))) != 0).otherwise(False)
        else:
            test = b <= self.threshold[node]
        return F.when(b == MISSING, F.lit(self.missing_left[node])).otherwise(test)

    def expression(self, bins: list[Column], leaf: bool = False) -> Column:
        """Value (or leaf number) of each row as nested CASE expressions over bin columns."""

        def at(node: int) -> Column:
            if self.feature[node] < 0:
                return F.lit(node) if leaf else F.lit(float(self.value[node]))
            return F.when(self.goes_left(node, bins), at(self.left[node])).otherwise(at(self.right[node]))

        return at(0)

    def rows(self) -> list[tuple]:
        """(node, feature, threshold, left, right, value, missing_left, is_categorical, cat_mask, gain, cover, depth)."""
        masks = [m - (1 << 64) if m >= 1 << 63 else m for m in self.cat_mask]
        return list(zip(range(len(self.feature)), self.feature, self.threshold, self.left, self.right, map(float, self.value), map(bool, self.missing_left), map(bool, self.is_categorical), masks, map(float, self.gain), map(float, self.cover), self.depth_of, strict=True))

    @classmethod
    def from_rows(cls, rows) -> Tree:
        out = cls()
        for r in sorted(rows):
            node = out.add(r[5], r[10], r[11])
            out.split(node, Split(r[1], r[2], r[9], r[6], r[7], r[8] % (1 << 64)), r[3], r[4])
        return out


ROW_SCHEMA = "node int, feature int, threshold int, left int, right int, value double, missing_left boolean, is_categorical boolean, cat_mask long, gain double, cover double, depth int"
