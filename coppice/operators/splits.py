"""Split finding on histograms: prefix sums over bins, then the largest gain."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .tree import MASK_BITS, MISSING, Split

BINS = 256


@dataclass(frozen=True)
class GrowthConfig:
    """Parameters of one tree. min_gain is compared with the gain as it stands, without a factor of one half."""

    max_depth: int = 6
    max_leaves: int | None = None
    min_child_weight: float = 1.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    min_gain: float = 0.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    growth: str = "levelwise"


def leaf_value(g: float, h: float, reg_lambda: float = 1.0, reg_alpha: float = 0.0) -> float:
    """Newton step -soft(G, alpha) / (H + lambda); 0 for an empty leaf."""
    soft = np.sign(g) * max(abs(g) - reg_alpha, 0.0)
    return float(-soft / (h + reg_lambda)) if h + reg_lambda > 0 else 0.0


def _score(g, h, reg_lambda):
    bottom = h + reg_lambda
    return np.divide(g * g, bottom, out=np.zeros(np.broadcast(g, bottom).shape), where=bottom > 0)


def _scan(prefix, total, missing, c: GrowthConfig, sides):
    """Gains of cutting after each prefix: for each side that missing values may take, (gain, side)."""
    out = []
    for side in sides:
        left = prefix + (missing if side else 0.0)
        right = total - left
        ok = (left[..., 1] >= c.min_child_weight) & (right[..., 1] >= c.min_child_weight)
        gain = _score(left[..., 0], left[..., 1], c.reg_lambda) + _score(right[..., 0], right[..., 1], c.reg_lambda) - _score(*total[:2], c.reg_lambda)
        out.append((np.where(ok, gain, -np.inf), left))
    return out


def best_split(hist: np.ndarray, config: GrowthConfig, n_categories: list[int] | None = None, allowed: np.ndarray | None = None) -> Split:
    """Best split of a node from its histogram (features, 256, 3: grad, hess, rows).

    Ties: the lowest bin, missing to the left, then the lowest feature. Categories are ordered by -g / (h + lambda) and
    cut by prefix. A split needs a gain above 0 and of min_gain at least, and min_child_weight on either side.
    """
    p = len(hist)
    n_categories = n_categories or [0] * p
    total = hist[0].sum(0)
    best = Split()
    if total[1] < config.min_child_weight:
        return best
    floor = max(config.min_gain, 0.0)
    prefixes = np.cumsum(hist[:, :MISSING], axis=1)
    for f in range(p):
        if allowed is not None and not allowed[f]:
            continue
        missing = hist[f, MISSING]
        sides = (True, False) if missing[2] > 0 else (True,)
        order = None
        if k := n_categories[f]:
            codes = hist[f, :k]
            score = np.where(codes[:, 1] > 1e-10, -codes[:, 0] / np.where(codes[:, 1] + config.reg_lambda > 0, codes[:, 1] + config.reg_lambda, 1.0), 0.0)
            order = np.argsort(score, kind="stable")
            prefix = np.cumsum(codes[order], axis=0)
        else:
            prefix = prefixes[f]
        if not len(prefix):
            continue
        scans = _scan(prefix, total, missing, config, sides)
        gains = np.stack([s[0] for s in scans], 1)
        at = int(gains.argmax())  # bins in order, the left side first: strict improvements only
        t, side = divmod(at, len(sides))
        gain = float(gains[t, side])
        if gain > best.gain and gain > 0 and gain >= floor:
            mask = 0
            if order is not None:
                for code in order[: t + 1]:
                    if code < MASK_BITS:
                        mask |= 1 << int(code)
                if k > MASK_BITS:
                    # What the mask cannot hold goes right: the record must follow the routing.
                    inside = [int(c) for c in order[: t + 1] if c < MASK_BITS]
                    left = codes[inside].sum(0) + (missing if sides[side] else 0.0)
                    right = total - left
                    if min(left[1], right[1]) < config.min_child_weight:
                        continue
                    gain = float(_score(*left[:2], config.reg_lambda) + _score(*right[:2], config.reg_lambda) - _score(*total[:2], config.reg_lambda))
                    if not (gain > best.gain and gain >= floor):
                        continue
                else:
                    left = scans[side][1][t]
            else:
                left = scans[side][1][t]
            best = Split(f, t, gain, sides[side], order is not None, mask, tuple(map(float, left)))
    return best


def best_level_split(hists: list[np.ndarray], config: GrowthConfig, allowed: np.ndarray | None = None, n_categories: list[int] | None = None) -> Split:
    """One split for all leaves of a level: the largest sum of their gains. Missing values go right."""
    best = Split()
    p = len(hists[0])
    pooled = sum(hists)
    for f in range(p):
        if allowed is not None and not allowed[f]:
            continue
        k = (n_categories or [0] * p)[f]
        if k:
            codes = pooled[f, :k]
            score = np.where(codes[:, 1] > 1e-10, -codes[:, 0] / np.where(codes[:, 1] + config.reg_lambda > 0, codes[:, 1] + config.reg_lambda, 1.0), 0.0)
            order = np.array([c for c in np.argsort(score, kind="stable") if c < MASK_BITS], int)
        gain = 0.0
        for h in hists:
            prefix = np.cumsum(h[f, order] if k else h[f, :MISSING], axis=0)
            scanned = _scan(prefix, h[f].sum(0), 0.0, config, (False,))[0][0]
            gain = gain + np.where(np.isfinite(scanned), scanned, 0.0)
        t = int(np.argmax(gain))
        if gain[t] > best.gain and gain[t] >= max(config.min_gain, 0.0):
            mask = sum(1 << int(c) for c in order[: t + 1]) if k else 0
            best = Split(f, t, float(gain[t]), False, bool(k), mask)
    return best


def subtract_histogram(parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The sibling's histogram."""
    return parent - child
