"""Growing trees: one pass over the matrix for each level (or each expanded node), splits on the driver.

All outputs of a round (classes, distribution parameters) grow together and share their passes.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .matrix import Block, Matrix, node_histogram
from .splits import GrowthConfig, best_level_split, best_split, leaf_value
from .tree import Split, Tree


def scores(block: Block, pending: list[tuple[float, list[Tree]]]) -> np.ndarray:
    """Raw scores of a block: those it holds and the trees grown since, (rate, trees of the outputs)."""
    raw = block.raw
    if pending:
        raw = raw.copy()
        for rate, trees in pending:
            for k, t in enumerate(trees):
                raw[k] += rate * t.predict(block.bins)
    return raw


@dataclass
class Round:
    """What a growth strategy works on. gradient(block) -> (g, h), each (outputs, rows), weights and sampling included.
    allowed: for each output the features it may split on, or None."""

    matrix: Matrix
    gradient: Callable[[Block], tuple[np.ndarray, np.ndarray]]
    config: GrowthConfig
    outputs: int = 1
    allowed: list[np.ndarray] | None = None

    @property
    def n_categories(self) -> list[int]:
        return self.matrix.binner.n_categories()

    def histograms(self, trees: list[Tree], nodes: list[list[int]]) -> list[dict[int, np.ndarray]]:
        """For each output: node -> (features, 256, 3), for the listed nodes of its unfinished tree; one pass."""
        gradient, p = self.gradient, len(self.matrix.binner.features)

        def work(block):
            g, h = gradient(block)
            for k, own in enumerate(nodes):
                if own:
                    slot = np.full(len(trees[k].feature), -1, np.int64)
                    slot[own] = np.arange(len(own))
                    yield str(k), node_histogram(block.bins, g[k], h[k], slot[trees[k].route(block.bins)], len(own))

        shapes = {str(k): (len(own), p, 256, 3) for k, own in enumerate(nodes) if own}
        got = self.matrix.sums(work, shapes) if shapes else {}
        return [dict(zip(own, got[str(k)], strict=True)) if own else {} for k, own in enumerate(nodes)]

    def best(self, k: int, hist: np.ndarray) -> Split:
        return best_split(hist, self.config, self.n_categories, self.allowed[k] if self.allowed else None)

    def open(self, tree: Tree, node: int, split: Split, total: np.ndarray) -> tuple[int, int]:
        """Give the node its split and two leaves."""
        c = self.config
        left = np.array(split.left)
        children = []
        for side in (left, total - left):
            children.append(tree.add(leaf_value(side[0], side[1], c.reg_lambda, c.reg_alpha), side[1], tree.depth_of[node] + 1))
        tree.split(node, split, *children)
        return tuple(children)


class GrowthStrategy:
    """grow(round) -> one tree for each output."""

    def grow(self, round: Round) -> list[Tree]:
        raise NotImplementedError


def _rooted(round: Round) -> tuple[list[Tree], list[dict[int, np.ndarray]]]:
    trees = [Tree() for _ in range(round.outputs)]
    for t in trees:
        t.add()
    hists = round.histograms(trees, [[0]] * round.outputs)
    for t, own in zip(trees, hists, strict=True):
        g, h, _ = own[0][0].sum(0)
        t.value[0], t.cover[0] = leaf_value(g, h, round.config.reg_lambda, round.config.reg_alpha), h
    return trees, hists


class LevelWise(GrowthStrategy):
    """Every level takes one pass. Of two siblings only the smaller is counted; the other is what the parent leaves."""

    def grow(self, round: Round) -> list[Tree]:
        trees, hists = _rooted(round)
        for depth in range(round.config.max_depth):
            pairs: list[list[tuple[int, int, np.ndarray]]] = []
            for k, (tree, own) in enumerate(zip(trees, hists, strict=True)):
                opened = []
                for node, hist in own.items():
                    split = round.best(k, hist)
                    if split.valid:
                        total = hist[0].sum(0)
                        children = round.open(tree, node, split, total)
                        small = 0 if split.left[2] <= total[2] / 2 else 1
                        opened.append((children[small], children[1 - small], hist))
                pairs.append(opened)
            if not any(pairs) or depth == round.config.max_depth - 1:
                break
            counted = round.histograms(trees, [[small for small, _, _ in own] for own in pairs])
            hists = [{n: x for small, large, parent in own for n, x in ((small, got[small]), (large, parent - got[small]))} for own, got in zip(pairs, counted, strict=True)]
        return trees


class LeafWise(GrowthStrategy):
    """The leaf of the largest gain first, up to max_leaves (2 ** max_depth by default). A pass for each expansion."""

    def grow(self, round: Round) -> list[Tree]:
        c = round.config
        most = c.max_leaves or 2**c.max_depth
        trees, hists = _rooted(round)
        heaps: list[list] = [[] for _ in trees]

        def push(k, node, hist):
            if trees[k].depth_of[node] < c.max_depth and (split := round.best(k, hist)).valid:
                heapq.heappush(heaps[k], (-split.gain, node, split, hist))

        for k, own in enumerate(hists):
            push(k, 0, own[0])
        while True:
            opened = {}
            for k, tree in enumerate(trees):
                if heaps[k] and tree.n_leaves < most:
                    _, node, split, hist = heapq.heappop(heaps[k])
                    total = hist[0].sum(0)
                    children = round.open(tree, node, split, total)
                    if tree.n_leaves < most:
                        small = 0 if split.left[2] <= total[2] / 2 else 1
                        opened[k] = (children[small], children[1 - small], hist)
            if not opened:
                return trees
            counted = round.histograms(trees, [[opened[k][0]] if k in opened else [] for k in range(len(trees))])
            for k, (small, large, parent) in opened.items():
                push(k, small, counted[k][small])
                push(k, large, parent - counted[k][small])


class Symmetric(GrowthStrategy):
    """Oblivious trees: all leaves of a level share one split. Missing values go right."""

    def grow(self, round: Round) -> list[Tree]:
        trees, hists = _rooted(round)
        for depth in range(round.config.max_depth):
            nodes: list[list[int]] = []
            for k, (tree, own) in enumerate(zip(trees, hists, strict=True)):
                leaves = []
                split = best_level_split(list(own.values()), round.config, round.allowed[k] if round.allowed else None, round.n_categories) if own else Split()
                if split.valid:
                    for node, hist in own.items():
                        code = np.arange(255)
                        if split.is_categorical:
                            left = np.array([c for c in range(64) if split.cat_mask >> c & 1], int)
                        else:
                            left = code[code <= split.threshold]
                        share = hist[split.feature, left].sum(0)
                        leaves += round.open(tree, node, Split(split.feature, split.threshold, split.gain, False, split.is_categorical, split.cat_mask, tuple(share)), hist[0].sum(0))
                nodes.append(leaves)
            if not any(nodes) or depth == round.config.max_depth - 1:
                break
            hists = round.histograms(trees, nodes)
        return trees


_STRATEGIES: dict[str, type] = {"levelwise": LevelWise, "leafwise": LeafWise, "symmetric": Symmetric}
_ALIASES = {"level_wise": "levelwise", "depthwise": "levelwise", "leaf_wise": "leafwise", "lossguide": "leafwise", "oblivious": "symmetric"}


def register_growth_strategy(name: str, *, override: bool = False):
    """Class decorator: make a strategy available by name."""

    def add(cls):
        if name.lower() in _STRATEGIES and not override:
            raise ValueError(f"growth strategy {name!r} is registered; pass override=True to replace it")
        _STRATEGIES[name.lower()] = cls
        return cls

    return add


def get_growth_strategy(name: str | GrowthStrategy) -> GrowthStrategy:
    if isinstance(name, GrowthStrategy):
        return name
    key = _ALIASES.get(name.lower(), name.lower())
    if key not in _STRATEGIES:
        raise ValueError(f"unknown growth strategy {name!r}; known: {', '.join(sorted(_STRATEGIES))}")
    return _STRATEGIES[key]()


@dataclass
class FittedTrees:
    """Trees of an ensemble: rounds[r][k] is the tree of output k, rates[r] what its values are multiplied by."""

    rounds: list[list[Tree]] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)

    def raw(self, bins: np.ndarray, base: np.ndarray, n_rounds: int | None = None) -> np.ndarray:
        out = np.repeat(np.asarray(base, np.float64)[:, None], bins.shape[1], 1)
        for rate, trees in list(zip(self.rates, self.rounds, strict=True))[:n_rounds]:
            for k, t in enumerate(trees):
                out[k] += rate * t.predict(bins)
        return out
