"""Growth of decision nodes from binned features: what a task does with the rows it has.

Rows are bytes (the bin of each feature). All nodes of a depth are split together: one count of
weights by node, drawn feature, bin and class gives every cut of every node. Which features a node
may use follows from its path and the seed alone, so it is the same wherever the node is grown.
Definitions: Breiman (2001) for the forest; Gini impurity; bins and cuts as in MLlib.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
from pyspark import cloudpickle

# workers get these functions by value: they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Impurity below which a node is pure, and cells of the counts that are held at once.
PURE, CELLS = 1e-12, 1 << 21


class Rules(NamedTuple):
    """When a node is split."""
    depth: int
    least: int
    features: int
    gain: float
    weight: float
    bins: int
    classes: int
    seed: int


def mixed(numbers: np.ndarray) -> np.ndarray:
    """64-bit numbers that look random, one for each (the finaliser of SplitMix64)."""
    z = numbers.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def root_path(tree: int, seed: int) -> int:
    return int(mixed(mixed(np.array([seed & (1 << 63) - 1])) ^ np.array([tree], np.uint64))[0])


def child_paths(paths: np.ndarray) -> np.ndarray:
    """Left and right path of each node, side by side."""
    return np.stack([mixed(paths ^ np.uint64(1)), mixed(paths ^ np.uint64(2))], axis=1)


def drawn(paths: np.ndarray, width: int, k: int) -> np.ndarray:
    """The ``k`` of ``width`` features that each node may use, in order."""
    if k >= width:
        return np.tile(np.arange(width), (len(paths), 1))
    keys = mixed(paths[:, None] ^ mixed(np.arange(width))[None, :])
    return np.sort(np.argpartition(keys, k - 1, axis=1)[:, :k], axis=1)


def cut_points(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Cuts of one feature: between all its values if they are few, else at equal steps of weight."""
    known = ~np.isnan(values)
    each, where = np.unique(values[known], return_inverse=True)
    if len(each) < 2:
        return np.zeros(0)
    middle = (each[:-1] + each[1:]) / 2
    if len(each) > bins:
        upto = np.cumsum(np.bincount(where, weights[known]))
        steps = upto[-1] / bins * np.arange(1, bins)
        at = np.unique(np.searchsorted((upto[:-1] + upto[1:]) / 2, steps, "right"))
        middle = middle[at[at < len(middle)]]
    return middle[np.isfinite(middle)]


def binned(matrix: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many cuts lie below each value."""
    out = np.empty(matrix.shape, np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16)
    for j, points in enumerate(cuts):
        out[:, j] = np.searchsorted(points, matrix[:, j], "left")
    return out


def over_classes(stats: np.ndarray) -> np.ndarray:
    """The sum over the last axis, class by class: numpy's own goes row by row, which is slow where classes are few."""
    total = stats[..., 0]
    for c in range(1, stats.shape[-1]):
        total = total + stats[..., c]
    return total


def impurity(stats: np.ndarray) -> np.ndarray:
    total = over_classes(stats)
    return 1 - over_classes(stats ** 2) / np.where(total > 0, total, 1) ** 2 * (total > 0) - (total <= 0)


def tallies(bins, y, weight, bag, node, features, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Weight by node, drawn feature, bin and class, and rows by node, drawn feature and bin."""
    m, k = features.shape
    at = features[node]
    at += (np.arange(len(bins)) * bins.shape[1])[:, None]
    cell = (np.arange(m * k) * rules.bins).reshape(m, k)[node]
    cell += bins.ravel().take(at)
    counts = np.bincount(cell.ravel(), np.repeat(bag, k), m * k * rules.bins)
    cell *= rules.classes
    cell += y[:, None]
    weights = np.bincount(cell.ravel(), np.repeat(weight, k), m * k * rules.bins * rules.classes)
    return weights.reshape(m, k, rules.bins, rules.classes), counts.reshape(m, k, rules.bins)


def best_cuts(weights: np.ndarray, counts: np.ndarray, rules: Rules) -> tuple[np.ndarray, ...]:
    """Of each node: which drawn feature and bin to cut at, the gain (0: none), and what goes left."""
    left, n_left = weights.cumsum(2)[:, :, :-1], counts.cumsum(2)[:, :, :-1]
    total, n = weights[:, 0].sum(1), counts[:, 0].sum(1)
    right = np.maximum(total[:, None, None] - left, 0)
    n_right = n[:, None, None] - n_left
    w_left, w_right = over_classes(left), over_classes(right)
    whole = np.maximum(total.sum(-1), np.finfo(float).tiny)[:, None, None]
    gain = impurity(total)[:, None, None] - w_left / whole * impurity(left) - w_right / whole * impurity(right)
    least = max(rules.least, 1)
    fits = (n_left >= least) & (n_right >= least) & (np.minimum(w_left, w_right) >= rules.weight) & (gain >= rules.gain)
    gain = np.where(fits, gain, 0).reshape(len(weights), -1)
    at = gain.argmax(1)
    row, j, cut = np.arange(len(weights)), at // left.shape[2], at % left.shape[2]
    return j, cut, gain[row, at], left[row, j, cut], n_left[row, j, cut]


def grow(bins, y, weight, bag, path: int, depth: int, rules: Rules) -> dict[str, np.ndarray]:
    """The subtree below a node that has these rows, in order of depth; leaves have feature -1."""
    node, paths, ids, size, levels = np.zeros(len(y), np.int64), np.array([path], np.uint64), np.zeros(1, np.int64), 1, []
    while len(ids):
        m = len(ids)
        stats = np.bincount(node * rules.classes + y, weight, m * rules.classes).reshape(m, -1)
        n = np.bincount(node, bag, m)
        out = {"feature": np.full(m, -1), "cut": np.full(m, -1), "left": np.full(m, -1), "right": np.full(m, -1),
               "stats": stats, "n": n.astype(np.int64), "gain": np.full(m, -1.0), "level": np.full(m, depth)}
        levels.append(out)
        open_ = (depth < rules.depth) & (impurity(stats) > PURE) & (n >= 2 * rules.least)
        order = np.argsort(node, kind="stable")
        order = order[open_[node[order]]]
        now = np.flatnonzero(open_)
        place = np.cumsum(open_) - 1
        bins, y, weight, bag, node = bins[order], y[order], weight[order], bag[order], place[node[order]]
        features = drawn(paths[now], bins.shape[1], rules.features)
        step = max(1, CELLS // (features.shape[1] * rules.bins * rules.classes))
        for a in range(0, len(now), step):
            rows = slice(*np.searchsorted(node, [a, a + step]))
            some = features[a:a + step]
            j, cut, gain, _, _ = best_cuts(*tallies(bins[rows], y[rows], weight[rows], bag[rows], node[rows] - a, some, rules), rules)
            at = now[a:a + step][gain > 0]
            out["feature"][at], out["cut"][at] = some[np.arange(len(some)), j][gain > 0], cut[gain > 0]
            out["gain"][at] = gain[gain > 0]
        split = np.flatnonzero(out["feature"] >= 0)
        out["left"][split] = size + 2 * np.arange(len(split))
        out["right"][split] = out["left"][split] + 1
        mine = now[node]
        kept = out["feature"][mine] >= 0
        bins, y, weight, bag, mine = bins[kept], y[kept], weight[kept], bag[kept], mine[kept]
        goes_right = bins[np.arange(len(mine)), out["feature"][mine]] > out["cut"][mine]
        node = out["left"][mine] + goes_right - size
        paths, ids = child_paths(paths[split]).ravel(), size + np.arange(2 * len(split))
        size, depth = size + 2 * len(split), depth + 1
    return pruned({c: np.concatenate([x[c] for x in levels]) for c in levels[0]})


def pruned(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Two leaves of one prediction below a node become one leaf; nodes are numbered anew."""
    says = tree["stats"].argmax(1)
    for level in range(tree["level"].max(), tree["level"].min() - 1, -1):
        at = np.flatnonzero((tree["level"] == level) & (tree["feature"] >= 0))
        low, high = tree["left"][at], tree["right"][at]
        gone = at[(tree["feature"][low] < 0) & (tree["feature"][high] < 0) & (says[low] == says[high])]
        for column in ("feature", "cut", "left", "right", "gain"):
            tree[column][gone] = -1
    kept = np.zeros(len(says), bool)
    kept[0] = True
    for level in range(tree["level"].min(), tree["level"].max()):
        at = np.flatnonzero((tree["level"] == level) & (tree["feature"] >= 0) & kept)
        kept[tree["left"][at]] = kept[tree["right"][at]] = True
    number = np.cumsum(kept) - 1
    out = {c: v[kept] for c, v in tree.items()}
    for side in ("left", "right"):
        out[side] = np.where(out["feature"] >= 0, number[out[side]], -1)
    return out


def routed(bins: np.ndarray, top: dict[str, np.ndarray]) -> np.ndarray:
    """The node of a tree's upper part that each row ends in."""
    node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(row):
        row = row[top["feature"][node[row]] >= 0]
        at = node[row]
        node[row] = np.where(bins[row, top["feature"][at]] <= top["cut"][at], top["left"][at], top["right"][at])
    return node
