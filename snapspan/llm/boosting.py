"""Gradient-boosted trees, logistic loss, binned splits: on a small labelled sample in numpy, or on a table of counted rows of any size.

The table is read where it lies once for each level of a tree; its partitions add up gradients by node, feature and bin, and only these sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapspan.llm.common import utf8_views

#: Gradients are summed as whole numbers of this part, so the order of the rows makes no difference.
PART = 1 << 20
#: Sums that a level sends to the driver at most, one a task.
TASKS = 48


@dataclass
class Boosted:
    """``trees`` holds (feature, cut, left, right, value) arrays; a leaf has feature -1."""

    base: float = 0.0
    trees: list = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree[4][place(tree, x)]
        return out


def place(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    feature, cut, left, right, _ = tree
    at = np.zeros(len(x), int)
    while (inner := feature[at] >= 0).any():
        here = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
        at = np.where(inner, np.where(here, left[at], right[at]), at)
    return at


def _grow(x, edges, binned, g, h, depth, shrink, least):
    nodes = []

    def split(rows, level):
        me = len(nodes)
        G, H = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, me, me, -shrink * G / (H + 1.0)])
        if level == depth or len(rows) < 2 * least:
            return me
        best = (1e-6, None, None)
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            b = binned[rows, f]
            gs = np.cumsum(np.bincount(b, g[rows], len(cuts) + 1))[:-1]
            hs = np.cumsum(np.bincount(b, h[rows], len(cuts) + 1))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=len(cuts) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] is None:
            return me
        _, f, k = best
        low = binned[rows, f] <= k
        nodes[me][:2] = f, edges[f][k]
        nodes[me][2] = split(rows[low], level + 1)
        nodes[me][3] = split(rows[~low], level + 1)
        return me

    split(np.arange(len(g)), 0)
    f, c, left, right, v = zip(*nodes)
    return np.array(f), np.array(c, float), np.array(left), np.array(right), np.array(v, float)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, shrink: float = 0.3, least: int = 5) -> Boosted:
    """Boost ``rounds`` trees; with no rows or one class only the prior is kept."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Boosted(float(np.log(rate / (1 - rate))))
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, edges, binned, p - y, np.maximum(p * (1 - p), 1e-6), depth, shrink, least)
        model.trees.append(tree)
        margin += Boosted(0.0, [tree]).margin(x)
    return model


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Rows of bins, one byte a feature: how many cuts of the feature lie below the value."""
    return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1).astype(np.uint8)


def values(bins: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """A value of each bin, which the cuts split as the one it came from."""
    table = np.full((len(cuts), 256), np.inf)
    for f, c in enumerate(cuts):
        table[f, : len(c)] = c
    return table[np.arange(len(cuts)), bins]


def summed(rows: DataFrame, cuts: list[np.ndarray], add: Callable[[np.ndarray, dict, dict], None]) -> DataFrame:
    """(key, sums): what ``add(bins, columns, sums)`` leaves in ``sums``, key -> array of whole numbers, of each of at most ``TASKS`` partitions; the arrays come as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if batch.num_rows:
                add(utf8_views(batch.column("bins"))[0].reshape(-1, len(cuts)), {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "bins"}, sums)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([int(k) for k in sums], pa.int32()), pa.array([np.ascontiguousarray(v, np.int64).tobytes() for v in sums.values()], pa.binary())], ["key", "sums"])

    return rows.coalesce(TASKS).mapInArrow(run, "key int, sums binary")


def _level(rows: DataFrame, cuts: list[np.ndarray], model: Boosted, tree: list, nodes: list[int]) -> dict[int, np.ndarray]:
    """node -> (feature, bin, 3): gradients, their slopes and rows of the open nodes of a tree, over all rows."""
    grown = tuple(np.array(c) for c in zip(*tree))
    wide = max(len(c) for c in cuts) + 1

    def add(bins: np.ndarray, columns: dict, sums: dict) -> None:
        x = values(bins, cuts)
        p = 1 / (1 + np.exp(-model.margin(x)))
        n, hits = columns["n"], columns["hits"]
        w = np.stack([n * np.rint(p * PART).astype(np.int64) - hits * PART, n * np.rint(np.maximum(p * (1 - p), 1e-6) * PART).astype(np.int64), n], 1)
        at, cell = place(grown, x), bins + wide * np.arange(len(cuts))
        for node in nodes:
            if len(mine := np.flatnonzero(at == node)):
                # whole numbers below 2**53, so the sums of a batch are exact
                own = [np.bincount(cell[mine].ravel(), np.repeat(w[mine, k], len(cuts)), len(cuts) * wide) for k in range(3)]
                sums[node] = sums.get(node, 0) + np.stack(own, 1).astype(np.int64).reshape(len(cuts), wide, 3)

    found: dict[int, np.ndarray] = {}
    for r in summed(rows.select("bins", "n", "hits"), cuts, add).collect():
        part = np.frombuffer(r["sums"], np.int64).reshape(len(cuts), wide, 3)
        found[r["key"]] = found[r["key"]] + part if r["key"] in found else part
    return found


def fit_counts(rows: DataFrame, cuts: list[np.ndarray], rounds: int = 30, depth: int = 3, shrink: float = 0.3, least: int = 5) -> Boosted:
    """As ``fit``, on all rows of a table (bins, n, hits): ``hits`` of ``n`` equal rows are positive. ``cuts`` are those the bins were made with."""
    n, hits = (int(v or 0) for v in rows.agg(F.sum("n"), F.sum("hits")).first())
    rate = (hits + 0.5) / (n + 1.0)
    model = Boosted(float(np.log(rate / (1 - rate))))
    if hits in (0, n):
        return model
    for _ in range(rounds):
        tree, open_nodes = [[-1, 0.0, 0, 0, 0.0]], [0]
        for level in range(depth):
            found = _level(rows, cuts, model, tree, open_nodes)
            open_nodes = [child for node in open_nodes if node in found for child in _split(tree, node, found[node], cuts, shrink, least, root=level == 0)]
            if not open_nodes:
                break
        f, c, left, right, v = zip(*tree)
        model.trees.append((np.array(f), np.array(c, float), np.array(left), np.array(right), np.array(v, float)))
    return model


def _split(tree: list, node: int, sums: np.ndarray, cuts: list[np.ndarray], shrink: float, least: int, root: bool) -> list[int]:
    """Give a node its best split and two leaves, if it gains; the new leaves."""
    (G, H), n = sums[0, :, :2].sum(axis=0) / PART, int(sums[0, :, 2].sum())
    if root:
        tree[node][4] = -shrink * G / (H + 1.0)
    if n < 2 * least:
        return []
    below = np.cumsum(sums, axis=1)[:, :-1]
    gs, hs, ns = below[..., 0] / PART, below[..., 1] / PART, below[..., 2]
    gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
    real = np.arange(gain.shape[1])[None] < np.array([len(c) for c in cuts])[:, None]
    gain[~real | (ns < least) | (n - ns < least)] = 0
    f, k = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[f, k] <= 1e-6:
        return []
    low, high = len(tree), len(tree) + 1
    tree[node][:4] = int(f), float(cuts[f][k]), low, high
    for me, (g, h) in ((low, (gs[f, k], hs[f, k])), (high, (G - gs[f, k], H - hs[f, k]))):
        tree.append([-1, 0.0, me, me, -shrink * g / (h + 1.0)])
    return [low, high]
