"""Boosted regression trees, many models grown side by side.

Features are binned once to bytes; bin 0 stands for a missing value, and each
split learns the side that missing values take. One Spark job grows one level
of the current tree of all models (folds, grid points): tasks add up gradient
histograms of the large nodes, and rows of a node of at most ``SMALL_NODE``
rows are sent to one task, which builds the whole subtree below. A model with
at most ``SMALL_TABLE`` rows is one small node from the start: its rows go to
one task for all of its trees, other models' rows to other tasks. The driver
holds trees and best splits, never rows or histograms.

Gradients are whole numbers of ``2 ** -k``, so sums don't depend on the order
or layout of the rows: the same data, settings and seed give the same model on
any number of cores, and either way of growing it. Rows are sampled by their
hash and the tree's number. Scores of the rows are kept beside the bins and
written to the checkpoint folder every ``CHECKPOINT_EVERY`` trees, so a lost
executor costs the updates since then and no tree is grown again.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from datetime import date
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ModelBundleError
from ..session import CHECKPOINT_SETTING, shared_path, ship

#: Bins of a feature beside the one for missing values.
BINS = 255
#: Rows of a node that one task takes whole; about 40 bytes each.
SMALL_NODE = 16_384
#: Rows of a model that one task takes whole, some 10 MB.
SMALL_TABLE = 100_000
#: Rows of a block, the unit in which tasks hold the bins.
BLOCK_ROWS = 8_192
CHECKPOINT_EVERY = 25
#: Bits of a gradient. A count and a sum over ``SMALL_TABLE`` rows share one
#: float without loss: the count in units of 2 ** 36.
GRADIENT_BITS = 18
_COUNT_BITS = 36
_COUNT_UNIT = 2.0**_COUNT_BITS
#: Bins of nodes that are looked at together; they should stay in a core's cache.
SUMS_AT_ONCE = 1 << 16
#: Bits below one of a squared error, for exact sums.
ERROR_BITS = 20
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    """One model: its trees and the rows it is trained on, up to ``last`` date."""

    maxIter: int = 300
    stepSize: float = 0.05
    maxDepth: int | None = 6
    maxLeaves: int | None = None
    subsamplingRate: float = 1.0
    columnRate: float = 1.0
    l2: float = 1.0
    minLeafRows: int = 1
    seed: int = 42
    last: date | None = None

    def depth_limit(self) -> int:
        return self.maxDepth if self.maxDepth is not None else 1 << 30


# ---- trees -----------------------------------------------------------------------

@dataclass
class Node:
    depth: int
    gradient: int
    n: int
    split: tuple | None = None  # gain, feature, bin, missing left, gradient left, n left
    known: bool = False
    left: int = -1
    right: int = -1


def chosen(nodes: list[Node], s: Settings) -> list[int]:
    """Nodes to split: all that gain, or the best first up to ``maxLeaves``.

    A node whose children aren't evaluated yet is chosen on what is known; the
    choice is final once all chosen nodes' children are.
    """
    if s.maxLeaves is None:
        return [k for k, node in enumerate(nodes) if node.split]
    heap, out = [], []
    push = lambda k: nodes[k].split and heapq.heappush(heap, (-nodes[k].split[0], k))
    push(0)
    while heap and len(out) < s.maxLeaves - 1:
        _, k = heapq.heappop(heap)
        out.append(k)
        if nodes[k].left >= 0:
            push(nodes[k].left)
            push(nodes[k].right)
    return out


def open_children(nodes: list[Node], s: Settings) -> list[int]:
    """Makes the children of newly chosen nodes; those that may split in turn."""
    out = []
    for k in chosen(nodes, s):
        node = nodes[k]
        if node.left < 0:
            _, _, _, _, gradient, n = node.split
            node.left, node.right = len(nodes), len(nodes) + 1
            nodes += [Node(node.depth + 1, gradient, n),
                      Node(node.depth + 1, node.gradient - gradient, node.n - n)]
            for child in (node.left, node.right):
                if nodes[child].depth < s.depth_limit() and nodes[child].n >= 2 * s.minLeafRows:
                    out.append(child)
    return out


@dataclass(frozen=True)
class Layout:
    """Where each feature's bins lie in a histogram."""

    sizes: tuple[int, ...]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes)))[:-1].astype(np.int64)

    @property
    def total(self) -> int:
        return int(sum(self.sizes))

    def only(self, columns: np.ndarray) -> Layout:
        return Layout(tuple(self.sizes[c] for c in columns.tolist()))


def up_to(sums: np.ndarray, layout: Layout) -> np.ndarray:
    """Sums of each histogram from a feature's first bin to each of its bins."""
    out = np.cumsum(sums, axis=1)
    before = out[:, layout.starts[1:] - 1]
    for k, (at, size) in enumerate(zip(layout.starts[1:].tolist(), layout.sizes[1:], strict=True)):
        out[:, at:at + size] -= before[:, k:k + 1]
    return out


def unpacked(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient sums and counts that share whole numbers."""
    n = (both + (1 << (_COUNT_BITS - 1))) >> _COUNT_BITS
    return both - (n << _COUNT_BITS), n


def best_splits(g_left: np.ndarray, n_left: np.ndarray, layout: Layout,
                columns: np.ndarray, s: Settings, unit: float) -> list[tuple | None]:
    """The best split of each node from the sums ``up_to`` each bin of ``columns``.

    Ties go by feature and bin. Missing values are tried on the right where a
    node has any; they lie left of the other bins.
    """
    starts, sizes = layout.starts, np.array(layout.sizes)
    g_all, n_all = (h[:, sizes[0] - 1:sizes[0]] for h in (g_left, n_left))
    total, low = g_all * unit, max(s.minLeafRows, 1)
    least = total * total / np.maximum(n_all + s.l2, 1e-300)

    def gains(g: np.ndarray, n: np.ndarray) -> np.ndarray:
        a, rest = g * unit, n_all - n
        b = total - a
        a *= a
        b *= b
        with np.errstate(divide="ignore", invalid="ignore"):
            a /= n + s.l2
            b /= rest + s.l2
        a += b
        a -= least
        # A side without rows gains nothing, unless it is divided by none.
        if low > 1 or s.l2 <= 0:
            np.putmask(a, np.minimum(n, rest) < low, -np.inf)
        return a
    gain = gains(g_left, n_left)
    at = gain.argmax(1)
    best = gain[np.arange(len(gain)), at]
    found = [(float(x), k, True) for x, k in zip(best, at.tolist(), strict=True)]
    gaps = np.flatnonzero((n_left[:, starts] > 0).any(0))
    if len(gaps):
        owner = np.repeat(gaps, sizes[gaps])
        place = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in gaps])
        right = gains(*(h[:, place] - h[:, starts[owner]] for h in (g_left, n_left)))
        at = right.argmax(1)
        better = right[np.arange(len(right)), at]
        for k in np.flatnonzero(better > best).tolist():
            found[k] = (float(better[k]), int(place[at[k]]), False)
    out = []
    for k, (value, place, left) in enumerate(found):
        if not value > LEAST_GAIN:
            out.append(None)
            continue
        feature = int(np.searchsorted(starts, place, side="right")) - 1
        first = starts[feature]
        g, n = (int(h[k, place] - (0 if left else h[k, first])) for h in (g_left, n_left))
        out.append((value, int(columns[feature]), int(place - first), left, g, n))
    return out


def histograms(bins: np.ndarray, rows: np.ndarray, packed: np.ndarray, slot: np.ndarray,
               slots: int, layout: Layout, columns: np.ndarray) -> np.ndarray:
    """Gradient sums and counts, in one number, by (slot, bin) of ``columns``.

    Feature by feature, so that the sums being added to are few; at most
    ``SMALL_TABLE`` rows.
    """
    out = np.empty((slots, layout.total), np.int64)
    most, at = max(layout.sizes), np.empty(len(rows), np.int64)
    first = slot * most
    for column, start, size in zip(columns.tolist(), layout.starts.tolist(), layout.sizes,
                                   strict=True):
        np.add(first, bins[column].take(rows), out=at)
        sums = np.bincount(at, packed, slots * most).reshape(slots, most)
        out[:, start:start + size] = sums[:, :size]
    return out


@dataclass
class Turns:
    """Where rows go from each node; a last node has feature -1, right follows left."""

    feature: np.ndarray
    cut: np.ndarray
    shift: np.ndarray  # 1 where missing values go right, as bin 255 then
    left: np.ndarray

    @classmethod
    def of(cls, size: int, splits: list[tuple]) -> Turns:
        """From (node, feature, bin, missing left, left child)."""
        out = cls(np.full(size, -1), np.zeros(size, np.uint8), np.zeros(size, np.uint8),
                  np.zeros(size, np.int64))
        if splits:
            node, feature, cut, left, child = (np.array(x) for x in zip(*splits, strict=True))
            out.feature[node], out.left[node] = feature, child
            out.shift[node], out.cut[node] = 1 - left, cut - (1 - left)
        return out


def descend(bins: np.ndarray, rows: np.ndarray, at: np.ndarray, turns: Turns) -> None:
    """Moves ``rows`` from their nodes ``at`` as far down as there are turns."""
    flat, last, shifted = bins.ravel(), turns.feature < 0, turns.shift.any()
    start = turns.feature * bins.shape[1]
    deeper = bool((~last[turns.left[~last]]).any() or (~last[turns.left[~last] + 1]).any())
    go = np.flatnonzero(start.take(at) >= 0)
    while len(go):
        node = at.take(go)
        value = flat.take(start.take(node) + rows.take(go))
        if shifted:
            value -= turns.shift.take(node)
        node = turns.left.take(node) + (value > turns.cut.take(node))
        at[go] = node
        go = go[start.take(node) >= 0] if deeper else go[:0]


def turns_of(nodes: list[Node], picked: list[int]) -> Turns:
    return Turns.of(len(nodes), [(k, *nodes[k].split[1:3], int(nodes[k].split[3]), nodes[k].left)
                                 for k in picked if nodes[k].left >= 0])


def grow_here(bins: np.ndarray, rows: np.ndarray, gradient: np.ndarray, root: Node, s: Settings,
              layout: Layout, columns: np.ndarray, unit: float) -> tuple[list[Node], np.ndarray]:
    """The whole subtree below a node whose ``rows`` are all here, and their nodes in it.

    Of two siblings the smaller one's histogram is added up, the other's is
    what remains of their parent's.
    """
    nodes, wanted, count, pairs = [root], [0], [0], []
    at, packed = np.zeros(len(rows), np.int64), gradient + _COUNT_UNIT
    own = layout.only(columns)
    known: dict[int, np.ndarray] = {}
    while wanted:
        slot = np.full(len(nodes), -1)
        slot[count] = np.arange(len(count))
        here = slot.take(at)
        mine = np.flatnonzero(here >= 0)
        level = dict(zip(count, histograms(bins, rows.take(mine), packed.take(mine),
                                           here.take(mine), len(count), own, columns),
                         strict=True))
        for parent, small, large in pairs:
            level[large] = known.pop(parent) - level[small]
        some = max(1, SUMS_AT_ONCE // own.total)
        for k in range(0, len(wanted), some):
            part = wanted[k:k + some]
            left = unpacked(up_to(np.stack([level[x] for x in part]), own))
            if nodes[0].n < 0:
                nodes[0].gradient, nodes[0].n = (int(h[0, own.sizes[0] - 1]) for h in left)
            for x, split in zip(part, best_splits(*left, own, columns, s, unit), strict=True):
                nodes[x].split, nodes[x].known = split, True
                if split:
                    known[x] = level[x]
        old = len(nodes)
        wanted = open_children(nodes, s)
        opened = [k for k, node in enumerate(nodes) if node.left >= old]
        descend(bins, rows, at, turns_of(nodes, opened))
        pairs = [(k, *sorted((nodes[k].left, nodes[k].right), key=lambda c: (nodes[c].n, c)))
                 for k in opened if {nodes[k].left, nodes[k].right} & set(wanted)]
        count = [small for _, small, _ in pairs]
    return nodes, at


# ---- blocks of rows ------------------------------------------------------------------

@dataclass
class Block:
    bins: np.ndarray  # one row for each feature
    label: np.ndarray
    day: np.ndarray
    key: np.ndarray
    score: np.ndarray  # one row for each model


def _binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.searchsorted(edges, values, side="left") + 1
    return np.where(np.isnan(values), 0, out).astype(np.int64)


def find_edges(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Upper ends of each feature's bins but the last, at most ``BINS`` - 1."""
    shares = F.lit(np.array([k / BINS for k in range(1, BINS)]))  # one literal, not an array of them
    got = rows.agg(*[F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)),
                                         shares, 10_000).alias(f"e{k}")
                     for k, c in enumerate(features)]).first()
    ends = rows.agg(*[F.max(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))).alias(f"m{k}")
                      for k, c in enumerate(features)]).first()
    return [sorted({v for v in (e or []) if v < m}) for e, m in zip(got, ends, strict=True)]


def _to_blocks(features: list[str], edges: list[list[float]]):
    cuts = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                get = lambda c: part.column(part.schema.get_field_index(c)).to_numpy(
                    zero_copy_only=False)
                bins = np.stack([_binned(get(f"f{k}").astype(float), c) for k, c in
                                 enumerate(cuts)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.tobytes()], pa.binary()) for a in
                     (bins, get("label").astype(float), get("day").astype(np.int32),
                      get("key").astype(np.int64))], names=["bins", "label", "day", "key"])
    return run


def _blocks(rows: DataFrame, features: list[str], edges: list[list[float]],
            base: list[float]) -> RDD:
    width = len(features)
    packed = rows.select(
        F.col("label"), F.unix_date("date").alias("day"), F.col("key"),
        *[F.col(f"`{c}`").cast("double").alias(f"f{k}") for k, c in enumerate(features)])
    start = np.array(base)[:, None]

    def load(row) -> Block:
        label = np.frombuffer(row.label)
        return Block(np.frombuffer(row.bins, np.uint8).reshape(width, -1), label,
                     np.frombuffer(row.day, np.int32), np.frombuffer(row.key, np.uint64),
                     np.repeat(start, len(label), axis=1))
    shape = "bins binary, label binary, day binary, key binary"
    return packed.mapInArrow(_to_blocks(features, edges), shape).rdd.map(load)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of whole numbers spread over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sampled(key: np.ndarray, share: float, seed: int) -> np.ndarray:
    if share >= 1:
        return np.ones(len(key), bool)
    x = mixed(key + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    return x < np.uint64(int(share * 2**64))


def columns_of(s: Settings, number: int, width: int) -> np.ndarray:
    """The features that a tree may use, drawn once a tree."""
    n = max(1, round(s.columnRate * width))
    return np.sort(np.random.default_rng([s.seed, number]).permutation(width)[:n])


def gradients(score: np.ndarray, label: np.ndarray, unit: float) -> np.ndarray:
    most = 1 << GRADIENT_BITS
    return np.clip(np.rint((score - label) / unit), -most, most)


def _day(d: date | None) -> int:
    return 2**31 - 1 if d is None else (d - date(1970, 1, 1)).days


def _boost_here(settings: list[Settings], bases: list[float], layout: Layout, unit: float,
                spans: dict[int, tuple[int, int]], marks: set[int], kept: set[int]):
    """All trees of models whose rows are in one part, and their held-out errors.

    The trees of models that aren't ``kept`` stay behind.
    """
    width = len(layout.sizes)

    def run(pairs: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, list] = {}
        for m, part in pairs:
            held.setdefault(m, []).append(part)
        for m in sorted(held):
            s = settings[m]
            bins, label, day, key = (np.concatenate(x, axis=-1)
                                     for x in zip(*held.pop(m), strict=True))
            score = np.full(len(label), bases[m])
            train = day <= _day(s.last)
            trees, gains, errors = [], [], {}
            for number in range(s.maxIter):
                taken = train & _sampled(key, s.subsamplingRate, s.seed * 1_000_003 + number)
                rows, others = np.flatnonzero(taken), np.flatnonzero(~taken)
                nodes, at = grow_here(
                    bins, rows, gradients(score[rows], label[rows], unit),
                    Node(0, 0, -1), s, layout, columns_of(s, number, width), unit)
                tree, gain = _finished(nodes, s, unit)
                if m in kept:
                    trees.append(tree)
                    gains.append(gain)
                score[rows] += values_at(nodes, s, unit).take(at)
                score[others] += value_of(np.array(tree), bins, others)
                if number + 1 in marks and m in spans:
                    low, high = spans[m]
                    errors[number + 1] = _error(score, label, (day >= low) & (day <= high))
            yield m, trees, gains, errors
    return run


def _error(score: np.ndarray, label: np.ndarray, rows: np.ndarray) -> tuple[int, int]:
    """Exact sum of squared errors, in small units, and the number of rows."""
    error = np.rint((score[rows] - label[rows]) ** 2 * 2.0**ERROR_BITS)
    return int(error.astype(np.int64).sum()), int(rows.sum())


def _work(settings: list[Settings], trees: list[list[Node]], wanted: dict[int, list[int]],
          layout: Layout, number: int, unit: float):
    """Histograms or rows of the wanted nodes of every model from a part's blocks."""
    width = len(layout.sizes)
    day_of = [_day(s.last) for s in settings]

    def run(blocks: Iterator[Block]) -> Iterator[tuple]:
        sums: dict[tuple, list] = {}
        taken: dict[tuple, list] = {}
        for block in blocks:
            for m, nodes in wanted.items():
                s = settings[m]
                rows = np.flatnonzero((block.day <= day_of[m]) & _sampled(
                    block.key, s.subsamplingRate, s.seed * 1_000_003 + number))
                if not len(rows):
                    continue
                gradient = gradients(block.score[m, rows], block.label[rows], unit)
                at = np.zeros(len(rows), np.int64)
                descend(block.bins, rows, at, turns_of(trees[m], chosen(trees[m], s)))
                columns = columns_of(s, number, width)
                large = [k for k in nodes if not 0 <= trees[m][k].n <= SMALL_NODE]
                if large:
                    slot = np.full(len(trees[m]), -1)
                    slot[large] = np.arange(len(large))
                    mine = np.flatnonzero(slot[at] >= 0)
                    g, n = unpacked(histograms(
                        block.bins, rows[mine], gradient[mine] + _COUNT_UNIT, slot[at[mine]],
                        len(large), layout.only(columns), columns))
                    for k, node in enumerate(large):
                        if (m, node) in sums:
                            sums[m, node][0] += g[k]
                            sums[m, node][1] += n[k]
                        else:
                            sums[m, node] = [g[k].copy(), n[k].copy()]
                for node in set(nodes) - set(large):
                    own = at == node
                    taken.setdefault((m, node), []).append(
                        (block.bins[:, rows[own]], gradient[own].astype(np.int32)))
        yield from ((k, ("sums", v)) for k, v in sums.items())
        for k, parts in taken.items():
            yield k, ("rows", [np.concatenate(x, axis=-1) for x in zip(*parts, strict=True)])
    return run


def _decide(settings: list[Settings], trees: list[list[Node]], layout: Layout, number: int,
            unit: float):
    """The best split of a node, or the subtree below it, from all parts' shares."""
    width = len(layout.sizes)

    def run(shares: Iterator[tuple]) -> Iterator[tuple]:
        sums: dict[tuple, list] = {}
        taken: dict[tuple, list] = {}
        for key, (kind, value) in shares:
            if kind == "rows":
                taken.setdefault(key, []).append(value)
            elif key in sums:
                sums[key][0] += value[0]
                sums[key][1] += value[1]
            else:
                sums[key] = [value[0].copy(), value[1].copy()]
        for (m, node), (g, n) in sums.items():
            s = settings[m]
            columns = columns_of(s, number, width)
            own = layout.only(columns)
            split = best_splits(up_to(g[None], own), up_to(n[None], own), own, columns, s, unit)[0]
            size = own.sizes[0]
            yield m, node, [Node(trees[m][node].depth, int(g[:size].sum()), int(n[:size].sum()),
                                 split, True)]
        for (m, node), parts in taken.items():
            s = settings[m]
            bins, gradient = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
            root = replace(trees[m][node], left=-1, right=-1)
            yield m, node, grow_here(bins, np.arange(bins.shape[1]), gradient, root, s, layout,
                                     columns_of(s, number, width), unit)[0]
    return run


def _graft(nodes: list[Node], at: int, subtree: list[Node]) -> None:
    """Puts an evaluated node, with what is known below it, in its place."""
    place = {0: at, **{k: len(nodes) + k - 1 for k in range(1, len(subtree))}}
    for k, node in enumerate(subtree):
        moved = replace(node, left=place.get(node.left, -1), right=place.get(node.right, -1))
        if k:
            nodes.append(moved)
        else:
            nodes[at] = moved


# ---- fitted models ------------------------------------------------------------------------

@dataclass
class BoostedTrees:
    """A fitted model: ``transform`` adds ``prediction`` to rows with the features."""

    #: Tells a saved model's kind.
    format: ClassVar[str] = "trees"

    features: list[str]
    edges: list[list[float]]
    base: float
    settings: Settings
    trees: list[list[tuple]] = field(default_factory=list)
    gains: list[list[float]] = field(default_factory=list)

    def first(self, n: int) -> BoostedTrees:
        """The model after ``n`` trees: later ones don't change earlier ones."""
        return replace(self, settings=replace(self.settings, maxIter=n),
                       trees=self.trees[:n], gains=self.gains[:n])

    def importances(self) -> list[float]:
        """Mean gain of each feature's splits, as shares of one."""
        total, n = np.zeros(len(self.features)), np.zeros(len(self.features))
        for tree, gains in zip(self.trees, self.gains, strict=True):
            for node, gain in zip(tree, gains, strict=True):
                if node[0] >= 0:
                    total[node[0]] += gain
                    n[node[0]] += 1
        mean = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
        return (mean / (mean.sum() or 1.0)).tolist()

    def scorer(self) -> Callable[[list[np.ndarray]], np.ndarray]:
        cuts = [np.array(e) for e in self.edges]
        tables = [np.array(t) for t in self.trees]

        def score(values: list[np.ndarray]) -> np.ndarray:
            bins = np.stack([_binned(v.astype(float), c)
                             for v, c in zip(values, cuts, strict=True)]).astype(np.uint8)
            out = np.full(bins.shape[1], self.base)
            for table in tables:
                out += value_of(table, bins)
            return out
        return score

    def transform(self, df: DataFrame) -> DataFrame:
        """Missing features take the side that each split has learned for them."""
        score = self.scorer()

        @F.pandas_udf("double")
        def predict(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(score([rows.iloc[:, k].to_numpy(dtype=float, na_value=np.nan)
                                    for k in range(rows.shape[1])]))
        ship(df.sparkSession)
        return df.withColumn("prediction", predict(F.struct(
            *[F.col(f"`{c}`").cast("double").alias(f"f{k}")
              for k, c in enumerate(self.features)])))

    def save(self, spark: SparkSession, path: str) -> None:
        """One line for the model and one for each tree."""
        settings = {k: v for k, v in asdict(self.settings).items() if k != "last"}
        head = {"features": self.features, "edges": self.edges, "base": self.base,
                "settings": settings}
        lines = [(0, json.dumps(head))] + [
            (k, json.dumps([tree, gains]))
            for k, (tree, gains) in enumerate(zip(self.trees, self.gains, strict=True), 1)]
        spark.createDataFrame(lines, "number int, body string").coalesce(1) \
            .write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        lines = [r.body for r in spark.read.parquet(path).orderBy("number").collect()]
        if not lines:
            raise ModelBundleError(f"no trees at {path}")
        head, trees = json.loads(lines[0]), [json.loads(x) for x in lines[1:]]
        return cls(head["features"], head["edges"], head["base"],
                   Settings(**head["settings"]), [t for t, _ in trees], [g for _, g in trees])


def value_of(table: np.ndarray, bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """The rows' values in a tree of (feature, bin, missing left, left, right, value)."""
    rows = np.arange(bins.shape[1]) if rows is None else rows
    at, inner = np.zeros(len(rows), np.int64), np.flatnonzero(table[:, 0] >= 0)
    descend(bins, rows, at, Turns.of(len(table), [
        (k, *map(int, table[k, :4])) for k in inner.tolist()]))
    return table[:, 5].take(at)


def _leaf(node: Node, s: Settings, unit: float) -> float:
    return (-node.gradient * unit / (node.n + s.l2) if node.n else 0.0) * s.stepSize


def values_at(nodes: list[Node], s: Settings, unit: float) -> np.ndarray:
    """The finished tree's value for the rows of each node; below a leaf it is the leaf's."""
    picked, out = set(chosen(nodes, s)), np.empty(len(nodes))
    within = [False] * len(nodes)
    for k, node in enumerate(nodes):
        if not within[k]:
            out[k] = _leaf(node, s, unit)
        if node.left >= 0:
            for child in (node.left, node.right):
                within[child] = within[k] or k not in picked
                if within[child]:
                    out[child] = out[k]
    return out


def _finished(nodes: list[Node], s: Settings, unit: float) -> tuple[list[tuple], list[float]]:
    """Rows of a grown tree, parents first, and the gains of its splits."""
    picked, order = set(chosen(nodes, s)), [0]
    for k in order:
        if k in picked:
            order += [nodes[k].left, nodes[k].right]
    place = {k: i for i, k in enumerate(order)}
    rows, gains = [], []
    for k in order:
        node = nodes[k]
        if k in picked:
            gain, feature, cut, left, _, _ = node.split
            rows.append((feature, cut, int(left), place[node.left], place[node.right], 0.0))
            gains.append(gain)
        else:
            rows.append((-1, 0, 0, 0, 0, _leaf(node, s, unit)))
            gains.append(0.0)
    return rows, gains


@dataclass
class Fitted:
    models: list[BoostedTrees]
    #: Root mean squared error of (model, number of trees) over its span.
    errors: dict[tuple[int, int], float]


def fit_many(rows: DataFrame, features: list[str], settings: list[Settings],
             spans: dict[int, tuple[date, date]] | None = None,
             marks: tuple[int, ...] = (), errors_only: int = 0) -> Fitted:
    """Fits all ``settings`` on ``rows`` (date, label, key, features) side by side.

    ``spans`` names held-out dates of models; their errors are taken after as
    many trees as ``marks`` say. Of the first ``errors_only`` models nothing
    else is returned: the driver need not hold their trees.
    """
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    ship(spark)
    if not spark.conf.get(CHECKPOINT_SETTING, None):
        sc.setCheckpointDir(shared_path(spark, "scores"))
    edges = find_edges(rows, features)
    layout = Layout(tuple(len(e) + 2 for e in edges))
    inside = [F.lit(True) if s.last is None else F.col("date") <= F.lit(s.last) for s in settings]
    found = rows.agg(F.max("label") - F.min("label"), F.count(F.lit(1)),
                     *[F.sum(F.when(c, F.col("label").cast("decimal(30,6)"))) for c in inside],
                     *[F.count_if(c) for c in inside]).first()
    k = len(settings)
    unit = 2.0 ** np.ceil(np.log2(max(found[0] or 0, 1e-9) * 2)) / (1 << GRADIENT_BITS)
    models = [BoostedTrees(features, edges, float(total or 0) / max(n, 1), s) for total, n, s in
              zip(found[2:2 + k], found[2 + k:], settings, strict=True)]
    days = {m: tuple(map(_day, span)) for m, span in (spans or {}).items()}
    parts = int(min(max(1, -(-found[1] // BLOCK_ROWS)), 4 * sc.defaultParallelism))
    blocks = _blocks(rows.repartition(parts), features, edges, [m.base for m in models])
    if found[1] <= SMALL_TABLE:
        errors = _fit_small(blocks, models, layout, unit, days, set(marks), errors_only)
    else:
        errors = _fit_large(blocks, models, layout, unit, days, set(marks), parts,
                            errors_only)
    return Fitted(models, {key: (s / n / 2**ERROR_BITS) ** 0.5 if n else float("nan")
                           for key, (s, n) in errors.items()})


def _fit_small(blocks: RDD, models: list[BoostedTrees], layout: Layout, unit: float,
               days: dict, marks: set[int], errors_only: int) -> dict:
    """Each model's rows, up to its last held-out day, to a task of its own."""
    settings = [m.settings for m in models]
    until = [max(_day(s.last), days.get(m, (0, -1))[1]) for m, s in enumerate(settings)]
    # The costly models first, so that no long one is left for the end.
    order = sorted(range(len(models)), key=lambda m: (
        -settings[m].maxIter * (settings[m].maxDepth or 8) * min(until[m], 1 << 20), m))
    place = {m: k for k, m in enumerate(order)}

    def deal(block: Block) -> Iterator[tuple]:
        for m in range(len(settings)):
            rows = block.day <= until[m]
            if rows.any():
                yield m, (block.bins[:, rows], block.label[rows], block.day[rows], block.key[rows])

    done = blocks.flatMap(deal).partitionBy(len(models), place.__getitem__).mapPartitions(
        _boost_here(settings, [m.base for m in models], layout, unit, days, marks,
                    set(range(errors_only, len(models))))).collect()
    errors = {}
    for m, trees, gains, found in done:
        models[m].trees, models[m].gains = trees, gains
        errors |= {(m, number): e for number, e in found.items()}
    return errors


def _fit_large(blocks: RDD, models: list[BoostedTrees], layout: Layout, unit: float,
               days: dict, marks: set[int], parts: int, errors_only: int) -> dict:
    """One job a level for all models; the rows stay where they are."""
    settings, level = [m.settings for m in models], StorageLevel.MEMORY_AND_DISK
    blocks, errors = blocks.persist(level), {}
    for number in range(max(s.maxIter for s in settings)):
        active = [m for m, s in enumerate(settings) if number < s.maxIter]
        trees = [[Node(0, 0, -1)] for _ in settings]
        wanted = {m: [0] for m in active}
        while wanted:
            shares = blocks.mapPartitions(_work(settings, trees, wanted, layout, number, unit))
            decided = shares.partitionBy(min(sum(map(len, wanted.values())), parts), hash) \
                .mapPartitions(_decide(settings, trees, layout, number, unit)).collect()
            for m, at, subtree in sorted(decided, key=lambda d: d[:2]):
                _graft(trees[m], at, subtree)
            wanted = {m: nodes for m in wanted if (nodes := open_children(
                trees[m], settings[m]))}
        tables: dict[int, np.ndarray] = {}
        for m in active:
            tree, gains = _finished(trees[m], settings[m], unit)
            if m >= errors_only:
                models[m].trees.append(tree)
                models[m].gains.append(gains)
            tables[m] = np.array(tree)
        blocks = _next(blocks, tables, number, level)
        if number + 1 in marks:
            found = squared_errors(blocks, {m: days[m] for m in active if m in days})
            errors |= {(m, number + 1): e for m, e in found.items()}
    blocks.unpersist()
    return errors


def _next(blocks: RDD, tables: dict[int, np.ndarray], number: int, level: StorageLevel) -> RDD:
    """The blocks with the new trees' values added to their scores."""
    def update(block: Block) -> Block:
        score = block.score.copy()
        for m, table in tables.items():
            score[m] += value_of(table, block.bins)
        return replace(block, score=score)
    after = blocks.map(update).persist(level)
    if (number + 1) % CHECKPOINT_EVERY == 0:
        after.checkpoint()
    after.foreachPartition(lambda _: None)
    blocks.unpersist()
    return after


def squared_errors(blocks: RDD, days: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Sum of squared errors and rows of each model over its days."""
    def run(part: Iterator[Block]) -> Iterator[tuple]:
        for block in part:
            for m, (low, high) in days.items():
                yield m, _error(block.score[m], block.label,
                                (block.day >= low) & (block.day <= high))
    return blocks.mapPartitions(run).reduceByKey(
        lambda a, b: (a[0] + b[0], a[1] + b[1])).collectAsMap()
