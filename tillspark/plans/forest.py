"""Random forest of regression trees, grown over binned blocks.

The settings are those of Spark ML's forest, whose passes hold and shuffle a full
histogram for every node of the deep levels, however few rows it has. Here a tree
takes only as much work as its nodes have rows: a table of at most ``SMALL_TABLE``
rows is dealt to a few tasks, each of which grows its share of the trees. Of a larger
one, tasks add up histograms of the large nodes where the rows lie, and the rows of a
node of at most ``SMALL_NODE`` rows go to one task, which grows the subtree below.

A row's weight in a tree and a node's features are drawn from hashes of the row's key,
the tree's number and the node's path, and sums are whole numbers, so either way gives
the same trees on any number of cores. A missing value lies left of all others.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, fields

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ModelBundleError
from ..session import ship
from . import boosting
from .boosting import (
    _COUNT_UNIT, GRADIENT_BITS, Block, BoostedTrees, Turns, _binned, _blocks, descend,
    gradients, mixed, unpacked,
)

#: Places of the sorted values among which the ends of bins are chosen.
PLACES = 2_048
#: Most bins of a feature, as a bin is a byte and one is for missing values.
MOST_BINS = 254
#: Trees whose nodes are spread over tasks together, and bins that a task may hold then.
TREES_AT_ONCE = 8
BINS_HELD = 1 << 23
#: A gain below this share of what it is taken from is rounding.
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class ForestSettings:
    """Spark ML's names and defaults."""

    numTrees: int = 20
    maxDepth: int = 5
    minInstancesPerNode: int = 1
    minInfoGain: float = 0.0
    maxBins: int = 32
    subsamplingRate: float = 1.0
    featureSubsetStrategy: str = "auto"
    bootstrap: bool = True
    seed: int = 42

    def features_a_node(self, width: int) -> int:
        kind = self.featureSubsetStrategy.lower()
        if kind == "auto":
            kind = "all" if self.numTrees == 1 else "onethird"
        named = {"all": width, "onethird": math.ceil(width / 3), "sqrt": math.ceil(width ** 0.5),
                 "log2": max(1, math.ceil(math.log2(width)))}
        if kind in named:
            return named[kind]
        return min(int(kind), width) if kind.isdigit() else math.ceil(float(kind) * width)


def knows(params: dict) -> bool:
    """Whether the forest here takes these parameters; Spark ML's has more."""
    return set(params) <= {f.name for f in fields(ForestSettings)} \
        and params.get("maxBins", 2) <= MOST_BINS


# ---- bins ---------------------------------------------------------------------------

def cuts_of(values: np.ndarray, bins: int) -> list[float]:
    """Ends of bins between the distinct values, as Spark ML places them.

    Midway between neighbours; if there are too many, where the rows so far are
    nearest to the next whole share.
    """
    value, count = np.unique(values, return_counts=True)
    middle = ((value[:-1] + value[1:]) / 2).tolist()
    if len(middle) < bins:
        return middle
    out, stride, so_far = [], len(values) / bins, np.cumsum(count)
    for k, cut in enumerate(middle):
        goal = stride * (len(out) + 1)
        if abs(so_far[k] - goal) < abs(so_far[k + 1] - goal) and len(out) < bins - 1:
            out.append(cut)
    return out


def find_cuts(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Each feature's ends of bins; a feature's summaries meet in a task of their own."""
    value = F.nanvl(F.col("value"), F.lit(None))
    got = rows.select(F.posexplode(F.array(*[
        F.col(f"`{c}`").cast("double") for c in features])).alias("k", "value")) \
        .groupBy("k").agg(F.percentile_approx(
            value, F.lit(np.arange(PLACES + 1) / PLACES), 10_000).alias("places")).collect()
    found = {r.k: cuts_of(np.array(r.places), bins) for r in got if r.places}
    return [found.get(k, []) for k in range(len(features))]


# ---- draws ---------------------------------------------------------------------------

def _salt(s: ForestSettings, tree: int) -> np.ndarray:
    return mixed(np.array([(s.seed * 1_000_003 + tree) % 2**64], np.uint64))


def weights(key: np.ndarray, s: ForestSettings, tree: int) -> np.ndarray:
    """How often a tree takes each row."""
    share = (mixed(key ^ _salt(s, tree)) >> np.uint64(11)) * 2.0**-53
    if not s.bootstrap:
        return (share < s.subsamplingRate).astype(np.int64)
    chance = math.exp(-s.subsamplingRate) * np.cumprod(
        [1.0, *[s.subsamplingRate / k for k in range(1, 40)]])
    return np.searchsorted(np.cumsum(chance), share, side="right")


def drawn(path: np.ndarray, s: ForestSettings, tree: int, width: int) -> np.ndarray:
    """The features that each node may use, ascending; a node is known by its path."""
    n = s.features_a_node(width)
    start = mixed(path + _salt(s, tree))[:, None]
    rank = mixed(start + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.argsort(rank, axis=1, kind="stable")[:, :n], axis=1)


# ---- splits --------------------------------------------------------------------------

class Best:
    """The best split so far of each of some nodes; the first one on ties."""

    def __init__(self, size: int, s: ForestSettings):
        self.s = s
        self.kept, self.total = np.full(size, -np.inf), np.zeros(size)
        self.feature, self.cut = np.full(size, -1), np.zeros(size, np.int64)
        self.g, self.n = np.zeros((2, size), np.int64)
        self.g_all, self.n_all = np.zeros((2, size), np.int64)

    def look(self, feature: np.ndarray, g: np.ndarray, n: np.ndarray) -> None:
        """A feature of each node: sums and counts by bin."""
        g, n = np.cumsum(g, axis=1), np.cumsum(n, axis=1)
        g_all, n_all = g[:, -1:], n[:, -1:]
        rest = n_all - n
        with np.errstate(divide="ignore", invalid="ignore"):
            kept = g.astype(float)
            kept *= kept
            kept /= n
            right = (g_all - g).astype(float)
            right *= right
            right /= rest
            kept += right
        np.putmask(kept, np.minimum(n, rest) < max(self.s.minInstancesPerNode, 1), -np.inf)
        rows, at = np.arange(len(kept)), kept.argmax(1)
        new = np.flatnonzero(kept[rows, at] > self.kept)
        at = at[new]
        self.kept[new], self.feature[new], self.cut[new] = kept[new, at], feature[new], at
        self.g[new], self.n[new] = g[new, at], n[new, at]
        self.g_all, self.n_all = g_all[:, 0], n_all[:, 0]

    def gains(self, unit: float) -> np.ndarray:
        """What each split takes from the sum of squares; 0 where there is none."""
        held = self.g_all.astype(float) ** 2 / np.maximum(self.n_all, 1)
        gain = self.kept - held
        enough = (gain > LEAST_SHARE * self.kept) & (
            gain * unit**2 >= self.s.minInfoGain * self.n_all)
        return np.where(np.isfinite(self.kept) & enough, gain * unit**2, 0.0)


@dataclass
class Sums:
    """Of some nodes' rows, feature by feature of those drawn."""

    bins: np.ndarray
    rows: np.ndarray
    slot: np.ndarray
    packed: np.ndarray  # weight times (gradient and one count)
    features: np.ndarray
    size: int

    def __iter__(self) -> Iterator[tuple]:
        flat, width, at = self.bins.ravel(), self.bins.shape[1], self.slot * self.size
        for own in np.ascontiguousarray(self.features.T):
            bin_of = flat.take(own.take(self.slot) * width + self.rows)
            both = np.bincount(at + bin_of, self.packed, len(own) * self.size)
            yield own, *unpacked(both.astype(np.int64).reshape(len(own), -1))


@dataclass
class Tree:
    """Nodes, parents first; right children follow left ones."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    importance: np.ndarray

    def turns(self) -> Turns:
        return Turns(self.feature.astype(np.int64), self.cut,
                     np.zeros(len(self.cut), np.uint8), self.left.astype(np.int64))


@dataclass
class Growth:
    """A tree while it grows; a list item for each node."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    g: list[int] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, g: np.ndarray, n: np.ndarray, path: np.ndarray) -> None:
        k = len(g)
        self.feature += [-1] * k
        self.cut += [0] * k
        self.left += [0] * k
        self.gain += [0.0] * k
        self.g += g.tolist()
        self.n += n.tolist()
        self.path += path.tolist()

    def split(self, nodes: np.ndarray, best: Best, unit: float) -> np.ndarray:
        """Splits those of ``nodes`` that gain; their left children, or -1."""
        gains, first = best.gains(unit), len(self.n)
        won = np.flatnonzero(gains > 0)
        left = np.full(len(nodes), -1)
        left[won] = first + 2 * np.arange(len(won))
        path = np.array(self.path, np.uint64)[nodes[won]] if len(won) else np.empty(0, np.uint64)
        for k, node in zip(won.tolist(), nodes[won].tolist(), strict=True):
            self.feature[node], self.cut[node] = int(best.feature[k]), int(best.cut[k])
            self.left[node], self.gain[node] = int(left[k]), float(gains[k])
        pairs = lambda a, b: np.stack([a, b], axis=1).ravel()
        self.add(*(pairs(part[won], whole[won] - part[won])
                   for part, whole in ((best.g, best.g_all), (best.n, best.n_all))),
                 pairs(path * np.uint64(2), path * np.uint64(2) + np.uint64(1)))
        return left

    def may_split(self, node: int, s: ForestSettings) -> bool:
        return self.path[node].bit_length() <= s.maxDepth \
            and self.n[node] >= 2 * max(s.minInstancesPerNode, 1)

    def graft(self, at: int, other: Growth) -> None:
        """A subtree in the place of its root."""
        move = len(self.n) - 1
        left = [k + move if f >= 0 else 0 for k, f in zip(other.left, other.feature, strict=True)]
        self.feature[at], self.cut[at], self.left[at], self.gain[at] = (
            other.feature[0], other.cut[0], left[0], other.gain[0])
        for name in ("feature", "cut", "g", "n", "path", "gain"):
            getattr(self, name).extend(getattr(other, name)[1:])
        self.left += left[1:]

    def done(self, base: float, unit: float, width: int) -> Tree:
        feature, n = np.array(self.feature, np.int16), np.array(self.n)
        value = base - np.array(self.g) * unit / np.maximum(n, 1)
        return Tree(feature, np.array(self.cut, np.uint8), np.array(self.left, np.int32),
                    np.where(feature < 0, value, 0.0), np.bincount(
                        np.maximum(feature, 0), np.array(self.gain), width))


def grow_here(bins: np.ndarray, rows: np.ndarray, weight: np.ndarray, gradient: np.ndarray,
              path: int, s: ForestSettings, tree: int, size: int, unit: float) -> Growth:
    """The subtree below the node of a path, whose rows are all here."""
    out, width, first = Growth(), len(bins), np.array([path], np.uint64)
    out.add(*(np.array([int(x.sum())]) for x in (weight * gradient, weight)), first)
    nodes, slot = np.array([0]), np.zeros(len(rows), np.int64)
    packed, flat = weight * (gradient + _COUNT_UNIT), bins.ravel()
    if not out.may_split(0, s):
        return out
    while len(nodes):
        features = drawn(np.array([out.path[k] for k in nodes.tolist()], np.uint64), s, tree, width)
        best = Best(len(nodes), s)
        for share in Sums(bins, rows, slot, packed, features, size):
            best.look(*share)
        left = out.split(nodes, best, unit)
        go = left[slot] >= 0
        rows, slot, packed = rows[go], slot[go], packed[go]
        value = flat.take(best.feature.take(slot) * bins.shape[1] + rows)
        child = left[slot] + (value > best.cut[slot])
        made = range(int(left.max()) - 2 * int((left >= 0).sum()) + 2, len(out.n)) \
            if len(rows) else range(0)
        nodes = np.array([k for k in made if out.may_split(k, s)], np.int64)
        place = np.full(len(out.n), -1)
        place[nodes] = np.arange(len(nodes))
        slot = place[child]
        go = slot >= 0
        rows, slot, packed = rows[go], slot[go], packed[go]
    return out


# ---- a model -------------------------------------------------------------------------

@dataclass
class Forest(BoostedTrees):
    """A fitted forest: ``transform`` adds the mean of its trees as ``prediction``."""

    format = "forest"

    def importances(self) -> list[float]:
        """Each feature's share of a tree's gains, as mean over the trees."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            total += tree.importance / (tree.importance.sum() or 1.0)
        return (total / (total.sum() or 1.0)).tolist()

    def scorer(self) -> Callable[[list[np.ndarray]], np.ndarray]:
        cuts, trees = [np.array(e) for e in self.edges], self.trees

        def score(values: list[np.ndarray]) -> np.ndarray:
            bins = np.stack([_binned(v.astype(float), c)
                             for v, c in zip(values, cuts, strict=True)]).astype(np.uint8)
            rows, out = np.arange(bins.shape[1]), np.zeros(bins.shape[1])
            for tree in trees:
                at = np.zeros(len(rows), np.int64)
                descend(bins, rows, at, tree.turns())
                out += tree.value.take(at)
            return out / len(trees)
        return score

    def save(self, spark: SparkSession, path: str) -> None:
        """One line for the model and one for each tree."""
        head = {"features": self.features, "edges": self.edges, "base": self.base,
                "settings": asdict(self.settings)}
        lines = [(0, json.dumps(head), None, None, None, None)] + [
            (k, json.dumps(t.importance.tolist()),
             *(bytearray(x.tobytes()) for x in (t.feature, t.cut, t.left, t.value)))
            for k, t in enumerate(self.trees, 1)]
        spark.createDataFrame(lines, "number int, body string, feature binary, cut binary, "
                              "left binary, value binary").coalesce(1) \
            .write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        lines = spark.read.parquet(path).orderBy("number").collect()
        if not lines:
            raise ModelBundleError(f"no trees at {path}")
        head = json.loads(lines[0].body)
        kinds = {"feature": np.int16, "cut": np.uint8, "left": np.int32, "value": np.float64}
        trees = [Tree(*(np.frombuffer(bytes(r[c]), kind) for c, kind in kinds.items()),
                      np.array(json.loads(r.body))) for r in lines[1:]]
        return cls(head["features"], head["edges"], head["base"],
                   ForestSettings(**head["settings"]), trees)


def fit_forest(rows: DataFrame, features: list[str], s: ForestSettings) -> Forest:
    """Fits a forest on ``rows`` (date, label, key, features)."""
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    ship(spark)
    edges = find_cuts(rows, features, s.maxBins)
    low, high, total, n = rows.agg(
        F.min("label"), F.max("label"), F.sum(F.col("label").cast("decimal(30,6)")),
        F.count(F.lit(1))).first()
    base = float(total or 0) / max(n, 1)
    unit = 2.0 ** np.ceil(np.log2(max((high or 0) - (low or 0), 1e-9) * 2)) / (1 << GRADIENT_BITS)
    parts = int(min(max(1, -(-n // boosting.BLOCK_ROWS)), 4 * sc.defaultParallelism))
    # Rows of the same key are drawn one by one.
    number = F.row_number().over(Window.partitionBy("key").orderBy(
        "date", "label", *[F.col(f"`{c}`") for c in features]))
    dealt = rows.repartition(parts, "key").withColumn("key", F.xxhash64("key", number))
    blocks = _blocks(dealt, features, edges, [base])
    size = max((len(e) for e in edges), default=0) + 2
    job = _Job(s, base, unit, size, len(features))
    if n <= boosting.SMALL_TABLE:
        trees = job.grow_small(blocks, min(s.numTrees, 2 * sc.defaultParallelism))
    else:
        trees = job.grow_large(blocks, n)
    return Forest(features, edges, base, s, trees)


@dataclass(frozen=True)
class _Job:
    s: ForestSettings
    base: float
    unit: float
    size: int
    width: int

    def _taken(self, block: Block, tree: int) -> tuple[np.ndarray, ...]:
        """The rows that a tree takes, how often, and their gradients."""
        weight = weights(block.key, self.s, tree)
        rows = np.flatnonzero(weight)
        return rows, weight[rows], gradients(block.score[0, rows], block.label[rows], self.unit)

    def grow_small(self, blocks: RDD, tasks: int) -> list[Tree]:
        """All rows to each of some tasks, which share the trees."""
        s = self.s

        def run(part: int, pairs: Iterator[tuple]) -> Iterator[tuple]:
            held = [b for _, b in pairs]
            bins, label, key = (np.concatenate([getattr(b, c) for b in held], axis=-1) if held
                                else np.empty(shape) for c, shape in (
                ("bins", (self.width, 0)), ("label", 0), ("key", 0)))
            whole = Block(bins.astype(np.uint8), label, np.empty(0), key.astype(np.uint64),
                          np.full((1, len(label)), self.base))
            for tree in range(part, s.numTrees, tasks):
                grown = grow_here(whole.bins, *self._taken(whole, tree), 1, s, tree, self.size,
                                  self.unit)
                yield tree, grown.done(self.base, self.unit, self.width)
        done = blocks.flatMap(lambda b: ((t, b) for t in range(tasks))).partitionBy(
            tasks, int).mapPartitionsWithIndex(run).collect()
        return [tree for _, tree in sorted(done, key=lambda d: d[0])]

    def grow_large(self, blocks: RDD, n: int) -> list[Tree]:
        """Groups of trees: large nodes from histograms, small ones from their rows."""
        s, blocks = self.s, blocks.persist(StorageLevel.MEMORY_AND_DISK)
        a_tree = max(1, n // boosting.SMALL_NODE) * s.features_a_node(self.width) * self.size
        group = max(1, min(TREES_AT_ONCE, BINS_HELD // a_tree))
        out = []
        for first in range(0, s.numTrees, group):
            trees = {t: Growth() for t in range(first, min(first + group, s.numTrees))}
            for t in trees.values():
                t.add(np.array([0]), np.array([n]), np.array([1], np.uint64))
            wanted = {t: [0] for t in trees}
            while wanted:
                wanted = self._level(blocks, trees, wanted)
            self._rest(blocks, trees, n)
            out += [t.done(self.base, self.unit, self.width) for t in trees.values()]
        blocks.unpersist()
        return out

    def _at(self, block: Block, rows: np.ndarray, tree: Growth) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        descend(block.bins, rows, at, tree.done(self.base, self.unit, self.width).turns())
        return at

    def _level(self, blocks: RDD, trees: dict[int, Growth], wanted: dict[int, list[int]]) -> dict:
        """Splits the wanted nodes; large children that may split in turn."""
        s, most = self.s, boosting.SMALL_NODE

        def add(part: Iterator[Block]) -> Iterator[tuple]:
            sums: dict[tuple, np.ndarray] = {}
            for block in part:
                for tree, nodes in wanted.items():
                    rows, weight, gradient = self._taken(block, tree)
                    slot = np.full(len(trees[tree].n), -1)
                    slot[nodes] = np.arange(len(nodes))
                    slot = slot[self._at(block, rows, trees[tree])]
                    mine = np.flatnonzero(slot >= 0)
                    path = np.array([trees[tree].path[k] for k in nodes], np.uint64)
                    got = np.array([(g, c) for _, g, c in Sums(
                        block.bins, rows[mine], slot[mine],
                        weight[mine] * (gradient[mine] + _COUNT_UNIT),
                        drawn(path, s, tree, self.width), self.size)])
                    for k, node in enumerate(nodes):
                        if (tree, node) in sums:
                            sums[tree, node] += got[:, :, k]
                        else:
                            sums[tree, node] = got[:, :, k].copy()
            yield from sums.items()

        def decide(total: tuple) -> tuple:
            (tree, node), sums = total
            path = np.array([trees[tree].path[node]], np.uint64)
            best = Best(1, s)
            for feature, (g, c) in zip(drawn(path, s, tree, self.width)[0], sums, strict=True):
                best.look(np.array([feature]), g[None], c[None])
            return tree, node, best
        parts = max(1, min(blocks.getNumPartitions(), sum(map(len, wanted.values()))))
        found = blocks.mapPartitions(add).reduceByKey(
            lambda a, b: a + b, parts, hash).map(decide).collect()
        out = {}
        for tree, node, best in sorted(found, key=lambda d: d[:2]):
            grown = trees[tree]
            if not node:
                grown.g[0], grown.n[0] = int(best.g_all[0]), int(best.n_all[0])
            left = int(grown.split(np.array([node]), best, self.unit)[0])
            for k in (left, left + 1) if left >= 0 else ():
                if grown.n[k] > most and grown.may_split(k, s):
                    out.setdefault(tree, []).append(k)
        return out

    def _rest(self, blocks: RDD, trees: dict[int, Growth], n: int) -> None:
        """The rows of the small nodes that may split, each node's to one task."""
        s, most = self.s, boosting.SMALL_NODE
        ends = {t: [k for k, f in enumerate(g.feature) if f < 0 and g.n[k] <= most
                    and g.may_split(k, s)] for t, g in trees.items()}

        def deal(part: Iterator[Block]) -> Iterator[tuple]:
            for block in part:
                for tree, nodes in ends.items():
                    rows, weight, gradient = self._taken(block, tree)
                    if not len(rows) or not nodes:
                        continue
                    at = self._at(block, rows, trees[tree])
                    order = np.argsort(at, kind="stable")
                    here, start = np.unique(at[order], return_index=True)
                    wanted = set(nodes)
                    for node, mine in zip(here.tolist(), np.split(order, start[1:]), strict=True):
                        if node in wanted:
                            yield (tree, node), (block.bins[:, rows[mine]], weight[mine].astype(
                                np.int16), gradient[mine].astype(np.int32))

        def grow(pairs: Iterator[tuple]) -> Iterator[tuple]:
            held: dict[tuple, list] = {}
            for key, share in pairs:
                held.setdefault(key, []).append(share)
            for tree, node in list(held):
                bins, weight, gradient = (np.concatenate(x, axis=-1) for x in zip(
                    *held.pop((tree, node)), strict=True))
                yield tree, node, grow_here(
                    bins, np.arange(len(weight)), weight.astype(np.int64), gradient.astype(float),
                    trees[tree].path[node], s, tree, self.size, self.unit)
        parts = max(1, -(-len(trees) * n // (4 * most)))
        for tree, node, grown in sorted(blocks.mapPartitions(deal).partitionBy(
                parts, hash).mapPartitions(grow).collect(), key=lambda d: d[:2]):
            trees[tree].graft(node, grown)
