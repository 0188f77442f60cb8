"""Trees grown on counted cells: of a row a tree sees no more than the bins of its features.

Candidate cuts are chosen once, as MLlib chooses them, and leave a feature at most MAX_BINS
bins. Rows of equal bins, label and fold are one cell with a count. A bootstrap weight of a
cell is one Poisson draw of its count, which is the sum of one draw for each of its rows, so
forests have the law they have on rows. Each tree is grown in one task, level by level from
histograms, with MLlib's rules for gain, least leaf, leaves and pruning.

The number of cells is bounded by bins, labels and folds, not by rows; where it is large all
the same (many features, an outcome of any real value), callers grow on rows with MLlib.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsift.session import materialise, scratch_path

MAX_BINS = 32  # MLlib's default
# a task holds all cells: about 100 bytes each
MOST_CELLS = 1_000_000
# values of a feature that a task tells apart, and how many times as many before it thins them
POINTS = 2_000
HELD = 10
# histogram entries of a group of nodes, at a few numbers of 8 bytes each
MOST_ENTRIES = 2_000_000
TASKS_OF_A_CORE = 4
PURE = 2.0**-52  # MLlib's epsilon: nodes below it are not split


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int = MAX_BINS) -> np.ndarray:
    """Cuts between distinct values in order: all of them if few, else about equal shares apart."""
    middles = values[:-1] / 2 + values[1:] / 2
    if len(middles) < bins:
        return np.unique(middles)
    stride = counts.sum() / bins
    cuts, seen, target = [], counts[0], stride
    for i in range(1, len(values)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            cuts.append(middles[i - 1])
            target += stride
    return np.unique(cuts)


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with the sums of their counts."""
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct))


def _thinned(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most so many values, each with an equal share of the counts; few values as they are."""
    if len(values) <= most:
        return values, counts
    places = (np.arange(most) + 0.5) * (counts.sum() / most)
    at = np.searchsorted(np.cumsum(counts), places)
    return _merged(values[at], np.full(most, counts.sum() / most))


def candidate_cuts(rows: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """Cuts of each feature, from one pass over all rows; labels are not looked at.

    A task counts the values of its rows. Of a feature with more than POINTS of them it
    keeps as many quantiles of its rows, so that a cut is off by a part of a bin at most.
    """
    width = len(names)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0), np.empty(0))] * width
        for batch in batches:
            for i, (values, counts) in enumerate(held):
                new, n = np.unique(batch.column(i).to_numpy(zero_copy_only=False), return_counts=True)
                both = _merged(np.concatenate([values, new]), np.concatenate([counts, n]))
                held[i] = _thinned(*both, POINTS) if len(both[0]) > HELD * POINTS else both
        for i, (values, counts) in enumerate(held):
            values, counts = _thinned(values, counts, POINTS)
            parts = [pa.array(np.full(len(values), i, np.int32)), pa.array(values), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(parts, ["feature", "value", "n"])

    found = rows.select(*names).mapInArrow(summarise, "feature int, value double, n double")
    # summed where tasks met the same values
    table = found.groupBy("feature", "value").agg(F.sum("n").alias("n")).toPandas().sort_values("value")
    of = [table[table["feature"] == i] for i in range(width)]
    return [thresholds(t["value"].to_numpy(float), t["n"].to_numpy(float)) for t in of]


def binned(rows: DataFrame, names: Sequence[str], cuts: Sequence[np.ndarray], out: Sequence[str]) -> DataFrame:
    """Add each feature's bin: how many of its cuts lie below the value."""
    cut = [(n, o, c) for n, o, c in zip(names, out, cuts) if len(c)]
    if cut:
        # a bucket takes its lower end, a bin its upper one
        edges = [[-math.inf, *np.nextafter(c, math.inf).tolist(), math.inf] for _, _, c in cut]
        rows = Bucketizer(
            splitsArray=edges, inputCols=[n for n, _, _ in cut], outputCols=[o for _, o, _ in cut]
        ).transform(rows)
    have = {o for _, o, _ in cut}
    return rows.withColumns({o: (F.col(o) if o in have else F.lit(0)).cast("tinyint") for o in out})


@dataclass
class Cells:
    """Distinct bin vectors, and for each cell its vector, label, fold and number of rows."""

    cuts: list[np.ndarray]
    bins: np.ndarray
    at: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    n: np.ndarray

    def totals(self, weight: np.ndarray) -> np.ndarray:
        """Sum of a number per cell over the cells of each vector."""
        return np.bincount(self.at, weight, len(self.bins))


def count_cells(rows: DataFrame, bins: Sequence[str], cuts: Sequence[np.ndarray]) -> Cells | None:
    """Cells of binned rows with label and fold; None if there are too many for one task."""
    counted = materialise(rows.groupBy(*bins, "label", "fold").agg(F.count(F.lit(1)).alias("n")))
    if counted.count() > MOST_CELLS:
        return None
    # sorted, so that draws do not depend on how rows came
    table = counted.toPandas().sort_values([*bins, "label", "fold"])
    codes = table[list(bins)].to_numpy(np.uint8).reshape(len(table), len(bins))
    if bins:
        distinct, at = np.unique(codes, axis=0, return_inverse=True)
    else:
        distinct, at = np.zeros((1, 0), np.uint8), np.zeros(len(table), int)
    return Cells(
        list(cuts), distinct, at.reshape(-1), table["label"].to_numpy(float), table["fold"].to_numpy(int),
        table["n"].to_numpy(np.int64),
    )


def _variance(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and impurity where the last axis holds weight, sum and sum of squares."""
    w = s[..., 0]
    at_least = np.where(w > 0, w, 1)
    return w, np.where(w > 0, (s[..., 2] - s[..., 1] * s[..., 1] / at_least) / at_least, 0.0)


def _gini(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and impurity where the last axis holds the weights of two classes."""
    w = s[..., 0] + s[..., 1]
    at_least = np.where(w > 0, w, 1)
    return w, np.where(w > 0, 1 - (s[..., 0] / at_least) ** 2 - (s[..., 1] / at_least) ** 2, 0.0)


IMPURITY = {"variance": _variance, "gini": _gini}
# what a leaf says; two leaves of one parent that say the same become one
SAYS = {
    "variance": lambda s: s[..., 1] / s[..., 0],
    "gini": lambda s: (s[..., 1] > s[..., 0]).astype(float),
}


@dataclass
class Tree:
    """Nodes of a tree, the root first and children after their parent; -1 marks leaves."""

    feature: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    left: np.ndarray
    right: np.ndarray
    stats: np.ndarray
    rows: np.ndarray
    impurity: np.ndarray
    gain: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each bin vector."""
        at, inner = np.zeros(len(bins), np.int32), np.arange(len(bins))
        while len(inner):
            here = at[inner]
            split = self.feature[here] >= 0
            inner, here = inner[split], here[split]
            goes_left = bins[inner, self.feature[here]] <= self.cut[here]
            at[inner] = np.where(goes_left, self.left[here], self.right[here])
        return at


def _best_splits(
    sums: np.ndarray, total: np.ndarray, sizes: Sequence[int], kind: str, min_leaf: int, allowed: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Gain, feature, cut and left side of each node's best split; the earlier one of equals."""
    m = len(sums)
    best, feature, cut = np.full(m, -np.inf), np.full(m, -1, np.int32), np.full(m, -1, np.int32)
    left = np.zeros_like(total)
    weight, impure = IMPURITY[kind](total)
    start = 0
    for f, size in enumerate(sizes):
        part, start = sums[:, start : start + size], start + size
        if size < 2:
            continue
        low = np.cumsum(part, axis=1)[:, :-1]
        high = total[:, None] - low
        wl, il = IMPURITY[kind](low)
        wr, ir = IMPURITY[kind](high)
        gain = impure[:, None] - wl / weight[:, None] * il - wr / weight[:, None] * ir
        enough = (low[..., -1] >= min_leaf) & (high[..., -1] >= min_leaf)
        gain = np.where(enough & allowed[:, f, None], gain, -np.inf)
        j = gain.argmax(axis=1)
        of_j = gain[np.arange(m), j]
        better = of_j > best
        best[better], feature[better], cut[better] = of_j[better], f, j[better]
        left[better] = low[better, j[better]]
    return best, feature, cut, left


def _node_groups(at: np.ndarray, m: int, width: int) -> Iterator[tuple[int, int, np.ndarray | slice]]:
    """Ranges of nodes whose histograms fit, with their rows."""
    most = max(1, MOST_ENTRIES // max(width, 1))
    if m <= most:
        yield 0, m, slice(None)
        return
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(0, m + most, most))
    for i, first in enumerate(range(0, m, most)):
        yield first, min(first + most, m), order[edges[i] : edges[i + 1]]


def grow(
    bins: np.ndarray,
    sizes: Sequence[int],
    stats: np.ndarray,
    rows: np.ndarray,
    kind: str,
    depth: int,
    min_leaf: int,
    choose: Callable[[int], np.ndarray] | None = None,
) -> Tree:
    """One tree on bin vectors with the sums of their rows.

    ``rows`` are counts, for the least leaf; ``stats`` what the impurity needs. ``choose``
    says for a number of nodes which features each may be split by.
    """
    used = np.flatnonzero(rows > 0)
    x, values = bins[used], np.column_stack([stats[used], rows[used]]).astype(float)
    starts = np.cumsum([0, *sizes])
    width, k = int(starts[-1]), values.shape[1]
    keys = x.astype(np.int64) + starts[:-1]
    at = np.zeros(len(used), np.int64)
    live, total = np.zeros(1, np.int64), values.sum(axis=0)[None]
    nodes, splits, made = [total], [], 1
    for _ in range(depth):
        if len(live) == 0 or width == 0:
            break
        m = len(live)
        gain, feature, cut = np.empty(m), np.empty(m, np.int32), np.empty(m, np.int32)
        left = np.empty_like(total)
        allowed = np.ones((m, len(sizes)), bool) if choose is None else choose(m)
        for first, last, own in _node_groups(at, m, width):
            key = ((at[own] - first)[:, None] * width + keys[own]).ravel()
            count = (last - first) * width
            sums = np.stack(
                [np.bincount(key, np.repeat(values[own, j], len(sizes)), count) for j in range(k)], axis=-1
            ).reshape(last - first, width, k)
            part = _best_splits(sums, total[first:last], sizes, kind, min_leaf, allowed[first:last])
            gain[first:last], feature[first:last], cut[first:last], left[first:last] = part
        split = np.flatnonzero(gain > 0)
        sides = np.stack([left[split], total[split] - left[split]], axis=1).reshape(-1, k)
        ids = made + np.arange(len(sides))
        splits.append((live[split], feature[split], cut[split], ids[0::2], gain[split]))
        nodes.append(sides)
        made += len(sides)
        # children that are pure stay leaves; rows go on with the others
        impure = np.abs(IMPURITY[kind](sides)[1]) >= PURE
        place = np.full(len(sides), -1)
        place[impure] = np.arange(impure.sum())
        child = np.full(m, -1)
        child[split] = 2 * np.arange(len(split))
        goes_right = x[np.arange(len(x)), feature[at]] > cut[at]
        at = np.where(child[at] >= 0, place[child[at] + goes_right] if len(place) else -1, -1)
        stays = at >= 0
        at, x, values, keys = at[stays], x[stays], values[stays], keys[stays]
        live, total = ids[impure], sides[impure]
    sums = np.concatenate(nodes)
    tree = Tree(
        *(np.full(made, -1, np.int32) for _ in range(4)), sums[:, :-1], sums[:, -1].astype(np.int64),
        IMPURITY[kind](sums)[1], np.full(made, -1.0),
    )
    for node, feature, cut, first, gain in splits:
        tree.feature[node], tree.cut[node], tree.gain[node] = feature, cut, gain
        tree.left[node], tree.right[node] = first, first + 1
    return _pruned(tree, SAYS[kind](tree.stats))


def _pruned(tree: Tree, says: np.ndarray) -> Tree:
    """Leaves of one parent that say the same are taken back, from the deepest up."""
    for i in range(len(tree.feature) - 1, -1, -1):
        a, b = tree.left[i], tree.right[i]
        if a >= 0 and tree.left[a] < 0 and tree.left[b] < 0 and says[a] == says[b]:
            tree.feature[i] = tree.cut[i] = tree.left[i] = tree.right[i] = -1
            tree.gain[i] = -1.0
    return tree


def _sizes(cells: Cells) -> list[int]:
    return [len(c) + 1 for c in cells.cuts]


def _spread_out(spark: SparkSession, work: Callable, jobs: Sequence) -> list:
    """Results of independent jobs, in their order, a few tasks a core."""
    context = spark.sparkContext
    tasks = max(1, min(len(jobs), TASKS_OF_A_CORE * context.defaultParallelism))
    return context.parallelize(jobs, tasks).map(work).collect()


def regression_forests(
    spark: SparkSession, cells: Cells, folds: Sequence[int], trees: int, depth: int, min_leaf: int, seed: int
) -> list[list[Tree]]:
    """For each fold a forest on the rows of the others; every feature may split any node."""
    shared = spark.sparkContext.broadcast(cells)

    def one(job: tuple[int, int]) -> Tree:
        fold, tree = job
        c = shared.value
        rng = np.random.default_rng([seed, fold, tree])
        drawn = np.where(c.fold != fold, rng.poisson(c.n), 0)
        rows = c.totals(drawn)
        stats = np.column_stack([rows, c.totals(drawn * c.label), c.totals(drawn * c.label * c.label)])
        return grow(c.bins, _sizes(c), stats, rows, "variance", depth, min_leaf)

    grown = _spread_out(spark, one, [(f, t) for f in folds for t in range(trees)])
    shared.destroy()
    return [grown[i * trees : (i + 1) * trees] for i in range(len(folds))]


def classification_forests(
    spark: SparkSession, cells: Cells, folds: Sequence[int], weights: Sequence[Sequence[float]],
    trees: int, depth: int, min_leaf: int, seed: int,
) -> list[list[Tree]]:
    """Like :func:`regression_forests` for labels 0 and 1 with a weight each in every fold.

    A node is split by one of as many features, drawn anew, as the root of their number.
    """
    shared = spark.sparkContext.broadcast(cells)
    per_fold = dict(zip(folds, weights))

    def one(job: tuple[int, int]) -> Tree:
        fold, tree = job
        c = shared.value
        rng = np.random.default_rng([seed, fold, tree])
        drawn = np.where(c.fold != fold, rng.poisson(c.n), 0)
        sides = [c.totals(np.where(c.label == side, drawn, 0)) for side in (0, 1)]
        stats = np.column_stack([n * w for n, w in zip(sides, per_fold[fold])])
        width = c.bins.shape[1]
        taken = math.ceil(math.sqrt(width))

        def choose(m: int) -> np.ndarray:
            return rng.random((m, width)).argsort(axis=1).argsort(axis=1) < taken

        return grow(c.bins, _sizes(c), stats, sides[0] + sides[1], "gini", depth, min_leaf, choose)

    grown = _spread_out(spark, one, [(f, t) for f in folds for t in range(trees)])
    shared.destroy()
    return [grown[i * trees : (i + 1) * trees] for i in range(len(folds))]


def _regressed(stats: np.ndarray) -> np.ndarray:
    return stats[:, 1] / stats[:, 0]


def _chance(stats: np.ndarray) -> np.ndarray:
    return stats[:, 1] / (stats[:, 0] + stats[:, 1])


def forest_values(spark: SparkSession, cells: Cells, forests: Sequence[Sequence[Tree]], kind: str) -> np.ndarray:
    """What each forest says of each bin vector (one row per forest): mean label, or chance of a 1."""
    leaf = {"variance": _regressed, "gini": _chance}[kind]
    # a leaf's value is all that is read of its sums
    small = [[(t.feature, t.cut, t.left, t.right, leaf(t.stats)) for t in trees] for trees in forests]
    shared = spark.sparkContext.broadcast((cells.bins, small))
    tasks = max(1, min(len(cells.bins), TASKS_OF_A_CORE * spark.sparkContext.defaultParallelism))
    edges = np.linspace(0, len(cells.bins), tasks + 1).astype(int).tolist()

    def one(job: tuple[int, int]) -> np.ndarray:
        bins, grown = shared.value
        part = bins[job[0] : job[1]]
        out = np.zeros((len(grown), len(part)))
        for i, trees in enumerate(grown):
            for feature, cut, left, right, value in trees:
                out[i] += value[Tree(feature, cut, left, right, None, None, None, None).leaves(part)]
            out[i] /= len(trees)
        return out

    found = _spread_out(spark, one, list(zip(edges[:-1], edges[1:])))
    shared.destroy()
    return np.concatenate(found, axis=1)


def boosted_values(
    spark: SparkSession, cells: Cells, folds: Sequence[int], trees: int, depth: int, rate: float
) -> np.ndarray:
    """Chance of a 1 by boosted trees on the rows outside each fold, for each bin vector.

    Gradient boosting of the log loss as MLlib does it: the first tree is fitted to the
    labels as -1 and 1, each later one to the remaining gradient and added at the rate.
    Rows of a cell have the same gradient. A fold is one task, as trees follow each other.
    """
    shared = spark.sparkContext.broadcast(cells)

    def one(fold: int) -> np.ndarray:
        c = shared.value
        train = np.where(c.fold != fold, c.n, 0)
        no, yes = (c.totals(np.where(c.label == side, train, 0)) for side in (0, 1))
        rows, margin = no + yes, np.zeros(len(c.bins))
        a, b = np.full(len(margin), -1.0), np.full(len(margin), 1.0)
        for t in range(trees):
            stats = np.column_stack([rows, no * a + yes * b, no * a * a + yes * b * b])
            tree = grow(c.bins, _sizes(c), stats, rows, "variance", depth, 1)
            margin += (rate if t else 1.0) * _regressed(tree.stats)[tree.leaves(c.bins)]
            a, b = -4 / (1 + np.exp(-2 * margin)), 4 / (1 + np.exp(2 * margin))
        return 1 / (1 + np.exp(-2 * margin))

    found = _spread_out(spark, one, list(folds))
    shared.destroy()
    return np.stack(found)


def _preorder(tree: Tree) -> np.ndarray:
    """Nodes as MLlib numbers them: a node, its left side, its right side."""
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        if tree.left[i] >= 0:
            stack += [tree.right[i], tree.left[i]]
    return np.array(order)


def _saved(trees: Sequence[Tree], cuts: Sequence[np.ndarray]) -> pa.Table:
    """Nodes of all trees in the form in which MLlib stores them."""
    parts = []
    for t, tree in enumerate(trees):
        order = _preorder(tree)
        number = np.full(len(tree.left) + 1, -1, np.int32)  # the last entry serves the -1 of leaves
        number[order] = np.arange(len(order))
        inner = np.flatnonzero(tree.feature[order] >= 0)
        cut = [cuts[tree.feature[i]][tree.cut[i]] for i in order[inner]]
        ends = np.zeros(len(order) + 1, np.int32)
        ends[1:] = np.cumsum(tree.feature[order] >= 0)
        stats = tree.stats[order]
        split = pa.StructArray.from_arrays(
            [pa.array(tree.feature[order]), pa.ListArray.from_arrays(pa.array(ends), pa.array(cut, pa.float64())),
             pa.array(np.full(len(order), -1, np.int32))],
            ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
        )
        starts = pa.array(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32))
        node = {
            "id": pa.array(np.arange(len(order), dtype=np.int32)),
            "prediction": pa.array(SAYS["variance"](stats)),
            "impurity": pa.array(tree.impurity[order]),
            "impurityStats": pa.ListArray.from_arrays(starts, pa.array(stats.ravel())),
            "rawCount": pa.array(tree.rows[order]),
            "gain": pa.array(tree.gain[order]),
            "leftChild": pa.array(number[tree.left[order]]),
            "rightChild": pa.array(number[tree.right[order]]),
            "split": split,
        }
        which = pa.array(np.full(len(order), t, np.int32))
        data = pa.StructArray.from_arrays(list(node.values()), list(node))
        parts.append(pa.Table.from_arrays([which, data], ["treeID", "nodeData"]))
    return pa.concat_tables(parts)


def as_model(
    spark: SparkSession, trees: Sequence[Tree], cuts: Sequence[np.ndarray], grower: RandomForestRegressor
) -> RandomForestRegressionModel:
    """MLlib's model of these trees, read from its own file format, with the grower's settings."""
    path = scratch_path(spark, "grown")
    own = {p.name: v for p, v in grower._paramMap.items()}
    default = {p.name: v for p, v in grower._defaultParamMap.items()}
    forest_only = {"numTrees", "featureSubsetStrategy", "bootstrap", "subsamplingRate"}

    def described(kind: str, left_out: set[str], **more) -> str:
        return json.dumps(
            {
                "class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000),
                "sparkVersion": spark.version, "uid": f"{kind}_{uuid.uuid4().hex[:12]}",
                "paramMap": {n: v for n, v in own.items() if n not in left_out},
                "defaultParamMap": {n: v for n, v in default.items() if n not in left_out}, **more,
            }
        )

    sizes = {"numFeatures": len(cuts), "numTrees": len(trees)}
    about = described("RandomForestRegressionModel", set(), **sizes)
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(i, described("DecisionTreeRegressionModel", forest_only), 1.0) for i in range(len(trees))]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(_saved(trees, cuts)).write.parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)
