"""Exact tree attributions of forest predictions, averaged per feature.

The attribution of a leaf to the features on its path is the Shapley value of a
product game. Its multilinear form is a polynomial in one variable, so a Gauss
rule with half as many points as the path is long integrates it exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsift.columns import c
from panelsift.models.cells import binned
from panelsift.operators.aggregates import hash_sample
from panelsift.session import scratch_path

NEUTRAL = 0.001  # fixed value: smaller mean effects count as neutral


@dataclass
class Leaves:
    """Leaves of one tree: value, and per path feature its interval and cover share."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def forest_leaves(model, spark) -> tuple[list[Leaves], float]:
    """Leaf tables of a fitted forest and its mean prediction, from its saved nodes.

    The size is bounded by the model (trees times leaves), not by any data.
    """
    path = scratch_path(spark, "forest")
    model.write().save(path)
    nodes: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(row.treeID, {})[row.nodeData.id] = row.nodeData
    trees, expected = [], 0.0
    for tree in nodes.values():
        leaves = list(_walk(tree, 0, 1.0, {}))
        depth = max((len(p) for _, p in leaves), default=0) or 1
        table = Leaves(
            np.array([v for v, _ in leaves]) / len(nodes),
            np.zeros((len(leaves), depth), dtype=int),
            np.full((len(leaves), depth), -np.inf),
            np.full((len(leaves), depth), np.inf),
            np.ones((len(leaves), depth)),
        )
        for i, (_, used) in enumerate(leaves):
            for d, (feature, (low, high, share)) in enumerate(used.items()):
                table.feature[i, d] = feature
                table.low[i, d], table.high[i, d] = low, high
                table.share[i, d] = share
        expected += float((table.value * table.share.prod(axis=1)).sum())
        trees.append(table)
    return trees, expected


def _walk(tree: dict, node_id: int, weight: float, used: dict) -> Iterator[tuple[float, dict]]:
    """Every leaf with the features on its path as (low, high, share of cover)."""
    node = tree[node_id]
    if node.leftChild < 0:
        yield node.prediction, used
        return
    feature = node.split.featureIndex
    cut = node.split.leftCategoriesOrThreshold[0]
    low, high, share = used.get(feature, (-np.inf, np.inf, 1.0))
    for child, bounds in ((node.leftChild, (low, min(high, cut))), (node.rightChild, (max(low, cut), high))):
        part = tree[child].rawCount / node.rawCount
        yield from _walk(tree, child, weight, {**used, feature: (*bounds, share * part)})


def attributions(trees: Sequence[Leaves], x: np.ndarray) -> np.ndarray:
    """Attribution of each row's prediction to each column of x."""
    result = np.zeros(x.shape)
    for t in trees:
        points, weights = np.polynomial.legendre.leggauss((t.feature.shape[1] + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        values = x[:, t.feature]
        inside = ((values > t.low) & (values <= t.high)).astype(float)
        gain = inside - t.share
        parts = np.zeros(inside.shape)
        for point, weight in zip(points, weights):
            factor = t.share + point * gain
            parts += weight * factor.prod(axis=2, keepdims=True) / factor
        parts *= gain * t.value[None, :, None]
        for d in range(t.feature.shape[1]):
            onto = np.zeros((t.feature.shape[0], x.shape[1]))
            onto[np.arange(len(onto)), t.feature[:, d]] = 1.0
            result += parts[:, :, d] @ onto
    return result


def tree_cuts(trees: Sequence[Leaves], width: int) -> list[list[float]]:
    """The cuts by which any tree splits each feature, in order."""
    cuts: list[set[float]] = [set() for _ in range(width)]
    for t in trees:
        for bound in (t.low, t.high):
            for leaf, d in zip(*np.nonzero(np.isfinite(bound))):
                cuts[t.feature[leaf, d]].add(float(bound[leaf, d]))
    return [sorted(c) for c in cuts]


def attribution_rows(
    df: DataFrame, model, feature_cols: Sequence[str], sample_size: int | None = None,
    seed: int = 42, keys: Sequence[str] = (), counted: bool = False,
) -> tuple[DataFrame, float]:
    """One column ``a<i>`` per feature and row, the prediction parts; and the base value.

    Every complete row is explained unless ``sample_size`` asks for fewer. ``counted``
    explains rows between the same cuts of all trees once, as no tree tells them apart, and
    adds how many they are as ``n``.
    """
    names = list(feature_cols)
    spark = df.sparkSession
    trees, base = forest_leaves(model, spark)
    complete = df.dropna(subset=names)
    if sample_size is not None:
        complete = hash_sample(complete, sample_size, keys, seed)
    rows = complete.select(*[c(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])
    if sample_size is not None:
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    if counted:
        met = [f"x{i}" for i in range(len(names))]
        at = [f"b{i}" for i in range(len(names))]
        cuts = tree_cuts(trees, len(names))
        # a bin includes its upper cut, which stands for it
        ends = [F.get(F.lit([*t, float("inf")]), b) for t, b in zip(cuts, at)]
        rows = binned(rows, met, cuts, at).groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.select(*[e.alias(x) for e, x in zip(ends, met)], "n")
        # few and small rows, but each costs every tree: adaptive execution must not merge them
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(trees)
    columns = [f"a{i}" for i in range(len(names))]
    kept = ["n"] if counted else []

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                x = part.drop(columns=kept).to_numpy(float)
                made = pd.DataFrame(attributions(shared.value, x), columns=columns)
                yield made.assign(**{n: part[n].to_numpy() for n in kept})

    schema = [*(f"{n} double" for n in columns), *(f"{n} bigint" for n in kept)]
    return rows.mapInPandas(explain, ", ".join(schema)), base


def shap_importance(
    df: DataFrame, model, feature_cols: Sequence[str], sample_size: int | None = None,
    seed: int = 42, keys: Sequence[str] = (),
) -> DataFrame:
    """Mean absolute and mean attribution per feature, its direction and rank."""
    from panelsift.models.compare import with_rank

    parts, _ = attribution_rows(df, model, feature_cols, sample_size, seed, keys, counted=True)
    rows, sums = F.sum("n"), []
    for i in range(len(feature_cols)):
        a = F.col(f"a{i}")
        sums += [(F.sum(F.abs(a) * F.col("n")) / rows).alias(f"b{i}"), (F.sum(a * F.col("n")) / rows).alias(f"m{i}")]
    table = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                F.col(f"b{i}").alias("shap_importance"),
                F.col(f"m{i}").alias("shap_mean"),
            )
            for i, n in enumerate(feature_cols)
        ]
    )
    rows = parts.agg(*sums).select(F.inline(table))
    direction = (
        F.when(F.col("shap_mean") > NEUTRAL, "↑ Increases")
        .when(F.col("shap_mean") < -NEUTRAL, "↓ Decreases")
        .otherwise("→ Neutral")
    )
    ranked = with_rank(rows.withColumn("shap_direction", direction), F.col("shap_importance"), "shap_rank")
    return ranked.orderBy(F.col("shap_importance").desc(), "feature")
