"""Behaviour clusters and filling gaps from a row's cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsift.columns import c
from panelsift.models.prepare import Scaler, fit_scaler
from panelsift.operators.skew import lookup_join
from panelsift.session import materialise


def behaviour_clusters(
    df: DataFrame, features: Sequence[str], k: int = 5, seed: int = 42, name: str = "cluster",
    restarts: int = 10,
) -> tuple[DataFrame, KMeansModel, Scaler]:
    """Add a k-means cluster on standardised features; a gap counts as the mean.

    Of ``restarts`` fits with different seeds the one with the least cost is kept.
    """
    scaler = fit_scaler(df, features)
    plain = {
        f"__k{i}": F.coalesce(
            (c(n).cast("double") - F.lit(scaler.shift[n])) / F.lit(scaler.width[n]), F.lit(0.0)
        )
        for i, n in enumerate(features)
    }
    rows = VectorAssembler(inputCols=list(plain), outputCol="__v").transform(df.withColumns(plain))
    vectors = materialise(rows.select("__v"))  # every fit reads it, and it alone
    fits = [
        KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol=name).fit(vectors)
        for i in range(restarts)
    ]
    model = min(fits, key=lambda fit: fit.summary.trainingCost)
    return model.transform(rows).drop("__v", *plain), model, scaler


def impute_by_cluster(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    cluster: str = "cluster",
) -> DataFrame:
    """Fill gaps with the cluster's mean or most frequent value (the smaller on ties).

    Values are counted per cluster before they are compared; there is one fill row
    per cluster.
    """
    means = [F.avg(c(n)).alias(f"__fill_{n}") for n in numeric]
    fills = df.groupBy(c(cluster)).agg(F.count(F.lit(1)).alias("__rows"), *means)
    for name in categorical:
        counts = (
            df.where(c(name).isNotNull()).groupBy(c(cluster), c(name)).agg(F.count(F.lit(1)).alias("n"))
        )
        best = F.min_by(c(name), F.struct(-F.col("n"), c(name)))
        fills = fills.join(counts.groupBy(c(cluster)).agg(best.alias(f"__fill_{name}")), cluster, "left")
    joined = lookup_join(df, fills, [cluster], "left")
    filled = {
        n: F.coalesce(c(n), F.col(f"`__fill_{n}`")) for n in (*numeric, *categorical)
    }
    return joined.withColumns(filled).select(*[c(n) for n in df.columns])
