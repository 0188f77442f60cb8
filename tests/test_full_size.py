"""Model queries run their operators at full size; equal rows are explained once."""

import inspect
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from catalog import modelling
from catalog.base import REGISTRY
from panelsift.models import attribution, clusters, compare, detection, forest


class Called(Exception):
    pass


class Given:
    """Inputs whose views are not read; embeddings have five dimensions."""

    def __init__(self, spark):
        self.spark = spark

    def view(self, name):
        return self.spark.range(1)

    def table(self, name):
        return self.spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, None)], "vec_id bigint, embedding array<float>")


def arguments(spark, monkeypatch, module, name, query):
    """What the query gives to the operator, defaults included."""
    kinds = inspect.signature(getattr(module, name))

    def record(*args, **named):
        bound = kinds.bind(*args, **named)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(module, name, record)
    monkeypatch.setattr(modelling.linear, "build_linear_baseline", lambda *a: (None, None, None))
    with pytest.raises(Called) as e:
        REGISTRY[query].run(Given(spark))
    return SimpleNamespace(**e.value.args[0])


@pytest.mark.parametrize("query", ["m5_random_forest", "m8_overfit_check", "m10_shap_importance", "j10_importance_joins"])
def test_forests_have_their_default_size(spark, monkeypatch, query):
    a = arguments(spark, monkeypatch, forest, "build_random_forest_model", query)
    assert (a.n_estimators, a.max_depth, a.n_splits, a.feature_cols) == (100, 10, 5, modelling.MODELLED)


@pytest.mark.parametrize("query", ["m9_model_comparison", "m11_stakeholder_report", "m12_significant_features"])
def test_comparisons_have_their_default_size(spark, monkeypatch, query):
    a = arguments(spark, monkeypatch, compare, "run_all_models", query)
    assert (a.rf_n_estimators, a.rf_max_depth, a.n_splits, a.feature_cols) == (100, 10, 5, modelling.MODELLED)


@pytest.mark.parametrize("query, module, name", [("m13_clusters", clusters, "behaviour_clusters"), ("m18_outlier_scores", detection, "outlier_scores")])
def test_all_dimensions_of_embeddings_are_used(spark, monkeypatch, query, module, name):
    a = arguments(spark, monkeypatch, module, name, query)
    assert list(a.features) == [f"x{i}" for i in range(5)]
    got = {tuple(r) for r in a.df.select("vec_id", *a.features).collect()}
    assert got == {(1, 1.0, 2.0, 3.0, 4.0, 5.0), (2, *[None] * 5)}


def test_equal_rows_are_explained_once_and_count_each(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(a + b * (i % 3))) for i, (a, b) in enumerate(rng.integers(0, 3, (400, 2)))]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0)], "u double, v double, y double")
    vectors = forest.assembled(df, ["u", "v"], {"label": F.col("y")})
    model = RandomForestRegressor(numTrees=4, maxDepth=4, seed=1).fit(vectors)
    once, _ = attribution.attribution_rows(df, model, ["u", "v"], counted=True)
    assert once.count() == 9 and once.agg(F.sum("n")).first()[0] == 400
    each, _ = attribution.attribution_rows(df, model, ["u", "v"])
    means = each.agg(F.avg(F.abs("a0")), F.avg(F.abs("a1")), F.avg("a0"), F.avg("a1")).first()
    got = {r.feature: r for r in attribution.shap_importance(df, model, ["u", "v"]).collect()}
    assert [got["u"].shap_importance, got["v"].shap_importance, got["u"].shap_mean, got["v"].shap_mean] == pytest.approx(list(means))
