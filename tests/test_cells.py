"""Trees on counted cells against MLlib's trees on the rows, and that fits take the cells."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from panelsift.models import attribution, cells, compare, detection, forest

NAMES = ["u", "v", "w"]


@pytest.fixture(scope="module")
def rows(spark):
    """Rows with many copies: two features of few values and a flag, a count as outcome."""
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.integers(0, 9, 3000), rng.integers(0, 30, 3000) / 4, rng.integers(0, 2, 3000)])
    y = np.clip(np.round(x[:, 0] / 4 + x[:, 2] * (x[:, 1] > 3) + rng.normal(size=3000) - 1), 0, 3)
    user = rng.integers(0, 200, 3000)
    table = [(int(k), float(o), *map(float, r)) for k, o, r in zip(user, y, x)]
    return spark.createDataFrame(table, "user int, y double, u double, v double, w double").repartition(3)


@pytest.fixture(scope="module")
def dealt(rows):
    return forest.fold_rows(rows, NAMES, F.col("y"), "user", 5)


def counted(dealt):
    made, binned = forest.cells_of(dealt, 3)
    assert made.n.sum() == 3000 and len(made.bins) <= 9 * 30 * 2 and binned.count() == 3000
    return made


def by_vector(made, data, model, column):
    """A model's column for each bin vector, from the rows that fall into it."""
    vectors = forest.vectors(data, 3)
    bins = cells.binned(data, ["__f0", "__f1", "__f2"], made.cuts, ["a", "b", "c"])
    found = model.transform(vectors).select("features", column).distinct().collect()
    value = {tuple(r.features.toArray()): r[column] for r in found}
    at = {(r.a, r.b, r.c): (r["__f0"], r["__f1"], r["__f2"]) for r in bins.collect()}
    return np.array([np.ravel(value[at[tuple(map(int, b))]])[-1] for b in made.bins])


def test_a_tree_on_cells_is_mllibs_tree_on_the_rows(dealt):
    made = counted(dealt)
    n = made.totals(made.n)
    stats = np.column_stack([n, made.totals(made.n * made.label), made.totals(made.n * made.label**2)])
    tree = cells.grow(made.bins, [len(c) + 1 for c in made.cuts], stats, n, "variance", 7, 10)
    model = DecisionTreeRegressor(maxDepth=7, minInstancesPerNode=10).fit(forest.vectors(dealt, 3))
    assert model.numNodes == len(cells._preorder(tree)) > 50
    got = (tree.stats[:, 1] / tree.stats[:, 0])[tree.leaves(made.bins)]
    np.testing.assert_allclose(got, by_vector(made, dealt, model, "prediction"), rtol=1e-9)


def test_a_weighted_class_tree_on_cells_is_mllibs(dealt, monkeypatch):
    monkeypatch.setattr(cells, "MOST_ENTRIES", 100)  # histograms of few nodes at a time
    two = dealt.withColumn("label", (F.col("label") > 0).cast("double"))
    made = counted(two)
    weight = {0: 0.7, 1: 1.9}
    sides = [made.totals(np.where(made.label == s, made.n, 0)) for s in (0, 1)]
    stats = np.column_stack([sides[0] * weight[0], sides[1] * weight[1]])
    tree = cells.grow(made.bins, [len(c) + 1 for c in made.cuts], stats, sides[0] + sides[1], "gini", 9, 2)
    data = forest.vectors(two, 3).withColumn("weight", F.when(F.col("label") == 1, weight[1]).otherwise(weight[0]))
    model = DecisionTreeClassifier(maxDepth=9, minInstancesPerNode=2, weightCol="weight").fit(data)
    leaf = tree.stats[tree.leaves(made.bins)]
    np.testing.assert_allclose(leaf[:, 1] / leaf.sum(axis=1), by_vector(made, two, model, "probability"), atol=1e-9)


def test_boosting_on_cells_is_mllibs(spark, dealt):
    two = dealt.withColumn("label", (F.col("label") > 0).cast("double"))
    made = counted(two)
    got = cells.boosted_values(spark, made, [3], 8, 4, 0.1)[0]
    model = GBTClassifier(maxIter=8, maxDepth=4, stepSize=0.1).fit(forest.vectors(two.where("fold <> 3"), 3))
    np.testing.assert_allclose(got, by_vector(made, two, model, "probability"), rtol=1e-7)


def test_a_grown_forest_is_a_model_with_the_same_predictions(spark, dealt):
    made = counted(dealt)
    grower = RandomForestRegressor(numTrees=6, maxDepth=5, minInstancesPerNode=10, seed=3)
    trees = cells.regression_forests(spark, made, [0, 2], 6, 5, 10, 3)
    again = cells.regression_forests(spark, made, [2], 6, 5, 10, 3)[0]
    for a, b in zip(trees[1], again):  # draws depend on seed, fold and tree only
        np.testing.assert_array_equal(a.stats, b.stats)
    values = cells.forest_values(spark, made, trees, "variance")
    model = cells.as_model(spark, trees[1], made.cuts, grower)
    np.testing.assert_allclose(values[1], by_vector(made, dealt, model, "prediction"), rtol=1e-9)
    assert (model.getNumTrees, model.numFeatures, model.getMaxDepth()) == (6, 3, 5)
    assert model.featureImportances.toArray().sum() == pytest.approx(1)
    # held-out rows have no part in a tree: the roots hold about the others' number of rows
    train = made.n[made.fold != 2].sum()
    assert abs(np.mean([t.rows[0] for t in trees[1]]) - train) < 5 * np.sqrt(train)


def test_fits_take_cells_and_rows_where_there_are_too_many(rows, monkeypatch):
    """Where every fit reads all rows again at each level of each tree, this ends in the error."""
    def refuse(*a, **k):
        raise AssertionError("fitted on rows")

    settings = dict(n_estimators=10, max_depth=4)
    with monkeypatch.context() as m:
        m.setattr(RandomForestRegressor, "fit", refuse)
        m.setattr(detection.RandomForestClassifier, "fit", refuse)
        m.setattr(detection.GBTClassifier, "fit", refuse)
        fit = forest.build_random_forest_model(rows, NAMES, "y", "user", **settings)
        made = detection.cross_validate_detectors(rows, NAMES, "y", "user", ["user"], trees=5, depth=4)
        found = {tuple(r) for r in made.scores.groupBy("kind").count().collect()}
        assert found == {("random_forest", 3000), ("gradient_boosting", 3000)}
    monkeypatch.setattr(cells, "MOST_CELLS", 0)
    other = forest.build_random_forest_model(rows, NAMES, "y", "user", **settings)
    for a, b in zip(fit.cv_scores.orderBy("fold").collect(), other.cv_scores.orderBy("fold").collect()):
        assert a.fold == b.fold and [a.train_r2, a.test_r2, a.test_mse, a.test_mae] == pytest.approx(
            [b.train_r2, b.test_r2, b.test_mse, b.test_mae], abs=0.03
        )
    old = detection.cross_validate_detectors(rows, NAMES, "y", "user", ["user"], trees=5, depth=4)
    aucs = [{(r.kind, r.fold): r.auc for r in x.folds.collect()} for x in (made, old)]
    assert aucs[0] == pytest.approx(aucs[1], abs=0.04)


def test_cuts_are_middles_or_equal_shares(spark):
    df = spark.range(0, 60_000, 1, 6).select(
        (F.col("id") % 3).cast("double").alias("few"), (F.col("id") * 0.5).alias("many"), F.lit(2.0).alias("one"),
    )
    few, many, one = cells.candidate_cuts(df, ["few", "many", "one"])
    assert few.tolist() == [0.5, 1.5] and len(one) == 0 and len(many) <= 31
    sizes = np.diff([0, *np.searchsorted(np.arange(60_000) * 0.5, many), 60_000])
    assert len(many) >= 30 and sizes.max() < 1.1 * 60_000 / 32
    at = cells.binned(df, ["few", "many", "one"], [few, many[:1], one], ["a", "b", "c"])
    assert {tuple(r) for r in at.select("few", "a", "c").distinct().collect()} == {(0.0, 0, 0), (1.0, 1, 0), (2.0, 2, 0)}
    on = spark.createDataFrame([(1.5,), (1.5000001,)], "few double")  # a value on a cut goes left
    assert [r.a for r in cells.binned(on, ["few"], [few], ["a"]).collect()] == [1, 2]


def test_values_between_the_same_cuts_are_explained_once(spark):
    rng = np.random.default_rng(4)
    table = [(float(a), float(b), float((a > 0.4) + b)) for a, b in zip(rng.random(500), rng.integers(0, 2, 500))]
    df = spark.createDataFrame(table, "u double, v double, y double")
    vectors = forest.assembled(df, ["u", "v"], {"label": F.col("y")})
    model = RandomForestRegressor(numTrees=3, maxDepth=3, seed=1).fit(vectors)
    once, _ = attribution.attribution_rows(df, model, ["u", "v"], counted=True)
    each, _ = attribution.attribution_rows(df, model, ["u", "v"])
    assert once.count() <= 70 and once.agg(F.sum("n")).first()[0] == 500
    got = once.agg(F.sum(F.abs("a0") * F.col("n")), F.sum(F.abs("a1") * F.col("n")), F.sum(F.expr("a0 * n"))).first()
    want = each.agg(F.sum(F.abs("a0")), F.sum(F.abs("a1")), F.sum("a0")).first()
    assert list(got) == pytest.approx(list(want))


def test_the_models_compared_read_their_input_once(spark, rows):
    """The input may be a long plan; each model goes through what was stored of it."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = rows.mapInArrow(count, rows.schema)
    made = compare.run_all_models(df, NAMES, "y", "user", rf_n_estimators=2, rf_max_depth=2, n_splits=2)
    assert made.comparison.count() == 3 and read.value == 3000
