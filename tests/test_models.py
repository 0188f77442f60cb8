"""Model properties: closed forms, additivity, disjoint folds, invariants."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from panelsift.models import (
    attribution, clusters, compare, detection, forest, linear, logistic, prepare,
)
from panelsift.operators.aggregates import hash_sample
from panelsift.plans import panel
from panelsift.stats import cluster
from tests.conftest import values

FEATURES = ["a=1", "b<2", "c"]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(21)
    n = 900
    x = np.column_stack([rng.integers(0, 2, n), rng.normal(size=n), rng.normal(size=n) * 3 + 10]).astype(float)
    y = np.maximum(0, np.round(x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n)))
    return x, y, rng.integers(0, 60, n)


@pytest.fixture(scope="module")
def sample_df(spark, sample):
    x, y, users = sample
    rows = [(int(u), float(v), *map(float, r)) for r, v, u in zip(x, y, users)]
    schema = "respondentPk int, wonky_study_count double, `a=1` double, `b<2` double, c double"
    return spark.createDataFrame(rows, schema)


def test_linear_against_normal_equations_and_mllib(sample, sample_df):
    x, y, _ = sample
    model, table, vifs = linear.build_linear_baseline(sample_df, FEATURES, "wonky_study_count")
    design = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    residual = y - design @ beta
    cov = np.linalg.inv(design.T @ design) * ((residual @ residual) / (len(y) - 4))
    got = {r.feature: r for r in table.collect()}
    for i, name in enumerate(FEATURES, start=1):
        assert got[name].coefficient == pytest.approx(beta[i])
        assert got[name].std_error == pytest.approx(math.sqrt(cov[i, i]))
    assert model.intercept == pytest.approx(beta[0])
    rows = forest.assembled(sample_df, FEATURES, {"label": F.col("wonky_study_count")})
    summary = LinearRegression(solver="normal").fit(rows).summary
    assert model.r2 == pytest.approx(summary.r2) and model.r2_adjusted == pytest.approx(summary.r2adj)
    explained = ((design @ beta - y.mean()) ** 2).sum() / 3
    assert model.f_statistic == pytest.approx(explained / ((residual @ residual) / (len(y) - 4)))
    one, table_of_one, _ = linear.build_linear_baseline(sample_df, FEATURES[:1], "wonky_study_count", calculate_vif=False)
    assert one.f_p_value == pytest.approx(table_of_one.first().p_value, rel=1e-9)  # F is t squared
    two, _, _ = linear.build_linear_baseline(sample_df, FEATURES[:2], "wonky_study_count", calculate_vif=False)
    free = len(y) - 3
    assert two.f_p_value == pytest.approx((1 + 2 * two.f_statistic / free) ** (-free / 2), rel=1e-9)
    for name, p in zip(FEATURES, summary.pValues):
        assert got[name].p_value == pytest.approx(p, rel=1e-6, abs=1e-12)
    assert vifs.count() == 3
    fitted = model.predict(sample_df).select(F.avg("prediction")).first()[0]
    assert fitted == pytest.approx(y.mean())


def test_linear_with_collinear_features(sample_df):
    df = sample_df.withColumn("twice", F.col("c") * 2)
    model, table, vifs = linear.build_linear_baseline(df, ["c", "twice", "a=1"], "wonky_study_count")
    alone, *_ = linear.build_linear_baseline(df, ["c", "a=1"], "wonky_study_count")
    assert model.r2 == pytest.approx(alone.r2)
    assert {r.VIF for r in vifs.where("feature IN ('c', 'twice')").collect()} == {math.inf}
    assert table.count() == 3


def test_logistic_is_the_penalised_optimum(sample, sample_df):
    x, y, _ = sample
    fit = logistic.build_logistic_regression_model(sample_df, FEATURES, "wonky_study_count", "respondentPk", n_splits=3)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    design = np.column_stack([np.ones(len(y)), z])
    target, beta = (y > 0).astype(float), np.zeros(4)
    ridge = np.diag([0.0, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + ridge
        beta += np.linalg.solve(hessian, design.T @ (target - p) - ridge @ beta)
    w = (p * (1 - p))[:, None]
    se = np.sqrt(np.diag(np.linalg.inv(z.T @ (z * w))))
    got = {r.feature: r for r in fit.importance.collect()}
    for i, name in enumerate(FEATURES):
        assert got[name].lr_coefficient == pytest.approx(beta[i + 1] / x[:, i].std(), rel=1e-3)
        assert got[name].lr_std_error == pytest.approx(se[i] / x[:, i].std(), rel=1e-3)
    assert fit.cv_scores.count() == 3
    assert all(0 <= r.accuracy <= 1 and 0.4 < r.auc <= 1 for r in fit.cv_scores.collect())


def test_forest_learns_and_reports(sample_df):
    fit = forest.build_random_forest_model(
        sample_df, FEATURES, "wonky_study_count", "respondentPk", n_estimators=10, max_depth=4, n_splits=3
    )
    rows = {r.feature: r for r in fit.importance.collect()}
    assert sum(r.rf_importance for r in rows.values()) == pytest.approx(1)
    assert rows["c"].rf_importance < min(rows["a=1"].rf_importance, rows["b<2"].rf_importance)
    assert fit.cv_scores.count() == 3
    assert fit.possible_overfit == (fit.overfit_gap > 0.1)


def test_folds_never_share_a_user(sample_df):
    folds = sample_df.withColumn("fold", prepare.group_fold("respondentPk", 5))
    per_user = folds.groupBy("respondentPk").agg(F.count_distinct("fold").alias("n"))
    assert {r.n for r in per_user.collect()} == {1}
    assert folds.select("fold").distinct().count() == 5


def test_attributions_add_up_to_the_prediction(spark, sample, sample_df):
    rows = forest.assembled(sample_df, FEATURES, {"label": F.col("wonky_study_count")})
    model = RandomForestRegressor(numTrees=7, maxDepth=5, seed=3).fit(rows)
    trees, base = attribution.forest_leaves(model, spark)
    x = sample[0][:80]
    got = attribution.attributions(trees, x)
    predicted = np.array([r.prediction for r in model.transform(rows.limit(80)).collect()])
    np.testing.assert_allclose(got.sum(axis=1) + base, predicted, rtol=1e-9)


def test_attributions_are_shapley_values(spark, sample, sample_df):
    from itertools import permutations

    rows = forest.assembled(sample_df, FEATURES, {"label": F.col("wonky_study_count")})
    model = RandomForestRegressor(numTrees=3, maxDepth=4, seed=5).fit(rows)
    trees, _ = attribution.forest_leaves(model, spark)
    x = sample[0][:4]

    def expectation(row, known):
        total = 0.0
        for t in trees:
            for leaf in range(len(t.value)):
                part = t.value[leaf]
                for d in range(t.feature.shape[1]):
                    f = t.feature[leaf, d]
                    if t.share[leaf, d] == 1.0 and np.isinf(t.low[leaf, d]) and np.isinf(t.high[leaf, d]):
                        continue
                    inside = t.low[leaf, d] < row[f] <= t.high[leaf, d]
                    part *= float(inside) if f in known else t.share[leaf, d]
                total += part
        return total

    got = attribution.attributions(trees, x)
    for r, row in enumerate(x):
        exact = np.zeros(3)
        for order in permutations(range(3)):
            for i, f in enumerate(order):
                exact[f] += expectation(row, set(order[: i + 1])) - expectation(row, set(order[:i]))
        np.testing.assert_allclose(got[r], exact / 6, atol=1e-10)


def test_all_models_compared(sample_df):
    results = compare.run_all_models(
        sample_df, [*FEATURES, "is_weekend"], rf_n_estimators=4, rf_max_depth=3, n_splits=2
    )
    assert results.feature_cols == FEATURES
    rows = results.comparison.collect()
    for name in ("linear_rank", "rf_rank", "lr_rank"):
        assert sorted(r[name] for r in rows) == [1.0, 2.0, 3.0]
    assert [r.avg_rank for r in rows] == sorted(r.avg_rank for r in rows)
    compare.run_shap_analysis(results, sample_df, sample_size=50)
    rows = results.comparison.collect()
    assert all(
        r.avg_rank == pytest.approx((r.linear_rank + r.rf_rank + r.lr_rank + r.shap_rank) / 4) for r in rows
    )
    report = compare.create_stakeholder_report(results.comparison)
    assert {"Feature", "Odds Ratio", "SHAP Direction", "VIF Flag"} <= set(report.columns)
    assert report.count() == 3
    kept = {r.feature for r in compare.get_significant_features(results.comparison).collect()}
    assert kept == {"a=1", "b<2"}


def test_models_on_features_significant_in_both_tests(sample_df):
    df = sample_df.withColumn("wonky_study_count", F.when(F.rand(1) > 0.05, F.col("wonky_study_count")))
    results = cluster.run_test_battery(df, {"all": FEATURES})
    made = panel.model_features(df, results, ["c"], rf_n_estimators=3, rf_max_depth=3, n_splits=2)
    assert made.feature_cols == ["a=1", "b<2", "c"]
    assert made.linear_model.n == df.dropna().count()


def test_ranks_share_ties(frame):
    df = compare.with_rank(frame("v double", [(2.0,), (2.0,), (9.0,), (None,)]), F.col("v"), "r")
    assert values(df, "v", "r") == [(2.0, 2.5), (2.0, 2.5), (9.0, 1.0), (None, None)]


def test_scalers(frame):
    df = frame("x double, same double", [(1.0, 5.0), (2.0, 5.0), (None, 5.0), (6.0, 5.0)])
    want = {"standard": np.array([-2, -1, 3]) / np.std([1, 2, 6]), "minmax": [0, 0.2, 1], "robust": [-0.4, 0, 1.6]}
    for method, expected in want.items():
        made, scaler = prepare.scale_features(df, ["x", "same"], method)
        got = [r.x for r in made.collect()]
        assert got[2] is None and [got[0], got[1], got[3]] == pytest.approx(list(expected))
        assert {r.same for r in made.collect()} == {0.0}
        again, _ = prepare.scale_features(df, ["x", "same"], scaler=scaler)
        assert values(again, "x") == values(made, "x")
    with pytest.raises(ValueError):
        prepare.scale_features(df, ["x"], "other")


def test_encoding_and_preparation(frame):
    df = frame("k string, b boolean, t string, y int", [("b", True, "1", 1), ("a", False, "x", 0), (None, None, "3", 1)])
    coded, _ = prepare.encode_categorical(df, ["k", "b", "absent"])
    assert values(coded, "k", "b") == [(0, 0), (1, 1), (2, 2)]
    flags, encoders = prepare.encode_categorical(df, ["k"], "onehot")
    assert "k" not in flags.columns and values(flags, "k_a", "k_b") == [(0, 0), (0, 1), (1, 0)]
    assert encoders == {"k": "onehot"}
    with pytest.raises(ValueError):
        prepare.encode_categorical(df, ["k"], "hash")
    made = prepare.prepare_features_for_modeling(df, ["k", "t", "absent"], "y", ["k", "gone"])
    assert made.feature_names == ["k", "t"] and "y" in made.data.columns
    assert [r.t for r in made.data.collect()].count(None) == 1  # not a number
    none = prepare.prepare_features_for_modeling(df, ["t"], categorical_cols=["gone"])
    assert none.encoders == {}


def test_scaling_needs_and_rare_features(frame):
    rows = [(float(i % 2), i % 5, i * 3.0, 0 if i else 1) for i in range(200)]
    df = frame("flag double, few int, wide double, rare int", rows)
    got = {r.feature: r for r in prepare.analyze_feature_scaling_needs(df, df.columns).collect()}
    assert [got[n].type for n in df.columns] == ["binary", "categorical/ordinal", "continuous", "binary"]
    assert got["wide"].scaling_recommended and not got["few"].scaling_recommended
    assert prepare.filter_rare_features(df, ["flag", "rare"], 0.01) == (["flag"], [("rare", 0.005)])


def test_clusters_and_imputation(spark, frame):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal() + 20 * (i % 2)), None if i % 9 == 0 else float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, x double, z double")
    made, _, _ = clusters.behaviour_clusters(df, ["x"], k=2)
    assert len({(r.i % 2, r.cluster) for r in made.collect()}) == 2
    filled = clusters.impute_by_cluster(made, ["z"])
    assert {(r.i % 2, r.z) for r in filled.collect()} == {(0, 0.0), (1, 1.0)}
    df = frame("cluster int, k string", [(0, "b"), (0, "a"), (0, None), (1, "c"), (1, "c"), (1, "d"), (1, None), (2, None)])
    got = values(clusters.impute_by_cluster(df, [], ["k"]), "cluster", "k")
    assert got.count((0, "a")) == 2 and got.count((1, "c")) == 3 and (2, None) in got


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boosting"])
def test_detector(sample_df, kind):
    _, scored = detection.train_detector(
        sample_df, FEATURES, "wonky_study_count", ["respondentPk"], kind, trees=8, depth=4
    )
    r = detection.evaluate_detector(scored, 0.0, 0.0).first()
    assert r.auc > 0.6 and r.meets_targets
    assert r.tp + r.fp + r.fn + r.tn == scored.count()


def test_balanced_folds_differ_by_one_user_at_most(spark):
    rng = np.random.default_rng(8)
    for sizes in ([900, 1, 1, 1], [7] * 23, list(rng.integers(1, 40, 300)), [5], []):
        rows = [(u, i) for u, n in enumerate(sizes) for i in range(int(n))] + [(None, 0)]
        df = spark.createDataFrame(rows, "u int, i int").repartition(5)
        made = prepare.with_group_folds(df, "u", 4)
        assert made.count() == len(rows) and made.where("u IS NULL AND fold IS NULL").count() == 1
        per_user = made.where("u IS NOT NULL").groupBy("u").agg(F.count_distinct("fold").alias("n"))
        assert {r.n for r in per_user.collect()} <= {1}
        found = {r.fold: r["count"] for r in made.where("u IS NOT NULL").groupBy("fold").count().collect()}
        load = [found.get(f, 0) for f in range(4)]
        assert set(found) <= set(range(4)) and max(load) - min(load) <= max(sizes, default=0)
        again = prepare.with_group_folds(df.repartition(2), "u", 4)
        assert values(again.distinct(), "u", "fold") == values(made.distinct(), "u", "fold")


def test_folds_of_one_user_are_refused(sample_df):
    alone = sample_df.withColumn("respondentPk", F.lit(1))
    for build in (forest.build_random_forest_model, logistic.build_logistic_regression_model):
        with pytest.raises(ValueError, match="two users"):
            build(alone, FEATURES, "wonky_study_count", "respondentPk")


def test_cross_validated_detectors_against_their_scores(sample_df):
    df = sample_df.withColumn("id", F.monotonically_increasing_id()).persist()
    made = detection.cross_validate_detectors(
        df, FEATURES, "wonky_study_count", "respondentPk", ["id", "respondentPk"], trees=6, depth=4
    )
    rows = made.scores.toPandas()
    truth = {r.id: float(r.wonky_study_count > 0) for r in df.collect()}
    for kind in detection.KINDS:
        own = rows[rows.kind == kind]
        assert sorted(own.id) == sorted(truth) and all(truth[i] == y for i, y in zip(own.id, own.label))
        assert own.groupby("respondentPk").fold.nunique().max() == 1 and own.fold.nunique() == 5
        for r in made.folds.where(F.col("kind") == kind).collect():
            part = own[own.fold == r.fold]
            guess, label = part.score >= 0.5, part.label == 1
            assert (r.tp, r.fp, r.fn) == ((guess & label).sum(), (guess & ~label).sum(), (~guess & label).sum())
            up, down = part.score[label].to_numpy(), part.score[~label].to_numpy()
            wins = (up[:, None] > down).mean() + 0.5 * (up[:, None] == down).mean()
            assert r.auc == pytest.approx(wins) and r.auc > 0.5
        chosen = made.chosen.where(F.col("kind") == kind).first()
        best = []
        for cut in sorted({int(s * 10_000) if s < 1 else 9_999 for s in own.score}):
            flagged = np.minimum(np.floor(own.score * 10_000), 9_999) >= cut
            tp = (flagged & (own.label == 1)).sum()
            p, r = tp / flagged.sum(), tp / (own.label == 1).sum()
            best.append((p >= 0.8 and r >= 0.7, 2 * tp / (flagged.sum() + (own.label == 1).sum()), -cut))
        assert (chosen.meets_targets, chosen.bin) == (max(best)[0], -max(best)[2])
        assert chosen.f1 == pytest.approx(max(best)[1])
    top = made.chosen.orderBy(F.col("f1").desc(), "kind").first()
    assert [r.kind for r in made.chosen.where("best").collect()] == [top.kind]


def test_targets_come_before_f1_and_one_class_scores_it(frame, sample_df):
    curve = frame("kind string, bin int, precision double, recall double, f1 double",
                  [("a", 10, 0.7, 0.99, 0.82), ("a", 20, 0.81, 0.72, 0.76), ("a", 30, 0.85, 0.7, 0.76), ("b", 5, 0.1, 0.1, 0.1)])
    got = values(detection.choose_cut(curve), "kind", "bin", "meets_targets", "best")
    assert got == [("a", 20, True, True), ("b", 5, False, False)]
    never = sample_df.withColumn("wonky_study_count", F.lit(0.0))
    made = detection.cross_validate_detectors(never, FEATURES, "wonky_study_count", "respondentPk", kinds=["random_forest"])
    assert made.scores.select("score").distinct().collect() == [(0.0,)]
    assert made.folds.where("auc IS NOT NULL").count() == 0 and made.chosen.first().recall == 0


def test_unknown_detector(sample_df):
    with pytest.raises(ValueError):
        detection.train_detector(sample_df, FEATURES, "wonky_study_count", ["respondentPk"], "other")


def test_cut_off_and_reduction(frame):
    df = frame("s double, y int", [(float(i), int(i >= 90)) for i in range(100)])
    flagged = detection.flag_top_share(df, "s", 0.05)
    assert flagged.where("flagged = 1").count() == 5
    r = detection.rate_reduction(flagged, "y").first()
    assert (r.flag_rate, r.baseline_rate) == (0.05, 0.1)
    assert r.remaining_rate == pytest.approx(5 / 95) and r.reduction == pytest.approx(1 - 50 / 95)


def test_outliers_score_highest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    rows += [(1000, 30.0, -30.0), (1001, -25.0, 40.0)]
    df = spark.createDataFrame(rows, "i int, x double, z double").repartition(4)
    made = detection.outlier_scores(df, ["x", "z"], trees=30, contamination=0.01)
    top = [r.i for r in made.orderBy(F.desc("outlier_score")).limit(2).collect()]
    assert set(top) == {1000, 1001}
    assert 2 <= made.where("is_outlier = 1").count() <= 5
    assert made.columns == ["i", "x", "z", "outlier_score", "is_outlier"]


def test_sample_is_reproducible(spark):
    df = spark.range(5000)
    a = {r.id for r in hash_sample(df.repartition(3), 100, ["id"]).collect()}
    b = {r.id for r in hash_sample(df.repartition(9), 100, ["id"]).collect()}
    assert a == b and len(a) == 100
    copies = spark.range(50).select(F.lit(1).alias("x"))
    assert hash_sample(copies, 10).count() == 10


def test_rows_of_a_fit_are_dealt_to_several_tasks(spark):
    """Few bytes, many rows: one stored file would be one task, whatever the number of cores."""
    rows = spark.range(0, 4 * forest.ROWS_OF_A_TASK, 1, 1).select(
        F.col("id"), (F.col("id") % 997).alias("user"), (F.col("id") % 13).cast("double").alias("x"),
        (F.col("id") % 3).cast("double").alias("y"),
    )
    data = forest.folded(rows, ["x"], F.col("y"), "user", 5, ["id"])
    sizes = [r.n for r in data.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 2 and sum(sizes) == 4 * forest.ROWS_OF_A_TASK and max(sizes) <= sum(sizes) / 2
    assert data.agg(F.count_distinct("id")).first()[0] == sum(sizes)
    few = forest.folded(rows.where(F.col("id") < forest.ROWS_OF_A_TASK), ["x"], F.col("y"), "user", 5)
    assert few.select(F.spark_partition_id()).distinct().count() == 1
