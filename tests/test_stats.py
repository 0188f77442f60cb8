"""Tests against direct computations with numpy on the same rows."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from panelsift.stats import cluster, effects, gram, tests, vif


def sandwich(x, y, users, score):
    """Clustered covariance with the small-sample factor; ``score`` gives bread and residuals."""
    n, groups = len(y), np.unique(users)
    design = np.column_stack([np.ones(n), x])
    bread, residual = score(design)
    sums = np.array([(design * residual[:, None])[users == g].sum(axis=0) for g in groups])
    factor = len(groups) / (len(groups) - 1) * (n - 1) / (n - 2)
    return factor * bread @ sums.T @ sums @ bread


def direct_ols(x, y, users):
    design = np.column_stack([np.ones(len(y)), x])
    bread = np.linalg.inv(design.T @ design)
    beta = bread @ design.T @ y
    cov = sandwich(x, y, users, lambda d: (bread, y - d @ beta))
    return beta[1], math.sqrt(cov[1, 1])


def direct_logit(x, y, users):
    design = np.column_stack([np.ones(len(y)), x])
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ beta))
        bread = np.linalg.inv(design.T @ (design * (p * (1 - p))[:, None]))
        beta = beta + bread @ design.T @ (y - p)
    cov = sandwich(x, y, users, lambda d: (bread, y - p))
    ll = np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
    m = y.mean()
    return beta[1], math.sqrt(cov[1, 1]), 1 - ll / (len(y) * (m * np.log(m) + (1 - m) * np.log(1 - m)))


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    n = 600
    users = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 40, n))  # one user has a third
    flag = rng.integers(0, 2, n).astype(float)
    year = rng.integers(1950, 2005, n).astype(float)
    gaps = np.where(rng.random(n) < 0.2, np.nan, flag)
    three = rng.integers(0, 3, n).astype(float)
    y = np.where(rng.random(n) < 0.25 + 0.3 * flag, rng.integers(1, 4, n), 0).astype(float)
    return {"users": users, "y": y, "flag": flag, "year": year, "gaps": gaps, "three": three}


@pytest.fixture(scope="module")
def sample_df(spark, sample):
    rows = [
        (int(u), None if y == 0 and i % 2 else y, f, a, None if math.isnan(g) else g, t)
        for i, (u, y, f, a, g, t) in enumerate(
            zip(*(sample[k].tolist() for k in ("users", "y", "flag", "year", "gaps", "three")))
        )
    ]
    schema = "respondentPk int, wonky_study_count double, flag double, year double, gaps double, three double"
    extra = {"zero": F.lit(0), "one": F.lit(1), "nothing": F.lit(None).cast("int")}
    return spark.createDataFrame(rows, schema).withColumns(extra)


FITTED = ("flag", "year", "gaps", "three")


def test_clustered_ols(sample, sample_df):
    table = cluster.ols_cluster_robust_test(sample_df, [*FITTED, "zero", "one", "nothing", "absent"])
    got = {r.feature: r for r in table.collect()}
    assert set(got) == set(FITTED)  # constant, empty and unknown features give no row
    for name in FITTED:
        known = ~np.isnan(sample[name])
        x, y, users = sample[name][known], sample["y"][known], sample["users"][known]
        slope, se = direct_ols(x, y, users)
        r = got[name]
        assert r.mean_difference == pytest.approx(slope, rel=1e-9)
        assert r.se_cluster_robust == pytest.approx(se, rel=1e-7)
        assert r.p_value == pytest.approx(math.erfc(abs(slope / se) / math.sqrt(2)), rel=1e-6)
        assert r.cohens_d == pytest.approx(slope / y.std(ddof=1), rel=1e-9)
        assert r.mean_without_feature == pytest.approx(y[x != 1].mean())
    assert got["year"].mean_with_feature is None
    sizes = [abs(r.t_statistic) for r in table.collect()]
    assert sizes == sorted(sizes, reverse=True)


def test_clustered_logit(sample, sample_df):
    table = cluster.logistic_cluster_robust_test(sample_df, [*FITTED, "zero", "one", "nothing"])
    got = {r.feature: r for r in table.collect()}
    assert set(got) == set(FITTED)
    for name in FITTED:
        known = ~np.isnan(sample[name])
        x, y = sample[name][known], (sample["y"][known] > 0).astype(float)
        centre, width = x.mean(), x.std()
        coef, se, r2 = direct_logit((x - centre) / width, y, sample["users"][known])
        r = got[name]
        assert r.log_odds_coef == pytest.approx(coef / width, rel=1e-6)
        assert r.se_cluster_robust == pytest.approx(se / width, rel=1e-6)
        assert r.pseudo_r2 == pytest.approx(r2, rel=1e-6, abs=1e-10)
        assert r.odds_ratio == pytest.approx(math.exp(coef / width))
        assert r.n_obs == known.sum()


def test_too_few_rows_and_separation(spark):
    def make(n, y):
        rows = [(i % 7, float(y(i)), i % 2) for i in range(n)]
        return spark.createDataFrame(rows, "respondentPk int, wonky_study_count double, x int")

    ols, logit = cluster.ols_cluster_robust_test, cluster.logistic_cluster_robust_test
    assert ols(make(29, lambda i: i % 3), ["x"]).count() == 0
    assert ols(make(30, lambda i: i % 3), ["x"]).count() == 1
    assert logit(make(60, lambda i: i % 2), ["x"]).count() == 0  # empty cells
    assert logit(make(60, lambda i: 0), ["x"]).count() == 0  # constant outcome
    scaled = make(60, lambda i: i % 2).withColumn("x", F.col("x") * 2 + 1)
    assert logit(scaled, ["x"]).count() == 0  # separated, found by Newton
    assert ols(make(60, lambda i: i), []).count() == 0


def test_combined_and_slices(sample_df):
    both = cluster.run_combined_regression_tests(sample_df, FITTED)
    got = {r.feature: r for r in both.collect()}
    for r in got.values():
        assert r.significant_both == (r.ols_significant and r.logit_significant)
        assert r.significant_either == (r.ols_significant or r.logit_significant)
    assert got["flag"].significant_both
    sets = {"a": ["flag", "year"], "b": ["flag", "zero"], "c": []}
    battery = cluster.run_test_battery(sample_df, sets)
    assert {(r.feature_set, r.feature) for r in battery.collect()} == {
        ("a", "flag"), ("a", "year"), ("b", "flag")
    }
    assert cluster.discrepant(battery).where("significant_both").count() == 0


def test_chi_square_is_z_squared_and_matches_mllib(sample_df):
    rows = sample_df.withColumn("b", F.coalesce((F.col("wonky_study_count") > 0).cast("int"), F.lit(0)))
    chi = tests.chi_square_tests(rows, ["flag"]).first()
    z = tests.two_proportion_z_tests(rows, ["flag"]).first()
    assert chi.chi2 == pytest.approx(z.z_statistic**2)
    assert chi.chi_p_value == pytest.approx(z.p_value)
    vectors = VectorAssembler(inputCols=["flag"], outputCol="v").transform(rows)
    reference = ChiSquareTest.test(vectors, "v", "b").first()
    assert chi.chi2 == pytest.approx(reference.statistics[0])
    assert chi.chi_p_value == pytest.approx(reference.pValues[0], rel=1e-6)


def test_mann_whitney_by_pair_counting(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 7.0], [2.0, 3.0, 3.0, 8.0, 9.0, 9.0]
    rows = [(v, 1) for v in a] + [(v, 0) for v in b] + [(None, 1)]
    r = tests.mann_whitney_tests(spark.createDataFrame(rows, "x double, wonky_study_count int"), ["x"]).first()
    u = sum((i > j) + 0.5 * (i == j) for i in a for j in b)
    assert r.u_statistic == pytest.approx(u)
    n, m, k = 11, 5, 6
    ties = sum(t**3 - t for t in (3, 2, 2))
    sd = math.sqrt(m * k / 12 * (n + 1 - ties / (n * (n - 1))))
    assert r.z_statistic == pytest.approx((u - m * k / 2) / sd)


def test_selection_bias_pairs_users(spark):
    rows = []
    for user, safe, risky in ((1, 0, 1), (2, 0, 0), (3, 1, 1), (4, 0, 1)):
        rows += [(user, safe, 1, 0)] * 3 + [(user, risky, 0, 1)] * 3
    rows += [(5, 1, 1, 0)] * 9 + [(6, 1, 1, 0), (6, 1, 0, 1)]  # one day only; too few tasks
    df = spark.createDataFrame(rows, "respondentPk int, wonky_study_count int, is_monday int, is_friday int")
    r = tests.selection_bias(df).first()
    change = np.array([1, 0, 0, 1])
    t = change.mean() / (change.std(ddof=1) / 2)
    assert (r.n_users, r.mean_difference) == (4, 0.5)
    assert r.t_statistic == pytest.approx(t)
    assert r.p_value == pytest.approx(tests.student_t_p_value(t, 3))


def test_student_t_against_known_points():
    assert tests.student_t_p_value(2.0, 10) == pytest.approx(0.0733880347707, rel=1e-9)
    assert tests.student_t_p_value(1.0, 1) == pytest.approx(0.5)
    assert tests.student_t_p_value(-1.959963985, 1e7) == pytest.approx(0.05, rel=1e-5)
    assert tests.student_t_p_value(12.706204736, 1) == pytest.approx(0.05, rel=1e-8)


def test_effect_labels(frame):
    ds = [(0.19, "negligible"), (-0.2, "small"), (0.5, "medium"), (0.8, "large"), (None, "undefined")]
    df = frame("v double, want string", ds)
    assert all(r.want == r[2] for r in df.select("v", "want", effects.cohens_d_label(F.col("v"))).collect())
    ratios = [(1.4, "negligible"), (0.5, "small"), (2.5, "medium"), (0.25, "large"), (0.0, "undefined"),
              (-1.0, "undefined"), (None, "undefined")]
    df = frame("v double, want string", ratios)
    assert all(r.want == r[2] for r in df.select("v", "want", effects.odds_ratio_label(F.col("v"))).collect())
    words = [(1.02, "No effect"), (1.5, "↑ 50% more likely"), (2.5, "↑ 2.5x more likely"),
             (0.4, "↓ 60% less likely"), (101.0, "⚠️ Extreme"), (None, "Invalid")]
    df = frame("v double, want string", words)
    assert all(r.want == r[2] for r in df.select("v", "want", effects.interpret_odds_ratio(F.col("v"))).collect())


def direct_vif(x, i):
    others = np.delete(x, i, axis=1)
    beta, *_ = np.linalg.lstsq(others, x[:, i], rcond=None)
    rss = ((x[:, i] - others @ beta) ** 2).sum()
    spans = np.linalg.matrix_rank(np.column_stack([others, np.ones(len(x))])) == np.linalg.matrix_rank(others)
    tss = ((x[:, i] - (x[:, i].mean() if spans else 0)) ** 2).sum()
    return math.inf if rss < 1e-9 * tss else tss / rss


@pytest.mark.parametrize("columns", [3, 15])
def test_vif_against_regressions(spark, columns):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, columns)) + 1
    x[:, 0] += x[:, 1] * 0.7
    names = [f"c<{i}" for i in range(columns)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], names)
    got = {r.feature: r.VIF for r in vif.calculate_vif_detailed(df, names).collect()}
    for i, name in enumerate(names):
        assert got[name] == pytest.approx(direct_vif(x, i), rel=1e-8)


def test_vif_of_a_full_one_hot_set_is_centred(spark):
    rng = np.random.default_rng(6)
    kind = rng.integers(0, 3, 300)
    x = np.column_stack([kind == 0, kind == 1, kind == 2, rng.normal(size=300) + kind]).astype(float)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], names)
    got = {r.feature: r.VIF for r in vif.calculate_vif_detailed(df, names).collect()}
    for i, name in enumerate(names):
        assert got[name] == pytest.approx(direct_vif(x, i), rel=1e-7)


def test_duplicated_columns_are_infinite(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(100, 2))
    df = spark.createDataFrame([(float(a), float(b), float(2 * a), None) for a, b in x], "a double, b double, twice double, e double")
    rows = {r.feature: r for r in vif.calculate_vif_detailed(df, ["a", "b", "twice"]).collect()}
    assert rows["a"].VIF == rows["twice"].VIF == math.inf and rows["b"].VIF < 1.2
    assert (rows["a"].vif_flag, rows["a"].recommendation) == ("🚨 INFINITE", "MUST REMOVE")
    assert (rows["b"].vif_flag, rows["b"].recommendation) == ("✓ OK", "Keep")
    kept, removed, log = vif.iterative_vif_removal(df, ["a", "b", "twice"])
    assert kept == ["b", "twice"] and removed == [("a", math.inf)] and log.count() == 2
    assert vif.correlated_features(df, ["a", "b", "twice"])[0] == ["a", "b"]


def test_gram_ways_agree(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 6))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None,) * 6], [f"x{i}" for i in range(6)])
    columns = {f"x{i}": F.col(f"x{i}") for i in range(6)}
    sums = gram.gram_matrix(df, columns)
    rows = df.dropna()
    other = gram._by_row_matrix(rows, list(columns), list(columns))
    assert sums.n == other.n == 500
    np.testing.assert_allclose(sums.products, other.products)
    np.testing.assert_allclose(sums.sums, x.sum(axis=0))


def _offset_frame(spark, offset):
    rows = [
        (f"r{i % 40}", float((i * 7) % 3) + offset, 1.0 if i % 50 == 49 else None, float((i * 13) % 5), int(i % 7 == 0))
        for i in range(600)
    ]
    lone = [(u, x, (1.0 if i % 2 else 0.0) if u == "r3" else None, y, w) for i, (u, x, _, y, w) in enumerate(rows)]
    return spark.createDataFrame(lone, "respondentPk string, x double, lone double, y double, wonky_study_count int")


def test_offset_changes_no_slope_and_a_lone_feature_fails_alone(spark):
    from panelsift.stats.cluster import ClusterSums, logit_results, ols_results

    found = {}
    for offset in (0.0, 1.7e9):
        sums = ClusterSums(_offset_frame(spark, offset), ["x", "lone"])
        for name, results in (("ols", ols_results(sums)), ("logit", logit_results(sums))):
            rows = {r.feature: r for r in results.collect()}
            assert "lone" not in rows
            found[name, offset] = rows["x"]
    for name, slope in (("ols", "mean_difference"), ("logit", "log_odds_coef")):
        near, far = found[name, 0.0], found[name, 1.7e9]
        assert abs(near[slope] - far[slope]) < 1e-6
        assert abs(near["se_cluster_robust"] - far["se_cluster_robust"]) < 1e-6


def test_offset_twin_is_found_and_linear_model_unmoved(spark):
    from panelsift.models.linear import build_linear_baseline
    from panelsift.stats.vif import correlated_features

    df = _offset_frame(spark, 0.0).selectExpr("x", "x + 1.7e9D AS far", "y", "wonky_study_count AS w")
    kept, pairs = correlated_features(df, ["x", "far", "y"])
    assert kept == ["x", "y"] and [(a, b) for a, b, _ in pairs] == [("x", "far")]
    near, _, _ = build_linear_baseline(df, ["x", "y"], "w")
    far, _, _ = build_linear_baseline(df, ["far", "y"], "w")
    assert abs(near.coefficients["x"] - far.coefficients["far"]) < 1e-7


def test_histogram_lists_all_bins_and_takes_zeros(spark):
    from panelsift.operators.profile import equal_width_histogram

    zeros = spark.createDataFrame([(0.0, 1)] * 4, "v double, f int")
    rows = sorted(equal_width_histogram(zeros, "v", "f", bins=5).collect(), key=lambda r: r.bin)
    assert [(r.bin, r["count"]) for r in rows] == [(1, 4), (2, 0), (3, 0), (4, 0), (5, 0)]


def test_nan_is_no_value_for_quantiles(spark):
    from panelsift.operators.ordered import quantiles

    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "v double")
    for approximate in (False, True):
        row = quantiles(df, "v", {"mid": 0.5}, approximate=approximate).first()
        assert (row.n, row.mid) == (3, 2.0)
