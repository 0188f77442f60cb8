"""Features of open vocabularies: the same numbers as with a column for each."""

import pytest
from pyspark.sql import functions as F

from panelsift.functions import onehot, sparse
from panelsift.operators import profile
from panelsift.stats import cluster, tests
from tests.conftest import values


@pytest.fixture
def rows(spark):
    """500 rows of 40 users; a list column with repeats, a text column, some nulls."""
    user = F.expr("CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 1 ELSE id % 40 END")
    listed = F.expr("CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN array('a') WHEN 2 THEN array('a', 'b', 'a') "
                    "WHEN 3 THEN array() ELSE array('b', NULL, 'c ') END")  # fmt: skip
    return spark.range(500, numPartitions=4).select(
        user.alias("respondentPk"),
        F.expr("CASE WHEN id % 7 = 0 THEN NULL ELSE (id * 13 % 11 > 6)::DOUBLE END").alias("wonky_study_count"),
        listed.alias("l"),
        F.expr("CASE WHEN id % 9 = 0 THEN NULL ELSE concat('t', id * 7 % 17 % 6) END").alias("t"),
        (F.col("id") * 31 % 23 / 4).alias("x"),
    )


@pytest.fixture
def both(rows):
    dense = onehot.batch_one_hot_encode(rows, ["l", "t"], ["t"])
    names = [n for n in dense.columns if n not in rows.columns]
    return dense, sparse.encode(rows, {"l": False, "t": True}), names


def near(a, b, key="feature", digits=8):
    def table(df):
        return {
            r[key]: {k: round(v, digits) if isinstance(v, float) else v for k, v in r.asDict().items()}
            for r in df.collect()
        }

    left, right = table(a), table(b)
    assert left.keys() == right.keys() and left
    for k in left:
        for n in left[k]:
            x, y = left[k][n], right[k][n]
            assert x == y or x == pytest.approx(y, rel=1e-7, abs=1e-9), (k, n, x, y)


def test_encoded_entries(rows, both):
    dense, listed, names = both
    back = sparse.with_columns(listed, names)
    wanted = [F.sum(F.col(n) * (F.col("x") + 1)).alias(n) for n in names]
    assert dense.agg(*wanted).first() == back.agg(*wanted).first()
    words = {r.feature: (r.rows, r.total) for r in sparse.vocabulary(listed).collect()}
    assert words.keys() == set(names) and words["l_a"] == (200, 300.0)
    assert sparse.present(listed, ["t_*", "l_a", "l_z", "z_*"]) == ["t_*", "l_a"]
    few = sparse.only(listed, ["l_b", "t_t1*"])
    assert {r.feature for r in sparse.vocabulary(few).collect()} == {"l_b", "t_t1"}
    assert few.count() == rows.count()
    twice = sparse.encode(sparse.encode(rows, {"l": False}), {"t": True})
    assert sparse.vocabulary(twice).exceptAll(sparse.vocabulary(listed)).isEmpty()


def test_missing_entries_count_as_missing(frame):
    df = frame(f"respondentPk int, wonky_study_count double, {sparse.COLUMN} {sparse.TYPE}",
               [(1, 1.0, [("a", 1.0)]), (2, 0.0, [("a", None)]), (3, 0.0, None), (4, 1.0, [])])
    got = profile.feature_sums(df, [], F.lit("all"), sparse.COLUMN)
    assert values(got, "feature", "n", "m", "s", "n1") == [("a", 4, 1, 1.0, 1)]
    assert values(sparse.with_columns(df, ["a", "b"]), "respondentPk", "a", "b") == [
        (1, 1.0, 0.0), (2, None, 0.0), (3, 0.0, 0.0), (4, 0.0, 0.0)
    ]


def test_profiles_and_contingency_agree_with_columns(both):
    dense, listed, names = both
    wanted = ["feature", "all_pct", "group_pct", "other_pct", "delta_pct"]
    a = profile.breakdown(dense, [*names, "x"]).select(wanted)
    near(a, profile.breakdown(listed, ["x"], sparse=sparse.COLUMN).select(wanted))
    near(tests.chi_square_tests(dense, names), tests.chi_square_tests(listed, [], sparse=sparse.COLUMN))
    near(tests.two_proportion_z_tests(dense, names), tests.two_proportion_z_tests(listed, [], sparse=sparse.COLUMN))


def test_regressions_agree_with_columns(both):
    dense, listed, names = both
    # values up to 2 (l_a) are fitted by Newton on both sides, next to a numeric column
    near(
        cluster.run_combined_regression_tests(dense, [*names, "x"]),
        cluster.run_combined_regression_tests(listed, ["x"], sparse=sparse.COLUMN),
    )


def test_battery_over_a_vocabulary(both):
    dense, listed, names = both
    sets = {"all of t": ["t_*"], "some": ["l_a", "x"], "none": ["gone"]}
    got = cluster.run_test_battery(listed, sets, sparse.COLUMN)
    found = {(r.feature_set, r.feature) for r in got.collect()}
    titles = {("all of t", n) for n in names if n.startswith("t_")}
    assert found == titles | {("some", "l_a"), ("some", "x")}


def test_separated_and_constant_features_give_no_fit(frame):
    rows = [(i % 10, float(i % 2), [("same", 1.0)] + ([("apart", 1.0 + i % 3)] if i % 2 else [])) for i in range(60)]
    df = frame(f"respondentPk int, wonky_study_count double, {sparse.COLUMN} {sparse.TYPE}", rows)
    assert cluster.logistic_cluster_robust_test(df, [], sparse=sparse.COLUMN).count() == 0
    got = cluster.ols_cluster_robust_test(df, [], sparse=sparse.COLUMN)
    assert [r.feature for r in got.collect()] == ["apart"]


def test_plan_does_not_widen_with_the_vocabulary(spark):
    def size(words):
        df = spark.range(400).select(
            (F.col("id") % 20).alias("respondentPk"), (F.col("id") % 2).cast("double").alias("wonky_study_count"),
            F.concat(F.lit("w"), F.col("id") % words).alias("t"),
        )
        made = cluster.ols_cluster_robust_test(sparse.encode(df, {"t": False}), [], sparse=sparse.COLUMN)
        assert made.count() == words
        return len(made._jdf.queryExecution().analyzed().toString().splitlines())

    assert size(5) == size(300)
