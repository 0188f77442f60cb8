"""Statistical tests, checked against closed forms written in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import FEATURES, Inputs, query
from panelsift.columns import c
from panelsift.functions import sparse
from panelsift.stats import cluster, effects, tests

Y = "coalesce(wonky_study_count, 0::DOUBLE)"
B = "CASE WHEN wonky_study_count > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END"
# features with missing values and with values other than 0/1 take part as well
TESTED = (*FEATURES, "quality", "task_time_taken_s", "male")
EXTRA = "CASE WHEN gender = 'male' THEN 1 WHEN gender IS NOT NULL THEN 0 END AS male"
LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, respondentPk AS u, CAST({f} AS DOUBLE) AS x, {Y} AS y, {B} AS b FROM src WHERE {f} IS NOT NULL"
    for f in TESTED
)
SOURCE = f"src AS (SELECT *, {EXTRA} FROM v_flags), long AS ({LONG})"

# slope and sandwich variance row by row, the direct way
OLS_SQL = f"""
  WITH {SOURCE},
  m AS (SELECT feature, count(*) AS n, count(DISTINCT u) AS g, avg(x) AS mx, avg(y) AS my,
      sum((x - ax) * (y - ay)) / sum((x - ax) * (x - ax)) AS b1, sum((x - ax) * (x - ax)) AS sxx,
      stddev_samp(y) AS sd, avg(CASE WHEN x = 1 THEN y END) AS w, avg(CASE WHEN x <> 1 THEN y END) AS wo
    FROM (SELECT *, avg(x) OVER (PARTITION BY feature) AS ax, avg(y) OVER (PARTITION BY feature) AS ay FROM long)
    GROUP BY feature),
  s AS (SELECT l.feature, l.u, sum((l.x - m.mx) * (l.y - m.my - m.b1 * (l.x - m.mx))) AS score
    FROM long l JOIN m ON l.feature = m.feature GROUP BY 1, 2),
  v AS (SELECT feature, sum(score * score) AS meat FROM s GROUP BY 1),
  r AS (SELECT m.*, sqrt(meat * g / (g - 1) * (n - 1) / (n - 2)) / sxx AS se FROM m JOIN v ON m.feature = v.feature)
"""
OLS_COLUMNS = """feature, round(w, 6) AS mean_with_feature, round(wo, 6) AS mean_without_feature,
  round(b1, 8) AS mean_difference, round(b1 / se, 5) AS t_statistic, round(se, 8) AS se_cluster_robust,
  round(b1 / sd, 6) AS cohens_d"""


def _source(t: Inputs):
    male = F.when(F.col("gender") == "male", 1).when(F.col("gender").isNotNull(), 0)
    return t.view("v_flags").withColumn("male", male)


@query("x1_clustered_ols", f"{OLS_SQL} SELECT {OLS_COLUMNS} FROM r")
def _(t: Inputs):
    r = cluster.ols_cluster_robust_test(_source(t), [*TESTED, "absent"])
    digits = {"mean_with_feature": 6, "mean_without_feature": 6, "mean_difference": 8,
              "t_statistic": 5, "se_cluster_robust": 8, "cohens_d": 6}
    return r.select("feature", *[F.round(c(n), d).alias(n) for n, d in digits.items()])


BINARY = (*FEATURES, "male")
LOGIT_SQL = f"""
  WITH {SOURCE.replace(LONG, " UNION ALL ".join(p for p in LONG.split(" UNION ALL ") if any(f"'{f}' AS" in p for f in BINARY)))},
  m AS (SELECT feature, count(*) AS n, count(DISTINCT u) AS g, avg(b) AS p,
      avg(CASE WHEN x = 1 THEN b END) AS p1, avg(CASE WHEN x = 0 THEN b END) AS p0,
      count(*) FILTER (x = 1) AS n1, count(*) FILTER (x = 0) AS n0 FROM long GROUP BY feature),
  w AS (SELECT *, n1 * p1 * (1 - p1) AS w1, n0 * p0 * (1 - p0) AS w0,
      ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) AS coef,
      1 - (n1 * (p1 * ln(p1) + (1 - p1) * ln(1 - p1)) + n0 * (p0 * ln(p0) + (1 - p0) * ln(1 - p0)))
        / (n * (p * ln(p) + (1 - p) * ln(1 - p))) AS r2 FROM m),
  s AS (SELECT l.feature, l.u, sum(CASE WHEN x = 1 THEN (b - p1) / w1 ELSE -(b - p0) / w0 END) AS h
    FROM long l JOIN w ON l.feature = w.feature GROUP BY 1, 2),
  r AS (SELECT w.*, e.se FROM w JOIN (SELECT s.feature, sqrt(sum(h * h) * any_value(g) / (any_value(g) - 1)
      * (any_value(n) - 1) / (any_value(n) - 2)) AS se FROM s JOIN w ON s.feature = w.feature GROUP BY 1) e
    ON w.feature = e.feature)
"""


@query(
    "x2_clustered_logit",
    f"""{LOGIT_SQL} SELECT feature, round(coef, 8) AS log_odds_coef, round(exp(coef), 6) AS odds_ratio,
        round(exp(coef - 1.959963984540054::DOUBLE * se), 6) AS or_ci_lower,
        round(exp(coef + 1.959963984540054::DOUBLE * se), 6) AS or_ci_upper, round(coef / se, 5) AS z_statistic,
        round(se, 8) AS se_cluster_robust, round(p1, 6) AS prop_outcome_with_feature,
        round(p0, 6) AS prop_outcome_without_feature, round(p1 - p0, 6) AS prop_difference,
        round(r2, 9) AS pseudo_r2, n AS n_obs FROM r WHERE p1 > 0 AND p1 < 1 AND p0 > 0 AND p0 < 1""",
)
def _(t: Inputs):
    r = cluster.logistic_cluster_robust_test(_source(t), BINARY)
    digits = {"log_odds_coef": 8, "odds_ratio": 6, "or_ci_lower": 6, "or_ci_upper": 6,
              "z_statistic": 5, "se_cluster_robust": 8, "prop_outcome_with_feature": 6,
              "prop_outcome_without_feature": 6, "prop_difference": 6, "pseudo_r2": 9}
    return r.select("feature", "n_obs", *[F.round(c(n), d).alias(n) for n, d in digits.items()])


def _newton_sql(feature: str, middle: int, width: int, source: str = "v_flags", name: str | None = None) -> str:
    """Newton's method as a recursive query, then the sandwich variance row by row."""
    return f"""WITH RECURSIVE src AS (SELECT respondentPk AS u, (CAST({feature} AS DOUBLE) - {middle}) / {width} AS x, {B} AS b
        FROM {source} WHERE {feature} IS NOT NULL),
      cells AS MATERIALIZED (SELECT x, count(*) AS n, sum(b) AS sb FROM src GROUP BY 1),
      newton(k, a, s) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE UNION ALL
        SELECT k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01),
          s + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
        FROM (SELECT k, a, s, sum(sb - n * p) AS g0, sum((sb - n * p) * x) AS g1, sum(n * p * (1 - p)) AS h00,
            sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * x * x) AS h11
          FROM (SELECT k, a, s, x, n, sb, 1 / (1 + exp(-(a + s * x))) AS p FROM newton, cells WHERE k < 12)
          GROUP BY k, a, s)),
      rows AS MATERIALIZED (SELECT u, x, b, s, 1 / (1 + exp(-(a + s * x))) AS p FROM src,
        (SELECT a, s FROM newton WHERE k = 12)),
      h AS (SELECT sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11,
          count(*) AS n, count(DISTINCT u) AS g, any_value(s) AS s FROM rows),
      m AS (SELECT sum(pow((h00 * s1 - h01 * s0) / (h00 * h11 - h01 * h01), 2)) AS v FROM h,
        (SELECT u, sum(b - p) AS s0, sum((b - p) * x) AS s1 FROM rows GROUP BY u))
      SELECT '{name or feature}' AS feature, round(s / {width}, 7) AS log_odds_coef,
        round(sqrt(v * g / (g - 1) * (n - 1) / (n - 2)) / {width}, 7) AS se_cluster_robust, n AS n_obs FROM h, m"""


NUMERIC = {"quality": (50, 30), "task_time_taken_s": (500, 400), "hr": (12, 7)}


@query(
    "x2_clustered_logit_numeric",
    " UNION ALL ".join(f"SELECT * FROM ({_newton_sql(f, *scale)})" for f, scale in NUMERIC.items()),
)
def _(t: Inputs):
    r = cluster.logistic_cluster_robust_test(_source(t), list(NUMERIC))
    return r.select(
        "feature", "n_obs", *[F.round(n, 7).alias(n) for n in ("log_odds_coef", "se_cluster_robust")]
    )


OCCURRENCES = """(SELECT f.respondentPk, f.wonky_study_count,
    len(list_filter(coalesce(gambling_participation_mc, []), lambda x: trim(x) = 'bingo')) AS bingo,
    len(list_filter(coalesce(gambling_participation_mc, []), lambda x: trim(x) = 'casino poker')) AS poker
  FROM v_fact f JOIN v_info i ON f.respondentPk = i.respondent_pk)"""


@query(
    "x2_clustered_logit_sparse",
    " UNION ALL ".join(
        f"SELECT * FROM ({_newton_sql(n, 0, 1, OCCURRENCES, f'plays_{label}')})"
        for n, label in (("bingo", "bingo"), ("poker", "casino poker"))
    ),
)
def _(t: Inputs):
    """Features of a list column, one of them with values up to 2, without a column for any."""
    info = t.view("v_info").select(F.col("respondent_pk").alias("respondentPk"), "profile.gambling_participation_mc")
    rows = t.view("v_fact").select("respondentPk", "wonky_study_count").join(info, "respondentPk")
    rows = sparse.encode(rows, {"gambling_participation_mc": False}, prefixes={"gambling_participation_mc": "plays_"})
    r = cluster.logistic_cluster_robust_test(rows, [], sparse=sparse.COLUMN)
    return r.select(
        "feature", "n_obs", *[F.round(n, 7).alias(n) for n in ("log_odds_coef", "se_cluster_robust")]
    )


@query(
    "x3_combined_tests",
    f"""{OLS_SQL.replace("WITH src", "WITH a0 AS (SELECT 1), src", 1)}, logit AS (
          SELECT feature, ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) AS coef FROM (
            SELECT feature, avg(CASE WHEN x = 1 THEN b END) AS p1, avg(CASE WHEN x = 0 THEN b END) AS p0
            FROM long WHERE feature NOT IN ('quality', 'task_time_taken_s') GROUP BY 1)
          WHERE p1 > 0 AND p1 < 1 AND p0 > 0 AND p0 < 1)
        SELECT r.feature, round(b1, 8) AS ols_mean_difference, round(b1 / se, 5) AS ols_t_statistic,
          round(logit.coef, 8) AS logit_log_odds_coef FROM r LEFT JOIN logit ON r.feature = logit.feature
        WHERE r.feature NOT IN ('quality', 'task_time_taken_s')""",
)
def _(t: Inputs):
    r = cluster.run_combined_regression_tests(_source(t), BINARY)
    digits = {"ols_mean_difference": 8, "ols_t_statistic": 5, "logit_log_odds_coef": 8}
    return r.select("feature", *[F.round(c(n), d).alias(n) for n, d in digits.items()])


SETS = {
    "days": ("is_weekend", "is_monday", "is_friday"),
    "hours": ("is_night", "is_business_hour"),
    "mixed": ("is_night", "is_fast", "is_error", "quality"),
}


MEMBERS = ", ".join(f"('{k}', '{f}')" for k, members in SETS.items() for f in members)


@query(
    "x5_test_battery",
    f"""{OLS_SQL} SELECT s.feature_set, r.feature, round(b1, 8) AS ols_mean_difference,
          round(b1 / se, 5) AS ols_t_statistic
        FROM r JOIN (VALUES {MEMBERS}) s(feature_set, feature) ON r.feature = s.feature""",
)
def _(t: Inputs):
    results = cluster.run_test_battery(_source(t), SETS)
    return results.select(
        "feature_set", "feature", F.round("ols_mean_difference", 8).alias("ols_mean_difference"),
        F.round("ols_t_statistic", 5).alias("ols_t_statistic"),
    )


@query("x5_result_slices")
def _(t: Inputs):
    results = cluster.run_test_battery(_source(t), SETS)
    kinds = (
        ("both", cluster.both_significant(results)),
        ("large", cluster.large_in_both(results)),
        ("one only", cluster.discrepant(results)),
    )
    sliced = [f.select(F.lit(k).alias("slice"), "feature_set", "feature") for k, f in kinds]
    named = results.select(F.lit("all").alias("slice"), "feature_set", "feature")
    for frame in sliced:
        named = named.unionByName(frame)
    return named


CELLS = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, CAST(count(*) FILTER ({f} = 1 AND wonky_study_count > 0) AS DOUBLE) AS a,
      CAST(count(*) FILTER ({f} = 1 AND NOT coalesce(wonky_study_count > 0, false)) AS DOUBLE) AS b,
      CAST(count(*) FILTER ({f} = 0 AND wonky_study_count > 0) AS DOUBLE) AS c,
      CAST(count(*) FILTER ({f} = 0 AND NOT coalesce(wonky_study_count > 0, false)) AS DOUBLE) AS d FROM v_flags"""
    for f in FEATURES
)


OPEN_CELLS = """SELECT feature, CAST(n11 AS DOUBLE) AS a, CAST(n1 - n11 AS DOUBLE) AS b,
    CAST((SELECT count(*) FILTER (wonky_study_count > 0) FROM v_fact) - n11 AS DOUBLE) AS c,
    CAST((SELECT count(*) FILTER (NOT coalesce(wonky_study_count > 0, false)) FROM v_fact) - (n1 - n11) AS DOUBLE) AS d
  FROM (SELECT concat('ip_', ip) AS feature, count(*) AS n1, count(*) FILTER (wonky_study_count > 0) AS n11
    FROM v_fact GROUP BY 1)"""


@query(
    "x6_chi_square_open_vocabulary",
    f"""SELECT feature, round((a + b + c + d) * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 6)
        AS chi2 FROM ({OPEN_CELLS})""",
)
def _(t: Inputs):
    """A flag per address: as many features as the data has addresses."""
    rows = sparse.encode(t.view("v_fact").select("wonky_study_count", "ip"), {"ip": False})
    return tests.chi_square_tests(rows, [], sparse=sparse.COLUMN).select("feature", F.round("chi2", 6).alias("chi2"))


@query(
    "x6_chi_square",
    f"""SELECT feature, round((a + b + c + d) * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 6)
        AS chi2 FROM ({CELLS})""",
)
def _(t: Inputs):
    r = tests.chi_square_tests(t.view("v_flags"), FEATURES)
    return r.select("feature", F.round("chi2", 6).alias("chi2"))


@query(
    "x6_chi_square_documents",
    """SELECT feature, round((a + b + c + d) * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 6) AS chi2
       FROM (SELECT 'is_en' AS feature, CAST(count(*) FILTER (lang = 'en' AND toxic = 1) AS DOUBLE) AS a,
         CAST(count(*) FILTER (lang = 'en' AND toxic = 0) AS DOUBLE) AS b,
         CAST(count(*) FILTER (lang <> 'en' AND toxic = 1) AS DOUBLE) AS c,
         CAST(count(*) FILTER (lang <> 'en' AND toxic = 0) AS DOUBLE) AS d FROM v_scored)""",
)
def _(t: Inputs):
    rows = t.view("v_scored").withColumn("is_en", F.when(F.col("lang") == "en", 1).otherwise(0))
    r = tests.chi_square_tests(rows, ["is_en"], "toxic")
    return r.select("feature", F.round("chi2", 6).alias("chi2"))


@query(
    "x7_two_proportions",
    f"""SELECT feature, round(a / (a + c), 9) AS prop_group, round(b / (b + d), 9) AS prop_rest,
          round(a / (a + c) - b / (b + d), 9) AS proportion_diff, round((a / (a + c) - b / (b + d))
            / sqrt((a + b) / (a + b + c + d) * (c + d) / (a + b + c + d) * (1 / (a + c) + 1 / (b + d))), 6) AS z_statistic
        FROM ({CELLS})""",
)
def _(t: Inputs):
    r = tests.two_proportion_z_tests(t.view("v_flags"), FEATURES)
    return r.select(
        "feature", *[F.round(n, 9).alias(n) for n in ("prop_group", "prop_rest", "proportion_diff")],
        F.round("z_statistic", 6).alias("z_statistic"),
    )


def _rank_sql(f: str) -> str:
    return f"""SELECT '{f}' AS feature, round(u, 4) AS u_statistic, round((u - m * k / 2) / sqrt(m * k / 12
        * ((m + k + 1) - ties / ((m + k) * (m + k - 1)))), 6) AS z_statistic
      FROM (SELECT sum(g * r) - sum(g) * (sum(g) + 1) / 2 AS u, sum(g) AS m, sum(1 - g) AS k, sum(same * same - 1) AS ties
        FROM (SELECT g, rank() OVER (ORDER BY x) + (same - 1) / 2 AS r, same
          FROM (SELECT x, g, CAST(count(*) OVER (PARTITION BY x) AS DOUBLE) AS same
            FROM (SELECT {f} AS x, CASE WHEN wonky_study_count > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS g
              FROM v_flags WHERE {f} IS NOT NULL))))"""


@query("x8_mann_whitney", " UNION ALL ".join(_rank_sql(f) for f in ("quality", "task_time_taken_s", "hr")))
def _(t: Inputs):
    r = tests.mann_whitney_tests(t.view("v_flags"), ["quality", "task_time_taken_s", "hr"])
    return r.select(
        "feature", F.round("u_statistic", 4).alias("u_statistic"), F.round("z_statistic", 6).alias("z_statistic")
    )


@query(
    "x9_selection_bias",
    """SELECT count(*) AS n_users, round(avg(safe), 9) AS safe_rate, round(avg(risky), 9) AS risky_rate,
         round(avg(risky - safe), 9) AS mean_difference,
         round(avg(risky - safe) / (stddev_samp(risky - safe) / sqrt(count(*))), 6) AS t_statistic
       FROM (SELECT respondentPk, avg(CASE WHEN is_monday = 1 THEN f END) AS safe,
           avg(CASE WHEN is_friday = 1 THEN f END) AS risky
         FROM (SELECT *, CASE WHEN wonky_study_count > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS f FROM v_flags)
         GROUP BY 1 HAVING count(*) >= 5) WHERE safe IS NOT NULL AND risky IS NOT NULL""",
)
def _(t: Inputs):
    r = tests.selection_bias(t.view("v_flags"))
    return r.select(
        "n_users", *[F.round(n, 9).alias(n) for n in ("safe_rate", "risky_rate", "mean_difference")],
        F.round("t_statistic", 6).alias("t_statistic"),
    )


@query(
    "x13_odds_in_words",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o IS NULL OR o <= 0 THEN 'Invalid'
         WHEN o > 100 OR o < 0.01::DOUBLE THEN '⚠️ Extreme' WHEN abs(o - 1) < 0.05::DOUBLE THEN 'No effect'
         WHEN (o - 1) * 100 > 100 THEN format('↑ {:.1f}x more likely', o)
         WHEN o > 1 THEN format('↑ {:.0f}% more likely', (o - 1) * 100)
         ELSE format('↓ {:.0f}% less likely', (1 - o) * 100) END AS words
       FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 11.3::DOUBLE - 0.2::DOUBLE AS o FROM lineitem)""",
)
def _(t: Inputs):
    ratio = F.col("l_quantity") / 11.3 - 0.2
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", effects.interpret_odds_ratio(ratio).alias("words")
    )


@query(
    "x15_trend",
    """SELECT round(regr_slope(chi, d), 9) AS slope, round(regr_intercept(chi, d), 9) AS intercept,
         round(regr_r2(chi, d), 9) AS r2, CAST(regr_count(chi, d) AS BIGINT) AS points
       FROM (SELECT epoch_us(ts) / 86400000000.0::DOUBLE - 19723 AS d, value AS chi FROM events)""",
)
def _(t: Inputs):
    days = F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000 - 19723
    r = tests.trend(t.table("events").withColumn("d", days), "value", "d")
    return r.select(*[F.round(n, 9).alias(n) for n in ("slope", "intercept", "r2")], "points")


@query(
    "t1_order_by_statistic",
    f"""SELECT feature, round(row_number() OVER (ORDER BY abs((a + b + c + d) * pow(a * d - b * c, 2)
          / ((a + b) * (c + d) * (a + c) * (b + d))) DESC, feature), 0) AS place FROM ({CELLS})""",
)
def _(t: Inputs):
    from pyspark.sql import Window

    # one row per tested feature, so one window partition is enough
    r = tests.ordered_by_size(tests.chi_square_tests(t.view("v_flags"), FEATURES), "chi2")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.abs("chi2").desc(), "feature"))
    return r.select("feature", place.cast("bigint").alias("place"))
