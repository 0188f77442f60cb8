"""Multicollinearity, preparation, models, attribution, detection, whole analyses."""

from __future__ import annotations

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from catalog.base import FEATURES, STUDY_LABELS, Inputs, query
from catalog.pull import DEVICE_SQL
from panelsift import config
from panelsift.columns import c
from panelsift.functions import sparse
from panelsift.models import attribution, clusters, compare, detection, forest, linear, logistic
from panelsift.models import prepare
from panelsift.operators import joins, select
from panelsift.plans import panel
from panelsift.session import materialise, scratch_path
from panelsift.sources import sinks, tables
from panelsift.stats import vif


def _vectors(t: Inputs):
    return t.view("v_vector")


def _embeddings(t: Inputs):
    """Embeddings with a column per dimension, stored once; and the names of these columns."""
    rows = t.table("embeddings")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"x{i}" for i in range(width)]
    spread = [F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]
    return materialise(rows.select("vec_id", *spread)), names


# uncentred VIF of three columns by cofactors of their cross-product matrix
CROSS = """SELECT sum(x0*x0) AS a, sum(x0*x1) AS b, sum(x0*x2) AS c, sum(x1*x1) AS d, sum(x1*x2) AS e,
  sum(x2*x2) AS f FROM v_vector"""
DET = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
VIF_SQL = " UNION ALL ".join(
    f"SELECT 'x{i}' AS feature, {whole} * ({minor}) / {DET} AS v FROM ({CROSS})"
    for i, (whole, minor) in enumerate((("a", "d*f-e*e"), ("d", "a*f-c*c"), ("f", "a*d-b*b")))
)


@query("x10_vif", f"SELECT feature, round(v, 8) AS \"VIF\", CASE WHEN v > 10 THEN '⚠️ HIGH' WHEN v > 5 THEN '⚡ MODERATE' ELSE '✓ OK' END AS vif_flag, CASE WHEN v > 10 THEN 'Consider removing' WHEN v > 5 THEN 'Monitor' ELSE 'Keep' END AS recommendation FROM ({VIF_SQL})")
def _(t: Inputs):
    r = vif.calculate_vif_detailed(_vectors(t), ["x0", "x1", "x2"])
    return r.select("feature", F.round("VIF", 8).alias("VIF"), "vif_flag", "recommendation")


@query(
    "x11_iterative_removal",
    """SELECT 1 AS iteration, 3 AS n_features, CAST(NULL AS DOUBLE) AS max_vif UNION ALL
       SELECT 2, 2, round(1 / (1 - pow(sum(x0 * x1), 2) / (sum(x0 * x0) * sum(x1 * x1))), 8) FROM v_vector""",
)
def _(t: Inputs):
    rows = _vectors(t).withColumn("twice", F.col("x0") * 2)
    kept, removed, log = vif.iterative_vif_removal(rows, ["x0", "x1", "twice"])
    if len(kept) != 2 or len(removed) != 1:
        raise RuntimeError(f"unexpected removal {removed}")
    finite = F.when(F.col("max_vif") < float("inf"), F.round("max_vif", 8))
    return log.select("iteration", "n_features", finite.alias("max_vif"))


@query("x12_removal_candidates", f"SELECT feature, round(v, 8) AS \"VIF\" FROM ({VIF_SQL}) WHERE v > 1::DOUBLE")
def _(t: Inputs):
    table = vif.calculate_vif_detailed(_vectors(t), ["x0", "x1", "x2"])
    r = vif.get_feature_removal_candidates(table, 1.0)
    return r.select("feature", F.round("VIF", 8).alias("VIF"))


@query("x14_correlated_features", "SELECT 'mixed' AS later, round(corr(x0, x0 + 0.1::DOUBLE * x1), 8) AS r FROM v_vector")
def _(t: Inputs):
    rows = _vectors(t).withColumn("mixed", F.col("x0") + 0.1 * F.col("x1"))
    _, dropped = vif.correlated_features(rows, ["x0", "x1", "x2", "mixed"])
    table = t.spark.createDataFrame(dropped, "earlier string, later string, r double")
    return table.select("later", F.round("r", 8).alias("r"))


SCALED = ("risk", "task_time_taken_s", "is_weekend", "hr")


@query(
    "f26_scaling_needs",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, CASE WHEN count(*) FILTER ({f} NOT IN (0, 1)) = 0 THEN 'binary'
            WHEN count(DISTINCT {f}) <= 10 THEN 'categorical/ordinal' ELSE 'continuous' END AS type,
          count(DISTINCT {f}) AS unique_values, CAST(min({f}) AS DOUBLE) AS min, CAST(max({f}) AS DOUBLE) AS max,
          round(avg({f}), 4) AS mean, round(stddev_samp({f}), 4) AS std,
          count(*) FILTER ({f} NOT IN (0, 1)) > 0 AND count(DISTINCT {f}) > 10
            AND (stddev_samp({f}) > 10 OR abs(avg({f})) > 100) AS scaling_recommended FROM v_flags"""
        for f in SCALED
    ),
)
def _(t: Inputs):
    return prepare.analyze_feature_scaling_needs(t.view("v_flags"), SCALED)


@query(
    "f27_rare_features",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg({f}) BETWEEN 0.15::DOUBLE AND 0.85::DOUBLE AS kept FROM v_flags"
        for f in FEATURES
    ),
)
def _(t: Inputs):
    valid, rare = prepare.filter_rare_features(t.view("v_flags"), FEATURES, 0.15)
    rows = [(f, True) for f in valid] + [(f, False) for f, _ in rare]
    return t.spark.createDataFrame(rows, "feature string, kept boolean")


@query(
    "m1_scale_standard",
    """SELECT vec_id, round((x0 - avg(x0) OVER ()) / stddev_pop(x0) OVER (), 8) AS x0,
       round((x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER (), 8) AS x1, 0::DOUBLE AS same FROM v_vector""",
)
def _(t: Inputs):
    rows = _vectors(t).select("vec_id", "x0", "x1", F.lit(3.0).alias("same"))
    made, _ = prepare.scale_features(rows, ["x0", "x1", "same"])
    return made.select("vec_id", *[F.round(n, 8).alias(n) for n in ("x0", "x1", "same")])


@query(
    "m1_scale_minmax",
    """SELECT vec_id, round((x0 - min(x0) OVER ()) / (max(x0) OVER () - min(x0) OVER ()), 8) AS x0,
       0::DOUBLE AS same FROM v_vector""",
)
def _(t: Inputs):
    rows = _vectors(t).select("vec_id", "x0", F.lit(3.0).alias("same"))
    made, _ = prepare.scale_features(rows, ["x0", "same"], "minmax")
    return made.select("vec_id", *[F.round(n, 8).alias(n) for n in ("x0", "same")])


@query(
    "m1_scale_robust",
    """SELECT vec_id, round((x0 - q[2]) / (q[3] - q[1]), 8) AS x0 FROM v_vector,
       (SELECT quantile_cont(x0, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS q FROM v_vector)""",
)
def _(t: Inputs):
    made, _ = prepare.scale_features(_vectors(t).select("vec_id", "x0"), ["x0"], "robust")
    return made.select("vec_id", F.round("x0", 8).alias("x0"))


@query(
    "m2_label_encoding",
    """SELECT event_id, CAST(dense_rank() OVER (ORDER BY coalesce(gender, 'nan')) - 1 AS INT) AS gender,
       CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS event_type FROM v_fact""",
)
def _(t: Inputs):
    rows = t.view("v_fact").select("event_id", "gender", "event_type")
    return prepare.encode_categorical(rows, ["gender", "event_type"])[0]


@query(
    "m2_onehot_encoding",
    """SELECT event_id, CASE WHEN gender = 'female' THEN 1 ELSE 0 END AS gender_female,
       CASE WHEN gender = 'male' THEN 1 ELSE 0 END AS gender_male,
       CASE WHEN gender = 'other' THEN 1 ELSE 0 END AS gender_other FROM v_fact""",
)
def _(t: Inputs):
    rows = t.view("v_fact").select("event_id", "gender")
    return prepare.encode_categorical(rows, ["gender"], "onehot")[0]


@query(
    "m3_prepare_features",
    """WITH e AS (SELECT event_id, CAST(dense_rank() OVER (ORDER BY coalesce(gender, 'nan')) - 1 AS DOUBLE) AS gender,
         risk, CAST(is_weekend AS DOUBLE) AS is_weekend FROM v_flags)
       SELECT event_id, round((gender - avg(gender) OVER ()) / stddev_pop(gender) OVER (), 8) AS gender,
         round((risk - avg(risk) OVER ()) / stddev_pop(risk) OVER (), 8) AS risk,
         round((is_weekend - avg(is_weekend) OVER ()) / stddev_pop(is_weekend) OVER (), 8) AS is_weekend FROM e""",
)
def _(t: Inputs):
    rows = t.view("v_flags").withColumn("constant", F.lit("7"))
    made = prepare.prepare_features_for_modeling(
        rows, ["gender", "risk", "is_weekend", "constant", "absent"],
        categorical_cols=["gender"], keep_cols=["event_id"],
    )
    if made.feature_names != ["gender", "risk", "is_weekend"]:
        raise RuntimeError(str(made.feature_names))
    return made.data.select("event_id", *[F.round(n, 8).alias(n) for n in made.feature_names])


LINEAR_SQL = """
  WITH m AS (SELECT count(*) AS n, var_pop(x0) * count(*) AS a, var_pop(x1) * count(*) AS d,
      covar_pop(x0, x1) * count(*) AS b, covar_pop(x0, label) * count(*) AS p,
      covar_pop(x1, label) * count(*) AS q, var_pop(label) * count(*) AS yy FROM v_vector),
  k AS (SELECT *, (d * p - b * q) / (a * d - b * b) AS b0, (a * q - b * p) / (a * d - b * b) AS b1 FROM m),
  s AS (SELECT *, (yy - b0 * p - b1 * q) / (n - 3) AS s2 FROM k)
  SELECT 'x0' AS feature, round(b0, 8) AS coefficient, round(sqrt(s2 * d / (a * d - b * b)), 8) AS std_error,
    round(b0 / sqrt(s2 * d / (a * d - b * b)), 6) AS t_stat, round(abs(b0), 8) AS importance FROM s UNION ALL
  SELECT 'x1', round(b1, 8), round(sqrt(s2 * a / (a * d - b * b)), 8),
    round(b1 / sqrt(s2 * a / (a * d - b * b)), 6), round(abs(b1), 8) FROM s"""


@query("m4_linear_baseline", LINEAR_SQL)
def _(t: Inputs):
    _, table, _ = linear.build_linear_baseline(_vectors(t), ["x0", "x1"], "label")
    digits = {"coefficient": 8, "std_error": 8, "t_stat": 6, "importance": 8}
    return table.select("feature", *[F.round(n, d).alias(n) for n, d in digits.items()])


# with two features the upper tail of the F distribution has a closed form
LINEAR_FIT_SQL = LINEAR_SQL[: LINEAR_SQL.index("  SELECT 'x0'")] + """
  SELECT CAST(n AS BIGINT) AS n, round(r2, 8) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 8) AS r2_adjusted,
    round(f, 6) AS f_statistic, round(pow(1 + 2 * f / (n - 3), -(n - 3) / 2.0::DOUBLE), 8) AS f_p_value
  FROM (SELECT n, (b0 * p + b1 * q) / yy AS r2, (b0 * p + b1 * q) / 2 / s2 AS f FROM s)"""


@query("m4_linear_fit", LINEAR_FIT_SQL)
def _(t: Inputs):
    model, _, _ = linear.build_linear_baseline(_vectors(t), ["x0", "x1"], "label", calculate_vif=False)
    row = (model.n, model.r2, model.r2_adjusted, model.f_statistic, model.f_p_value)
    fit = t.spark.createDataFrame(
        [row], "n bigint, r2 double, r2_adjusted double, f_statistic double, f_p_value double"
    )
    digits = {"r2": 8, "r2_adjusted": 8, "f_statistic": 6, "f_p_value": 8}
    return fit.select("n", *[F.round(n, d).alias(n) for n, d in digits.items()])


MODELLED = ("is_weekend", "is_monday", "is_night", "is_error", "is_fast", "risk", "quality")


@query("m5_random_forest")
def _(t: Inputs):
    fit = forest.build_random_forest_model(t.view("v_flags"), MODELLED, "wonky_study_count", "respondentPk")
    return fit.importance


@query("m6_logistic_regression")
def _(t: Inputs):
    fit = logistic.build_logistic_regression_model(
        t.view("v_flags"), MODELLED, "wonky_study_count", "respondentPk"
    )
    return fit.importance


# users from the most rows to the fewest: equal shares of every size, the rest to the lightest fold
FOLDS_SQL = """WITH RECURSIVE u AS (SELECT respondentPk, count(*) AS n FROM v_fact GROUP BY 1),
    sizes AS (SELECT n, count(*) AS m FROM u GROUP BY 1),
    rest AS (SELECT row_number() OVER (ORDER BY n DESC, i) AS k, n FROM sizes, range(4) r(i) WHERE i < m % 5),
    load(k, loads, users) AS (
      SELECT CAST(0 AS BIGINT), [0, 0, 0, 0, 0]::BIGINT[], [0, 0, 0, 0, 0]::BIGINT[] UNION ALL
      SELECT rest.k, list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN n ELSE 0 END),
        list_transform(users, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN 1 ELSE 0 END)
      FROM load JOIN rest ON rest.k = load.k + 1),
    last AS (SELECT * FROM load ORDER BY k DESC LIMIT 1),
    even AS (SELECT sum(n * (m // 5)) AS rows, sum(m // 5) AS users, max(n) AS most FROM sizes)
  SELECT CAST(f AS INT) AS fold, CAST(even.rows + loads[f + 1] AS BIGINT) AS rows, CAST(even.users + last.users[f + 1] AS BIGINT) AS users,
    list_max(loads) - list_min(loads) <= most AS even FROM last, even, range(5) r(f)"""


@query("m7_balanced_folds", FOLDS_SQL)
def _(t: Inputs):
    """Rows and users of each fold, and whether folds differ by no more than one user's rows."""
    rows = prepare.with_group_folds(t.view("v_fact").select("respondentPk"), "respondentPk", 5)
    per_user = rows.groupBy("respondentPk").agg(F.count(F.lit(1)).alias("n"), F.max("fold").alias("fold"))
    folds = materialise(per_user.groupBy("fold").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("users"), F.max("n").alias("most")))
    spread = folds.agg((F.max("rows") - F.min("rows") <= F.max("most")).alias("even"))
    return folds.drop("most").crossJoin(F.broadcast(spread))  # one row


@query("m7_group_folds", "SELECT respondentPk, CAST(1 AS BIGINT) AS folds, count(*) AS n FROM v_fact GROUP BY 1")
def _(t: Inputs):
    rows = t.view("v_fact").withColumn("fold", prepare.group_fold("respondentPk", 5))
    return rows.groupBy("respondentPk").agg(
        F.count_distinct("fold").alias("folds"), F.count(F.lit(1)).alias("n")
    )


@query("m8_overfit_check")
def _(t: Inputs):
    fit = forest.build_random_forest_model(t.view("v_flags"), MODELLED, "wonky_study_count", "respondentPk")
    gap = F.lit(float(fit.overfit_gap)).alias("gap")
    return fit.cv_scores.select("*", gap, F.lit(fit.possible_overfit).alias("possible_overfit"))


def _all_models(t: Inputs):
    return compare.run_all_models(t.view("v_flags"), MODELLED)


@query("m9_model_comparison")
def _(t: Inputs):
    return _all_models(t).comparison


@query("m10_shap_importance")
def _(t: Inputs):
    """Attributions of every complete row, not of a sample."""
    fit = forest.build_random_forest_model(t.view("v_flags"), MODELLED, "wonky_study_count", "respondentPk")
    return attribution.shap_importance(t.view("v_flags"), fit.model, MODELLED, sample_size=None)


@query(
    "m10_attributions_add_up",
    """SELECT count(*) AS rows, true AS additive FROM v_flags WHERE wonky_study_count IS NOT NULL""",
)
def _(t: Inputs):
    """Base value and attributions of every row sum to its prediction."""
    rows = t.view("v_flags").dropna(subset=["wonky_study_count"])
    label = {"label": F.col("wonky_study_count"), "event_id": F.col("event_id")}
    vectors = forest.assembled(rows, MODELLED, label)
    grower = RandomForestRegressor(numTrees=5, maxDepth=4, seed=1)
    model = grower.fit(vectors)
    parts, base = attribution.attribution_rows(rows, model, MODELLED, None)
    total = sum((F.col(n) for n in parts.columns[1:]), F.col(parts.columns[0]))
    explained = parts.agg(F.count(F.lit(1)).alias("rows"), F.sum(total + F.lit(base)).alias("explained"))
    predicted = model.transform(vectors).agg(F.sum("prediction")).scalar()
    same = F.abs(F.col("explained") - predicted) < 1e-6 * F.col("rows")
    return explained.select("rows", same.alias("additive"))


REPORT_SOURCE = """SELECT 'f' || p_partkey AS feature, p_retailprice / 1000 - 1.2::DOUBLE AS linear_coef,
  CASE WHEN p_size > 40 THEN p_size * 0.000001::DOUBLE ELSE p_size / 600::DOUBLE END AS linear_p_value,
  p_size / 7::DOUBLE AS rf_importance_pct, p_retailprice / 450 - 1.9::DOUBLE AS lr_odds_ratio, p_partkey / 4::DOUBLE AS avg_rank,
  CASE WHEN p_size = 3 THEN NULL ELSE p_size / 3::DOUBLE END AS "VIF" FROM part"""


@query(
    "m11_report_format",
    f"""SELECT feature AS "Feature", format('{{:+.4f}}', linear_coef) || CASE WHEN linear_p_value < 0.001::DOUBLE THEN '***'
          WHEN linear_p_value < 0.01::DOUBLE THEN '**' WHEN linear_p_value < 0.05::DOUBLE THEN '*' ELSE '' END AS "Linear Effect",
        CASE WHEN linear_p_value >= 0.0001::DOUBLE THEN format('{{:.4f}}', linear_p_value)
          ELSE format('{{:.2e}}', linear_p_value) END AS "Linear p-value",
        format('{{:.2f}}%', rf_importance_pct) AS "RF Importance %",
        CASE WHEN lr_odds_ratio BETWEEN 0.01::DOUBLE AND 100 THEN format('{{:.3f}}', lr_odds_ratio) ELSE '⚠️' END AS "Odds Ratio",
        CASE WHEN lr_odds_ratio <= 0 THEN 'Invalid' WHEN lr_odds_ratio < 0.01::DOUBLE THEN '⚠️ Extreme'
          WHEN abs(lr_odds_ratio - 1) < 0.05::DOUBLE THEN 'No effect'
          WHEN (lr_odds_ratio - 1) * 100 > 100 THEN format('↑ {{:.1f}}x more likely', lr_odds_ratio)
          WHEN lr_odds_ratio > 1 THEN format('↑ {{:.0f}}% more likely', (lr_odds_ratio - 1) * 100)
          ELSE format('↓ {{:.0f}}% less likely', (1 - lr_odds_ratio) * 100) END AS "OR Interpretation",
        round(avg_rank, 1) AS "Consensus Rank",
        CASE WHEN "VIF" IS NULL THEN 'N/A' ELSE format('{{:.1f}}', "VIF") END AS "VIF",
        CASE WHEN "VIF" > 10 THEN '⚠️' WHEN "VIF" > 5 THEN '⚡' ELSE '✓' END AS "VIF Flag" FROM ({REPORT_SOURCE})""",
)
def _(t: Inputs):
    return compare.create_stakeholder_report(t.sql(REPORT_SOURCE.replace("::DOUBLE", "D").replace('"VIF"', "VIF")))


@query("m11_stakeholder_report")
def _(t: Inputs):
    results = compare.run_shap_analysis(_all_models(t), t.view("v_flags"))
    return compare.create_stakeholder_report(results.comparison)


@query("m12_significant_features")
def _(t: Inputs):
    return compare.get_significant_features(_all_models(t).comparison)


@query(
    "s10_export_results",
    "SELECT feature, CAST(round(linear_coef, 9) AS DOUBLE) AS linear_coef, CAST(round(avg_rank, 9) AS DOUBLE) AS avg_rank, "
    f'round("VIF", 9) AS "VIF", round(lr_odds_ratio, 9) AS lr_odds_ratio FROM ({REPORT_SOURCE})',
)
def _(t: Inputs):
    """A comparison with unexported columns, written as CSV and read back."""
    path = scratch_path(t.spark, "comparison")
    table = t.sql(REPORT_SOURCE.replace("::DOUBLE", "D").replace('"VIF"', "VIF"))
    sinks.export_results(table.select("VIF", "avg_rank", "feature", "linear_coef", "lr_odds_ratio", (F.col("avg_rank") * 2).alias("extra")), path)
    schema = "feature string, linear_coef double, avg_rank double, VIF double, lr_odds_ratio double"
    back = t.spark.read.schema(schema).option("header", True).csv(path)
    return back.select("feature", *[F.round(n, 9).alias(n) for n in back.columns[1:]])


@query("m13_clusters")
def _(t: Inputs):
    made, _, _ = clusters.behaviour_clusters(*_embeddings(t))
    return made.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m14_impute_by_cluster",
    """WITH g AS (SELECT event_id, event_type, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 7 END AS kind FROM events),
       f AS (SELECT event_type, avg(value) AS v FROM g GROUP BY 1),
       k AS (SELECT event_type, kind FROM (SELECT event_type, kind, row_number() OVER (PARTITION BY event_type
           ORDER BY count(*) DESC, kind) AS r FROM g WHERE kind IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
       SELECT event_id, g.event_type, round(coalesce(value, f.v), 6) AS value, coalesce(g.kind, k.kind) AS kind
       FROM g JOIN f ON g.event_type = f.event_type JOIN k ON g.event_type = k.event_type""",
)
def _(t: Inputs):
    rows = t.table("events").select(
        "event_id", "event_type",
        F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 11 != 0, F.col("user_id") % 7).alias("kind"),
    )
    made = clusters.impute_by_cluster(rows, ["value"], ["kind"], "event_type")
    return made.withColumn("value", F.round("value", 6))


@query("m15_forest_detector")
def _(t: Inputs):
    _, scored = detection.train_detector(
        t.view("v_flags"), MODELLED, "wonky_study_count", ["respondentPk"]
    )
    return detection.evaluate_detector(scored)


@query("m15_boosted_detector")
def _(t: Inputs):
    _, scored = detection.train_detector(
        t.view("v_flags"), MODELLED, "wonky_study_count", ["respondentPk"], "gradient_boosting"
    )
    return detection.evaluate_detector(scored)


@query(
    "m15_cross_validated_detectors",
    """SELECT k.kind, count(*) AS rows, count(*) FILTER (wonky_study_count > 0) AS positives,
         count(DISTINCT respondentPk) AS users, CAST(5 AS BIGINT) AS folds, CAST(1 AS BIGINT) AS most_folds_of_a_user,
         true AS scores_in_range, true AS ranks_flagged_rows_higher, true AS counts_add_up
       FROM v_flags, (VALUES ('random_forest'), ('gradient_boosting')) k(kind) GROUP BY 1""",
)
def _(t: Inputs):
    """Both detectors at full size in five folds; facts about the scores of all rows."""
    made = detection.cross_validate_detectors(
        t.view("v_flags"), MODELLED, "wonky_study_count", "respondentPk", ["event_id", "respondentPk"]
    )
    users = made.scores.groupBy("kind", "respondentPk").agg(F.count_distinct("fold").alias("n"))
    per_user = users.groupBy("kind").agg(F.count(F.lit(1)).alias("users"), F.max("n").alias("most_folds_of_a_user"))
    facts = made.scores.groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("positives"),
        F.count_distinct("fold").alias("folds"), F.every(F.col("score").between(0, 1)).alias("scores_in_range"),
    )
    folds = made.folds.groupBy("kind").agg(
        F.every(F.col("auc") > 0.5).alias("ranks_flagged_rows_higher"), F.sum(F.expr("tp + fp + fn + tn")).alias("__n")
    )
    joined = facts.join(per_user, "kind").join(folds, "kind")
    return joined.withColumn("counts_add_up", F.col("__n") == F.col("rows")).drop("__n")


CURVE_SQL = """WITH s AS (SELECT 'length' AS kind, n_chars / (SELECT max(n_chars) + 1 FROM v_scored)::DOUBLE AS score, toxic AS label FROM v_scored
      UNION ALL SELECT 'id', doc_id / (SELECT max(doc_id) + 1 FROM v_scored)::DOUBLE, toxic FROM v_scored),
    h AS (SELECT kind, floor(score * 10000)::INT AS bin, count(*) AS n, sum(label) AS p FROM s GROUP BY 1, 2),
    c AS (SELECT kind, bin, sum(n) OVER w AS flagged, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY kind) AS positives
      FROM h WINDOW w AS (PARTITION BY kind ORDER BY bin DESC)),
    r AS (SELECT *, tp / flagged::DOUBLE AS "precision", tp / positives::DOUBLE AS recall,
      2 * tp / (flagged + positives)::DOUBLE AS f1 FROM c)"""


@query(
    "m16_score_curve",
    f"""{CURVE_SQL} SELECT kind, bin, CAST(flagged AS BIGINT) AS flagged, CAST(tp AS BIGINT) AS tp, round("precision", 9) AS "precision",
      round(recall, 9) AS recall, round(f1, 9) AS f1 FROM r""",
)
def _(t: Inputs):
    curve = detection.score_curve(_two_scores(t), ["kind"])
    return curve.select("kind", "bin", "flagged", "tp", *[F.round(n, 9).alias(n) for n in ("precision", "recall", "f1")])


@query(
    "m16_chosen_cut",
    f"""{CURVE_SQL}, k AS (SELECT *, "precision" >= 0.05 AND recall >= 0.7 AS meets_targets FROM r),
      t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY meets_targets DESC, f1 DESC, bin) AS rn FROM k)
    SELECT kind, bin, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1, meets_targets,
      row_number() OVER (ORDER BY f1 DESC, kind) = 1 AS best FROM t WHERE rn = 1""",
)
def _(t: Inputs):
    chosen = detection.choose_cut(detection.score_curve(_two_scores(t), ["kind"]), 0.05, 0.7)
    return chosen.select("kind", "bin", *[F.round(n, 9).alias(n) for n in ("precision", "recall", "f1")], "meets_targets", "best")


@query(
    "m16_fold_metrics",
    f"""{CURVE_SQL}, q AS (SELECT *, rank() OVER (PARTITION BY kind ORDER BY score) +
          (count(*) OVER (PARTITION BY kind, score) - 1) / 2.0 AS rk FROM s)
    SELECT kind, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
      count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 0 AND score < 0.5) AS tn,
      round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
        / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 9) AS auc FROM q GROUP BY 1""",
)
def _(t: Inputs):
    made = detection.fold_metrics(_two_scores(t), ["kind"])
    return made.select("kind", "tp", "fp", "fn", "tn", F.round("auc", 9).alias("auc"))


def _two_scores(t: Inputs):
    """Two plain scores of the labelled documents, each from 0 to below 1."""
    rows = t.view("v_scored")
    top = rows.agg((F.max("n_chars") + 1).alias("n"), (F.max("doc_id") + 1).alias("d"))
    rows = rows.crossJoin(F.broadcast(top))  # one row
    scores = (("length", F.col("n_chars") / F.col("n")), ("id", F.col("doc_id") / F.col("d")))
    parts = [rows.select(F.lit(k).alias("kind"), s.alias("score"), F.col("toxic").alias("label")) for k, s in scores]
    return parts[0].unionByName(parts[1])


@query(
    "m16_confusion_scores",
    """SELECT tp, fp, fn, tn, round((tp + tn) / n, 9) AS accuracy, round(tp / nullif(tp + fp, 0), 9) AS "precision",
         round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1
       FROM (SELECT count(*) FILTER (quality = 1 AND n_chars > 900) AS tp, count(*) FILTER (quality = 0 AND n_chars > 900) AS fp,
         count(*) FILTER (quality = 1 AND n_chars <= 900) AS fn, count(*) FILTER (quality = 0 AND n_chars <= 900) AS tn,
         CAST(count(*) AS DOUBLE) AS n FROM v_scored)""",
)
def _(t: Inputs):
    scored = t.view("v_scored").select(
        F.col("quality").alias("label"), (F.col("n_chars") > 900).cast("int").alias("prediction")
    )
    made = logistic.confusion(scored)
    ratios = ("accuracy", "precision", "recall", "f1")
    return made.select("tp", "fp", "fn", "tn", *[F.round(n, 9).alias(n) for n in ratios])


@query(
    "m17_cut_off_and_reduction",
    """WITH q AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.95::DOUBLE) AS cut FROM v_scored)
       SELECT round(avg(CASE WHEN n_chars > cut THEN 1 ELSE 0 END), 9) AS flag_rate, round(avg(toxic), 9) AS baseline_rate,
         round(avg(CASE WHEN n_chars <= cut THEN toxic END), 9) AS remaining_rate,
         round(1 - avg(CASE WHEN n_chars <= cut THEN toxic END) / avg(toxic), 9) AS reduction FROM v_scored, q""",
)
def _(t: Inputs):
    flagged = detection.flag_top_share(t.view("v_scored"), "n_chars", 0.05)
    made = detection.rate_reduction(flagged, "toxic")
    return made.select(*[F.round(n, 9).alias(n) for n in made.columns])


@query("m18_outlier_scores")
def _(t: Inputs):
    made = detection.outlier_scores(*_embeddings(t))
    return made.select("vec_id", F.round("outlier_score", 6).alias("outlier_score"), "is_outlier")


@query(
    "u3_significant_everywhere",
    f"""SELECT feature FROM ({REPORT_SOURCE}) WHERE linear_p_value < 0.03::DOUBLE AND rf_importance_pct >= 2 AND lr_odds_ratio > 0.3::DOUBLE""",
)
def _(t: Inputs):
    table = t.sql(REPORT_SOURCE.replace("::DOUBLE", "D").replace('"VIF"', "VIF"))
    table = table.withColumns(
        {"rf_importance": F.col("rf_importance_pct"), "lr_significant": F.col("lr_odds_ratio") > 0.3}
    )
    return compare.get_significant_features(table, 0.03, 2.0)


@query("j9_outer_join_results", """SELECT coalesce(a.n_name, b.n_name) AS n_name, a.suppliers, b.customers FROM
    (SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 GROUP BY 1) a
    FULL JOIN (SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey > 4 GROUP BY 1) b
    ON a.n_name = b.n_name""")
def _(t: Inputs):
    nation = F.broadcast(t.table("nation").select("n_nationkey", "n_name"))
    rich = t.table("supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    some = t.table("customer").where("c_nationkey > 4").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    a = rich.groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"))
    b = some.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))
    return joins.outer_join_results(a, b, ["n_name"])


@query("j10_importance_joins")
def _(t: Inputs):
    rows = t.view("v_flags")
    _, table, factors = linear.build_linear_baseline(rows, MODELLED, "wonky_study_count")
    fit = forest.build_random_forest_model(rows, MODELLED, "wonky_study_count", "respondentPk")
    return compare.compare_models(table, fit.importance, None, factors)


def _settings(t: Inputs) -> tuple[config.PathSettings, config.StudySettings]:
    base = scratch_path(t.spark, "projects")
    rows = t.view("v_balance").withColumnRenamed("ip", "request-remote-addr")
    for uuid in STUDY_LABELS:
        rows.where(F.col("uuid") == uuid).drop("uuid").write.parquet(tables.balance_path(base, uuid))
    paths = config.PathSettings(t.silver, base, "GB", "2024-01-01", "panel", "parquet")
    return paths, config.StudySettings(STUDY_LABELS)


PULL_SQL = """
  WITH g AS (SELECT respondent_pk, task_pk, survey_pk, exposure_band, yob, ip, CAST(sum(wonky_study_count) AS BIGINT)
      AS wonky_study_count FROM (SELECT b.*, t.length_of_task FROM v_study b JOIN v_task t ON b.task_pk = t.pk)
      WHERE yob IS NOT NULL AND length_of_task IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6)
  SELECT c.respondentPk, c.taskPk, u.gender, i.fulcrum_region, t.length_of_task AS task_length_of_task,
    g.wonky_study_count, g.exposure_band, count(*) AS n
  FROM v_user u JOIN v_completion c ON u.respondent_pk = c.respondentPk
  JOIN v_info i ON u.respondent_pk = i.respondent_pk
  LEFT JOIN (SELECT * FROM v_task WHERE origin = 'panel') t ON c.taskPk = t.pk
  LEFT JOIN g ON c.respondentPk = g.respondent_pk AND c.taskPk = g.task_pk
  WHERE u.country = 'GB' AND i.country = 'GB' AND c.taskOrigin = 'panel' GROUP BY ALL"""


@query("e1_panel_pull", PULL_SQL)
def _(t: Inputs):
    pulled = panel.pull_panel(t.spark, *_settings(t))
    columns = ["respondentPk", "taskPk", "gender", "fulcrum_region", "task_length_of_task",
               "wonky_study_count", "exposure_band"]
    return pulled.user_info_df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def _pulled(t: Inputs):
    """The pulled completions, written and read back as between the real steps."""
    path = scratch_path(t.spark, "pulled")
    panel.pull_panel(t.spark, *_settings(t)).write({"user_info_df": path})
    return sinks.read_table(t.spark, path)


@query("e2_engineered_features")
def _(t: Inputs):
    return panel.engineer_features(_pulled(t))


E2_SQL = f"""
  WITH g AS (SELECT respondent_pk, task_pk, survey_pk, exposure_band, yob, ip, count(*) AS k
      FROM (SELECT b.*, t.length_of_task FROM v_study b JOIN v_task t ON b.task_pk = t.pk)
      WHERE yob IS NOT NULL AND length_of_task IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6),
    d AS ({DEVICE_SQL}),
    r AS (SELECT c.*, u.quality, u.risk, u.gender, i.fulcrum_region, t.length_of_task, g.exposure_band, g.ip, d.hardware,
        CAST(floor(epoch(c.date_completed)) - floor(epoch(c.date_created)) AS DOUBLE) AS x, n.total
      FROM v_user u JOIN v_completion c ON u.respondent_pk = c.respondentPk JOIN v_info i ON u.respondent_pk = i.respondent_pk
      JOIN (SELECT respondentPk, count(*) AS total FROM v_completion WHERE taskOrigin = 'panel' GROUP BY 1) n
        ON c.respondentPk = n.respondentPk
      LEFT JOIN d ON u.respondent_pk = d.respondent_pk
      LEFT JOIN (SELECT * FROM v_task WHERE origin = 'panel') t ON c.taskPk = t.pk
      LEFT JOIN g ON c.respondentPk = g.respondent_pk AND c.taskPk = g.task_pk
      WHERE u.country = 'GB' AND i.country = 'GB' AND c.taskOrigin = 'panel'),
    w AS (SELECT *, floor((epoch_us(date_completed) - min(epoch_us(date_created)) OVER (PARTITION BY respondentPk))
        / 86400000000.0::DOUBLE) AS days, coalesce(CAST(length_of_task AS VARCHAR), 'unknown') AS lg FROM r),
    q AS (SELECT lg, quantile_cont(x, 0.16::DOUBLE) AS fast FROM w GROUP BY 1),
    ips AS (SELECT respondentPk, count(DISTINCT ip) AS ips FROM w GROUP BY 1)
  SELECT w.respondentPk, count(*) AS n, sum(CASE WHEN isodow(date_completed) = 1 THEN 1 ELSE 0 END)::BIGINT AS is_monday,
    sum(CASE WHEN hour(date_completed) >= 22 OR hour(date_completed) <= 6 THEN 1 ELSE 0 END)::BIGINT AS is_night,
    sum(CASE WHEN x < fast THEN 1 ELSE 0 END)::BIGINT AS is_fast,
    sum(CASE WHEN quality < 90 THEN 1 ELSE 0 END)::BIGINT AS "quality<90",
    sum(CASE WHEN days BETWEEN 3 AND 10 THEN 1 ELSE 0 END)::BIGINT AS days_active_3_to_10,
    sum(CASE WHEN fulcrum_region = 'C' THEN 1 ELSE 0 END)::BIGINT AS "fulcrum_region_mapped_London",
    sum(CASE WHEN total BETWEEN 26 AND 75 THEN 1 ELSE 0 END)::BIGINT AS total_tasks_26_75,
    sum(CASE WHEN hardware = 'qcom' THEN 1 ELSE 0 END)::BIGINT AS hardware_category_qualcomm,
    sum(CASE WHEN round_even(risk, -1) = 50 THEN 1 ELSE 0 END)::BIGINT AS risk_round10_50,
    sum(CASE WHEN gender = 'female' THEN 1 ELSE 0 END)::BIGINT AS gender_female,
    sum(CASE WHEN ips = 3 THEN 1 ELSE 0 END)::BIGINT AS ip_address_count_3
  FROM w JOIN q ON w.lg = q.lg JOIN ips ON w.respondentPk = ips.respondentPk GROUP BY 1"""


@query("e2_feature_sums", E2_SQL)
def _(t: Inputs):
    """One feature of each kind from the engineered table, summed per respondent."""
    made = panel.engineer_features(_pulled(t))
    names = ["is_monday", "is_night", "is_fast", "quality<90", "days_active_3_to_10",
             "fulcrum_region_mapped_London", "total_tasks_26_75", "hardware_category_qualcomm",
             "risk_round10_50", "gender_female", "ip_address_count_3"]
    made = sparse.with_columns(made, ["ip_address_count_3"])
    # a category that does not occur has no column: none of its rows
    flags = {n: c(n) if n in made.columns else F.lit(0) for n in names}
    return made.groupBy("respondentPk").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f.cast("int")).alias(n) for n, f in flags.items()]
    )


@query("e3_tests_on_features")
def _(t: Inputs):
    path = scratch_path(t.spark, "features")
    sinks.write_table(panel.engineer_features(_pulled(t)), path)
    made = sinks.read_table(t.spark, path)
    sets = {
        "days": panel.feature_names(made, "is_mon", "is_tue", "is_sat"),
        "tenure": panel.feature_names(made, "days_active_"),
        "gender": panel.feature_names(made, "gender_"),
        "scores": ["risk,", "quality", "not a column"],
    }
    results, _ = panel.test_features(select.keep_known(made, ["wonky_study_count"]), sets)
    return results.select("feature_set", "feature", c("ols_t_statistic"), c("logit_odds_ratio"))


def _many_titles(t: Inputs):
    """Engineered features with nearly as many task titles as completions."""
    pulled = _pulled(t)
    title = F.concat(F.lit("Task "), F.col("respondentPk"), F.lit(" "), F.unix_micros(F.col("date_completed").cast("timestamp")) % 97)
    return panel.engineer_features(pulled.withColumn("taskTitle", title))


# the completions with those titles, the outcome and each respondent's number of addresses
TITLES_SQL = f"""
  g AS (SELECT respondent_pk, task_pk, survey_pk, exposure_band, yob, ip, CAST(sum(wonky_study_count) AS BIGINT) AS y
      FROM (SELECT b.*, t.length_of_task FROM v_study b JOIN v_task t ON b.task_pk = t.pk)
      WHERE yob IS NOT NULL AND length_of_task IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6),
  r AS (SELECT c.respondentPk AS u, coalesce(g.y, 0)::DOUBLE AS y, g.ip, t.length_of_task,
      concat('taskTitle_Task ', c.respondentPk, ' ', epoch_us(c.date_completed) % 97) AS title
    FROM v_user u JOIN v_completion c ON u.respondent_pk = c.respondentPk JOIN v_info i ON u.respondent_pk = i.respondent_pk
    LEFT JOIN (SELECT * FROM v_task WHERE origin = 'panel') t ON c.taskPk = t.pk
    LEFT JOIN g ON c.respondentPk = g.respondent_pk AND c.taskPk = g.task_pk
    WHERE u.country = 'GB' AND i.country = 'GB' AND c.taskOrigin = 'panel'),
  f AS (SELECT u, y, title AS feature FROM r
    UNION ALL SELECT u, y, concat('ip_address_count_', count(DISTINCT ip) OVER (PARTITION BY u)) FROM r
    UNION ALL SELECT u, y, concat('task_length_of_task_', coalesce(length_of_task::VARCHAR, 'nan')) FROM r)"""


@query(
    "e2_open_vocabulary",
    f"""WITH {TITLES_SQL} SELECT feature, count(*) AS rows, count(*)::DOUBLE AS total,
      count(DISTINCT u) AS respondents, min(u) AS first, max(u) AS last FROM f GROUP BY 1""",
)
def _(t: Inputs):
    """Every feature of the open vocabularies, found without a column or a list of them."""
    entries = _many_titles(t).select("respondentPk", F.inline(sparse.COLUMN))
    return entries.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("x").alias("total"),
        F.count_distinct("respondentPk").alias("respondents"),
        F.min("respondentPk").alias("first"), F.max("respondentPk").alias("last"),
    )


@query(
    "e3_open_vocabulary",
    f"""WITH {TITLES_SQL},
      tot AS (SELECT count(*) AS n, count(DISTINCT u) AS g, sum(y) AS sy, sum((y > 0)::INT) AS sb FROM r),
      per AS (SELECT feature, count(*) AS n1, sum(y) AS sy1, sum((y > 0)::INT) AS sb1 FROM f GROUP BY 1),
      fit AS (SELECT feature, n1, n, g, sy1 / n1 - (sy - sy1) / (n - n1) AS b1, (sy - sy1) / (n - n1) AS a, n1 / n::DOUBLE AS p,
          sb1 / n1::DOUBLE AS p1, (sb - sb1) / (n - n1)::DOUBLE AS p0
        FROM per, tot WHERE n1 < n),
      users AS (SELECT u, count(*) AS nu, sum(y) AS su FROM r GROUP BY 1),
      own AS (SELECT feature, u, count(*) AS k, sum(y) AS s FROM f GROUP BY 1, 2),
      score AS (SELECT fit.feature, coalesce(s, 0) - a * coalesce(k, 0) - b1 * coalesce(k, 0)
          - p * (su - a * nu - b1 * coalesce(k, 0)) AS v
        FROM fit CROSS JOIN users LEFT JOIN own ON own.feature = fit.feature AND own.u = users.u),
      se AS (SELECT feature, sum(v * v) AS meat FROM score GROUP BY 1)
    SELECT CASE WHEN feature LIKE 'taskTitle%' THEN 'titles' ELSE 'addresses' END AS feature_set, feature,
      round(b1, 8) AS ols_mean_difference,
      round(b1 / (sqrt(meat * g / (g - 1) * (n - 1) / (n - 2)) / (n * p * (1 - p))), 5) AS ols_t_statistic,
      CASE WHEN p1 > 0 AND p1 < 1 AND p0 > 0 AND p0 < 1 THEN round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 8) END
        AS logit_log_odds_coef
    FROM fit JOIN se USING (feature) WHERE feature NOT LIKE 'task_length%'""",
)
def _(t: Inputs):
    """Both regressions for every title and number of addresses, over all completions."""
    made = _many_titles(t).drop("exposure_band")
    sets = {"titles": ["taskTitle_*"], "addresses": ["ip_address_count_*"], "none": ["gone_*"]}
    results, _ = panel.test_features(materialise(made), sets)
    digits = {"ols_mean_difference": 8, "ols_t_statistic": 5, "logit_log_odds_coef": 8}
    return results.select("feature_set", "feature", *[F.round(c(n), d).alias(n) for n, d in digits.items()])
