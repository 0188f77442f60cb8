"""Profiles of flagged against other completions, rankings and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import FEATURES, Inputs, query
from panelsift.columns import c
from panelsift.functions import sparse, temporal
from panelsift.operators import aggregates, ordered, profile, windows


def breakdown_sql(features, columns: str, source: str = "v_flags", order: str = "") -> str:
    parts = [
        f"""SELECT '{f}' AS feature, 100 * avg({f}) AS all_pct,
          100 * avg(CASE WHEN wonky_study_count > 0 THEN {f} END) AS group_pct,
          100 * avg(CASE WHEN wonky_study_count IS NULL THEN {f} END) AS other_pct FROM {source}"""
        for f in features
    ]
    return f"SELECT {columns} FROM ({' UNION ALL '.join(parts)}) {order}"


ROUNDED = """feature, round(all_pct, 6) AS all_pct, round(group_pct, 6) AS group_pct,
  round(other_pct, 6) AS other_pct, round(group_pct - other_pct, 6) AS delta_pct"""


def _rounded(df, *names):
    return df.select(
        *[(F.round(c(n), 6).alias(n) if dict(df.dtypes)[n] == "double" else c(n)) for n in names]
    )


FLAGSHIP = ("is_weekend", "is_monday", "is_friday", "is_night", "is_business_hour")
FLAGSHIP_SQL = breakdown_sql(
    FLAGSHIP,
    ROUNDED,
    """(SELECT CASE WHEN wd >= 5 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN wd = 0 THEN 1 ELSE 0 END AS is_monday,
         CASE WHEN wd = 4 THEN 1 ELSE 0 END AS is_friday, CASE WHEN hr >= 22 OR hr <= 6 THEN 1 ELSE 0 END AS is_night,
         CASE WHEN hr BETWEEN 9 AND 17 THEN 1 ELSE 0 END AS is_business_hour, wonky_study_count
       FROM (SELECT CAST(hour(co.date_completed) AS INT) AS hr, isodow(co.date_completed) - 1 AS wd,
           s.wonky_study_count
         FROM v_completion co LEFT JOIN (SELECT respondent_pk, task_pk, sum(wonky_study_count) AS wonky_study_count
           FROM v_study GROUP BY 1, 2) s ON co.respondentPk = s.respondent_pk AND co.taskPk = s.task_pk
         WHERE co.taskOrigin = 'panel' AND co.date_completed >= TIMESTAMP '2024-01-03'))""",
)


@query("flag_breakdown", FLAGSHIP_SQL)
def _(t: Inputs):
    """Load, enrich, merge the study flags, derive temporal flags, compare the groups."""
    from panelsift.operators import joins
    from panelsift.sources.tables import TASK_RENAMES

    done = t.view("v_completion").where(
        (F.col("taskOrigin") == "panel") & (F.col("date_completed") >= F.lit("2024-01-03").cast("timestamp_ntz"))
    )
    tasks = t.view("v_task").withColumnsRenamed(TASK_RENAMES)
    study = t.view("v_study").withColumnRenamed("respondent_pk", "balance_respondentPk")
    merged = joins.join_panel(done, tasks, study, dedupe=True)
    flags = temporal.create_all_temporal_features(merged)
    rows = profile.breakdown(flags, FLAGSHIP)
    return _rounded(rows, "feature", "all_pct", "group_pct", "other_pct", "delta_pct")


@query(
    "a6_user_level_proportions",
    f"""SELECT respondentPk, round(avg(CASE WHEN wonky_study_count > 0 THEN 1 ELSE 0 END), 6) AS group_binary,
        {", ".join(f"round(avg({f}), 6) AS {f}" for f in FEATURES)}, count(*) AS n_tasks
        FROM v_flags GROUP BY 1""",
)
def _(t: Inputs):
    users = aggregates.aggregate_user_level_proportions(t.view("v_flags"), [*FEATURES, "absent"])
    return _rounded(users, *users.columns)


@query("a8_breakdown", breakdown_sql(FEATURES, ROUNDED))
def _(t: Inputs):
    rows = profile.breakdown(t.view("v_flags"), [*FEATURES, "absent"])
    return _rounded(rows, "feature", "all_pct", "group_pct", "other_pct", "delta_pct")


@query(
    "a8_breakdown_open_vocabulary",
    """WITH r AS (SELECT concat('ip_', ip) AS feature, wonky_study_count AS w FROM v_fact),
      t AS (SELECT count(*) AS n, count(*) FILTER (w > 0) AS g, count(*) FILTER (w IS NULL) AS o FROM r)
    SELECT feature, round(100 * count(*) / any_value(n)::DOUBLE, 6) AS all_pct,
      round(100 * count(*) FILTER (w > 0) / any_value(g)::DOUBLE, 6) AS group_pct,
      round(100 * count(*) FILTER (w IS NULL) / any_value(o)::DOUBLE, 6) AS other_pct FROM r, t GROUP BY feature
    UNION ALL SELECT 'is_night', round(100 * avg(is_night), 6), round(100 * avg(is_night) FILTER (wonky_study_count > 0), 6),
      round(100 * avg(is_night) FILTER (wonky_study_count IS NULL), 6) FROM v_flags""",
)
def _(t: Inputs):
    """Shares of every address among all, flagged and other rows, next to a plain flag."""
    rows = t.view("v_fact").select("wonky_study_count", "ip", F.expr("CAST(hr >= 22 OR hr <= 6 AS INT)").alias("is_night"))
    made = profile.breakdown(sparse.encode(rows, {"ip": False}), ["is_night"], sparse=sparse.COLUMN)
    return _rounded(made, "feature", "all_pct", "group_pct", "other_pct")


ZERO_SQL = breakdown_sql(FEATURES, ROUNDED).replace(
    "CASE WHEN wonky_study_count IS NULL", "CASE WHEN wonky_study_count = 0"
)


@query("a8_breakdown_without_missing", ZERO_SQL.replace("FROM v_flags", "FROM v_flags WHERE wonky_study_count IS NOT NULL"))
def _(t: Inputs):
    rows = profile.breakdown(t.view("v_flags").dropna(subset=["wonky_study_count"]), FEATURES)
    return _rounded(rows, "feature", "all_pct", "group_pct", "other_pct", "delta_pct")


SPEED_FLAGS_SQL = """(SELECT wonky_study_count, CASE WHEN x < f THEN 1 ELSE 0 END AS is_fast,
    CASE WHEN x < sf THEN 1 ELSE 0 END AS is_suspiciously_fast, CASE WHEN x > s THEN 1 ELSE 0 END AS is_slow,
    CASE WHEN x > ss THEN 1 ELSE 0 END AS is_suspiciously_slow,
    CASE WHEN x >= f AND x <= s THEN 1 ELSE 0 END AS is_normal_speed
  FROM (SELECT wonky_study_count, CAST(task_time_taken_s AS DOUBLE) AS x FROM v_fact),
    (SELECT quantile_cont(x, 0.025::DOUBLE) AS sf, quantile_cont(x, 0.16::DOUBLE) AS f,
       quantile_cont(x, 0.84::DOUBLE) AS s, quantile_cont(x, 0.975::DOUBLE) AS ss
     FROM (SELECT CAST(task_time_taken_s AS DOUBLE) AS x FROM v_fact)))"""


@query("a9_speed_breakdown", breakdown_sql(tuple(profile.SPEED_LABELS), ROUNDED, SPEED_FLAGS_SQL))
def _(t: Inputs):
    from panelsift.functions.speed import create_task_speed_features

    made = create_task_speed_features(t.view("v_fact").drop("task_length_of_task"))
    rows = profile.task_speed_breakdown(made)
    return _rounded(rows, "feature", "all_pct", "group_pct", "other_pct", "delta_pct")


@query("a10_deltas", breakdown_sql(FEATURES, "feature, round(group_pct - other_pct, 6) AS delta_pct"))
def _(t: Inputs):
    rows = profile.calculate_temporal_feature_deltas(t.view("v_flags"), FEATURES)
    return _rounded(rows, "feature", "delta_pct")


CHART_NAMES = " ".join(
    f"WHEN '{f}' THEN '{profile.display_name(f, profile.CHART_LABELS)}'" for f in FEATURES
)


@query(
    "a10_chart_data",
    breakdown_sql(
        FEATURES,
        f"""CASE feature {CHART_NAMES} END AS feature, round(group_pct - other_pct, 6) AS delta,
            round(group_pct, 6) AS wonky_pct, round(other_pct, 6) AS non_wonky_pct""",
    ),
)
def _(t: Inputs):
    rows = profile.breakdown_chart_data(t.view("v_flags"), FEATURES)
    return _rounded(rows, "feature", "delta", "wonky_pct", "non_wonky_pct")


METRICS = ("risk", "quality", "task_time_taken_s", "task_points")


def _group_metric(m: str) -> str:
    one, two = "CASE WHEN g = 1 THEN x END", "CASE WHEN g = 0 THEN x END"
    cells = []
    for side, x in (("wonky", one), ("non_wonky", two)):
        cells += [
            f"round(avg({x}), 6) AS {side}_mean", f"round(median({x}), 6) AS {side}_median",
            f"round(stddev_samp({x}), 6) AS {side}_std", f"count({x}) AS {side}_count",
        ]
    return f"""SELECT '{m}' AS metric, {", ".join(cells)}, round(avg({one}) - avg({two}), 6) AS mean_difference,
      round(median({one}) - median({two}), 6) AS median_difference
      FROM (SELECT CAST({m} AS DOUBLE) AS x, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS g FROM v_fact)"""


@query("a11_feature_breakdown_table", " UNION ALL ".join(_group_metric(m) for m in METRICS))
def _(t: Inputs):
    rows = t.view("v_fact").withColumn("g", F.when(F.col("event_type") == "error", 1).otherwise(0))
    table = profile.create_feature_breakdown_table(
        rows, "event_type", "g", metrics=[*METRICS, "absent"]
    )
    return _rounded(table, *table.columns)


CUTS = {"q025": 0.025, "q16": 0.16, "q84": 0.84, "q975": 0.975, "q95": 0.95, "q9999": 0.9999,
        "q01": 0.01, "q99": 0.99}


@query(
    "a12_quantiles",
    "SELECT count(x) AS n, "
    + ", ".join(f"round(quantile_cont(x, {p}::DOUBLE), 6) AS {n}" for n, p in CUTS.items())
    + " FROM (SELECT value AS x FROM events)",
)
def _(t: Inputs):
    made = ordered.quantiles(t.table("events"), "value", CUTS)
    return _rounded(made, *made.columns)


@query(
    "a12_quantiles_by_group",
    "SELECT l_returnflag, l_linestatus, count(x) AS n, "
    + ", ".join(f"round(quantile_cont(x, {p}::DOUBLE), 6) AS {n}" for n, p in CUTS.items())
    + " FROM (SELECT l_returnflag, l_linestatus, l_extendedprice AS x FROM lineitem) GROUP BY 1, 2",
)
def _(t: Inputs):
    keys = ["l_returnflag", "l_linestatus"]
    made = ordered.quantiles(t.table("lineitem"), "l_extendedprice", CUTS, keys)
    return _rounded(made, *made.columns)


@query(
    "a13_distribution",
    """SELECT task_time_taken_s, n, round(n / total, 9) AS share,
         round(sum(n) OVER (ORDER BY task_time_taken_s) / total, 9) AS cumulative_share
       FROM (SELECT task_time_taken_s, count(*) AS n FROM v_fact WHERE task_time_taken_s IS NOT NULL GROUP BY 1),
         (SELECT CAST(count(*) AS DOUBLE) AS total FROM v_fact)""",
)
def _(t: Inputs):
    made = profile.distribution(t.view("v_fact"), "task_time_taken_s")
    return made.select(
        "task_time_taken_s", "n", F.round("share", 9).alias("share"),
        F.round("cumulative_share", 9).alias("cumulative_share"),
    )


@query(
    "a13_category_shares",
    """SELECT coalesce(gender, 'unknown') AS gender, count(*) AS n, round(count(*) / CAST((SELECT count(*)
         FROM v_fact WHERE wonky_study_count > 0) AS DOUBLE), 9) AS share
       FROM v_fact WHERE wonky_study_count > 0 GROUP BY 1""",
)
def _(t: Inputs):
    flagged = t.view("v_fact").where("wonky_study_count > 0")
    made = profile.distribution(flagged, "gender", "unknown", cumulative=False)
    return made.select("gender", "n", F.round("share", 9).alias("share"))


@query(
    "a14_two_populations",
    """SELECT task_points, round(100 * count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM v_fact), 6) AS everyone,
         round(100 * count(*) FILTER (wonky_study_count > 0)
           / (SELECT CAST(count(*) AS DOUBLE) FROM v_fact WHERE wonky_study_count > 0), 6) AS flagged,
         round(100 * count(*) FILTER (wonky_study_count > 0)
           / (SELECT CAST(count(*) AS DOUBLE) FROM v_fact WHERE wonky_study_count > 0)
           - 100 * count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM v_fact), 6) AS delta
       FROM v_fact GROUP BY 1""",
)
def _(t: Inputs):
    made = profile.compare_distributions(
        t.view("v_fact"),
        "task_points",
        {"everyone": F.lit(True), "flagged": F.col("wonky_study_count") > 0},
        "everyone",
        "flagged",
    )
    return _rounded(made, *made.columns)


@query(
    "a14_by_user_type_and_exposure",
    """SELECT user_type, exposure_band, task_points, count(*) AS n,
         round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY user_type, exposure_band), 6) AS percent
       FROM (SELECT *, CASE WHEN wonky_study_count > 0 THEN 'flagged' ELSE 'all' END AS user_type FROM v_fact
         WHERE exposure_band IS NOT NULL) GROUP BY 1, 2, 3""",
)
def _(t: Inputs):
    kind = F.when(F.col("wonky_study_count") > 0, "flagged").otherwise("all")
    rows = t.view("v_fact").withColumn("user_type", kind)
    made = profile.distribution_by_group(rows, "task_points", ["user_type", "exposure_band"])
    return _rounded(made, "user_type", "exposure_band", "task_points", "n", "percent")


@query(
    "a15_histogram",
    """SELECT CAST(b AS INT) AS bin, count(f) AS count, max(f) AS wonky_any,
         round(100.0::DOUBLE * count(f) / sum(count(f)) OVER (), 6) AS percent,
         round((b - 0.5::DOUBLE) * (SELECT max(l_extendedprice) FROM lineitem) / 120, 6) AS bin_center
       FROM range(1, 121) AS bins(b) LEFT JOIN (SELECT l_linenumber % 2 AS f,
           CAST(greatest(least(ceil(l_extendedprice / (top / 120)), 120), 1) AS INT) AS bin
         FROM lineitem, (SELECT max(l_extendedprice) AS top FROM lineitem)) ON bin = b GROUP BY b""",
)
def _(t: Inputs):
    rows = t.table("lineitem").withColumn("f", F.col("l_linenumber") % 2)
    made = profile.equal_width_histogram(rows, "l_extendedprice", "f")
    return _rounded(made, *made.columns)


@query(
    "a17_daily_counts",
    "SELECT CAST(date_completed AS DATE) AS day, count(taskPk) AS tasks FROM v_fact WHERE respondentPk = 7 GROUP BY 1",
)
def _(t: Inputs):
    return aggregates.daily_task_counts(t.view("v_fact"), 7)


@query(
    "a18_exposure_and_gender",
    """WITH long AS (SELECT DISTINCT s.respondent_pk, s.exposure_band, f.gender, x.label_tags
         FROM v_study s JOIN v_flags f ON s.respondent_pk = f.respondentPk
         JOIN (SELECT unnest(['is_weekend', 'is_night', 'is_error']) AS label_tags) x
           ON CASE x.label_tags WHEN 'is_weekend' THEN f.is_weekend WHEN 'is_night' THEN f.is_night
              ELSE f.is_error END = 1 WHERE f.gender IS NOT NULL)
       SELECT label_tags, exposure_band, gender, count(*) AS n,
         CAST(sum(count(*)) OVER (PARTITION BY exposure_band, gender) AS BIGINT) AS group_total,
         round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY exposure_band, gender), 6) AS pct
       FROM long GROUP BY 1, 2, 3""",
)
def _(t: Inputs):
    made = aggregates.exposure_and_gender_counts(
        t.view("v_study"), t.view("v_flags"), ["is_weekend", "is_night", "is_error"], "respondent_pk"
    )
    return _rounded(made, *made.columns)


@query(
    "a19_exposure_share",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS feature,
          round(sum(CASE WHEN exposure_band = 'control' THEN {f} ELSE 0 END) / CAST(count(*) AS DOUBLE), 9) AS control,
          round(sum(CASE WHEN exposure_band = 'exposed' THEN {f} ELSE 0 END) / CAST(count(*) AS DOUBLE), 9) AS exposed,
          round((sum(CASE WHEN exposure_band = 'exposed' THEN {f} ELSE 0 END)
            - sum(CASE WHEN exposure_band = 'control' THEN {f} ELSE 0 END)) / CAST(count(*) AS DOUBLE), 9) AS delta
          FROM v_flags"""
        for f in FEATURES
    ),
)
def _(t: Inputs):
    made = profile.exposure_share(t.view("v_flags"), FEATURES)
    return made.select("feature", *[F.round(n, 9).alias(n) for n in ("control", "exposed", "delta")])


NULLABLE = ("gender", "task_time_taken_s", "wonky_study_count", "risk")


@query(
    "a20_null_counts",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count(*) - count({n}) AS null_count,
          round(1 - (count(*) - count({n})) / CAST(count(*) AS DOUBLE), 9) AS coverage FROM v_fact"""
        for n in NULLABLE
    ),
)
def _(t: Inputs):
    made = profile.null_counts(t.view("v_fact"), NULLABLE)
    return made.select("column", "null_count", F.round("coverage", 9).alias("coverage"))


def _describe_sql(m: str, by: str | None = None) -> str:
    extra = f"{by} AS \"group\", " if by else ""
    tail = f"WHERE {by} IS NOT NULL GROUP BY {by}" if by else ""
    x = f"CAST({m} AS DOUBLE)"
    return f"""SELECT '{m}' AS metric, {extra}count({m}) AS count, round(avg({x}), 6) AS mean,
      round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, round(max({x}), 6) AS max,
      round(quantile_cont({x}, 0.25::DOUBLE), 6) AS q25, round(quantile_cont({x}, 0.5::DOUBLE), 6) AS median,
      round(quantile_cont({x}, 0.75::DOUBLE), 6) AS q75 FROM v_fact {tail}"""


@query("a20_describe", " UNION ALL ".join(_describe_sql(m) for m in METRICS))
def _(t: Inputs):
    made = profile.describe(t.view("v_fact"), METRICS)
    return _rounded(made, *made.columns)


@query("a22_describe_by_group", " UNION ALL ".join(_describe_sql(m, "exposure_band") for m in METRICS))
def _(t: Inputs):
    made = profile.describe(t.view("v_fact"), METRICS, "exposure_band")
    return _rounded(made, *made.columns)


@query(
    "a21_task_time_diagnostics",
    """SELECT count(*) AS rows, count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std,
         min(s) AS min, max(s) AS max, count(*) - count(x) AS null_count, count(*) FILTER (x < 0) AS negative_count,
         count(*) FILTER (x > 3600) AS over_1_hour, count(*) FILTER (x > 86400) AS over_1_day,
         count(*) FILTER (x > 604800) AS over_1_week, quantile_cont(x, 0.25::DOUBLE) AS q25,
         quantile_cont(x, 0.5::DOUBLE) AS median, quantile_cont(x, 0.75::DOUBLE) AS q75,
         round(quantile_cont(x, 0.95::DOUBLE), 4) AS q95, round(quantile_cont(x, 0.99::DOUBLE), 4) AS q99
       FROM (SELECT s, CAST(s AS DOUBLE) AS x FROM (SELECT
         CAST(floor(epoch(date_completed)) - floor(epoch(date_created)) AS BIGINT) AS s FROM v_duration))""",
)
def _(t: Inputs):
    timed = t.view("v_duration").withColumn(
        "task_time_taken_s", windows.task_seconds("date_completed", "date_created")
    )
    made = profile.task_time_diagnostics(timed)
    rounded = {n: F.round(c(n), 4) for n in ("mean", "std", "q95", "q99")}
    return made.withColumns(rounded)


@query(
    "a21_date_diagnostics",
    """SELECT count(*) - count(date_created) AS created_null, count(*) - count(date_completed) AS completed_null,
         min(date_created) AS created_min, max(date_created) AS created_max, min(date_completed) AS completed_min,
         max(date_completed) AS completed_max, count(*) FILTER (date_created > date_completed) AS created_after_completed
       FROM v_duration""",
)
def _(t: Inputs):
    return profile.date_diagnostics(t.view("v_duration"), "date_created", "date_completed")


@query(
    "w5_share_within_group",
    """SELECT exposure_band, gender, count(*) AS n, round(100.0::DOUBLE * count(*)
         / sum(count(*)) OVER (PARTITION BY exposure_band), 6) AS pct
       FROM v_fact WHERE gender IS NOT NULL AND exposure_band IS NOT NULL GROUP BY 1, 2""",
)
def _(t: Inputs):
    rows = t.view("v_fact").dropna(subset=["gender"])
    made = profile.distribution_by_group(rows, "gender", ["exposure_band"])
    return made.select("exposure_band", "gender", "n", F.round("percent", 6).alias("pct"))


@query(
    "w6_running_total",
    """SELECT user_id, ts, event_id, CAST(sum(event_id % 10) OVER (PARTITION BY user_id
         ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events""",
)
def _(t: Inputs):
    rows = t.table("events").select("user_id", "ts", "event_id")
    return ordered.running_total(
        rows, {"running": F.col("event_id") % 10}, [F.col("ts"), F.col("event_id")], ["user_id"]
    )


@query(
    "w6_row_number",
    """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn
       FROM events""",
)
def _(t: Inputs):
    rows = t.table("events").select("event_id", "event_type", "value")
    order = [F.col("value").desc(), F.col("event_id")]
    return ordered.numbered(rows, ["event_type"], order, "rn").select("event_id", "rn")


@query(
    "w7_average_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (ORDER BY l_quantity DESC)
         + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS quantity_rank FROM lineitem""",
)
def _(t: Inputs):
    rows = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return ordered.average_rank(rows, "l_quantity", name="quantity_rank").drop("l_quantity")


@query(
    "w7_average_rank_by_group",
    """SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY floor(value))
         + (count(*) OVER (PARTITION BY event_type, floor(value)) - 1) / 2.0::DOUBLE AS value_rank FROM events""",
)
def _(t: Inputs):
    rows = t.table("events").select("event_id", "event_type", F.floor("value").alias("v"))
    ranked = ordered.average_rank(rows, "v", ["event_type"], descending=False, name="value_rank")
    return ranked.select("event_id", "value_rank")


@query(
    "t3_top_address_counts",
    """SELECT respondent_pk, count(ip) AS addresses FROM v_study WHERE wonky_study_count = 1 GROUP BY 1
       ORDER BY addresses DESC, respondent_pk LIMIT 10""",
)
def _(t: Inputs):
    counts = (
        t.view("v_study").where("wonky_study_count = 1").groupBy("respondent_pk").agg(F.count("ip").alias("addresses"))
    )
    return aggregates.top_k(counts, "addresses", 10, ["respondent_pk"])


@query("t4_seeded_sample")
def _(t: Inputs):
    return aggregates.hash_sample(t.view("v_fact"), 1000, ["event_id"]).select("event_id")
