"""Loading, selecting, joining and first aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import STUDY_LABELS, Inputs, query
from panelsift.columns import c, drop_duplicate_columns, exclude, select_existing
from panelsift.functions.bins import cap_at_one
from panelsift.operators import aggregates, joins, select, windows
from panelsift.session import scratch_path
from panelsift.sources import sinks, tables


@query(
    "s1_load_table",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000.0::DOUBLE",
)
def _(t: Inputs):
    filters = {"o_orderstatus": "F", "o_totalprice": (1000.0, None), "o_custkey": 7}
    rows = tables.load_table(t.spark, t.path("orders"), filters, fmt="parquet")
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query("s2_load_users", "SELECT * FROM v_user WHERE country = 'GB'")
def _(t: Inputs):
    return tables.load_user_table(t.spark, t.silver, fmt="parquet")


@query(
    "s3_load_completions",
    """SELECT respondentPk, taskPk, taskTitle, entryPoint FROM v_completion
       WHERE date_completed >= TIMESTAMP '2024-01-10' AND taskOrigin = 'panel'""",
)
def _(t: Inputs):
    rows = tables.load_task_complete_table(
        t.spark, t.silver, "2024-01-10", "panel", fmt="parquet"
    )
    return rows.select("respondentPk", "taskPk", "taskTitle", "entryPoint")


@query(
    "s4_load_respondent_info",
    """SELECT respondent_pk, fulcrum_household_income, fulcrum_region,
         len(gambling_participation_mc) AS answers
       FROM v_info WHERE country = 'GB'""",
)
def _(t: Inputs):
    info = tables.load_respondent_info_table(
        t.spark, t.silver, exclude_cols=["hobbies", "not there"], fmt="parquet"
    )
    answers = F.when(F.col("gambling_participation_mc").isNotNull(), F.size("gambling_participation_mc"))
    return info.withColumn("answers", answers.cast("bigint")).drop("gambling_participation_mc")


@query(
    "s5_load_tasks",
    """SELECT pk AS task_pk, origin, origin_id AS task_origin_id,
         targeting_type AS task_targeting_type, length_of_task AS task_length_of_task,
         points AS task_points, category AS task_category, country AS task_country
       FROM v_task WHERE origin = 'panel'""",
)
def _(t: Inputs):
    return tables.load_task_table(t.spark, t.silver, "panel", fmt="parquet")


DEVICE_SQL = """
  SELECT respondent_pk, hardware, manufacturer, os FROM (
    SELECT *, row_number() OVER (PARTITION BY respondent_pk ORDER BY date_created DESC NULLS LAST,
      hardware DESC NULLS LAST, manufacturer DESC NULLS LAST, os DESC NULLS LAST) AS rn
    FROM v_device) WHERE rn = 1"""


@query(
    "s6_load_devices_for_users",
    f"""SELECT u.respondent_pk, d.hardware, d.manufacturer, d.os FROM v_user u
        LEFT JOIN ({DEVICE_SQL}) d ON u.respondent_pk = d.respondent_pk WHERE u.country = 'GB'""",
)
def _(t: Inputs):
    users = tables.load_user_table(t.spark, t.silver, fmt="parquet")
    wanted = ["respondent_pk", "hardware", "manufacturer", "os", "os_version"]
    return tables.load_device_table(t.spark, t.silver, users, wanted, fmt="parquet")


STUDY_COLUMNS = ["respondent_pk", "survey_pk", "exposure_band", "yob", "platform_name"]


def _study_folder(t: Inputs) -> str:
    """One folder per study, as the study tables are laid out, two schemas among them."""
    base = scratch_path(t.spark, "projects")
    balance = t.view("v_balance")
    for uuid in STUDY_LABELS:
        rows = balance.where(F.col("uuid") == uuid).drop("uuid")
        if uuid in ("study_3", "study_9"):
            rows = rows.drop("yob")
        rows.write.parquet(tables.balance_path(base, uuid))
    return base


@query(
    "s7_load_one_study",
    """SELECT respondent_pk, survey_pk, exposure_band, yob, uuid FROM v_balance
       WHERE uuid = 'study_1' AND match_id_type = 'respondent_pk'""",
)
def _(t: Inputs):
    base = scratch_path(t.spark, "projects")
    rows = t.view("v_balance").where(F.col("uuid") == "study_1").drop("uuid")
    rows.write.parquet(tables.balance_path(base, "study_1"))
    one, problem = tables.load_study_balance(t.spark, "study_1", base, STUDY_COLUMNS, "parquet")
    if one is None:
        raise RuntimeError(problem)
    return one


@query(
    "s8_load_all_studies",
    """SELECT respondent_pk, survey_pk, exposure_band, uuid,
         CASE WHEN uuid IN ('study_3', 'study_9') THEN NULL ELSE yob END AS yob,
         CASE WHEN uuid IN ('study_0', 'study_1', 'study_2', 'study_3', 'study_4', 'study_5')
           THEN 1 ELSE 0 END AS wonky_study_count
       FROM v_balance WHERE match_id_type = 'respondent_pk'""",
)
def _(t: Inputs):
    loaded = tables.load_all_studies(
        t.spark, [*STUDY_LABELS, "study_missing"], _study_folder(t), STUDY_COLUMNS, "parquet"
    )
    if loaded.failed != ["study_missing"]:
        raise RuntimeError(str(loaded.errors))
    return joins.label_studies(loaded.balance, STUDY_LABELS)


@query("s9_write_and_read", "SELECT respondentPk, taskPk, entryPoint FROM v_completion")
def _(t: Inputs):
    path = scratch_path(t.spark, "completions")
    rows = t.view("v_completion").select("respondentPk", "taskPk", "entryPoint")
    sinks.write_outputs({"completions": rows}, {"completions": path})
    return sinks.read_table(t.spark, path)


@query("p1_select_and_exclude", "SELECT respondent_pk, gender, risk FROM v_user")
def _(t: Inputs):
    kept = select_existing(
        t.view("v_user"), ["respondent_pk", "nothing", "gender", "risk", "quality", "gender"]
    )
    return exclude(kept, ["quality", "nothing either"])


@query("p2_drop_duplicate_columns", "SELECT c_custkey AS k, c_name AS v FROM customer")
def _(t: Inputs):
    both = t.table("customer").select("c_custkey", "c_mktsegment", "c_name").toDF("k", "v", "v")
    return drop_duplicate_columns(both, keep="last")


@query(
    "p3_keep_known",
    "SELECT event_id, exposure_band FROM v_fact WHERE exposure_band IS NOT NULL AND wonky_study_count IS NOT NULL",
)
def _(t: Inputs):
    kept = select.keep_known(t.view("v_fact"), ["exposure_band", "wonky_study_count"])
    return kept.select("event_id", "exposure_band")


@query(
    "p4_label_studies",
    """SELECT wonky_study_count, count(*) AS n FROM (
         SELECT CASE WHEN uuid IN ('study_0','study_1','study_2','study_3','study_4','study_5')
           THEN 1 ELSE 0 END AS wonky_study_count FROM v_balance) GROUP BY 1""",
)
def _(t: Inputs):
    tagged = joins.label_studies(t.view("v_balance"), STUDY_LABELS)
    return tagged.groupBy("wonky_study_count").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p5_engineered_columns",
    """SELECT respondentPk, wonky_study_count, CASE WHEN risk < 50 THEN 1 ELSE 0 END AS "risk<50",
       quality FROM v_fact""",
)
def _(t: Inputs):
    base = t.view("v_fact")
    made = base.withColumn("risk<50", F.when(F.col("risk") < 50, 1).otherwise(0))
    return select.filter_to_engineered_features(
        made, set(base.columns), additional_columns=["quality", "absent", "quality"]
    )


@query(
    "p7_cap_at_one",
    """SELECT l_orderkey, l_linenumber, l_partkey,
         CASE WHEN l_quantity > 25 THEN NULL ELSE least(l_quantity / 10::DOUBLE, 1::DOUBLE) END AS capped
       FROM lineitem""",
)
def _(t: Inputs):
    ratio = F.when(F.col("l_quantity") <= 25, F.col("l_quantity") / 10)
    rows = t.table("lineitem").withColumn("ratio", ratio)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", cap_at_one("ratio").alias("capped"))


@query(
    "p8_winsorise",
    """WITH q AS (SELECT quantile_cont(CAST(task_time_taken_s AS DOUBLE), 0.95::DOUBLE) AS q FROM v_fact)
       SELECT event_id, CASE WHEN task_time_taken_s < q THEN CAST(task_time_taken_s AS DOUBLE) ELSE q END
         AS task_time_taken_s_capped FROM v_fact, q""",
)
def _(t: Inputs):
    from panelsift.operators.profile import winsorise_upper

    return winsorise_upper(t.view("v_fact"), "task_time_taken_s", 0.95).select(
        "event_id", "task_time_taken_s_capped"
    )


@query(
    "p9_trimmed_moments",
    """WITH q AS (SELECT quantile_cont(CAST(task_time_taken_s AS DOUBLE), 0.01::DOUBLE) AS lo,
                    quantile_cont(CAST(task_time_taken_s AS DOUBLE), 0.99::DOUBLE) AS hi FROM v_fact)
       SELECT round(avg(greatest(least(CAST(task_time_taken_s AS DOUBLE), hi), lo)), 6) AS trimmed_mean,
         round(stddev_samp(greatest(least(CAST(task_time_taken_s AS DOUBLE), hi), lo)), 6) AS trimmed_std
       FROM v_fact, q WHERE task_time_taken_s IS NOT NULL""",
)
def _(t: Inputs):
    from panelsift.operators.profile import trimmed_moments

    m = trimmed_moments(t.view("v_fact"), "task_time_taken_s")
    return m.select(*[F.round(n, 6).alias(n) for n in m.columns])


@query(
    "p10_fill_missing",
    """SELECT event_id, coalesce(wonky_study_count, 0::DOUBLE) AS wonky_study_count,
       coalesce(exposure_band, 'unknown') AS exposure_band FROM v_fact""",
)
def _(t: Inputs):
    filled = select.fill_missing(t.view("v_fact"), {"wonky_study_count": 0, "exposure_band": "unknown"})
    return filled.select("event_id", "wonky_study_count", "exposure_band")


@query(
    "p11_complete_cases",
    """SELECT event_id FROM v_fact WHERE task_time_taken_s IS NOT NULL AND gender IS NOT NULL
       AND wonky_study_count IS NOT NULL AND respondentPk IS NOT NULL""",
)
def _(t: Inputs):
    rows = select.complete_cases(
        t.view("v_fact"), ["task_time_taken_s", "gender"], "wonky_study_count", "respondentPk"
    )
    return rows.select("event_id")


@query("p12_remove_collinear", "SELECT event_id, is_monday, is_friday, is_night FROM v_flags")
def _(t: Inputs):
    names = ["is_weekend", "is_monday", "is_friday", "is_night", "is_business_hour", "is_fast"]
    kept = select.remove_collinear_features(names, ["is_fast"])
    return t.view("v_flags").select("event_id", *kept)


def _joined(t: Inputs):
    device = windows.latest_per_key(t.view("v_device"), ["respondent_pk"], "date_created")
    info = t.view("v_info").where("country = 'GB'").select("respondent_pk", "profile.*")
    users = t.view("v_user").where("country = 'GB'")
    done = t.view("v_completion").where("taskOrigin = 'panel'")
    return joins.join_user_task_respondent(users, done, info, device)


@query(
    "j1_user_completion_profile_device",
    f"""SELECT c.respondentPk, c.taskPk, u.gender, u.risk, i.fulcrum_region, d.hardware AS ditr_hardware,
          d.os AS ditr_os
        FROM v_user u JOIN v_completion c ON u.respondent_pk = c.respondentPk
        JOIN v_info i ON u.respondent_pk = i.respondent_pk
        LEFT JOIN ({DEVICE_SQL}) d ON u.respondent_pk = d.respondent_pk
        WHERE u.country = 'GB' AND i.country = 'GB' AND c.taskOrigin = 'panel'""",
)
def _(t: Inputs):
    return _joined(t).select(
        "respondentPk", "taskPk", "gender", "risk", "fulcrum_region", "ditr_hardware", "ditr_os"
    )


def _tasks(t: Inputs):
    return t.view("v_task").where("origin = 'panel'").withColumnsRenamed(tables.TASK_RENAMES)


def _study_map(t: Inputs):
    balance = t.view("v_balance").where("match_id_type = 'respondent_pk'").drop("match_id_type")
    balance = joins.label_studies(balance, STUDY_LABELS)
    return joins.join_study_balance_with_task(balance, _tasks(t)).withColumnRenamed(
        "ip", "request-remote-addr"
    )


@query(
    "j2_study_with_task",
    'SELECT uuid, respondent_pk, survey_pk, task_pk, task_points, wonky_study_count, ip AS "request-remote-addr" FROM v_study',
)
def _(t: Inputs):
    return _study_map(t).select(
        "uuid", "respondent_pk", "survey_pk", "task_pk", "task_points", "wonky_study_count",
        "request-remote-addr",
    )


@query(
    "j3_users_with_device",
    f"""SELECT u.respondent_pk, d.hardware FROM v_user u
        LEFT JOIN ({DEVICE_SQL}) d ON u.respondent_pk = d.respondent_pk""",
)
def _(t: Inputs):
    device = windows.latest_per_key(t.view("v_device"), ["respondent_pk"], "date_created")
    users = t.view("v_user").select("respondent_pk")
    return users.join(device, "respondent_pk", "left").select("respondent_pk", "hardware")


GROUPED_SQL = """
  SELECT respondent_pk AS balance_respondentPk, survey_pk, exposure_band, yob, ip, task_pk,
    task_points, count(uuid) AS balance_study_count,
    CAST(sum(wonky_study_count) AS BIGINT) AS wonky_study_count
  FROM v_study WHERE yob IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7"""


def _grouped(t: Inputs):
    keys = ["respondent_pk", "survey_pk", "exposure_band", "yob", "request-remote-addr",
            "task_pk", "task_points", "activation_date"]
    return aggregates.aggregate_studies(_study_map(t), keys)


@query(
    "j4_merge_studies_into_completions",
    f"""WITH g AS ({GROUPED_SQL})
        SELECT c.respondentPk, c.taskPk, g.task_pk, g.wonky_study_count, g.exposure_band,
          g.ip AS "request-remote-addr",
          concat(c.respondentPk, '_', c.taskPk) AS user_task_pk,
          CASE WHEN c.respondentPk IN (SELECT balance_respondentPk FROM g) THEN 1 ELSE 0 END
            AS wonky_user_flag,
          CASE WHEN g.task_pk IS NULL THEN 'left_only' ELSE 'both' END AS _merge
        FROM v_completion c LEFT JOIN g ON c.respondentPk = g.balance_respondentPk
          AND c.taskPk = g.task_pk""",
)
def _(t: Inputs):
    merged = joins.merge_study_data_with_user_info(t.view("v_completion"), _grouped(t))
    return merged.select(
        "respondentPk", "taskPk", "task_pk", "wonky_study_count", "exposure_band",
        "request-remote-addr", "user_task_pk", "wonky_user_flag", "_merge",
    )


@query(
    "j4_merge_without_fan_out",
    f"""WITH g AS (SELECT balance_respondentPk, task_pk, CAST(sum(wonky_study_count) AS BIGINT)
            AS wonky_study_count, max(exposure_band) AS exposure_band
          FROM ({GROUPED_SQL}) GROUP BY 1, 2)
        SELECT c.respondentPk, c.taskPk, c.taskTitle, g.wonky_study_count, g.exposure_band
        FROM v_completion c LEFT JOIN g ON c.respondentPk = g.balance_respondentPk
          AND c.taskPk = g.task_pk""",
)
def _(t: Inputs):
    merged = joins.merge_study_data_with_user_info(
        t.view("v_completion"), _grouped(t), dedupe=True
    )
    return merged.select("respondentPk", "taskPk", "taskTitle", "wonky_study_count", "exposure_band")


@query(
    "j5_membership_flag",
    """SELECT respondent_pk, CASE WHEN respondent_pk IN (SELECT respondent_pk FROM v_study)
         THEN 1 ELSE 0 END AS in_study FROM v_user""",
)
def _(t: Inputs):
    flagged = joins.add_membership_flag(
        t.view("v_user"), "respondent_pk", t.view("v_study"), "respondent_pk", "in_study"
    )
    return flagged.select("respondent_pk", "in_study")


@query(
    "j6_task_metadata",
    """SELECT c.respondentPk, c.taskPk, t.length_of_task AS task_length_of_task
       FROM v_completion c LEFT JOIN (SELECT * FROM v_task WHERE origin = 'panel') t
         ON c.taskPk = t.pk""",
)
def _(t: Inputs):
    merged = joins.merge_task_metadata(t.view("v_completion"), _tasks(t))
    return merged.select("respondentPk", "taskPk", "task_length_of_task")


COUNTS_SQL = """SELECT respondentPk, count(taskPk) AS task_completed FROM v_completion GROUP BY 1"""
SUMMARY_SQL = """
  SELECT respondent_pk AS balance_respondentPk, exposure_band, yob,
    count(task_pk) AS task_pk_count, count(DISTINCT task_pk) AS task_pk_nunique,
    count(DISTINCT uuid) AS total_wonky_studies
  FROM v_study WHERE yob IS NOT NULL GROUP BY 1, 2, 3"""


def _counts(t: Inputs):
    enriched = windows.enrich_with_task_counts(t.view("v_completion"))
    return joins.respondent_task_totals(enriched)


def _summary(t: Inputs):
    return aggregates.create_study_respondent_summary(
        _study_map(t), categorical_cols=["exposure_band", "yob", "platform_name"]
    )


RATIO_SQL = f"""SELECT s.balance_respondentPk, s.exposure_band, t.task_completed, s.total_wonky_studies,
    s.total_wonky_studies / CAST(t.task_completed AS DOUBLE) AS wonky_task_ratio,
    least(s.total_wonky_studies / CAST(t.task_completed AS DOUBLE), 1::DOUBLE) AS wonky_task_ratio_cap
  FROM ({COUNTS_SQL}) t JOIN ({SUMMARY_SQL}) s ON t.respondentPk = s.balance_respondentPk"""


def _ratio(t: Inputs):
    totals = _counts(t).withColumnRenamed("respondentPk", "respondentPk_tc")
    ratio = aggregates.calculate_task_ratio(totals, _summary(t))
    return ratio.select(
        "balance_respondentPk", "exposure_band", "task_completed", "total_wonky_studies",
        "wonky_task_ratio", "wonky_task_ratio_cap",
    )


query("j7_counts_with_summary", RATIO_SQL)(_ratio)
query("a3_task_ratio", RATIO_SQL)(_ratio)


@query(
    "j8_first_date_and_addresses",
    """SELECT f.event_id, m.first_seen, m.ip_address_count FROM v_fact f JOIN (
         SELECT respondentPk, epoch_us(min(date_completed)) AS first_seen,
           count(DISTINCT ip) AS ip_address_count FROM v_fact GROUP BY 1) m
       ON f.respondentPk = m.respondentPk""",
)
def _(t: Inputs):
    from panelsift.operators.skew import attach_per_key

    rows = attach_per_key(
        t.view("v_fact"),
        ["respondentPk"],
        F.min("date_completed").alias("first"),
        F.count_distinct("ip").alias("ip_address_count"),
    )
    micros = F.unix_micros(F.col("first").cast("timestamp"))
    return rows.select("event_id", micros.alias("first_seen"), "ip_address_count")


@query(
    "j11_summary_with_totals",
    f"""SELECT s.balance_respondentPk, s.exposure_band, s.task_pk_count, t.task_completed
        FROM ({SUMMARY_SQL}) s LEFT JOIN ({COUNTS_SQL}) t ON s.balance_respondentPk = t.respondentPk""",
)
def _(t: Inputs):
    enriched = windows.enrich_with_task_counts(t.view("v_completion"))
    joined = joins.summary_with_task_totals(_summary(t), enriched)
    return joined.select("balance_respondentPk", "exposure_band", "task_pk_count", "task_completed")


@query(
    "j11_completions_with_study_rows",
    """SELECT c.respondentPk, c.taskPk, s.wonky_study_count FROM v_completion c
       LEFT JOIN v_study s ON c.respondentPk = s.respondent_pk AND c.taskPk = s.task_pk""",
)
def _(t: Inputs):
    rows = aggregates.add_study_rows(
        t.view("v_completion").select("respondentPk", "taskPk"), t.view("v_study")
    )
    return rows.select("respondentPk", "taskPk", "wonky_study_count")


@query("a1_study_groups", GROUPED_SQL.replace(" ip,", ' ip AS "request-remote-addr",'))
def _(t: Inputs):
    return _grouped(t)


@query("a2_respondent_summary", SUMMARY_SQL)
def _(t: Inputs):
    return _summary(t)


@query("a4_distinct_totals", COUNTS_SQL)
def _(t: Inputs):
    return _counts(t)


@query(
    "a5_distinct_counts",
    """SELECT count(DISTINCT respondentPk) AS respondentPk, count(DISTINCT taskPk) AS taskPk,
       count(DISTINCT exposure_band) AS exposure_band FROM v_fact""",
)
def _(t: Inputs):
    return aggregates.distinct_counts(t.view("v_fact"), ["respondentPk", "taskPk", "exposure_band"])


@query(
    "a5_distinct_per_respondent",
    "SELECT respondentPk, count(DISTINCT ip) AS ip_address_count FROM v_fact GROUP BY 1",
)
def _(t: Inputs):
    return aggregates.distinct_per_key(t.view("v_fact"), "respondentPk", "ip", "ip_address_count")


@query(
    "a16_tasks_and_flags",
    """SELECT c.respondentPk, count(c.taskPk) AS tasks_completed,
         CAST(sum(coalesce(s.wonky_study_count, 0)) AS BIGINT) AS wonky_study_count
       FROM v_completion c LEFT JOIN v_study s
         ON c.respondentPk = s.respondent_pk AND c.taskPk = s.task_pk GROUP BY 1""",
)
def _(t: Inputs):
    return aggregates.tasks_and_flags_per_respondent(t.view("v_completion"), t.view("v_study"))


@query("w1_latest_record", DEVICE_SQL)
def _(t: Inputs):
    return windows.latest_per_key(t.view("v_device"), ["respondent_pk"], "date_created").drop(
        "date_created"
    )


@query(
    "w2_task_counts",
    """SELECT respondentPk, taskPk, taskTitle, epoch_us(date_completed) // 1000000 AS at_second,
         CAST(floor(epoch(date_completed)) - floor(epoch(date_created)) AS BIGINT) AS task_time_taken_s,
         count(taskPk) OVER (PARTITION BY respondentPk) AS task_completed
       FROM v_completion""",
)
def _(t: Inputs):
    rows = windows.enrich_with_task_counts(t.view("v_completion"))
    at = F.unix_timestamp("date_completed").alias("at_second")
    return rows.select("respondentPk", "taskPk", "taskTitle", at, "task_time_taken_s", "task_completed")


@query(
    "u1_union_studies",
    """SELECT respondent_pk, yob, CAST(NULL AS VARCHAR) AS ip FROM v_balance WHERE exposure_band = 'exposed'
       UNION ALL SELECT respondent_pk, NULL, ip FROM v_balance WHERE exposure_band = 'control'""",
)
def _(t: Inputs):
    rows = t.view("v_balance")
    first = rows.where("exposure_band = 'exposed'").select("respondent_pk", "yob")
    second = rows.where("exposure_band = 'control'").select("ip", "respondent_pk")
    return tables.union_studies([first, second])


@query("u2_concatenate", "SELECT respondent_pk, uuid, wonky_study_count FROM v_study")
def _(t: Inputs):
    both = t.view("v_study").select("respondent_pk", "uuid", "wonky_study_count")
    parts = [both.where(c("wonky_study_count") == v) for v in (1, 0)]
    return tables.union_studies(parts)
