"""Column features: time, speed, bins, one-hot flags, devices, income."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Inputs, query
from panelsift import config
from panelsift.columns import c
from panelsift.functions import bins, device, income, onehot, speed, temporal
from panelsift.operators import windows

CLOCK = "CASE WHEN hr % 12 = 0 THEN 12 ELSE hr % 12 END || CASE WHEN hr < 12 THEN 'am' ELSE 'pm' END"
PERIOD = """CASE WHEN hr < 6 THEN 'night' WHEN hr < 9 THEN 'early_morning' WHEN hr < 12 THEN 'morning'
  WHEN hr < 17 THEN 'afternoon' WHEN hr < 22 THEN 'evening' ELSE 'night' END"""


def _ones(condition: str, name: str) -> str:
    return f'CASE WHEN {condition} THEN 1 ELSE 0 END AS "{name}"'


TEMPORAL_SQL = (
    f"SELECT event_id, hr AS hour_of_day, wd AS day_of_week, {CLOCK} AS hour_of_day_label, "
    f"{PERIOD} AS hour_period, "
    + ", ".join(
        [
            _ones("wd >= 5", "is_weekend"),
            *[_ones(f"wd = {i}", f"is_{n}") for i, n in enumerate(temporal.WEEKDAYS)],
            _ones("hr >= 22 OR hr <= 6", "is_night"),
            _ones("hr BETWEEN 9 AND 17", "is_business_hour"),
            _ones("hr BETWEEN 9 AND 17 AND wd < 5", "is_business_hour_weekday"),
            _ones("hr BETWEEN 9 AND 17 AND wd >= 5", "is_business_hour_weekend"),
            *[_ones(f"hr = {h}", f"is_hour_{h}") for h in range(24)],
            *[_ones(f"({CLOCK}) = '{temporal.clock_label(h)}'", f"is_{temporal.clock_label(h)}") for h in range(24)],
            *[_ones(f"({PERIOD}) = '{p}'", f"is_{p}") for p in temporal.PERIOD_FLAGS],
        ]
    )
    + " FROM (SELECT event_id, CASE WHEN event_id % 41 = 0 THEN NULL ELSE hr END AS hr, "
    "CASE WHEN event_id % 41 = 0 THEN NULL ELSE wd END AS wd FROM v_fact)"
).replace(f"{PERIOD} AS hour_period", f"CASE WHEN hr IS NULL THEN NULL ELSE {PERIOD} END AS hour_period")


@query("f2_temporal_features", TEMPORAL_SQL)
def _(t: Inputs):
    dated = t.view("v_fact").select(
        "event_id", F.when(F.col("event_id") % 41 != 0, F.col("date_completed")).alias("date_completed")
    )
    return temporal.create_all_temporal_features(dated).drop("date_completed")


@query("f3_clock_label", f"SELECT event_id, {CLOCK} AS label FROM v_fact")
def _(t: Inputs):
    return t.view("v_fact").select("event_id", temporal.hour_label(F.col("hr")).alias("label"))


@query("f4_hour_period", f"SELECT event_id, {PERIOD} AS period FROM v_fact")
def _(t: Inputs):
    return t.view("v_fact").select("event_id", temporal.hour_period(F.col("hr")).alias("period"))


@query(
    "f1_task_seconds",
    """SELECT CAST(floor(epoch(date_completed)) - floor(epoch(date_created)) AS BIGINT) AS seconds,
         count(*) AS n FROM v_duration GROUP BY 1""",
)
def _(t: Inputs):
    seconds = windows.task_seconds("date_completed", "date_created").alias("seconds")
    return t.view("v_duration").select(seconds).groupBy("seconds").agg(F.count(F.lit(1)).alias("n"))


SPEED_FLAGS = """
  CASE WHEN x < fast THEN 1 ELSE 0 END AS is_fast,
  CASE WHEN x < suspiciously_fast THEN 1 ELSE 0 END AS is_suspiciously_fast,
  CASE WHEN x > slow THEN 1 ELSE 0 END AS is_slow,
  CASE WHEN x > suspiciously_slow THEN 1 ELSE 0 END AS is_suspiciously_slow,
  CASE WHEN x >= fast AND x <= slow THEN 1 ELSE 0 END AS is_normal_speed,
  CASE WHEN x < fast THEN 1 ELSE 0 END AS is_very_fast"""
SPEED_CUTS = ", ".join(
    f"quantile_cont(x, {p}::DOUBLE) AS {n}" for n, p in speed.SPEED_PERCENTILES.items()
)
SPEED_BASE = """b AS (SELECT event_id, CAST(task_time_taken_s AS DOUBLE) AS x, task_points,
    CASE WHEN event_id % 5003 < 5 THEN 'tiny' WHEN task_length_of_task = 0 THEN 'unknown'
      ELSE CAST(task_length_of_task AS VARCHAR) END AS g FROM v_fact)"""


@query(
    "f5_speed_overall",
    f"""WITH {SPEED_BASE}, q AS (SELECT {SPEED_CUTS} FROM b)
        SELECT event_id, {SPEED_FLAGS} FROM b, q""",
)
def _(t: Inputs):
    made = speed.create_task_speed_features(t.view("v_fact"), group_by_col="no such column")
    names = [f"is_{n}" for n in (*speed.SPEED_PERCENTILES, "normal_speed", "very_fast")]
    return made.select("event_id", *names)


@query(
    "f5_speed_by_group",
    f"""WITH {SPEED_BASE}, q AS (SELECT {SPEED_CUTS} FROM b),
        own AS (SELECT g, {SPEED_CUTS}, count(x) AS n FROM b GROUP BY g),
        cut AS (SELECT g, {", ".join(f"CASE WHEN n < 10 THEN q.{n} ELSE own.{n} END AS {n}" for n in speed.SPEED_PERCENTILES)}
          FROM own, q)
        SELECT event_id, {SPEED_FLAGS}, x / 60 AS task_time_minutes,
          task_points / nullif(x / 60, 0::DOUBLE) AS "task_points_perMinute"
        FROM b JOIN cut ON b.g = cut.g""",
)
def _(t: Inputs):
    length = F.when(F.col("event_id") % 5003 < 5, "tiny").when(
        F.col("task_length_of_task") != 0, F.col("task_length_of_task").cast("string")
    )
    rows = t.view("v_fact").withColumn("task_length_of_task", length)
    made = speed.create_task_speed_features(rows)
    names = [f"is_{n}" for n in (*speed.SPEED_PERCENTILES, "normal_speed", "very_fast")]
    return made.select("event_id", *names, "task_time_minutes", "task_points_perMinute")


@query(
    "f6_speed_legacy",
    """SELECT event_id, CASE WHEN task_time_taken_s < 30 THEN 1 ELSE 0 END AS is_suspiciously_fast,
         CASE WHEN task_time_taken_s < 180 THEN 1 ELSE 0 END AS is_very_fast,
         CASE WHEN task_time_taken_s > 3600 THEN 1 ELSE 0 END AS is_very_slow FROM v_fact""",
)
def _(t: Inputs):
    made = speed.create_task_speed_features(t.view("v_fact"), use_std_dev=False)
    return made.select("event_id", "is_suspiciously_fast", "is_very_fast", "is_very_slow")


@query(
    "f7_points_per_minute",
    """SELECT event_id, task_points / nullif(task_time_taken_s / 60::DOUBLE, 0::DOUBLE)
       AS "task_points_perMinute" FROM v_fact""",
)
def _(t: Inputs):
    made = speed.create_task_speed_features(t.view("v_fact"), use_std_dev=False)
    return made.select("event_id", "task_points_perMinute")


def _amount(label, low, high):
    bounds = [f"p_size * 6 {'>=' if low == 0 else '>'} {low}"]
    bounds += [f"p_size * 6 <= {high}"] if high is not None else []
    return _ones(" AND ".join(bounds), label)


@query(
    "f8_task_amounts",
    f"SELECT p_partkey, {', '.join(_amount(*b) for b in bins.TASK_AMOUNT_BINS)} FROM part",
)
def _(t: Inputs):
    sized = t.table("part").select("p_partkey", (F.col("p_size") * 6).alias("n"))
    return bins.create_task_amount_features(sized, "n")[0].drop("n")


@query(
    "f9_one_hot_scalar",
    f"""SELECT respondent_pk, {", ".join(_ones(f"coalesce(gender, 'nan') = '{g}'", f"gender_{g}") for g in ("female", "male", "other", "nan"))},
        {_ones("email_verified", "verified_True")}, {_ones("NOT email_verified", "verified_False")}
        FROM v_user""",
)
def _(t: Inputs):
    users = t.view("v_user").select("respondent_pk", "gender", "email_verified")
    users, _ = onehot.one_hot_encode_column(users, "gender", as_string=True)
    users, _ = onehot.one_hot_encode_column(users, "email_verified", "verified_", as_string=True)
    return users.drop("gender", "email_verified")


@query(
    "f9_one_hot_list",
    """SELECT respondent_pk,
         coalesce(len(list_filter(gambling_participation_mc, lambda x: trim(x) = 'bingo')), 0) AS g_bingo,
         coalesce(len(list_filter(gambling_participation_mc, lambda x: trim(x) = 'casino poker')), 0)
           AS "g_casino poker" FROM v_info""",
)
def _(t: Inputs):
    info = t.view("v_info").select("respondent_pk", "profile.gambling_participation_mc")
    made, names = onehot.one_hot_encode_column(info, "gambling_participation_mc", "g_")
    return made.select("respondent_pk", *[c(n).cast("bigint").alias(n) for n in names])


@query(
    "f9_one_hot_sparse",
    """SELECT category, count(*) AS rows, sum(n)::BIGINT AS n, min(item) AS first_item, max(item) AS last_item FROM (
         SELECT o_orderkey AS item, trim(o_orderpriority) AS category, 1 AS n FROM orders
         UNION ALL SELECT o_orderkey, o_orderkey::VARCHAR, 1 FROM orders)
       GROUP BY category""",
)
def _(t: Inputs):
    """As many categories as orders; a dense encoding would need a column for each."""
    orders = t.table("orders").select("o_orderkey", "o_orderpriority", F.col("o_orderkey").alias("order"))
    made = onehot.one_hot_entries(orders, {"o_orderpriority": False, "order": True})
    entries = made.select("o_orderkey", F.inline("encoded"))
    return entries.groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"),
        F.min("o_orderkey").alias("first_item"), F.max("o_orderkey").alias("last_item"),
    )


@query(
    "f10_one_hot_batch",
    f"""SELECT event_id,
        {", ".join(_ones(f"coalesce(gender, 'nan') = '{g}'", f"gender_{g}") for g in ("female", "male", "other", "nan"))},
        {", ".join(_ones(f"event_type = '{e}'", f"event_type_{e}") for e in ("click", "view", "purchase", "error", "signup"))},
        {", ".join(_ones(f"task_length_of_task = {n}", f"task_length_of_task_{n}") for n in range(6))},
        {", ".join(_ones(f"exposure_band = '{b}'", f"exposure_band_{b}") for b in ("exposed", "control"))}
        FROM v_fact""",
)
def _(t: Inputs):
    columns = ["gender", "event_type", "task_length_of_task", "exposure_band"]
    rows = t.view("v_fact").select("event_id", *columns)
    made = onehot.batch_one_hot_encode(rows, columns, ["gender", "task_length_of_task"])
    return made.drop(*columns)


@query(
    "f11_thresholds",
    f"""SELECT event_id, {_ones("x < 100", "lt")}, {_ones("x <= 100", "le")}, {_ones("x > 100", "gt")},
        {_ones("x >= 100", "ge")}, {_ones("x = 100", "eq")}, {_ones("x <> 100 OR x IS NULL", "ne")}
        FROM (SELECT event_id, task_time_taken_s AS x FROM v_fact)""",
)
def _(t: Inputs):
    rules = [("lt", "<", 100), ("le", "<=", 100), ("gt", ">", 100), ("ge", ">=", 100),
             ("eq", "==", 100), ("ne", "!=", 100)]
    rows = t.view("v_fact").select("event_id", "task_time_taken_s")
    return bins.create_threshold_features(rows, "task_time_taken_s", rules).drop("task_time_taken_s")


@query(
    "f12_scores",
    f"""SELECT respondent_pk, {_ones("quality = 100", "quality=100")},
        {", ".join(_ones(f"quality < {n}", f"quality<{n}") for n in (90, 75, 50, 30))},
        {_ones("risk = 100", "risk=100")}, {", ".join(_ones(f"risk < {n}", f"risk<{n}") for n in (80, 50))}
        FROM v_user""",
)
def _(t: Inputs):
    users = t.view("v_user").select("respondent_pk", "quality", "risk")
    users = bins.create_score_features(users, "quality")
    return bins.create_score_features(users, "risk", thresholds=[80, 50]).drop("quality", "risk")


@query(
    "f13_delta_categories",
    f"""SELECT event_id, {_ones("d > 50", "d_LargePositive")}, {_ones("d > 0", "d_Positive")},
        {_ones("d = 0", "d_Neutral")}, {_ones("d < -50", "d_LargeNegative")}, {_ones("d < 0", "d_Negative")}
        FROM (SELECT event_id, risk - quality AS d FROM v_fact)""",
)
def _(t: Inputs):
    rows = t.view("v_fact").select("event_id", (F.col("risk") - F.col("quality")).alias("d"))
    return bins.create_delta_category_features(rows, "d").drop("d")


BIN_SQL = [
    *[_ones(f"x < {b}", f"d_<{b}") for b in bins.TENURE_BINS],
    _ones("x >= 250", "d_>=250"),
    _ones("x BETWEEN 0 AND 2", "d_0_to_2"),
    *[
        _ones(f"x BETWEEN {a + 1} AND {b}", f"d_{a + 1}_to_{b}")
        for a, b in zip(bins.TENURE_BINS, bins.TENURE_BINS[1:])
    ],
    _ones("x >= 251", "d_251_plus"),
]


@query(
    "f14_bins",
    f"SELECT event_id, {', '.join(BIN_SQL)} FROM (SELECT event_id, value - 5 AS x FROM events)",
)
def _(t: Inputs):
    rows = t.table("events").select("event_id", (F.col("value") - 5).alias("x"))
    made, _ = bins.create_binned_features(
        rows, "x", bins.TENURE_BINS, "d_", include_mutually_exclusive=True
    )
    return made.drop("x")


def _labels(column: str, mapping: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {cases} END"


REGION = _labels("fulcrum_region", config.REGION_LABELS)


@query(
    "f15_map_and_encode",
    f"""SELECT respondent_pk, fulcrum_region_mapped,
        {", ".join(_ones(f"coalesce(fulcrum_region_mapped, 'nan') = '{v}'", f"fulcrum_region_mapped_{v}") for v in (*config.REGION_LABELS.values(), "nan"))}
        FROM (SELECT respondent_pk, {REGION} AS fulcrum_region_mapped FROM v_info)""",
)
def _(t: Inputs):
    info = t.view("v_info").select("respondent_pk", "profile.fulcrum_region")
    made, _ = onehot.create_value_mapping_and_encode(info, "fulcrum_region", config.REGION_LABELS)
    return made.drop("fulcrum_region")


@query(
    "f15_map_by_table",
    "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def _(t: Inputs):
    nations = t.table("nation").select("n_nationkey", "n_name")
    rows = t.table("customer").select("c_custkey", "c_nationkey")
    return onehot.map_values_by_table(rows, "c_nationkey", nations, "nation").drop("c_nationkey")


def _contains(text: str, patterns) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in patterns) + ")"


def _rule(text: str, how: str, patterns) -> str:
    if how == "equals":
        return f"{text} IN ({', '.join(repr(p) for p in patterns)})"
    if how == "starts":
        return "(" + " OR ".join(f"starts_with({text}, '{p}')" for p in patterns) + ")"
    return _contains(text, patterns)


def _case(text: str, table, otherwise: str) -> str:
    whens = " ".join(f"WHEN {_rule(text, how, p)} THEN '{n}'" for n, how, p in table)
    return f"CASE {whens} ELSE {otherwise} END"


def _tiers(number: str, table, lowest: str) -> str:
    whens = " ".join(f"WHEN {number} >= {least} THEN '{n}'" for least, n in table)
    return f"CASE {whens} ELSE '{lowest}' END"


def _number(pattern: str) -> str:
    return f"TRY_CAST(regexp_extract(h, '{pattern}(\\d+)', 1) AS DOUBLE)"


HARDWARE_SQL = f"""CASE WHEN h IS NULL THEN 'unknown'
  WHEN contains(h, 'iphone') THEN CASE WHEN {_number("iphone ?")} IS NOT NULL
    THEN {_tiers(_number("iphone ?"), device.IPHONE_GENERATIONS, "iphone_legacy")}
    ELSE {_case("h", device.IPHONE_NAMES, "'iphone_other'")} END
  WHEN starts_with(h, 'mt') OR contains(h, 'mediatek') THEN CASE WHEN {_number("mt")} IS NOT NULL
    THEN {_tiers(_number("mt"), device.MEDIATEK_TIERS, "mediatek_budget")} ELSE 'mediatek_other' END
  WHEN contains(h, 'exynos') OR starts_with(h, 's5e') THEN {_case("h", device.EXYNOS_MODELS, "'exynos_budget'")}
  WHEN h = 'qcom' OR {_contains("h", ("qualcomm", "snapdragon"))} THEN 'qualcomm'
  WHEN {_rule("h", "equals", device.PIXEL_CODENAMES)} THEN 'google_pixel'
  WHEN {_rule("h", "starts", ("ums", "sp"))} OR contains(h, 's9863a') THEN 'unisoc_budget'
  WHEN {_contains("h", ("kirin", "hi62", "hi32", "hi36"))} THEN CASE WHEN {_number("kirin ?")} IS NOT NULL
    THEN {_tiers(_number("kirin ?"), device.KIRIN_TIERS, "kirin_mid")} ELSE 'kirin_other' END
  ELSE {_case("h", device.OTHER_HARDWARE, "'other'")} END"""
MAKER_SQL = f"CASE WHEN m IS NULL THEN 'unknown' ELSE {_case('m', device.MANUFACTURERS, repr('other'))} END"
DEVICE_SOURCE = """(SELECT hardware, manufacturer, lower(trim(hardware)) AS h,
  lower(trim(manufacturer)) AS m FROM v_device)"""


@query(
    "f16_hardware_category",
    f"SELECT hardware, {HARDWARE_SQL} AS hardware_category, count(*) AS n FROM {DEVICE_SOURCE} GROUP BY 1, 2",
)
def _(t: Inputs):
    made = device.add_hardware_category(t.view("v_device"), "hardware")
    return made.groupBy("hardware", "hardware_category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f17_manufacturer_category",
    f"SELECT manufacturer, {MAKER_SQL} AS manufacturer_category, count(*) AS n FROM {DEVICE_SOURCE} GROUP BY 1, 2",
)
def _(t: Inputs):
    made = device.add_manufacturer_category(t.view("v_device"), "manufacturer")
    return made.groupBy("manufacturer", "manufacturer_category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f18_device_categories",
    f"""SELECT {HARDWARE_SQL} AS hardware_category, {MAKER_SQL} AS manufacturer_category, count(*) AS n
        FROM {DEVICE_SOURCE} GROUP BY 1, 2""",
)
def _(t: Inputs):
    made = device.add_device_categories(t.view("v_device"), "hardware", "manufacturer")
    return made.groupBy("hardware_category", "manufacturer_category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a7_hardware_summary",
    f"""SELECT hardware AS original_value, {HARDWARE_SQL} AS category, count(*) AS count,
          round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct
        FROM {DEVICE_SOURCE} WHERE hardware IS NOT NULL GROUP BY 1, 2""",
)
def _(t: Inputs):
    return device.get_device_mapping_summary(t.view("v_device"), "hardware", "manufacturer")[0]


@query(
    "a7_manufacturer_summary",
    f"""SELECT manufacturer AS original_value, {MAKER_SQL} AS category, count(*) AS count,
          round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct
        FROM {DEVICE_SOURCE} WHERE manufacturer IS NOT NULL GROUP BY 1, 2""",
)
def _(t: Inputs):
    return device.get_device_mapping_summary(t.view("v_device"), "hardware", "manufacturer")[1]


@query(
    "f19_round_to_tens",
    """SELECT respondent_pk, CAST(round_even(risk, -1) AS INT) AS risk_round10,
         CAST(round_even(quality, -1) AS INT) AS quality_round10 FROM v_user""",
)
def _(t: Inputs):
    return t.view("v_user").select(
        "respondent_pk",
        bins.round_to_tens("risk").alias("risk_round10"),
        bins.round_to_tens("quality").alias("quality_round10"),
    )


INCOME = _labels("fulcrum_household_income", config.INCOME_LABELS)
INCOME_SOURCE = f"(SELECT respondent_pk, {INCOME} AS s FROM v_info)"
AMOUNT = "TRY_CAST(replace(regexp_extract(s, '£([\\d,]+)', 1), ',', '') AS DOUBLE)"


def _income(t: Inputs):
    codes = t.view("v_info").select("respondent_pk", "profile.fulcrum_household_income")
    return onehot.map_values(codes, "fulcrum_household_income", config.INCOME_LABELS, "s")


@query(
    "f20_income_bucket",
    f"""SELECT respondent_pk, CASE WHEN s IS NULL THEN 'unknown.'
          WHEN contains(s, 'Prefer not to answer') THEN 'Prefer not to answer'
          WHEN {AMOUNT} IS NULL THEN 'Unknown' WHEN {AMOUNT} < 35000 THEN 'Less than £35k'
          WHEN {AMOUNT} < 50000 THEN '£35k to £49k' WHEN {AMOUNT} < 80000 THEN '£50k to £79k'
          WHEN {AMOUNT} < 100000 THEN '£80k to £99k' ELSE '£100k or more' END AS bucket
        FROM {INCOME_SOURCE}""",
)
def _(t: Inputs):
    return _income(t).select("respondent_pk", income.income_bucket(F.col("s")).alias("bucket"))


@query(
    "f21_income_lower_bound",
    f"""SELECT respondent_pk, CASE WHEN contains(s, 'Less than') THEN 0::DOUBLE
          WHEN contains(s, '£') THEN {AMOUNT} ELSE -1::DOUBLE END AS lower_bound FROM {INCOME_SOURCE}""",
)
def _(t: Inputs):
    bound = income.income_lower_bound(F.col("s"))
    # infinity stands for "no amount"; shown as -1 so that both engines print it alike
    finite = F.when(bound == float("inf"), F.lit(-1.0)).otherwise(bound)
    return _income(t).select("respondent_pk", finite.alias("lower_bound"))


SHORT = "s"
for _old, _new in income.SHORTENINGS:
    SHORT = f"replace({SHORT}, '{_old}', '{_new}')"


@query(
    "f22_max_salary",
    f"""SELECT respondent_pk, 1000 * TRY_CAST(regexp_extract(k, '£(\\d+)\\s*k', 1) AS DOUBLE)
        AS max_salary FROM (SELECT respondent_pk, {SHORT} AS k FROM {INCOME_SOURCE})""",
)
def _(t: Inputs):
    short = income.shorten_income_label(F.col("s"))
    return _income(t).select("respondent_pk", income.extract_max_salary(short).alias("max_salary"))


@query("f23_short_label", f"SELECT respondent_pk, {SHORT} AS short FROM {INCOME_SOURCE}")
def _(t: Inputs):
    return _income(t).select("respondent_pk", income.shorten_income_label(F.col("s")).alias("short"))


@query(
    "f24_joined_categories",
    f"""SELECT u.respondent_pk, coalesce(gender, 'nan') || '_' || coalesce(s, 'nan') AS both_labels
        FROM v_user u JOIN {INCOME_SOURCE} i ON u.respondent_pk = i.respondent_pk""",
)
def _(t: Inputs):
    rows = t.view("v_user").select("respondent_pk", "gender").join(_income(t), "respondent_pk")
    both = income.joined_categories(F.col("gender"), F.col("s"))
    return rows.select("respondent_pk", both.alias("both_labels"))


@query(
    "f28_trailing_number",
    """SELECT p_partkey, TRY_CAST(string_split(p_name || '_' || CASE WHEN p_size > 25 THEN 'big'
         ELSE CAST(p_size AS VARCHAR) END, '_')[-1] AS DOUBLE) AS days FROM part""",
)
def _(t: Inputs):
    tail = F.when(F.col("p_size") > 25, "big").otherwise(F.col("p_size").cast("string"))
    named = F.concat_ws("_", "p_name", tail)
    return t.table("part").select("p_partkey", income.trailing_number(named).alias("days"))


@query(
    "w3_days_active",
    """SELECT event_id, CAST(floor((epoch_us(done) - min(epoch_us(made)) OVER (PARTITION BY u))
         / 86400000000.0::DOUBLE) AS BIGINT) AS days_active_before_task
       FROM (SELECT event_id, user_id AS u, ts AS done,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts - to_seconds(CAST(floor(value * 10) AS INT)) END
         AS made FROM events)""",
)
def _(t: Inputs):
    made = t.sql(
        """SELECT event_id, user_id AS respondentPk, ts AS date_completed,
           CASE WHEN event_id % 97 = 0 THEN NULL
             ELSE timestampadd(SECOND, -CAST(floor(value * 10) AS INT), ts) END AS date_created
           FROM events"""
    )
    return windows.add_days_active(made).select("event_id", "days_active_before_task")


@query(
    "w3_days_since_first_completion",
    """SELECT event_id, CAST(floor((epoch_us(date_completed) - min(epoch_us(date_completed))
         OVER (PARTITION BY respondentPk)) / 86400000000.0::DOUBLE) AS BIGINT) AS days FROM v_fact""",
)
def _(t: Inputs):
    rows = windows.add_days_active(t.view("v_fact"), first_date_col="date_completed", name="days")
    return rows.select("event_id", "days")


@query(
    "w4_address_count",
    """SELECT f.event_id, m.ip_address_count FROM v_fact f JOIN (SELECT respondentPk,
         count(DISTINCT ip) AS ip_address_count FROM v_fact GROUP BY 1) m
       ON f.respondentPk = m.respondentPk""",
)
def _(t: Inputs):
    return windows.add_distinct_count(t.view("v_fact"), "respondentPk", "ip").select(
        "event_id", "ip_address_count"
    )


@query(
    "w8_rating_change_from_first",
    """SELECT event_id, task_points - first_value(task_points) OVER (PARTITION BY respondentPk
         ORDER BY date_completed, event_id) AS task_points_delta FROM v_fact""",
)
def _(t: Inputs):
    rows = windows.add_rating_delta(t.view("v_fact"), "task_points", "max", tie_cols=["event_id"])
    return rows.select("event_id", "task_points_delta")


@query(
    "w8_rating_change_two_back",
    """SELECT event_id, task_points - lag(task_points, 2) OVER (PARTITION BY respondentPk
         ORDER BY date_completed, event_id) AS task_points_delta FROM v_fact""",
)
def _(t: Inputs):
    rows = windows.add_rating_delta(t.view("v_fact"), "task_points", 2, tie_cols=["event_id"])
    return rows.select("event_id", "task_points_delta")


@query(
    "f25_composite_key",
    "SELECT concat(respondentPk, '_', taskPk) AS user_task_pk, count(*) AS n FROM v_completion GROUP BY 1",
)
def _(t: Inputs):
    key = F.concat_ws("_", F.col("respondentPk").cast("string"), F.col("taskPk").cast("string"))
    return t.view("v_completion").groupBy(key.alias("user_task_pk")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x4_effect_labels",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN d IS NULL THEN 'undefined'
         WHEN abs(d) < 0.2::DOUBLE THEN 'negligible' WHEN abs(d) < 0.5::DOUBLE THEN 'small'
         WHEN abs(d) < 0.8::DOUBLE THEN 'medium' ELSE 'large' END AS d_label,
         CASE WHEN o IS NULL OR o <= 0 THEN 'undefined' WHEN greatest(o, 1 / o) < 1.5::DOUBLE THEN 'negligible'
         WHEN greatest(o, 1 / o) < 2.5::DOUBLE THEN 'small' WHEN greatest(o, 1 / o) < 4.0::DOUBLE THEN 'medium'
         ELSE 'large' END AS or_label
       FROM (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - 25) / 20::DOUBLE AS d,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE (l_quantity - 5) / 8::DOUBLE END AS o FROM lineitem)""",
)
def _(t: Inputs):
    from panelsift.stats.effects import cohens_d_label, odds_ratio_label

    rows = t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        ((F.col("l_quantity") - 25) / 20).alias("d"),
        F.when(F.col("l_linenumber") != 3, (F.col("l_quantity") - 5) / 8).alias("o"),
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        cohens_d_label(F.col("d")).alias("d_label"), odds_ratio_label(F.col("o")).alias("or_label"),
    )
