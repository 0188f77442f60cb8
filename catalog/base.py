"""Registry of queries, and the panel views both engines derive from the given tables.

A query is registered with the Spark callable and, where one exists, the DuckDB
SQL that must return the same rows. View names used in the SQL are expanded to
common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

HARDWARE = (
    "iPhone17,1", "iPhone15,2", "iPhone14,2", "iPhone13,1", "iPhone8,1", "iphone se",
    "iphone pro max", "iphone xr", "iphone", "mt6989", "mt6893", "mt6785", "mt6768",
    "mediatek", "exynos2200", "exynos9820", "exynos9611", "s5e8535", "qcom", "shiba",
    "ums512", "s9863a", "kirin990", "kirin710", "hi6250", "samsungx", "rmx2020", "joan",
    "itel", "w6001", "tcl", "surface", "zzz",
)
MAKERS = (
    "Apple", "samsung ", "google", "Xiaomi Inc", "honor", "OPPO", "vivo", "oneplus",
    "motorola", "realme", "nothing", "sony", "TECNO MOBILE", "Blackview", "alcatel",
    "nokia", "lenovo", "zte", "asus", "lge", "htc", "meizu", "fairphone", "microsoft",
    "wiko", "hisense", "Crosscall", "sharp", "Teclast", "sprd", "acme",
)


def _choice(values: tuple[str, ...], index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


# Each view: one SQL text for both engines, or a (Spark, DuckDB) pair.
VIEWS: dict[str, str | tuple[str, str]] = {
    "v_completion": (
        """SELECT user_id AS respondentPk, event_id % 200 AS taskPk,
             CASE WHEN event_type = 'signup' THEN 'other' ELSE 'panel' END AS taskOrigin,
             concat('Title ', event_id % 5) AS taskTitle,
             CASE WHEN event_id % 3 = 0 THEN 'notification' ELSE 'offerwall' END AS entryPoint,
             ts AS date_completed,
             CASE WHEN event_id % 97 = 0 THEN NULL
               ELSE timestampadd(SECOND, -CAST(floor(value * 10) AS INT), ts) END AS date_created
           FROM events""",
        """SELECT user_id AS respondentPk, event_id % 200 AS taskPk,
             CASE WHEN event_type = 'signup' THEN 'other' ELSE 'panel' END AS taskOrigin,
             concat('Title ', event_id % 5) AS taskTitle,
             CASE WHEN event_id % 3 = 0 THEN 'notification' ELSE 'offerwall' END AS entryPoint,
             ts AS date_completed,
             CASE WHEN event_id % 97 = 0 THEN NULL
               ELSE ts - to_seconds(CAST(floor(value * 10) AS INT)) END AS date_created
           FROM events""",
    ),
    "v_user": """SELECT c_custkey AS respondent_pk,
             CASE WHEN c_nationkey < 20 THEN 'GB' ELSE 'FR' END AS country,
             CASE c_custkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'other' END
               AS gender,
             CAST((c_custkey * 37) % 101 AS DOUBLE) AS risk,
             CAST((c_custkey * 53) % 101 AS DOUBLE) AS quality,
             (c_custkey % 3 <> 0) AS email_verified,
             (c_custkey % 5 = 0) AS notify_new_task
           FROM customer""",
    "v_info": (
        """SELECT c_custkey AS respondent_pk,
             CASE WHEN c_nationkey < 20 THEN 'GB' ELSE 'FR' END AS country,
             named_struct(
               'fulcrum_household_income', chr(CAST(65 + c_custkey % 20 AS INT)),
               'fulcrum_region', chr(CAST(65 + c_custkey % 13 AS INT)),
               'gambling_participation_mc', CASE c_custkey % 4
                 WHEN 1 THEN array('bingo') WHEN 2 THEN array(' bingo', 'casino poker')
                 WHEN 3 THEN array('bingo', 'bingo') END,
               'hobbies', c_mktsegment) AS profile
           FROM customer""",
        """SELECT c_custkey AS respondent_pk,
             CASE WHEN c_nationkey < 20 THEN 'GB' ELSE 'FR' END AS country,
             chr(CAST(65 + c_custkey % 20 AS INT)) AS fulcrum_household_income,
             chr(CAST(65 + c_custkey % 13 AS INT)) AS fulcrum_region,
             CASE c_custkey % 4 WHEN 1 THEN ['bingo'] WHEN 2 THEN [' bingo', 'casino poker']
               WHEN 3 THEN ['bingo', 'bingo'] END AS gambling_participation_mc,
             c_mktsegment AS hobbies
           FROM customer""",
    ),
    "v_task": """SELECT p_partkey AS pk,
             CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE 'panel' END AS origin,
             100000 + p_partkey AS origin_id,
             CASE WHEN p_partkey % 2 = 0 THEN 'profile' ELSE 'open' END AS targeting_type,
             CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size % 6 END AS length_of_task,
             p_size AS points, p_type AS category, 'GB' AS country
           FROM part""",
    "v_device": f"""SELECT user_id AS respondent_pk, ts AS date_created,
             {_choice(HARDWARE, "event_id % 34")} AS hardware,
             {_choice(MAKERS, "event_id % 32")} AS manufacturer,
             CASE WHEN event_id % 34 < 9 THEN 'ios' ELSE 'android' END AS os
           FROM events""",
    "v_balance": """SELECT concat('study_', event_id % 12) AS uuid,
             CASE WHEN event_id % 10 = 0 THEN 'device_id' ELSE 'respondent_pk' END
               AS match_id_type,
             user_id AS respondent_pk, 100000 + event_id % 200 AS survey_pk,
             CASE WHEN user_id % 2 = 0 THEN 'exposed' ELSE 'control' END AS exposure_band,
             CASE WHEN user_id % 11 = 0 THEN NULL ELSE 1950 + user_id % 50 END AS yob,
             concat('10.0.', user_id, '.', event_id % 3) AS ip
           FROM events WHERE event_type IN ('error', 'view')""",
    "v_study": """SELECT b.respondent_pk, b.survey_pk, b.exposure_band, b.yob, b.ip, b.uuid,
             t.pk AS task_pk, t.points AS task_points,
             CASE WHEN b.uuid IN ('study_0', 'study_1', 'study_2', 'study_3', 'study_4',
               'study_5') THEN 1 ELSE 0 END AS wonky_study_count
           FROM v_balance b JOIN v_task t ON b.survey_pk = t.origin_id
           WHERE b.match_id_type = 'respondent_pk' AND t.origin = 'panel'""",
    "v_fact": (
        """SELECT e.event_id, e.user_id AS respondentPk, e.event_id % 200 AS taskPk,
             e.ts AS date_completed, CAST(floor(e.value * 10) AS INT) AS seconds,
             CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE CAST(floor(e.value * 10) AS INT) END
               AS task_time_taken_s,
             CASE WHEN e.event_id % 7 = 0 THEN NULL
               WHEN e.event_type IN ('error', 'signup') THEN 1.0D + e.event_id % 2
               ELSE 0.0D END AS wonky_study_count,
             CASE WHEN e.event_id % 5 = 0 THEN NULL WHEN e.user_id % 2 = 0 THEN 'exposed'
               ELSE 'control' END AS exposure_band,
             e.event_type, e.event_id % 6 AS task_length_of_task, e.event_id % 9 AS task_points,
             hour(e.ts) AS hr, weekday(e.ts) AS wd,
             concat('10.0.', e.user_id, '.', e.event_id % 3) AS ip,
             u.gender, u.risk, u.quality, u.email_verified
           FROM events e JOIN v_user u ON e.user_id = u.respondent_pk""",
        """SELECT e.event_id, e.user_id AS respondentPk, e.event_id % 200 AS taskPk,
             e.ts AS date_completed, CAST(floor(e.value * 10) AS INT) AS seconds,
             CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE CAST(floor(e.value * 10) AS INT) END
               AS task_time_taken_s,
             CASE WHEN e.event_id % 7 = 0 THEN NULL
               WHEN e.event_type IN ('error', 'signup') THEN CAST(1 + e.event_id % 2 AS DOUBLE)
               ELSE CAST(0 AS DOUBLE) END AS wonky_study_count,
             CASE WHEN e.event_id % 5 = 0 THEN NULL WHEN e.user_id % 2 = 0 THEN 'exposed'
               ELSE 'control' END AS exposure_band,
             e.event_type, e.event_id % 6 AS task_length_of_task, e.event_id % 9 AS task_points,
             CAST(hour(e.ts) AS INT) AS hr, CAST(isodow(e.ts) - 1 AS INT) AS wd,
             concat('10.0.', e.user_id, '.', e.event_id % 3) AS ip,
             u.gender, u.risk, u.quality, u.email_verified
           FROM events e JOIN v_user u ON e.user_id = u.respondent_pk""",
    ),
    "v_flags": """SELECT event_id, respondentPk, wonky_study_count, exposure_band, gender,
             risk, quality, hr, wd, task_time_taken_s,
             CASE WHEN wd >= 5 THEN 1 ELSE 0 END AS is_weekend,
             CASE WHEN wd = 0 THEN 1 ELSE 0 END AS is_monday,
             CASE WHEN wd = 4 THEN 1 ELSE 0 END AS is_friday,
             CASE WHEN hr >= 22 OR hr <= 6 THEN 1 ELSE 0 END AS is_night,
             CASE WHEN hr BETWEEN 9 AND 17 THEN 1 ELSE 0 END AS is_business_hour,
             CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_error,
             CASE WHEN seconds < 200 THEN 1 ELSE 0 END AS is_fast
           FROM v_fact""",
    "v_duration": """SELECT o_orderdate AS date_created, l_shipdate AS date_completed
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_scored": """SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v_vector": (
        "SELECT vec_id, label, "
        + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS x{i}" for i in range(8))
        + " FROM embeddings",
        "SELECT vec_id, label, "
        + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(8))
        + " FROM embeddings",
    ),
}
FEATURES = ("is_weekend", "is_monday", "is_friday", "is_night", "is_business_hour", "is_error", "is_fast")
STUDY_LABELS = {f"study_{i}": i < 6 for i in range(12)}


def _used(sql: str) -> list[str]:
    names = set(re.findall(r"\bv_[a-z_]+\b", sql)) & set(VIEWS)
    needed: list[str] = []
    for view in VIEWS:  # declaration order is dependency order
        if view in names:
            body = VIEWS[view]
            body = body if isinstance(body, str) else body[1]
            for inner in _used(body):
                if inner not in needed:
                    needed.append(inner)
            if view not in needed:
                needed.append(view)
    return needed


def expand(sql: str) -> str:
    """DuckDB SQL with the used views in front as common table expressions."""
    views = _used(sql)
    if not views:
        return sql
    parts = []
    for name in views:
        body = VIEWS[name]
        parts.append(f"{name} AS ({body if isinstance(body, str) else body[1]})")
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, flags=re.IGNORECASE)
    rest = ", " + sql[own.end() :] if own else " " + sql
    keyword = "WITH RECURSIVE" if own and own[1] else "WITH"
    return f"{keyword} {', '.join(parts)}{rest}"


@dataclass
class Inputs:
    """The given tables and derived views of one scale folder, as DataFrames."""

    spark: SparkSession
    folder: str
    _views: dict[str, DataFrame] = field(default_factory=dict)

    def path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def sql(self, text: str) -> DataFrame:
        names = set(re.findall(r"\b[a-z_]+\b", text))
        frames = {n: self.table(n) for n in TABLES if n in names}
        frames |= {n: self.view(n) for n in VIEWS if n in names}
        frames = {n: f for n, f in frames.items() if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text)}
        text = re.sub(
            r"\b(FROM|JOIN)\s+([a-z_]+)\b",
            lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in frames else m[0],
            text,
        )
        return self.spark.sql(text, **frames)

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            body = VIEWS[name]
            self._views[name] = self.sql(body if isinstance(body, str) else body[0])
        return self._views[name]

    @cached_property
    def silver(self) -> str:
        """The panel tables written below the shared folder, for the table readers."""
        from panelsift.session import scratch_path

        base = scratch_path(self.spark, "silver") + "/"
        names = {
            "user": "v_user",
            "task_complete": "v_completion",
            "respondent_info": "v_info",
            "task": "v_task",
            "device_id_to_respondent": "v_device",
        }
        for table, view in names.items():
            self.view(view).write.parquet(base + table)
        return base


@dataclass
class Query:
    run: Callable[[Inputs], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[Inputs], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(run, expand(sql) if sql else None)
        return run

    return register
