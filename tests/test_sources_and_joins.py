"""Readers, study loading, joins and aggregates on small written tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelsift import config
from panelsift.operators import aggregates, joins, profile, skew, windows
from panelsift.plans import panel
from panelsift.sources import sinks, tables
from tests.conftest import values


@pytest.fixture
def silver(spark, frame, tmp_path):
    base = f"{tmp_path}/silver/"
    at = datetime(2025, 6, 1, 10)
    frame(
        "respondent_pk string, country string, gender string, risk double, quality double",
        [("r1", "GB", "female", 20.0, 95.0), ("r2", "GB", None, 80.0, 40.0), ("r3", "FR", "male", 1.0, 1.0),
         ("r4", "GB", "male", 50.0, 50.0)],
    ).write.parquet(base + "user")
    frame(
        "respondentPk string, taskPk string, taskOrigin string, date_completed timestamp, date_created timestamp",
        [("r1", "t1", "panel", at, datetime(2025, 6, 1, 9, 59)), ("r1", "t2", "panel", at, None),
         ("r2", "t1", "panel", at, at), ("r2", "t3", "other", at, at), ("r3", "t1", "panel", at, at),
         ("r1", "t3", "panel", datetime(2024, 1, 1), at), (None, "t1", "panel", at, at)],
    ).write.parquet(base + "task_complete")
    frame(
        "respondent_pk string, country string, profile struct<fulcrum_region:string,hobbies:string,gender:string>",
        [("r1", "GB", ("C", "x", "f")), ("r2", "GB", ("G", "y", "f")), ("r3", "FR", ("A", "z", "m"))],
    ).write.parquet(base + "respondent_info")
    frame(
        "pk string, origin string, origin_id string, length_of_task int, points int",
        [("t1", "panel", "o1", 5, 10), ("t2", "panel", "o2", None, 20), ("t3", "other", "o3", 7, 30)],
    ).write.parquet(base + "task")
    frame(
        "respondent_pk string, date_created timestamp, hardware string, manufacturer string, os string, os_version string",
        [("r1", at, "iPhone14,2", "Apple", "ios", "17"), ("r1", None, "qcom", "x", "android", "1"),
         ("r3", at, "qcom", "x", "android", "1")],
    ).write.parquet(base + "device_id_to_respondent")
    return base


@pytest.fixture
def projects(frame, tmp_path):
    base = f"{tmp_path}/projects"
    full = "match_id_type string, respondent_pk string, survey_pk string, exposure_band string, yob int"
    frame(full, [("respondent_pk", "r1", "o1", "exposed", 1980), ("device_id", "r1", "o2", "exposed", 1980),
                 ("respondent_pk", "r2", "o1", "control", None)]).write.parquet(
        tables.balance_path(base, "s one"))
    frame("survey_pk string, match_id_type string, respondent_pk string, exposure_band string",
          [("o1", "respondent_pk", "r1", "exposed")]).write.parquet(
        tables.balance_path(base, "s2"))
    frame("respondent_pk string", [("r1",)]).write.parquet(tables.balance_path(base, "broken"))
    return base


COLUMNS = ["respondent_pk", "survey_pk", "exposure_band", "yob", "platform_name"]


def test_filters(spark, silver):
    def load(filters):
        return tables.load_table(spark, silver + "user", filters, "parquet")

    assert load(None).count() == 4
    assert load({"country": "GB"}).count() == 3
    assert load({"risk": (20.0, 50.0)}).count() == 2
    assert load({"risk": (None, 20.0), "country": "GB"}).count() == 1
    assert load({"risk": 20.0, "country": ["GB"]}).count() == 4  # other kinds are ignored
    plan = load({"country": "GB"})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(country,GB)" in plan  # the filter reaches the scan


def test_completion_range_is_half_open(spark, silver):
    df = tables.load_task_complete_table(spark, silver, "2025-06-01", "panel", "parquet")
    assert values(df, "respondentPk", "taskPk") == [("r1", "t1"), ("r1", "t2"), ("r2", "t1"), ("r3", "t1"), (None, "t1")]


def test_profile_is_flattened_and_pruned(spark, silver):
    df = tables.load_respondent_info_table(spark, silver, exclude_cols=["hobbies", "none"], fmt="parquet")
    assert df.columns == ["respondent_pk", "fulcrum_region", "gender"]
    assert "hobbies" not in df._jdf.queryExecution().executedPlan().toString()


def test_renames_and_devices(spark, silver):
    tasks = tables.load_task_table(spark, silver, "panel", "parquet")
    assert {"task_pk", "task_points", "origin"} <= set(tasks.columns) and tasks.count() == 2
    users = tables.load_user_table(spark, silver, fmt="parquet")
    got = tables.load_device_table(spark, silver, users, ["respondent_pk", "hardware", "gone"], "parquet")
    assert values(got, "respondent_pk", "hardware") == [("r1", "iPhone14,2"), ("r2", None), ("r4", None)]
    assert tables.load_device_table(spark, silver, fmt="parquet").count() == 2


def test_studies(spark, projects):
    loaded = tables.load_all_studies(spark, ["s one", "missing", "s2", "broken"], projects, COLUMNS, "parquet")
    assert loaded.failed == ["missing", "broken"] and set(loaded.errors) == {"missing", "broken"}
    assert values(loaded.balance, "uuid", "respondent_pk", "survey_pk", "yob") == [
        ("s one", "r1", "o1", 1980), ("s one", "r2", "o1", None), ("s2", "r1", "o1", None)
    ]
    one, problem = tables.load_study_balance(spark, "s2", projects, COLUMNS, "parquet")
    assert problem is None and one.columns == ["respondent_pk", "survey_pk", "exposure_band", "uuid"]
    assert tables.load_all_studies(spark, [], projects).balance is None
    assert tables.load_all_studies(spark, ["missing"], projects, fmt="parquet").balance is None
    with pytest.raises(ValueError):
        tables.union_studies([])


def test_studies_one_path_at_a_time(spark, projects, monkeypatch):
    real = tables.load_study_balance
    monkeypatch.setattr(
        tables, "load_study_balance", lambda s, u, b, c, fmt: real(s, u, b, c, "parquet")
    )
    loaded = tables.load_all_studies(spark, ["s one", "s2"], projects, COLUMNS, "delta")
    assert loaded.balance.count() == 3


def test_user_completion_join(spark, silver):
    users = tables.load_user_table(spark, silver, fmt="parquet")
    done = tables.load_task_complete_table(spark, silver, "2025-01-01", "panel", "parquet")
    info = tables.load_respondent_info_table(spark, silver, fmt="parquet")
    devices = tables.load_device_table(spark, silver, users, fmt="parquet")
    got = joins.join_user_task_respondent(users, done, info, devices)
    assert len(set(got.columns)) == len(got.columns)
    assert values(got, "respondentPk", "taskPk", "gender", "fulcrum_region", "ditr_hardware") == [
        ("r1", "t1", "female", "C", "iPhone14,2"), ("r1", "t2", "female", "C", "iPhone14,2"),
        ("r2", "t1", None, "G", None),
    ]
    hot = skew.HotKeys([("r1", 3)], [users.schema["respondent_pk"].dataType])
    again = joins.join_user_task_respondent(users, done, info, devices, hot=hot)
    assert values(again, *got.columns) == values(got, *got.columns)
    left = joins.join_user_task_respondent(users, done, info, join_type="left")
    assert values(left, "respondent_pk", "taskPk") == [("r1", "t1"), ("r1", "t2"), ("r2", "t1"), ("r4", None)]
    with pytest.raises(ValueError):
        joins.join_user_task_respondent(users, done, info, join_type="cross")


def _sides(frame):
    users = frame("respondent_pk int, gender string, age int", [(1, "f", 5), (2, "m", 6), (3, "f", 7), (4, "m", 8), (8, "x", 9)])
    done = frame(
        "respondentPk int, taskPk int, age int, date_completed timestamp, date_created timestamp",
        [(r, t, 0, datetime(2025, 1, 2, 0, 0, t or 9), datetime(2025, 1, 2)) for r, t in
         [(1, 1), (1, 2), (1, 2), (2, 1), (5, 1), (None, 3), (8, None)]],
    )
    info = frame("respondent_pk int, gender string, region string", [(1, "no", "N"), (3, "no", "S"), (5, "no", "E"), (6, "no", "W"), (8, "no", "X"), (None, "no", "Z")])
    devices = frame("respondent_pk int, hardware string, app string", [(1, "h1", "a1"), (3, "h3", "a3"), (5, "h5", "a5")])
    return users, done, info, devices


@pytest.mark.parametrize("how", joins.USER_JOINS)
def test_user_join_types_are_those_of_the_plain_chain(frame, how):
    users, done, info, devices = _sides(frame)
    got = joins.join_user_task_respondent(users, done, info, devices, how, hot=skew.HotKeys([(1, 2)], [users.schema["respondent_pk"].dataType]))
    u, d, i = users.alias("u"), done.drop("age").alias("d"), info.withColumnsRenamed({"respondent_pk": "ipk"}).drop("gender").alias("i")
    plain = u.join(d, F.col("u.respondent_pk") == F.col("d.respondentPk"), how)
    plain = plain.join(i, F.col("respondent_pk") == F.col("ipk"), how).drop("ipk")
    v = devices.withColumnsRenamed({"respondent_pk": "ditr_respondent_pk", "hardware": "ditr_hardware"})
    plain = plain.join(v, F.col("respondent_pk") == F.col("ditr_respondent_pk"), "left")
    assert set(got.columns) == set(plain.columns)
    assert values(got, *plain.columns) == values(plain, *plain.columns)


@pytest.mark.parametrize("given", [True, False])
@pytest.mark.parametrize("dedupe", [True, False])
def test_panel_in_two_shuffles_equals_the_steps(frame, given, dedupe):
    users, done, info, devices = _sides(frame)
    users = users.unionByName(users.where("respondent_pk = 2"))  # a user listed twice
    info = info.unionByName(frame("respondent_pk int, gender string, region string", [(2, "no", "Q")]))
    tasks = frame("task_pk int, task_length_of_task int, points int", [(1, 5, 1), (2, None, 2)])
    study = frame(
        "balance_respondentPk int, task_pk int, wonky_study_count int, exposure_band string",
        [(1, 1, 1, "exposed"), (1, 1, 0, "control"), (2, 9, 1, "exposed"), (None, 3, 1, "exposed"), (5, 1, 1, "control")],
    )
    rows = joins.join_user_task_respondent(users, done, info, devices) if given else done
    steps = joins.merge_task_metadata(windows.enrich_with_task_counts(rows), tasks)
    steps = joins.merge_study_data_with_user_info(steps, study, dedupe=dedupe)
    respondents = joins.respondent_table(users, done, info, devices, study) if given else None
    hot = skew.find_hot_key_sets(done, [["respondentPk"], ["respondentPk", "taskPk"]], 1)
    for h, hp in ((None, None), hot):
        got = joins.join_panel(done, tasks, study, respondents, users.columns if given else (), dedupe, h, hp)
        assert got.columns == steps.columns
        assert values(got, *steps.columns) == values(steps, *steps.columns)


def test_merge_keeps_fan_out_unless_asked(frame):
    done = frame("respondentPk int, taskPk int, task_pk int", [(1, 1, 9), (1, 2, 9), (2, 1, 9), (None, 1, 9)])
    study = frame(
        "balance_respondentPk int, task_pk int, wonky_study_count int, exposure_band string",
        [(1, 1, 1, "exposed"), (1, 1, 0, "control"), (None, 1, 1, "exposed")],
    )
    got = joins.merge_study_data_with_user_info(done, study)
    assert values(got, "respondentPk", "taskPk", "wonky_study_count", "wonky_user_flag", "_merge") == [
        (1, 1, 0, 1, "both"), (1, 1, 1, 1, "both"), (1, 2, None, 1, "left_only"), (2, 1, None, 0, "left_only"),
        (None, 1, None, 0, "left_only"),
    ]
    assert "task_pk_wonky" in got.columns
    single = joins.merge_study_data_with_user_info(done, study, dedupe=True)
    assert values(single, "respondentPk", "taskPk", "wonky_study_count") == [
        (1, 1, 1), (1, 2, None), (2, 1, None), (None, 1, None)
    ]
    assert joins.merge_study_data_with_user_info(done, study, how="inner").count() == 2
    met = {how: joins.merge_study_data_with_user_info(done, study, how=how).groupBy("_merge").count() for how in ("right", "outer")}
    alone = study.join(done, [study.balance_respondentPk == done.respondentPk, study.task_pk == done.taskPk], "left_anti").count()
    right, outer = ({r["_merge"]: r["count"] for r in met[how].collect()} for how in ("right", "outer"))
    assert right == {k: n for k, n in {"both": 2, "right_only": alone}.items() if n}
    assert outer == {**right, "left_only": 3}


def test_null_keys_form_no_group(frame):
    df = frame("respondent_pk int, yob int, task_pk int, uuid string, wonky_study_count int",
               [(1, 1980, 5, "a", 1), (1, 1980, 5, "b", 1), (1, None, 6, "a", 0), (None, 1980, 5, "a", 1)])
    assert values(aggregates.aggregate_studies(df, ["respondent_pk", "yob", "gone"]),
                  "balance_respondentPk", "yob", "balance_study_count", "wonky_study_count") == [(1, 1980, 2, 2)]
    assert aggregates.aggregate_studies(df, ["respondent_pk", "yob"], keep_nulls=True).count() == 3
    summary = aggregates.create_study_respondent_summary(df, categorical_cols=["yob"])
    assert values(summary, "balance_respondentPk", "task_pk_count", "task_pk_nunique", "total_wonky_studies") == [(1, 2, 1, 2)]
    plain = aggregates.create_study_respondent_summary(df.drop("uuid"), categorical_cols=[])
    assert values(plain, "total_wonky_studies") == [(2,)]


def test_breakdown_sides(frame):
    rows = [(1, 2.0), (0, 1.0), (1, 0.0), (0, 0.0), (None, 0.0)]
    r = profile.breakdown(frame("f int, wonky_study_count double", rows), ["f", "gone"]).first()
    assert (r.all_pct, r.group_pct, r.other_pct, r.delta_pct, r.other_means) == (50, 50, 50, 0, "zero")
    with_missing = frame("f int, wonky_study_count double", [*rows, (1, None), (1, -1.0)])
    r = profile.breakdown(with_missing, ["f"]).first()
    assert (r.other_pct, r.other_means) == (100, "missing")
    r = profile.breakdown(frame("f int, wonky_study_count double", [(1, 0.0)]), ["f"]).first()
    assert (r.group_pct, r.other_pct) == (0, 100)
    text = profile.create_breakdown_summary(with_missing.withColumnRenamed("f", "is_x"), ["is_x"])
    assert text.splitlines()[:2] == ["features created:", "  - Is X: 66.7%"]
    assert "wonky_study_count is NaN" in text
    flags = frame("is_fast int, wonky_study_count double", [(1, 1.0), (0, 0.0)])
    assert "Fast tasks (1 std dev below mean): 50.0%" in profile.create_task_speed_breakdown_summary(flags)
    with pytest.raises(ValueError):
        profile.breakdown(flags, ["is_fast"], "no group")


def test_group_table_skips_empty_metrics(frame):
    df = frame("g int, k int, x double, y double", [(1, 0, 1.0, 1.0), (1, 0, 3.0, 2.0), (0, 0, 4.0, None)])
    r = profile.create_feature_breakdown_table(df, "k", "g").collect()
    assert [x.metric for x in r] == ["x"]
    assert (r[0].wonky_mean, r[0].wonky_median, r[0].non_wonky_std, r[0].median_difference) == (2.0, 2.0, None, -2.0)


def test_histogram_edges(frame):
    df = frame("x double, f int", [(0.0, 0), (10.0, 1), (10.1, 0), (100.0, 0), (None, 1)])
    got = {r.bin: r for r in profile.equal_width_histogram(df, "x", "f", bins=10).collect()}
    # empty bins are listed
    assert {b: r["count"] for b, r in got.items()} == {**dict.fromkeys(range(1, 11), 0), 1: 2, 2: 1, 10: 1}
    assert got[1].wonky_any == 1 and got[1].bin_center == 5.0 and got[10].percent == 25.0


def test_exposure_counts_people_once(frame):
    summary = frame("respondentPk int, exposure_band string", [(1, "exposed"), (1, "exposed"), (2, "exposed")])
    users = frame("respondentPk int, gender string, a int, b int", [(1, "f", 1, 0), (1, "f", 1, 1), (2, "f", 0, 1), (2, None, 1, 1)])
    got = aggregates.exposure_and_gender_counts(summary, users, ["a", "b"])
    assert values(got, "label_tags", "n", "group_total") == [("a", 1, 3), ("b", 2, 3)]


def test_export_keeps_known_columns(spark, frame, tmp_path):
    df = frame("feature string, extra int, avg_rank double, VIF double", [("b", 1, 2.0, 3.0), ("a", 1, 1.0, 2.0)])
    sinks.export_results(df, f"{tmp_path}/out")
    back = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert back.columns == ["feature", "avg_rank", "VIF"] and back.count() == 2


def test_settings(tmp_path):
    path = tmp_path / "studies.yaml"
    path.write_text("some_study_uuids:\n  a: true\n  b: false\ncols_to_drop: [x]\nunknown: 1\n")
    made = panel.with_configured_studies(config.read_yaml(path))
    assert made.study_labels == {"a": True, "b": False} and made.cols_to_drop == ["x"]
    assert made.cols_to_group == list(config.STUDY_GROUP_KEYS)


def test_whole_analysis(spark, silver, projects, tmp_path):
    paths = config.PathSettings(silver, projects, "GB", "2025-01-01", "panel", "parquet")
    studies = config.StudySettings({"s one": True, "s2": False, "missing": True}, COLUMNS)
    pulled = panel.pull_panel(spark, paths, studies)
    assert pulled.failed_studies == ["missing"]
    pulled.write({"user_info_df": f"{tmp_path}/pulled", "wonky_user_counts": f"{tmp_path}/counts"})
    back = sinks.read_table(spark, f"{tmp_path}/pulled")
    assert values(back, "respondentPk", "taskPk", "wonky_study_count", "task_completed") == [
        ("r1", "t1", 1, 2), ("r1", "t2", None, 2), ("r2", "t1", None, 1)
    ]
    made = panel.engineer_features(back)
    names = set(made.columns)
    assert {"respondentPk", "wonky_study_count", "is_monday", "days_active_0_to_2", "quality<90",
            "hardware_category_iphone_14", "fulcrum_region_mapped_London", "gender_female", "risk"} <= names
    assert "country" not in names and made.count() == 3
    results, unknown = panel.test_features(made, {"days": ["is_sunday", "gone,"]})
    assert unknown == {"days": ["gone"]} and results.count() == 0
    assert pulled.wonky_map.count() == 3
    assert spark.read.parquet(f"{tmp_path}/counts").where(F.col("wonky_task_ratio_cap") > 1).count() == 0
