"""One hand-written row per rule."""

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelsift import config
from panelsift.columns import c, drop_duplicate_columns
from panelsift.functions import bins, device, income, onehot, speed, temporal
from panelsift.operators import select, windows
from panelsift.plans import panel
from tests.conftest import values

HARDWARE = {
    None: "unknown", "iPhone17,1": "iphone_16", "iPhone15,2": "iphone_15",
    "iPhone16,1": "iphone_15", "iPhone14,2": "iphone_14", "iPhone13,1": "iphone_13",
    "iPhone8,1": "iphone_legacy", "iphone se": "iphone_se", "iphone pro max": "iphone_pro_max",
    "iphone pro": "iphone_pro", "iphone xr": "iphone_x_series", "iphone": "iphone_other",
    "mt6989": "mediatek_flagship", "mt6893": "mediatek_upper_mid", "mt6785": "mediatek_mid",
    "mt6768": "mediatek_budget", "mediatek": "mediatek_other", "exynos2200": "exynos_flagship",
    "exynos9820": "exynos_upper_mid", "exynos9611": "exynos_mid", "s5e8535": "exynos_budget",
    "qcom": "qualcomm", " Shiba ": "google_pixel", "ums512": "unisoc_budget",
    "s9863a": "unisoc_budget", "kirin990": "kirin_flagship", "kirin710": "kirin_mid",
    "hi6250": "kirin_other", "samsungx": "samsung_other", "rmx2020": "realme", "joan": "lg",
    "itel": "itel_budget", "w6001": "itel_budget", "tcl": "tcl", "surface": "microsoft_surface",
    "zzz": "other", "xiaomi 5": "xiaomi", "snapdragon 8": "qualcomm", "": "other",
    "iphone99999999999999999999999": "iphone_16",
}
MAKERS = {
    None: "unknown", "Apple": "apple", "samsung ": "samsung", "xiaomi inc": "xiaomi",
    "honor": "huawei_honor", "motorola mobility llc": "motorola", "TECNO MOBILE": "transsion",
    "Blackview": "budget_chinese", "x-tigi": "budget_chinese", "alcatel": "tcl",
    "HMD Global": "hmd_nokia", "nubia": "zte_nubia", "LGE": "lg", "Crosscall": "rugged_enterprise",
    "fcnt": "japanese_other", "Teclast": "tablet_other", "notepad": "tablet_other",
    "sprd": "odm_reference", "acme": "other", "applex": "other", "bobcat": "rugged_enterprise",
}


def test_hardware_rules(frame):
    df = device.add_hardware_category(frame("h string", [(h,) for h in HARDWARE]), "h", "got")
    assert {r.h: r.got for r in df.collect()} == HARDWARE


def test_manufacturer_rules(frame):
    df = device.add_manufacturer_category(frame("m string", [(m,) for m in MAKERS]), "m", "got")
    assert {r.m: r.got for r in df.collect()} == MAKERS


def test_every_hour(frame):
    rows = [(h, datetime(2024, 1, 6, h, 59)) for h in range(24)] + [(24, None)]
    df = temporal.create_all_temporal_features(frame("i int, d timestamp", rows), "d")
    got = {r.i: r for r in df.collect()}
    for h in range(24):
        r = got[h]
        label = temporal.clock_label(h)
        assert (r.hour_of_day, r.day_of_week, r.hour_of_day_label) == (h, 5, label)
        assert r[f"is_hour_{h}"] == r[f"is_{label}"] == 1
        assert sum(r[f"is_hour_{k}"] for k in range(24)) == 1
        assert sum(r[f"is_{d}"] for d in temporal.WEEKDAYS) == r.is_saturday == 1
        assert r.is_night == int(h >= 22 or h <= 6)
        assert r.is_business_hour == r.is_business_hour_weekend == int(9 <= h <= 17)
        assert r.is_business_hour_weekday == 0
    assert [temporal.clock_label(h) for h in (0, 1, 11, 12, 13, 23)] == ["12am", "1am", "11am", "12pm", "1pm", "11pm"]
    assert got[6].is_night == got[6].is_early_morning == 1  # the overlap is kept
    assert got[17].hour_period == "evening" and got[17].is_business_hour == 1
    empty = got[24]
    assert empty.hour_of_day is None and empty.hour_period is None and empty.hour_of_day_label is None
    assert all(empty[n] == 0 for n in df.columns if n.startswith("is_"))
    short = temporal.create_all_temporal_features(frame("i int, d timestamp", rows), "d", False)
    assert not [n for n in short.columns if n.startswith("is_hour_")]


def test_thresholds(frame):
    rows = [(1.0,), (2.0,), (3.0,), (None,)]
    rules = [(op, op, 2) for op in bins.COMPARISONS]
    got = {r.x: r for r in bins.create_threshold_features(frame("x double", rows), "x", rules).collect()}
    expected = {"<": (1, 0, 0, 0), "<=": (1, 1, 0, 0), ">": (0, 0, 1, 0), ">=": (0, 1, 1, 0),
                "==": (0, 1, 0, 0), "!=": (1, 0, 1, 1)}
    for op, flags in expected.items():
        assert tuple(got[x][op] for x in (1.0, 2.0, 3.0, None)) == flags
    with pytest.raises(ValueError):
        bins.create_threshold_features(frame("x double", rows), "x", [("a", "~", 1)])


def test_scores_and_deltas(frame):
    df = bins.create_score_features(frame("q double", [(100.0,), (30.0,), (None,)]), "q")
    got = {r.q: r for r in df.collect()}
    assert got[100.0]["q=100"] == 1 and got[30.0]["q<50"] == 1 and got[30.0]["q<30"] == 0
    assert sum(v for n, v in got[None].asDict().items() if n != "q") == 0
    df = bins.create_delta_category_features(frame("d double", [(51.0,), (0.0,), (-50.0,)]), "d")
    got = {r.d: tuple(r)[1:] for r in df.collect()}
    assert got == {51.0: (1, 1, 0, 0, 0), 0.0: (0, 0, 1, 0, 0), -50.0: (0, 0, 0, 0, 1)}


def test_bins(frame):
    xs = [-1.0, 0.0, 2.0, 2.5, 3.0, 10.0, 11.0, 250.0, 251.0, None]
    df, names = bins.create_binned_features(
        frame("x double", [(x,) for x in xs]), "x", bins.TENURE_BINS, "d_",
        include_mutually_exclusive=True,
    )
    got = {r.x: r for r in df.collect()}
    disjoint = [n for n in names if "_to_" in n or n.endswith("plus")]
    on = {x: [n for n in disjoint if got[x][n]] for x in xs}
    assert on == {
        -1.0: [], 0.0: ["d_0_to_2"], 2.0: ["d_0_to_2"], 2.5: [], 3.0: ["d_3_to_10"],
        10.0: ["d_3_to_10"], 11.0: ["d_11_to_20"], 250.0: ["d_201_to_250"], 251.0: ["d_251_plus"],
        None: [],
    }
    assert got[250.0]["d_>=250"] == 1 and got[2.0]["d_<2"] == 0 and got[-1.0]["d_<2"] == 1


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 400), min_size=1, max_size=20))
def test_disjoint_bins_cover_whole_numbers(frame, xs):
    df, names = bins.create_binned_features(
        frame("x int", [(x,) for x in xs]), "x", [5, 20, 100], include_mutually_exclusive=True
    )
    disjoint = [c(n) for n in names if "_to_" in n or n.endswith("plus")]
    total = sum(disjoint[1:], disjoint[0])
    assert {r[0] for r in df.select(total).collect()} == {1}


def test_task_amounts(frame):
    xs = {-1: None, 0: 0, 10: 0, 11: 1, 25: 1, 75: 2, 125: 3, 175: 4, 225: 5, 226: 6, None: None}
    df, labels = bins.create_task_amount_features(frame("n int", [(x,) for x in xs]), "n")
    for r in df.collect():
        assert [r[label] for label in labels] == [int(i == xs[r.n]) for i in range(7)]


def test_rounding_halves_to_even(frame):
    df = frame("x double", [(float(x),) for x in (5, 15, 25, 35, 94, 95, 100)])
    got = {r.x: r.y for r in df.select("x", bins.round_to_tens("x").alias("y")).collect()}
    assert got == {5.0: 0, 15.0: 20, 25.0: 20, 35.0: 40, 94.0: 90, 95.0: 100, 100.0: 100}


def test_cap_keeps_missing(frame):
    df = frame("x double", [(0.5,), (2.0,), (None,)])
    assert [r[0] for r in df.select(bins.cap_at_one("x")).collect()] == [0.5, 1.0, None]


def test_one_hot_text(frame):
    df = frame("i int, g string", [(1, "a"), (2, " b\t"), (3, None), (4, "a ")])
    made, names = onehot.one_hot_encode_column(df, "g")
    assert names == ["g_a", "g_b"]
    assert values(made, "i", "g_a", "g_b") == [(1, 1, 0), (2, 0, 1), (3, 0, 0), (4, 1, 0)]
    made, names = onehot.one_hot_encode_column(df, "g", as_string=True)
    assert names == ["g_a", "g_b", "g_nan"]
    assert all(sum(r[n] for n in names) == 1 for r in made.collect())


def test_one_hot_lists(frame):
    rows = [(1, ["x", "x", " y"]), (2, []), (3, None), (4, ["y", None])]
    df = frame("i int, g array<string>", rows)
    made, names = onehot.one_hot_encode_column(df, "g")
    assert values(made, "i", *names) == [(1, 2, 1), (2, 0, 0), (3, 0, 0), (4, 0, 1)]
    made, names = onehot.one_hot_encode_column(df, "g", as_string=True)
    assert names == ["g_nan", "g_x", "g_y"]
    assert values(made, "i", *names) == [(1, 0, 2, 1), (2, 1, 0, 0), (3, 1, 0, 0), (4, 1, 0, 1)]


def test_sparse_entries_are_the_flags_that_are_set(frame):
    rows = [(1, ["x", "y", "x"], " a "), (2, [], None), (3, None, "b")]
    df = frame("id int, g array<string>, t string", rows)
    made = onehot.one_hot_entries(df, {"g": True, "t": False}).collect()
    found = {r.id: {(e.column, e.category): e.n for e in r.encoded} for r in made}
    assert found[1] == {("g", "x"): 2, ("g", "y"): 1, ("t", "a"): 1}
    assert found[2] == {("g", onehot.MISSING): 1}
    assert found[3] == {("g", onehot.MISSING): 1, ("t", "b"): 1}
    words = {(r.column, r.category): r.rows for r in onehot.vocabulary(df, {"g": True}).collect()}
    assert words == {("g", "x"): 1, ("g", "y"): 1, ("g", onehot.MISSING): 2}


def test_categories_of_scalars_take_no_function_over_arrays(frame, capsys):
    df = frame("a string, n int, g array<string>", [(" x ", 1, ["p", "p"]), (None, None, None), ("x", 1, ["p", "q"])])
    words = onehot.vocabulary(df, {"a": False, "n": True, "g": False})
    assert values(words, "column", "category", "rows") == [
        ("a", "x", 2), ("g", "p", 2), ("g", "q", 1), ("n", "1", 2), ("n", onehot.MISSING, 1)
    ]
    onehot.vocabulary(df.drop("g"), {"a": False, "n": True}).explain()
    assert "lambda" not in capsys.readouterr().out


def test_features_of_one_row_are_made_where_they_are_read(frame, monkeypatch):
    written = []
    store = panel.materialise
    monkeypatch.setattr(panel, "materialise", lambda df: written.append(df.columns) or store(df))
    day = datetime(2025, 6, 2, 23, 30)
    df = frame(
        "respondentPk int, date_completed timestamp, date_created timestamp, task_time_taken_s bigint, quality double, "
        "ditr_hardware string, ditr_manufacturer string, gender string, task_completed bigint, wonky_study_count int",
        [(i % 2, day, day, 10 + i, 10.0 * i, "qcom", "apple", None if i else "female", i, 1) for i in range(12)],
    )
    made = panel.engineer_features(df)
    assert len(written) == 1 and {"is_fast", "first_task_created", "hardware_category"} <= set(written[0])
    flags = ["is_night", "is_hour_23", "quality<90", "days_active_0_to_2", "total_tasks_1_10", "quality_round10"]
    assert not set(flags) & set(written[0])
    order = ["is_fast", "is_night", "quality<90", "first_task_created", "days_active_before_task", "total_tasks_1_10",
             "hardware_category", "manufacturer_category", "quality_round10", "hardware_category_qualcomm", "gender_female"]
    assert [n for n in made.columns if n in order] == order
    sums = made.agg(*[F.sum(c(n)).alias(n) for n in (*flags[:5], "gender_female")]).first()
    assert tuple(sums) == (12, 12, 9, 12, 11, 1)


def test_one_hot_other_types_need_text(frame):
    df = frame("i int, b boolean, n int", [(1, True, 5), (2, False, None)])
    with pytest.raises(TypeError):
        onehot.one_hot_encode_column(df, "b")
    made = onehot.batch_one_hot_encode(df, ["b", "n"], ["b", "n"])
    assert values(made, "i", "b_True", "b_False", "n_5", "n_nan") == [(1, 1, 0, 1, 0), (2, 0, 1, 0, 1)]
    assert onehot.vocabularies(df, {"i": True}) == {"i": ["1", "2"]}  # no limit on categories


def test_mapping(frame):
    df = frame("r string", [("A",), ("L",), ("M",), (None,)])
    made, names = onehot.create_value_mapping_and_encode(df, "r", config.REGION_LABELS)
    got = {r.r: r for r in made.collect()}
    assert got["M"].r_mapped is None and got["M"]["r_mapped_nan"] == 1
    assert got["A"]["r_mapped_East Midlands (England)"] == 1 and len(names) == 3


def _speed_rows():
    rows = [("big", float(x)) for x in range(100)] + [("same", 50.0)] * 12
    rows += [("tiny", float(x)) for x in (0, 1, 2, 3, 4, 5, 6, 7, 99)] + [("ten", float(x)) for x in range(10)]
    return rows + [(None, 5.0), ("big", None), ("same", None)]


def test_speed_by_group(frame):
    import numpy as np

    rows = _speed_rows()
    df = frame("g string, x double", rows)
    made = speed.create_task_speed_features(df, "x", group_by_col="g").collect()
    known = [x for _, x in rows if x is not None]

    def cut(group):
        own = [x for g, x in rows if (g or "unknown") == group and x is not None]
        return np.quantile(known if len(own) < 10 else own, [0.025, 0.16, 0.84, 0.975])

    for r in made:
        group = r.g or "unknown"
        flags = (r.is_suspiciously_fast, r.is_fast, r.is_slow, r.is_suspiciously_slow)
        assert r.is_very_fast == r.is_fast
        if r.x is None:
            assert flags == (0, 0, 0, 0) and r.is_normal_speed == 0
        elif group == "same":
            assert flags == (0, 0, 0, 0) and r.is_normal_speed == 1
        else:
            sf, f, s, ss = cut(group)
            assert flags == (int(r.x < sf), int(r.x < f), int(r.x > s), int(r.x > ss))
            assert r.is_normal_speed == int(f <= r.x <= s)
    assert "__group" not in made[0]


def test_speed_special_cases(frame):
    one = frame("x double", [(7.0,), (7.0,), (None,)])
    got = speed.create_task_speed_features(one, "x").collect()
    assert [(r.is_fast, r.is_normal_speed) for r in got] == [(0, 1)] * 3
    with pytest.raises(ValueError):
        speed.create_task_speed_features(frame("x double", [(None,)]), "x")
    with pytest.raises(ValueError):
        speed.create_task_speed_features(one, "absent")
    old = frame("x double, task_points int", [(29.0, 3), (30.0, 3), (180.0, 3), (3601.0, 3), (0.0, 3), (None, 3)])
    got = {r.x: r for r in speed.create_task_speed_features(old, "x", use_std_dev=False).collect()}
    assert (got[29.0].is_suspiciously_fast, got[30.0].is_suspiciously_fast) == (1, 0)
    assert (got[180.0].is_very_fast, got[3601.0].is_very_slow) == (0, 1)
    assert got[0.0].task_points_perMinute is None and got[180.0].task_points_perMinute == 1.0
    assert got[None].is_very_fast == 0


def test_income(frame):
    labels = {
        "Less than £15,000": ("Less than £35k", 0.0, "<£15k", 15000.0),
        "£35,000 to £39,999": ("£35k to £49k", 35000.0, "£35k to £39k", 35000.0),
        "£75,000 to £84,999": ("£50k to £79k", 75000.0, "£75k to £84k", 75000.0),
        "£85,000 to £99,999": ("£80k to £99k", 85000.0, "£85k to £99k", 85000.0),
        "£200,000 and above": ("£100k or more", 200000.0, "£200k+", 200000.0),
        "Prefer not to answer": ("Prefer not to answer", float("inf"), "no_answer", None),
        "something": ("Unknown", float("inf"), "something", None),
        None: ("unknown.", float("inf"), None, None),
    }
    s = F.col("s")
    short = income.shorten_income_label(s)
    df = frame("s string", [(k,) for k in labels]).select(
        "s", income.income_bucket(s), income.income_lower_bound(s), short, income.extract_max_salary(short)
    )
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == labels


def test_small_text_helpers(frame):
    df = frame("a string, b string", [("days_12", "x"), ("days_x", None)])
    got = df.select(income.trailing_number(F.col("a")), income.joined_categories(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(12.0, "days_12_x"), (None, "days_x_nan")]


def test_days_are_floored(frame):
    rows = [(1, datetime(2024, 1, 2, 12), datetime(2024, 1, 2, 13)), (1, datetime(2024, 1, 4, 13), None),
            (2, datetime(2024, 1, 1), None)]
    df = frame("respondentPk int, date_completed timestamp, date_created timestamp", rows)
    got = windows.add_days_active(df)
    assert values(got, "respondentPk", "days_active_before_task") == [(1, -1), (1, 2), (2, None)]


def test_latest_record_prefers_dates_over_null(frame):
    rows = [(1, None, "z"), (1, datetime(2024, 1, 1), "a"), (1, datetime(2024, 1, 1), "b"), (2, None, "c")]
    df = windows.latest_per_key(frame("k int, d timestamp, v string", rows), ["k"], "d")
    assert values(df, "k", "v") == [(1, "b"), (2, "c")]


def test_rating_delta_rejects_bad_periods(frame):
    df = frame("respondentPk int, date_completed timestamp, risk int", [(1, datetime(2024, 1, 1), 3)])
    with pytest.raises(ValueError):
        windows.add_rating_delta(df, "risk", 0)


def test_columns(frame):
    df = frame("a int, b int, c int", [(1, 2, 3)]).toDF("x", "y", "x")
    assert drop_duplicate_columns(df).collect()[0].asDict() == {"x": 1, "y": 2}
    assert drop_duplicate_columns(df, "last").collect()[0].asDict() == {"y": 2, "x": 3}
    assert select.remove_collinear_features(["is_weekend", "a", "b_x"], ["a"]) == ["b_x"]
    assert select.remove_collinear_features(["aa", "b"], containing=["a"]) == ["b"]


def test_feature_sets_lose_stray_commas():
    known, unknown = config.clean_feature_sets({"s": ["a,", "b", "zz"]}, ["a", "b"])
    assert known == {"s": ["a", "b"]} and unknown == {"s": ["zz"]}
