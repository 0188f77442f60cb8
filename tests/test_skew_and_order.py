"""Hot keys and ordered work, against plain Spark on the same rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelsift.operators import ordered, skew
from tests.conftest import values


@pytest.fixture
def skewed(spark):
    # a third of the rows share key 0, another group has no key
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 20)
    return spark.range(0, 3000, numPartitions=6).select(
        "id", key.alias("k"), (F.col("id") * 7 % 101).alias("v")
    )


def test_hot_keys_are_found_with_their_share(skewed):
    hot = skew.find_hot_keys(skewed, ["k"], rows_per_task=400)
    assert [r[0] for r in hot.rows] == [0]
    n = skewed.where("k = 0").count()
    assert hot.rows[0][1] == -(-n // 400)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(skewed, how):
    small = skewed.where("id % 4 = 0").select("k", F.col("v").alias("w")).distinct()
    hot = skew.find_hot_keys(skewed, ["k"], rows_per_task=20)
    assert len(hot.rows) > 5 and any(r[0] is None for r in hot.rows)
    salted = skew.salted_join(skewed, small, ["k"], how, hot)
    plain = skewed.join(small, "k", how)
    assert values(salted, "id", "k", "v", "w") == values(plain, "id", "k", "v", "w")


def test_salting_spreads_one_key_over_tasks(spark, skewed):
    # these tables are small enough to be broadcast at run time, which needs no spreading
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in limits:
        spark.conf.set(name, "-1")
    hot = skew.find_hot_keys(skewed, ["k"], rows_per_task=100)
    small = skewed.select("k").distinct().withColumn("w", F.lit(1))
    rows = skewed.repartition(8)
    tasks = {
        n: skew.salted_join(rows, small, ["k"], "inner", h)
        .where("k = 0")
        .select(F.spark_partition_id())
        .distinct()
        .count()
        for n, h in (("spread", hot), ("plain", skew.HotKeys([], hot.types)))
    }
    for name in limits:
        spark.conf.unset(name)
    assert tasks["plain"] == 1 and tasks["spread"] > 1


def test_attach_per_key_is_a_window_with_null_group(skewed):
    hot = skew.find_hot_keys(skewed, ["k"], rows_per_task=50)
    made = skew.attach_per_key(
        skewed, ["k"], F.count("v").alias("n"), F.min("v").alias("low"), hot=hot
    )
    w = Window.partitionBy("k")
    plain = skewed.withColumns({"n": F.count("v").over(w), "low": F.min("v").over(w)})
    assert values(made, "id", "k", "n", "low") == values(plain, "id", "k", "n", "low")


def test_lookup_join_beyond_the_broadcast_limit(skewed, monkeypatch):
    small = skewed.select("k").distinct().where("k IS NOT NULL").withColumn("w", F.col("k") * 2)
    broadcasted = skew.lookup_join(skewed, small, ["k"])
    monkeypatch.setattr(skew, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
    assert values(skew.lookup_join(skewed, small, ["k"]), "id", "w") == values(broadcasted, "id", "w")


def test_fits_broadcast_counts_rows_and_bytes(spark):
    df = spark.range(50).withColumn("s", F.repeat(F.lit("x"), 100))
    assert skew.fits_broadcast(df, max_rows=50)
    assert not skew.fits_broadcast(df, max_rows=49)
    assert not skew.fits_broadcast(df, max_bytes=1000)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_total_equals_window(skewed, keys):
    made = ordered.running_total(skewed, {"t": F.col("v")}, [F.col("v").desc(), F.col("id")], keys)
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("v").desc(), "id")
    plain = skewed.withColumn("t", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert values(made, "id", "t") == values(plain, "id", "t")


def test_groups_do_span_range_partitions(skewed):
    parts = skewed.repartitionByRange("k", "v").select(F.spark_partition_id().alias("p"), "k")
    assert parts.distinct().groupBy("k").count().where("count > 1").count() > 0


def test_row_numbers_cover_copies(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.lit(5).alias("v"))
    made = ordered.numbered(df, ["k"], [F.col("v")], "n")
    assert sorted(r.n for r in made.collect()) == list(range(1, 1001))


def test_lag_by_rows(skewed):
    rows = skewed.where("k IS NOT NULL")
    made = ordered.lagged(rows, "v", 3, ["k"], [F.col("id")], "before")
    plain = rows.withColumn("before", F.lag("v", 3).over(Window.partitionBy("k").orderBy("id")))
    assert values(made, "id", "before") == values(plain, "id", "before")


@pytest.mark.parametrize("p", [0.0, 0.025, 0.16, 0.5, 0.95, 0.9999, 1.0])
def test_quantiles_are_linear(spark, p):
    rng = np.random.default_rng(3)
    data = [float(x) for x in rng.normal(size=997)] + [0.25] * 300
    df = spark.createDataFrame([(x,) for x in data] + [(None,)], "x double")
    got = ordered.quantiles(df, "x", {"q": p}).first()
    assert got.n == len(data)
    assert got.q == pytest.approx(np.quantile(data, p), abs=1e-12)


def test_quantiles_per_group_keep_a_null_group(skewed):
    got = {r.k: r.q for r in ordered.quantiles(skewed, "v", {"q": 0.3}, ["k"]).collect()}
    plain = {
        r.k: r.q for r in skewed.groupBy("k").agg(F.percentile("v", 0.3).alias("q")).collect()
    }
    assert got.keys() == plain.keys() and None in got
    assert all(got[k] == pytest.approx(plain[k]) for k in got)


@pytest.fixture
def lumps(spark):
    """Normal values with a lump of equal ones, so that brackets end inside the lump."""
    key = F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3)
    x = F.when(F.col("id") % 5 == 0, 0.5).otherwise(F.randn(4))
    return spark.range(40_000, numPartitions=5).select(key.alias("k"), x.alias("x")).persist()


LEVELS = {f"q{i}": p for i, p in enumerate((0.0, 0.01, 0.16, 0.5, 0.5, 0.84, 0.9999, 1.0))}


def assert_exact(df, keys):
    got = {tuple(r[k] for k in keys): r for r in ordered.quantiles(df, "x", LEVELS, keys).collect()}
    plain = df.groupBy(*keys).agg(F.percentile("x", list(LEVELS.values())).alias("q")).collect()
    assert len(got) == len(plain)
    for r in plain:
        row = got[tuple(r[k] for k in keys)]
        assert [row[n] for n in LEVELS] == pytest.approx(r.q, abs=1e-12)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_bracketed_quantiles_are_exact(lumps, monkeypatch, keys):
    picks = []
    real = ordered._stored_picks
    monkeypatch.setattr(ordered, "_stored_picks", lambda *a: picks.append(real(*a)) or picks[-1])
    monkeypatch.setattr(ordered, "SKETCH_ACCURACY", 2000)
    assert_exact(lumps, keys)
    assert len(picks) == 1 and picks[0].where("__missed").isEmpty()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_wide_groups_are_narrowed(lumps, monkeypatch, keys):
    monkeypatch.setattr(ordered, "SKETCH_ACCURACY", 20)  # wide brackets leave much inside
    monkeypatch.setattr(ordered, "ENTRIES", 60)
    monkeypatch.setattr(ordered, "PIECES", 8)
    rounds = []
    real = ordered._stored_counts
    monkeypatch.setattr(ordered, "_stored_counts", lambda f: rounds.append(real(f)) or rounds[-1])
    assert_exact(lumps, keys)
    assert len(rounds) > 3 and rounds[-1][1] < rounds[0][1] / 10


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_groups_with_missed_brackets_are_counted_anew(lumps, monkeypatch, keys):
    monkeypatch.setattr(ordered, "SKETCH_ACCURACY", 1000)
    monkeypatch.setattr(ordered, "_brackets", lambda ps: [0.3, 0.31] * len(ps))
    monkeypatch.setattr(ordered, "ENTRIES", 2000)
    assert_exact(lumps, keys)


def test_one_value_one_row_and_no_rows(frame):
    df = frame("k string, v double", [("a", 1.0), ("b", None), ("c", float("inf")), ("c", 2.0), (None, 3.0)])
    got = ordered.quantiles(df, "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}, ["k"])
    assert values(got, "k", "n", "lo", "hi") == [("a", 1, 1.0, 1.0), ("c", 2, 2.0, float("inf")), (None, 1, 3.0, 3.0)]
    assert ordered.quantiles(df.where("v < 0"), "v", {"q": 0.5}).collect() == []


def test_average_rank_shares_ties(frame):
    df = frame("v double", [(3.0,), (1.0,), (3.0,), (2.0,), (None,)])
    got = values(ordered.average_rank(df, "v"), "v", "rank")
    assert got == [(1.0, 4.0), (2.0, 3.0), (3.0, 1.5), (3.0, 1.5), (None, None)]


def test_result_does_not_depend_on_partitions(skewed):
    a = ordered.quantiles(skewed.repartition(1), "v", {"q": 0.77}, ["k"])
    b = ordered.quantiles(skewed.repartition(13), "v", {"q": 0.77}, ["k"])
    assert values(a, "k", "n", "q") == values(b, "k", "n", "q")


def test_running_total_shuffles_its_rows_once(spark):
    rows = [(i % 3 if i % 2 else None, i, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, at int, `odd, name` string")
    out = ordered.running_total(df, {"total": F.lit(1)}, [F.col("at").desc()], ["k"])
    prepared = out._jdf.queryExecution().executedPlan().toString()
    # what is left: the carried totals of the parts meet by key, and are broadcast
    wide = [line for line in prepared.splitlines() if "hashpartitioning" in line]
    assert all("__part" not in line for line in wide) and len(wide) == 1
    got = {(r["k"], r["at"]): r["total"] for r in out.collect()}
    by_key = {}
    for k, at, _ in sorted(rows, key=lambda r: -r[1]):
        by_key[k] = by_key.get(k, 0) + 1
        assert got.pop((k, at)) == by_key[k]
    assert not got and not [t for t in spark.catalog.listTables() if t.name.startswith("panelsift_")]


def test_hot_keys_of_several_sets_beyond_any_list_length(spark):
    # 51,000 keys with three rows each, 9,000 with one; the pairs are hot only with no key
    rows = spark.range(0, 162_000, numPartitions=6).select(
        F.when(F.col("id") < 153_000, F.col("id") % 51_000).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") < 153_000, F.col("id").cast("string")).alias("t"),
    )
    rows = rows.unionByName(spark.range(4).select(F.lit(None).cast("long").alias("k"), F.lit(None).cast("string").alias("t")))
    one, pair = skew.find_hot_key_sets(rows, [["k"], ["k", "t"]], rows_per_task=2)
    assert {r[0] for r in one.rows} == {*range(51_000), None}
    assert {r[1] for r in one.rows} == {2}
    assert pair.rows == [(None, None, 2)]


def test_hot_keys_of_empty_rows(spark):
    empty = spark.createDataFrame([], "k int, t string")
    assert [h.rows for h in skew.find_hot_key_sets(empty, [["k"], ["t", "k"]], 1)] == [[], []]
