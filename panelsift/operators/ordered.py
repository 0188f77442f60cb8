"""Ordered computations over groups of any size.

A window with an ORDER BY sorts one whole group in one task. The operators here
range-partition by (keys, order) instead: each range partition is worked on by
itself and a carried-in total is added for the only key that can span into it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsift.columns import all_of, any_of, c
from panelsift.operators.skew import lookup_join
from panelsift.session import materialise, materialise_by

SKETCH_ACCURACY = 10_000
# so many distinct values of one group may be ordered in a task; beyond, they are narrowed
ENTRIES = 200_000
# pieces a group's values are cut into when they are narrowed
PIECES = 256


def running_total(
    df: DataFrame,
    totals: Mapping[str, Column],
    order: Sequence[Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums within ``keys`` along ``order``.

    ``totals`` maps each output name to the column to sum; the order must be
    total within a key (aggregate to distinct values first), since equal rows get
    successive totals in an arbitrary order.
    """
    weights = {f"__w{i}": weight for i, weight in enumerate(totals.values())}
    ranged = materialise_by(
        df.withColumns(weights)
        .repartitionByRange(*[c(k) for k in keys], *order)
        .withColumn("__part", F.spark_partition_id()),
        "__part",
    )
    # the part of a row is fixed by the table just written, which has each part in one bucket:
    # neither the sums per (key, part) nor the window below shuffle its rows again. Only keys that
    # reach into a later part carry anything, at most one per part, which bounds the broadcast
    along = Window.partitionBy(*[c(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    before = along.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranged.groupBy("__part", *[c(k) for k in keys])
        .agg(*[F.sum(w).alias(w) for w in weights])
        .select(
            F.col("__part").alias("__cpart"),
            *[c(k).alias(f"__ckey{i}") for i, k in enumerate(keys)],
            *[F.sum(w).over(before).alias(f"__c{w}") for w in weights],
            F.count(F.lit(1)).over(before).alias("__cn"),
        )
        .where(F.col("__cn") > 0)
    )
    within = (
        Window.partitionBy("__part", *[c(k) for k in keys])
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.select(
        *[c(n) for n in df.columns],
        "__part",
        *[F.sum(w).over(within).alias(w) for w in weights],
    )
    meets = all_of(
        [F.col("__part") == F.col("__cpart")]
        + [c(k).eqNullSafe(F.col(f"__ckey{i}")) for i, k in enumerate(keys)]
    )
    joined = local.join(F.broadcast(carried), meets, "left")
    sums = [
        (F.col(w) + F.coalesce(F.col(f"__c{w}"), F.lit(0))).alias(name)
        for name, w in zip(totals, weights)
    ]
    return joined.select(*[c(n) for n in df.columns], *sums)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "row_number"
) -> DataFrame:
    """1-based row number within each key, for keys of any size."""
    tie = df.withColumn("__tie", F.monotonically_increasing_id())
    return running_total(tie, {name: F.lit(1)}, [*order, F.col("__tie")], keys).drop("__tie")


def _without_nan(df: DataFrame, value: str) -> DataFrame:
    """NaN is a missing value, not the largest one."""
    if dict(df.dtypes)[value] not in ("double", "float"):
        return df
    return df.withColumn(value, F.when(~F.isnan(c(value)), c(value)))


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value within each key, as ``n``; null and NaN are no values."""
    return (
        _without_nan(df, value).where(c(value).isNotNull())
        .groupBy(*[c(k) for k in keys], c(value))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Mapping[str, float],
    keys: Sequence[str] = (),
    approximate: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles per key, one named column each, and ``n`` values.

    Exact by default, without ordering or holding a group's values. A sketch brackets the
    wanted positions; in one more scan the values inside the brackets are counted per
    distinct value and all others per gap between brackets, so exact ranks are known.
    Groups with too many distinct values left are narrowed further, all at once; a group
    whose bracket missed its position is counted anew, alone. ``approximate`` stops at
    Spark's sketch. Null keys form a group; nulls and NaN are no values; a group without
    values has no row.
    """
    known = _without_nan(df, value).where(c(value).isNotNull())
    if approximate:
        sketch = [
            F.percentile_approx(c(value), p, SKETCH_ACCURACY).cast("double").alias(name)
            for name, p in probabilities.items()
        ]
        return known.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), *sketch)
    ks = [f"__k{i}" for i in range(len(keys))]
    rows = known.select(*[c(k).alias(m) for k, m in zip(keys, ks)], c(value).cast("double").alias("__x"))
    ps = sorted(set(map(float, probabilities.values())))
    gaps = _bracketed(rows, ks, ps)
    picked = _stored_picks(_narrowed(*gaps, ks, ps), ks, ps)
    if not picked.where("__missed").isEmpty():
        # the rows of those groups only; all their values are counted
        lost = _meet(rows, materialise(picked.where("__missed").select(*ks)), ks, "left_semi") if ks else rows
        counts = lost.groupBy(*ks, F.col("__x").alias("__v")).agg(F.count(F.lit(1)).alias("n")).withColumn("__slot", F.lit(0).cast("bigint"))
        redone = _stored_picks(_narrowed(*_stored_counts(counts), ks, ps), ks, ps)
        picked = picked.where("NOT __missed").unionByName(redone)
    at = {p: i for i, p in enumerate(ps)}
    return picked.select(
        *[F.col(m).alias(k) for k, m in zip(keys, ks)],
        F.col("__size").alias("n"),
        *[F.col(f"__q{at[float(p)]}").alias(name) for name, p in probabilities.items()],
    )


def _meet(left: DataFrame, right: DataFrame, ks: Sequence[str], how: str) -> DataFrame:
    """Join on group keys, null to null. ``right`` is a stored table, so its size decides
    whether it is broadcast; else hot groups are split while the query runs."""
    renamed = right.withColumnsRenamed({k: f"{k}r" for k in ks})
    match = all_of([F.col(k).eqNullSafe(F.col(f"{k}r")) for k in ks])
    return left.join(renamed, match, how).drop(*[f"{k}r" for k in ks])


def _stored_counts(counts: DataFrame) -> tuple[DataFrame, int]:
    """Written counts and their number of rows."""
    table = materialise(counts)
    return table, table.count()


def _brackets(ps: Sequence[float]) -> list[float]:
    """Lower and upper end around each position, as shares of the rows."""
    margin = 3.0 / SKETCH_ACCURACY
    return [min(max(p + side, 0.0), 1.0) for p in ps for side in (-margin, margin)]


def _bracketed(rows: DataFrame, ks: Sequence[str], ps: Sequence[float]) -> tuple[DataFrame, int]:
    """Counts (keys, ``__slot``, ``__v``, ``n``) in rank order; ``__v`` is null in gaps.

    ``__slot`` is the number of brackets that end below the value. Brackets of a group
    with few rows are open: a margin of less than a row would miss its position.
    """
    ends = _brackets(ps)
    few = F.count(F.lit(1)) <= 2 * SKETCH_ACCURACY
    sketch = materialise(
        rows.groupBy(*ks).agg(F.when(~few, F.percentile_approx("__x", ends, SKETCH_ACCURACY)).alias("__ends"))
    )
    x = F.col("__x")
    slot, inside = F.lit(0), F.col("__ends").isNull()
    for i in range(len(ps)):
        low = F.lit(True) if ends[2 * i] <= 0 else x >= F.col("__ends")[2 * i]
        above = F.lit(False) if ends[2 * i + 1] >= 1 else x > F.col("__ends")[2 * i + 1]
        slot = slot + F.when(above, 1).otherwise(0)
        inside = inside | F.coalesce(low & ~above, F.lit(False))
    if ks:
        placed = _meet(rows, sketch, ks, "inner")
    else:
        placed = rows.withColumn("__ends", sketch.select("__ends").scalar())
    counts = (
        placed.select(*ks, slot.cast("bigint").alias("__slot"), F.when(inside, x).alias("__v"))
        .groupBy(*ks, "__slot", "__v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _stored_counts(counts)


def _held(cum: Column, n: Column, size: Column, ps: Sequence[float]) -> list[Column]:
    """Per probability: whether the rows up to ``cum`` hold the rank below and above it."""
    tests = []
    for p in ps:
        position = (size - 1) * F.lit(p)
        tests += [(cum - n <= rank) & (rank < cum) for rank in (F.floor(position), F.ceil(position))]
    return tests


def _narrowed(counts: DataFrame, rows: int, ks: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """Counts with at most ``ENTRIES`` values in any group.

    Groups with more are cut into pieces of about equally many distinct values. A piece
    that holds no wanted rank becomes a gap. Each round leaves a small share of them.
    """
    done = None
    while rows > ENTRIES:
        sizes = counts.groupBy(*ks).agg(
            F.count("__v").alias("__entries"),
            F.sum("n").alias("__size"),
            F.percentile_approx("__v", [i / PIECES for i in range(1, PIECES)], 4 * PIECES).alias("__cuts"),
        )
        wide = materialise(sizes.where(F.col("__entries") > ENTRIES))
        if wide.isEmpty():
            break
        narrow = _meet(counts, wide, ks, "left_anti") if ks else counts.limit(0)
        done = narrow if done is None else done.unionByName(narrow)
        if ks:
            placed = _meet(counts, wide, ks, "inner")
        else:
            one = wide.select(F.struct("__size", "__cuts")).scalar()
            placed = counts.withColumn("__one", one).select("*", "__one.*").drop("__one")
        below = F.size(F.filter("__cuts", lambda cut: cut < F.col("__v")))
        piece = F.when(F.col("__v").isNull(), 0).otherwise(below + 1)
        cut = placed.withColumn("__slot", F.col("__slot") * (PIECES + 2) + piece)
        # a few hundred pieces a group from here on
        along = Window.partitionBy(*ks) if ks else Window.partitionBy(F.lit(0))
        ranked = (
            cut.groupBy(*ks, "__slot")
            .agg(F.sum("n").alias("n"), F.max("__size").alias("__size"))
            .withColumn("__cum", F.sum("n").over(along.orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)))
        )
        wanted = materialise(ranked.where(any_of(_held(F.col("__cum"), F.col("n"), F.col("__size"), ps))).select(*ks, "__slot"))
        marked = _meet(cut, wanted.withColumn("__kept", F.lit(True)), [*ks, "__slot"], "left")
        kept = F.when(F.col("__kept"), F.col("__v")).alias("__v")
        merged = marked.select(*ks, "__slot", kept, "n").groupBy(*ks, "__slot", "__v").agg(F.sum("n").alias("n"))
        counts, rows = _stored_counts(merged)
    return counts if done is None else done.unionByName(counts)


def _stored_picks(counts: DataFrame, ks: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """One row per group: ``__size``, a quantile each, and whether a rank lies in a gap."""
    # at most ENTRIES values and as many gaps as positions in a group
    own = Window.partitionBy(*ks) if ks else Window.partitionBy(F.lit(0))
    order = own.orderBy("__slot", F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    along = counts.select("*", F.sum("n").over(order).alias("__cum"), F.sum("n").over(own).alias("__size"))
    tests = _held(F.col("__cum"), F.col("n"), F.col("__size"), ps)
    gathered = along.groupBy(*ks).agg(
        F.max("__size").alias("__size"),
        F.coalesce(F.bool_or(any_of(tests) & F.col("__v").isNull()), F.lit(False)).alias("__missed"),
        *[F.max(F.when(test, F.col("__v"))).alias(f"__t{i}") for i, test in enumerate(tests)],
    )
    quantile = []
    for i, p in enumerate(ps):
        low, high, position = F.col(f"__t{2 * i}"), F.col(f"__t{2 * i + 1}"), (F.col("__size") - 1) * F.lit(p)
        between = F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position)))
        quantile.append(between.alias(f"__q{i}"))
    return materialise(gathered.where(F.col("__size").isNotNull()).select(*ks, "__size", "__missed", *quantile))


def average_rank(
    df: DataFrame, value: str, keys: Sequence[str] = (), descending: bool = True,
    name: str = "rank",
) -> DataFrame:
    """Rank of every row with ties sharing their mean rank; null values rank null."""
    order = c(value).desc() if descending else c(value).asc()
    ranked = running_total(value_counts(df, value, keys), {"__cum": F.col("n")}, [order], keys)
    ranked = ranked.select(
        *[c(k) for k in keys],
        c(value),
        (F.col("__cum") - (F.col("n") - 1) / 2).alias(name),
    )
    return lookup_join(df, ranked, [*keys, value], "left").select(
        *[c(n) for n in df.columns], c(name)
    )


def lagged(
    df: DataFrame, value: str, periods: int, keys: Sequence[str], order: Sequence[Column],
    name: str,
) -> DataFrame:
    """Value of the row ``periods`` places earlier within the key."""
    rows = materialise(numbered(df, keys, order, "__row"))
    earlier = rows.select(
        *[c(k) for k in keys],
        (F.col("__row") + periods).alias("__row"),
        c(value).alias(name),
    )
    # (key, row number) is unique on both sides, so no key is hot here
    return rows.join(earlier, [*keys, "__row"], "left").select(
        *[c(n) for n in df.columns], c(name)
    )
