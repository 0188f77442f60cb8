"""Joins that stay balanced when one key owns a large part of the rows.

Keys with more rows than one task should take are looked up first, from mergeable
sketches of the most frequent keys that every task fills over its own rows. Mostly there
are none and the join is a plain one. Otherwise the rows of those keys are dealt over
several salts and the matching rows of the other side repeated per salt.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsift.columns import all_of, c

ROWS_PER_TASK = 2_000_000
# A sketch per part of the keys' hash space, and the keys each of them keeps track of. Of n
# rows, no key with more than 2 * 3.5 * n / (PARTS * TRACKED) is missed: 1/150 000 of them.
PARTS = 64
TRACKED = 16_384
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024


@dataclass
class HotKeys:
    """Keys to spread, with the number of tasks for each. A hint: never affects results."""

    rows: list[tuple]
    types: list[T.DataType]

    def frame(self, spark, names: Sequence[str]) -> DataFrame:
        fields = [T.StructField(n, t) for n, t in zip(names, self.types)]
        schema = T.StructType([*fields, T.StructField("__salts", T.IntegerType())])
        return spark.createDataFrame(self.rows, schema)


def find_hot_keys(
    df: DataFrame, keys: Sequence[str], rows_per_task: int | None = None
) -> HotKeys:
    """Look for hot keys, null among them; see :func:`find_hot_key_sets`."""
    return find_hot_key_sets(df, [keys], rows_per_task)[0]


def find_hot_key_sets(
    df: DataFrame, key_sets: Sequence[Sequence[str]], rows_per_task: int | None = None
) -> list[HotKeys]:
    """Hot keys of several sets of key columns, all from one pass over narrow hashes.

    A task sends at most PARTS sketches a set, whatever number of keys it met. Only sets
    in which something is hot are read again, to count those few keys exactly. There are
    no more of them than rows / ``rows_per_task``, which bounds what the driver gets.
    Look on a stored table where possible and pass the result to several joins on the same
    keys, so that a derived frame is not computed just for this.
    """
    limit = rows_per_task or ROWS_PER_TASK
    hashes = [F.xxhash64(*[c(k) for k in keys]) for keys in key_sets]
    hashed = [F.struct(F.lit(i).alias("set"), h.alias("hash")) for i, h in enumerate(hashes)]
    frequent = (
        df.select(F.inline(F.array(*hashed)))
        .groupBy("set", F.pmod("hash", F.lit(PARTS)))
        .agg(F.expr(f"approx_top_k(hash, {TRACKED}, {TRACKED})").alias("__top"))
        .select("set", F.inline("__top"))
        .where(F.col("count") > limit)
        .select("set", F.col("item").alias("__hash"))
        .collect()
    )
    found = []
    for i, keys in enumerate(key_sets):
        types = [df.schema[k].dataType for k in keys]
        hot = [(r["__hash"],) for r in frequent if r["set"] == i]
        rows = []
        if hot:
            # at most rows / limit of them
            listed = F.broadcast(df.sparkSession.createDataFrame(hot, "__hash bigint"))
            counts = (
                df.select(*[c(k) for k in keys], hashes[i].alias("__hash"))
                .join(listed, "__hash", "left_semi")
                .groupBy(*[c(k) for k in keys])
                .agg(F.count(F.lit(1)).alias("__n"))
                .where(F.col("__n") > limit)
                .orderBy(F.col("__n").desc())
            )
            rows = [(*r[:-1], -(-r[-1] // limit)) for r in counts.collect()]
        found.append(HotKeys(rows, types))
    return found


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot: HotKeys | None = None,
) -> DataFrame:
    """``big`` joined to ``small`` on equally named keys, hot keys spread out.

    The salt comes from the task a row is read in, so it does not change when that
    task is run again, and identical copies are spread as well.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    if hot is None:
        hot = find_hot_keys(big, keys)
    if not hot.rows:
        return big.join(small, list(keys), how)
    hot_names = [f"__hot{i}" for i in range(len(keys))]
    # at most rows / rows_per_task of them
    table = F.broadcast(hot.frame(big.sparkSession, hot_names))
    match = all_of([c(k).eqNullSafe(F.col(h)) for k, h in zip(keys, hot_names)])
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    spread = (
        big.join(table, match, "left")
        .withColumn("__salt", F.pmod(F.spark_partition_id(), salts))
        .drop("__salts", *hot_names)
    )
    repeated = (
        small.join(table, match, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("__salts", *hot_names)
    )
    return spread.join(repeated, [*keys, "__salt"], how).drop("__salt")


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether a frame's counted rows and measured text size allow a broadcast.

    The size is measured only for frames that have few rows.
    """
    if df.count() > max_rows:
        return False
    size = F.octet_length(F.to_json(F.struct(*[c(n) for n in df.columns])))
    return (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Join to a dictionary-like side: broadcast when measured small, else salted."""
    if fits_broadcast(small):
        return big.join(F.broadcast(small), list(keys), how)
    return salted_join(big, small, keys, how, hot)


def attach_per_key(
    df: DataFrame, keys: Sequence[str], *aggregates, hot: HotKeys | None = None
) -> DataFrame:
    """Add per-key aggregates to every row of the key.

    Replaces an unordered window function: the aggregate is combined before the
    shuffle and the join back is salted, so no task holds all rows of one key.
    Null keys form a group of their own, as they do in a window.
    """
    per_key = df.groupBy(*[c(k) for k in keys]).agg(*aggregates)
    if hot is None:
        hot = find_hot_keys(df, keys)
    return attach_facts(df, keys, per_key, hot)


def attach_facts(df: DataFrame, keys: Sequence[str], per_key: DataFrame, hot: HotKeys) -> DataFrame:
    """Add the columns of a table with one row per key, null a key like any other."""
    new = [n for n in per_key.columns if n not in keys]
    marked = [f"__key{i}" for i in range(len(keys))]

    def tagged(frame: DataFrame) -> DataFrame:
        # null keys must meet their own group, which plain equality never does
        return frame.withColumns({m: F.struct(c(k).isNull(), c(k)) for m, k in zip(marked, keys)})

    right = tagged(per_key).select(*marked, *[c(n) for n in new])
    left = tagged(df)
    pairs = [tuple((k is None, k) for k in row[:-1]) + (row[-1],) for row in hot.rows]
    spread = HotKeys(pairs, [left.schema[m].dataType for m in marked])
    joined = salted_join(left, right, marked, "left", spread)
    return joined.select(*[c(n) for n in df.columns], *[c(n) for n in new])
