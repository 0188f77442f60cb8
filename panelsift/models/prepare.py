"""Feature preparation: encoding, numeric form, variance filter, scaling, folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsift.columns import c, existing
from panelsift.functions.onehot import MISSING, one_hot_flags, vocabularies
from panelsift.operators.ordered import numbered, quantiles
from panelsift.operators.profile import long_metrics
from panelsift.operators.skew import lookup_join
from panelsift.session import materialise


@dataclass
class Scaler:
    """Shift and width per column; a column without spread keeps width 1."""

    method: str
    shift: dict[str, float]
    width: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {n: (c(n) - F.lit(s)) / F.lit(self.width[n]) for n, s in self.shift.items()}
        return df.withColumns(scaled)


def _number(name: str) -> Column:
    return F.nanvl(c(name).cast("double"), F.lit(None).cast("double"))


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "standard") -> Scaler:
    """Fit from one aggregate; missing values are left out."""
    if method == "robust":
        cuts = {"low": 0.25, "mid": 0.5, "high": 0.75}
        rows = quantiles(long_metrics(df, columns), "value", cuts, ["metric"]).collect()
        shift = {r.metric: r.mid for r in rows}
        width = {r.metric: r.high - r.low for r in rows}
    elif method in ("standard", "minmax"):
        pairs = {
            "standard": lambda x: (F.avg(x), F.stddev_pop(x)),
            "minmax": lambda x: (F.min(x), F.max(x) - F.min(x)),
        }
        row = df.agg(*[part for n in columns for part in pairs[method](_number(n))]).first()
        shift = {n: row[2 * i] for i, n in enumerate(columns)}
        width = {n: row[2 * i + 1] for i, n in enumerate(columns)}
    else:
        raise ValueError(f"unknown scaling method {method!r}")
    return Scaler(
        method,
        {n: shift.get(n) or 0.0 for n in columns},
        {n: width.get(n) or 1.0 for n in columns},
    )


def scale_features(
    df: DataFrame, columns: Sequence[str], method: str = "standard", scaler: Scaler | None = None
) -> tuple[DataFrame, Scaler]:
    """Scaled columns and the scaler; pass a fitted scaler to reuse it."""
    fitted = scaler or fit_scaler(df, columns, method)
    return fitted.transform(df), fitted


def _text(df: DataFrame, name: str) -> Column:
    text = c(name).cast("string")
    if isinstance(df.schema[name].dataType, T.BooleanType):
        text = F.initcap(text)
    return F.coalesce(text, F.lit(MISSING))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Each distinct text of a column with its place in sorted order, from 0.

    Numbered across partitions, so a column may have any number of values.
    """
    values = df.select(_text(df, column).alias("value")).distinct()
    coded = numbered(values, [], [F.col("value")], "code")
    return coded.select("value", (F.col("code") - 1).cast("int").alias("code"))


def encode_categorical(
    df: DataFrame, columns: Sequence[str], method: str = "label"
) -> tuple[DataFrame, dict[str, object]]:
    """Label codes in place, or 0/1 columns instead of the originals."""
    names = existing(df, columns)
    encoders: dict[str, object] = {}
    if method == "label":
        for name in names:
            codes = label_codes(df, name)
            encoders[name] = codes
            keyed = df.withColumn("value", _text(df, name)).drop(c(name))
            joined = lookup_join(keyed, codes.withColumnRenamed("code", name), ["value"])
            df = joined.select(*[c(n) for n in df.columns])
        return df, encoders
    if method != "onehot":
        raise ValueError(f"unknown encoding method {method!r}")
    texts = df.withColumns({n: F.when(c(n).isNotNull(), _text(df, n)) for n in names})
    words = vocabularies(texts, dict.fromkeys(names, False)) if names else {}
    flags: dict[str, Column] = {}
    for name in names:
        encoders[name] = "onehot"
        flags.update(one_hot_flags(texts, name, words[name], f"{name}_", False))
    kept = [c(n) for n in df.columns if n not in names]
    return texts.select(*kept, *[f.alias(n) for n, f in flags.items()]), encoders


@dataclass
class Prepared:
    """Scaled features (and the target), with what is needed to repeat it."""

    data: DataFrame
    feature_names: list[str]
    scaler: Scaler
    encoders: dict[str, object] = field(default_factory=dict)
    variance_threshold: float = 0.01


def prepare_features_for_modeling(
    df: DataFrame,
    feature_cols: Sequence[str],
    target_col: str | None = None,
    categorical_cols: Sequence[str] | None = None,
    scaling_method: str = "standard",
    encoding_method: str = "label",
    remove_low_variance: bool = True,
    variance_threshold: float = 0.01,
    keep_cols: Sequence[str] = (),
) -> Prepared:
    """Select, encode, make numeric, drop near-constant columns, scale."""
    features = existing(df, feature_cols)
    kept = existing(df, [*keep_cols, *([target_col] if target_col else [])])
    carried = {n: f"__keep{i}" for i, n in enumerate(kept)}
    rows = df.select(
        *[c(n) for n in features], *[c(n).alias(tmp) for n, tmp in carried.items()]
    )
    encoders: dict[str, object] = {}
    cats = [n for n in categorical_cols or () if n in features]
    if cats:
        rows, encoders = encode_categorical(rows, cats, encoding_method)
    names = [n for n in rows.columns if n not in carried.values()]
    kinds = dict(rows.dtypes)
    numeric = {
        n: (c(n).try_cast("double") if kinds[n] == "string" else c(n).cast("double"))
        for n in names
    }
    rows = rows.withColumns({n: F.nanvl(v, F.lit(None).cast("double")) for n, v in numeric.items()})
    if remove_low_variance and names:
        spread = rows.agg(*[F.var_samp(c(n)) for n in names]).first()
        names = [n for n, v in zip(names, spread) if v is not None and v >= variance_threshold]
    scaled, scaler = scale_features(rows, names, scaling_method)
    data = scaled.select(
        *[c(tmp).alias(n) for n, tmp in carried.items() if n not in names],
        *[c(n) for n in names],
    )
    return Prepared(data, names, scaler, encoders, variance_threshold)


def analyze_feature_scaling_needs(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Kind of each feature, its range and whether scaling is advised."""
    long = long_metrics(df, existing(df, feature_cols))
    moments = long.groupBy("metric").agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.count_if(~F.col("value").isin(0.0, 1.0)).alias("others"),
    )
    distinct = long.distinct().groupBy("metric").agg(F.count(F.lit(1)).alias("unique_values"))
    kind = (
        F.when(F.col("others") == 0, "binary")
        .when(F.col("unique_values") <= 10, "categorical/ordinal")
        .otherwise("continuous")
    )
    wide = (F.col("std") > 10) | (F.abs("mean") > 100)
    return moments.join(distinct, "metric").select(
        F.col("metric").alias("feature"),
        kind.alias("type"),
        "unique_values",
        "min",
        "max",
        F.round("mean", 4).alias("mean"),
        F.round("std", 4).alias("std"),
        ((kind == "continuous") & wide).alias("scaling_recommended"),
    )


def filter_rare_features(
    df: DataFrame, features: Sequence[str], min_prevalence: float = 0.01
) -> tuple[list[str], list[tuple[str, float]]]:
    """Features whose mean lies in [m, 1 - m], and the others with their mean."""
    shares = df.agg(*[F.avg(c(n)) for n in features]).first()
    valid, rare = [], []
    for name, share in zip(features, shares):
        if share is not None and min_prevalence <= share <= 1 - min_prevalence:
            valid.append(name)
        else:
            rare.append((name, share))
    return valid, rare


def group_fold(user: str, folds: int) -> Column:
    """Fold of a row by hash alone; all rows of a user share it, sizes are left to chance."""
    return F.pmod(F.xxhash64(c(user)), F.lit(folds)).cast("int")


def balanced_folds(df: DataFrame, user: str, folds: int) -> DataFrame:
    """(user, fold) for every known user, with fold sizes as even as whole users allow.

    Users are dealt from the most rows to the fewest. Of those with equally many rows
    each fold gets the same number, in hash order; the few left over go to the lightest
    folds one by one, so no two folds differ by more than the largest user has rows. Only
    the distinct sizes are gathered, of which N rows have at most the root of 2 N.
    """
    users = materialise(
        df.where(c(user).isNotNull())
        .groupBy(c(user).alias("__user"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__place", F.xxhash64("__user"))
    )
    ranked = numbered(users, ["__n"], [F.col("__place"), F.col("__user")], "__rank")
    load, dealt = [0] * folds, []
    for r in users.groupBy("__n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.col("__n").desc()).collect():
        rest = []
        for _ in range(r.m % folds):
            rest.append(load.index(min(load)))
            load[rest[-1]] += r["__n"]
        dealt.append((r["__n"], r.m - r.m % folds, rest))
    # one row per distinct size
    table = F.broadcast(df.sparkSession.createDataFrame(dealt, "__n bigint, __even bigint, __rest array<int>"))
    evenly = F.pmod(F.col("__rank") - 1, F.lit(folds)).cast("int")
    left_over = F.get("__rest", (F.col("__rank") - F.col("__even") - 1).cast("int"))
    fold = F.when(F.col("__rank") <= F.col("__even"), evenly).otherwise(left_over)
    return ranked.join(table, "__n").select(F.col("__user").alias(user), fold.alias("fold"))


def with_group_folds(df: DataFrame, user: str, folds: int, name: str = "fold") -> DataFrame:
    """Rows with their user's balanced fold; rows without a user have none."""
    table = materialise(balanced_folds(df, user, folds)).withColumnRenamed("fold", name)
    return lookup_join(df, table, [user], "left").select(*[c(n) for n in df.columns], name)


def holdout(key: Sequence[str], share: float, seed: int = 42) -> Column:
    """True for a reproducible share of the keys."""
    bucket = F.pmod(F.xxhash64(*[c(k) for k in key], F.lit(seed)), F.lit(1_000_000))
    return bucket < int(share * 1_000_000)
