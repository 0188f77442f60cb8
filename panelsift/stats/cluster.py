"""One regression per feature with standard errors clustered by user.

Both tests need sums over (feature, user) only. Flags are mostly 0, so a row
contributes one base entry plus an entry for each feature that is not 0 or is
missing; what the zeros add follows from the base entry. One scan and one
map-side combined shuffle serve all features of both tests, and a user with very
many rows shrinks to one partial row per feature and task.

Features of an open vocabulary come from a sparse column and are keyed by name: any
number of them is fitted, and nothing that grows with their number is gathered or sent
to the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsift.columns import c, existing
from panelsift.functions.sparse import only, requested
from panelsift.operators.profile import sparse_entries
from panelsift.session import materialise
from panelsift.stats.effects import Z_95, cohens_d_label, normal_p_value, odds_ratio_label

MIN_ROWS = 30
BASE = -1
NEWTON_STEPS = 100
NEWTON_TOLERANCE = 1e-8
# a feature this many ranges away from 0 is moved before it is squared
OFFSET = 100.0

OLS_COLUMNS = (
    "feature", "mean_with_feature", "mean_without_feature", "mean_difference", "t_statistic",
    "p_value", "significant", "se_cluster_robust", "cohens_d", "effect_size_interpretation",
)
LOGIT_COLUMNS = (
    "feature", "log_odds_coef", "odds_ratio", "or_ci_lower", "or_ci_upper", "z_statistic",
    "p_value", "se_cluster_robust", "significant", "prop_outcome_with_feature",
    "prop_outcome_without_feature", "prop_difference", "pseudo_r2",
    "effect_size_interpretation", "n_obs",
)


class ClusterSums:
    """Per (feature, user) sums of one frame, kept for both tests."""

    def __init__(
        self,
        df: DataFrame,
        features: Sequence[str],
        outcome: str = "wonky_study_count",
        user: str = "respondentPk",
        binarize: bool = True,
        sparse: str | None = None,
    ):
        self.features, self.sparse = existing(df, features), sparse
        #: type and base entry of ``i``: the position of a column, or any feature's name
        self.key, self.base = ("int", F.lit(BASE)) if sparse is None else ("string", F.lit(""))
        self.df, self.user = self._near_zero(df), user
        y = F.coalesce(c(outcome).cast("double"), F.lit(0.0))
        self.y = y
        self.positive = F.when(y > 0, 1.0).otherwise(0.0) if binarize else y
        self.sums = materialise(self._summed()) if self.features or sparse else None

    def _near_zero(self, df: DataFrame) -> DataFrame:
        """Features whose offset dwarfs their range, moved to the middle of it.

        Slopes and errors do not change; sums of squares keep their digits.
        """
        if not self.features:
            return df
        ends = df.agg(*[f(self.value(name)) for name in self.features for f in (F.min, F.max)]).first()
        moved = {}
        for k, name in enumerate(self.features):
            low, high = ends[2 * k], ends[2 * k + 1]
            if low is not None and max(low, -high) > max(1.0, OFFSET * (high - low)):
                moved[name] = self.value(name) - F.lit((low + high) / 2)
        return df.withColumns(moved) if moved else df

    def value(self, feature: str) -> Column:
        return F.nanvl(c(feature).cast("double"), F.lit(None).cast("double"))

    def name(self, index: Column) -> Column:
        if self.sparse is not None:
            return index
        return F.element_at(F.array(*[F.lit(f) for f in self.features]), index + 1)

    @property
    def at_base(self) -> Column:
        return F.col("i") == self.base

    def key_of(self, position: int) -> object:
        return position if self.sparse is None else self.features[position]

    def entries(self) -> DataFrame:
        """User, outcome and (``i``, ``x``) of each row's base and non-zero features."""
        return self.df.where(c(self.user).isNotNull()).select(
            c(self.user).alias("u"),
            self.y.alias("y"),
            self.positive.alias("b"),
            F.inline(sparse_entries(self.features, self.sparse)),
        )

    def _summed(self) -> DataFrame:
        long = self.entries()
        x, y, b = F.col("x"), F.col("y"), F.col("b")
        per_user = long.groupBy("i", "u").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(y).alias("sy"),
            F.sum(y * y).alias("syy"),
            F.sum(b).alias("sb"),
            F.count_if(x.isNull()).alias("m"),
            *[
                F.coalesce(F.sum(F.when(x.isNull(), v)), F.lit(0.0)).alias(n)
                for n, v in (("my", y), ("myy", y * y), ("mb", b))
            ],
            *[
                F.coalesce(F.sum(v), F.lit(0.0)).alias(n)
                for n, v in (("sx", x), ("sxx", x * x), ("sxy", x * y), ("sxb", x * b))
            ],
            F.count_if(x == 1).alias("n1"),
            *[
                F.coalesce(F.sum(F.when(x == 1, v)), F.lit(0.0)).alias(n)
                for n, v in (("sy1", y), ("sb1", b))
            ],
            F.min(x).alias("lo"),
            F.max(x).alias("hi"),
        )
        if self.sparse is not None:  # users may have any number of features
            stored = materialise(per_user)
            base = stored.where(self.at_base).select("u", *[c(n).alias(f"u_{n}") for n in ("n", "sy", "sb")])
            return stored.join(base, "u")
        # a user has at most one row per column here, so this window stays small
        own = Window.partitionBy("u")
        base = {f"u_{n}": F.max(F.when(self.at_base, c(n))).over(own) for n in ("n", "sy", "sb")}
        return per_user.withColumns(base)

    def overall(self) -> Column:
        """Struct of whole-frame totals, as a scalar subquery of one row."""
        base = self.sums.where(self.at_base)
        n, sy, sb = F.sum("n"), F.sum("sy"), F.sum("sb")
        sums = base.agg(
            n.alias("n"), sy.alias("sy"), F.sum("syy").alias("syy"), sb.alias("sb"),
            F.count(F.lit(1)).alias("g"), (sy / n).alias("ybar"), (sb / n).alias("bbar"),
        )
        return sums.select(F.struct(*sums.columns)).scalar()

    def squares(self) -> Column:
        """Struct of second moments of the users' centred outcome sums and row counts."""
        base = self.sums.where(self.at_base).withColumn("all", self.overall())
        r = F.col("sy") - F.col("all.ybar") * F.col("n")
        s = F.col("sb") - F.col("all.bbar") * F.col("n")
        n = F.col("n").cast("double")
        sums = base.agg(
            F.sum(n * n).alias("nn"), F.sum(r * n).alias("rn"), F.sum(r * r).alias("rr"),
            F.sum(s * n).alias("sn"), F.sum(s * s).alias("ss"),
        )
        return sums.select(F.struct(*sums.columns)).scalar()

    def totals(self) -> DataFrame:
        """One row per feature: complete-case totals."""
        summed = ("m", "my", "myy", "mb", "sx", "sxx", "sxy", "sxb", "n1", "sy1", "sb1")
        per = (
            self.sums.where(~self.at_base)
            .groupBy("i")
            .agg(
                *[F.sum(c(n)).alias(n) for n in summed],
                F.sum(F.col("n") - F.col("m")).alias("nonzero"),
                F.count_if(F.col("m") == F.col("u_n")).alias("lost_users"),
                F.min("lo").alias("lo"),
                F.max("hi").alias("hi"),
            )
            .withColumn("all", self.overall())
        )
        size = (F.col("all.n") - F.col("m")).cast("double")
        varied = (F.col("nonzero") > 0) & (
            (F.col("nonzero") < size) | (F.col("lo") != F.col("hi"))
        )
        return per.select(
            "i", "all", "sx", "sxx", "sxy", "sxb", "n1", "sy1", "sb1",
            size.alias("n"),
            (F.col("all.g") - F.col("lost_users")).alias("g"),
            (F.col("all.sy") - F.col("my")).alias("sy"),
            (F.col("all.syy") - F.col("myy")).alias("syy"),
            (F.col("all.sb") - F.col("mb")).alias("sb"),
            ((F.col("lo") == 1) & (F.col("hi") == 1)).alias("binary"),
        ).where((F.col("n") >= MIN_ROWS) & varied)

    def with_coefficients(self, coefficients: DataFrame) -> DataFrame:
        """(feature, user) sums next to their feature's row."""
        return self.sums.join(self.per_feature(coefficients.select("i", F.struct("*").alias("f"))), "i")

    def per_feature(self, table: DataFrame) -> DataFrame:
        """One row per feature: sent to the tasks if these are columns, else joined by key."""
        return F.broadcast(table) if self.sparse is None else table


def _correction(n: Column, g: Column) -> Column:
    """Small-sample factor of the clustered covariance with two parameters."""
    return F.try_divide(g, g - 1) * F.try_divide(n - 1, n - 2)


def ols_results(sums: ClusterSums, significance_level: float = 0.05) -> DataFrame:
    """Clustered OLS per feature; outcome sums are centred to keep digits."""
    t = sums.totals()
    n, sx, sxx = F.col("n"), F.col("sx"), F.col("sxx")
    ybar = F.col("all.ybar")
    sy, sxy = F.col("sy") - ybar * n, F.col("sxy") - ybar * sx
    det = n * sxx - sx * sx
    slope = F.try_divide(n * sxy - sx * sy, det)
    fitted = t.withColumn("det", det).withColumn("slope", slope)
    fitted = fitted.withColumn("level", (sy - F.col("slope") * sx) / n)

    f = lambda name: F.col(f"f.{name}")
    joined = sums.with_coefficients(fitted)
    ybar_f = F.col("f.all.ybar")
    rows = F.col("u_n") - F.col("m")
    residual = (F.col("u_sy") - F.col("my")) - ybar_f * rows
    s0 = residual - f("level") * rows - f("slope") * F.col("sx")
    s1 = (F.col("sxy") - ybar_f * F.col("sx")) - f("level") * F.col("sx") - f("slope") * F.col("sxx")
    zero = F.col("u_sy") - ybar_f * F.col("u_n") - f("level") * F.col("u_n")
    scores = joined.select("i", s0.alias("s0"), s1.alias("s1"), zero.alias("z"))
    meat = scores.groupBy("i").agg(
        F.sum(F.col("s0") * F.col("s0") - F.col("z") * F.col("z")).alias("d00"),
        F.sum(F.col("s0") * F.col("s1")).alias("m01"),
        F.sum(F.col("s1") * F.col("s1")).alias("m11"),
    )
    done = fitted.join(sums.per_feature(meat), "i").withColumn("q", sums.squares())
    level = F.col("level")
    m00 = F.col("q.rr") - 2 * level * F.col("q.rn") + level * level * F.col("q.nn") + F.col("d00")
    w0, w1 = F.try_divide(-F.col("sx"), F.col("det")), F.try_divide(F.col("n"), F.col("det"))
    variance = w0 * w0 * m00 + 2 * w0 * w1 * F.col("m01") + w1 * w1 * F.col("m11")
    done = done.withColumn("se", F.sqrt(_correction(F.col("n"), F.col("g")) * variance))
    spread = F.sqrt((F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")) / (F.col("n") - 1))
    done = done.withColumn("t", F.try_divide(F.col("slope"), F.col("se"))).withColumn(
        "d", F.when(spread > 0, F.try_divide(F.col("slope"), spread))
    )
    # a feature known for one user has no clustered error and no result
    done = done.where(F.col("se").isNotNull()).withColumn("p", normal_p_value("t"))
    return done.select(
        sums.name(F.col("i")).alias("feature"),
        F.try_divide(F.col("sy1"), F.col("n1")).alias("mean_with_feature"),
        F.try_divide(F.col("sy") - F.col("sy1"), F.col("n") - F.col("n1")).alias("mean_without_feature"),
        F.col("slope").alias("mean_difference"),
        F.col("t").alias("t_statistic"),
        F.col("p").alias("p_value"),
        F.coalesce(F.col("p") < significance_level, F.lit(False)).alias("significant"),
        F.col("se").alias("se_cluster_robust"),
        F.col("d").alias("cohens_d"),
        cohens_d_label(F.col("d")).alias("effect_size_interpretation"),
    ).orderBy(F.abs(F.col("t_statistic")).desc_nulls_last(), "feature")


def _information(p: Column) -> Column:
    """Log-likelihood per row of a 0/1 outcome with share p."""
    q = 1 - p
    return p * F.log(p) + q * F.log(q)


def _binary_logit(sums: ClusterSums, totals: DataFrame) -> DataFrame:
    """Closed form for 0/1 features; an empty cell of the 2x2 table gives no row."""
    n0 = F.col("n") - F.col("n1")
    cells = totals.where("binary").withColumns(
        {"n0": n0, "p1": F.try_divide(F.col("sb1"), F.col("n1")),
         "p0": F.try_divide(F.col("sb") - F.col("sb1"), n0)}
    )
    cells = cells.where("p1 > 0 AND p1 < 1 AND p0 > 0 AND p0 < 1").withColumns(
        {"w1": F.col("n1") * F.col("p1") * (1 - F.col("p1")),
         "w0": F.col("n0") * F.col("p0") * (1 - F.col("p0")),
         "coef": F.log(F.col("p1") / (1 - F.col("p1"))) - F.log(F.col("p0") / (1 - F.col("p0")))}
    )
    f = lambda name: F.col(f"f.{name}")
    joined = sums.with_coefficients(cells)
    rows = F.col("u_n") - F.col("m")
    with_x = F.col("sb1") - f("p1") * F.col("n1")
    without = (F.col("u_sb") - F.col("mb") - F.col("sb1")) - f("p0") * (rows - F.col("n1"))
    influence = with_x / f("w1") - without / f("w0")
    zero = (F.col("u_sb") - f("p0") * F.col("u_n")) / f("w0")
    spread = joined.select("i", influence.alias("h"), zero.alias("z")).groupBy("i").agg(
        F.sum(F.col("h") * F.col("h") - F.col("z") * F.col("z")).alias("extra")
    )
    done = cells.join(sums.per_feature(spread), "i").withColumn("q", sums.squares())
    shift = F.col("p0") - F.col("all.bbar")
    everyone = F.col("q.ss") - 2 * shift * F.col("q.sn") + shift * shift * F.col("q.nn")
    variance = everyone / (F.col("w0") * F.col("w0")) + F.col("extra")
    fit = F.col("n1") * _information(F.col("p1")) + F.col("n0") * _information(F.col("p0"))
    return done.select(
        "i", "n", "n1", "sb", "sb1", "coef",
        F.sqrt(_correction(F.col("n"), F.col("g")) * variance).alias("se"),
        fit.alias("loglik"),
    )


def _fit_counts(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """Newton on (x, n, sb) of one feature; no row if it does not settle (separated)."""
    n, sb, width = (cells[k].to_numpy(float) for k in ("n", "sb", "width"))
    x = cells["x"].to_numpy(float) / width
    beta = np.zeros(2)
    names = ["i", "a", "s", "h00", "h01", "h11", "loglik"]
    for _ in range(NEWTON_STEPS):
        with np.errstate(all="ignore"):
            p = 1 / (1 + np.exp(-(beta[0] + beta[1] * x)))
        w, off = n * p * (1 - p), sb - n * p
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]])
        det = h[0, 0] * h[1, 1] - h[0, 1] ** 2
        if not det > 1e-12 * max(h[0, 0], 1e-300) ** 2:
            break
        g = np.array([off.sum(), (off * x).sum()])
        step = np.array([h[1, 1] * g[0] - h[0, 1] * g[1], h[0, 0] * g[1] - h[0, 1] * g[0]]) / det
        beta = beta + step
        if np.abs(beta).max() > 500:
            break
        if np.abs(step).max() < NEWTON_TOLERANCE:
            p = 1 / (1 + np.exp(-(beta[0] + beta[1] * x)))
            w = n * p * (1 - p)
            fit = (sb * np.log(p) + (n - sb) * np.log1p(-p)).sum()
            u = cells["x"].to_numpy(float)
            row = [key[0], beta[0], beta[1] / width[0], w.sum(), (w * u).sum(), (w * u * u).sum(), fit]
            return pd.DataFrame([row], columns=names)
    return pd.DataFrame(columns=names)


def _counted_logit(sums: ClusterSums, totals: DataFrame) -> DataFrame:
    """Newton for features of the sparse column that are not just 0 and 1.

    Such values are numbers of occurrences, so a feature has few distinct ones: its
    counts per value make one small group, and all features are fitted in one job. Zeros
    are what is left of the totals.
    """
    others = totals.where(~F.col("binary") & ~F.col("i").isin(sums.features))
    width = F.sqrt(F.greatest(F.col("sxx") / F.col("n") - (F.col("sx") / F.col("n")) ** 2, F.lit(0.0)))
    fitted = others.withColumn("width", F.when(width > 0, width).otherwise(1.0))
    listed = sums.entries().where(~sums.at_base & F.col("x").isNotNull())
    per_user = materialise(
        listed.join(fitted.select("i"), "i", "left_semi")
        .groupBy("i", "x", "u")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("sb"))
    )
    counts = per_user.groupBy("i", "x").agg(F.sum("n").cast("double").alias("n"), F.sum("sb").alias("sb"))
    some = counts.groupBy("i").agg(F.sum("n").alias("some"), F.sum("sb").alias("some_b"))
    zeros = fitted.join(some, "i").select(
        "i", F.lit(0.0).alias("x"), (F.col("n") - F.col("some")).alias("n"), (F.col("sb") - F.col("some_b")).alias("sb")
    )
    cells = counts.unionByName(zeros.where("n > 0")).join(fitted.select("i", "width"), "i")
    fit = cells.groupBy("i").applyInPandas(
        _fit_counts, "i string, a double, s double, h00 double, h01 double, h11 double, loglik double"
    )
    done = materialise(fitted.join(fit, "i"))
    p = 1 / (1 + F.exp(-(F.col("a") + F.col("s") * F.col("x"))))
    sure = done.select("i", "a", "s")
    expected = per_user.join(sure, "i").groupBy("i", "u").agg(
        F.sum(F.col("n") * p).alias("e0"), F.sum(F.col("n") * p * F.col("x")).alias("e1")
    )
    p0 = 1 / (1 + F.exp(-F.col("a")))
    known = sums.sums.join(sure.select("i", p0.alias("p0")), "i").join(expected, ["i", "u"], "left")
    zero_rows = F.col("u_n") - F.col("n")  # of the entries some may be missing values
    s0 = (F.col("u_sb") - F.col("mb")) - F.coalesce("e0", F.lit(0.0)) - F.col("p0") * zero_rows
    s1 = F.col("sxb") - F.coalesce("e1", F.lit(0.0))
    z = F.col("u_sb") - F.col("p0") * F.col("u_n")
    spread = known.select("i", s0.alias("s0"), s1.alias("s1"), z.alias("z")).groupBy("i").agg(
        F.sum(F.col("s0") * F.col("s0") - F.col("z") * F.col("z")).alias("extra"),
        F.sum(F.col("s0") * F.col("s1")).alias("m01"),
        F.sum(F.col("s1") * F.col("s1")).alias("m11"),
    )
    done = done.join(spread, "i").withColumn("q", sums.squares())
    shift = p0 - F.col("all.bbar")
    m00 = F.col("q.ss") - 2 * shift * F.col("q.sn") + shift * shift * F.col("q.nn") + F.col("extra")
    det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
    w0, w1 = F.try_divide(-F.col("h01"), det), F.try_divide(F.col("h00"), det)
    variance = w0 * w0 * m00 + 2 * w0 * w1 * F.col("m01") + w1 * w1 * F.col("m11")
    return done.select(
        "i", "n", "n1", "sb", "sb1", F.col("s").alias("coef"),
        F.sqrt(_correction(F.col("n"), F.col("g")) * variance).alias("se"), "loglik",
    )


def _newton_logit(sums: ClusterSums, totals: DataFrame) -> DataFrame | None:
    """Newton for columns with other values, on counts per distinct value.

    Only one row per feature reaches the driver in each step. A feature whose fit
    does not settle (separated outcomes) gives no row.
    """
    spark = totals.sparkSession
    columns = {sums.key_of(k): name for k, name in enumerate(sums.features)}
    numeric = totals.where(~F.col("binary") & F.col("i").isin(list(columns)))
    others = numeric.select("i", "n", "sx", "sxx").collect()  # one row per column
    if not others:
        return None
    scale = {
        r.i: (r.sx / r.n, max((r.sxx / r.n - (r.sx / r.n) ** 2), 0.0) ** 0.5 or 1.0)
        for r in others
    }
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                ((sums.value(columns[i]) - F.lit(mid)) / F.lit(width)).alias("x"),
            )
            for i, (mid, width) in scale.items()
        ]
    )
    per_user = materialise(
        sums.df.where(c(sums.user).isNotNull())
        .select(c(sums.user).alias("u"), sums.positive.alias("b"), F.inline(pairs))
        .where(F.col("x").isNotNull())
        .groupBy("i", "x", "u")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("sb"))
    )
    counts = materialise(
        per_user.groupBy("i", "x").agg(F.sum("n").alias("n"), F.sum("sb").alias("sb"))
    )
    beta = {i: (0.0, 0.0) for i in scale}
    settled: dict[object, tuple] = {}
    x, n = F.col("x"), F.col("n")

    def table(values: dict) -> DataFrame:
        rows = [(i, float(a), float(b)) for i, (a, b) in values.items()]
        return F.broadcast(spark.createDataFrame(rows, f"i {sums.key}, a double, s double"))

    p = 1 / (1 + F.exp(-(F.col("a") + F.col("s") * x)))
    for _ in range(NEWTON_STEPS):
        if not beta:
            break
        grown = counts.join(table(beta), "i").withColumn("p", p)
        w = n * F.col("p") * (1 - F.col("p"))
        off = F.col("sb") - n * F.col("p")
        steps = grown.groupBy("i").agg(
            F.sum(off).alias("g0"), F.sum(off * x).alias("g1"),
            F.sum(w).alias("h00"), F.sum(w * x).alias("h01"), F.sum(w * x * x).alias("h11"),
        ).collect()
        for r in steps:
            det = r.h00 * r.h11 - r.h01 * r.h01
            if not det > 1e-12 * max(r.h00, 1e-300) ** 2:
                del beta[r.i]
                continue
            step = ((r.h11 * r.g0 - r.h01 * r.g1) / det, (r.h00 * r.g1 - r.h01 * r.g0) / det)
            a, s = beta[r.i][0] + step[0], beta[r.i][1] + step[1]
            if max(abs(a), abs(s)) > 500:
                del beta[r.i]
            elif max(map(abs, step)) < NEWTON_TOLERANCE:
                settled[r.i] = (a, s)
                del beta[r.i]
            else:
                beta[r.i] = (a, s)
    if not settled:
        return None

    final = table(settled)
    grown = counts.join(final, "i").withColumn("p", p)
    w = n * F.col("p") * (1 - F.col("p"))
    q = 1 - F.col("p")
    bread = grown.groupBy("i").agg(
        F.sum(w).alias("h00"), F.sum(w * x).alias("h01"), F.sum(w * x * x).alias("h11"),
        F.sum(F.col("sb") * F.log(F.col("p")) + (n - F.col("sb")) * F.log(q)).alias("loglik"),
    )
    off = F.col("sb") - n * F.col("p")
    scores = (
        per_user.join(final, "i")
        .withColumn("p", p)
        .groupBy("i", "u")
        .agg(F.sum(off).alias("s0"), F.sum(off * x).alias("s1"))
    )
    meat = scores.groupBy("i").agg(
        F.sum(F.col("s0") * F.col("s0")).alias("m00"),
        F.sum(F.col("s0") * F.col("s1")).alias("m01"),
        F.sum(F.col("s1") * F.col("s1")).alias("m11"),
    )
    det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
    w0, w1 = F.try_divide(-F.col("h01"), det), F.try_divide(F.col("h00"), det)
    variance = (
        w0 * w0 * F.col("m00") + 2 * w0 * w1 * F.col("m01") + w1 * w1 * F.col("m11")
    )
    widths = F.broadcast(
        spark.createDataFrame([(i, float(s)) for i, (_, s) in scale.items()], f"i {sums.key}, width double")
    )
    return (
        totals.join(F.broadcast(bread), "i")
        .join(F.broadcast(meat), "i")
        .join(final, "i")
        .join(widths, "i")
        .select(
            "i", "n", "n1", "sb", "sb1",
            (F.col("s") / F.col("width")).alias("coef"),
            (F.sqrt(_correction(F.col("n"), F.col("g")) * variance) / F.col("width")).alias("se"),
            "loglik",
        )
    )


def logit_results(sums: ClusterSums, significance_level: float = 0.05) -> DataFrame:
    """Clustered logistic regression per feature; no rows if the outcome is constant."""
    share = F.col("sb") / F.col("n")
    usable = sums.totals().where((share > 0) & (share < 1))
    fitted = _binary_logit(sums, usable)
    other = _newton_logit(sums, usable)
    if other is not None:
        fitted = fitted.unionByName(other)
    if sums.sparse is not None:
        fitted = fitted.unionByName(_counted_logit(sums, usable))
    fitted = fitted.where(F.col("se").isNotNull())
    coef, se = F.col("coef"), F.col("se")
    with_share = F.try_divide(F.col("sb1"), F.col("n1"))
    without_share = F.try_divide(F.col("sb") - F.col("sb1"), F.col("n") - F.col("n1"))
    fitted = fitted.withColumn("z", F.try_divide(coef, se)).withColumn("p", normal_p_value("z"))
    return fitted.select(
        sums.name(F.col("i")).alias("feature"),
        coef.alias("log_odds_coef"),
        F.exp(coef).alias("odds_ratio"),
        F.exp(coef - Z_95 * se).alias("or_ci_lower"),
        F.exp(coef + Z_95 * se).alias("or_ci_upper"),
        F.col("z").alias("z_statistic"),
        F.col("p").alias("p_value"),
        se.alias("se_cluster_robust"),
        F.coalesce(F.col("p") < significance_level, F.lit(False)).alias("significant"),
        with_share.alias("prop_outcome_with_feature"),
        without_share.alias("prop_outcome_without_feature"),
        (with_share - without_share).alias("prop_difference"),
        (1 - F.col("loglik") / (F.col("n") * _information(share))).alias("pseudo_r2"),
        odds_ratio_label(F.exp(coef)).alias("effect_size_interpretation"),
        F.col("n").cast("bigint").alias("n_obs"),
    ).orderBy(F.abs(F.col("z_statistic")).desc_nulls_last(), "feature")


def _empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    text = ("feature", "effect_size_interpretation")
    types = {"significant": "boolean", "n_obs": "bigint", **dict.fromkeys(text, "string")}
    schema = ", ".join(f"{n} {types.get(n, 'double')}" for n in columns)
    return df.sparkSession.createDataFrame([], schema)


def ols_cluster_robust_test(
    df: DataFrame,
    feature_set: Sequence[str],
    outcome_var: str = "wonky_study_count",
    user_id_var: str = "respondentPk",
    significance_level: float = 0.05,
    sparse: str | None = None,
) -> DataFrame:
    """Mean difference per feature, strongest t first; unknown features are skipped.

    All features of a ``sparse`` column are tested along with the named columns.
    """
    sums = ClusterSums(df, feature_set, outcome_var, user_id_var, sparse=sparse)
    return ols_results(sums, significance_level) if sums.sums is not None else _empty(df, OLS_COLUMNS)


def logistic_cluster_robust_test(
    df: DataFrame,
    feature_set: Sequence[str],
    outcome_var: str = "wonky_study_count",
    user_id_var: str = "respondentPk",
    significance_level: float = 0.05,
    binarize_outcome: bool = True,
    sparse: str | None = None,
) -> DataFrame:
    """Odds ratio per feature, strongest z first; all features of a ``sparse`` column too."""
    sums = ClusterSums(df, feature_set, outcome_var, user_id_var, binarize_outcome, sparse)
    if sums.sums is None:
        return _empty(df, LOGIT_COLUMNS)
    return logit_results(sums, significance_level)


def run_combined_regression_tests(
    df: DataFrame,
    feature_set: Sequence[str],
    outcome_var: str = "wonky_study_count",
    user_id_var: str = "respondentPk",
    significance_level: float = 0.05,
    sparse: str | None = None,
) -> DataFrame:
    """Both tests side by side, one row per feature that either could fit.

    All features of a ``sparse`` column are tested along with the named columns.
    """
    sums = ClusterSums(df, feature_set, outcome_var, user_id_var, sparse=sparse)
    if sums.sums is not None:
        ols, logit = ols_results(sums, significance_level), logit_results(sums, significance_level)
    else:
        ols, logit = _empty(df, OLS_COLUMNS), _empty(df, LOGIT_COLUMNS)
    prefixed = [
        frame.select(
            "feature", *[c(n).alias(f"{prefix}_{n}") for n in frame.columns if n != "feature"]
        )
        for prefix, frame in (("ols", ols), ("logit", logit))
    ]
    a = F.coalesce(F.col("ols_significant"), F.lit(False))
    b = F.coalesce(F.col("logit_significant"), F.lit(False))
    return (
        prefixed[0]
        .join(prefixed[1], "feature", "full_outer")
        .withColumns({"significant_both": a & b, "significant_either": a | b})
        .orderBy(F.abs(F.col("ols_t_statistic")).desc_nulls_last(), "feature")
    )


def run_test_battery(
    df: DataFrame, feature_sets: dict[str, Sequence[str]], sparse: str | None = None, **settings
) -> DataFrame:
    """All feature sets in one table; a feature in several sets is fitted once.

    Names that are no columns are looked for in the ``sparse`` column, if one is given; a
    name that ends in ``*`` stands for all its features that start so.
    """
    names = list(dict.fromkeys(f for members in feature_sets.values() for f in members))
    listed = [n for n in names if n not in df.columns]
    if sparse is not None and listed:
        df = only(df, listed, sparse)
    fitted = run_combined_regression_tests(df, names, sparse=sparse if listed else None, **settings)
    members = [
        F.when(requested(F.col("feature"), wanted), F.lit(name))
        for name, wanted in feature_sets.items()
        if wanted
    ]
    sets = F.array_compact(F.array(*members))
    return fitted.select(F.explode(sets).alias("feature_set"), "*")


def both_significant(results: DataFrame) -> DataFrame:
    return results.where("significant_both")


def large_in_both(results: DataFrame) -> DataFrame:
    wanted = ("medium", "large")
    return results.where(
        F.col("ols_effect_size_interpretation").isin(*wanted)
        & F.col("logit_effect_size_interpretation").isin(*wanted)
    )


def discrepant(results: DataFrame) -> DataFrame:
    return results.where("significant_either AND NOT significant_both")
