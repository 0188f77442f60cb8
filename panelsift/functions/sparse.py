"""Features of open vocabularies as one array column of (feature, x) entries.

A column of free text, such as a task title, has as many categories as the data brings.
Instead of a column for each, a row holds the few features that are not 0 for it, by
name. The plan is as wide as before, no list of categories is ever gathered, and sums
per feature come from the entries alone: what is not listed is 0.

A feature may be listed once per row; an entry without ``x`` is a missing value. Requests
are exact names, or a start of names followed by ``*`` for a whole vocabulary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsift.columns import any_of, c
from panelsift.functions.onehot import occurrences

COLUMN = "sparse_features"
TYPE = "array<struct<feature:string,x:double>>"


def encode(
    df: DataFrame, columns: Mapping[str, bool], into: str = COLUMN, prefixes: Mapping[str, str] | None = None
) -> DataFrame:
    """One-hot entries of several columns, added to those already in ``into``.

    ``columns`` maps a name to its ``as_string`` setting; features are named and valued
    as the dense encoding would. Prefixes must keep the columns' features apart.
    """
    named = {n: f"{n}_" for n in columns} | dict(prefixes or {})

    def entries(column: str, as_string: bool) -> Column:
        return F.transform(
            occurrences(df, column, as_string),
            lambda e: F.struct(
                F.concat(F.lit(named[column]), e["category"]).alias("feature"), e["n"].cast("double").alias("x")
            ),
        )

    present = [F.coalesce(c(into), F.array().cast(TYPE))] if into in df.columns else []
    return df.withColumn(into, F.concat(*present, *[entries(n, s) for n, s in columns.items()], F.array().cast(TYPE)))


def requested(name: Column, wanted: Sequence[str]) -> Column:
    """Whether a feature's name is among the requested names and starts of names."""
    exact = [n for n in wanted if not n.endswith("*")]
    starts = [F.startswith(name, F.lit(n[:-1])) for n in wanted if n.endswith("*")]
    return any_of([name.isin(exact), *starts])


def only(df: DataFrame, wanted: Sequence[str], column: str = COLUMN) -> DataFrame:
    """The same rows with the requested features' entries."""
    return df.withColumn(column, F.filter(c(column), lambda e: requested(e["feature"], wanted)))


def vocabulary(df: DataFrame, column: str = COLUMN) -> DataFrame:
    """(feature, rows, total): every feature that occurs, as a table."""
    return (
        df.select(F.inline(c(column)))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("x").alias("total"))
    )


def present(df: DataFrame, wanted: Sequence[str], column: str = COLUMN) -> list[str]:
    """Requested names and starts of names that occur; at most one row a request is gathered."""
    exact = [n for n in wanted if not n.endswith("*")]
    starts = [n for n in wanted if n.endswith("*")]
    names = df.select(F.explode(c(column)["feature"]).alias("feature"))
    met = names.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("feature").isin(exact), F.col("feature")),
                    *[F.when(F.startswith("feature", F.lit(n[:-1])), F.lit(n)) for n in starts],
                )
            )
        ).alias("request")
    )
    found = {r.request for r in met.distinct().collect()}
    return [n for n in dict.fromkeys(wanted) if n in found]


def with_columns(df: DataFrame, names: Sequence[str], column: str = COLUMN) -> DataFrame:
    """Chosen features as columns of their own, 0 where a row does not list them."""

    def value(name: str) -> Column:
        hits = F.filter(c(column), lambda e: e["feature"] == name)
        listed = F.size(hits) > 0  # -1 where the array itself is missing
        return F.when(listed, F.get(hits, F.lit(0))["x"]).otherwise(0.0)

    return df.select("*", *[value(n).alias(n) for n in names if n not in df.columns])
