"""One-hot flags for scalar and list columns, and dictionary mappings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsift.columns import c, strip
from panelsift.operators.skew import lookup_join

MISSING = "nan"  # fixed value: category of a missing value when encoding as text


def _as_text(column: Column, kind: T.DataType) -> Column:
    # booleans are spelled True/False in the category names
    text = column.cast("string")
    return F.initcap(text) if isinstance(kind, T.BooleanType) else text


def _category(df: DataFrame, name: str, as_string: bool, value: Column | None = None) -> Column:
    """Category text of a scalar column, or of one value of a list column; null for none."""
    kind = df.schema[name].dataType
    element = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not as_string and not isinstance(element, T.StringType):
        raise TypeError(f"{name!r} is not text; encode it with as_string=True")
    # plain encoding has no category for a missing value
    trimmed = strip(_as_text(c(name) if value is None else value, element))
    return F.coalesce(trimmed, F.lit(MISSING)) if as_string else trimmed


def _categories(df: DataFrame, name: str, as_string: bool) -> Column:
    """Array with the category texts of one row, repeated values included."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.ArrayType):
        return F.array_compact(F.array(_category(df, name, as_string)))
    values = F.array_compact(F.transform(c(name), lambda x: _category(df, name, as_string, x)))
    if not as_string:
        return F.coalesce(values, F.array().cast("array<string>"))
    lone = F.array(F.lit(MISSING))
    return F.when(c(name).isNull() | (F.size(c(name)) == 0), lone).otherwise(values)


def occurrences(df: DataFrame, column: str, as_string: bool) -> Column:
    """Array of (category, n): how often each category stands in the row."""
    values = _categories(df, column, as_string)
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        return F.transform(values, lambda v: F.struct(v.alias("category"), F.lit(1).alias("n")))
    return F.transform(
        F.array_distinct(values),
        lambda v: F.struct(v.alias("category"), F.size(F.filter(values, lambda x: x == v)).alias("n")),
    )


def one_hot_entries(df: DataFrame, columns: Mapping[str, bool], name: str = "encoded") -> DataFrame:
    """Sparse encoding: one (column, category, n) entry per category of the row.

    ``columns`` maps a name to its ``as_string`` setting. The row's entries are the
    flags that :func:`one_hot_encode_column` would set, whatever number of categories
    the column has; no vocabulary is needed, so nothing reaches the driver.
    """

    def entries(column: str, as_string: bool) -> Column:
        return F.transform(
            occurrences(df, column, as_string),
            lambda e: F.struct(F.lit(column).alias("column"), e["category"].alias("category"), e["n"].alias("n")),
        )

    return df.withColumn(name, F.concat(*[entries(n, s) for n, s in columns.items()]))


def vocabulary(df: DataFrame, columns: Mapping[str, bool]) -> DataFrame:
    """(column, category, rows): all categories of several columns, in how many rows."""

    def entry(column: str, category: Column) -> Column:
        return F.struct(F.lit(column).alias("column"), category.alias("category"))

    def named(column: str, as_string: bool) -> Column:
        return F.transform(F.array_distinct(_categories(df, column, as_string)), lambda v: entry(column, v))

    listed = {n for n in columns if isinstance(df.schema[n].dataType, T.ArrayType)}
    # one category at most, which takes no function over an array
    single = [entry(n, _category(df, n, s)) for n, s in columns.items() if n not in listed]
    entries = [F.array(*single)] if single else []
    entries += [named(n, s) for n, s in columns.items() if n in listed]
    met = df.select(F.inline(F.concat(*entries))).where("category IS NOT NULL")
    return met.groupBy("column", "category").agg(F.count(F.lit(1)).alias("rows"))


def vocabularies(df: DataFrame, columns: Mapping[str, bool]) -> dict[str, list[str]]:
    """Sorted categories of several columns, found in one job.

    Each category becomes a column of the dense encoding, so the list is as long as the
    caller's table is wide. Encode columns of open vocabulary with :mod:`sparse` instead.
    """
    found = vocabulary(df, columns).select("column", "category").collect()
    return {n: sorted(r.category for r in found if r.column == n) for n in columns}


def one_hot_flags(
    df: DataFrame, column: str, categories: Sequence[str], prefix: str, as_string: bool
) -> dict[str, Column]:
    """Occurrences of each category in the row: 0/1 for scalars, a count for lists."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        values = _categories(df, column, as_string)

        def occurrences(category: str) -> Column:
            return F.size(F.filter(values, lambda x: x == category))

        return {f"{prefix}{v}": occurrences(v) for v in categories}
    if not as_string and not isinstance(kind, T.StringType):
        raise TypeError(f"{column!r} is not text; encode it with as_string=True")
    text = strip(_as_text(c(column), kind))
    if as_string:
        text = F.coalesce(text, F.lit(MISSING))
    return {f"{prefix}{v}": F.when(text == v, 1).otherwise(0) for v in categories}


def one_hot_encode_column(
    df: DataFrame,
    column: str,
    prefix: str | None = None,
    as_string: bool = False,
    categories: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Add one flag per category of a scalar or list column."""
    p = f"{column}_" if prefix is None else prefix
    if categories is None:
        categories = vocabularies(df, {column: as_string})[column]
    flags = one_hot_flags(df, column, categories, p, as_string)
    return _added(df, flags), list(flags)


def batch_one_hot_encode(
    df: DataFrame,
    columns: Sequence[str],
    as_string_columns: Sequence[str] | None = None,
    categories: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Encode many columns: one job for all vocabularies, one projection for all flags."""
    text = set(as_string_columns or ())
    given = dict(categories or {})
    missing = {n: n in text for n in columns if n not in given}
    if missing:
        given.update(vocabularies(df, missing))
    flags: dict[str, Column] = {}
    for name in columns:
        flags.update(one_hot_flags(df, name, given[name], f"{name}_", name in text))
    return _added(df, flags)


def _added(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    return df.select("*", *[col.alias(name) for name, col in flags.items()])


def map_values(df: DataFrame, column: str, mapping: Mapping[str, str], new_column: str) -> DataFrame:
    """Dictionary lookup; values outside the dictionary become null."""
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(new_column, F.element_at(literal, c(column)))


def map_values_by_table(
    df: DataFrame, column: str, table: DataFrame, new_column: str
) -> DataFrame:
    """Lookup in a two-column dictionary frame, for dictionaries kept as tables."""
    key, value = table.columns
    renamed = table.select(c(key).alias("__code"), c(value).alias(new_column))
    return lookup_join(df.withColumn("__code", c(column)), renamed, ["__code"]).drop("__code")


def create_value_mapping_and_encode(
    df: DataFrame,
    column: str,
    mapping: Mapping[str, str],
    new_column: str | None = None,
    one_hot: bool = True,
) -> tuple[DataFrame, list[str] | None]:
    """Map a code column to its labels and encode the labels.

    The mapping itself bounds the categories; only those that occur become columns.
    """
    name = f"{column}_mapped" if new_column is None else new_column
    mapped = map_values(df, column, mapping, name)
    if not one_hot:
        return mapped, None
    return one_hot_encode_column(mapped, name, as_string=True)
