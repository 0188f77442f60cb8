"""Column-name helpers shared by every operator.

Engineered names contain ``<``, ``>=``, ``=``, blanks and currency signs, so
names are always turned into columns through :func:`c`, which quotes them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(name: str) -> Column:
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Requested names the frame has, in request order, each once."""
    have = set(df.columns)
    return list(dict.fromkeys(n for n in names if n in have))


def select_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[c(n) for n in existing(df, names)])


def exclude(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """All columns but the named ones; unknown names are ignored."""
    unwanted = set(names)
    return df.select(*[c(n) for n in df.columns if n not in unwanted])


def placed_last(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same columns, the named ones behind the others."""
    return df.select(*[c(n) for n in df.columns if n not in names], *[c(n) for n in names])


def drop_duplicate_columns(df: DataFrame, keep: str = "first") -> DataFrame:
    """Keep one column per name when a join left several of the same name."""
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    names = df.columns
    wanted: dict[str, int] = {}
    for i, name in enumerate(names):
        if keep == "last" or name not in wanted:
            wanted[name] = i
    unique = df.toDF(*[f"__{i}" for i in range(len(names))])
    return unique.select(*[F.col(f"__{i}").alias(names[i]) for i in sorted(wanted.values())])


def starting_with(df: DataFrame, *prefixes: str) -> list[str]:
    return [n for n in df.columns if n.startswith(prefixes)]


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if t in kinds or t.startswith("decimal")]


def strip(text: Column) -> Column:
    """Remove blanks, tabs and line breaks at both ends, not just blanks."""
    return F.trim(text, F.lit(" \t\n\r\x0b\x0c"))
