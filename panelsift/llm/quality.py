"""Quality rules: a threshold table compiled into one Spark projection.

No user functions: words, windows and lines are arrays, and each text is reduced by
higher-order functions in one pass over the table, without a shuffle. Arrays that are
used more than once are bound once, by applying a lambda to a one-element array, so
that no expression is evaluated per element again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
CAPITALS = r"\p{Lu}{2,}"
STOP_WORDS = (
    "the of and to in is that it for a on with was by be as at "
    "le la de et les des un une est que qui en du pour dans "
    "der die und das ist ein eine den von zu mit nicht auf "
    "el los las por con para una y se su"
).split()


@dataclass(frozen=True)
class Rule:
    """Text is rejected where ``measure`` is below ``low`` or above ``high``."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios are per word or per line; a text must pass all rules.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("upper_word_ratio", None, 0.5),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_word_ratio", None, 0.5),
    Rule("n_words", 50, None),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that occurs at least twice, each word once.

    Windows are compared by 64-bit hash. Hashes are sorted first; positions are only
    sorted for a text that has equal neighbours. Covered words of sorted positions add
    up to the gaps between neighbours, three at most.
    """

    def windows(w: Column) -> Column:
        last = F.size(w) - 2
        return F.when(
            last >= 1,
            F.transform(
                F.sequence(F.lit(1), last),
                lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    def has_equal(s: Column) -> Column:
        return F.size(F.array_distinct(s)) < F.size(s)

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            n = F.size(p)
            # comparisons are strict, so an index outside never reaches element access
            own = F.filter(
                p,
                lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False))
                | F.when(i + 1 < n, F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))).otherwise(
                    F.lit(False)
                ),
            )
            return F.sort_array(F.transform(own, lambda x: x["i"]))

        def gaps(s: Column) -> Column:
            steps = F.transform(
                s, lambda x, i: F.coalesce(F.least(F.get(s, i + 1) - x, F.lit(3)), F.lit(3))
            )
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(pairs, lambda p: let(positions(p), gaps))

    return let(
        windows(words),
        lambda h: F.when(has_equal(h), covered(h)).otherwise(F.lit(0).cast("bigint")),
    )


def measures(text: Column) -> Column:
    """Struct of the counts one text is judged by, all bigint."""
    total = F.lit(0).cast("bigint")

    def of_words(w: Column) -> Column:
        bare = F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, total, lambda a, x: a + F.char_length(x)).alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            let(
                F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))),
                lambda lines: F.struct(
                    F.size(lines).cast("bigint").alias("n"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("dup"),
                ),
            ).alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(bare).cast("bigint").alias("n_stop"),
            F.regexp_count(text, F.lit(CAPITALS)).cast("bigint").alias("n_upper"),
        )

    return let(_words(text), of_words)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def passes(rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one condition."""
    verdict = F.lit(True)
    for rule in rules:
        value = F.col(rule.measure)
        if rule.low is not None:
            verdict = verdict & (value >= rule.low)
        if rule.high is not None:
            verdict = verdict & (value <= rule.high)
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``quality``: counts, ratios, ``base_failed`` and ``kept``.

    A null text has no words, so every count is 0 and it is not kept; empty texts
    likewise. Other columns pass through, whatever their names; a column named
    ``quality`` is replaced. Repeated rows are judged each for itself.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    base = held.select("row", measures(F.coalesce(F.col("row")[text], F.lit(""))).alias("m"))
    n = F.col("m.n_words")
    ratios = base.select(
        "row",
        n.alias("n_words"),
        F.col("m.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.lines.dup").alias("n_dup_lines"),
        F.col("m.n_repeat_words").alias("n_repeat_words"),
        _share(F.col("m.word_chars"), n).alias("mean_word_chars"),
        _share(F.col("m.n_symbols"), n).alias("symbol_ratio"),
        _share(F.col("m.n_stop"), n).alias("stop_word_ratio"),
        _share(F.col("m.n_upper"), n).alias("upper_word_ratio"),
        _share(F.col("m.lines.dup"), F.col("m.lines.n")).alias("dup_line_ratio"),
        _share(F.col("m.n_repeat_words"), n).alias("repeat_word_ratio"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = [c for c in ratios.columns if c != "row"]
    verdict = F.struct(
        *counted, failed.alias("base_failed"), (~failed & passes(rules)).alias("kept")
    )
    return ratios.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c != "quality"], verdict.alias("quality")
    )
