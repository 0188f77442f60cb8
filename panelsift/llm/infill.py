"""Fill-in-the-middle texts, cut at line boundaries through a learned rank index.

A text is cut after whole lines. Where the line of a given rank ends is told by a
piecewise-linear model of all boundary offsets: segments grow while one straight line
stays within an error bound of all their points. A cut is predicted from its rank and
corrected by the stored residual, so it is exact.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsift.llm.common import map_texts, texts_of

#: Marks of the parts. Fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = re.compile("<[PSM]>")
LINE_END = re.compile("\n")
#: Most characters between a boundary and its segment's line, before rounding.
ERROR = 100


def boundaries(text: str) -> list[int]:
    """Offsets in code points between lines: 0, and after each line; the last is the length."""
    ends = [0, *(m.end() for m in LINE_END.finditer(text))]
    if ends[-1] < len(text):
        ends.append(len(text))
    return ends


class RankIndex:
    """Offsets by rank, as error-bounded line segments and one small residual a rank."""

    def __init__(self, offsets: Sequence[int], error: int = ERROR):
        self.starts: list[int] = []
        self.bases: list[int] = []
        self.slopes: list[float] = []
        rank, n = 0, len(offsets)
        while rank < n:
            base, low, high, end = offsets[rank], 0.0, float("inf"), rank + 1
            while end < n:  # the cone of slopes that pass near all points so far
                rise, run = offsets[end] - base, end - rank
                least, most = max(low, (rise - error) / run), min(high, (rise + error) / run)
                if least > most:
                    break
                low, high, end = least, most, end + 1
            self.starts.append(rank)
            self.bases.append(base)
            self.slopes.append((low + high) / 2 if end > rank + 1 else 0.0)
            rank = end
        ranks = np.arange(n)
        at = np.searchsorted(self.starts, ranks, "right") - 1 if n else ranks
        guess = np.array(self.bases, np.int64)[at] + np.floor(np.array(self.slopes)[at] * (ranks - np.array(self.starts, np.int64)[at])).astype(np.int64)
        left = np.asarray(offsets, np.int64) - guess
        self.residuals = left.astype(np.int16 if error < 2**14 else np.int64)

    def predict(self, rank: int) -> int:
        at = bisect_right(self.starts, rank) - 1
        return self.bases[at] + int(np.floor(self.slopes[at] * (rank - self.starts[at])))

    def offset(self, rank: int) -> int:
        """The exact offset: prediction and residual."""
        return self.predict(rank) + int(self.residuals[rank])


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that seed and key decide; a null key counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def rearrange(text: str, key: object, seed: int, rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of lines, form, length of prefix and middle, and the text in its form."""
    ends = boundaries(text)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= rate or MARKS.search(text):
        return n, "plain", None, None, text
    index = RankIndex(ends)
    cuts = h1 % (n + 1), h2 % (n + 1)
    a, b = index.offset(min(cuts)), index.offset(max(cuts))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(
    docs: DataFrame, seed: int = 7, rate: int = 100, suffix_first: int = 50, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key, n (lines), form, prefix_chars, middle_chars and output, the new text.

    Of 100 texts about ``rate`` are rearranged, and of these ``suffix_first`` as spm, the
    others as psm; key and seed alone decide, so equal keys get equal draws. Texts that are
    null, empty or hold a mark stay plain, with null lengths. A null key counts as empty.
    Repeated rows are kept. An empty table gives no rows. Other columns, whatever their
    names, are neither read nor returned.
    """
    kind = dict(docs.dtypes)[key]

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            made = [
                rearrange(t, k, seed, rate, suffix_first)
                for k, t in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True)
            ]
            n, form, prefix, middle, output = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array(output, pa.string()),
                ],
                [key, "n", "form", "prefix_chars", "middle_chars", "output"],
            )

        return work

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"`{key}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_texts(narrow, make, schema)


def restored(output: Column, form: Column) -> Column:
    """The text before rearrangement: marks occur nowhere else in a rearranged text."""
    parts = F.split(output, MARKS.pattern, -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
