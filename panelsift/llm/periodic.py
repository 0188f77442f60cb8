"""Periodic runs of words: seeds that a run cannot avoid, extended along diagonals.

A run of period q and length L repeats itself at lag q over L - q words. With runs of at
least ``least`` words and two periods, that overlap is at least half of ``least`` (k), so
every run repeats some k-gram. The index names all k-grams of a document, then those of
2k, 4k, ... words by pairing names, exactly and as long as any repeats itself.

Lags below 2k are looked at densely. Lags from 2m to 4m - 1, for m = k, 2k, 4k, ...,
overlap over at least 2m words, so one whole block of m words at a multiple of m lies in
the overlap: only such blocks are paired with their occurrences at those lags. Blocks next
to each other on a diagonal form one chain, which is extended once, from its ends. Pairs
that lie within a found run of a short period are covered by it and are not extended
again. There are at most 2n pairs a level, so time grows as n log n on any text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsift.llm.common import map_texts

#: Least words of a run.
LEAST = 12
Edit = Callable[[object, list[bytes]], list[bytes]]


def paired(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Names of two stretches in a row, the second ``shift`` words on; equal stretches share one."""
    m = len(b) - shift
    if m <= 0:
        return np.zeros(0, np.int64)
    return np.unique(a[:m] * (int(b.max()) + 1) + b[shift:], return_inverse=True)[1]


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Name of the k-gram that starts at each word."""
    names, size, power, length = None, 0, codes, 1
    while True:
        if k & length:
            names, size = (power, length) if names is None else (paired(names, power, size), size + length)
        if 2 * length > k:
            return names
        power, length = paired(power, power, length), 2 * length


def may_repeat(codes: np.ndarray, k: int) -> bool:
    """False only if no k-gram stands twice."""
    m = len(codes) - k + 1
    if m < 2:
        return False
    mixed = np.zeros(m, np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + wide[i : i + m]
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def chains(first: np.ndarray, lag: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring pairs of one lag put together: first and last start, and lag."""
    order = np.lexsort((first, lag))
    first, lag = first[order], lag[order]
    new = np.ones(len(first), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (first[1:] != first[:-1] + step)
    at = np.flatnonzero(new)
    return first[at], first[np.append(at[1:], len(first)) - 1], lag[at]


def find_runs(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of a sequence as (start, length, period), by start, then period.

    A run has its smallest period, at least ``least`` words and two periods, and cannot be
    extended by a word on either side without losing the period.
    """
    n, k = len(codes), (least + 1) // 2
    if n < least or not may_repeat(codes, k):
        return []
    names = grams(codes, k)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # starts, ends, lags

    def keep(start: np.ndarray, overlap: np.ndarray, lag: np.ndarray) -> None:
        good = overlap >= np.maximum(least - lag, lag)
        found.append((start[good], (start + overlap + lag)[good], lag[good]))

    for lag in range(1, min(2 * k, n // 2 + 1)):
        at = np.flatnonzero(names[:-lag] == names[lag:])
        if len(at):
            first, last, lags = chains(at, np.full(len(at), lag), 1)
            keep(first, last - first + k, lags)
    levels = [(k, names)]
    m = k
    while 4 * m <= n and int(names.max()) + 1 < len(names):
        for first, last, lags in level_chains(names, m, n, furthest(found, m, n)):
            left, right = first, last + m
            for size, known in [*reversed(levels[:-1]), *[(1, codes)] * (k - 1)]:
                before = np.maximum(left - size, 0)
                left = left - size * ((left >= size) & (known[before] == known[np.minimum(before + lags, len(known) - 1)]))
                after = np.minimum(right, len(known) - 1)
                there = np.minimum(right + lags, len(known) - 1)
                right = right + size * ((right + lags + size <= n) & (known[after] == known[there]))
            keep(left, right - left, lags)
        names, m = paired(names, names, m), 2 * m
        levels.append((m, names))
        if not len(names):
            break
    start, end, lag = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    # a multiple of a period has the very same stretch
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return sorted((int(s), int(e - s), int(q)) for s, e, q in zip(start[new], end[new], lag[new], strict=True))


def furthest(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], m: int, n: int) -> np.ndarray:
    """How far the found runs of periods up to ``m`` that begin at or before each word reach."""
    reach = np.zeros(n, np.int64)
    for start, end, lag in found:
        short = lag <= m
        np.maximum.at(reach, start[short], end[short])
    return np.maximum.accumulate(reach)


def level_chains(names: np.ndarray, m: int, n: int, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chains of blocks of ``m`` words that occur again 2m to 4m - 1 words on."""
    blocks = np.arange(0, len(names), m)
    # all pairs of such a block lie within one run of a short period
    blocks = blocks[reach[blocks] < blocks + 5 * m]
    index = np.sort(names * (n + 1) + np.arange(len(names)))
    begin = np.searchsorted(index, names[blocks] * (n + 1) + np.minimum(blocks + 2 * m, n))
    end = np.searchsorted(index, names[blocks] * (n + 1) + np.minimum(blocks + 4 * m, n))
    count = end - begin
    first = np.repeat(blocks, count)
    at = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    lag = index[at] % (n + 1) - first
    new = reach[first] < first + lag + m  # not covered
    if new.any():
        yield chains(first[new], lag[new], m)


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without the repetitions: of each run its first period stays."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def coded(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words share it."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def periodic_runs(
    docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", edit: Edit | None = None
) -> DataFrame:
    """Per row: key, n_words, runs (start, length, period, in words from 0) and collapsed.

    ``collapsed`` are the words that stay when each run is cut down to its first period,
    joined by one space. Words are what lies between ASCII blanks. ``edit`` may change the
    words of a row, given its key, before they are looked at. Null and empty texts have no
    words, no runs and an empty ``collapsed``. Repeated rows and null keys are kept. An
    empty table gives no rows. Other columns, whatever their names, are neither read nor
    returned.
    """
    kind = dict(docs.dtypes)[key]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            counts, runs, collapsed = [], [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (data or b"").split()  # at the blanks of ASCII, as bytes do
                if edit is not None and words:
                    words = edit(name, words)
                own = find_runs(coded(words), least) if len(words) >= least else []
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                collapsed.append(b" ".join(kept_words(words, own)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(runs, run_type),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                [key, "n_words", "runs", "collapsed"],
            )

        return work

    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    schema = f"`{key}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return map_texts(narrow, make, schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of :func:`periodic_runs`: number of runs, the longest one, and checksums."""
    # greatest length first, then smallest start, then period
    longest = F.array_sort(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    )
    top = F.get(longest, F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    length = -top["less"]
    return found.select(
        key,
        F.size("runs").cast("bigint").alias("n_runs"),
        top["start"].alias("start"),
        length.alias("length"),
        top["period"].alias("period"),
        F.floor(1000 * length / top["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
