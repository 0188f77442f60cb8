"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document if at least 0.8 of the item's five-word shingles are in
it. Similarity is no measure for that, since documents are long and items short; so
documents are partitioned by the size of their shingle set, and each partition has a
MinHash of its own: one permutation, dealt into bins that grow with the partition's
upper size, of which each keeps its least hash. Items carry a signature per partition.
A bin in common makes a candidate; each candidate is verified by exact containment.

With eight bins per shingle of the largest document in a partition a shared shingle is
missing from the document's signature with probability below 0.061 (it must share its
bin with a smaller hash), and an item of n shingles is missed only if all its at least
0.8 n shared shingles are. An item of fewer than ``SURE`` shingles therefore enters
with each shingle (bins of one shingle each: no loss).

Items are a query set held against all documents in blocks of ``BLOCK_SHINGLES``; a
block is what tasks receive, so its size has a bound whatever the benchmark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsift.llm.common import bounded_batches, map_texts
from panelsift.llm.shingles import WORDS, shared, shingle_sets

THRESHOLD = 0.8
BINS_PER_SHINGLE = 8
SURE = 16
BLOCK_SHINGLES = 2_000_000


def signature(shingles: np.ndarray, size_class: int) -> np.ndarray:
    """Least hash of each filled bin; the bin is the top bits of the hash itself.

    Size class c holds sets of up to 2**c shingles and has 2**c * BINS_PER_SHINGLE bins.
    """
    bits = size_class + BINS_PER_SHINGLE.bit_length() - 1
    bins = shingles >> np.uint64(64 - bits)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    return shingles[first]


def size_class(n: int) -> int:
    return max(int(n - 1).bit_length(), 1)


class ItemBlock:
    """Items with their sets and an index of signatures per size class, made when used."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.items = items
        self._index: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def index(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        if c not in self._index:
            signs = [s if len(s) < SURE else signature(s, c) for _, s in self.items]
            hashes = np.concatenate(signs)
            owners = np.repeat(np.arange(len(signs)), [len(s) for s in signs])
            order = np.argsort(hashes, kind="stable")
            self._index[c] = hashes[order], owners[order]
        return self._index[c]

    def found_in(self, document: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(item number, shared shingles) of the items contained in a document's set."""
        if not len(document):
            return
        c = size_class(len(document))
        hashes, owners = self.index(c)
        candidates: set[int] = set()
        # signatures of long items against the document's, short items against its set
        sign = signature(document, c)
        for probe, short in ((sign, False), (document, True)):
            low = np.searchsorted(hashes, probe, "left")
            hit = low < len(hashes)
            hit[hit] = hashes[low[hit]] == probe[hit]
            if not hit.any():
                continue
            high = np.searchsorted(hashes, probe[hit], "right")
            for a, b in zip(low[hit].tolist(), high.tolist()):
                for i in owners[a:b].tolist():
                    if (len(self.items[i][1]) < SURE) == short:
                        candidates.add(i)
        for i in sorted(candidates):
            item = self.items[i][1]
            both = shared(item, document)
            if both >= threshold * len(item) - 1e-9:
                yield i, both


def item_sets(items: DataFrame, key: str, text: str) -> DataFrame:
    """Per item: key and its set of shingles; items of fewer than five words have none.

    So short an item says nothing about where a document came from.
    """

    def make():
        def work(batch: pa.RecordBatch):
            texts = batch.column(text)
            rows = []
            for t, s in zip(texts.to_pylist(), shingle_sets(texts)):
                rows.append(s.view(np.int64).tolist() if len((t or "").encode().split()) >= WORDS else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(rows, pa.list_(pa.int64()))], ["item", "shingles"]
            )

        return work

    return map_texts(items.select(key, text), make, f"item {dict(items.dtypes)[key]}, shingles array<bigint>")


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[ItemBlock]:
    """Items in blocks of bounded size, streamed through the driver one at a time."""
    held, size = [], 0
    for row in item_sets(items, key, text).where(F.size("shingles") > 0).toLocalIterator():
        held.append((row.item, np.array(row.shingles, np.int64).view(np.uint64)))
        size += len(row.shingles)
        if size >= BLOCK_SHINGLES:
            yield ItemBlock(held)
            held, size = [], 0
    if held:
        yield ItemBlock(held)


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id",
    text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document row and item it contains: doc, item, n_shared, n_item, containment.

    Null and empty texts contain nothing, and no item without five words is contained.
    Equal documents are reported each, equal items each. Other columns, whatever their
    names, are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    types = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"`{key}` {types[0]}, `{item_key}` {types[1]}, n_shared bigint, n_item bigint, containment double"
    found = None
    for block in item_blocks(items, item_key, text):
        sent = spark.sparkContext.broadcast(block)

        def make(sent=sent):
            own = ItemBlock(sent.value.items)

            def work(batch: pa.RecordBatch):
                keys, item, both, size = [], [], [], []
                for i, s in enumerate(shingle_sets(batch.column(text))):
                    for j, n in own.found_in(s, threshold):
                        keys.append(i)
                        item.append(own.items[j][0])
                        both.append(n)
                        size.append(len(own.items[j][1]))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(key).take(pa.array(keys)),
                            pa.array(item, pa.from_numpy_dtype(np.int64) if types[1] == "bigint" else None),
                            pa.array(both, pa.int64()),
                            pa.array(size, pa.int64()),
                            pa.array(np.array(both) / np.array(size), pa.float64()),
                        ],
                        [key, item_key, "n_shared", "n_item", "containment"],
                    )

            return work

        part = map_texts(docs.select(key, text), make, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that contain an item, columns and order of columns kept.

    Items are tried while the row is at hand, so nothing is joined back.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs
    for block in item_blocks(items, "item_id", "text"):
        sent = spark.sparkContext.broadcast(block)

        def make(sent=sent):
            own = ItemBlock(sent.value.items)

            def work(batch: pa.RecordBatch):
                keep = [next(own.found_in(s, threshold), None) is None for s in shingle_sets(batch.column(text))]
                yield batch.filter(pa.array(keep, pa.bool_()))

            return work

        out = map_texts(out, make, docs.schema)
    return out
