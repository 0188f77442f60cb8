"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a 64-bit ring, and a row's place on it is the hash of its
text, so equal texts lie together. Rows go to the shard of the next point clockwise.
No shard takes more than its bound; what overflows goes on clockwise to shards with room.
With bound 1.0 every shard ends up with the mean, up to one row's size.

Overflow is decided for arcs of the ring, not for rows: rows lie along the ring in one
range-partitioned order with running sums, an arc is cut where its shard is full, and a
row belongs to the piece that holds its middle. What reaches the driver is one row per arc
and range partition. A hot text is cut like any other stretch of the ring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsift.llm.common import stored

NODES = 200
#: Largest load of a shard, in means.
BOUND = 1.0


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Points in ring order and the shard that owns the arc ending at each."""
    import xxhash

    points = [
        (xxhash.xxh64_intdigest(f"shard {s} node {v}") - 2**63, s) for s in range(shards) for v in range(nodes)
    ]
    points.sort()
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def spread(arcs: np.ndarray, owner: np.ndarray, shards: int, bound: float) -> list[tuple[int, int, int, int]]:
    """Pieces (arc, from, to, shard) of arcs with the given sizes under bounded loads.

    Every arc first goes to its owner as far as that has room; then what is left of the
    arcs goes on clockwise, from its own place, to the next owners with room.
    """
    total = int(arcs.sum())
    cap = -(-int(total * bound) // shards) if total else 0
    room = [cap] * shards
    pieces, over = [], []
    for a, size in enumerate(arcs.tolist()):
        s = int(owner[a])
        take = min(size, room[s])
        room[s] -= take
        if take:
            pieces.append((a, 0, take, s))
        if take < size:
            over.append((a, take, size))
    n = len(arcs)
    for a, begin, end in over:
        at = a
        while begin < end:
            at = (at + 1) % n
            s = int(owner[at])
            take = min(end - begin, room[s])
            if take:
                pieces.append((a, begin, begin + take, s))
                room[s] -= take
                begin += take
    return sorted(pieces)


def assign(
    docs: DataFrame, shards: int = 40, nodes: int = NODES, bound: float = BOUND, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key, size, text_crc32, law 'bytes', shard, slot and grown_shard (null).

    Size is the text's UTF-8 bytes plus 16; a null text counts as empty. Slots of a shard
    run from 0 without gaps. Rows with equal text and key lie in any order among
    themselves. Other columns, whatever their names, are neither read nor returned.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(content) + 16).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(content).alias("place"),
    )
    points, owner = ring(shards, nodes)

    def run_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        size_before = rows_before = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            size = batch.column(1).to_numpy()
            arc = np.searchsorted(points, batch.column(3).to_numpy(), "left") % len(points)
            begin = size_before + np.cumsum(size) - size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array(np.where(batch.column(3).to_numpy() > points[-1], 1, 0), pa.int32()),
                    pa.array(arc, pa.int32()),
                    pa.array(np.full(n, part), pa.int32()),
                    pa.array(begin, pa.int64()),
                    pa.array(rows_before + np.arange(n), pa.int64()),
                ],
                ["key", "size", "text_crc32", "lap", "arc", "part", "begin", "rank"],
            )
            size_before += int(size.sum())
            rows_before += n

    kind = dict(docs.dtypes)[key]
    order = [F.col("place"), F.col("key").asc_nulls_first()]
    along = stored(
        narrow.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            run_sums,
            f"key {kind}, size bigint, text_crc32 bigint, lap int, arc int, part int, begin bigint, rank bigint",
        ),
        "ring",
    )
    # per stretch (range partition and arc), in ring order; the stretch past the last
    # point belongs to the first arc but keeps its own place in the order
    stretches = sorted(
        (r.part, r.begin, r.rank, r.lap, r.arc, r.size, r.rows)
        for r in along.groupBy("part", "lap", "arc")
        .agg(F.min("begin").alias("begin"), F.min("rank").alias("rank"), F.sum("size").alias("size"), F.count("*").alias("rows"))
        .collect()
    )
    arcs = np.zeros(len(points), np.int64)
    part_size, part_rows = {}, {}
    run_size = run_rows = 0
    first_of_arc: dict[tuple[int, int], int] = {}
    for part, begin, rank, lap, arc, size, rows in stretches:
        if part not in part_size:
            part_size[part], part_rows[part] = run_size, run_rows
        first_of_arc.setdefault((lap, arc), run_size)
        arcs[arc] += size
        run_size += size
        run_rows += rows
    # pieces by where they start along the whole order; the first arc may lie at both ends
    starts: list[tuple[int, int]] = []
    head = sum(s for *_, lap, arc, s, _ in stretches if lap == 0 and arc == 0)
    for arc, begin, end, shard in spread(arcs, owner, shards, bound):
        if (0, arc) in first_of_arc and (arc or begin < head):
            starts.append((first_of_arc[0, arc] + begin, shard))
        if arc == 0 and (1, 0) in first_of_arc and end > head:
            starts.append((first_of_arc[1, 0] + max(begin - head, 0), shard))
    starts.sort()
    edge = np.array([s for s, _ in starts] or [0], np.int64)
    shard_of = np.array([s for _, s in starts] or [0], np.int64)
    parts = max(part_size, default=0) + 1
    base = np.array([part_size.get(p, 0) for p in range(parts)], np.int64)
    base_rows = np.array([part_rows.get(p, 0) for p in range(parts)], np.int64)

    def pieces_of(batches: Iterator[pa.RecordBatch], finish) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            piece = np.searchsorted(edge, batch.column("begin").to_numpy() + batch.column("size").to_numpy() // 2 + base[part], "right") - 1
            yield finish(batch, piece, batch.column("rank").to_numpy() + base_rows[part])

    def count(batch, piece, rank):
        own, n = np.unique(piece, return_counts=True)
        first = [int(rank[piece == p].min()) for p in own]
        return pa.RecordBatch.from_pydict({"piece": own.astype(np.int64), "n": n, "first": first})

    counted = {
        r.piece: (r.n, r.first)
        for r in along.select("part", "begin", "size", "rank")
        .mapInArrow(lambda b: pieces_of(b, count), "piece bigint, n bigint, first bigint")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        .collect()
    }
    first_rank = np.zeros(len(edge), np.int64)
    first_slot = np.zeros(len(edge), np.int64)
    filled = [0] * shards
    for p in range(len(edge)):
        n, first = counted.get(p, (0, 0))
        first_rank[p], first_slot[p] = first, filled[shard_of[p]]
        filled[shard_of[p]] += n

    def place(batch, piece, rank):
        n = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                batch.column("size"),
                batch.column("text_crc32"),
                pa.array(["bytes"] * n),
                pa.array(shard_of[piece], pa.int32()),
                pa.array(first_slot[piece] + rank - first_rank[piece], pa.int64()),
                pa.nulls(n, pa.int32()),
            ],
            [key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        )

    return along.mapInArrow(
        lambda b: pieces_of(b, place),
        f"`{key}` {kind}, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    )
