"""Exact inner-product search: ball trees per shard, branch and bound, shared k-th scores.

Vectors are quantised to integers and repeated ones are reduced to the few smallest ids
that a result could hold. Shards are cells around pivots, split so that each fits a task;
a query class (all queries with the same vector) first searches its own shard. The k-th
score found there travels with it: it rules out whole cells by their balls, and in every
shard that is left it is where the search through the shard's ball tree starts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsift.llm.common import bounded_batches, stored

#: Bytes of the vectors of a shard, and of the queries that meet it in one task.
SHARD_BYTES = 4 << 20
#: Most pivots; they are chosen by hash among distinct vectors and sent to the tasks.
PIVOTS = 1024
PIVOT_BYTES = 16 << 20
#: Rows of a leaf.
LEAF = 64
#: Largest magnitude of a scaled component: squares are added up in double precision.
LARGEST = 1e100
LAST = np.iinfo(np.int64).max


def quantised(vector: Column, scale: float) -> Column:
    """Components times ``scale``, rounded down; null where the vector takes no part."""
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    # beyond 2**52 a double is whole; floor would squeeze it into a long
    whole = F.transform(
        scaled, lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y) + F.lit(0.0)
    )
    fits = F.forall(scaled, lambda y: F.coalesce(F.abs(y) < LARGEST, F.lit(False)))
    return F.when(fits, whole)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List column as rows of ``dim`` numbers; shorter lists end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets)
    flat = np.asarray(column.values, np.float64)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def scores(block: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products, held within a long; ``exact`` if doubles hold all sums."""
    if exact:
        return (block @ q).astype(np.int64)
    whole = [int(x) for x in q]
    each = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in block]
    return np.array([min(max(x, -LAST - 1), LAST) for x in each], np.int64)


class BallTree:
    """Balls halved along their widest direction; rows of a node lie next to each other."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order = np.arange(len(rows))
        self.nodes: list[tuple[int, int, int]] = []  # first row, end, left child (right is next to it) or 0
        centres, radii, least = [], [], []
        queue = [(0, len(rows))]
        while len(self.nodes) < len(queue):
            a, b = queue[len(self.nodes)]
            own = rows[order[a:b]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(away.max())
            least.append(ids[order[a:b]].min())
            if b - a <= LEAF:
                self.nodes.append((a, b, 0))
                continue
            far = own[away.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            along = own @ (other - far)
            order[a:b] = order[a:b][np.lexsort((ids[order[a:b]], along))]
            self.nodes.append((a, b, len(queue)))
            queue += [(a, (a + b) // 2), ((a + b) // 2, b)]
        self.order, self.rows, self.ids = order, rows[order], ids[order]
        self.centres, self.radii, self.least = np.array(centres), np.array(radii), least
        self.norm = float(np.sqrt((self.rows**2).sum(axis=1)).max())
        # room for rounding in centre, radius and product
        self.slack = 1e-9 * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii)

    def bounds(self, a: int, b: int, q: np.ndarray, size: float) -> np.ndarray:
        """No row of the nodes a to b scores more than this."""
        return self.centres[a:b] @ q + size * (self.radii[a:b] + self.slack[a:b])

    def search(self, q: np.ndarray, k: int, floor: tuple[int, int] | None) -> list[tuple[int, int, int]]:
        """The best rows that are no worse than ``floor``: (-score, id, place in the input).

        Nodes are opened by their bound, greatest first. A node whose bound only equals the
        k-th score is opened if it holds a smaller id.
        """
        size = float(np.sqrt((q**2).sum()))
        exact = size * self.norm < 2.0**52
        best: list[tuple[int, int, int]] = []
        last = (-floor[0], floor[1]) if floor else (LAST + 1, LAST)
        open_ = [(-float(self.bounds(0, 1, q, size)[0]), 0)]
        while open_:
            bound, node = heapq.heappop(open_)
            # scores are whole, so a bound is as good as the whole number below it
            if (top := -min(np.floor(-bound), float(LAST))) > last[0]:
                break
            if top == last[0] and self.least[node] > last[1]:
                continue
            a, b, child = self.nodes[node]
            if child:
                for i, x in enumerate(self.bounds(child, child + 2, q, size)):
                    heapq.heappush(open_, (-float(x), child + i))
                continue
            found = scores(self.rows[a:b], q, exact)
            at = np.flatnonzero(found >= -last[0]) if last[0] <= LAST else np.arange(b - a)
            if len(at):
                best += [(-int(found[i]), int(self.ids[a + i]), int(self.order[a + i])) for i in at]
                best = [x for x in sorted(best)[:k] if x[:2] <= last]
                if len(best) == k:
                    last = best[-1][:2]
        return best


def search_shards(shards: DataFrame, asked: DataFrame, dim: int, wanted: int, blocks: int) -> DataFrame:
    """Best ``wanted`` rows of a shard for each query class sent to it.

    ``asked``: qid, q, shard, block and the k-th score so far (floor, floor_id), if any.
    A shard meets the queries in blocks, so both sides of a task stay bounded.
    """

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        qid, vec_id, score, same = [], [], [], []
        if shard.num_rows and queries.num_rows:
            rows, ask = matrix(shard.column("v"), dim), matrix(queries.column("q"), dim)
            names = shard.column("vec_id").to_pylist()
            tree = BallTree(rows, np.array([LAST if x is None else x for x in names], np.int64))
            floors = zip(queries.column("floor").to_pylist(), queries.column("floor_id").to_pylist(), strict=True)
            for i, q, floor in zip(queries.column("qid").to_pylist(), ask, floors, strict=True):
                for s, _, place in tree.search(q, wanted, None if floor[0] is None else floor):
                    qid.append(i)
                    vec_id.append(names[place])
                    score.append(-s)
                    same.append(bool((rows[place] == q).all()))
        return pa.table(
            {
                "qid": pa.array(qid, pa.int64()),
                "vec_id": pa.array(vec_id, pa.int64()),
                "score": pa.array(score, pa.int64()),
                "same": pa.array(same, pa.bool_()),
            }
        )

    if blocks > 1:
        shards = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    else:
        shards = shards.withColumn("block", F.lit(0))
    return (
        shards.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(run, "qid bigint, vec_id bigint, score bigint, same boolean")
    )


def best_of(hits: DataFrame, wanted: int) -> DataFrame:
    """Per query class: the best hits as an array in order."""
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    return (
        hits.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
        .where(F.col("r") <= wanted)
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score", "same"))).alias("top"))
    )


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For each row where ``is_query`` holds, its ``k`` rows of greatest inner product.

    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller id, a null id
    comes last. The query's own row is left out, other rows of the same id or vector are
    not; queries that stand twice are answered twice. Vectors that are null or hold a null,
    non-finite or, once scaled, over-large (1e100) component take no part. Vectors of
    unlike length are compared as if the shorter one ended in zeros; an empty one scores 0.
    Scores beyond a long are held at its ends. An empty table gives no rows. Other columns
    are neither read nor returned.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = stored(
        vectors.select(
            F.col(key).cast("bigint").alias("vec_id"),
            quantised(F.col(vector), scale).alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        ).where("v IS NOT NULL"),
        "vectors",
    )
    wanted = k + 1  # the query's own row may be among them
    place = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    few = stored(
        rows.select("vec_id", "v").withColumn("r", F.row_number().over(place)).where(F.col("r") <= wanted), "distinct"
    )
    n, dim = few.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or k < 1:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dim = max(dim, 1)
    per_shard = max(1, SHARD_BYTES // (8 * dim))
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * dim), -(-n // per_shard)))
    chosen = few.where("r = 1").select("v").orderBy(F.xxhash64("v"), "v").limit(most).collect()
    pivots = np.zeros((len(chosen), dim))
    for i, row in enumerate(chosen):
        pivots[i, : len(row.v)] = row.v
    sent = spark.sparkContext.broadcast(pivots)

    def to_cell(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = 7919 * TaskContext.get().partitionId()
        for batch in batches:
            m = matrix(batch.column(at), dim)
            p = sent.value
            cell = ((p**2).sum(axis=1) - 2 * (m @ p.T)).argmin(axis=1) if len(m) else np.zeros(0, np.int64)
            away = np.sqrt(((m - p[cell]) ** 2).sum(axis=1))
            salt = seen + np.arange(len(m))
            seen += len(m)
            added = [pa.array(cell, pa.int32()), pa.array(away, pa.float64()), pa.array(salt, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "cell", "away", "salt"])

    placed = stored(
        few.select("vec_id", "v").mapInArrow(
            lambda b: to_cell(b, 1), "vec_id bigint, v array<double>, cell int, away double, salt bigint"
        ),
        "cells",
    )
    # one row per pivot
    radius, parts = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():
        radius[r.cell], parts[r.cell] = r.r, -(-r.n // per_shard)
    first = np.cumsum(parts) - parts
    cells = F.broadcast(
        spark.createDataFrame(
            [(c, int(parts[c]), int(first[c])) for c in range(len(pivots))], "cell int, parts bigint, first bigint"
        )
    )
    shards = placed.join(cells, "cell").select("vec_id", "v", (F.col("first") + F.pmod("salt", "parts")).alias("shard"))

    asked = stored(
        rows.where("asks")
        .select(F.col("v").alias("q"))
        .distinct()
        .withColumn("qid", F.monotonically_increasing_id())  # any number will do; frozen by the write
        .mapInArrow(lambda b: to_cell(b, 0), "q array<double>, qid bigint, cell int, away double, salt bigint")
        .drop("away"),
        "asked",
    )
    blocks = max(1, -(-asked.count() // per_shard))
    asked = asked.withColumn("block", F.pmod("salt", F.lit(blocks)).cast("int"))
    none = F.lit(None).cast("bigint")
    at_home = asked.join(cells, "cell").select(
        "qid", "q", F.col("first").alias("shard"), "block", none.alias("floor"), none.alias("floor_id")
    )
    home = stored(search_shards(shards, at_home, dim, wanted, blocks), "home")
    kth = F.when(F.size("top") == wanted, F.col("top")[wanted - 1])
    floors = best_of(home, wanted).select(
        F.col("qid"), kth["score"].alias("floor"), F.coalesce(kth["vec_id"], F.lit(int(LAST))).alias("floor_id")
    )

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        reach = radius + 1e-9 * (np.sqrt((p**2).sum(axis=1)) + radius)  # room for rounding
        for whole in batches:
            for begin in range(0, whole.num_rows, 64):
                batch = whole.slice(begin, 64)
                q = matrix(batch.column(1), dim)
                floor = np.array([-np.inf if x is None else x for x in batch.column(4).to_pylist()], np.float64)
                bound = q @ p.T + np.sqrt((q**2).sum(axis=1))[:, None] * reach
                row, cell = np.nonzero((bound >= floor[:, None]) & (parts > 0))
                n = parts[cell]
                to = np.repeat(first[cell] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                row = np.repeat(row, n)
                new = to != first[np.asarray(batch.column(2))[row]]  # the home shard is done
                many = batch.select(["qid", "q", "block", "floor", "floor_id"]).take(pa.array(row[new]))
                yield pa.RecordBatch.from_arrays([*many.columns, pa.array(to[new], pa.int64())], [*many.schema.names, "shard"])

    further = (
        asked.join(floors, "qid", "left")
        .select("qid", "q", "cell", "block", "floor", "floor_id")
        .mapInArrow(to_shards, "qid bigint, q array<double>, block int, floor bigint, floor_id bigint, shard bigint")
    )
    top = best_of(home.unionByName(search_shards(shards, further, dim, wanted, blocks)), wanted)
    answers = asked.select("qid", "q").join(top, "qid")
    mine = F.array_position(F.transform("top", lambda x: x["same"] & x["vec_id"].eqNullSafe(F.col("query_id"))), True)
    others = F.when(
        mine > 0, F.filter("top", lambda x: x["r"] != mine)
    ).otherwise(F.slice("top", 1, k))
    return (
        rows.where("asks")
        .select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        .join(answers, "q")
        .select("query_id", F.posexplode(others).alias("pos", "hit"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
    )
