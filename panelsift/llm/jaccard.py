"""N-gram Jaccard join by PartEnum signatures, and its connected components.

Sets are five-word shingles; two link when their Jaccard similarity is 0.8 or more. Rows
with equal sets form one class, so copies never meet each other. Sizes are cut into
bands of ratio 1.25: linked sets lie in one band or in neighbouring ones, and differ in
at most a known number k of shingles. PartEnum cuts the shingle domain into k + 1
partitions, of which at least one then holds the same shingles in both sets; the part of
a set in one partition is a signature, and linked sets share one.

Two things would break that in practice, and both have an exact way out:

* A partition that is empty in both sets agrees as well but tells nothing. A set with
  more than k filled partitions is safe; one that is not also enters with prefix
  signatures (single shingles in a global order, of which linked sets share one).
* A passage in very many texts fills partitions alone and makes huge buckets. Shingles
  common in a sample of classes are left out of the domain: what remains differs in no
  more than k, so the argument stands, and texts made of little else are not safe and
  use prefixes, rarest shingles first. The sample guides the cost, never the result.

Signatures are packed into blocks per signature range before the shuffle; a signature
that several classes of one task share is sent once, with the rest noted beside it. In
buckets, members are compared with few pivots, in rounds: what is in one component
already needs no more comparing, and buckets that stay mixed are compared in full.
A pair is first held against sketches, which rule out without error, and what they
leave is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsift.llm.common import bounded_batches, give_back, stored
from panelsift.llm.shingles import mix, shared, shingle_sets

#: Similarity as hundredths, so that all bounds are whole numbers.
PERCENT = 80
#: Classes sampled for common shingles, and sampled classes a common shingle is in.
SAMPLE_CLASSES = 5_000
COMMON_IN = 3
#: Pivots of a bucket of more than LARGE classes that still holds several components.
PIVOTS = 4
LARGE = 256
#: Rows of a bucket that one task compares.
BLOCK_ROWS = 2048
FLUSH_ENTRIES = 400_000
#: Tasks that the buckets of one least class are dealt to, and pairs a task remembers.
TASKS_OF_A_LEAD = 16
REMEMBERED_PAIRS = 100_000
#: Fewest places of the sketches that rule pairs out; a power of two.
MIN_PLACES = 512
#: Candidate ids are sent to all tasks up to this many; beyond it they are joined.
SEND_IDS = 4_000_000


def bands(limit: int = 1 << 40) -> np.ndarray:
    """Upper sizes of the bands: each reaches from the last one's end + 1 to 1.25 times that."""
    tops, low = [], 1
    while low < limit:
        tops.append(low * 100 // PERCENT)
        low = tops[-1] + 1
    return np.array(tops, np.int64)


TOPS = bands()


def differences(instance: int) -> int:
    """Most shingles in which linked sets of a band, or of it and the next, can differ."""
    top = int(TOPS[instance])
    return (top + top * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)


def instances(size: int) -> list[int]:
    """Bands whose join a set of this size takes part in: its own, and as partner the one below."""
    own = int(np.searchsorted(TOPS, size))
    if own and size * PERCENT <= int(TOPS[own - 1]) * 100:
        return [own, own - 1]
    return [own]


def class_of(shingles: np.ndarray) -> int:
    """Number of the class of equal sets: 64 bits of the sum of mixed hashes and the size."""
    with np.errstate(over="ignore"):
        whole = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(shingles))
    return int(mix(whole).view(np.int64)[0])


def parity(shingles: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each of at least twice as many places.

    Sets that differ in d shingles differ in at most d places, so sketches can rule a
    pair out, never wrongly. A sketch's halves, one over the other, are the sketch of
    half as many places.
    """
    places = max(MIN_PLACES, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else MIN_PLACES
    at = (mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8)).tobytes()


def halved(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches folded to so many words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def unlike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places in which rows of sketches differ, at the coarser of two sizes."""
    words = min(x.shape[1], y.shape[1])
    return np.bitwise_count(halved(x, words) ^ halved(y, words)).sum(axis=1).astype(np.int64)


def possible(differ: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes together can link with so many places different."""
    return differ * (100 + PERCENT) <= total * (100 - PERCENT)


def partition_signatures(rare: np.ndarray, instance: int) -> np.ndarray:
    """One signature per filled partition. Hashes are sorted, so partitions are runs."""
    parts = differences(instance) + 1
    number = ((rare >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.ones(len(rare), bool)
    first[1:] = number[1:] != number[:-1]
    begin = np.nonzero(first)[0]
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mix(rare), begin)
        return mix(sums + number[begin] * np.uint64(0xD1342543DE82EF95) + np.uint64(instance + 1))


def prefix_signatures(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The rarest shingles, as many as linked sets must share one of."""
    keep = len(shingles) - -(-len(shingles) * PERCENT // 100) + 1
    at = np.minimum(np.searchsorted(common, shingles), max(len(common) - 1, 0))
    known = common[at] == shingles if len(common) else np.zeros(len(shingles), bool)
    order = np.lexsort((shingles, known))
    return mix(shingles[order[:keep]] ^ np.uint64(0xA0761D6478BD642F))


def signatures(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """All signatures of one set; sets below four shingles link with equal sets only."""
    if len(shingles) < 4:
        return np.zeros(0, np.uint64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rare = shingles[common[at] != shingles]
    else:
        rare = shingles
    out, safe = [], True
    for instance in instances(len(shingles)):
        own = partition_signatures(rare, instance) if len(rare) else np.zeros(0, np.uint64)
        safe &= len(own) > differences(instance)
        out.append(own)
    if not safe:
        out.append(prefix_signatures(shingles, common))
    return np.concatenate(out)


def classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: id, n_shingles, cls and sketch."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number, sketch = [], [], []
            for s in shingle_sets(batch.column(1)):
                size.append(len(s))
                number.append(class_of(s))
                sketch.append(parity(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(number, pa.int64()), pa.array(sketch, pa.binary())],
                ["id", "n_shingles", "cls", "sketch"],
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"id {kind}, n_shingles bigint, cls bigint, sketch binary")


def common_shingles(docs: DataFrame, text: str, n_classes: int) -> np.ndarray:
    """Shingles found in several of a bounded number of sampled classes, sorted."""
    bounded_batches(docs.sparkSession)
    share = min(1.0, SAMPLE_CLASSES / max(n_classes, 1))
    limit = int(share * 2**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                c = class_of(s)
                if len(s) and (c & (2**63 - 1)) <= limit:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), c), pa.int64()), pa.array(s.view(np.int64))], ["cls", "s"]
                    )

    rows = docs.select(text).where(F.length(text) > 0).mapInArrow(run, "cls bigint, s bigint")
    # distinct (class, shingle), then classes per shingle, in one shuffle by shingle
    found = rows.groupBy("s", "cls").agg(F.lit(1).alias("one")).groupBy("s").agg(F.count("*").alias("n"))
    batch = found.where(F.col("n") >= COMMON_IN).select("s").toPandas()
    return np.sort(batch["s"].to_numpy(np.int64).view(np.uint64))


def shared_buckets(docs: DataFrame, text: str, common: np.ndarray, parts: int) -> DataFrame:
    """(sig, cls) of every signature that at least two classes have."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(common)
    ranges = 4 * parts

    def pack(sig: np.ndarray, cls: np.ndarray, kind: int, salt: int) -> pa.RecordBatch | None:
        if not len(sig):
            return None
        if kind:  # known to be shared already: any task can pass them on
            where = np.array([0, len(sig)])
            target = np.array([salt % ranges])
        else:
            number = ((sig >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            where = np.append(np.nonzero(np.append(True, number[1:] != number[:-1]))[0], len(sig))
            target = number[where[:-1]].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(target, pa.int32()),
                pa.array(np.full(len(target), kind), pa.int32()),
                pa.array([sig[a:b].tobytes() for a, b in zip(where[:-1], where[1:])], pa.binary()),
                pa.array([cls[a:b].tobytes() for a, b in zip(where[:-1], where[1:])], pa.binary()),
            ],
            ["p", "kind", "sig", "cls"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common_here, salt = sent.value, TaskContext.get().partitionId()
        seen: set[int] = set()
        sigs, owners, size = [], [], 0

        def flush():
            sig, cls = np.concatenate(sigs), np.repeat(np.array(owners, np.int64), [len(s) for s in sigs])
            order = np.lexsort((cls, sig))
            sig, cls = sig[order], cls[order]
            fresh = np.append(True, sig[1:] != sig[:-1])
            distinct = fresh | np.append(True, cls[1:] != cls[:-1])
            sig, cls, fresh = sig[distinct], cls[distinct], fresh[distinct]
            several = np.zeros(len(sig), bool)  # of a signature with several classes here
            several[:-1] = ~fresh[1:]
            several |= ~fresh
            for batch in (pack(sig[fresh], cls[fresh], 0, salt), pack(sig[several], cls[several], 1, salt)):
                if batch is not None:
                    yield batch

        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                c = class_of(s)
                if len(s) < 4 or c in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(c)  # copies within a task are not sent again
                own = signatures(s, common_here)
                sigs.append(own)
                owners.append(c)
                size += len(own)
                if size >= FLUSH_ENTRIES:
                    yield from flush()
                    sigs, owners, size = [], [], 0
        if sigs:
            yield from flush()
        del sigs, owners, seen
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners = [], []
        for batch in batches:
            for kind, sig, cls in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                sig, cls = np.frombuffer(sig, np.uint64), np.frombuffer(cls, np.int64)
                if kind:
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cls)], ["sig", "cls"])
                else:
                    sigs.append(sig)
                    owners.append(cls)
        if sigs:
            sig, cls = np.concatenate(sigs), np.concatenate(owners)
            order = np.lexsort((cls, sig))
            sig, cls = sig[order], cls[order]
            fresh = np.append(True, sig[1:] != sig[:-1])
            number = np.cumsum(fresh) - 1
            first = np.nonzero(fresh)[0]
            # shared if a signature's first and last class differ
            last = np.append(first[1:], len(sig)) - 1
            several = (cls[first] != cls[last])[number]
            distinct = several & (fresh | np.append(True, cls[1:] != cls[:-1]))
            sig, cls = sig[distinct], cls[distinct]
            for k in range(0, len(sig), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[k : k + 100_000].view(np.int64)), pa.array(cls[k : k + 100_000])], ["sig", "cls"]
                )

    blocks = docs.select(text).mapInArrow(emit, "p int, kind int, sig binary, cls binary")
    return blocks.repartition(parts, "p").mapInArrow(meet, "sig bigint, cls bigint").distinct()


def sets_of(docs: DataFrame, text: str, wanted: DataFrame, key: str) -> DataFrame:
    """(cls, sh), the whole set of each wanted (cls, id): only those rows' texts are hashed.

    Ids up to SEND_IDS are sent to all tasks; more are joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, content = [], []
            for s in shingle_sets(batch.column(1)):
                number.append(class_of(s))
                content.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(content, pa.binary())], ["cls", "sh"])

    ids = wanted.select("id")
    ids = F.broadcast(ids) if wanted.count() <= SEND_IDS else ids
    rows = docs.select(F.col(key).alias("id"), text).join(ids, "id", "left_semi").select("id", text)
    # an id may be on several rows, with one text or more
    return rows.mapInArrow(run, "cls bigint, sh binary").join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            total = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            sizes = np.array([(len(a), len(b)) for a, b in zip(x, y)])
            keep = np.zeros(batch.num_rows, bool)
            for a, b in np.unique(sizes, axis=0):
                at = np.nonzero((sizes == (a, b)).all(axis=1))[0]
                left, right = (
                    np.frombuffer(b"".join([side[k] for k in at]), np.uint64).reshape(len(at), -1) for side in (x, y)
                )
                keep[at] = possible(unlike(left, right), total[at])
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sketches.select(F.col("cls").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("cls").alias("b"), F.col("n_shingles").alias("m"), F.col("sketch").alias("y"))
    near = (F.col("n") * 100 >= F.col("m") * PERCENT) & (F.col("m") * 100 >= F.col("n") * PERCENT)
    met = pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "n", "x", "m", "y")
    return met.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = shared(x, y)
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cls").alias("a"), F.col("sh").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("sh").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return met.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(cls, comp) for classes in links, comp the least class reachable.

    Large-star and small-star rounds on the links themselves: every round is a grouping
    on keys whose minima are combined before the shuffle, until nothing changes.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    last = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: neighbours above a node are linked to the node's least neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: neighbours below a node, and the node, to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        edges = stored(small.where("a <> b").distinct(), "links")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        if (state.n, state.h) == last:
            break
        last = state.n, state.h
    return edges.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "cls").unionByName(
        edges.select(F.col("b").alias("cls"), F.col("b").alias("comp")).distinct()
    )


def across(live: DataFrame, sketches: DataFrame, forest: bool = False) -> DataFrame:
    """Plausible pairs (a, b) of classes in one bucket (sig) but different components.

    All of them, or of each block a ``forest``: pairs that join all that its plausible
    pairs join, fewer than it has rows. A bucket that has any is named at least once. Rows of the component that most of a bucket belongs to meet only the others. A bucket
    of more than BLOCK_ROWS rows is dealt into blocks that meet pairwise in tasks of their own.
    Buckets with the same least class, mostly of one passage, go to the same few tasks,
    which give each pair they remember once.
    """
    counts = live.groupBy("sig", "comp").agg(F.count("*").alias("n"), F.min("cls").alias("lead"))
    facts = counts.groupBy("sig").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.min("lead").alias("lead")
    )
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    rows = (
        live.join(facts, "sig")
        .withColumn("lead", F.xxhash64("lead", F.pmod("sig", F.lit(TASKS_OF_A_LEAD))))
        .select("lead", "sig", "cls", "comp", (F.col("comp") == F.col("most")).alias("main"), blocks.alias("blocks"))
        .withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .join(sketches, "cls")
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "sig", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
            "cls", "comp", "main", F.col("n_shingles").alias("n"), "sketch", "lead",
        )
    )

    def pairs(table: pa.Table) -> pa.RecordBatch | None:
        cls, comp = (table.column(c).to_numpy() for c in ("cls", "comp"))
        n = table.column("n").to_numpy()
        main = table.column("main").to_numpy(zero_copy_only=False)
        sketch = table.column("sketch").to_pylist()
        width = np.array([len(x) for x in sketch])
        place = np.zeros(len(cls), np.int64)  # row of each class in the matrix of its width
        matrix = {}
        for w in np.unique(width):
            at = np.nonzero(width == w)[0]
            place[at] = np.arange(len(at))
            matrix[w] = np.frombuffer(b"".join([sketch[k] for k in at]), np.uint64).reshape(len(at), -1)
        found_a, found_b = [], []
        joined = comp.copy() if forest else comp
        for k in np.nonzero(~main)[0]:
            # a pair of others is looked at from its first row only
            rest = (joined != joined[k]) & (main | (np.arange(len(cls)) > k))
            rest &= (n * 100 >= n[k] * PERCENT) & (n[k] * 100 >= n * PERCENT)
            own = matrix[width[k]][place[k] : place[k] + 1]
            for w in np.unique(width[rest]):
                at = np.nonzero(rest & (width == w))[0]
                differ = unlike(matrix[w][place[at]], own)
                keep = possible(differ, n[at] + n[k])
                at = at[keep]
                if forest and len(at):  # the likeliest pair with each part, which then is joined
                    at = at[np.argsort(differ[keep], kind="stable")]
                    at = at[joined[at] != joined[k]]
                    parts, first = np.unique(joined[at], return_index=True)
                    at = at[first]
                    joined[np.isin(joined, parts)] = joined[k]
                found_a.append(np.minimum(cls[at], cls[k]))
                found_b.append(np.maximum(cls[at], cls[k]))
        if not found_a:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        seen: set[tuple[int, int]] = set()

        def fresh() -> Iterator[pa.RecordBatch]:
            out = pairs(pa.Table.from_batches(held)) if held else None
            if out is None or not out.num_rows:
                return
            keys = list(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
            new = [k not in seen for k in keys]
            new[0] = True  # names the bucket
            if len(seen) + len(keys) > REMEMBERED_PAIRS:  # forgotten pairs are given again
                seen.clear()
            seen.update(keys)
            out = out.filter(pa.array(new))
            sig = pa.array(np.full(out.num_rows, last[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([*out.columns, sig], ["a", "b", "sig"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("sig", "i", "j")])
            cuts = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                now = tuple(key[:, a].tolist())
                if now != last and held:
                    yield from fresh()
                    held = []
                last = now
                held.append(batch.slice(a, b - a))
        yield from fresh()

    return rows.repartition("lead", "i", "j").sortWithinPartitions("lead", "sig", "i", "j").mapInArrow(run, "a bigint, b bigint, sig bigint")


def link_classes(
    buckets: DataFrame, sketches: DataFrame, fetch: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Verified links that connect whatever any bucket links, and their components.

    Every member of a bucket meets the bucket's least; where large buckets still hold
    several components, members meet a few more pivots. What is left in one bucket but in
    different components first meets along a forest of plausible pairs, whose links join
    most of it, and then in full, unless the forest's search found that the bucket has no
    plausible pair at all. ``fetch`` gives the sets of the classes named; only
    those of plausible pairs are asked for.
    """
    links = comps = None

    def add(likely: DataFrame) -> None:
        nonlocal links, comps
        likely = stored(likely, "plausible")
        named = likely.select(F.col("a").alias("cls")).union(likely.select(F.col("b").alias("cls"))).distinct()
        new = stored(verified(likely, fetch(named)), "verified")
        links = new if links is None else links.unionByName(new)
        comps = stored(components(links), "components")

    def named_now(live: DataFrame) -> DataFrame:
        """Rows of buckets with the components so far."""
        known = live.drop("comp").join(comps, "cls", "left")
        return known.withColumn("comp", F.coalesce("comp", "cls"))

    def mixed(live: DataFrame) -> DataFrame:
        """Rows of buckets with several components, of three classes or more: pairs have met.

        A passage that many texts share makes many buckets of the very same classes; one of
        them is enough. Buckets are the same if two sums over their classes' hashes are.
        """
        named = named_now(live.select("sig", "cls"))
        several = named.groupBy("sig").agg(
            F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size"),
            F.bit_xor(F.xxhash64("cls")).alias("f"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("g"),
        )
        distinct_ = several.where("x <> y and size > 2").groupBy("size", "f", "g").agg(F.min("sig").alias("sig"))
        return stored(named.join(distinct_.select("sig", "size"), "sig"), "mixed")

    def pivots(live: DataFrame, many: int) -> DataFrame:
        group = F.pmod(F.xxhash64("cls", F.lit(many)), F.lit(many))
        pivot = live.groupBy("sig", group.alias("g")).agg(F.min("cls").alias("d"))
        pairs = live.join(pivot, "sig").where("cls <> d")
        return pairs.select(F.least("cls", "d").alias("a"), F.greatest("cls", "d").alias("b")).distinct()

    add(plausible(pivots(buckets, 1), sketches))
    live = mixed(buckets)
    large = live.where(F.col("size") > LARGE)
    if not large.isEmpty():
        add(plausible(pivots(large, PIVOTS), sketches))
        live = mixed(large).unionByName(named_now(live.where(F.col("size") <= LARGE)))
    if not live.isEmpty():
        tried = stored(across(live, sketches, forest=True), "forest")
        if not tried.isEmpty():
            add(tried.select("a", "b").distinct())
            live = mixed(live.join(tried.select("sig").distinct(), "sig", "left_semi"))
            if not live.isEmpty():
                add(across(live, sketches).select("a", "b").distinct())
    return links, comps


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles and component_id, the least key its links lead to.

    Null and empty texts, and texts without words, have no shingles, link with nothing
    and are their own component; so is a row with a null key and no text. Repeated rows
    and equal texts share a component. Only key and text are read; other columns,
    whatever their names, are not.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(key, text)
    rows = stored(classes(docs, key, text), "classes")
    members = stored(
        rows.where("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("id")), "members"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = common_shingles(docs, text, members.count())
    buckets = stored(shared_buckets(docs, text, common, parts), "buckets")
    bucketed = buckets.select("cls").distinct()
    sketches = stored(
        rows.select("cls", "n_shingles", "sketch").join(bucketed, "cls", "left_semi").dropDuplicates(["cls"]), "sketches"
    )

    def fetch(named: DataFrame) -> DataFrame:
        wanted = stored(members.join(named, "cls"), "wanted")
        return stored(sets_of(docs, text, wanted, key), "sets")

    _, comps = link_classes(buckets, sketches, fetch)
    # least key per component, and back to the rows; classes without links keep their own
    named = members.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    by_class = named.join(least, "comp").select("cls", "component_id")
    return (
        rows.join(by_class.withColumn("some", F.lit(True)), "cls", "left")
        .select(
            F.col("id").alias(key),
            "n_shingles",
            F.when((F.col("n_shingles") > 0) & F.col("some"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        )
    )
