"""What the text operators share: reading tables, Arrow batches, scratch tables."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsift.session import scratch_path

#: Most rows and bytes of an Arrow batch; a batch of more bytes is a single long row.
BATCH_ROWS = "1000"
BATCH_BYTES = str(8 << 20)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table of a scale folder, read by Spark from whatever store it is in."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts do not fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(key: Column) -> Column:
    """True for the fold no model may learn from: crc32 of the id as text, remainder 1 of 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` with state built once per task by ``make``."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)
        del work
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the machine: workers stay alive between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column as Python strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
