"""Spark session settings and materialisation in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelsift", **extra: str) -> SparkSession:
    """Session with the settings the operators are written for.

    Hour and weekday features depend on the session zone, hence UTC. Adaptive
    execution resizes shuffles and splits skewed join partitions, also where the
    next operator would have liked to reuse the partitioning.
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="panelsift-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path below the shared folder for an intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/panelsift/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame to a table in the shared folder and read it from there.

    Used where a frame feeds several later jobs or where two branches of a plan
    must see the very same rows. The table is columnar, so later steps read only
    what they need and know its size; a lost executor costs a re-read only.
    """
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, column: str) -> DataFrame:
    """Like ``materialise``, with the rows of one value of ``column`` in one bucket.

    Grouping and windows by that column and any others then work on the table as it
    lies, without another shuffle. The rows should come with few values of the column in
    a task, since a task writes a file for each bucket it meets.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "bucketed")
    name = f"panelsift_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    # the frame knows files and buckets by now; dropping an external table keeps its files
    spark.sql(f"DROP TABLE {name}")
    return table
