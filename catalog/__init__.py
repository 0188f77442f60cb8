"""Every operator as a query over the given tables, with SQL to check it against."""

from pyspark.sql import DataFrame, SparkSession

from catalog.base import REGISTRY, Inputs
from catalog import features, modelling, profiles, pull, testing  # noqa: E402,F401  (registers queries)


def run_query(name: str, spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return REGISTRY[name].run(Inputs(spark, folder))
