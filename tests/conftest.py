import pytest

from panelsift.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            # small tables must still span several range partitions
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Frame from a DDL schema and rows."""

    def make(schema, rows):
        return spark.createDataFrame(rows, schema)

    return make


def values(df, *names):
    """Rows as tuples in a stable order."""
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
