import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def stored(spark, tmp_path):
    """Rows as a table in files, as the operators expect them."""

    def write(rows, schema, name="t"):
        path = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
        return spark.read.parquet(path)

    return write
