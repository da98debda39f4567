"""Parquet tables of a data directory, read through Spark so that any Hadoop path works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The relational tables of a data directory.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

_schemas: dict[tuple[str, int], T.StructType] = {}  # by path and time of its last change


def changed(spark: SparkSession, path: str) -> int:
    """When a file or folder last changed, by any file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf).getFileStatus(place).getModificationTime()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table; its schema is read from its files once for each state they are in."""
    path = f"{directory.rstrip('/')}/{name}.parquet"
    key = (path, changed(spark, path))
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def register_views(spark: SparkSession, directory: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        table(spark, directory, name).createOrReplaceTempView(name)
