"""CREATE TABLE and INSERT over managed parquet tables, with the checks Spark leaves out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.types import spark_type

NOT_NULL = "granary.not_null"
# The row that acknowledges an INSERT.
RESPONSE = T.StructType([
    T.StructField("header", T.ShortType()),
    T.StructField("affected_rows", T.LongType()),
    T.StructField("last_insert_id", T.LongType()),
    T.StructField("warnings", T.IntegerType()),
    T.StructField("info", T.StringType()),
    T.StructField("session_state_info", T.StringType()),
])


class NullInNotNullColumn(ValueError):
    """An INSERT has a NULL for a column declared NOT NULL."""


class TableStore:
    """Tables of the current databases. Databases must exist before their tables."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def create(self, name: str, columns: Sequence[tuple[str, str, bool]], if_not_exists: bool = False) -> None:
        """``columns``: name, SQL type name, whether NULL is allowed."""
        seen = [c.lower() for c, _, _ in columns]
        if len(set(seen)) != len(seen):
            raise ValueError(f"duplicate column name in {name}")
        kinds = [(c, spark_type(kind), nullable) for c, kind, nullable in columns]
        body = ", ".join(f"`{c}` {kind.simpleString()}{'' if nullable else ' NOT NULL'}" for c, kind, nullable in kinds)
        required = ",".join(c for c, _, nullable in kinds if not nullable)
        guard = "IF NOT EXISTS " if if_not_exists else ""
        self.spark.sql(f"CREATE TABLE {guard}{name} ({body}) USING parquet TBLPROPERTIES ('{NOT_NULL}' = '{required}')")

    def required(self, name: str) -> set[str]:
        found = {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        return {c.lower() for c in found.get(NOT_NULL, "").split(",") if c}

    def insert(self, name: str, source: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """Append ``source`` by position of ``columns``; columns left out become NULL. Returns the response row."""
        target = self.spark.table(name).schema
        names = [f.name for f in target] if columns is None else list(columns)
        known = {f.name.lower() for f in target}
        if bad := [c for c in names if c.lower() not in known]:
            raise ValueError(f"no column {bad[0]} in {name}")
        if len({c.lower() for c in names}) != len(names):
            raise ValueError("a column is listed twice")
        if len(names) != len(source.columns):
            raise ValueError(f"INSERT has {len(source.columns)} values for {len(names)} columns")
        given = {c.lower(): i for i, c in enumerate(names)}
        plain = source.toDF(*[f"_{i}" for i in range(len(names))])
        rows = plain.select(*[
            (F.col(f"_{given[f.name.lower()]}") if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in target
        ])
        required = [f.name for f in target if f.name.lower() in self.required(name)]
        checks = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(required)]
        counts = rows.agg(F.count(F.lit(1)).alias("n"), *checks).first()
        for i, c in enumerate(required):
            if counts[f"null_{i}"]:
                raise NullInNotNullColumn(f"NULL in column {c} of {name}")
        rows.write.insertInto(name)
        return self.spark.createDataFrame([(0, counts["n"], 0, 0, "", "")], RESPONSE)
