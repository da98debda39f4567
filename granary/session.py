"""A session: databases, tables, and SQL statements one at a time."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from granary.sources.ddl import TableStore
from granary.sql_text import check_joins, without_aggregate_order

DEFAULT_DATABASE = "master"  # fixed value: the name of the database that a session starts in
_CREATE = re.compile(r"\s*create\s+table\s+(if\s+not\s+exists\s+)?([\w.`]+)\s*\((.*)\)\s*;?\s*$", re.I | re.S)
_INSERT = re.compile(r"\s*insert\s+into\s+(?:table\s+)?([\w.`]+)\s*(?:\(([^()]*)\)\s*)?((?:values|select|with)\b.*?);?\s*$", re.I | re.S)


def split_columns(body: str) -> list[str]:
    """Column definitions, split at commas outside parentheses."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(body[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, body[start:]]]


class EngineSession:
    """Wraps a SparkSession with a default database and strict DDL and DML.

    CREATE TABLE maps portable type names to Spark's and INSERT enforces NOT NULL. A join without a
    condition is an error unless it says CROSS, and aggregates may have an ORDER BY. Every other
    statement is Spark SQL as it is, so nothing is parsed and then ignored.
    """

    def __init__(self, spark: SparkSession, database: str = DEFAULT_DATABASE) -> None:
        self.spark = spark.newSession()
        self.session_id = str(uuid.uuid4())
        self.started = time.time()
        self.store = TableStore(self.spark)
        self.register_database(database)
        self.spark.sql(f"USE `{database}`")
        self.database = database

    def sql(self, statement: str) -> DataFrame:
        if m := _CREATE.match(statement):
            return self._create(m[2], m[3], bool(m[1]))
        if m := _INSERT.match(statement):
            columns = None if m[2] is None else [c.strip().strip("`\"") for c in m[2].split(",")]
            return self.store.insert(m[1], self._query(m[3]), columns)
        return self._query(statement)

    def _query(self, statement: str) -> DataFrame:
        check_joins(statement)
        return self.spark.sql(without_aggregate_order(statement))

    def run(self, statement: str) -> list:
        return self.sql(statement).collect()

    def explain(self, statement: str) -> str:
        return self._query(f"EXPLAIN FORMATTED {statement}").first()[0]

    def _create(self, name: str, body: str, if_not_exists: bool) -> DataFrame:
        columns = []
        for part in split_columns(body):
            m = re.match(r"(`[^`]+`|\"[^\"]+\"|\w+)\s+(.*?)(\s+not\s+null|\s+null)?$", part, re.I | re.S)
            if not m:
                raise ValueError(f"cannot read the column definition: {part}")
            columns.append((m[1].strip("`\""), m[2], not (m[3] or "").strip().lower().startswith("not")))
        self.store.create(name, columns, if_not_exists)
        return self.spark.createDataFrame([], "result string")

    def register_table(self, name: str, df: DataFrame) -> None:
        """Names a DataFrame made by this session's ``spark``."""
        df.createOrReplaceTempView(name)

    def deregister_table(self, name: str) -> None:
        if not self.spark.catalog.dropTempView(name):
            self.spark.sql(f"DROP TABLE {name}")

    def register_database(self, name: str) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")

    def databases(self) -> list[str]:
        return [d.name for d in self.spark.catalog.listDatabases()]

    def tables(self, database: str | None = None) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(database or self.database) if database is None or not t.isTemporary)

    def table_exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)
