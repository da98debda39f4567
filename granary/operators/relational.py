"""Relational verbs over DataFrames.

Each verb only adds a node to the logical plan. Pushdown, pruning, join choice and top-k selection
are left to Catalyst and AQE; nothing here collects, caches or hints.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

JOIN_TYPES = ("inner", "left", "right", "full")


def scan(spark: SparkSession, table: str, projection: Sequence[str] | None = None, filters: Iterable[Column] = ()) -> DataFrame:
    """A table or view, with the columns and predicates that should reach its reader."""
    df = reduce(DataFrame.filter, filters, spark.table(table))
    return df if projection is None else df.select(*projection)


def empty(spark: SparkSession, schema: T.StructType | None = None, one_row: bool = False) -> DataFrame:
    """No rows, or a single row of NULLs; without a schema, the one-row relation behind SELECT without FROM."""
    if schema is None:
        return spark.range(1 if one_row else 0).select()
    rows = [tuple(None for _ in schema)] if one_row else []
    fields = [T.StructField(f.name, f.dataType, True) for f in schema]
    return spark.createDataFrame(rows, T.StructType(fields))


def values(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    if not rows:
        raise ValueError("VALUES needs at least one row")
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def project(df: DataFrame, *exprs: Column | str) -> DataFrame:
    return df.select(*exprs)


def rename_columns(df: DataFrame, alias: str, names: Sequence[str]) -> DataFrame:
    """``t AS alias(x, y)``."""
    if len(names) != len(df.columns):
        raise ValueError(f"{alias} names {len(names)} columns, the relation has {len(df.columns)}")
    return df.toDF(*names).alias(alias)


def filter_rows(df: DataFrame, predicate: Column | str) -> DataFrame:
    """WHERE or HAVING: rows for which the predicate is TRUE."""
    return df.filter(predicate)


def aggregate(df: DataFrame, group: Sequence[Column | str], aggs: Sequence[Column], having: Column | str | None = None) -> DataFrame:
    """Grouped aggregation; without group expressions one row, even for empty input."""
    if not group and not aggs:
        raise ValueError("an aggregate needs a group or an aggregate expression")
    if group and not aggs:
        out = df.select(*group).distinct()
    else:
        out = df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)
    return out if having is None else out.filter(having)


def sort(df: DataFrame, *keys: Column | str, fetch: int | None = None) -> DataFrame:
    """Global order; with ``fetch`` Catalyst plans a top-k instead of a full sort."""
    out = df.orderBy(*keys)
    return out if fetch is None else out.limit(fetch)


def limit(df: DataFrame, fetch: int | None = None, skip: int = 0) -> DataFrame:
    if skip < 0 or (fetch is not None and fetch < 0):
        raise ValueError("LIMIT and OFFSET take non-negative integers")
    out = df.offset(skip) if skip else df
    return out if fetch is None else out.limit(fetch)


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join on any condition. A condition that is NULL does not match."""
    if how not in JOIN_TYPES:
        raise ValueError(f"unsupported join type: {how}")
    return left.join(right, on, how)


def join_using(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named columns, which come first and once, coalesced for outer joins."""
    if how not in JOIN_TYPES:
        raise ValueError(f"unsupported join type: {how}")
    if not keys:
        raise ValueError("USING needs at least one column")
    return left.join(right, list(keys), how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """USING over the common column names; without any, every pair of rows, as SQL defines it."""
    other = {c.lower() for c in right.columns}
    common = [c for c in left.columns if c.lower() in other]
    return join_using(left, right, common, how) if common else cross_join(left, right)


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """The CROSS JOIN of SQL. Give it a join condition wherever the query has one."""
    return left.crossJoin(right)
