"""SQL type names accepted by the DDL helper and the Spark types that store them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Type names of the accepted dialect. Unsigned types take the next wider signed type,
# character types drop their length, NUMERIC is a double, and TIME is kept as ISO text because
# parquet tables cannot hold Spark's time type.
SQL_TYPES: dict[str, T.DataType] = {
    "BOOLEAN": T.BooleanType(),
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "TINYINT UNSIGNED": T.ShortType(),
    "SMALLINT UNSIGNED": T.IntegerType(),
    "INT UNSIGNED": T.LongType(),
    "BIGINT UNSIGNED": T.DecimalType(20, 0),
    "REAL": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "NUMERIC": T.DoubleType(),
    "CHAR": T.StringType(),
    "NVARCHAR": T.StringType(),
    "VARCHAR": T.StringType(),
    "TEXT": T.StringType(),
    "STRING": T.StringType(),
    "BINARY": T.BinaryType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "TIME": T.StringType(),
}


class UnknownType(ValueError):
    """The DDL names a type that no column can have."""


def spark_type(name: str) -> T.DataType:
    """The Spark type of a SQL type name; a length or precision in parentheses is dropped."""
    bare = re.sub(r"\([^)]*\)", " ", name)
    key = " ".join(bare.upper().split())
    if key not in SQL_TYPES:
        raise UnknownType(f"unsupported SQL type: {name}")
    return SQL_TYPES[key]
