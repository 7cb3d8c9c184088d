"""SQL type names of the dialect and their Spark types, with the type families."""

from __future__ import annotations

import re

from pyspark.sql import types as T

INTEGERS = {"TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "MEDIUMINT": T.IntegerType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "SERIAL": T.IntegerType(), "BIGSERIAL": T.LongType(), "ROWID": T.LongType()}
FLOATS = {"FLOAT": T.FloatType(), "REAL": T.FloatType(), "BINARY_FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "DOUBLE_PRECISION": T.DoubleType(), "BINARY_DOUBLE": T.DoubleType()}
DECIMALS = ("DECIMAL", "NUMERIC")
STRINGS = ("CHAR", "VARCHAR", "VARCHAR2", "NCHAR", "NVARCHAR", "TEXT", "TINYTEXT", "MEDIUMTEXT", "LONGTEXT", "NTEXT", "CLOB", "NCLOB")
BINARIES = ("BINARY", "VARBINARY", "BYTEA", "BLOB", "TINYBLOB", "MEDIUMBLOB", "LONGBLOB", "IMAGE")
TIMES = {"DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "DATETIME2": T.TimestampNTZType(), "SMALLDATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_TZ": T.TimestampType(), "DATETIMEOFFSET": T.TimestampType()}
OTHERS = {"BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), **dict.fromkeys(("JSON", "JSONB", "XML", "UUID", "UNIQUEIDENTIFIER", "GEOMETRY", "GEOGRAPHY", "HIERARCHYID"), T.StringType()), "NULL": T.NullType()}
#: Ranges that are narrower than the Spark type's, and the characters a type holds at most.
RANGES = {"MEDIUMINT": (-(1 << 23), (1 << 23) - 1)}
LENGTHS = {"TINYTEXT": 255}
#: Auto-incrementing by their name.
SERIALS = ("SERIAL", "BIGSERIAL")

SPELLED = re.compile(r"\s*([A-Za-z_0-9]+(?:\s+PRECISION)?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*$", re.I)


def parse_type(text: str) -> tuple[str, T.DataType]:
    """(name, Spark type) of a type as spelled in SQL; ValueError if it isn't one."""
    m = SPELLED.match(text)
    if not m:
        raise ValueError(f"not a type: {text}")
    name = "_".join(m[1].upper().split())
    length = int(m[2]) if m[2] else None
    for table in (INTEGERS, FLOATS, TIMES, OTHERS):
        if name in table:
            return name, table[name]
    if name == "TIME":
        return name, T.TimeType(6)
    if name in DECIMALS:
        return name, T.DecimalType(length or 38, int(m[3] or 0) if length else 18)
    if name in STRINGS:
        if name in ("CHAR", "NCHAR") and length:
            return name, T.CharType(length)
        return name, T.VarcharType(length) if length and name != "TEXT" else T.StringType()
    if name in BINARIES:
        return name, T.BinaryType()
    raise ValueError(f"unknown type: {text}")


def storage_type(kind: T.DataType) -> T.DataType:
    """The type a column is stored as: bounded strings are strings, checked when written."""
    return T.StringType() if isinstance(kind, (T.CharType, T.VarcharType)) else kind


def is_integer(name: str) -> bool:
    return name.upper() in INTEGERS


def is_float(name: str) -> bool:
    return name.upper() in FLOATS


def is_numeric(name: str) -> bool:
    return is_integer(name) or is_float(name) or name.upper() in DECIMALS


def is_string(name: str) -> bool:
    return name.upper() in STRINGS


def is_binary(name: str) -> bool:
    return name.upper() in BINARIES


def is_datetime(name: str) -> bool:
    return name.upper() in TIMES or name.upper() == "TIME"


def fixed_size(name: str) -> int | None:
    """Bytes of a value where the type fixes them."""
    sizes = {"TINYINT": 1, "SMALLINT": 2, "MEDIUMINT": 3, "BOOLEAN": 1, "BOOL": 1, "UUID": 16, "UNIQUEIDENTIFIER": 16, "DATE": 4, "FLOAT": 4, "REAL": 4, "BINARY_FLOAT": 4, "INT": 4, "INTEGER": 4, "SERIAL": 4}
    name = name.upper()
    return sizes.get(name, 8 if name in INTEGERS or name in FLOATS or is_datetime(name) else None)
