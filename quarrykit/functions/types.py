"""Column types: the manifest's JSON and Arrow's spellings, to and from Spark's."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

SIMPLE = {
    "Null": T.NullType(),
    "Boolean": T.BooleanType(),
    "Int8": T.ByteType(),
    "Int16": T.ShortType(),
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "UInt8": T.ShortType(),
    "UInt16": T.IntegerType(),
    "UInt32": T.LongType(),
    "UInt64": T.DecimalType(20, 0),
    "Float16": T.FloatType(),
    "Float32": T.FloatType(),
    "Float64": T.DoubleType(),
    "Utf8": T.StringType(),
    "LargeUtf8": T.StringType(),
    "Utf8View": T.StringType(),
    "Binary": T.BinaryType(),
    "LargeBinary": T.BinaryType(),
    "BinaryView": T.BinaryType(),
    "Date32": T.DateType(),
    "Date64": T.DateType(),
}
NAMES = {
    "void": "Null", "boolean": "Boolean", "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32",
    "double": "Float64", "string": "Utf8", "binary": "Binary", "date": "Date32", "timestamp_ntz": "Timestamp(Microsecond, None)",
    "timestamp": 'Timestamp(Microsecond, Some("UTC"))',
}


def from_arrow_name(name: str) -> T.DataType:
    """A type by its Arrow spelling. Unsigned types widen; a time with a zone is a timestamp, without one
    timestamp_ntz; what Spark can't hold is an error."""
    name = name.strip()
    if name in SIMPLE:
        return SIMPLE[name]
    m = re.fullmatch(r"(\w+)\((.*)\)", name, re.S)
    if not m:
        raise ValueError(f"unknown type {name}")
    kind, inside = m[1], m[2].strip()
    if kind == "Timestamp":
        zone = inside.partition(",")[2].strip()
        return T.TimestampNTZType() if zone in ("", "None") else T.TimestampType()
    if kind in ("Time32", "Time64"):
        return T.TimeType() if hasattr(T, "TimeType") else T.LongType()
    if kind == "Duration":
        return T.DayTimeIntervalType()
    if kind == "Interval":
        return {"YearMonth": T.YearMonthIntervalType(), "DayTime": T.DayTimeIntervalType(), "MonthDayNano": T.CalendarIntervalType()}[inside]
    if kind in ("Decimal128", "Decimal256"):
        p, s = (int(x) for x in inside.split(","))
        if p > 38:
            raise ValueError(f"{name} has more than 38 digits")
        return T.DecimalType(p, s)
    if kind in ("List", "LargeList", "ListView"):
        return T.ArrayType(from_arrow_name(inside))
    if kind == "FixedSizeList":
        return T.ArrayType(from_arrow_name(inside.rpartition(",")[0]))
    if kind == "Struct":
        fields = []
        for part in re.findall(r"(\w+)\s*:\s*((?:[^,()]|\((?:[^()]|\([^()]*\))*\))+)", inside):
            fields.append(T.StructField(part[0], from_arrow_name(part[1])))
        return T.StructType(fields)
    raise ValueError(f"unknown type {name}")


def arrow_name(kind: T.DataType) -> str:
    simple = kind.simpleString()
    if simple in NAMES:
        return NAMES[simple]
    if isinstance(kind, T.DecimalType):
        return f"Decimal128({kind.precision}, {kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"List({arrow_name(kind.elementType)})"
    if isinstance(kind, T.StructType):
        return f"Struct({', '.join(f'{f.name}: {arrow_name(f.dataType)}' for f in kind)})"
    if isinstance(kind, T.DayTimeIntervalType):
        return "Duration(Microsecond)"
    if isinstance(kind, T.YearMonthIntervalType):
        return "Interval(YearMonth)"
    return simple


def to_manifest(schema: T.StructType) -> dict:
    return json.loads(schema.json())


def from_manifest(saved: dict) -> T.StructType:
    return T.StructType.fromJson(saved)


def output_schema(declared: dict[str, str]) -> T.StructType:
    """A function source's declared columns; all may be null."""
    return T.StructType([T.StructField(name, from_arrow_name(kind)) for name, kind in declared.items()])
