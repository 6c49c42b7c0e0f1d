"""Readers by what a URL looks like. The schema is inferred once, at attach, and kept."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import FunctionRegistry, function_scan
from .files import Files, real


class Described(NamedTuple):
    schema: T.StructType
    version: str
    num_rows: int | None
    bytes: int | None
    multi_line: bool | None = None


def kind_of(url: str) -> str:
    """csv, function, json or parquet."""
    if url.startswith("function://"):
        return "function"
    path = url.rstrip("/")
    for ending, kind in ((".csv", "csv"), (".json", "json"), (".jsonl", "json"), (".parquet", "parquet")):
        if path.endswith(ending):
            return kind
    raise ValueError(f"No reader found for {url}")


def function_name(url: str) -> str:
    return url.removeprefix("function://").split("/")[0].split("?")[0]


def _widened(schema: T.StructType) -> T.StructType:
    """Inferred whole numbers are 64 bits wide, and times have no zone."""

    def wide(kind: T.DataType) -> T.DataType:
        return T.LongType() if isinstance(kind, T.IntegerType) else T.TimestampNTZType() if isinstance(kind, T.TimestampType) else kind

    return T.StructType([T.StructField(f.name, wide(f.dataType), True) for f in schema])


def spans_lines(spark: SparkSession, url: str) -> bool:
    """Whether a record of a CSV source has a quoted line end: then some line has an odd number of quotes."""
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(real(url)).where(odd % 2 == 1).limit(1).count() > 0


def scan(spark: SparkSession, url: str, schema: T.StructType | None, functions: FunctionRegistry, files: list[str] | None = None, multi_line: bool | None = None) -> DataFrame:
    """The rows behind a URL. files: only these of a folder's files. multi_line: a CSV source's records may have
    quoted line ends, so each file is read by one task."""
    kind = kind_of(url)
    if kind == "function":
        return function_scan(spark, function_name(url), functions)
    reader = spark.read if schema is None else spark.read.schema(schema)
    at = files or [real(url)]
    if kind == "csv":
        # where lines are records, a large file is read by many tasks
        reader = reader.options(header=True, quote='"', escape='"', enforceSchema=True, multiLine=bool(multi_line))
        return (reader if schema is not None else reader.option("inferSchema", True)).csv(at)
    if kind == "json":
        return reader.json(at)
    return reader.parquet(*at)


def _json_order(spark: SparkSession, url: str, schema: T.StructType) -> T.StructType:
    """Columns as the first object names them; Spark's inference sorts them."""
    first = spark.read.text(real(url)).where("trim(value) <> ''").first()
    order = list(json.loads(first.value)) if first else []
    by = {f.name: f for f in schema}
    return T.StructType([by[n] for n in order if n in by] + [f for f in schema if f.name not in order])


def describe(spark: SparkSession, url: str, functions: FunctionRegistry) -> Described:
    """Schema, version and sizes of a source. A missing file or function is an error here."""
    kind = kind_of(url)
    if kind == "function":
        schema, version, _ = functions.need(function_name(url))
        return Described(schema, version, None, None)
    version, size = Files(spark).version(url)
    multi_line = spans_lines(spark, url) if kind == "csv" else None
    found = scan(spark, url, None, functions, None, multi_line)
    schema = found.schema
    if kind != "parquet":
        schema = _widened(schema)
    if kind == "json":
        schema = _json_order(spark, url, schema)
    schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])
    rows = scan(spark, url, schema, functions, None, multi_line).agg(F.count("*")).first()[0]
    return Described(schema, version, rows, size, multi_line or None)
