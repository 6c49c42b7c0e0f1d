"""Functions that generate rows: a name, declared columns, and pages of record batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class StaticPages:
    """Record batches as the pages of a function."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.batches = list(batches)

    def __call__(self, page: int, schema: pa.Schema) -> pa.RecordBatch | None:
        return self.batches[page] if page < len(self.batches) else None


class FunctionRegistry:
    """Signatures are saved with the dataset; implementations are given anew in each process."""

    def __init__(self) -> None:
        self.signatures: dict[str, tuple[StructType, str]] = {}
        self.implementations: dict[str, Callable[..., Any]] = {}

    def copy(self) -> FunctionRegistry:
        out = FunctionRegistry()
        out.signatures, out.implementations = dict(self.signatures), dict(self.implementations)
        return out

    def need(self, name: str) -> tuple[StructType, str, Callable[..., Any]]:
        if not name:
            raise ValueError("No function specified")
        if name not in self.signatures:
            raise ValueError(f"Unknown function: {name}")
        if name not in self.implementations:
            raise ValueError(f"Function implementation not set for: {name}")
        return *self.signatures[name], self.implementations[name]


def pages(func: Callable[..., Any], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pages 0, 1, 2 … until the function gives None, as batches of the declared columns."""
    number = 0
    while (page := func(page=number, schema=schema)) is not None:
        for batch in page.to_batches() if isinstance(page, pa.Table) else [page]:
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in schema], schema=schema)
        number += 1


def function_scan(spark: SparkSession, name: str, registry: FunctionRegistry) -> DataFrame:
    """The function's rows, pulled page by page by one task when the plan runs; the driver holds none."""
    schema, _, func = registry.need(name)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from pages(func, arrow)
            return

    return spark.range(0, 1, 1, 1).mapInArrow(run, schema)
