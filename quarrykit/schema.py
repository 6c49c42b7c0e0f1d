"""A dataset's columns, as users see them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.types import StructField, StructType

from .functions.types import arrow_name


class Field:
    def __init__(self, field: StructField):
        self.name, self.data_type, self.nullable, self.spark_type = field.name, arrow_name(field.dataType), field.nullable, field.dataType

    def __str__(self) -> str:
        return f"{self.name}: {self.data_type}"


class Schema:
    def __init__(self, schema: StructType):
        self.spark = schema
        self.fields = [Field(f) for f in schema]

    def __len__(self) -> int:
        return len(self.fields)

    def __iter__(self) -> Iterator[Field]:
        return iter(self.fields)

    def is_empty(self) -> bool:
        return not self.fields

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise ValueError(f"Field '{name}' not found")

    def __str__(self) -> str:
        return "\n".join(f"- {f}" for f in self.fields)
