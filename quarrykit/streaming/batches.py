"""Results batch by batch, as Arrow makes them on the executors: one partition's rows at a time are on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def stream_batches(df: DataFrame, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Record batches in partition order, without holding the whole result."""
    schema = to_arrow_schema(df.schema)
    if not len(schema):
        return

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as arrow

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                sink = arrow.BufferOutputStream()
                with arrow.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, size))
                yield arrow.RecordBatch.from_arrays([arrow.array([sink.getvalue().to_pybytes()], arrow.binary())], ["batch"])

    # names may repeat, which Arrow's way through Python doesn't allow
    numbered = df.toDF(*(f"c{i}" for i in range(len(schema))))
    for row in numbered.mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=True):
        with pa.ipc.open_stream(row.batch) as stream:
            for batch in stream:
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema)


class RecordBatchStream:
    """next_batch() until None, or iteration, or collect_all()."""

    def __init__(self, df: DataFrame):
        self._df, self._batches = df, None

    @property
    def schema(self) -> pa.Schema:
        return to_arrow_schema(self._df.schema)

    def is_empty(self) -> bool:
        return False

    def next_batch(self) -> pa.RecordBatch | None:
        if self._batches is None:
            self._batches = stream_batches(self._df)
        return next(self._batches, None)

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        while (b := self.next_batch()) is not None:
            yield b

    def collect_all(self) -> list[pa.RecordBatch]:
        return list(self)
