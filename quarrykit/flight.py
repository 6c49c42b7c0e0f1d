"""A dataset served by Arrow Flight, where pyarrow has it: a ticket is SQL text, the answer its rows."""

from __future__ import annotations

import pyarrow as pa

from .dataset import Dataset
from .streaming.batches import RecordBatchStream

try:
    from pyarrow import flight
except ImportError:
    flight = None


def serve(dataset: Dataset, host: str = "127.0.0.1", port: int = 50051):
    """A server that is not started yet: serve() on it blocks. Rows are sent a batch at a time."""
    if flight is None:
        raise RuntimeError("this pyarrow has no Flight")

    class Server(flight.FlightServerBase):
        def do_get(self, context, ticket):
            stream = RecordBatchStream(dataset.select(ticket.ticket.decode()).dataframe)
            return flight.GeneratorStream(stream.schema, iter(stream))

        def get_schema(self, context, descriptor):
            return flight.SchemaResult(RecordBatchStream(dataset.dataframe).schema)

        def get_flight_info(self, context, descriptor):
            sql = descriptor.command.decode() if descriptor.command else "SELECT * FROM bundle"
            schema: pa.Schema = RecordBatchStream(dataset.select(sql).dataframe).schema
            return flight.FlightInfo(schema, descriptor, [flight.FlightEndpoint(sql.encode(), [])], -1, -1)

    return Server(f"grpc://{host}:{port}")
