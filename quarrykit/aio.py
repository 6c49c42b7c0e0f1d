"""The same calls for asyncio: chains of calls that run when they are awaited.

    data = await aio.create(path).attach("customers.csv").filter("age > $1", [21])
    frame = await data.to_pandas()
"""

from __future__ import annotations

import asyncio
import warnings
from collections.abc import AsyncIterator, Callable
from typing import Any

import pyarrow as pa

from . import dataset as sync
from .streaming.batches import stream_batches as _stream

#: Calls that give the data on: a chain goes on after them.
CHAINED = frozenset(
    """attach attach_to_join commit create_index create_view define_function drop_index drop_view extend filter index join rebuild_index
    reindex remove_column rename_column rename_view reset select set_config set_description set_impl set_name undo view""".split()
)


def _plain(value: Any) -> Any:
    return value._held if isinstance(value, AsyncDataset) else value


class Chain:
    """Calls in the order they were made. Nothing runs before await; each runs once."""

    def __init__(self, start: Callable[[], sync.Dataset], calls: tuple = ()):
        self._start, self._calls, self._used = start, calls, False

    def __getattr__(self, name: str) -> Callable[..., Chain]:
        if name not in CHAINED:
            raise AttributeError(f"{name} can't be called before the chain is awaited")

        def call(*args: Any, **kw: Any) -> Chain:
            self._used = True
            return Chain(self._start, (*self._calls, (name, args, kw)))

        return call

    def __await__(self):
        self._used = True

        def run() -> AsyncDataset:
            held = self._start()
            for name, args, kw in self._calls:
                held = getattr(held, name)(*map(_plain, args), **{k: _plain(v) for k, v in kw.items()})
            return AsyncDataset(held)

        return asyncio.to_thread(run).__await__()

    def __del__(self):
        if not self._used and self._calls:
            warnings.warn(f"a chain ending in {self._calls[-1][0]}() was never awaited", RuntimeWarning, stacklevel=2)


class AsyncDataset:
    """A dataset whose work is awaited; what it is (name, version, status, history …) is told at once."""

    TOLD = frozenset("id name description url from_url version history operations views status is_view".split())

    def __init__(self, held: sync.Dataset):
        self._held = held

    def __getattr__(self, name: str) -> Any:
        value = getattr(self._held, name) if name not in ("schema", "num_rows", "dataframe") else None
        if name in self.TOLD:
            return value
        if name in ("schema", "num_rows", "dataframe"):
            return lambda: asyncio.to_thread(getattr, self._held, name)
        if name in CHAINED:
            return lambda *args, **kw: Chain(lambda: self._held, ((name, args, kw),))
        return lambda *args, **kw: asyncio.to_thread(value, *args, **kw)


def create(path: str = "", config: dict | None = None, **kw: Any) -> Chain:
    return Chain(lambda: sync.create(path, config, **kw))


def open(path: str, config: dict | None = None, **kw: Any) -> Chain:  # noqa: A001
    return Chain(lambda: sync.open(path, config, **kw))


async def stream_batches(data: AsyncDataset, size: int = 8192) -> AsyncIterator[pa.RecordBatch]:
    batches = _stream(await data.dataframe(), size)
    while (batch := await asyncio.to_thread(next, batches, None)) is not None:
        yield batch
