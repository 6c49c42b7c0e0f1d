"""The library's calls are synchronous already; this module gives them under the name that says so."""

from .dataset import Dataset, DatasetBuilder, create, open
from .streaming.batches import stream_batches as _stream


def stream_batches(dataset: Dataset, size: int = 8192):
    return _stream(dataset.dataframe, size)


__all__ = ["Dataset", "DatasetBuilder", "create", "open", "stream_batches"]
