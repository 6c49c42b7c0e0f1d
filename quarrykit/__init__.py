"""PySpark-native, versioned data pipelines: an ordered log of operations over attached sources, run by Catalyst."""

from .dataset import Context, Dataset, DatasetBuilder, Status, create, open
from .functions.registry import StaticPages
from .metrics import log_metrics, metrics, set_log_level
from .progress import set_callback as set_progress_callback
from .session import dataset_session
from .sources.files import random_memory_url
from .streaming.batches import RecordBatchStream


def stream_batches(dataset, size: int = 8192):
    """A dataset's rows as record batches, a partition at a time."""
    from .streaming.batches import stream_batches as stream

    return stream(dataset.dataframe, size)


def to_pandas(dataset):
    return dataset.to_pandas()


def to_polars(dataset):
    return dataset.to_polars()


def to_numpy(dataset):
    return dataset.to_numpy()


def to_dict(dataset):
    return dataset.to_dict()


__all__ = [
    "Context", "Dataset", "DatasetBuilder", "RecordBatchStream", "StaticPages", "Status", "create", "dataset_session", "log_metrics", "metrics", "open",
    "random_memory_url", "set_log_level", "set_progress_callback", "stream_batches", "to_dict", "to_numpy", "to_pandas", "to_polars",
]
