"""Counts and times of what datasets do; Spark's own metrics cover execution."""

from __future__ import annotations

import contextlib
import logging
import threading
import time
from collections import Counter
from collections.abc import Iterator

log = logging.getLogger("quarrykit")
_lock = threading.Lock()
_counts: Counter[str] = Counter()
_seconds: Counter[str] = Counter()


def set_log_level(level: str) -> None:
    log.setLevel(level.upper())


def count(name: str, n: int = 1) -> None:
    with _lock:
        _counts[name] += n


@contextlib.contextmanager
def timed(name: str) -> Iterator[None]:
    began = time.perf_counter()
    try:
        yield
    finally:
        with _lock:
            _counts[name] += 1
            _seconds[name] += time.perf_counter() - began


def metrics() -> dict[str, dict[str, float]]:
    """For each kind of event how often it happened and, where it is timed, its seconds."""
    with _lock:
        return {k: {"count": n} | ({"seconds": round(_seconds[k], 6)} if k in _seconds else {}) for k, n in sorted(_counts.items())}


def log_metrics() -> None:
    for name, values in metrics().items():
        log.info("%s %s", name, values)
