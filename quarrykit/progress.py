"""Progress of long steps, told to a callback."""

from __future__ import annotations

import contextlib
import logging
from collections.abc import Callable, Iterator
from typing import Any

#: Gets (event, title, done, total, message), event one of start, update, finish.
Callback = Callable[[str, str, int, int | None, str], Any]
_callback: Callback | None = None
log = logging.getLogger("quarrykit")


def set_callback(callback: Callback | None) -> None:
    global _callback
    _callback = callback


def tqdm_callback() -> Callback:
    """Bars, where tqdm is installed."""
    from tqdm.auto import tqdm

    bars: dict[str, Any] = {}

    def tell(event: str, title: str, done: int, total: int | None, message: str) -> None:
        if event == "start":
            bars[title] = tqdm(total=total, desc=title)
        elif event == "update":
            bars[title].update(done - bars[title].n)
        elif title in bars:
            bars.pop(title).close()

    return tell


@contextlib.contextmanager
def progress(title: str, total: int | None = None) -> Iterator[Callable[[int, str], None]]:
    def tell(event: str, done: int, message: str = "") -> None:
        log.debug("%s: %s %s/%s %s", title, event, done, total, message)
        if _callback:
            _callback(event, title, done, total, message)

    tell("start", 0)
    try:
        yield lambda done, message="": tell("update", done, message)
    finally:
        tell("finish", total or 0)
