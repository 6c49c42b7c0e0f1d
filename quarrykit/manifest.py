"""The log on disk: one init file, then one file for each commit.

A commit exists from the moment that its data are renamed to ``.commit-N``, a name made from its number alone. The file
of number and hash, which others read, is written after that, and again by whoever finds that it is missing."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import posixpath
import uuid
from datetime import UTC, datetime

from .operators.ops import Operation
from .sources.files import Files

try:
    import yaml
except ImportError:  # JSON is YAML too
    yaml = None

LOG, INIT, TAKEN = "_log", f"{0:017}.yaml", ".commit-"


def dump(data: dict) -> bytes:
    return (yaml.safe_dump(data, sort_keys=False, allow_unicode=True) if yaml else json.dumps(data, ensure_ascii=False, indent=1)).encode()


def parse(data: bytes) -> dict:
    return yaml.safe_load(data) if yaml else json.loads(data)


def _plain(value):
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def _tuples(op: dict) -> dict:
    return {k: tuple(v) if isinstance(v, list) else v for k, v in op.items()}


@dataclasses.dataclass(frozen=True)
class Change:
    """What one call did: the unit of undo."""

    id: str
    description: str
    operations: tuple

    def to_dict(self) -> dict:
        return {"id": self.id, "description": self.description, "operations": [_plain(o.to_dict()) for o in self.operations]}

    @staticmethod
    def from_dict(saved: dict) -> Change:
        return Change(saved["id"], saved["description"], tuple(Operation.from_dict(_tuples(o)) for o in saved["operations"]))

    def __str__(self) -> str:
        return self.description


@dataclasses.dataclass(frozen=True)
class Commit:
    author: str
    message: str
    timestamp: str
    changes: tuple
    url: str = ""

    def to_dict(self) -> dict:
        return {"author": self.author, "message": self.message, "timestamp": self.timestamp, "changes": [c.to_dict() for c in self.changes]}

    @staticmethod
    def from_dict(saved: dict, url: str = "") -> Commit:
        return Commit(saved["author"], saved["message"], str(saved["timestamp"]), tuple(Change.from_dict(c) for c in saved.get("changes") or ()), url)


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def log_of(folder: str) -> str:
    return f"{folder.rstrip('/')}/{LOG}"


def read_init(files: Files, folder: str) -> dict:
    at = f"{log_of(folder)}/{INIT}"
    if not files.exists(at):
        raise FileNotFoundError(f"No dataset found at {folder}")
    return parse(files.read(at))


def write_init(files: Files, folder: str, init: dict) -> None:
    files.create(f"{log_of(folder)}/{INIT}", dump(init))


def read_commits(files: Files, folder: str) -> list[tuple[int, Commit]]:
    names = files.list(log_of(folder))
    taken = {int(n.removeprefix(TAKEN)): n for n in names if n.startswith(TAKEN) and n.removeprefix(TAKEN).isdigit()}
    shown = [(int(n[:5]), n) for n in names if n.endswith(".yaml") and n != INIT and n[:5].isdigit()]
    if len({n for n, _ in shown}) != len(shown):
        raise ValueError(f"two commits of {folder} have the same number")
    found = dict(shown) | taken  # what was renamed is whole; the other file may be cut off by a crash
    return [(n, Commit.from_dict(parse(files.read(f"{log_of(folder)}/{found[n]}")), folder)) for n in sorted(found)]


def write_commit(files: Files, folder: str, number: int, commit: Commit) -> str:
    """A number is taken once: of two writers the second one fails. A writer that breaks off before the rename leaves
    nothing in the way, and one that breaks off after it has committed."""
    log = log_of(folder)
    data = dump(commit.to_dict())
    beside = f"{log}/.new-{uuid.uuid4().hex}"
    files.create(beside, data)
    try:
        if any(n.startswith(f"{number:05}") and n.endswith(".yaml") and n != INIT for n in files.list(log)):
            raise FileExistsError(f"commit {number} of {folder} exists")
        files.take(beside, f"{log}/{TAKEN}{number:05}")
    except FileExistsError:
        files.delete(beside)
        raise
    name = f"{number:05}{hashlib.sha256(data).hexdigest()[:12]}.yaml"
    files.create(f"{log}/{name}", data)
    return name


def parent_url(folder: str, parent: str) -> str:
    """A parent's place; '..' is relative to the child's folder."""
    if not parent.startswith(".."):
        return parent
    scheme, sep, path = folder.partition("://")
    if not sep:
        return posixpath.normpath(posixpath.join(folder, parent))
    return f"{scheme}://{posixpath.normpath(posixpath.join(path, parent))}"
