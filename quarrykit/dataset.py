"""Datasets: a log of operations over attached sources, read-only (Dataset) or growing (DatasetBuilder)."""

from __future__ import annotations

import contextlib
import getpass
import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import export, manifest
from .functions.registry import FunctionRegistry
from .functions.types import output_schema, to_manifest
from .operators import ops
from .plans import lineage, pruning
from .plans.explain import explained
from .plans.run import run_sql
from .plans.sqltext import check_parameters
from .plans.state import State
from .progress import progress
from .session import dataset_session
from .sources import readers
from .sources.files import Files, azure_account, fresh_folder, resolve, use_account
from .schema import Schema

JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "full outer": "full"}
CONFIG_KEYS = {
    "region": "fs.s3a.endpoint.region",
    "access_key_id": "fs.s3a.access.key",
    "secret_access_key": "fs.s3a.secret.key",
    "session_token": "fs.s3a.session.token",
    "endpoint": "fs.s3a.endpoint",
    "allow_http": "fs.s3a.connection.ssl.enabled",
    "account_name": "fs.azure.account.name",
    "account_key": "fs.azure.account.key",
    "service_account_path": "google.cloud.auth.service.account.json.keyfile",
}


def new_id() -> str:
    return uuid.uuid4().hex[:16]


class Status:
    """Changes that aren't committed."""

    def __init__(self, changes: list[manifest.Change]):
        self.changes = list(changes)

    @property
    def change_count(self) -> int:
        return len(self.changes)

    @property
    def total_operations(self) -> int:
        return sum(len(c.operations) for c in self.changes)

    def is_empty(self) -> bool:
        return not self.changes

    def __str__(self) -> str:
        if not self.changes:
            return "No uncommitted changes"
        return "\n".join([f"{len(self.changes)} change(s), {self.total_operations} operation(s):", *(f"  * {c.description} ({len(c.operations)} operation(s))" for c in self.changes)])


class Dataset:
    """A dataset as it was opened. Reading it runs the log's fold as one Spark plan."""

    def __init__(self, spark: SparkSession, url: str, state: State, key: str | None, commits: list[manifest.Commit], number: int, is_view: bool = False, parent: str | None = None, config: dict | None = None, tar: str | None = None):
        self.spark, self._url, self._state, self._id = spark, url, state, key
        self._commits, self._number, self.is_view, self._parent, self._config, self._tar = list(commits), number, is_view, parent, config, tar
        state.folder = url

    # -- what it is

    @property
    def id(self) -> str | None:
        return self._id

    @property
    def name(self) -> str | None:
        return self._state.name

    @property
    def description(self) -> str | None:
        return self._state.description

    @property
    def url(self) -> str:
        return self._tar or self._url

    @property
    def from_url(self) -> str | None:
        return self._parent

    @property
    def version(self) -> str:
        return self._state.version()

    def history(self) -> list[manifest.Commit]:
        return list(self._commits)

    def operations(self) -> list[ops.Operation]:
        return list(self._state.operations)

    def views(self) -> dict[str, str]:
        return dict(self._state.views)

    # -- its rows

    @property
    def dataframe(self) -> DataFrame:
        return self._state.dataframe()

    @property
    def schema(self) -> Schema:
        return Schema(self.dataframe.schema)

    @property
    def num_rows(self) -> int:
        return self.dataframe.count() if self.dataframe.columns else 0

    def explain(self) -> str:
        return explained(self.dataframe)

    def show(self, limit: int = 10) -> list:
        return self.dataframe.limit(limit).collect()

    def ctx(self) -> Context:
        return Context(self._state)

    def select(self, sql: str, params: list | None = None) -> DatasetBuilder:
        """A new builder whose data is the query's; this one doesn't change. Nothing is analysed yet."""
        out = DatasetBuilder(self.spark, self._url, self._state.copy(), self._id, self._commits, self._number, self.is_view, self._parent, self._config, self._tar)
        out._pending = list(getattr(self, "_pending", []))
        with out._change(f"Select: {sql}"):
            out._add(ops.Select(sql, tuple(check_parameters(params))))
        return out

    # -- exports

    def as_pyarrow(self):
        return export.batches(self.dataframe)

    def as_pyarrow_stream(self):
        from .streaming.batches import RecordBatchStream

        return RecordBatchStream(self.dataframe)

    def to_pandas(self):
        return export.to_pandas(self.dataframe)

    def to_polars(self):
        return export.to_polars(self.dataframe)

    def to_numpy(self):
        return export.to_numpy(self.dataframe)

    def to_dict(self):
        return export.to_dict(self.dataframe)

    def export_tar(self, path: str) -> str:
        return export.export_tar(self.spark, self._url, path)

    # -- views and growth

    def view(self, name_or_id: str) -> Dataset:
        """A view by its name, else by its id."""
        by_name = {v: k for k, v in self._state.views.items()}
        key = by_name.get(name_or_id) or (name_or_id if name_or_id in self._state.views else None)
        if key is None:
            raise ValueError(f"View '{name_or_id}' not found. Available views: {', '.join(sorted(by_name)) or 'none'}")
        return open(f"{self._url.rstrip('/')}/view_{key}", self._config, spark=self.spark, functions=self._state.functions.implementations)

    def extend(self, data_dir: str | None = None) -> DatasetBuilder:
        """A builder on top of this: in the same folder, or in a new one whose log starts from this one's."""
        if data_dir is None or data_dir == self.url:
            return DatasetBuilder(self.spark, self._url, self._state.copy(), self._id, self._commits, self._number, self.is_view, self._parent, self._config, self._tar)
        return DatasetBuilder(self.spark, data_dir, self._state.copy(), self._id, self._commits, 0, False, self.url, self._config)


class DatasetBuilder(Dataset):
    """A dataset and the changes that aren't committed yet. Methods change it in place and return it."""

    def __init__(self, *args: Any, **kw: Any):
        super().__init__(*args, **kw)
        self._pending: list[manifest.Change] = []
        self._open: list[ops.Operation] | None = None

    @contextlib.contextmanager
    def _change(self, description: str) -> Iterator[None]:
        """One undoable change. Changes within it are part of it; on an error nothing of it stays."""
        if self._open is not None:
            yield
            return
        before, self._open = self._state.copy(), []
        before.folder = self._state.folder
        try:
            yield
            if self._open:
                self._pending.append(manifest.Change(str(uuid.uuid4()), description, tuple(self._open)))
        except BaseException:
            self._state = before
            raise
        finally:
            self._open = None

    def _add(self, op: ops.Operation) -> None:
        if self.is_view and not op.on_view:
            raise ValueError(f"'{op.type}' is not allowed on a view")
        self._state.add(op)
        self._open.append(op)

    # -- sources and joins

    def _attach(self, url: str, pack: str) -> None:
        at = resolve(url, self._url)
        with progress(f"Attaching {url}", 2) as step:
            found = readers.describe(self.spark, at, self._state.functions)
            step(1, "schema and version read")
            self._add(ops.AttachBlock(at, found.version, new_id(), pack, to_manifest(found.schema), found.num_rows, found.bytes, found.multi_line))

    def attach(self, url: str) -> DatasetBuilder:
        """Adds a source's rows to the data."""
        with self._change(f"Attach {url}"):
            if self._state.base is None:
                self._add(ops.DefinePack(new_id()))
            self._attach(url, self._state.base)
        return self

    def join(self, name: str, url: str, expression: str, join_type: str | None = None) -> DatasetBuilder:
        """Joins a source. ON sees the base columns and this source's (``$base`` and ``name`` tell them
        apart). Joins come before all other operations, in the order of their first addition."""
        with self._change(f"Join {name} from {url}"):
            pack = new_id()
            self._add(ops.DefinePack(pack))
            self._attach(url, pack)
            self._add(ops.Join(name, pack, JOIN_TYPES.get((join_type or "inner").lower(), "inner"), expression))
        return self

    def attach_to_join(self, name: str, url: str) -> DatasetBuilder:
        if name not in self._state.joins:
            raise ValueError(f"Unknown join '{name}'")
        with self._change(f"Attach {url} to join {name}"):
            self._attach(url, self._state.joins[name].pack_id)
        return self

    # -- rows and columns

    def filter(self, where_clause: str, params: list | None = None) -> DatasetBuilder:
        with self._change(f"Filter: {where_clause}"):
            self._add(ops.Filter(where_clause, tuple(check_parameters(params))))
        return self

    def remove_column(self, name: str) -> DatasetBuilder:
        with self._change(f"Remove column {name}"):
            self._add(ops.RemoveColumns((name,)))
        return self

    def rename_column(self, old_name: str, new_name: str) -> DatasetBuilder:
        with self._change(f"Rename column '{old_name}' to '{new_name}'"):
            self._add(ops.RenameColumn(old_name, new_name))
        return self

    # -- what it is

    def set_name(self, name: str) -> DatasetBuilder:
        with self._change(f"Set name to {name}"):
            self._add(ops.SetName(name))
        return self

    def set_description(self, description: str) -> DatasetBuilder:
        with self._change(f"Set description to {description}"):
            self._add(ops.SetDescription(description))
        return self

    def set_config(self, key: str, value: str, url_prefix: str | None = None) -> DatasetBuilder:
        with self._change(f"Set config {key}"):
            self._add(ops.SetConfig(key, value, url_prefix))
        configure(self.spark, self._state.config, self._config)
        return self

    # -- functions

    def define_function(self, name: str, output: dict[str, str], func: Callable | None = None, version: str = "1") -> DatasetBuilder:
        with self._change(f"Define function {name}"):
            self._add(ops.DefineFunction(name, to_manifest(output_schema(output)), version))
        return self.set_impl(name, func) if func is not None else self

    def set_impl(self, name: str, func: Callable) -> DatasetBuilder:
        """The function's implementation, for this process: func(page=, schema=) gives a record batch, or None
        after the last page."""
        self._state.functions.implementations[name] = func
        self._state._df = None
        return self

    # -- indexes

    def index(self, column: str, clustered: bool = False) -> DatasetBuilder:
        """Indexes a column: which files hold which values. clustered: the index also keeps a copy of the rows, sorted by
        the column, and lookups read that, so they skip what they don't need inside a file of any source too."""
        with self._change(f"Index column {column}"):
            self._add(ops.CreateIndex(column, new_id(), clustered or None))
            self.reindex()
        return self

    create_index = index

    def drop_index(self, column: str) -> DatasetBuilder:
        with self._change(f"Drop index on column {column}"):
            self._add(ops.DropIndex(column))
        return self

    def rebuild_index(self, column: str) -> DatasetBuilder:
        with self._change(f"Rebuild index on column {column}"):
            self._add(ops.RebuildIndex(column))
            self.reindex()
        return self

    def reindex(self) -> DatasetBuilder:
        """Builds what indexes lack: blocks that no part of an index covers at their version."""
        with self._change("Reindex"):
            for column, (key, parts) in list(self._state.indexes.items()):
                source = lineage.source_column(self._state, column)
                if source is None:
                    raise ValueError(f"Column '{column}' is computed: there is no source column to index")
                done = {b for p in parts for b in p.blocks}
                todo = [b for b in self._state.packs[self._state.base] if pruning.block_key(b) not in done and pruning.indexable(b)]
                if todo:
                    clustered = next((o.clustered for o in self._state.operations if o.type == "createIndex" and o.id == key), None)
                    with progress(f"Indexing {column}", len(todo)) as step:
                        path, found = pruning.build(self._state, todo, source, self._url, bool(clustered), step)
                    self._add(ops.IndexBlocks(key, tuple(pruning.block_key(b) for b in todo), path, source, found, clustered))
        return self

    # -- views

    def create_view(self, name: str, source: DatasetBuilder) -> DatasetBuilder:
        """Saves the source's uncommitted changes as a named view of this dataset. It is folded on top of
        this dataset's log whenever it is opened."""
        if self.is_view:
            raise ValueError("'createView' is not allowed on a view")
        held = {c.id for c in self._pending}
        captured = [c for c in source._pending if (source is self or c.id not in held) and not any(isinstance(o, ops.VIEW_OPERATIONS) for o in c.operations)]
        with self._change(f"Create view {name}"):
            key = new_id()
            self._add(ops.CreateView(name, key))
            folder, files = f"{self._url.rstrip('/')}/view_{key}", Files(self.spark)
            manifest.write_init(files, folder, {"id": self._id, "from": "../", "view": key})
            manifest.write_commit(files, folder, 1, manifest.Commit(author(), f"View {name}", manifest.now(), tuple(captured)))
        if source is self:
            kept = [c for c in self._pending if c not in captured]
            self._rebuild(kept)
        return self

    def rename_view(self, old_name: str, new_name: str) -> DatasetBuilder:
        with self._change(f"Rename view '{old_name}' to '{new_name}'"):
            self._add(ops.RenameView(ops._view_id(self._state, old_name), new_name))
        return self

    def drop_view(self, name: str) -> DatasetBuilder:
        with self._change(f"Drop view '{name}'"):
            self._add(ops.DropView(ops._view_id(self._state, name)))
        return self

    # -- the log

    def status(self) -> Status:
        return Status(self._pending)

    def commit(self, message: str) -> DatasetBuilder:
        files = Files(self.spark)
        if self._number == 0:
            manifest.write_init(files, self._url, {"id": self._id} if self._parent is None else {"id": self._id, "from": self._parent})
        commit = manifest.Commit(author(), message, manifest.now(), tuple(self._pending), self._url)
        manifest.write_commit(files, self._url, self._number + 1, commit)
        self._number += 1
        self._commits.append(commit)
        self._pending = []
        if self._tar:
            export.export_tar(self.spark, self._url, self._tar)
        return self

    def reset(self) -> DatasetBuilder:
        """Drops all uncommitted changes."""
        if not self._pending:
            raise ValueError("No uncommitted changes")
        self._rebuild([])
        return self

    def undo(self) -> DatasetBuilder:
        """Drops the last uncommitted change."""
        if not self._pending:
            raise ValueError("No uncommitted changes")
        self._rebuild(self._pending[:-1])
        return self

    def _rebuild(self, pending: list[manifest.Change]) -> None:
        functions = FunctionRegistry()
        functions.implementations = dict(self._state.functions.implementations)
        state = State(self.spark, functions)
        state.folder = self._state.folder
        for c in [*(c for commit in self._commits for c in commit.changes), *pending]:
            for op in c.operations:
                if not (self.is_view and op.type in ("createView", "renameView", "dropView")):
                    state.add(op, checked=False)
        self._state, self._pending = state, pending

    def export_tar(self, path: str) -> str:
        if self._pending:
            raise ValueError("There are uncommitted changes: commit or reset them first")
        return super().export_tar(path)


class Context:
    """Any SQL over the dataset's tables."""

    def __init__(self, state: State):
        self._state = state

    def sql(self, text: str, params: list | None = None) -> DataFrame:
        self._state.register_tables()
        return run_sql(None, text, check_parameters(params), session=self._state.spark)


def author() -> str:
    name = os.environ.get("QUARRYKIT_AUTHOR") or os.environ.get("USER")
    if name:
        return name
    try:
        return getpass.getuser()
    except (OSError, KeyError):
        return "unknown"


def configure(spark: SparkSession, stored: dict[str, dict[str, str]], passed: dict | None) -> None:
    """Storage settings: what is passed goes before what is stored. A setting for a URL prefix holds for the
    bucket that the prefix names."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for prefix, pairs in [*sorted(stored.items(), key=lambda x: len(x[0])), ("", passed or {})]:
        for key, value in sorted(pairs.items(), key=lambda x: x[0] != "account_name"):  # other settings need its value
            if isinstance(value, dict):
                configure(spark, {key: value}, None)
                continue
            name = CONFIG_KEYS.get(key, key)
            if prefix and name.startswith("fs.s3a."):
                name = name.replace("fs.s3a.", f"fs.s3a.bucket.{prefix.partition('://')[2].split('/')[0]}.")
            if key == "account_name":
                use_account(str(value))
            if key == "account_key" and azure_account():
                name = f"fs.azure.account.key.{azure_account()}.dfs.core.windows.net"
            if key == "allow_http":
                value = str(str(value).lower() != "true").lower()
            hadoop.set(name, str(value))


def create(path: str = "", config: dict | None = None, spark: SparkSession | None = None) -> DatasetBuilder:
    """An empty builder; nothing is written before a commit."""
    session = dataset_session(spark)
    configure(session, {}, config)
    tar = path if path.endswith(".tar") else None
    folder = fresh_folder() if not path or tar or path.startswith("empty:") else path
    return DatasetBuilder(session, folder, State(session), new_id(), [], 0, False, None, config, tar)


def open(path: str, config: dict | None = None, spark: SparkSession | None = None, functions: dict[str, Callable] | None = None) -> Dataset:  # noqa: A001
    """A dataset as its log says: its parents' operations first, then its own. functions: implementations of
    function sources."""
    session = dataset_session(spark)
    configure(session, {}, config)
    registry = FunctionRegistry()
    registry.implementations = dict(functions or {})
    out = _open(session, path, State(session, registry), config, ())
    configure(session, out._state.config, config)
    return out


def _open(spark: SparkSession, path: str, state: State, config: dict | None, below: tuple) -> Dataset:
    if path in below:
        raise ValueError(f"{path} extends itself: {' -> '.join([*below, path])}")
    tar = path if path.endswith(".tar") else None
    folder = export.unpack_tar(spark, path) if tar else path.rstrip("/")
    files = Files(spark)
    init = manifest.read_init(files, folder)
    is_view = "view" in init
    commits: list[manifest.Commit] = []
    parent = None
    if init.get("from"):
        parent = manifest.parent_url(folder, init["from"])
        above = _open(spark, parent, state, config, (*below, path))
        state, commits = above._state, above.history()
    if is_view:
        state.views = {}
    own = manifest.read_commits(files, folder)
    for _, commit in own:
        for change in commit.changes:
            for op in change.operations:
                state.add(op, checked=False)
        commits.append(commit)
    return Dataset(spark, folder, state, init.get("id"), commits, own[-1][0] if own else 0, is_view, parent, config, tar)
