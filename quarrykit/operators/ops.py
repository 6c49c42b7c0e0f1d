"""The operations of a dataset's log.

Each is a small record that says what it is (describe), whether it may be added now (check), what it does to
the dataset's state (apply) and, for the few that do, to its rows (rows).
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from typing import TYPE_CHECKING, Any, ClassVar

from pyspark.sql import DataFrame

from ..functions.types import from_manifest
from ..plans import sqltext
from ..plans.run import run_sql

if TYPE_CHECKING:
    from ..plans.state import State

KINDS: dict[str, type[Operation]] = {}


@dataclasses.dataclass(frozen=True)
class Operation:
    type: ClassVar[str] = ""
    on_view: ClassVar[bool] = True

    def __init_subclass__(cls, **kw: Any) -> None:
        super().__init_subclass__(**kw)
        KINDS[cls.type] = cls

    def to_dict(self) -> dict:
        return {"type": self.type} | {k: v for k, v in dataclasses.asdict(self).items() if v is not None}

    @staticmethod
    def from_dict(saved: dict) -> Operation:
        saved = dict(saved)
        kind = saved.pop("type")
        if kind not in KINDS:
            raise ValueError(f"unknown operation {kind}")
        return KINDS[kind](**saved)

    def version(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]

    def describe(self) -> str:
        raise NotImplementedError

    def check(self, state: State) -> None:
        """Raises if the operation can't be added to a dataset in this state."""

    def apply(self, state: State) -> None:
        """Changes the state; rows are changed by rows()."""

    def rows(self, df: DataFrame) -> DataFrame:
        return df

    def __str__(self) -> str:
        return self.describe()


@dataclasses.dataclass(frozen=True)
class DefinePack(Operation):
    """A list of blocks; the first one defined is the base."""

    type = "definePack"
    on_view = False
    id: str

    def describe(self) -> str:
        return f"Define pack {self.id}"

    def apply(self, state):
        state.packs[self.id] = ()
        if state.base is None:
            state.base = self.id


@dataclasses.dataclass(frozen=True)
class AttachBlock(Operation):
    """A source, with the schema and version it had when it was attached."""

    type = "attachBlock"
    on_view = False
    source: str
    version_: str
    id: str
    pack_id: str
    schema: dict | None = None
    num_rows: int | None = None
    bytes: int | None = None
    multi_line: bool | None = None

    def describe(self) -> str:
        return f"Attach {self.source}"

    def check(self, state):
        if self.pack_id not in state.packs:
            raise ValueError(f"Unknown pack {self.pack_id}")

    def apply(self, state):
        state.packs[self.pack_id] = (*state.packs[self.pack_id], self)

    def struct(self):
        return from_manifest(self.schema) if self.schema else None


@dataclasses.dataclass(frozen=True)
class Join(Operation):
    type = "join"
    name: str
    pack_id: str
    join_type: str
    expression: str

    def describe(self) -> str:
        return f"{self.join_type.capitalize()} join {self.name} on {self.expression}"

    def apply(self, state):
        state.joins[self.name] = self


@dataclasses.dataclass(frozen=True)
class Filter(Operation):
    type = "filter"
    where_clause: str
    parameters: tuple = ()

    def describe(self) -> str:
        return f"Filter: {self.where_clause}"

    def rows(self, df):
        return run_sql(df, f"SELECT * FROM bundle WHERE {self.where_clause}", list(self.parameters))


@dataclasses.dataclass(frozen=True)
class Select(Operation):
    type = "select"
    sql: str
    parameters: tuple = ()

    def describe(self) -> str:
        return f"Select: {self.sql}"

    def rows(self, df):
        return run_sql(df, sqltext.complete(self.sql), list(self.parameters))


@dataclasses.dataclass(frozen=True)
class RemoveColumns(Operation):
    """Names that don't exist are ignored."""

    type = "removeColumns"
    names: tuple

    def describe(self) -> str:
        return f"Remove column{'s' if len(self.names) > 1 else ''} {', '.join(self.names)}"

    def rows(self, df):
        return df.drop(*self.names)


@dataclasses.dataclass(frozen=True)
class RenameColumn(Operation):
    type = "renameColumn"
    old_name: str
    new_name: str

    def describe(self) -> str:
        return f"Rename column {self.old_name} to {self.new_name}"

    def check(self, state):
        if self.old_name not in state.dataframe().columns:
            raise ValueError(f"Column '{self.old_name}' not found")

    def rows(self, df):
        return df.withColumnRenamed(self.old_name, self.new_name)


@dataclasses.dataclass(frozen=True)
class SetName(Operation):
    type = "setName"
    name: str

    def describe(self) -> str:
        return f"Set name to {self.name}"

    def apply(self, state):
        state.name = self.name


@dataclasses.dataclass(frozen=True)
class SetDescription(Operation):
    type = "setDescription"
    description: str

    def describe(self) -> str:
        return f"Set description to {self.description}"

    def apply(self, state):
        state.description = self.description


@dataclasses.dataclass(frozen=True)
class SetConfig(Operation):
    type = "setConfig"
    key: str
    value: str
    url_prefix: str | None = None

    def describe(self) -> str:
        return f"Set config {self.key}" + (f" for {self.url_prefix}" if self.url_prefix else "")

    def apply(self, state):
        state.config.setdefault(self.url_prefix or "", {})[self.key] = self.value


@dataclasses.dataclass(frozen=True)
class DefineFunction(Operation):
    """The declared columns of a function source; its implementation isn't saved."""

    type = "defineFunction"
    name: str
    schema: dict
    function_version: str = "1"

    def describe(self) -> str:
        return f"Define function {self.name}"

    def apply(self, state):
        state.functions.signatures[self.name] = (from_manifest(self.schema), self.function_version)


@dataclasses.dataclass(frozen=True)
class CreateIndex(Operation):
    type = "createIndex"
    column: str
    id: str
    clustered: bool | None = None

    def describe(self) -> str:
        return f"Index column {self.column}"

    def check(self, state):
        if self.column not in state.dataframe().columns:
            raise ValueError(f"Column '{self.column}' not found")
        if self.column in state.indexes:
            raise ValueError(f"Column '{self.column}' is already indexed")

    def apply(self, state):
        state.indexes[self.column] = (self.id, ())


@dataclasses.dataclass(frozen=True)
class IndexBlocks(Operation):
    """An index file: which files of these block versions hold which values of a source column. clustered: the files
    are those of a copy of the rows, sorted by the column, beside the index."""

    type = "indexBlocks"
    index_id: str
    blocks: tuple
    path: str
    source_column: str
    cardinality: int = 0
    clustered: bool | None = None

    def describe(self) -> str:
        return f"Index blocks {', '.join(self.blocks)}"

    def apply(self, state):
        for column, (key, parts) in state.indexes.items():
            if key == self.index_id:
                state.indexes[column] = (key, (*parts, self))


@dataclasses.dataclass(frozen=True)
class DropIndex(Operation):
    type = "dropIndex"
    column: str

    def describe(self) -> str:
        return f"Drop index on column {self.column}"

    def check(self, state):
        if self.column not in state.indexes:
            raise ValueError(f"No index found for column '{self.column}'")

    def apply(self, state):
        del state.indexes[self.column]


@dataclasses.dataclass(frozen=True)
class RebuildIndex(Operation):
    """Drops what an index holds; the reindex that follows in the same change builds it anew."""

    type = "rebuildIndex"
    column: str

    def describe(self) -> str:
        return f"Rebuild index on column {self.column}"

    def check(self, state):
        if self.column not in state.indexes:
            raise ValueError(f"No index found for column '{self.column}'")

    def apply(self, state):
        state.indexes[self.column] = (state.indexes[self.column][0], ())


def _no_view(state, name: str) -> None:
    if name in state.views.values():
        raise ValueError(f"View '{name}' already exists")


def _view_id(state, name: str) -> str:
    for key, known in state.views.items():
        if known == name:
            return key
    raise ValueError(f"View '{name}' not found. Available views: {', '.join(sorted(state.views.values())) or 'none'}")


@dataclasses.dataclass(frozen=True)
class CreateView(Operation):
    type = "createView"
    on_view = False
    name: str
    view_id: str

    def describe(self) -> str:
        return f"Create view {self.name}"

    def check(self, state):
        _no_view(state, self.name)

    def apply(self, state):
        state.views[self.view_id] = self.name


@dataclasses.dataclass(frozen=True)
class RenameView(Operation):
    type = "renameView"
    view_id: str
    new_name: str

    def describe(self) -> str:
        return f"Rename view {self.view_id} to {self.new_name}"

    def check(self, state):
        if self.view_id not in state.views:
            raise ValueError(f"View {self.view_id} not found")
        _no_view(state, self.new_name)

    def apply(self, state):
        state.views[self.view_id] = self.new_name


@dataclasses.dataclass(frozen=True)
class DropView(Operation):
    type = "dropView"
    on_view = False
    view_id: str

    def describe(self) -> str:
        return f"Drop view {self.view_id}"

    def check(self, state):
        if self.view_id not in state.views:
            raise ValueError(f"View {self.view_id} not found")

    def apply(self, state):
        del state.views[self.view_id]


VIEW_OPERATIONS = (CreateView, RenameView, DropView)
