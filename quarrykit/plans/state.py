"""What a log of operations amounts to, and the DataFrame it folds to."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import metrics
from ..functions.registry import FunctionRegistry
from ..sources import readers
from . import pruning
from .sqltext import Token, render, significant, tokenize


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def like_first(df: DataFrame, first: T.StructType) -> DataFrame:
    """A block's rows with the columns of its pack's first block: by name if the names are the same, else by
    position if the types can be cast."""
    names = [f.name for f in first]
    if sorted(df.columns) == sorted(names):
        if df.columns == names and [f.dataType for f in df.schema] == [f.dataType for f in first]:
            return df
        return df.select(*(F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in first))
    if len(df.columns) != len(names):
        raise ValueError(f"columns {df.columns} don't fit those of the pack's first block, {names}")
    return df.toDF(*names).select(*(F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in first))


class State:
    """Packs, joins, indexes and views, after the operations so far. Copies share nothing that changes."""

    def __init__(self, spark: SparkSession, functions: FunctionRegistry | None = None):
        self.spark = spark
        self.name: str | None = None
        self.description: str | None = None
        self.base: str | None = None
        self.packs: dict[str, tuple] = {}
        self.joins: dict[str, object] = {}
        self.indexes: dict[str, tuple] = {}
        self.views: dict[str, str] = {}
        self.config: dict[str, dict[str, str]] = {}
        self.functions = functions or FunctionRegistry()
        self.operations: tuple = ()
        self.use_indexes = True
        self._df: DataFrame | None = None

    def copy(self) -> State:
        out = State(self.spark, self.functions.copy())
        out.name, out.description, out.base = self.name, self.description, self.base
        out.packs, out.joins, out.indexes, out.views = dict(self.packs), dict(self.joins), dict(self.indexes), dict(self.views)
        out.config = {k: dict(v) for k, v in self.config.items()}
        out.operations, out._df, out.use_indexes = self.operations, self._df, self.use_indexes
        return out

    def add(self, op, checked: bool = True) -> None:
        if checked:
            op.check(self)
        with metrics.timed(f"operation.{op.type}"):
            op.apply(self)
        self.operations = (*self.operations, op)
        self._df = None

    def version(self) -> str:
        """A hash over all operations' hashes; 'empty' for none."""
        if not self.operations:
            return "empty"
        return hashlib.sha256("".join(o.version() for o in self.operations).encode()).hexdigest()[:12]

    def block(self, block, found: pruning.Found | None = None) -> DataFrame:
        if found and found.copies:
            return self.spark.read.schema(block.struct()).parquet(*found.files)
        return readers.scan(self.spark, block.source, block.struct(), self.functions, found.files if found else None, block.multi_line)

    def pack(self, key: str, files: dict[str, pruning.Found] | None = None) -> DataFrame:
        """The union of a pack's blocks. files: for blocks found in an index, the files that are read."""
        blocks = self.packs[key]
        if not blocks:
            raise ValueError(f"Pack {key} has no blocks")
        first = blocks[0].struct() or self.block(blocks[0]).schema
        files = files or {}
        wanted = [b for b in blocks if b.id not in files or files[b.id].files]
        if not wanted:
            return self.block(blocks[0]).where("false")
        return reduce(DataFrame.union, [like_first(self.block(b, files.get(b.id)), first) for b in wanted])

    def _on(self, text: str, base: list[str], name: str, own: list[str]) -> str:
        """A join's condition with every column told by its side: it sees the base and this pack alone."""
        tokens = tokenize(text)
        out: list[Token] = []
        for i, t in enumerate(tokens):
            before = significant(tokens[:i])[-1:]
            after = significant(tokens[i + 1 :])[:1]
            if t.kind == "op" and t.text == "$":  # of $base
                continue
            column = t.text[1:-1] if t.kind == "name" else t.text
            if t.kind in ("word", "name") and not (before and before[0].text == ".") and not (after and after[0].text in ".("):
                side = "base" if column in base and column not in own else name if column in own and column not in base else None
                if side:
                    t = Token("name", f"{quoted(side)}.{quoted(column)}")
            elif t.kind == "name" and t.text[0] == '"':
                t = Token("name", quoted(column))
            out.append(t)
        return render(out)

    def joined(self, files: dict | None = None) -> DataFrame:
        """The base pack and, in the order they were first added, its joins."""
        df = self.pack(self.base, files)
        columns = df.columns
        df = df.alias("base")
        for join in self.joins.values():
            other = self.pack(join.pack_id)
            on = self._on(join.expression, columns, join.name, other.columns)
            df = df.join(other.alias(join.name), F.expr(on), join.join_type)
        return df

    def dataframe(self) -> DataFrame:
        """The fold of all operations; made once for each state."""
        if self._df is None:
            with metrics.timed("fold"):
                if self.base is None or not self.packs[self.base]:
                    df = self.spark.createDataFrame([], T.StructType([]))
                else:
                    df = self.joined(pruning.files_to_read(self) if self.use_indexes else None)
                for op in self.operations:
                    df = op.rows(df)
            self._df = df
        else:
            metrics.count("fold.reused")
        return self._df

    def register_tables(self) -> None:
        """Temporary views: bundle, and __pack_x and __block_x of every pack and block that has rows."""
        for key, blocks in self.packs.items():
            if blocks:
                self.pack(key).createOrReplaceTempView(f"__pack_{key}")
            for b in blocks:
                self.block(b).createOrReplaceTempView(f"__block_{b.id}")
        self.dataframe().createOrReplaceTempView("bundle")
