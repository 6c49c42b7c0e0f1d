"""Column indexes: which files hold a value, and which files a query need not read.

An index is a Parquet table of (value, block, file, rows), sorted by value, so that a lookup reads a few row
groups. It only takes files out of a scan; the filter itself always stays, so a result never depends on it. The files
of a clustered index are those of a copy of the block's rows, dealt and sorted by the column: a lookup reads few of
them, and Parquet's own statistics skip most of each, whatever the source's format and number of files.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable
from typing import TYPE_CHECKING, Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..metrics import log
from ..sources import readers
from ..sources.files import real
from . import lineage
from .sqltext import Token, significant, split_arguments, tokenize

if TYPE_CHECKING:
    from .state import State

#: A lookup that finds more files than this, or more than this share of those indexed, isn't used.
MOST_FILES, MOST_SHARE = 10_000, 0.2
#: Bytes of a row group of a clustered copy.
ROW_GROUP = 16 << 20


class Bound(NamedTuple):
    """What a filter says of one column: one of these values, or a range with inclusive ends."""

    column: str
    values: tuple | None = None
    low: Any = None
    high: Any = None

    def on(self, value: Column) -> Column:
        if self.values is not None:
            return value.isin(*self.values)
        out = F.lit(True)
        if self.low is not None:
            out = out & (value >= self.low)
        if self.high is not None:
            out = out & (value <= self.high)
        return out


def _literal(tokens: list[Token], parameters: list) -> Any:
    """The value of a literal or parameter; None if it isn't one."""
    sign = 1
    if len(tokens) == 2 and tokens[0].text == "-":
        sign, tokens = -1, tokens[1:]
    if len(tokens) != 1:
        return None
    t = tokens[0]
    if t.kind == "string":
        return t.text[1:-1].replace("''", "'")
    if t.kind == "number":
        return sign * (float(t.text) if set(t.text) & set(".eE") else int(t.text))
    if t.kind == "param" and int(t.text[1:]) <= len(parameters):
        return parameters[int(t.text[1:]) - 1]
    return {"TRUE": True, "FALSE": False}.get(t.upper)


def _column(tokens: list[Token]) -> str | None:
    if len(tokens) == 3 and tokens[1].text == "." and tokens[0].text in ("bundle", "base"):
        tokens = tokens[2:]
    if len(tokens) != 1:
        return None
    return tokens[0].text[1:-1] if tokens[0].kind == "name" else tokens[0].text if tokens[0].kind == "word" else None


def _conjuncts(tokens: list[Token]) -> list[list[Token]]:
    """The parts of a top-level AND; nothing if there is an OR."""
    out, depth, between = [[]], 0, False
    for t in tokens:
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.upper == "OR":
            return []
        if depth == 0 and t.upper == "BETWEEN":
            between = True
        if depth == 0 and t.upper == "AND" and not between:
            out.append([])
            continue
        if depth == 0 and t.upper == "AND":
            between = False
        out[-1].append(t)
    return out


def bounds_of(where: str, parameters: list) -> list[Bound]:
    """What the clause says of single columns; what it says beyond that is left to the filter."""
    out = []
    flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}
    for part in _conjuncts(significant(tokenize(where))):
        while len(part) > 2 and part[0].text == "(" and part[-1].text == ")" and not any(t.text == ")" for t in part[1:-1]):
            part = part[1:-1]
        words = [t.upper for t in part]
        if "NOT" in words:
            continue
        for op in flip:
            if words.count(op) == 1:
                i = words.index(op)
                name, value, way = _column(part[:i]), _literal(part[i + 1 :], parameters), op
                if name is None or value is None:
                    name, value, way = _column(part[i + 1 :]), _literal(part[:i], parameters), flip[op]
                if name is not None and value is not None:
                    out.append(Bound(name, (value,)) if way == "=" else Bound(name, None, value, None) if way[0] == ">" else Bound(name, None, None, value))
        if "IN" in words and part[-1].text == ")":
            i = words.index("IN")
            values = [_literal(significant(a), parameters) for a in split_arguments(part[i + 2 : -1])]
            if _column(part[:i]) is not None and values and None not in values:
                out.append(Bound(_column(part[:i]), tuple(values)))
        if "BETWEEN" in words and words.count("AND") == 1:
            i, j = words.index("BETWEEN"), words.index("AND")
            low, high = _literal(part[i + 1 : j], parameters), _literal(part[j + 1 :], parameters)
            if _column(part[:i]) is not None and low is not None and high is not None:
                out.append(Bound(_column(part[:i]), None, low, high))
    merged: dict[str, Bound] = {}
    for b in out:
        a = merged.get(b.column)
        if a is None:
            merged[b.column] = b
        elif a.values is None and b.values is None:
            try:
                low = b.low if a.low is None else a.low if b.low is None else max(a.low, b.low)
                high = b.high if a.high is None else a.high if b.high is None else min(a.high, b.high)
            except TypeError:
                continue
            merged[b.column] = Bound(b.column, None, low, high)
        elif a.values is None:
            merged[b.column] = b
    return list(merged.values())


def block_key(block) -> str:
    return f"{block.id}@{block.version_}"


class Found(NamedTuple):
    """The files of a block that can hold rows of the result; copies: of the clustered copy of its rows."""

    files: list[str]
    copies: bool


def build(state: State, blocks: list, column: str, folder: str, clustered: bool, step: Callable[[int, str], None]) -> tuple[str, int]:
    """Writes the index of a source column over blocks, one after the other; returns its path and its number of
    values."""
    name = f"idx_{uuid.uuid4().hex[:12]}"
    at = real(f"{folder.rstrip('/')}/{name}")
    value = F.col(f"`{column.replace('`', '``')}`")
    for i, b in enumerate(blocks):
        rows, file = state.block(b), F.col("_metadata.file_path")
        if clustered:
            copy = f"{at}-rows/{i}"
            rows.repartitionByRange(value).sortWithinPartitions(value).write.option("parquet.block.size", ROW_GROUP).parquet(copy)
            rows, file = state.spark.read.schema(b.struct()).parquet(copy), F.regexp_extract(F.col("_metadata.file_path"), f"({name}-rows/.*)", 1)
        one = rows.select(value.alias("value"), F.lit(block_key(b)).alias("block"), file.alias("file"))
        one = one.groupBy("value", "block", "file").agg(F.count("*").alias("rows"))
        one.repartitionByRange("value").sortWithinPartitions("value").write.mode("append").parquet(at)
        step(i + 1, b.source)
    found = state.spark.read.parquet(at).agg(F.approx_count_distinct("value")).first()[0]
    return name, int(found)


_looked_up: OrderedDict[tuple, tuple[int, list]] = OrderedDict()


def _lookup(state: State, paths: tuple[str, ...], covered: tuple[str, ...], bound: Bound) -> tuple[int, list]:
    """How many (block, file) pairs the index has, and those that the bound finds. An index's files never change,
    so what was found is kept."""
    key = (paths, covered, repr(bound))
    if key not in _looked_up:
        table = state.spark.read.parquet(*paths).where(F.col("block").isin(*covered)).select("value", "block", "file")
        every = table.select("block", "file").distinct().count()
        hits = table.where(bound.on(F.col("value"))).select("block", "file").distinct().limit(MOST_FILES + 1).collect()
        _looked_up[key] = (every, hits)
        if len(_looked_up) > 1000:
            _looked_up.popitem(last=False)
    return _looked_up[key]


def files_to_read(state: State) -> dict[str, Found] | None:
    """For blocks of the base pack that an index covers at their version: the files that can hold rows of
    the result, by the most selective index. None: no index helps."""
    if not state.indexes:
        return None
    taken = {c for j in state.joins.values() for b in state.packs[j.pack_id] if b.struct() for c in b.struct().names}
    best: tuple[float, dict] | None = None
    for bound in lineage.base_bounds(state):
        if bound.column in taken:
            continue
        current = {block_key(b): b for b in state.packs[state.base]}
        parts = [p for _, ps in state.indexes.values() for p in ps if p.source_column == bound.column and any(k in current for k in p.blocks)]
        # the last part that has a block tells of it
        of = {k: p for p in parts for k in p.blocks if k in current}
        folder = state.folder.rstrip("/")
        every, hits = 0, []
        try:
            for p in {id(p): p for p in of.values()}.values():
                n, found = _lookup(state, (real(f"{folder}/{p.path}"),), tuple(k for k in of if of[k] is p), bound)
                every, hits = every + n, [*hits, *found]
        except (PySparkException, Py4JJavaError) as e:
            log.warning("an index of %s can't be read, and isn't used: %s", bound.column, str(e).splitlines()[0])
            continue
        if not of or len(hits) > MOST_FILES:
            continue
        share = len(hits) / max(1, every)
        if share <= MOST_SHARE or any(p.clustered for p in of.values()) or (share < 1 and every <= 16):
            files = {current[k].id: Found([real(f"{folder}/{h.file}") if p.clustered else h.file for h in hits if h.block == k], bool(p.clustered)) for k, p in of.items()}
            if best is None or share < best[0]:
                best = (share, files)
    return best[1] if best else None


def indexable(block) -> bool:
    return readers.kind_of(block.source) != "function"
