"""Best-fit packing by sum of squares.

Documents become pieces of at most ``capacity`` ids. Pieces are dealt to shards of bounded size; a shard
packs its pieces, longest first, each where the sum of the squared counts of open bins per residual gap
becomes smallest. A bin whose gap is smaller than the shortest piece at hand is closed. What is in bins that
stay open is dealt anew to shards of the same bounded size, level by level, until one shard holds it all or a
level saves next to no bins: no task ever packs more than about SHARD pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions
from .tokens import text_ids

#: Pieces that one shard packs, about.
SHARD = 8192
#: A level that saves a smaller share of its bins is the last one.
WORTH = 0.01
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, path: str, pattern: str, end: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and the id ``end`` after them. A
    longer document's first piece takes the rest, the others are full. A null text is empty: one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(text_ids(path, pattern, text.as_py()), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or capacity
                at = 0
                for k, to in enumerate(range(first, len(ids) + 1, capacity)):
                    rows.append((key, k, at, to - at, zlib.crc32(ids[at:to].tobytes())))
                    at = to
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item, in the order given: its bin, its offset there; and the gap that each bin is left with.

    N[g] is the number of open bins with gap g. An item that fits a gap turns a bin of gap g to one of gap
    g - length; of the gaps at hand and a new bin, it takes the one with the least sum of N[g]^2 after it.
    Ties take the smallest gap."""
    count = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left: list[int] = []
    never = 1 << 60
    for i, size in enumerate(lengths.tolist()):
        gaps = count[size:capacity]  # of open bins, size and larger
        best, at = never, -1
        if len(gaps):
            cost = np.where(gaps > 0, 2 * (count[: capacity - size] - gaps) + 2, never)
            if gaps[0]:
                cost[0] = 1 - 2 * gaps[0]  # a full bin isn't open any more
            at = int(cost.argmin())
            best = cost[at]
        rest = capacity - size
        if best >= never or (rest and 2 * count[rest] + 1 < best):
            left.append(rest)
            b = len(left) - 1
        else:
            gap = size + at
            b = bins[gap].pop()
            count[gap] -= 1
            rest = at
        where[i], offset[i] = b, capacity - rest - size
        left[b] = rest
        if rest:
            bins[rest].append(b)
            count[rest] += 1
    return where, offset, np.array(left, np.int64)


def pack_rounds(lengths: np.ndarray, capacity: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sum_of_squares, longest items first; then again with the items of the bins left open, as long as that
    saves bins. For each item: its bin, its offset, the gap that its bin is left with."""
    n = len(lengths)
    where, offset, gap = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    rest, first, bins = np.argsort(-lengths, kind="stable"), 0, n + 1
    for _ in range(rounds):
        if not len(rest):
            break
        own, at, left = sum_of_squares(lengths[rest], capacity)
        if len(left) >= bins:
            break
        where[rest], offset[rest], gap[rest] = own + first, at, left[own]
        first += len(left)
        bins = int((left > 0).sum())
        rest = rest[left[own] > 0]
    return where, offset, gap


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to capacity; other columns may have any names but
    shard and open. Every row is an item of its own, equal rows too, and full items have sequences of their own.
    Ties in length are packed in any order. An empty table gives no rows.

    Of each level, the driver gets the number of open pieces, their bins and their shortest length."""

    def shard(level: int, least: int):
        def run(rows: pa.Table) -> pa.Table:
            length = rows["length"].to_numpy()
            where, offset, gap = pack_rounds(length, capacity)
            number = level << 58 | rows["shard"][0].as_py() << 30
            for name, values in (("sequence_id", where + number), ("offset", offset), ("open", gap >= least)):
                rows = rows.append_column(name, pa.array(values))
            return rows

        return run

    columns = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", shard long, sequence_id long, offset long, open boolean"
    width = partitions(items.sparkSession)
    items = materialize(items, "pieces")
    many, least = items.agg(F.count("*"), F.coalesce(F.min("length"), F.lit(1))).first()
    # the row's own number keeps equal rows, however many, from one shard
    number, todo, bins = F.xxhash64(*columns, F.monotonically_increasing_id()), items, None
    done, level = None, 0
    while True:
        shards = max(1, -(-many // SHARD))
        dealt = todo.withColumn("shard", F.pmod(number, F.lit(shards))).select(*columns, "shard")
        packed = materialize(dealt.repartition(min(width, shards), "shard").groupBy("shard").applyInArrow(shard(level, least), schema), "packed")
        first = F.when(F.col("offset") == 0, 1)
        made, many, open_, least = packed.agg(F.count(first), F.count(F.when(F.col("open"), 1)), F.count(F.when(F.col("open"), first)), F.min(F.when(F.col("open"), F.col("length")))).first()
        if shards == 1 or not many or level == 30 or (bins is not None and bins - made < WORTH * bins):
            last = packed.select(*columns, "sequence_id", "offset")
            return last if done is None else done.unionByName(last)
        closed = packed.where("not open").select(*columns, "sequence_id", "offset")
        done = closed if done is None else done.unionByName(closed)
        level, bins = level + 1, open_
        number, todo = F.xxhash64("sequence_id", F.lit(level)), packed.where("open").select(*columns, "sequence_id")


def pack_documents(documents: DataFrame, path: str, pattern: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null and empty texts hold the id ``end`` alone. A text of any length is whole in memory with its ids, one at a
    time, and becomes as many pieces as it needs. Repeated rows, and rows without doc_id, are documents of their own.
    Other columns are ignored, whatever their names. An empty table gives no rows."""
    return pack(pieces(documents, path, pattern, end, capacity), capacity)
