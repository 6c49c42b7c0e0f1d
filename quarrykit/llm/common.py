"""What the operators share: the shared folder, tables that cut lineage, components, the global order of rows."""

from __future__ import annotations

import gc
import sys
import tempfile
import time
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir, or, where it is unset and the
    master is local (tests on one machine), a new local folder. On a cluster there is no such folder that
    executors share: an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quarrykit-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at


_written: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def mark() -> int:
    """How many tables and folders this process has written to the shared folder."""
    return len(_written)


def clean(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Deletes what this process wrote to the shared folder since a mark, the last of it left out if it is still
    wanted. Results that read from what is deleted, and weren't saved, can't be read any more."""
    release(spark, *_written[since : max(since, len(_written) - keep_last)])


def release(spark: SparkSession, *done: DataFrame | str) -> None:
    """Deletes tables of materialize, or paths of fresh_path, that nothing reads any more, and the files of shuffles that are
    over: Spark keeps those until the driver's JVM collects its garbage, which a driver with little to do puts off."""
    for at in [x if isinstance(x, str) else x.written_at for x in done]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(at)
    for _ in range(2):  # what just ended is still held by Spark's own threads for a moment
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut, and what an executor
    made outlives the executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, on any executor."""
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def kept_by_worker(key: tuple, build, most: int = 2):
    """What ``build()`` makes, made once by a Python worker for all of its tasks; the latest ``most`` are kept.

    This subpackage travels by value, so its own globals are new in each task: the table hangs in sys.modules."""
    table = sys.modules.setdefault("_quarrykit_worker", types.ModuleType("_quarrykit_worker")).__dict__.setdefault("kept", {})
    if key not in table:
        while len(table) >= most:
            table.pop(next(iter(table)))
        table[key] = build()
    return table[key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (id, root): the smallest id that each linked id reaches.

    Alternating large-star and small-star rounds: every round is two aggregations and two joins over
    the links, which become stars in a number of rounds that grows with the logarithm of the longest
    chain. Links stay on the executors; only a count and a checksum reach the driver."""
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    while True:
        count, check = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if (count, check) == seen or count == 0:
            break
        seen = (count, check)
        both = now.union(now.select("b", "a"))
        # written, so that the join has two plain shuffles and Spark may split an id with very many links
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        now = materialize(small, "links")
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root").unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )


#: A filter of ids has at most so many bits (32 MB), whatever the number of ids; beyond some 50 million ids more and
#: more rows pass that aren't meant, and are shuffled to be judged.
FILTER_BITS = 1 << 28
_HASHED = ["__quarrykit_hash_0", "__quarrykit_hash_1"]


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter over the one column of ids, built by an aggregation: 64-bit words of bounded number."""
    name = ids.columns[0]
    bits = min(FILTER_BITS, 1 << max(10, (16 * ids.count()).bit_length()))
    at = ids.select(F.explode(F.array(*(F.xxhash64(name, F.lit(i)).bitwiseAND(bits - 1) for i in (0, 1)))).alias("p"))
    words = at.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("m")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[np.asarray(words["w"])] = np.asarray(words["m"])
    return table.view(np.uint64)


def sliced(batches, rows: int = 512):
    """Batches in small slices, so that what is made of one is small beside it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_hashes(df: DataFrame, name: str) -> DataFrame:
    """Adds the two hashes that id_filter uses."""
    return df.withColumns({c: F.xxhash64(name, F.lit(i)) for i, c in enumerate(_HASHED)})


def maybe_in(batch: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    """Which rows' ids may be in the filter; no id that is in it is missed."""
    hit = np.ones(batch.num_rows, bool)
    for c in _HASHED:
        h = np.asarray(batch.column(c)) & (len(table) * 64 - 1)
        hit &= ((table[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return hit


def without(df: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """The rows of df whose id isn't in gone. Only rows that pass a Bloom filter of gone are shuffled to be
    judged exactly; the rest, most rows where few go, stay where they are."""
    gone = materialize(gone.select(F.col(gone.columns[0]).alias(name)).where(f"`{name}` is not null").distinct(), "gone")
    table, columns = id_filter(gone), df.columns
    held = df.sparkSession.sparkContext.broadcast(table)

    def run(wanted: bool):
        def each(batches):
            for batch in sliced(batches):
                rows = batch.filter(pa.array(maybe_in(batch, held.value) == wanted))
                if rows.num_rows:
                    yield rows.select(columns)

        return each

    hashed = with_hashes(df, name)
    sure = hashed.mapInArrow(run(False), df.schema)
    return sure.unionByName(hashed.mapInArrow(run(True), df.schema).join(gone, name, "left_anti").select(*columns))


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most value, as a balanced tree of comparisons; null: 0."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= F.lit(bounds[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(bounds))
