"""Byte-level BPE ids, flat token files, and the separator scan that counts their documents."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filesystem, fresh_path, kept_by_worker, materialize, partitions

def encoder(path: str, pattern: str):
    """The tokenizer of a ranks file, as read once by a worker from the vocabulary folder of its machine. Strings
    of special tokens are ordinary text to it."""

    def build():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return kept_by_worker(("encoder", path, pattern), build)


def text_ids(path: str, pattern: str, text: str | None) -> np.ndarray:
    return np.array(encoder(path, pattern).encode_ordinary(text), np.uint32) if text else np.zeros(0, np.uint32)


def as_uint16(ids: np.ndarray) -> np.ndarray:
    if len(ids) and ids.max() > 0xFFFF:
        raise ValueError(f"id {ids.max()} doesn't fit in 16 bits: a flat file of this vocabulary can't be written")
    return ids.astype("<u2")


def write_token_files(documents: DataFrame, path: str, pattern: str, end: int) -> DataFrame:
    """Writes every text's ids and then the id ``end`` to flat little-endian uint16 files, one for each task,
    in the shared folder. Returns (file, ordinal, doc_id) for each document, in the files' order. Null and empty texts
    have the id ``end`` alone, and rows that repeat or lack a doc_id are documents of their own. An id that
    16 bits don't hold is an error. An empty table writes no file.

    A task that is run again writes another file; only files of tasks that ended well are in the result."""
    folder = fresh_path(documents.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ordinal, out = f"{folder}/{uuid.uuid4().hex}.u16", 0, None
        try:
            for batch in batches:
                if out is None:
                    fs, at = filesystem(name)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at)
                for text in batch.column("text"):
                    out.write(as_uint16(np.append(text_ids(path, pattern, text.as_py()), np.uint32(end))).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column("doc_id")], ["file", "ordinal", "doc_id"])
                ordinal += n
        finally:
            if out is not None:
                out.close()

    return materialize(documents.select("doc_id", "text").mapInArrow(run, "file string, ordinal long, doc_id long"), "token-files")


def separator_scan(spark: SparkSession, files: DataFrame, end: int, block: int = 4 << 20) -> DataFrame:
    """Documents of flat token files: (file, ordinal, start, n_tokens), in tokens, without the separator.

    files: (file). Every block of ``block`` uint16 ids is searched for ``end`` at once; the documents before
    a block and the last separator before it come from a prefix scan over the blocks of its file. Two
    separators in a row enclose an empty document; ids after the last separator are a document of their
    own; an empty file has none."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("file").to_pylist()
            n = [fs.get_file_info(at).size // 2 for fs, at in map(filesystem, names)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(n, pa.int64())], ["file", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, k, n in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "n")), strict=True):
                fs, at = filesystem(name)
                with fs.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(2 * min(block, n - k * block), 2 * k * block), "<u2")
                found = np.flatnonzero(ids == end) + k * block
                if (k + 1) * block >= n and ids[-1] != end:
                    found = np.append(found, n)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found, pa.int64()))], ["file", "block", "ends"])

    width = partitions(spark)
    sized = files.select("file").distinct().mapInArrow(sizes, "file string, n long").where("n > 0")
    blocks = sized.select("file", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))).alias("block"))
    found = materialize(blocks.repartition(width, "file", "block").mapInArrow(scan, "file string, block long, ends array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("file", "block", F.size("ends").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last")).select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("done"), F.coalesce(F.last("last", True).over(before), F.lit(-1)).alias("carry")
    )
    each = found.join(carried, ["file", "block"]).select("file", "done", "carry", "ends", F.posexplode("ends").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.expr("get(ends, i - 1)")) + 1
    return each.select("file", (F.col("done") + F.col("i")).cast("long").alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"))


def token_counts(documents: DataFrame, path: str, pattern: str, end: int) -> DataFrame:
    """doc_id, file_ordinal, start, n_tokens of every document, from flat token files written and scanned.

    Null and empty texts have no tokens. Repeated rows are documents of their own; a row without doc_id
    keeps its row. Files are scanned in blocks, so a document of any length may lie across many of them. Other
    columns are ignored, whatever their names. An empty table gives no rows."""
    written = write_token_files(documents, path, pattern, end)
    scanned = separator_scan(documents.sparkSession, written, end)
    return written.join(scanned, ["file", "ordinal"]).select("doc_id", F.col("ordinal").alias("file_ordinal"), "start", "n_tokens")
