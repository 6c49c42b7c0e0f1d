"""Results outside Spark, and datasets as tar archives."""

from __future__ import annotations

import io
import tarfile
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .sources.files import Files, fresh_folder


def batches(df: DataFrame) -> list[pa.RecordBatch]:
    return df.toArrow().to_batches()


def to_pandas(df: DataFrame):
    if not df.columns:
        raise ValueError("Bundle produced no data")
    return df.toArrow().to_pandas()


def to_polars(df: DataFrame):
    import polars

    return polars.from_arrow(df.toArrow())


def to_numpy(df: DataFrame) -> dict:
    table = df.toArrow()
    return {name: column.to_numpy() for name, column in zip(table.column_names, table.columns, strict=True)}


def to_dict(df: DataFrame) -> dict:
    """Lists by column name; of columns with the same name the last one's."""
    table = df.toArrow()
    return {name: column.to_pylist() for name, column in zip(table.column_names, table.columns, strict=True)}


def export_tar(spark: SparkSession, folder: str, path: str) -> str:
    """All files of a dataset's folder in a tar archive, which is replaced at once; its sources are not in it."""
    files = Files(spark)

    def walk(at: str, name: str, out: tarfile.TarFile) -> None:
        fs, there = files._at(at)
        for s in fs.listStatus(there):
            own = s.getPath().getName()
            if own.startswith(".new-") or own.endswith(".crc"):
                continue
            below = f"{at.rstrip('/')}/{own}"
            if s.isDirectory():
                walk(below, f"{name}{own}/", out)
            else:
                data = files.read(below)
                info = tarfile.TarInfo(f"{name}{own}")
                info.size, info.mode = len(data), 0o644
                out.addfile(info, io.BytesIO(data))

    with tempfile.TemporaryDirectory() as own:  # the driver's own: nothing else reads it
        with tarfile.open(f"{own}/tar", "w") as out:
            walk(folder, "", out)
        files.put(f"{own}/tar", path)
    return f"Exported to {path}"


def unpack_tar(spark: SparkSession, path: str) -> str:
    """An archive's files in a new folder that executors can read."""
    files, folder = Files(spark), fresh_folder()
    if not files.exists(path):
        raise FileNotFoundError(f"No dataset found at {path}")
    with tempfile.TemporaryDirectory() as own:
        files.get(path, f"{own}/tar")
        with tarfile.open(f"{own}/tar") as t:
            for member in t:
                if member.isfile() and ".." not in member.name.split("/") and not member.name.startswith("/"):
                    files.create(f"{folder}/{member.name}", t.extractfile(member).read())
    return folder
