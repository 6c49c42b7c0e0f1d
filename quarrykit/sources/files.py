"""Places of data: URLs, the files behind them, their versions and sizes."""

from __future__ import annotations

import hashlib
import os
import posixpath
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_scratch: dict[str, str] = {}


def use_scratch(shared: str | None, local: bool = True) -> None:
    """Where datasets without a place of their own are kept: a folder that all executors share. local: whether driver
    and executors are one machine, and may use a folder of it."""
    if shared:
        _scratch["shared"] = shared.rstrip("/")
    _scratch["local"] = "yes" if local else ""


def scratch() -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, else a local one (one machine)."""
    if "shared" not in _scratch:
        if not _scratch.get("local", "yes"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _scratch["shared"] = "file://" + tempfile.mkdtemp(prefix="quarrykit-")
    return _scratch["shared"]


def fresh_folder() -> str:
    return f"{scratch()}/dataset-{uuid.uuid4().hex}"


def random_memory_url() -> str:
    return f"memory:///{uuid.uuid4().hex}"


def real(url: str) -> str:
    """The URL that Spark reads: memory:/// is a folder of this process's scratch, a plain path is a file."""
    if url.startswith("memory://"):
        if "memory" not in _scratch:
            _scratch["memory"] = f"{scratch()}/memory-{uuid.uuid4().hex}"
        return f"{_scratch['memory']}/{url.removeprefix('memory://').lstrip('/')}"
    if "://" not in url:
        return "file://" + os.path.abspath(url)
    scheme, _, rest = url.partition("://")
    if scheme == "s3":
        return f"s3a://{rest}"
    if scheme in ("az", "azure"):  # container/path of the account that is set
        account = _scratch.get("azure", "")
        if not account:
            raise ValueError(f"{url}: set the config 'account_name' first")
        container, _, path = rest.partition("/")
        return f"abfss://{container}@{account}.dfs.core.windows.net/{path}"
    return url


def use_account(name: str) -> None:
    """The Azure storage account that az:// and azure:// URLs are of."""
    _scratch["azure"] = name


def azure_account() -> str:
    return _scratch.get("azure", "")


def resolve(url: str, folder: str) -> str:
    """A relative path is below the dataset's folder, and stays there."""
    if "://" in url or os.path.isabs(url):
        return url
    path = posixpath.normpath(url)
    if path.startswith(".."):
        raise ValueError(f"{url} leads out of the dataset's folder")
    if not folder or folder.startswith("empty:"):
        return os.path.abspath(url)
    return f"{folder.rstrip('/')}/{path}"


class Files:
    """Small files by URL, through Hadoop's file systems: whatever Spark reads from works."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, url: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(real(url))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, url: str) -> bool:
        fs, path = self._at(url)
        return fs.exists(path)

    def list(self, url: str) -> list[str]:
        """Names of what is in a folder; none if it doesn't exist."""
        fs, path = self._at(url)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, url: str) -> bytes:
        fs, path = self._at(url)
        stream = fs.open(path)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, url: str, data: bytes) -> None:
        """Writes a new file; an existing one is an error, so two writers can't both have a name."""
        fs, path = self._at(url)
        out = fs.create(path, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def take(self, beside: str, url: str) -> None:
        """Renames a file to a name that no file has: of two that want the name, the second one fails."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        (_, a), (_, b) = self._at(beside), self._at(url)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(a, b, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise FileExistsError(f"{url} exists") from e
            raise

    def put(self, local: str, url: str) -> None:
        """A local file of the driver to a new or replaced one: beside it first, then renamed over it."""
        fs, path = self._at(url)
        beside = self._at(f"{real(url)}.new")[1]
        fs.copyFromLocalFile(True, True, self._at(f"file://{local}")[1], beside)
        fs.delete(path, False)
        if not fs.rename(beside, path):
            raise OSError(f"{url} can't be written")

    def get(self, url: str, local: str) -> None:
        fs, path = self._at(url)
        fs.copyToLocalFile(False, path, self._at(f"file://{local}")[1], True)

    def delete(self, url: str) -> None:
        fs, path = self._at(url)
        fs.delete(path, True)

    def version(self, url: str) -> tuple[str, int]:
        """(version, bytes): a hash over modification times and lengths of the file or of a folder's files."""
        fs, path = self._at(url)
        if not fs.exists(path):
            raise FileNotFoundError(f"{url} does not exist")
        status = fs.getFileStatus(path)
        if status.isDirectory():
            found = [s for s in fs.listStatus(path) if not s.getPath().getName().startswith(("_", "."))]
        else:
            found = [status]
        told = sorted((s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in found)
        whole = fs.getContentSummary(path)
        told.append((whole.getFileCount(), whole.getLength()))
        return hashlib.sha256(repr(told).encode()).hexdigest()[:16], whole.getLength()
