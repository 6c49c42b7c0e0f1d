"""WARC records in ZIP archives.

An archive is a ZIP file of stored (not compressed again) members: WARC files below ``archive/`` (one gzip member
for each record, or plain), CDXJ lines below ``indexes/`` with each record's file and place, and ``datapackage.json``
that names them. The reader parses the central directory (ZIP64 too) from the end of the file, finds where the stored
members' bytes begin, reads the index, and then only the bytes of records. A WARC file that no index tells of is
walked record by record. What others wrote can be read as well.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, materialize, partitions

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
WARCS, INDEXES = (".warc", ".warc.gz"), (".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")
#: Records with a payload of at least so many bytes may be revisits.
SMALLEST_REVISIT = 100
#: An archive is closed after so many bytes of records; its index is all that the writer holds.
ARCHIVE_BYTES = 256 << 20
#: Neighbouring records are read together up to so many bytes.
RANGE_BYTES = 4 << 20


class ZipDirectory:
    """The central directory of a ZIP file, from ``read(offset, size)`` and the file's size."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        locator = tail_at + at - 20
        if locator >= 0 and (count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF):
            head = read(locator, 20)
            if head[:4] == b"PK\x06\x07":
                record = read(struct.unpack_from("<Q", head, 8)[0], 56)
                if record[:4] != b"PK\x06\x06":
                    raise ValueError("the ZIP64 locator points to no ZIP64 record")
                count, length, offset = struct.unpack_from("<QQQ", record, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, at = read(offset, length), 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, plain = struct.unpack_from("<II", directory, at + 20)
            name_n, extra_n, comment_n = struct.unpack_from("<HHH", directory, at + 28)
            header = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, to = at + 46 + name_n, at + 46 + name_n + extra_n
            while extra + 4 <= to:
                kind, n = struct.unpack_from("<HH", directory, extra)
                if kind == 1:  # ZIP64: only the fields that don't fit above, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", directory, extra + 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                extra += 4 + n
            self.members[name] = (method, packed, header)
            at = to + comment_n

    def stored(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's bytes in the file."""
        method, size, header = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read in ranges")
        head = self.read(header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: no local header")
        return header + 30 + sum(struct.unpack_from("<HH", head, 26)), size


def record_bytes(record_id: str, target: str | None, kind: str, payload: bytes, digest: str, headers: dict[str, str]) -> bytes:
    """One WARC/1.1 record: a response's block is an HTTP answer with the payload; a revisit has the answer's head
    alone, its payload's digest and length are in its headers."""
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = answer + payload if kind == "response" else answer
    lines = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id,
        "WARC-Date": "1970-01-01T00:00:00Z",
        **({"WARC-Target-URI": target} if target is not None else {}),
        **({"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} if kind == "revisit" else {}),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(len(payload)),
        **headers,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in lines.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0 and (n := int(body[at:end].split(b";")[0] or b"0", 16)):
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload: of an HTTP answer its body, else the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = _headers(head)
    block = rest[: int(headers["content-length"])]
    if headers.get("content-type", "").startswith("application/http"):
        answer, _, block = block.partition(b"\r\n\r\n")
        if _headers(answer).get("transfer-encoding", "").lower() == "chunked":
            block = _unchunked(block)
    return headers, block


def _one_line(text: str) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text)


def sort_key(url: str) -> str:
    """The key of a CDXJ line: the host's labels from the last on, and the rest."""
    host, slash, rest = url.partition("://")[2].partition("/")
    return "".join(",".join(reversed(host.lower().split("."))).split()) + ")" + "".join((slash + rest).lower().split())


def record_places(read: Callable[[int, int], bytes], name: str, base: int, size: int, window: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of every record of a WARC file of ``size`` bytes at ``base``, by walking through it."""
    at = 0
    while at < size:
        if name.endswith(".gz"):
            unpack, to = zlib.decompressobj(31), at
            while not unpack.eof and to < size:
                part = read(base + to, min(window, size - to))
                unpack.decompress(part)
                to += len(part)
            if not unpack.eof:
                raise ValueError(f"{name}: the record at {at} is cut off")
            length = to - len(unpack.unused_data) - at
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                part = read(base + at + len(head), min(4096, size - at - len(head)))
                if not part:
                    raise ValueError(f"{name}: the record at {at} is cut off")
                head += part
            head = head[: head.index(b"\r\n\r\n")]
            length = len(head) + 4 + int(_headers(head)["content-length"]) + 4
        yield at, length
        at += length


def places_of(directory: ZipDirectory, read: Callable[[int, int], bytes]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """For each WARC file of an archive its name, where its bytes begin, and its records' (offset, length) in order."""

    def whole(name: str) -> bytes:
        at, n = directory.stored(name)
        data = read(at, n)
        return zlib.decompress(data, 47) if name.endswith(".gz") else data

    names = list(directory.members)
    if PACKAGE in directory.members:
        named = [r.get("path", "") for r in json.loads(whole(PACKAGE)).get("resources", [])]
        # a package names members by their path or by their place below its folders
        names = [n for n in names if any(n == x or n.endswith("/" + x) for x in named)] or names
    files = {n.rpartition("/")[2]: n for n in names if n.endswith(WARCS)}
    told: dict[str, set[tuple[int, int]]] = {}
    for name in names:
        if name.endswith(INDEXES):
            for line in whole(name).decode().splitlines():
                if "{" in line and not line.startswith("!"):
                    entry = json.loads(line[line.index("{") :])
                    file = str(entry.get("filename", "")).rpartition("/")[2] or next(iter(files), "")
                    if "offset" in entry and "length" in entry:
                        told.setdefault(file, set()).add((int(entry["offset"]), int(entry["length"])))
    for file, name in sorted(files.items()):
        base, size = directory.stored(name)
        yield name, base, sorted(told[file]) if file in told else list(record_places(read, name, base, size))


def write_archives(pages: DataFrame, folder: str, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """Writes a record for each row (page_id, url, html) to archives in ``folder``; returns (archive, size).

    Of records with equal payloads of at least ``smallest`` bytes, those with the smallest page_id are
    responses and the others revisit it. Who revisits whom is found from digests and ids alone; the pages
    are then dealt by page_id once to be written.

    A null html is an empty payload; a null url has no target, and control characters of others are escaped. A
    payload of any length is whole in memory, one at a time. Other columns are ignored, whatever their names. An
    empty table writes no archive."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digests = pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")).where(f"n >= {smallest}").drop("n")
    groups = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").drop("copies")
    revisits = digests.join(groups, "digest").where("page_id is null or page_id > first").select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), "first").distinct()
    judged = pages.withColumn("digest", F.sha2("html", 256)).join(revisits, F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None

        def close() -> pa.RecordBatch:
            nonlocal out
            member.close()
            for name, data in ((INDEX, "".join(sorted(lines)).encode()), (PACKAGE, json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())):
                archive.writestr(zipfile.ZipInfo(name), data)
            archive.close()
            size = out.tell()
            out.close()
            out = None
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([size], pa.int64())], ["archive", "size"])

        for batch in batches:
            for key, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                if out is None:
                    own, lines, at = uuid.uuid4(), [], 0
                    path = f"{folder}/{own.hex}.wacz"
                    fs, local = filesystem(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                kind = "response" if first is None else "revisit"
                headers = {"X-Page-ID": json.dumps(key)} | ({"X-Refers-To-Page-ID": str(first)} if first is not None else {})
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                target = None if url is None else _one_line(url)
                data = squeeze.compress(record_bytes(f"<urn:uuid:{uuid.uuid5(own, str(at))}>", target, kind, html.encode(), digest, headers)) + squeeze.flush()
                member.write(data)
                entry = {"url": target, "mime": "text/html", "status": "200", "digest": f"sha256:{digest}", "length": str(len(data)), "offset": str(at), "filename": DATA.rpartition("/")[2]}
                lines.append(f"{sort_key(target or '')} 19700101000000 {json.dumps(entry)}\n")
                at += len(data)
                if at > ARCHIVE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    written = judged.select("page_id", "url", "html", "digest", "first").mapInArrow(run, "archive string, size long")
    return materialize(written, "archives")


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives (column archive): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, with ``payloads``, payload (null for a revisit).

    Records of any type are read; page_id and refers_to are null where a record doesn't tell them, url where it has no
    target. The digest is that of the payload's bytes in lower-case hex SHA-256; of a revisit, which has none, what its
    header says. A response whose payload hasn't the SHA-256 of its header is an error."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]

    def row(path: str, offset: int, data: bytes, packed: bool) -> tuple:
        headers, payload = parse_record(zlib.decompress(data, 31) if packed else data)
        kind, said, told = headers.get("warc-type", ""), headers.get("warc-payload-digest", ""), headers.get("x-payload-length")
        digest, own, refers = hashlib.sha256(payload).hexdigest(), headers.get("x-page-id"), headers.get("x-refers-to-page-id")
        if kind == "revisit":
            digest, payload = said.removeprefix("sha256:") or None, None
        elif kind == "response" and said.startswith("sha256:") and said != f"sha256:{digest}":
            raise ValueError(f"{path}: a record at {offset} is damaged")
        n = int(told) if told else None if payload is None else len(payload)
        return (json.loads(own) if own else None, headers.get("warc-target-uri"), n, digest, kind, int(refers) if refers else None, payload)[: 6 + payloads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                fs, local = filesystem(path)
                with fs.open_input_file(local) as f:
                    read = lambda at, n, f=f: f.read_at(n, at)
                    for name, base, places in places_of(ZipDirectory(read, f.size()), read):
                        i = 0
                        while i < len(places):
                            j, begin = i + 1, places[i][0]
                            while j < len(places) and places[j][0] + places[j][1] - begin <= RANGE_BYTES:
                                j += 1
                            block = read(base + begin, places[j - 1][0] + places[j - 1][1] - begin)
                            rows = [row(path, at, block[at - begin : at - begin + n], name.endswith(".gz")) for at, n in places[i:j]]
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            i = j

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return archives.repartition(partitions(spark), "archive").mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, written to archives in
    the shared folder and read back.

    A null html is an empty payload, a null url no target; payloads of any length come back whole. Equal rows of the
    smallest page_id are all responses; a row without page_id revisits a numbered one and is a response if there is
    none. Other columns are ignored, whatever their names. An empty table gives no rows."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, fresh_path(spark, "warc"), smallest), payloads=False).drop("url")
