"""WARC: ZIP-packaged archive reader.

The reader parses the end record, the ZIP64 locator and the central directory of an archive,
locates its stored members (the WARC file and its CDXJ index, sorted by URL key) and range-reads
single records; nothing is extracted. It works on any ``read_at(offset, length)``. Archives are
files in the shared folder, or in any store that ``pyarrow.fs`` opens; tasks write and range-read
them there. A task's files carry its attempt's number, and only those of the attempt that
succeeded are listed, so a lost executor leaves at most files that nothing refers to.

Defined results: a null payload is empty; payloads under ``MIN_SHARED`` bytes are never shared;
rows that repeat the smallest id of a payload are all responses; null ids are written as ``-``
and never chosen while another id has the payload; a null or empty address has the key ``-``; an
empty table gives no archive; a payload beyond ``archive_bytes`` has an archive of its own. Only
page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, broadcast_if_small, shared_dir, stored, table
from tessella.storage import remember

# Signatures and sizes of the ZIP format (APPNOTE 6.3).
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
NO32, NO16 = 0xFFFFFFFF, 0xFFFF

MIN_SHARED = 100
ARCHIVE_BYTES = 4 << 20
#: Bytes fetched at once: of the index, and of neighbouring records.
INDEX_CHUNK, WINDOW = 1 << 20, 256 << 10
WARC_NAME, INDEX_NAME = "archive/data.warc", "indexes/index.cdxj"
ReadAt = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int
    crc: int


def bytes_reader(content: bytes) -> tuple[ReadAt, int]:
    view = memoryview(content)
    return lambda at, n: bytes(view[at : at + n]), len(view)


def file_reader(file: io.BufferedIOBase) -> tuple[ReadAt, int]:
    size = file.seek(0, 2)

    def read_at(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read_at, size


def write_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """An archive of stored members; ``zip64`` forces the 64-bit records that large ones need."""
    out, entries = bytearray(), []
    for name, data in members:
        raw, at, crc = name.encode(), len(out), zlib.crc32(data)
        wide = zip64 or max(len(data), at) >= NO32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = NO32 if wide else len(data)
        out += LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra + data
        more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        entries.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(more), 0, 0, 0, 0, NO32 if wide else at) + raw + more)
    start, directory = len(out), b"".join(entries)
    out += directory
    n, wide = len(entries), zip64 or start >= NO32 or len(entries) >= NO16
    if wide:
        at = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), start)
        out += LOCATOR64 + struct.pack("<IQI", 0, at, 1)
    out += END + struct.pack("<HHHHIIH", 0, 0, NO16 if wide else n, NO16 if wide else n, NO32 if wide else len(directory), NO32 if wide else start, 0)
    return bytes(out)


def read_directory(read_at: ReadAt, size: int) -> dict[str, Member]:
    """Members by name, from the central directory."""
    tail_at = max(0, size - 22 - NO16)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end record: not a ZIP archive")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if n == NO16 or length == NO32 or start == NO32:
        locator = read_at(tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("ZIP64 locator is missing")
        record = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("ZIP64 end record is missing")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, pos, found = read_at(start, length), 0, {}
    for _ in range(n):
        if directory[pos : pos + 4] != CENTRAL:
            raise ValueError("central directory is damaged")
        method, _, _, crc, packed, plain, name_n, extra_n, note_n = struct.unpack_from("<HHHIIIHHH", directory, pos + 10)
        (header_at,) = struct.unpack_from("<I", directory, pos + 42)
        name = directory[pos + 46 : pos + 46 + name_n].decode()
        extra = directory[pos + 46 + name_n : pos + 46 + name_n + extra_n]
        plain, packed, header_at = _wide(extra, plain, packed, header_at)
        found[name] = Member(name, method, plain, header_at, crc)
        pos += 46 + name_n + extra_n + note_n
    return found


def _wide(extra: bytes, *fields: int) -> list[int]:
    """Fields with those that don't fit 32 bits taken from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(values) if f == NO32 else f for f in fields]
        at += 4 + n
    return list(fields)


def member_start(read_at: ReadAt, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; its records can't be read by range")
    header = read_at(member.header_at, 30)
    if header[:4] != LOCAL:
        raise ValueError(f"local header of {member.name} is damaged")
    name_n, extra_n = struct.unpack_from("<HH", header, 26)
    return member.header_at + 30 + name_n + extra_n


def windowed(read_at: ReadAt, size: int = WINDOW) -> ReadAt:
    """The same bytes, fetched ``size`` at a time and held, so that neighbours cost one request."""
    held = [0, b""]

    def read(at: int, n: int) -> bytes:
        first, data = held
        if not first <= at <= at + n <= first + len(data):
            held[:] = first, data = at, read_at(at, max(n, size))
        return data[at - first : at - first + n]

    return read


def index_lines(read_at: ReadAt, index: Member, first: int = 0) -> Iterator[str]:
    """The lines of the index from the byte ``first`` (the start of a line) on, chunk by chunk."""
    start, rest = member_start(read_at, index), b""
    for at in range(first, index.size, INDEX_CHUNK):
        *lines, rest = (rest + read_at(start + at, min(INDEX_CHUNK, index.size - at))).split(b"\n")
        for line in lines:
            yield line.decode()
    if rest:
        yield rest.decode()


def url_key(url: str | None) -> str:
    """The sortable form of an address: the host's parts from the last on, then path and query."""
    address = quote(url or "", safe=_URL_SAFE)
    try:
        parts = urlsplit(address)
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port else ""
    except ValueError:  # no address: kept as it is
        return address
    return (f"{host}{port})" if host else "") + parts.path + (f"?{parts.query}" if parts.query else "") or "-"


def _record(read_at: ReadAt, at: int, line: str) -> tuple[dict, bytes]:
    entry = json.loads(line.split(" ", 2)[2])
    record = read_at(at + int(entry["offset"]), int(entry["length"]))
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    if lines[0] != "WARC/1.1" or len(block) != int(headers["Content-Length"]) + 4:
        raise ValueError("a record's length doesn't match its header")
    return headers, block[:-4]


def read_records(read_at: ReadAt, size: int) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record that the archive's index lists, each read by its range
    (those of a chunk of the index in the order they lie in)."""
    members = read_directory(read_at, size)
    at, near = member_start(read_at, members[WARC_NAME]), windowed(read_at)
    some: list[str] = []
    for line in index_lines(read_at, members[INDEX_NAME]):
        some.append(line)
        if len(some) == 4096:
            yield from (_record(near, at, x) for x in sorted(some, key=_offset))
            some = []
    yield from (_record(near, at, x) for x in sorted(some, key=_offset))


def _offset(line: str) -> int:
    return int(json.loads(line.split(" ", 2)[2])["offset"])


def find_records(read_at: ReadAt, size: int, url: str | None) -> Iterator[tuple[dict, bytes]]:
    """The records of an address, found by halving the sorted index; only a few ranges are read."""
    members = read_directory(read_at, size)
    index, key = members[INDEX_NAME], url_key(url).encode()
    start = member_start(read_at, index)

    def line_from(pos: int) -> tuple[int, bytes]:
        """The first line that begins at ``pos`` or later, and where."""
        data, n = b"", 512
        while True:
            data = read_at(start + max(0, pos - 1), min(n, index.size - max(0, pos - 1)))
            begin = data.find(b"\n") + 1 if pos else 0
            end = data.find(b"\n", begin)
            whole = max(0, pos - 1) + len(data) >= index.size
            if (begin or not pos) and end >= 0 or whole:
                break
            n *= 4
        if pos and not begin or max(0, pos - 1) + begin >= index.size:
            return index.size, b""
        return max(0, pos - 1) + begin, data[begin : end if end >= 0 else len(data)]

    low, high = 0, index.size
    while low < high:
        middle = (low + high) // 2
        where, line = line_from(middle)
        if where >= index.size or line.split(b" ", 1)[0] >= key:
            high = middle
        else:
            low = where + len(line) + 1
    where, _ = line_from(low) if low < index.size else (index.size, b"")
    at = member_start(read_at, members[WARC_NAME])
    for line in index_lines(read_at, index, where) if where < index.size else ():
        if line.split(" ", 1)[0].encode() != key:
            return
        yield _record(read_at, at, line)


_URL_SAFE = ":/?#[]@!$&()*+,;=%~"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit if ``refers_to`` is given: its payload is left out."""
    name = "-" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {quote(url or '', safe=_URL_SAFE)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder (a path, or an address that Arrow knows)."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Write ZIP archives of about ``archive_bytes`` into ``folder``, one or more a partition; rows
    (archive, bytes, records) of their names. Store the rows before they are used.

    ``pages`` has page_id, url, payload (binary), digest and refers_to.
    """
    bounded_batches(pages.sparkSession)

    def run(batches):
        context, number = TaskContext.get(), 0
        store, at = store_of(folder)
        warc, index = bytearray(), []

        def close():
            nonlocal number, warc, index
            lines = b"".join(line for _, line in sorted(index))
            content = write_zip([(WARC_NAME, bytes(warc)), (INDEX_NAME, lines)], zip64)
            name = f"part-{context.partitionId():05d}-{context.taskAttemptId():x}-{number:05d}.wacz"
            store.create_dir(at, recursive=True)
            with store.open_output_stream(f"{at}/{name}") as out:
                out.write(content)
            row = pa.RecordBatch.from_pydict({"archive": [name], "bytes": pa.array([len(content)], pa.int64()), "records": pa.array([len(index)], pa.int64())})
            number, warc, index = number + 1, bytearray(), []
            return row

        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for k in range(batch.num_rows):
                page_id, url, payload, digest, first = (c[k].as_py() for c in columns)
                record = record_bytes(page_id, url, payload, digest, first)
                entry = {"offset": str(len(warc)), "length": str(len(record)), "filename": WARC_NAME}
                key = url_key(url).encode()
                index.append(((key, len(warc)), key + b" 20000101000000 " + json.dumps(entry).encode() + b"\n"))
                warc += record
                if len(warc) >= archive_bytes:
                    yield close()
        if index:
            yield close()

    return pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, bytes long, records long")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(value: str | None) -> int | None:
    name = (value or "-").removeprefix("<urn:page:").rstrip(">")
    return None if name == "-" else int(name)


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives of ``folder`` that the column ``archive`` names."""

    def rows_of(name: str) -> Iterator[tuple]:
        store, at = store_of(folder)
        with store.open_input_file(f"{at}/{name}") as file:
            for headers, block in read_records(lambda at, n: file.read_at(n, at), file.size()):
                http, _, payload = block.partition(b"\r\n\r\n")
                claimed = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                if headers["WARC-Type"] == "response":
                    claimed, size = hashlib.sha256(payload).hexdigest(), len(payload)
                yield _urn(headers["WARC-Record-ID"]), size, claimed, headers["WARC-Type"], _urn(headers.get("WARC-Refers-To"))

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found = rows_of(name)
                while rows := list(islice(found, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[p.split()[0] for p in READ.split(", ")])

    return archives.select("archive").mapInArrow(run, READ)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest and ``refers_to``: the smallest id with an equal payload, if it is
    another. Pages meet a narrow table of the revisits by their own ids, not by their payloads."""
    raw = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    digested = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", raw.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = digested.filter(F.length("payload") >= MIN_SHARED).select("page_id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = narrow.join(firsts, "digest").filter("NOT page_id <=> refers_to").distinct()
    revisits = stored(found.select(F.col("page_id").alias("revisit"), F.col("digest").alias("same"), "refers_to"), "revisits")
    own = F.col("page_id").eqNullSafe(F.col("revisit")) & (F.col("digest") == F.col("same"))
    return digested.join(broadcast_if_small(revisits), own, "left").drop("revisit", "same")


def op6_warc_zip(spark, sf_dir: str) -> DataFrame:
    """All pages written to ZIP-packaged WARC archives in the shared folder, and the records read
    back by range."""
    folder = remember(f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}")
    written = stored(write_archives(with_revisits(table(spark, sf_dir, "pages")), folder), "archives")
    return read_archives(written, folder)


ORACLE_OP6 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, CASE WHEN octet_length(payload) >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p
)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
