"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writer: each task writes its pages as WARC/1.1 records, one gzip member a record, into files of bounded
size in the shared folder. A file's name holds the task attempt; only files that a successful task
reports are part of the archive, so lost executors and retries leave no duplicates. Of pages with equal
payloads of ``least_bytes`` or more, the one with the largest id is stored, the others refer to it.

Reader: reads a file by places through a window of fixed size. Each member (or, in uncompressed stretches,
each record from its version line) must inflate, have the right CRC, a complete header, a block of the stated
length and, where given, the right block and payload digests. All of that is checked in pieces of fixed size; only a
record that passed, or a small one, is held in memory, so a damaged length or a member that inflates without
end costs time but no memory. After a failed check the reader searches from the next byte for a member or
version line that passes all of them, goes on from there, and reports the bytes between as a quarantined gap
with its reason.

Defined results: null html is an empty payload; a null id is written without the id field and read as
null; repeated rows with the largest id of their payload are all stored as responses; an empty table
gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.session import scratch, written

LEAST_BYTES = 1000
FILE_BYTES = 128 << 20
CHUNK = 1 << 20
#: In uncompressed stretches a header block longer than this, and than any that the manifest tells of, is damage, not a header.
HEADER_BYTES = 64 << 10
#: A record up to this size is held while it is checked; a larger one is checked in pieces first and then read again.
#: A member's header block, and the HTTP header in a record, may be as long.
HELD = 8 << 20
PIECE = 64 << 10
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
MAGIC, LINE = b"\x1f\x8b\x08", b"WARC/1."
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
RECORD = "page_id {id}, payload_bytes long, payload_digest string, record_type string, refers_to {id}, payload binary"
GAP = "file string, gap_start long, gap_end long, reason string"


def _open(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# -- writing -------------------------------------------------------------------------------------


def record(kind: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *headers, ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit record (identical payload) if it refers to another page."""
    about = [("WARC-Date", date), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}")]
    about += [("WARC-Page-ID", str(page_id))] * (page_id is not None)
    about += [("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response")]
    head = HTTP.format(len(payload)).encode()
    if refers_to is None:
        return record("response", head + payload, about)
    about += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", str(refers_to))]
    return record("revisit", head, about)


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``sha, bytes, refers_to`` of the payloads that more than one page holds; only digests are shuffled."""
    text = F.coalesce(F.col(html_col), F.lit(""))
    seen = pages.select(F.col(id_col).alias("id"), F.sha1(F.encode(text, "UTF-8")).alias("sha"), F.octet_length(text).alias("bytes"))
    same = seen.where(F.col("bytes") >= least_bytes).groupBy("sha", "bytes").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    return same.where("n > 1").drop("n")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, compress: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archive below ``path`` and returns its manifest, ``file, records, bytes, header_bytes`` (the longest header block).

    The table of repeated payloads is written first, so that its size is known when the join is planned:
    a small one is sent to all tasks, a large one is merge-joined.
    """
    same = written(roles(pages, id_col, html_col, least_bytes), "roles")
    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.alias("html"))
    sha = F.when(F.octet_length("html") >= least_bytes, F.sha1(F.encode("html", "UTF-8")))
    rows = rows.join(same.withColumnRenamed("bytes", "n"), (sha == F.col("sha")) & (F.octet_length("html") == F.col("n")), "left")
    rows = rows.select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        filesystem, root = _open(path)
        filesystem.create_dir(root, recursive=True)
        pack = member if compress else bytes
        out, name, count, size, longest, k = None, "", 0, 0, 0, 0
        for batch in batches:
            for page_id, url, html, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{k}.warc" + ".gz" * compress
                    out, count, longest = filesystem.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    size = out.write(pack(record("warcinfo", b"software: stowage\r\nformat: WARC File Format 1.1\r\n", [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")])))
                data = page_record(page_id, url, html.encode("utf-8", "replace"), other)
                size += out.write(pack(data))
                count, longest = count + 1, max(longest, data.index(b"\r\n\r\n") + 4)
                if size >= file_bytes:
                    out.close()
                    yield _manifest(f"{path}/{name}", count, size, longest)
                    out, k = None, k + 1
        if out is not None:
            out.close()
            yield _manifest(f"{path}/{name}", count, size, longest)

    return written(rows.mapInArrow(run, "file string, records long, bytes long, header_bytes long"), "manifest")


def _manifest(name: str, *counts: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([n], pa.int64()) for n in counts)], ["file", "records", "bytes", "header_bytes"])


# -- reading -------------------------------------------------------------------------------------


class Window:
    """A file that is read at any place, through one buffer of fixed size."""

    def __init__(self, file):
        self.file, self.start, self.data = file, 0, b""
        file.seek(0, 2)
        self.size = file.tell()

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``; fewer at the end of the file."""
        n = max(0, min(n, self.size - at))
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            if n > CHUNK:
                self.file.seek(at)
                return self.file.read(n)
            self.file.seek(at)
            self.start, self.data = at, self.file.read(min(CHUNK, self.size - at))
        return self.data[at - self.start : at - self.start + n]

    def pieces(self, at: int, n: int) -> Iterator[bytes]:
        for k in range(at, at + n, PIECE):
            yield self.get(k, min(PIECE, at + n - k))

    def find(self, at: int) -> int:
        """The next place from ``at`` on where a member or a version line may start; the end if none."""
        while at < self.size:
            data = self.get(at, CHUNK)
            found = [k for k in (data.find(MAGIC), data.find(LINE)) if k >= 0]
            if found:
                return at + min(found)
            at += max(1, len(data) - len(LINE) + 1)
        return self.size


class Damage(Exception):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    kind: str = field(init=False)

    def __post_init__(self):
        self.kind = self.headers.get("warc-type", "")

    @property
    def payload(self) -> bytes:
        head, mark, body = self.block.partition(b"\r\n\r\n")
        return body if mark and head.startswith(b"HTTP/") else self.block


def _parse_head(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        if line:
            name, colon, value = line.partition(b":")
            if not colon:
                raise Damage("header line without colon")
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


class Check:
    """One record, taken piece by piece: its header, the length of its block, and the digests that its header names.

    Only digests written as ``sha1:`` and hexadecimal are known. The record itself is kept while it is small.
    """

    def __init__(self, header_bytes: int, need_digest: bool):
        self.most, self.need_digest = header_bytes, need_digest
        self.head, self.headers, self.length, self.seen = b"", None, 0, 0
        self.kept: bytearray | None = bytearray()
        self.tail = b""

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            if not self.head.startswith(LINE[: len(self.head)]):
                raise Damage("no version line")
            end = self.head.find(b"\r\n\r\n")
            if end < 0 and len(self.head) < self.most:
                return
            if end < 0 or end + 4 > self.most or not self.head.startswith(VERSIONS):
                raise Damage("no version line or header end")
            self.headers = _parse_head(self.head[:end])
            self.length = _length(self.headers)
            if self.length > HELD:
                self.kept = None
            self.whole, self.body, self.http = hashlib.sha1(), hashlib.sha1(), b""
            self.in_http = self.headers.get("warc-type") == "response"
            self.split = False
            data, self.head = self.head[end + 4 :], b""
        block = data[: max(0, self.length - self.seen)]
        self.seen += len(block)
        self.whole.update(block)
        if self.kept is not None:
            self.kept += block
        self._payload(block)
        self.tail += data[len(block) :]
        if len(self.tail) > 4:
            raise Damage("block length differs")

    def _payload(self, block: bytes) -> None:
        """The payload's digest: of what follows the HTTP header, or of the whole block if it has none."""
        if not self.in_http:
            return
        if self.split:
            self.body.update(block)
            return
        self.http += block
        end = self.http.find(b"\r\n\r\n")
        if not self.http.startswith(b"HTTP/"[: len(self.http)]) or end < 0 and (self.seen >= self.length or len(self.http) > max(self.most, HELD)):
            self.body.update(self.http)
        elif end >= 0:
            self.body.update(self.http[end + 4 :])
        else:
            return
        self.split, self.http = True, b""

    def end(self) -> None:
        if self.headers is None or self.seen < self.length or self.tail != b"\r\n\r\n":
            raise Damage("block length differs" if self.headers else "no version line or header end")
        whole, part = (self.headers.get(f"warc-{k}-digest", "") for k in ("block", "payload"))
        if len(whole) == 45 and whole.startswith("sha1:"):
            if self.whole.hexdigest() != whole[5:]:
                raise Damage("block digest differs")
        elif self.need_digest:
            raise Damage("no block digest")
        if self.in_http and len(part) == 45 and part.startswith("sha1:") and self.body.hexdigest() != part[5:]:
            raise Damage("payload digest differs")


def _length(headers: dict[str, str]) -> int:
    n = headers.get("content-length", "")
    if not n.isdecimal() or "warc-type" not in headers:
        raise Damage("no type or length")
    return int(n)


def _inflated(window: Window, at: int, ends: list[int]) -> Iterator[bytes]:
    """A member's content in pieces; appends where it ends."""
    z, here = zlib.decompressobj(31), at
    while not z.eof:
        piece = window.get(here, PIECE)
        over, here = not piece, here + len(piece)
        while over or piece and not z.eof:
            try:
                data = z.decompress(piece, CHUNK)
            except zlib.error as e:
                raise Damage(f"member: {str(e)[:60]}") from e
            if over and not data and not z.eof:
                raise Damage("member cut off")
            piece, over = z.unconsumed_tail, False
            if data:
                yield data
    ends.append(here - len(z.unused_data))


def _member(window: Window, at: int, need_digest: bool, header_bytes: int) -> tuple[Record, int]:
    check, ends = Check(max(header_bytes, HELD), need_digest), []
    for data in _inflated(window, at, ends):
        check.feed(data)
    check.end()
    if check.kept is None:
        check.kept, skip, head = bytearray(), 0, b""
        for data in _inflated(window, at, []):
            if not skip:
                head += data
                skip = head.find(b"\r\n\r\n") + 4
                if skip < 4:
                    skip = 0
                    continue
                data, head = head[skip:], b""
            check.kept += data[: check.length - len(check.kept)]
    return Record(check.headers, bytes(check.kept)), ends[0]


def _plain(window: Window, at: int, need_digest: bool, header_bytes: int) -> tuple[Record, int]:
    step = min(4096, header_bytes)
    head = window.get(at, step)
    if not head.startswith(VERSIONS):
        raise Damage("no version line")
    while (end := head.find(b"\r\n\r\n")) < 0:
        if step >= header_bytes or len(head) < step:
            raise Damage("no header end")
        step = min(2 * step, header_bytes)
        head = window.get(at, step)
    n = _length(_parse_head(head[:end]))
    if window.get(at + end + 4 + n, 4) != b"\r\n\r\n":  # before anything of that length is read
        raise Damage("block length differs")
    check = Check(header_bytes, need_digest)
    for data in window.pieces(at, end + 8 + n):
        check.feed(data)
    check.end()
    block = window.get(at + end + 4, n) if check.kept is None else bytes(check.kept)
    return Record(check.headers, block), at + end + 8 + n


def salvage(file, need_digest: bool = False, header_bytes: int = HEADER_BYTES) -> Iterator[Record | tuple[int, int, str]]:
    """Records of a file in order, and ``(start, end, reason)`` of the gaps between them; ``file`` can seek.

    With ``need_digest``, as for archives of this writer, a record without block digest counts as damaged.
    ``header_bytes`` is the longest header block of a record outside members.
    """
    window, at, gap, why = Window(file), 0, None, ""
    while at < window.size:
        try:
            found, end = (_member if window.get(at, 3) == MAGIC else _plain)(window, at, need_digest, header_bytes)
        except Damage as e:
            if gap is None:
                gap, why = at, str(e)
            at = window.find(at + 1)
            continue
        if gap is not None:
            yield gap, at, why
            gap = None
        yield found
        at = end
    if gap is not None:
        yield gap, at, why


def read(spark: SparkSession, files: DataFrame, id_type: str = "bigint", payload: bool = True, need_digest: bool = False, complete: bool = False) -> DataFrame:
    """Rows of records (gap columns null) and of gaps (record columns null) of the files in column ``file``.

    A row of ``files`` is a file; one task reads several, each through a window. ``files`` may be a manifest: its
    ``header_bytes`` is then heeded, and with ``complete`` a file must give as many records as it says.
    """
    count = max(1, files.count())
    longest = F.coalesce("header_bytes", F.lit(0)) if "header_bytes" in files.columns else F.lit(0)
    wanted = F.col("records") if complete else F.lit(0)
    spread = files.select("file", longest.cast("long").alias("header_bytes"), wanted.cast("long").alias("records")).repartitionByRange(min(count, 4 * spark.sparkContext.defaultParallelism + count // 8), "file")
    whole = pa.string() if id_type == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            types = (whole, pa.int64(), pa.string(), pa.string(), whole, pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string())
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        cast = (lambda x: x) if id_type == "string" else int
        for batch in batches:
            for name, header_bytes, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                filesystem, path = _open(name)
                with filesystem.open_input_file(path) as stream:
                    size, seen = 0, 0
                    for x in salvage(stream, need_digest, max(HEADER_BYTES, header_bytes)):
                        if isinstance(x, tuple):
                            rows.append((None,) * 6 + (name, *x))
                        elif x.kind in ("response", "revisit"):
                            h = x.headers
                            own, other = (None if h.get(k) is None else cast(h[k]) for k in ("warc-page-id", "warc-refers-to-page-id"))
                            body = x.payload
                            n = int(h["warc-payload-length"]) if x.kind == "revisit" else len(body)
                            rows.append((own, n, h.get("warc-payload-digest", "")[5:], x.kind, other, body if payload and x.kind == "response" else None, None, None, None, None))
                            size, seen = size + len(body), seen + 1
                        if len(rows) >= 2000 or size >= 8 << 20:
                            yield flush()
                            size = 0
                if complete and seen != records:
                    raise ValueError(f"{name}: {seen} records read, {records} written")
        if rows:
            yield flush()

    schema = f"{RECORD.format(id=id_type)}, {GAP}"
    names = [c.split()[0] for c in schema.split(", ")]
    return spread.mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archive of ``pages`` and reads it back: a row a page, as the records say; an error if one is missing."""
    spark = pages.sparkSession
    manifest = write(pages, scratch(spark, "warc"), id_col, url_col, html_col)
    rows = read(spark, manifest, pages.schema[id_col].dataType.simpleString(), payload=False, need_digest=True, complete=True)
    return rows.where("file is null").select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
