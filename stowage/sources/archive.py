"""Archives as tables: entries of files, or of rows that hold files, and a data source named ``archive``.

``read_archives`` lists files with Spark's own ``binaryFile`` reader, so any file system that Spark reads
will do. A file is one row and one parse; its entries stream out in batches, and payloads are decoded only
if asked for. An archive that cannot be opened is one row with ``seq`` -1 and its ``error``.

``read_archives(by_parts=True)`` and the data source open files in the tasks, through pyarrow's file systems: of
ZIP, plain tar and 7z only the directory, the headers, and the entries that are asked for are read, and compressed
streams and tars are decoded in pieces, so such files may have any size. Others are read whole, up to 2 GiB.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage

from stowage.errors import ERROR, ArchiveError, as_error
from stowage.formats import Archive, Entry, Ranged, detect, open_archive
from stowage.formats.write import Item, write_archive
from stowage.formats.zip import join_spanned

#: The entry schema: metadata of one entry, its place in the archive, and what went wrong.
ENTRY = (
    "archive string, format string, backend string, seq long, path string, is_directory boolean, is_symlink boolean, uncompressed_size long, "
    "compressed_size long, compression string, encryption string, crc32 long, modified timestamp, accessed timestamp, created timestamp, "
    f"attributes long, comment string, host_os string, link_target string, is_hardlink boolean, error {ERROR}"
)
CONTENT = ENTRY + ", content binary"
_ERROR = pa.struct([("kind", pa.string()), ("message", pa.string()), ("entry", pa.string())])
_TIME = pa.timestamp("us", tz="UTC")
ARROW = pa.schema(
    [
        ("archive", pa.string()), ("format", pa.string()), ("backend", pa.string()), ("seq", pa.int64()), ("path", pa.string()), ("is_directory", pa.bool_()),
        ("is_symlink", pa.bool_()), ("uncompressed_size", pa.int64()), ("compressed_size", pa.int64()), ("compression", pa.string()), ("encryption", pa.string()),
        ("crc32", pa.int64()), ("modified", _TIME), ("accessed", _TIME), ("created", _TIME), ("attributes", pa.int64()), ("comment", pa.string()),
        ("host_os", pa.string()), ("link_target", pa.string()), ("is_hardlink", pa.bool_()), ("error", _ERROR),
    ]
)
ARROW_CONTENT = ARROW.append(pa.field("content", pa.binary()))
#: A batch is given out at so many rows or bytes of payload.
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20
#: Decoded bytes of an entry that a row may hold.
CONTENT_LIMIT = 1 << 30


def _row(archive: str, a: Archive, seq: int, e: Entry, error: ArchiveError | None) -> tuple:
    return (
        archive, a.format, a.backend, seq, e.path, e.is_directory, e.is_symlink, e.uncompressed_size, e.compressed_size, e.compression, e.encryption, e.crc32,
        e.modified, None, None, e.attributes, e.comment, e.host_os, e.link_target, e.is_hardlink, error.row() if error else None,
    )


def opened(path: str):
    """A file of a path or URI, for reading by parts."""
    from pyarrow import fs

    if path.startswith("file:"):  # as Spark lists local files: not escaped
        path = "/" + path[5:].lstrip("/")
    filesystem, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return filesystem.open_input_file(root)


def entry_batches(name: str, data: bytes | Ranged, password: str | None = None, content: bool = False, limit: int = CONTENT_LIMIT, kind: str | None = None) -> Iterator[pa.RecordBatch]:
    """Entries of one archive as record batches of the schema."""
    schema = ARROW_CONTENT if content else ARROW
    rows, size = [], 0

    def flush() -> pa.RecordBatch:
        nonlocal rows, size
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        rows, size = [], 0
        return out

    try:
        a = open_archive(data, name, password, kind)
    except ArchiveError as e:
        rows.append((name, None, None, -1, *[None] * 16, e.row()) + (None,) * content)
        yield flush()
        return
    for seq, entry in enumerate(a.entries):
        payload, error = None, None
        if content and not entry.is_directory:
            try:
                payload = a.read(seq, limit)
                size += len(payload)
            except ArchiveError as e:
                error = e
        rows.append(_row(name, a, seq, entry, error) + ((payload,) if content else ()))
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield flush()
    if rows:
        yield flush()


def entries(archives: DataFrame, path_col: str = "path", content_col: str = "content", password: str | None = None, content: bool = False, limit: int = CONTENT_LIMIT) -> DataFrame:
    """Entries of every archive of a table with a path and a binary column; null files are archives that cannot be opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                yield from entry_batches(name, data or b"", password, content, limit)

    return archives.select(path_col, content_col).mapInArrow(run, CONTENT if content else ENTRY)


def read_archives(spark: SparkSession, path: str | list[str], password: str | None = None, content: bool = False, pattern: str | None = None, limit: int = CONTENT_LIMIT, by_parts: bool = False) -> DataFrame:
    """Entries of the files below a path; ``pattern`` is a glob on file names.

    With ``by_parts`` Spark only lists the files: its reader would fail on one of more than 2 GiB, and read all of each.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if by_parts:
        return entries_by_parts(reader.load(path).select("path", F.array("path").alias("files")), password, content, limit)
    return entries(reader.load(path).select("path", "content"), password=password, content=content, limit=limit)


def entries_by_parts(archives: DataFrame, password: str | None = None, content: bool = False, limit: int = CONTENT_LIMIT) -> DataFrame:
    """Entries of the archives of ``path, files``: ``files`` are the one file of an archive, or its volumes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, files in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with ExitStack() as held:
                    yield from entry_batches(name, Ranged(*(held.enter_context(opened(f)) for f in files)), password, content, limit)

    spread = archives.select("path", "files").repartition("path")  # a listing comes in few partitions
    return spread.mapInArrow(run, CONTENT if content else ENTRY)


def join_volumes(volumes: DataFrame, set_col: str = "set", index_col: str = "index", content_col: str = "content", spanned: bool = False) -> DataFrame:
    """One file a set, its volumes in order; ``spanned`` rewrites the directory of real multi-disk ZIPs.

    A set is one file and so one row; its volumes are gathered by the task that gets it, at most 2 GiB.
    """
    gathered = volumes.groupBy(F.col(set_col).alias("path")).agg(F.transform(F.sort_array(F.collect_list(F.struct(index_col, content_col))), lambda v: v[content_col]).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    whole, error = join_spanned(parts) if spanned else b"".join(parts), None
                except Exception as e:
                    whole, error = None, as_error(e).row()
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([whole], pa.binary()), pa.array([error], _ERROR)], ["path", "content", "error"])

    return gathered.mapInArrow(run, f"path string, content binary, error {ERROR}")


# -- the data source -----------------------------------------------------------------------------


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.only, self.kind = options, None, None

    def pushFilters(self, filters: list[Filter]):
        """An equality on ``archive`` picks files before any is opened, one on ``format`` by their first bytes; all stay with Spark too."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("archive",):
                self.only = f.value
            if isinstance(f, EqualTo) and f.attribute == ("format",):
                self.kind = f.value
            yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        found = []
        for base in self.options["path"].split(","):
            filesystem, root = fs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (fs.LocalFileSystem(), base)
            info = filesystem.get_file_info(root)
            infos = filesystem.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
            prefix = base[: len(base) - len(root)] if base.endswith(root) else ""
            found += [prefix + i.path for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
        return [_File(p) for p in sorted(found) if self.only in (None, p)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        o = self.options
        with opened(partition.path) as f:
            data = Ranged(f)
            kind = o.get("kind") or detect(data, partition.path)
            if self.kind in (None, kind):
                yield from entry_batches(partition.path, data, o.get("password"), o.get("includecontent", "false").lower() == "true", int(o.get("limit", CONTENT_LIMIT)), kind)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _ArchiveWriter(DataSourceArrowWriter):
    """Items of ``operators.archives.create`` as archive files: staged by tasks, moved into place by the commit.

    Rows of an archive must lie together in one partition, in order; a failed job leaves no archive.
    """

    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def _place(self):
        from pyarrow import fs

        base = self.options["path"]
        return fs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (fs.LocalFileSystem(), base)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        filesystem, root = self._place()
        filesystem.create_dir(root, recursive=True)
        o, staged, name, held, seen = self.options, [], None, [], set()

        def done() -> None:
            if name in seen:
                raise ArchiveError("InvalidArgument", f"rows of {name} do not lie together")
            seen.add(name)
            data = write_archive(held, o.get("kind", "Zip"), int(o.get("level", "6")), o.get("password"))
            path = f"{root}/{name}.{uuid.uuid4().hex}.part"
            filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with filesystem.open_output_stream(path, compression=None) as f:
                f.write(data)
            staged.append(path)

        for batch in iterator:
            for r in batch.to_pylist():
                if r["archive"] != name:
                    if name is not None:
                        done()
                    name, held = r["archive"], []
                held.append(Item(r["path"], r["payload"], r.get("modified"), r.get("mode")))
        if name is not None:
            done()
        return _Written(staged)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        filesystem, _ = self._place()
        for m in messages:
            for path in m.files if m else []:
                filesystem.move(path, path.rsplit(".", 2)[0])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        filesystem, _ = self._place()
        for m in messages:
            for path in m.files if m else []:
                filesystem.delete_file(path)


class ArchiveSource(DataSource):
    """``spark.read.format("archive").option("includeContent", ...).load(path)``: a partition a file.

    ``df.write.format("archive").option("kind", ...).mode("append").save(path)`` writes items as archives.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> str:
        return CONTENT if self._options().get("includecontent", "false").lower() == "true" else ENTRY

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self._options())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ArchiveWriter(self._options(), [f.name for f in schema.fields])


def register(spark: SparkSession) -> None:
    """Registers the source, and lets filters reach it: without that setting Spark refuses a source that takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
