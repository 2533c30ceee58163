"""Operations on archives as DataFrames: totals, tests, layout, gates, extraction, creation, appending, volumes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.errors import ERROR, ArchiveError, as_error
from stowage.formats import open_archive
from stowage.formats.model import READ_LIMIT, disk_mode
from stowage.formats.write import Item, append_zip, write_archive
from stowage.functions.paths import is_system_metadata, rename_collisions, resolve_output, symlink_fault, top_component
from stowage.functions.values import BOMB_BYTES, BOMB_RATIO, exit_code, ratio_suspect

LAYOUT_ENTRIES = 1024
OUTPUT_BYTES = 16 << 30
POLICIES = ("Never", "Always", "IfNewer", "Ask", "Rename")
_ERROR = pa.struct([("kind", pa.string()), ("message", pa.string()), ("entry", pa.string())])
MOST_VOLUMES = 999
# From how many entries, packed bytes and packed bytes an entry on a ZIP is extracted by many workers; large ones always are.
PARALLEL_ENTRIES, PARALLEL_BYTES, PARALLEL_MEAN, PARALLEL_LARGE = 8, 4 << 20, 32 << 10, 50 << 20


# -- aggregates ----------------------------------------------------------------------------------


def totals(entries: DataFrame, *by: str) -> DataFrame:
    """Entries, bytes and whether any is encrypted, by archive unless told otherwise; archives that did not open count 0."""
    opened = F.col("seq") >= 0
    return entries.groupBy(*(by or ("archive",))).agg(
        F.count_if(opened).alias("entries"), F.coalesce(F.sum("uncompressed_size"), F.lit(0)).alias("uncompressed"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("compressed"),
        F.coalesce(F.bool_or(F.col("encryption") != "None"), F.lit(False)).alias("encrypted"),
    )


def root_layout(entries: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """``archive, layout, folder``: SingleFolder if the first entries all lie below one top component, else Flat.

    An archive without entries has no rows in ``entries``; it is Flat if ``archives`` names it in ``path``.
    """
    first = entries.where((F.col("seq") >= 0) & (F.col("seq") < LAYOUT_ENTRIES))
    seen = first.select("archive", top_component(F.col("path")).alias("top"))
    tops = seen.groupBy("archive").agg(F.min("top").alias("low"), F.max("top").alias("high"), F.bool_and(F.col("top").isNotNull()).alias("below"))
    all_archives = entries.select("archive").distinct() if archives is None else archives.select(F.col("path").alias("archive")).distinct()
    single = F.coalesce(F.col("below") & (F.col("low") == F.col("high")) & (F.col("low") != ""), F.lit(False))
    return all_archives.join(tops, "archive", "left").select("archive", F.when(single, "SingleFolder").otherwise("Flat").alias("layout"), F.when(single, F.col("low")).alias("folder"))


def worst_exit(results: DataFrame, kind_col: str = "kind", *by: str) -> DataFrame:
    """The largest exit code of several targets."""
    return results.groupBy(*by).agg(F.coalesce(F.max(exit_code(F.col(kind_col))), F.lit(0)).alias("exit_code"))


# -- tests ---------------------------------------------------------------------------------------


def verify(archives: DataFrame, path_col: str = "path", content_col: str = "content", password: str | None = None) -> DataFrame:
    """``archive, seq, path, decoded, error`` of every file in every archive: each is decoded and checked, none is kept.

    A wrong password ends an archive's test; an archive that does not open is one row with ``seq`` -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                try:
                    a = open_archive(data or b"", name, password)
                except ArchiveError as e:
                    a = None
                    rows.append((name, -1, None, False, e.row()))
                for seq, e in enumerate(a.entries if a else []):
                    if e.is_directory or e.is_symlink:
                        continue
                    error, decoded = None, True
                    try:
                        payload = a.read(seq)
                        import zlib

                        if e.crc32 is not None and e.encryption == "None" and a.backend != "rar" and zlib.crc32(payload) != e.crc32:
                            error = ArchiveError("Corrupted", "CRC differs", e.path)
                    except ArchiveError as x:
                        error, decoded = x, False
                    rows.append((name, seq, e.path, decoded, error.row() if error else None))
                    if error and error.kind == "WrongPassword":
                        break
                if rows:
                    types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), _ERROR)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["archive", "seq", "path", "decoded", "error"])

    return archives.select(path_col, content_col).mapInArrow(run, f"archive string, seq long, path string, decoded boolean, error {ERROR}")


def test_report(checked: DataFrame) -> DataFrame:
    """``archive, tested, corrupted, corrupted_paths, error``: the error is what ended the test, if something did."""
    ends = F.when((F.col("seq") < 0) | (F.col("error.kind") == "WrongPassword"), F.col("error"))
    bad = F.when((F.col("seq") >= 0) & F.col("error").isNotNull() & (F.col("error.kind") != "WrongPassword"), F.struct("seq", "path"))
    out = checked.groupBy("archive").agg(F.count_if("decoded").alias("tested"), F.sort_array(F.collect_list(bad)).alias("bad"), F.max(ends).alias("error"))
    return out.select("archive", "tested", F.size("bad").cast("long").alias("corrupted"), F.transform("bad", lambda b: b["path"]).alias("corrupted_paths"), "error")


test_report.__test__ = False


# -- gates ---------------------------------------------------------------------------------------


def running_gate(entries: DataFrame, cap: int = OUTPUT_BYTES, limit: int = BOMB_RATIO, by: str = "archive", order: str = "seq", floor: int = BOMB_BYTES, ratio_counts: Column | None = None) -> DataFrame:
    """Adds ``so_far, breach``: bytes up to each entry in order, and whether the whole is over the cap or the ratio there.

    ``ratio_counts`` says for which rows the ratio of the totals is looked at, by default all. One archive's
    entries are one window; an archive is one file and was one task's parse already.
    """
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out, packed = F.sum("uncompressed_size").over(w), F.sum("compressed_size").over(w)
    ratio = F.floor(F.try_divide(out.cast("decimal(38,0)"), packed.cast("decimal(38,0)")))
    steep = (out >= floor) & F.coalesce(ratio > limit, F.lit(False))
    breach = (out > cap) | (steep if ratio_counts is None else steep & ratio_counts)
    return entries.withColumns({"so_far": out, "breach": breach})


def extracted_in_order(entries: DataFrame) -> Column:
    """Whether an archive's entries are extracted one after another by the generic path, which is the one that keeps running totals.

    Of ZIPs those with few or small entries are; other backends have paths of their own.
    """
    if "backend" not in entries.columns:
        return F.lit(True)
    w = W.partitionBy("archive")
    n, packed = F.count("*").over(w), F.sum("compressed_size").over(w)
    few = (n < PARALLEL_ENTRIES) | (packed < PARALLEL_BYTES) | ((packed < PARALLEL_LARGE) & (F.floor(packed / n) < PARALLEL_MEAN))
    return F.coalesce(F.col("backend").isin("zip", "zip-lenient") & few, F.lit(True))


def first_errors(rows: DataFrame, by: str = "archive", order: str = "seq") -> DataFrame:
    """The first error of each archive in archive order, which is the one an operation ends with."""
    found = rows.where(F.col("error").isNotNull())
    return found.groupBy(by).agg(F.min_by("error", order).alias("error"), F.min(order).alias("at"))


def plan_extraction(entries: DataFrame, existing: DataFrame | None = None, policy: str = "Never", flatten: bool = False, follow_symlinks: bool = False, limit: int = BOMB_RATIO, cap: int = OUTPUT_BYTES, only: list[str] | None = None) -> DataFrame:
    """What extraction would do with every entry, by columns alone: ``action`` (write, mkdir, link, skip, fail), ``out_path``, ``error``, ``warning``.

    Gates stand in the order of the serial path: ratio of the entry, symbolic link, path, directory,
    existing file under ``policy``, running totals. Where ``entries`` has a ``backend``, it decides the rest: the
    ratio of running totals counts where entries are extracted in order only, 7z reports its own kind of error,
    and RAR makes no links. A link that is not made is a skip with a warning. ``only`` (an extension) names the
    entries to take.
    """
    if policy not in POLICIES:
        raise ArchiveError("InvalidArgument", f"policy {policy}")
    rows = entries.where("seq >= 0")
    rows = running_gate(rows.withColumn("_ordered", extracted_in_order(rows)), cap, limit, ratio_counts=F.col("_ordered"))
    backend = F.coalesce(F.col("backend"), F.lit("")) if "backend" in entries.columns else F.lit("")
    if only is not None:
        rows = rows.where(F.col("path").isin(only))
    rows = rows.withColumn("_to", resolve_output(F.col("path"), F.col("is_directory"), flatten))
    rows = rows.withColumn("out_path", F.col("_to.path"))
    if policy == "Rename":
        files = rows.where(~F.col("is_directory") & F.col("out_path").isNotNull())
        taken = existing.select("archive", "path") if existing is not None else None
        named = rename_collisions(files, "out_path", ["seq"], ["archive"], taken, "_new").select(F.col("archive").alias("_a"), F.col("seq").alias("_s"), "_new")
        rows = rows.join(named, (F.col("archive") == F.col("_a")) & (F.col("seq") == F.col("_s")), "left").withColumn("out_path", F.coalesce("_new", "out_path")).drop("_a", "_s", "_new")
        there = F.lit(False)
    else:
        first = F.row_number().over(W.partitionBy("archive", "out_path").orderBy("seq")) > 1
        if existing is not None:
            on_disk = existing.select(F.col("archive").alias("_a"), F.col("path").alias("_p")).distinct().withColumn("_on_disk", F.lit(True))
            rows = rows.join(on_disk, (F.col("archive") == F.col("_a")) & (F.col("out_path") == F.col("_p")), "left").drop("_a", "_p")
            there = F.coalesce("_on_disk", F.lit(False)) | first
        else:
            there = first
        rows = rows.withColumn("_there", ~F.col("is_directory") & F.col("out_path").isNotNull() & there)
        there = F.col("_there")
    own = lambda kind: F.when(backend == "7z", "BackendError").otherwise(kind)
    error = lambda kind, text: F.struct(kind.alias("kind"), F.lit(text).alias("message"), F.col("path").alias("entry"))
    suspect = ratio_suspect(F.col("is_directory"), F.col("is_symlink"), F.col("uncompressed_size"), F.col("compressed_size"), limit)
    fault = F.when(F.lit(not follow_symlinks) | (backend == "rar"), F.lit("links are not followed")).otherwise(symlink_fault(F.col("out_path"), F.col("link_target")))
    link = F.when(fault.isNotNull(), "skip").otherwise("link")
    action = (
        F.when(suspect, "fail").when(F.col("is_symlink"), link).when(F.col("_to.blocked"), "fail").when(F.col("is_directory"), "mkdir")
        .when(there & F.lit(policy == "Never"), "fail").when(there & F.lit(policy in ("IfNewer", "Ask")), "skip").when(F.col("breach"), "fail").otherwise("write")
    )
    why = (
        F.when(suspect, error(own("ZipBombSuspected"), "ratio")).when(F.col("is_symlink"), F.lit(None)).when(F.col("_to.blocked"), error(F.lit("PathTraversalBlocked"), "path"))
        .when(~F.col("is_directory") & there & F.lit(policy == "Never"), error(own("Io"), "already exists")).when(~F.col("is_directory") & F.col("breach"), error(F.lit("ZipBombSuspected"), "total"))
    )
    said = F.when((F.col("action") == "skip") & F.col("is_symlink"), F.concat(F.lit("symbolic link skipped: "), fault))
    out = rows.withColumns({"action": action, "error": F.when(action == "fail", why)}).withColumn("warning", said)
    ended = F.coalesce(F.max(F.when(F.col("action") == "fail", 1).otherwise(0)).over(W.partitionBy("archive").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("reached", ended == 0).drop("_to", "_on_disk", "_there", "_ordered", "breach")


def extract_report(plan: DataFrame) -> DataFrame:
    """``archive, extracted, skipped, bytes, error, warnings`` of a plan; warnings are those of entries that were reached, in order."""
    warned = F.when(F.col("reached") & F.col("warning").isNotNull(), F.struct("seq", "warning"))
    done = F.col("reached") & F.col("action").isin("write", "link")
    return plan.groupBy("archive").agg(
        F.count_if(done).alias("extracted"), F.count_if(F.col("reached") & (F.col("action") == "skip")).alias("skipped"),
        F.coalesce(F.sum(F.when(F.col("reached") & (F.col("action") == "write"), F.col("uncompressed_size"))), F.lit(0)).alias("bytes"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"),
        F.transform(F.sort_array(F.collect_list(warned)), lambda x: x["warning"]).alias("warnings"),
    )


def reader_warnings(archives: DataFrame, path_col: str = "path", content_col: str = "content", password: str | None = None) -> DataFrame:
    """``archive, place, warning``: what the readers had to pass over to open each archive; none for those that do not open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = open_archive(data or b"", name, password).warnings
                except ArchiveError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], ["archive", "place", "warning"])

    return archives.select(path_col, content_col).mapInArrow(run, "archive string, place long, warning string")


def extract(archives: DataFrame, dest: str, path_col: str = "path", content_col: str = "content", password: str | None = None, policy: str = "Never", cap: int = OUTPUT_BYTES, **options) -> DataFrame:
    """Extracts every archive into a folder of its own below ``dest``, and returns a status row an entry.

    The plan is made by columns from metadata and from the files that are there already; payloads are decoded and
    written by the task that holds the archive, and never shuffled. What is decoded counts against ``cap``, whatever
    sizes are stated. Tasks write below a folder of the job, which retries may overwrite; when all have ended, files
    are moved into place, and under any policy but ``Always`` never over one that has appeared since.
    """
    from stowage.session import written

    spark, job = archives.sparkSession, f".extract-{uuid.uuid4().hex}"
    from stowage.sources.archive import entries

    archives = archives.select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))
    folders = written(folders_of(archives.select("path")), "folders")
    existing = written(existing_files(folders, dest), "existing")
    plan = plan_extraction(entries(archives, password=password), existing=existing, policy=policy, cap=cap, **options).where("reached")
    plan = written(plan.select("archive", "seq", "action", "out_path", "error", "warning"), "plan")
    steps = plan.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("seq", "action", "out_path", "error", "warning"))).alias("steps"))
    work = archives.join(steps.join(folders, "archive"), F.col("path") == F.col("archive")).select("archive", "content", "folder", "steps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _file_system(dest)
        for batch in batches:
            for name, data, folder, todo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, base, rows, left = open_archive(data, name, password), f"{root}/{job}/{folder}", [], cap
                for step in todo:
                    error, size, action = step["error"], 0, step["action"]
                    if action == "write":
                        target = f"{base}/{step['out_path']}"
                        try:
                            payload = a.read(step["seq"], min(READ_LIMIT, left))
                            size = len(payload)
                            left -= size
                            filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
                            with filesystem.open_output_stream(target, compression=None) as f:
                                f.write(payload)
                        except (ArchiveError, OSError) as e:
                            error, action = as_error(e).row(), "fail"
                    entry = a.entries[step["seq"]]
                    mode = disk_mode(entry)
                    rows.append((name, folder, step["seq"], action, step["out_path"], size, error, step["warning"], entry.link_target, mode, entry.modified))
                    if error and action == "fail":
                        break
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STAGED.types, strict=True)], schema=_STAGED)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _file_system(dest)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                base = f"{root}/{r['folder']}"
                target = f"{base}/{r['out_path']}" if r["out_path"] else base
                try:
                    _put(filesystem, f"{root}/{job}/{r['folder']}/{r['out_path']}", target, r, policy == "Always")
                except (ArchiveError, OSError) as e:
                    r |= {"action": "fail", "bytes": 0, "error": as_error(e, r["out_path"]).row()}
                rows.append(r)
            out = pa.RecordBatch.from_pylist(rows, _STAGED)
            yield out.select(["archive", "seq", "action", "out_path", "bytes", "error", "warning"])

    kinds = f"archive string, folder string, seq long, action string, out_path string, bytes long, error {ERROR}, warning string, link_target string, mode int, modified timestamp"
    staged = written(work.mapInArrow(run, kinds), "staged")
    out = written(staged.mapInArrow(place, f"archive string, seq long, action string, out_path string, bytes long, error {ERROR}, warning string"), "extracted")
    filesystem, root = _file_system(dest)
    from pyarrow import fs

    if filesystem.get_file_info(f"{root}/{job}").type == fs.FileType.Directory:
        filesystem.delete_dir(f"{root}/{job}")
    return out


_STAGED = pa.schema(
    [
        ("archive", pa.string()), ("folder", pa.string()), ("seq", pa.int64()), ("action", pa.string()), ("out_path", pa.string()), ("bytes", pa.int64()), ("error", _ERROR),
        ("warning", pa.string()), ("link_target", pa.string()), ("mode", pa.int32()), ("modified", pa.timestamp("us", tz="UTC")),
    ]
)


def _file_system(place: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)


def _put(filesystem, source: str, target: str, row: dict, over: bool) -> None:
    """One staged entry into place. A file whose staged form is gone was moved by an earlier attempt of the task."""
    import os

    from pyarrow import fs

    local, action = isinstance(filesystem, fs.LocalFileSystem), row["action"]
    kind = lambda path: filesystem.get_file_info(path).type
    if action == "mkdir":
        filesystem.create_dir(target, recursive=True)
    elif action == "write":
        if kind(source) == fs.FileType.NotFound and kind(target) == fs.FileType.File:
            return
        filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
        if local and not over:
            try:
                os.link(source, target)  # fails if the target is there
            except FileExistsError as e:
                if not os.path.samefile(source, target):
                    raise ArchiveError("Io", "already exists", row["out_path"]) from e
            os.remove(source)
        elif not over and kind(target) != fs.FileType.NotFound:
            raise ArchiveError("Io", "already exists", row["out_path"])
        else:
            filesystem.move(source, target)
    elif action == "link" and local:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if os.path.islink(target) and os.readlink(target) == row["link_target"]:
            return
        if os.path.lexists(target):
            if not over:
                raise ArchiveError("Io", "already exists", row["out_path"])
            os.remove(target)
        os.symlink(row["link_target"], target)
    if local and action in ("mkdir", "write"):  # other file systems have neither modes nor times to set
        if row["mode"] is not None:
            os.chmod(target, row["mode"])
        if row["modified"] is not None and action == "write":
            os.utime(target, (row["modified"].timestamp(),) * 2)


def existing_files(folders: DataFrame, dest: str) -> DataFrame:
    """``archive, path`` of all files below each archive's folder in ``dest``, listed by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        filesystem, root = _file_system(dest)
        for batch in batches:
            for name, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base = f"{root}/{folder}"
                found = [i.path[len(base) + 1 :] for i in filesystem.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)) if i.type != fs.FileType.Directory]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.string())], ["archive", "path"])

    return folders.select("archive", "folder").mapInArrow(run, "archive string, path string")


def folder_of(name: str) -> str:
    """The folder that an archive is extracted to: its own name without archive extensions."""
    base = name.rstrip("/").rsplit("/", 1)[-1]
    stem = base.rsplit(".", 1)[0] if "." in base.lstrip(".") else base
    return stem[:-4] if stem.lower().endswith(".tar") and len(stem) > 4 else stem or base


def folders_of(archives: DataFrame, path_col: str = "path") -> DataFrame:
    """``archive, folder``: of archives whose folder would be the same, all but the first by path get a mark made of their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([folder_of(n) for n in names], pa.string())], ["archive", "folder"])

    return _told_apart(archives.select(path_col).distinct().mapInArrow(run, "archive string, folder string"), "folder")


def _told_apart(rows: DataFrame, name: str, ending: Column | None = None) -> DataFrame:
    """``rows(archive, name)`` with unique names: later claims of a name get 16 digits of their path's hash before the ``ending``."""
    first = rows.groupBy(F.col(name).alias("_n")).agg(F.min("archive").alias("_first"))
    mark = F.concat(F.lit("-"), F.substring(F.sha1(F.encode("archive", "UTF-8")), 1, 16))
    end = F.lit("") if ending is None else ending
    other = F.concat(F.substring(F.col(name), F.lit(1), F.length(name) - F.length(end)), mark, end)
    rows = rows.join(first, F.col(name) == F.col("_n"))
    return rows.withColumn(name, F.when(F.col("archive") == F.col("_first"), F.col(name)).otherwise(other)).drop("_n", "_first")


# -- sinks ---------------------------------------------------------------------------------------


def create(items: DataFrame, kind: str = "Zip", level: int = 6, password: str | None = None, exclude_metadata: bool = True, smart: bool = True) -> DataFrame:
    """``path, content, entries, error``: one archive for each ``archive`` of items ``(archive, seq, path, payload, modified, mode)``.

    Items are dealt by archive and stream through the task in order; an archive is held while it is written.
    """
    rows = items.where(~is_system_metadata(F.col("path"))) if exclude_metadata else items
    rows = rows.select("archive", "seq", "path", "payload", "modified", "mode").repartition("archive").sortWithinPartitions("archive", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def done() -> pa.RecordBatch:
            try:
                data, error = write_archive(held, kind, level, password, smart), None
            except Exception as e:
                data, error = None, as_error(e).row()
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([data], pa.binary()), pa.array([len(held)], pa.int64()), pa.array([error], _ERROR)], ["path", "content", "entries", "error"])

        for batch in batches:
            for archive, _, path, payload, modified, mode in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    if name is not None:
                        yield done()
                    name, held = archive, []
                held.append(Item(path, payload, modified, mode))
        if name is not None:
            yield done()

    return rows.mapInArrow(run, f"path string, content binary, entries long, error {ERROR}")


def create_verified(items: DataFrame, kind: str = "Zip", **options) -> DataFrame:
    """``create``, each archive opened again and tested: adds ``tested, corrupted``. The archives are written once, to be read twice."""
    from stowage.session import written

    made = written(create(items, kind, **options), "made")
    report = test_report(verify(made.where("content is not null"), password=options.get("password"))).select(F.col("archive").alias("_a"), "tested", "corrupted")
    return made.join(report, F.col("path") == F.col("_a"), "left").drop("_a")


def batch_create(items: DataFrame, kind: str = "Zip", **options) -> DataFrame:
    """One archive for each top component of the items' paths, named after it."""
    from stowage.functions.values import PRIMARY_EXTENSIONS

    top = F.coalesce(top_component(F.col("path")), F.regexp_replace("path", r"\.[^./]*$", ""))
    return create(items.withColumn("archive", F.concat(top, F.lit("." + PRIMARY_EXTENSIONS[kind]))), kind, **options)


def append_plan(existing: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items that an archive lacks, and those it has by name: ``existing`` holds entries, both have ``archive, path``."""
    names = existing.where("seq >= 0").select("archive", "path")
    return items.join(names, ["archive", "path"], "left_anti"), items.join(names, ["archive", "path"], "left_semi")


def append(archives: DataFrame, items: DataFrame, level: int = 6) -> DataFrame:
    """``path, content, added, skipped_existing, error``: ZIPs with their items added; what is there stays as it is."""
    packed = items.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("seq", "path", "payload"))).alias("items"))
    work = archives.join(packed, F.col("path") == F.col("archive")).select("path", "content", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    (out, added, skipped), error = append_zip(data, [Item(i["path"], i["payload"]) for i in own], level), None
                except Exception as e:
                    out, added, skipped, error = None, [], [], as_error(e).row()
                cols = [pa.array([name]), pa.array([out], pa.binary()), pa.array([len(added)], pa.int64()), pa.array([skipped], pa.list_(pa.string())), pa.array([error], _ERROR)]
                yield pa.RecordBatch.from_arrays(cols, ["path", "content", "added", "skipped_existing", "error"])

    return work.mapInArrow(run, f"path string, content binary, added long, skipped_existing array<string>, error {ERROR}")


def split_volumes(archives: DataFrame, size: int, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``set, index, path, content``: an archive cut into volumes ``.001``, ``.002``, ...; an empty one is one empty volume.

    More than 999 volumes are an error of the caller's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, whole = batch.column(0)[k].as_py(), batch.column(1)[k].as_buffer()
                held = len(whole) if whole is not None else 0
                n = max(1, -(-held // size))
                if n > MOST_VOLUMES:
                    raise ArchiveError("InvalidArgument", f"InvalidArgument: more than {MOST_VOLUMES} volumes")
                for index in range(1, n + 1):  # a volume is a slice: the archive is never copied
                    part = whole.slice((index - 1) * size, min(size, held - (index - 1) * size)).to_pybytes() if held else b""
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([index], pa.int32()), pa.array([f"{name}.{index:03}"]), pa.array([part], pa.binary())], ["set", "index", "path", "content"])

    return archives.select(path_col, content_col).mapInArrow(run, "set string, index int, path string, content binary")


def without(archives_entries: DataFrame, names: list[str]) -> DataFrame:
    """Entries without those queued for removal (an extension: asks that are recorded elsewhere take effect here)."""
    return archives_entries.where(~F.col("path").isin(names))


def save(archives: DataFrame, dest: str, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Writes archive bytes as files below ``dest``, each under a name of its task's own and then moved; returns ``path, file, bytes``.

    Files are named after the last part of their path; of equal names all but the first by path get a mark
    before their ending, so that no file takes another's place.
    """
    from stowage.session import written

    names = archives.select(F.col(path_col).alias("archive")).distinct().withColumn("file", F.regexp_extract("archive", r"([^/]*)$", 1))
    names = _told_apart(names, "file", F.regexp_extract("file", r"(?s).((?:\.tar)?\.[^.]*)$", 1)).withColumnRenamed("archive", "_of")
    rows = archives.join(names, F.col(path_col) == F.col("_of")).select(path_col, content_col, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _file_system(dest)
        filesystem.create_dir(root, recursive=True)
        for batch in batches:
            for name, data, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = f"{root}/{file}"
                part = f"{target}.{uuid.uuid4().hex}.part"
                with filesystem.open_output_stream(part, compression=None) as f:
                    f.write(data or b"")
                filesystem.move(part, target)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([target]), pa.array([len(data or b"")], pa.int64())], ["path", "file", "bytes"])

    return written(rows.mapInArrow(run, "path string, file string, bytes long"), "saved")


def source_tree(spark: SparkSession, root: str, archive: str, prefix: str = "") -> DataFrame:
    """Items of ``create`` from the folders and files below a folder, in order of their paths; payloads are read by Spark's reader.

    Only paths are put in order, by ranges; each payload joins its place by path.
    """
    from stowage.functions.paths import entry_name
    from stowage.session import written

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if "://" in root or root.startswith("file:") else "file:" + root
    relative = F.regexp_replace(F.regexp_replace(F.col("path"), "^file:/+", "/"), "^" + _quoted(base.replace("file://", "").replace("file:", "").rstrip("/")) + "/*", "")
    name = entry_name(F.lit(prefix), relative)
    # folders first, as far as they hold files: Spark lists no empty ones
    parts = F.split(relative, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = files.where(F.size(parts) > 1).select(F.explode(above).alias("_folder")).distinct()
    folders = folders.select(F.lit(None).cast("string").alias("_file"), F.concat(entry_name(F.lit(prefix), F.col("_folder")), F.lit("/")).alias("_name"))
    both = folders.unionByName(files.select(F.col("path").alias("_file"), name.alias("_name"))).withColumn("_late", F.col("_file").isNotNull())
    ranged = written(both.repartitionByRange("_late", "_name").withColumn("_part", F.spark_partition_id()), "names")
    starts, at = [], 0
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():  # a row a range
        starts.append((r["_part"], at))
        at += r["count"]
    begins = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy("_late", "_name", "_file"))
    places = ranged.join(begins, "_part").select("_file", "_name", (F.col("_start") + inside).alias("seq"))
    rows = places.join(files.select(F.col("path").alias("_of"), "content", "modificationTime"), F.col("_of") == F.col("_file"), "left")
    return rows.select(F.lit(archive).alias("archive"), F.col("_name").alias("path"), F.col("content").alias("payload"), F.col("modificationTime").alias("modified"), F.lit(None).cast("int").alias("mode"), "seq")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def volume_totals(volumes: DataFrame, set_col: str = "set", content_col: str = "content") -> DataFrame:
    return volumes.groupBy(set_col).agg(F.count("*").alias("volumes"), F.sum(F.octet_length(content_col)).alias("bytes"))


def split_sets(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``kind, stem, volumes``: files that form volume sets of two or more, by their names.

    ``x.zip.001`` and on are raw pieces, ``x.z01`` with ``x.zip`` a spanned ZIP, ``x.7z.001`` a 7z set.
    """
    from stowage.functions.detect import has_archive_extension

    p = F.col(path_col)
    numbered, spanned = r"(?s)^(.+)\.(\d{3,4})$", r"(?is)^(.+)\.z(\d{2,3})$"
    stem = F.regexp_extract(p, numbered, 1)
    raw = (stem != "") & has_archive_extension(stem)
    kind = F.when(raw, "RawByteSplit").when(p.rlike(spanned) | F.lower(p).endswith(".zip"), "Spanned")
    of = F.when(raw, stem).when(p.rlike(spanned), F.regexp_extract(p, spanned, 1)).otherwise(F.regexp_replace(p, r"(?i)\.zip$", ""))
    last = F.when(raw, F.regexp_extract(p, numbered, 2).cast("int")).when(p.rlike(spanned), F.regexp_extract(p, spanned, 2).cast("int")).otherwise(100_000)
    rows = files.select(p.alias("path"), kind.alias("kind"), of.alias("stem"), last.alias("index")).where("kind is not null")
    # a gap ends a set: the run from the lowest index counts, and a spanned set needs its first piece
    place = F.row_number().over(W.partitionBy("kind", "stem").orderBy("index"))
    low = F.min("index").over(W.partitionBy("kind", "stem"))
    rows = rows.withColumns({"at": place, "low": low}).where((F.col("index") == F.col("low") + F.col("at") - 1) | ((F.col("kind") == "Spanned") & (F.col("index") == 100_000)))
    sets = rows.groupBy("kind", "stem").agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "path"))), lambda v: v["path"]).alias("volumes"))
    return sets.where(F.size("volumes") >= 2)


def read_sets(spark: SparkSession, root: str, content: bool = False, password: str | None = None) -> DataFrame:
    """Entries of the volume sets below a folder. Raw pieces are read by parts, as one file of any size; spanned ZIPs,
    whose directory gets whole offsets, are joined first, up to 2 GiB."""
    from stowage.sources.archive import entries, entries_by_parts, join_volumes

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    sets = split_sets(files.select("path"))
    raw = entries_by_parts(sets.where("kind = 'RawByteSplit'").select(F.col("stem").alias("path"), F.col("volumes").alias("files")), password, content)
    spanned = sets.where("kind = 'Spanned'").select("stem", F.posexplode("volumes").alias("index", "volume"))
    volumes = files.select("path", "content").join(spanned, F.col("path") == F.col("volume"))
    joined = join_volumes(volumes.select(F.concat("stem", F.lit(".zip")).alias("set"), "index", "content"), spanned=True)
    return raw.unionByName(entries(joined.where("error is null"), content=content, password=password))


def destination(archive_path: Column, layout: Column) -> Column:
    """Smart extraction: in place for a single root folder, else below a folder of the archive's own name."""
    here = F.regexp_replace(archive_path, r"[^/]*$", "")
    name = F.regexp_extract(archive_path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?i)(\.tar)?\.[^.]*$", "")
    return F.when(layout == "SingleFolder", here).otherwise(F.concat(here, stem))
