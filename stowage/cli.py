"""The verbs of an archiver over Spark: ``python -m stowage l|t|x|e|a|bc|bx|bt``; each returns an exit code.

Archives and sources may be many files, folders or globs, wherever Spark reads. ``x`` puts each archive into a folder
of its own below ``-o``. What is printed streams from Spark row by row.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.errors import EXIT_OK, KINDS, ArchiveError
from stowage.functions import values as V
from stowage.functions.detect import file_name
from stowage.operators import archives as A
from stowage.sources.archive import entries, read_archives

# Verbs, and those that are another name of one.
VERBS = {"l": "list", "t": "test", "x": "extract", "e": "extract without folders", "a": "add: create, or append to a ZIP that is there", "bc": "create an archive for each top folder or file"}
ALIASES = {"bx": "x", "bt": "t"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stowage", description=__doc__)
    out.add_argument("-y", action="store_true", help="answer yes: files that are there are replaced")
    verbs = out.add_subparsers(dest="verb", required=True)
    for verb, help_ in (VERBS | {k: VERBS[v] for k, v in ALIASES.items()}).items():
        p = verbs.add_parser(verb, help=help_)
        p.add_argument("-p", dest="password")
        p.add_argument("-y", action="store_true", default=argparse.SUPPRESS)
        if verb in ("a", "bc"):
            p.add_argument("--format")
            p.add_argument("-l", dest="level", type=int, default=6)
            p.add_argument("-v", dest="volume")
            p.add_argument("-t", dest="test", action="store_true")
            p.add_argument("--storeroot", action="store_true", help="names begin with the source folder's own name")
        if verb in ("x", "e", "bx"):
            p.add_argument("-o", dest="output", default=".")
            p.add_argument("--aoa", action="store_true")
            p.add_argument("--aos", action="store_true")
        p.add_argument("paths", nargs="+", help="the archive, then sources" if verb == "a" else "a folder to write to, then sources" if verb == "bc" else None)
    return out


def _files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")


def _code(kind: str | None) -> int:
    return EXIT_OK if kind is None else KINDS[kind][0]


def _items(spark: SparkSession, sources: Sequence[str], archive: str, storeroot: bool) -> DataFrame:
    """The sources' files and folders as items of one archive, in order."""
    out = None
    for k, source in enumerate(sources):
        name = source.rstrip("/").rsplit("/", 1)[-1]
        tree = A.source_tree(spark, source, archive, name if storeroot else "").withColumn("seq", F.col("seq") + (k << 40))
        # of a source that is a file its own name is the entry
        tree = tree.withColumn("path", F.when(F.col("path").isin("", name) & F.col("payload").isNotNull(), name).otherwise(F.col("path")))
        out = tree if out is None else out.unionByName(tree)
    return out


def _format(spark: SparkSession, token: str | None, path: str) -> str:
    if token is None:
        return spark.range(1).select(V.infer_format(F.lit(path))).first()[0]
    found = spark.range(1).select(V.parse_format(F.lit(token)).alias("f")).first().f
    if found.error:
        raise ArchiveError("UnsupportedFormat" if found.error == "unknown format" else "FeatureDisabled", f"{token}: {found.error}")
    return found.format


def _saved(spark: SparkSession, made: DataFrame, folder: str, o: argparse.Namespace, say: Callable[[str], None]) -> int:
    """Archives tested if asked for, cut if asked for, and written; the worst exit code."""
    from stowage.session import written

    made = written(made.select("path", "content", "error"), "made")
    worst = 0
    for r in made.where("error is not null").select("path", "error").toLocalIterator():
        say(f"{r.path}: {r.error.kind}: {r.error.message}")
        worst = max(worst, _code(r.error.kind))
    good = made.where("error is null")
    if o.test:
        worst = max(worst, _tested(A.verify(good, password=o.password), say))
    if o.volume:
        size = spark.range(1).select(V.parse_size(F.lit(o.volume)).cast("long")).first()[0]
        if not size:
            raise ArchiveError("InvalidArgument", f"volume size {o.volume}")
        good = A.split_volumes(good, size)
    for r in A.save(good, folder).orderBy("path").toLocalIterator():
        say(f"{r.file}  {r.bytes}")
    return worst


def _tested(checked: DataFrame, say: Callable[[str], None]) -> int:
    worst = 0
    for r in A.test_report(checked).orderBy("archive").toLocalIterator():
        say(f"{r.archive}: {r.tested} tested, {r.corrupted} corrupted" + (f", {r.error.kind}: {r.error.message}" if r.error else ""))
        for path in r.corrupted_paths:
            say(f"  {path}")
        worst = max(worst, _code(r.error.kind if r.error else "Corrupted" if r.corrupted else None))
    return worst


def _list(spark: SparkSession, o: argparse.Namespace, say: Callable[[str], None]) -> int:
    rows = read_archives(spark, o.paths, password=o.password, by_parts=True)
    line = V.listing(F.col("path"), F.col("is_directory"), F.col("uncompressed_size"), F.col("modified"))
    worst, archive = 0, None
    for r in rows.select("archive", "seq", line.alias("line"), "error").orderBy("archive", "seq").toLocalIterator():
        if r.archive != archive:
            archive = r.archive
            say(archive)
        say(f"{r.error.kind}: {r.error.message}" if r.seq < 0 else r.line)
        worst = max(worst, _code(r.error.kind) if r.error else 0)
    for r in A.totals(rows).orderBy("archive").toLocalIterator():
        say(f"{r.archive}: {r.entries} entries, {r.uncompressed} bytes, {r.compressed} packed" + (", encrypted" if r.encrypted else ""))
    return worst


def _extract(spark: SparkSession, o: argparse.Namespace, say: Callable[[str], None]) -> int:
    policy = "Always" if o.y or o.aoa else "IfNewer" if o.aos else "Never"
    files = _files(spark, o.paths)
    done = A.extract(files, o.output, password=o.password, policy=policy, flatten=o.verb == "e")
    unread = entries(files, password=o.password).where("seq < 0").select("archive", "error")
    worst = 0
    for r in done.where("error is not null").select("archive", "error").union(unread).orderBy("archive").toLocalIterator():
        say(f"{r.archive}: {r.error.kind}: {r.error.message}" + (f" ({r.error.entry})" if r.error.entry else ""))
        worst = max(worst, _code(r.error.kind))
    for r in done.where("warning is not null").orderBy("archive", "seq").toLocalIterator():
        say(f"{r.archive}: {r.out_path}: {r.warning}")
    counts = done.groupBy("archive").agg(F.count_if(F.col("action").isin("write", "link")).alias("n"), F.count_if(F.col("action") == "skip").alias("skipped"), F.sum("bytes").alias("bytes"))
    for r in counts.orderBy("archive").toLocalIterator():
        say(f"{r.archive}: {r.n} extracted, {r.skipped} skipped, {r.bytes} bytes")
    return worst


def _add(spark: SparkSession, o: argparse.Namespace, say: Callable[[str], None]) -> int:
    target, sources = o.paths[0], o.paths[1:]
    if not sources:
        raise ArchiveError("InvalidArgument", "nothing to add")
    folder, name = target.rsplit("/", 1) if "/" in target else (".", target)
    kind = _format(spark, o.format, name)
    items = _items(spark, sources, name, o.storeroot)
    there = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select(file_name(F.col("path")).alias("path"), "content") if _is_there(spark, target) else None
    if there is None:
        return _saved(spark, A.create(items, kind, o.level, o.password), folder, o, say)
    if kind not in ("Zip", "Zipx"):
        raise ArchiveError("FeatureDisabled", f"{kind} cannot be appended to")
    out = A.append(there, items, o.level)
    from stowage.session import written

    out = written(out, "appended")
    for r in out.select("path", "added", "skipped_existing").toLocalIterator():
        say(f"{r.path}: {r.added} added, {len(r.skipped_existing or [])} there already")
    return _saved(spark, out, folder, o, say)


def _is_there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _batch(spark: SparkSession, o: argparse.Namespace, say: Callable[[str], None]) -> int:
    folder, sources = o.paths[0], o.paths[1:]
    if not sources:
        raise ArchiveError("InvalidArgument", "nothing to add")
    kind = _format(spark, o.format or "zip", "")
    return _saved(spark, A.batch_create(_items(spark, sources, "", o.storeroot), kind, level=o.level, password=o.password), folder, o, say)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, say: Callable[[str], None] = print) -> int:
    """Runs a verb; the exit code is the worst of all archives', 2 for a call that makes no sense."""
    try:
        o = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    o.verb = ALIASES.get(o.verb, o.verb)
    if spark is None:
        from stowage.session import local_session

        spark = SparkSession.getActiveSession() or local_session()
    try:
        run = {"l": _list, "x": _extract, "e": _extract, "a": _add, "bc": _batch}.get(o.verb)
        return run(spark, o, say) if run else _tested(A.verify(_files(spark, o.paths), password=o.password), say)
    except ArchiveError as e:
        say(f"{e.kind}: {e.message}")
        return _code(e.kind)
