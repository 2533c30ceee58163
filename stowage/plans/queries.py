"""Queries over the driver's tables that exercise the archive operators, with their SQL.

``documents`` is packed into archives of 256 documents by language, ``pages`` into single streams, and the
other tables give times, sizes and names. Every query takes its whole table.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.formats.streams import lz4_frame
from stowage.functions import detect as D
from stowage.functions import paths as P
from stowage.functions import values as V
from stowage.operators import archives as A
from stowage.session import table
from stowage.sources.archive import entries, join_volumes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PER_ARCHIVE = 256


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from stowage.plans import more  # noqa: F401, it adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from stowage.plans import more  # noqa: F401

    return dict(ORACLE)


# -- inputs --------------------------------------------------------------------------------------


def document_items(spark: SparkSession, sf_dir: str, ext: str = "zip") -> DataFrame:
    """A document an entry, ``<source>/<doc_id>.txt``, in archives ``<lang>-<nnn>.<ext>``."""
    d = table(spark, sf_dir, "documents")
    name = F.concat("lang", F.lit("-"), F.floor(F.col("doc_id") / PER_ARCHIVE).cast("string"), F.lit("." + ext))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    modified = F.timestamp_seconds(F.col("doc_id") * 2 + 1_000_000_000)
    return d.select(name.alias("archive"), F.col("doc_id").alias("seq"), path.alias("path"), F.encode("text", "UTF-8").alias("payload"), modified.alias("modified"), F.lit(0o640).alias("mode"))


def packed(spark: SparkSession, sf_dir: str, kind: str, ext: str, **options) -> DataFrame:
    return A.create(document_items(spark, sf_dir, ext), kind, **options)


def _round_trip(spark: SparkSession, sf_dir: str, kind: str, ext: str, password: str | None = None) -> DataFrame:
    rows = entries(packed(spark, sf_dir, kind, ext, password=password), content=True, password=password)
    return rows.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


DOCUMENTS = "select doc_id, text from documents"


@query(DOCUMENTS)
def roundtrip_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "Zip", "zip")


@query(DOCUMENTS)
def roundtrip_zipx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "Zipx", "zipx")


@query(DOCUMENTS)
def roundtrip_zip_aes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "Zip", "zip", "correct horse")


@query(DOCUMENTS)
def roundtrip_sevenz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "SevenZ", "7z")


@query(DOCUMENTS)
def roundtrip_tar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "Tar", "tar")


@query(DOCUMENTS)
def roundtrip_targz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "TarGz", "tar.gz")


def _stream(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    """Every page as a compressed stream of its own, read back through the stream reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lambda b: lzma.compress(b, preset=1), "lzma": lambda b: lzma.compress(b, lzma.FORMAT_ALONE, preset=1), "zst": zstandard.ZstdCompressor().compress, "lz4": lz4_frame}[suffix]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(b or b"") for b in batch.column(1).to_pylist()], pa.binary())], ["path", "content"])

    pages = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(f".html.{suffix}")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    rows = entries(pages.mapInArrow(run, "path string, content binary"), content=True)
    return rows.select(F.regexp_extract("path", r"^(\d+)\.html$", 1).cast("long").alias("page_id"), F.decode("content", "UTF-8").alias("html"))


def _add_streams() -> None:
    for suffix in ("gz", "bz2", "xz", "lzma", "zst", "lz4"):
        QUERIES[f"stream_{suffix}"] = lambda spark, sf_dir, suffix=suffix: _stream(spark, sf_dir, suffix)
        ORACLE[f"stream_{suffix}"] = "select page_id, html from pages"


_add_streams()

ARCHIVE_SQL = f"lang || '-' || cast(doc_id // {PER_ARCHIVE} as varchar) || '.zip'"


@query(f"select {ARCHIVE_SQL} as archive, count(*) as entries, cast(sum(strlen(text)) as bigint) as uncompressed, false as encrypted from documents group by 1")
def list_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.totals(entries(packed(spark, sf_dir, "Zip", "zip"))).drop("compressed")


@query(
    f"select {ARCHIVE_SQL} as archive, source || '/' || cast(doc_id as varchar) || '.txt' as path, cast(strlen(text) as bigint) as size, 'None' as encryption, cast(33184 as bigint) as attributes, "
    "strftime(to_timestamp(1000000000 + 2 * doc_id) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as modified, row_number() over (partition by lang, doc_id // 256 order by doc_id) - 1 as seq from documents"
)
def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(packed(spark, sf_dir, "Zip", "zip"))
    return rows.select("archive", "path", F.col("uncompressed_size").alias("size"), "encryption", "attributes", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"), "seq")


@query(
    f"with d as (select {ARCHIVE_SQL} as archive, doc_id, text from documents), t as (select archive, (min(doc_id) // {PER_ARCHIVE}) % 2 = 1 and max(strlen(text)) > 0 as hurt, count(*) as n from d group by 1) "
    "select archive, n - cast(hurt as int) as tested, cast(hurt as int) as corrupted from t"
)
def test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other archive has one byte changed in the payload of its first entry, empty ones coming last; stored entries keep it in place."""
    items = document_items(spark, sf_dir)
    empty = F.coalesce(F.octet_length("payload"), F.lit(0)) == 0
    items = items.withColumn("seq", F.col("seq") + F.when(empty, 1 << 40).otherwise(0))
    whole = A.create(items, "Zip", level=0)
    first = items.groupBy("archive").agg(F.min_by(F.octet_length("path"), "seq").alias("n"), F.min(empty).alias("none"))
    hurt = (F.regexp_extract("path", r"-(\d+)\.zip$", 1).cast("long") % 2 == 1) & ~F.col("none")
    at = F.col("n") + 31  # behind the first local header and name
    flipped = F.concat(F.substring("content", F.lit(1), at - 1), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("content", at, F.lit(1))), 16, 10).cast("long").bitwiseXOR(1)), 2, "0")), F.substring("content", at + 1, F.lit(2**30)))
    files = whole.join(first, whole.path == first.archive).select("path", F.when(hurt, flipped).otherwise(F.col("content")).alias("content"))
    return A.test_report(A.verify(files)).select("archive", "tested", "corrupted")


@query(
    f"with d as (select lang || '-' || cast(doc_id // {PER_ARCHIVE} as varchar) || '.tar' as archive, source, doc_id from documents) select archive, case when min(top) = max(top) then 'SingleFolder' else 'Flat' end as layout, case when min(top) = max(top) then min(top) end as folder "
    "from (select archive, case when archive like 'en%' then 'root' else source end as top from d) group by 1"
)
def root_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = document_items(spark, sf_dir, "tar")
    items = items.withColumn("path", F.when(F.col("archive").startswith("en"), F.concat(F.lit("root/"), "path")).otherwise(F.col("path")))
    return A.root_layout(entries(A.create(items, "Tar")))


# -- functions on names --------------------------------------------------------------------------

# Names that the name functions are asked about, by turns.
NAMES = (
    "a/b.txt", "/abs", "a\\..\\x", "x/../y", "con.txt", "dir/AUX", "ok/COM10", "a:b", "end.", "end ", "./", "", "a//b", ".DS_Store", "x/._y", "x/Thumbs.DB", "$recycle.bin/z", "p/System Volume Information/q",
    "m.tar.gz", "m.TGZ", "m.zip", "m.JPG", "m.pdf", "noext", ".hidden", "a.b/c", "v.zip.001", "w.7z.0002", "s.z01", "deep/a.tar.xz",
    "a.jar", "b.zipx", "c.7Z", "d.rar", "e.tar", "f.tbz2", "g.tlz", "h.lzma", "i.tzst", "j.lz4", "k.iso", "l.IMG", "m.cab", "n.msi", "o.deb", "p.tar.zst", "q.tar.lz4", "r.tar.bz2", "s.bz2", "t.xz", "u.zst", "v.gz",
    "x.mp4", "y.docx", "z.PNG", "w.heic", "COM1.txt", "lpt9", "nul.tar.gz", "a/con/b", "aux.", "x/desktop.INI", ".Trashes/a", "._", "p/.Spotlight-V100",
)
# Fixed values, written out once more so that the SQL does not ask the tables of the code: signatures, and what the extensions of the names above say.
SIGNATURES = (
    ("504B0304", "Zip"), ("504B0506", "Zip"), ("504B0708", "Zip"), ("377ABCAF271C", "SevenZ"), ("526172211A070100", "Rar"), ("526172211A0700", "Rar"), ("FD377A585A00", "TarXz"), ("1F8B", "Gzip"), ("425A68", "TarBz2"),
    ("28B52FFD", "Zstd"), ("04224D18", "Lz4"), ("4D534346", "Cab"), ("D0CF11E0A1B11AE1", "Msi"), ("213C617263683E0A", "Deb"),
)
SAID = {
    "zip": "Zip", "jar": "Zip", "zipx": "Zipx", "7z": "SevenZ", "rar": "Rar", "tar": "Tar", "gz": "Gzip", "tgz": "TarGz", "bz2": "Bzip2", "tbz2": "TarBz2", "xz": "Xz", "tlz": "TarXz", "lzma": "Lzma", "zst": "Zstd",
    "tzst": "TarZst", "lz4": "Lz4", "iso": "Iso", "img": "Iso", "cab": "Cab", "msi": "Msi", "deb": "Deb",
}
PAIRS = {"tar.gz": "TarGz", "tar.bz2": "TarBz2", "tar.xz": "TarXz", "tar.zst": "TarZst", "tar.lz4": "TarLz4"}


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a name each, by their key."""
    pick = F.element_at(F.array(*(F.lit(n) for n in NAMES)), (F.col("o_orderkey") % len(NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", pick.alias("name"))


def _sql_names() -> str:
    quoted = ", ".join("'" + n.replace("'", "''") + "'" for n in NAMES)
    return f"n as (select o_orderkey, ([{quoted}])[o_orderkey % {len(NAMES)} + 1] as name from orders)"


NAMES_SQL = _sql_names()
_FOLDERS = "'$recycle.bin', 'system volume information', '.spotlight-v100', '.trashes', '.appledouble', '.fseventsd', '.temporaryitems'"
_FILES = "'.ds_store', 'thumbs.db', 'ehthumbs.db', 'ehthumbs_vista.db', 'desktop.ini'"


@query(
    f"with {NAMES_SQL}, c as (select *, list_filter(string_split(name, '/'), lambda x: x <> '' and x <> '.') as parts from n) "
    f"select o_orderkey, coalesce(parts[-1] <> '..' and (starts_with(parts[-1], '._') or lower(parts[-1]) in ({_FILES})), false) or coalesce(len(list_filter(parts, lambda x: lower(x) in ({_FOLDERS}))) > 0, false) as excluded from c"
)
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("o_orderkey", P.is_system_metadata(F.col("name")).alias("excluded"))


_RESERVED = "'CON', 'PRN', 'AUX', 'NUL', 'COM1', 'COM2', 'COM3', 'COM4', 'COM5', 'COM6', 'COM7', 'COM8', 'COM9', 'LPT1', 'LPT2', 'LPT3', 'LPT4', 'LPT5', 'LPT6', 'LPT7', 'LPT8', 'LPT9'"
_BAD = f"(x = '..' or regexp_matches(x, '[\\x00-\\x1f\\x7f]') or contains(x, ':') or upper(string_split(x, '.')[1]) in ({_RESERVED}) or suffix(x, '.') or suffix(x, ' '))"


@query(
    f"with {NAMES_SQL}, c as (select *, list_filter(string_split(replace(name, chr(92), '/'), '/'), lambda x: x <> '' and x <> '.') as parts from n), "
    f"b as (select *, starts_with(name, '/') or starts_with(name, chr(92)) or len(list_filter(parts, lambda x: {_BAD})) > 0 or len(parts) = 0 as blocked from c) "
    "select o_orderkey, blocked, case when not blocked then array_to_string(parts, '/') end as out_path from b"
)
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = P.resolve_output(F.col("name"), F.lit(False))
    return _names(spark, sf_dir).select("o_orderkey", to["blocked"].alias("blocked"), to["path"].alias("out_path"))


#: Of the extensions of the names above those of packed data.
_PACKED = "'gz', 'tgz', 'zip', 'jpg', 'xz', 'jar', '7z', 'rar', 'tbz2', 'lzma', 'lz4', 'bz2', 'zst', 'tzst', 'mp4', 'docx', 'png', 'heic', 'cab', 'img', 'iso', 'msi', 'pdf'"


@query(f"with {NAMES_SQL} select o_orderkey, lower(regexp_extract(name, '\\.([^.]*)$', 1)) in ({_PACKED}) as stored from n")
def smart_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("o_orderkey", V.has_incompressible_extension(F.col("name")).alias("stored"))


_MAGIC_CASE = " ".join(f"when starts_with(m, '{m}') then '{k}'" for m, k in SIGNATURES)
_EXT_CASE = " ".join(f"when '{e}' then '{k}'" for e, k in SAID.items())
_PAIR_CASE = " ".join(f"when '{e}' then '{k}'" for e, k in PAIRS.items())


@query(
    f"with {NAMES_SQL}, h as (select *, ([" + ", ".join(f"'{m}'" for m, _ in SIGNATURES) + f", '00'])[o_orderkey % {len(SIGNATURES) + 1} + 1] as m from n), "
    "f as (select *, regexp_extract(name, '([^/]*)/*$', 1) as last from h), e as (select *, case when regexp_matches(last, '^.+\\.[^.]*$') then lower(regexp_extract(last, '^.+\\.([^.]*)$', 1)) end as ext, regexp_extract(lower(last), '(tar\\.gz|tar\\.bz2|tar\\.xz|tar\\.zst|tar\\.lz4)$', 1) as pair from f), "
    f"t as (select *, case {_MAGIC_CASE} end as tentative from e) "
    "select o_orderkey, case when tentative is null then coalesce(case pair " + _PAIR_CASE + " end, case ext " + _EXT_CASE + " end, 'Unknown') "
    "when tentative = 'Zip' and ext = 'zipx' then 'Zipx' when tentative = 'Gzip' and (pair = 'tar.gz' or ext = 'tgz') then 'TarGz' when tentative = 'TarBz2' and ext = 'bz2' and pair <> 'tar.bz2' then 'Bzip2' "
    "when tentative = 'Zstd' and (pair = 'tar.zst' or ext = 'tzst') then 'TarZst' when tentative = 'Lz4' and pair = 'tar.lz4' then 'TarLz4' when tentative = 'TarXz' and ext = 'xz' and pair <> 'tar.xz' then 'Xz' when tentative in ('Msi', 'Deb') then case when ext = lower(tentative) then tentative else 'Unknown' end else tentative end as format from t"
)
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signature and none under every name."""
    magic = F.element_at(F.array(*(F.lit(m) for m, _ in SIGNATURES), F.lit("00")), (F.col("o_orderkey") % (len(SIGNATURES) + 1) + 1).cast("int"))
    return _names(spark, sf_dir).select("o_orderkey", D.detect(F.col("name"), F.unhex(magic)).alias("format"))


#: What an output's name says, the longest ending first; read-only kinds say nothing.
_ENDINGS = (
    ("tar.gz", "TarGz"), ("tar.bz2", "TarBz2"), ("tar.xz", "TarXz"), ("tar.zst", "TarZst"), ("tar.lz4", "TarLz4"), ("zipx", "Zipx"), ("tbz2", "TarBz2"), ("tzst", "TarZst"), ("lzma", "Lzma"), ("tgz", "TarGz"),
    ("zip", "Zip"), ("tar", "Tar"), ("bz2", "Bzip2"), ("zst", "Zstd"), ("lz4", "Lz4"), ("7z", "SevenZ"), ("gz", "Gzip"), ("xz", "Xz"),
)


@query(f"with {NAMES_SQL} select o_orderkey, case " + " ".join(f"when suffix(lower(regexp_extract(name, '([^/]*)/*$', 1)), '.{t}') then '{k}'" for t, k in _ENDINGS) + " else 'Zip' end as format from n")
def infer_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("o_orderkey", V.infer_format(F.col("name")).alias("format"))


@query(f"with {NAMES_SQL} select o_orderkey, case when regexp_matches(name, '[/\\\\]') then regexp_extract(name, '^([^/\\\\]*)', 1) end as top from n")
def top_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("o_orderkey", P.top_component(F.col("name")).alias("top"))


@query(
    "with r as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) as k, min(l_linenumber) over (partition by l_orderkey) as low from lineitem), "
    "s as (select l_orderkey, count(*) as v from r where l_linenumber = low + k - 1 group by 1 having count(*) >= 2) select count(*) as sets, cast(sum(v) as bigint) as volumes from s"
)
def split_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume sets among the names of parts, each with a piece suffix by turns; pieces of one order lie together."""
    li = table(spark, sf_dir, "lineitem")
    files = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit(".zip."), F.lpad(F.col("l_linenumber").cast("string"), 3, "0")).alias("path"))
    sets = A.split_sets(files)
    return sets.agg(F.count("*").alias("sets"), F.sum(F.size("volumes").cast("long")).alias("volumes"))


# -- times, modes, sizes -------------------------------------------------------------------------


@query(
    "with e as (select event_id, cast(floor(epoch(ts)) as bigint) as s, ts from events) select event_id, "
    "cast(((year(ts) - 1980) << 9) + (month(ts) << 5) + day(ts) as int) as dos_date, cast((hour(ts) << 11) + (minute(ts) << 5) + second(ts) // 2 as int) as dos_time, s - s % 2 as back from e"
)
def dos_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", V.timestamp_to_dos(F.col("ts").cast("timestamp")).alias("dos"))
    back = V.dos_to_timestamp(F.col("dos.date"), F.col("dos.time"))
    return e.select("event_id", F.col("dos.date").alias("dos_date"), F.col("dos.time").alias("dos_time"), F.unix_seconds(back).alias("back"))


@query("select event_id, case when s >= 0 then s end as seconds from (select event_id, (event_id * 123456789012345) // 10000000 - 11644473600 as s from events)")
def filetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", V.filetime_seconds(F.col("event_id").cast("decimal(20,0)") * F.lit(123456789012345)).alias("seconds"))


@query(
    "with m as (select event_id, case event_id % 4 when 0 then (32768 + event_id % 4096) << 16 when 1 then 32768 + event_id % 4096 when 2 then event_id % 4096 else 32 end as a, event_id % 3 = 0 as unix, event_id % 5 = 0 as dir from events), "
    "u as (select *, cast(case when ((a >> 16) & 61440) <> 0 then (a >> 16) & 4095 when (a & 61440) <> 0 then a & 4095 when unix and a <> 0 and a <= 4095 then a end as int) as mode from m) "
    "select event_id, mode, cast(((mode & 511) & (511 - 18)) | (case when dir then 448 else 384 end) as int) as effective from u"
)
def posix_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    a = F.when(k % 4 == 0, (32768 + k % 4096) * 65536).when(k % 4 == 1, 32768 + k % 4096).when(k % 4 == 2, k % 4096).otherwise(32)
    mode = V.unix_mode(a, F.when(k % 3 == 0, "Unix").otherwise("Unknown"))
    return table(spark, sf_dir, "events").select("event_id", mode.alias("mode"), V.effective_mode(mode, k % 5 == 0).cast("int").alias("effective"))


_SIZE = "cast(round(l_extendedprice * 1000) as bigint) * (l_orderkey % 7) * (l_linenumber * l_linenumber)"


@query(
    f"with s as (select l_orderkey, l_linenumber, {_SIZE} as b from lineitem) select l_orderkey, l_linenumber, case when b >= 1073741824 then regexp_replace(cast(cast(round(b / 1073741824.0, 2) as decimal(20,2)) as varchar), '\\.?0+$', '') || ' GB' "
    "when b >= 1048576 then regexp_replace(cast(cast(round(b / 1048576.0, 2) as decimal(20,2)) as varchar), '\\.?0+$', '') || ' MB' when b >= 1024 then regexp_replace(cast(cast(round(b / 1024.0, 2) as decimal(20,2)) as varchar), '\\.?0+$', '') || ' KB' "
    "else cast(b as varchar) || ' B' end as label from s"
)
def size_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.round(F.col("l_extendedprice") * 1000).cast("long") * (F.col("l_orderkey") % 7) * (F.col("l_linenumber") * F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.size_label(b).alias("label"))


@query(
    "select p_partkey, case p_size % 4 when 0 then p_size when 1 then p_size * 1024 when 2 then p_size * 1048576 else p_size * 1073741824 end::bigint as bytes from (select p_partkey, cast(p_size as bigint) as p_size from part)"
)
def parse_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.element_at(F.array(F.lit(""), F.lit("k"), F.lit("M"), F.lit(" g")), (F.col("p_size") % 4 + 1).cast("int")))
    return p.select("p_partkey", V.parse_size(text).cast("long").alias("bytes"))


_KINDS = ["InvalidArgument", "Io", "WrongPassword", "Corrupted", "EntryNotFound", "UnsupportedFormat", "FeatureDisabled", "MissingVolume", "PathTraversalBlocked", "ZipBombSuspected", "BackendError", "Canceled", ""]


def _kind(key: Column) -> Column:
    return F.nullif(F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (key % len(_KINDS) + 1).cast("int")), F.lit(""))


@query("select c_nationkey, cast(max([2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 130, 0][c_custkey % 13 + 1]) as int) as exit_code from customer group by 1")
def worst_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", _kind(F.col("c_custkey")).alias("kind"))
    return A.worst_exit(c, "kind", "c_nationkey")


@query("select c_custkey, cast([-2, -10, -22, -21, -24, -20, -40, -23, -41, -42, -50, -30, 0][c_custkey % 13 + 1] as int) as code from customer")
def library_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", V.library_code(_kind(F.col("c_custkey"))).alias("code"))


@query("select o_orderkey, replace(o_orderpriority, ' ', '') || '-' || strftime(o_orderdate, '%Y-%m-%d') || '_' || cast(o_custkey as varchar) || '.zip' as name from orders")
def output_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.fill_template(F.lit('{name}-{date}_{count}<>:"|?*.zip'), name, F.lit("/x"), F.col("o_custkey"), F.col("o_orderdate").cast("timestamp")).alias("name"))


# -- plans ---------------------------------------------------------------------------------------


def _order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as entries of an archive an order."""
    li = table(spark, sf_dir, "lineitem")
    seq = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity")).cast("long")
    return li.select(F.col("l_orderkey").cast("string").alias("archive"), seq.alias("seq"), F.round(F.col("l_extendedprice") * 100_000).cast("long").alias("uncompressed_size"), F.round(F.col("l_quantity")).cast("long").alias("compressed_size"))


@query(
    "with e as (select cast(l_orderkey as varchar) as archive, row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice, l_quantity) as seq, cast(round(l_extendedprice * 100000) as bigint) as u, cast(round(l_quantity) as bigint) as c from lineitem), "
    "r as (select *, sum(u) over w as so_far, sum(c) over w as packed from e window w as (partition by archive order by seq rows unbounded preceding)) "
    "select archive, min(seq) as at from r where so_far > 17179869184 or (so_far >= 1073741824 and packed > 0 and so_far // packed > 100000000) group by 1"
)
def running_bomb_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of each archive at which the totals breach the cap or the ratio."""
    rows = A.running_gate(_order_entries(spark, sf_dir), limit=100_000_000)
    return rows.where("breach").groupBy("archive").agg(F.min("seq").alias("at"))


@query(
    "select c_custkey, case when n = 1 then base || '.tar' else base || ' (' || cast(n as varchar) || ').tar' end as out_path from "
    "(select c_custkey, c_mktsegment as base, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) as n from customer)"
)
def rename_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat("c_mktsegment", F.lit(".tar")).alias("target"))
    return P.rename_collisions(c, "target", ["c_custkey"], ["c_nationkey"]).select("c_custkey", "out_path")


def _append_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("archive"), F.concat(F.col("o_orderpriority"), F.lit(".txt")).alias("path"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")


@query(
    "with o as (select cast(o_custkey as varchar) as archive, o_orderpriority || '.txt' as path, o_orderkey, o_orderstatus as s from orders), x as (select *, exists (select 1 from o b where b.s = 'F' and b.archive = a.archive and b.path = a.path) as there from o a where s <> 'F') "
    "select archive, count(*) filter (not there) as added, count(*) filter (there) as skipped from x group by 1"
)
def append_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    have, new = _append_sides(spark, sf_dir)
    added, skipped = A.append_plan(have, new)
    both = added.select("archive", F.lit(1).alias("a"), F.lit(0).alias("s")).union(skipped.select("archive", F.lit(0).alias("a"), F.lit(1).alias("s")))
    return both.groupBy("archive").agg(F.sum("a").cast("long").alias("added"), F.sum("s").cast("long").alias("skipped"))


_POLICY_SQL = (
    "with n as (select cast(o_custkey as varchar) as archive, o_orderkey as seq, o_orderpriority as p from orders), w as (select *, row_number() over (partition by archive, p order by seq) > 1 as there from n), "
    "e as (select *, case when there then {there} else 'write' end as action from w), r as (select *, coalesce(max(case when action = 'fail' then 1 else 0 end) over (partition by archive order by seq rows between unbounded preceding and 1 preceding), 0) = 0 as reached from e) "
    "select archive, count(*) filter (reached and action = 'write') as extracted, count(*) filter (reached and action = 'skip') as skipped, bool_or(action = 'fail') as failed from r group by 1"
)


def _policy(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("archive"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("path"), F.lit(False).alias("is_directory"), F.lit(False).alias("is_symlink"),
        F.lit(10).cast("long").alias("uncompressed_size"), F.lit(5).cast("long").alias("compressed_size"), F.lit(None).cast("string").alias("link_target"),
    )
    report = A.extract_report(A.plan_extraction(rows, policy=policy))
    return report.select("archive", "extracted", "skipped", F.col("error").isNotNull().alias("failed"))


@query(_POLICY_SQL.format(there="'fail'"))
def overwrite_never(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, "Never")


@query(_POLICY_SQL.format(there="'skip'"))
def overwrite_if_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, "IfNewer")


@query(_POLICY_SQL.format(there="'write'"))
def overwrite_always(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, "Always")


@query("select page_id, cast(greatest(1, ceil(strlen(html) / 1000.0)) as bigint) as volumes, html from pages")
def volume_split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page cut into volumes of 1000 bytes, counted, and joined again."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    volumes = A.split_volumes(pages, 1000)
    counts = A.volume_totals(volumes).select(F.col("set").alias("path"), "volumes")
    whole = join_volumes(volumes)
    return whole.join(counts, "path").select(F.col("path").cast("long").alias("page_id"), "volumes", F.decode("content", "UTF-8").alias("html"))


@query(f"select {ARCHIVE_SQL} as archive, count(*) as kept from documents group by 1")
def lenient_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives whose end record states a wrong directory: the tolerant reader finds every entry, and its payload."""
    whole = A.create(document_items(spark, sf_dir), "Zip")
    n = F.octet_length("content")
    hurt = F.concat(F.substring("content", F.lit(1), n - 6), F.unhex(F.lit("F0FFFF7F")), F.substring("content", n - 1, F.lit(2)))
    rows = entries(whole.select("path", hurt.alias("content")), content=True)
    return rows.where((F.col("backend") == "zip-lenient") & (F.crc32("content") == F.col("crc32"))).groupBy("archive").agg(F.count("*").alias("kept"))
