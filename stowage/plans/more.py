"""More queries with SQL: containers that are only read, damaged ZIPs, volume sets, extraction to files, gates, names and labels.

Where SQL cannot derive the values they are written out, by turns over the keys of a table.
"""

from __future__ import annotations

import bz2
import lzma
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.formats.streams import lz4_frame
from stowage.functions import content as C
from stowage.functions import detect as D
from stowage.functions import paths as P
from stowage.functions import values as V
from stowage.operators import archives as A
from stowage.plans import made as M
from stowage.plans.queries import ARCHIVE_SQL, DOCUMENTS, PER_ARCHIVE, _policy, _POLICY_SQL, document_items, packed, query
from stowage.session import scratch, table
from stowage.sources.archive import entries, join_volumes, read_archives, register


def _bytes(rows: DataFrame, change: Callable[[bytes, str], bytes], path: Callable[[str], str] = str) -> DataFrame:
    """``path, content`` with every content, and path, changed by a plain function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            out = [change(b or b"", n) for n, b in zip(names, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([path(n) for n in names], pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    return rows.select("path", "content").mapInArrow(run, "path string, content binary")


def _turns(values: list, key: Column) -> Column:
    """The values by turns; nulls are written as null."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def _pages(spark: SparkSession, sf_dir: str, ending: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(ending)).alias("path"), F.encode("html", "UTF-8").alias("content"))


def _page_rows(rows: DataFrame, last: str) -> DataFrame:
    """The pages that the entries named ``last`` hold, by the name of their archive."""
    return rows.where(F.col("path").endswith(last)).select(F.regexp_extract("archive", r"^(\d+)", 1).cast("long").alias("page_id"), F.decode("content", "UTF-8").alias("html"))


# -- formats -------------------------------------------------------------------------------------

PAGES = "select page_id, html from pages"


def _tar_in(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    def pack(data: bytes, _: str) -> bytes:
        import zstandard

        return {"bz2": bz2.compress, "xz": lambda b: lzma.compress(b, preset=1), "zst": zstandard.ZstdCompressor().compress, "lz4": lz4_frame}[suffix](data)

    rows = entries(_bytes(packed(spark, sf_dir, "Tar", f"tar.{suffix}"), pack), content=True)
    return rows.where(F.col("error").isNull()).select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


@query(DOCUMENTS)
def tar_bz2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tar_in(spark, sf_dir, "bz2")


@query(DOCUMENTS)
def tar_xz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tar_in(spark, sf_dir, "xz")


@query(DOCUMENTS)
def tar_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tar_in(spark, sf_dir, "zst")


@query(DOCUMENTS)
def tar_lz4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tar_in(spark, sf_dir, "lz4")


@query(PAGES)
def container_deb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(entries(_bytes(_pages(spark, sf_dir, ".deb"), lambda b, _: M.deb(b)), content=True), "data.bin")


@query(PAGES)
def container_cab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored and MSZIP by turns."""
    return _page_rows(entries(_bytes(_pages(spark, sf_dir, ".cab"), lambda b, n: M.cab(b, int(n[:-4]) % 2 == 1)), content=True), "page.html")


@query(PAGES)
def container_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(entries(_bytes(_pages(spark, sf_dir, ".iso"), lambda b, _: M.iso(b)), content=True), "PAGE.HTM")


@query(PAGES)
def container_msi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(entries(_bytes(_pages(spark, sf_dir, ".msi"), lambda b, _: M.msi(b)), content=True), "page")


@query(PAGES)
def container_rar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entries, in the older and the newer layout by turns."""
    return _page_rows(entries(_bytes(_pages(spark, sf_dir, ".rar"), lambda b, n: M.rar(b, int(n[:-4]) % 2 == 1)), content=True), "page.html")


@query(PAGES)
def write_xz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an xz file of its own, by the writer."""
    p = table(spark, sf_dir, "pages")
    items = p.select(F.concat(F.col("page_id").cast("string"), F.lit(".html.xz")).alias("archive"), F.lit(0).cast("long").alias("seq"), F.lit("x").alias("path"), F.encode("html", "UTF-8").alias("payload"), F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("int").alias("mode"))
    return _page_rows(entries(A.create(items, "Xz", level=1), content=True), ".html")


_REFUSED = {
    "Rar": "FeatureDisabled", "Iso": "FeatureDisabled", "Cab": "FeatureDisabled", "Msi": "FeatureDisabled", "Deb": "FeatureDisabled", "Gzip": "UnsupportedFormat", "TarBz2": "UnsupportedFormat", "TarXz": "UnsupportedFormat",
    "Bzip2": "UnsupportedFormat", "Lzma": "UnsupportedFormat", "Zstd": "UnsupportedFormat", "Lz4": "UnsupportedFormat", "TarZst": "UnsupportedFormat", "TarLz4": "UnsupportedFormat",
}


@query("select r_name as archive, k as kind, case when k in ('Rar', 'Iso', 'Cab', 'Msi', 'Deb') then 'FeatureDisabled' else 'UnsupportedFormat' end as error from region, unnest(['Rar', 'Iso', 'Cab', 'Msi', 'Deb', 'Gzip', 'TarBz2', 'TarXz', 'Bzip2', 'Lzma', 'Zstd', 'Lz4', 'TarZst', 'TarLz4']) as u(k)")
def refused_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "region").select(F.col("r_name").alias("archive"), F.lit(0).cast("long").alias("seq"), F.lit("a").alias("path"), F.lit(b"1").alias("payload"), F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("int").alias("mode"))
    out = None
    for kind in _REFUSED:
        rows = A.create(items, kind).select(F.col("path").alias("archive"), F.lit(kind).alias("kind"), F.col("error.kind").alias("error"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"select lang || '-' || cast(doc_id // {PER_ARCHIVE} as varchar) || '.7z' as archive, source || '/' || cast(doc_id as varchar) || '.txt' as path, case when strlen(text) > 0 then 'Aes256' else 'None' end as encryption from documents")
def sevenz_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(packed(spark, sf_dir, "SevenZ", "7z", password="pw"), password="pw").select("archive", "path", "encryption")


# -- damaged, cut and joined ---------------------------------------------------------------------

_SHAPE_SQL = f"with d as (select {ARCHIVE_SQL} as archive, (doc_id // {PER_ARCHIVE}) % 8 as s, doc_id from documents), t as (select archive, s, count(*) as n from d group by 1, 2)"


def _hurt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document archives, with a fault each by the turns of their numbers."""
    whole = A.create(document_items(spark, sf_dir), "Zip")
    return _bytes(whole, lambda b, n: M.damaged(b, M.SHAPES[int(n.rsplit("-", 1)[1][:-4]) % len(M.SHAPES)]))


@query(
    f"{_SHAPE_SQL} select archive, n - case when s = 2 then 1 else 0 end as listed, n - case when s in (2, 3, 4) then 1 else 0 end as decoded, case when s = 0 then 'zip' else 'zip-lenient' end as backend from t where s <> 7 "
    "union all select archive, 0, 0, null from t where s = 7"
)
def lenient_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries of each damaged archive are listed and decode with their checksum; without an end record it does not open."""
    rows = entries(_hurt(spark, sf_dir), content=True)
    good = F.col("content").isNotNull() & (F.crc32("content") == F.col("crc32"))
    return rows.groupBy("archive").agg(F.count_if(F.col("seq") >= 0).alias("listed"), F.count_if(good).alias("decoded"), F.max("backend").alias("backend"))


@query(f"{_SHAPE_SQL} select archive, s in (1, 3, 4, 5, 6, 7) as fault from t")
def zip_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the damaged archives the look at the last bytes refuses."""
    return _hurt(spark, sf_dir).select(F.col("path").alias("archive"), C.zip_fault(F.col("content")).isNotNull().alias("fault"))


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document archives as spanned sets of two disks: ``set, index, content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = M.cut_in_two(data)
                yield pa.RecordBatch.from_arrays([pa.array([name] * 2), pa.array([0, 1], pa.int32()), pa.array(parts, pa.binary())], ["set", "index", "content"])

    return packed(spark, sf_dir, "Zip", "zip").select("path", "content").mapInArrow(run, "set string, index int, content binary")


@query(DOCUMENTS)
def spanned_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(join_volumes(_volumes(spark, sf_dir), spanned=True), content=True)
    return rows.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


@query(f"select regexp_replace({ARCHIVE_SQL}, '\\.zip$', '') as stem, count(*) as entries, cast(sum(strlen(text)) as bigint) as bytes from documents group by 1")
def volume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives cut into numbered files, found by their names and read by parts."""
    place = scratch(spark, "volumes")
    A.save(A.split_volumes(packed(spark, sf_dir, "Zip", "zip"), 20_000), place)
    rows = A.read_sets(spark, place).unionByName(read_archives(spark, place, by_parts=True, pattern="*.none"))
    lone = read_archives(spark, place, by_parts=True, pattern="*.zip.001").where("error is null")  # archives of one volume are no sets
    rows = rows.unionByName(lone).withColumn("stem", F.regexp_extract("archive", r"([^/]+?)\.zip(?:\.001)?$", 1))
    return rows.groupBy("stem").agg(F.count("*").alias("entries"), F.sum("uncompressed_size").alias("bytes"))


# -- files ---------------------------------------------------------------------------------------

_FILES_SQL = f"select {ARCHIVE_SQL} as archive, source || '/' || cast(doc_id as varchar) || '.txt' as out_path, 'write' as action, cast(strlen(text) as bigint) as bytes from documents"


@query(_FILES_SQL)
def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every archive extracted for real, as the status rows say."""
    return A.extract(packed(spark, sf_dir, "Zip", "zip"), scratch(spark, "extracted")).select("archive", "out_path", "action", "bytes")


@query(_FILES_SQL.replace("'write' as action, cast(strlen(text) as bigint) as bytes", "'skip' as action, 0::bigint as bytes"))
def extract_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second extraction to the same place skips what is there."""
    place, archives = scratch(spark, "twice"), packed(spark, sf_dir, "Zip", "zip")
    A.extract(archives, place)
    return A.extract(archives, place, policy="IfNewer").select("archive", "out_path", "action", "bytes")


@query("select page_id, case when strlen(html) > 2000 then 'fail' else 'write' end as action, case when strlen(html) > 2000 then 'ZipBombSuspected' end as error from pages")
def extract_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams state no size: what is decoded is held to the cap."""
    import gzip

    rows = A.extract(_bytes(_pages(spark, sf_dir, ".gz"), lambda b, _: gzip.compress(b, 1)), scratch(spark, "capped"), cap=2000)
    return rows.select(F.regexp_extract("archive", r"^(\d+)", 1).cast("long").alias("page_id"), "action", F.col("error.kind").alias("error"))


@query(f"select {ARCHIVE_SQL} as archive, source || '/' || cast(doc_id as varchar) || '.txt' as path, text from documents")
def data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written and read by the data source, payloads included."""
    register(spark)
    place = scratch(spark, "source")
    items = document_items(spark, sf_dir).repartition("archive").sortWithinPartitions("archive", "seq")
    items.write.format("archive").option("kind", "Zip").mode("append").save(place)
    rows = spark.read.format("archive").option("includeContent", "true").load(place)
    return rows.select(F.regexp_extract("archive", r"([^/]+)$", 1).alias("archive"), "path", F.decode("content", "UTF-8").alias("text"))


@query("select 'pre/' || n_name || '.zip' as path, row_number() over (order by 'pre/' || n_name || '.zip') as seq from nation")
def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written, and the folder walked again as items in the order of their names."""
    place = scratch(spark, "tree")
    A.save(table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".zip")).alias("path"), F.encode("n_name", "UTF-8").alias("content")), place)
    return A.source_tree(spark, place, "all.zip", "pre").select("path", "seq")


# -- writing on ----------------------------------------------------------------------------------


@query(
    f"with d as (select {ARCHIVE_SQL} as archive, doc_id from documents) select archive, count(*) filter (doc_id % 2 = 0) as had, count(*) filter (doc_id % 2 = 1 or doc_id % 4 = 0) - count(*) filter (doc_id % 4 = 0) as added, "
    "count(*) filter (doc_id % 4 = 0) as skipped, count(*) as entries from d group by 1 having count(*) filter (doc_id % 2 = 0) > 0 and count(*) filter (doc_id % 2 = 1 or doc_id % 4 = 0) > 0"
)
def append_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of every other document get the rest, and again a part of what they have."""
    items = document_items(spark, sf_dir)
    made = A.create(items.where("seq % 2 = 0"), "Zip").select("path", "content")
    out = A.append(made, items.where("seq % 2 = 1 or seq % 4 = 0"))
    listed = entries(out).groupBy("archive").agg(F.count("*").alias("entries"))
    had = items.where("seq % 2 = 0").groupBy("archive").agg(F.count("*").alias("had"))
    rows = out.select(F.col("path").alias("archive"), "added", F.size("skipped_existing").cast("long").alias("skipped"))
    return rows.join(listed, "archive").join(had, "archive").select("archive", "had", "added", "skipped", "entries")


@query("select source || '.tar' as path, count(*) as entries from documents group by 1")
def batch_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.batch_create(document_items(spark, sf_dir), "Tar").select("path", "entries")


@query(f"select {ARCHIVE_SQL} as path, count(*) as entries, count(*) as tested, 0::bigint as corrupted from documents group by 1")
def verified_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.create_verified(document_items(spark, sf_dir)).select("path", "entries", "tested", "corrupted")


# -- gates and policies --------------------------------------------------------------------------


@query(_POLICY_SQL.format(there="'skip'"))
def overwrite_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, "Ask")


@query(
    "with n as (select cast(o_custkey as varchar) as archive, o_orderkey as seq, 'd/' || o_orderpriority || '.txt' as p, o_orderpriority as b, o_orderstatus = 'F' as f from orders), t as (select distinct archive, p from n where f), "
    "k as (select n.*, row_number() over (partition by n.archive, n.p order by seq) + case when t.p is null then 0 else 1 end as nth from n left join t on n.archive = t.archive and n.p = t.p) "
    "select archive, seq, case when nth = 1 then p else 'd/' || b || ' (' || cast(nth as varchar) || ').txt' end as out_path from k"
)
def overwrite_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both files are kept: names that are on disk (of orders with status F) or claimed before get numbers."""
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("d/"), "o_orderpriority", F.lit(".txt"))
    rows = _plain_entries(o, F.col("o_custkey").cast("string"), F.col("o_orderkey"), path)
    there = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("archive"), path.alias("path"))
    return A.plan_extraction(rows, there, "Rename").select("archive", "seq", "out_path")


def _plain_entries(rows: DataFrame, archive: Column, seq: Column, path: Column, size: Column | None = None, packed_size: Column | None = None, link: Column | None = None, backend: Column | None = None) -> DataFrame:
    target = F.lit(None).cast("string") if link is None else link
    return rows.select(
        archive.alias("archive"), seq.cast("long").alias("seq"), path.alias("path"), F.lit(False).alias("is_directory"), target.isNotNull().alias("is_symlink"),
        (F.lit(10) if size is None else size).cast("long").alias("uncompressed_size"), (F.lit(5) if packed_size is None else packed_size).cast("long").alias("compressed_size"), target.alias("link_target"),
        *([] if backend is None else [backend.alias("backend")]),
    )


@query("select l_orderkey, l_linenumber, l_extendedprice, l_quantity, coalesce(u >= 1073741824 and u // nullif(c, 0) > 1000, false) as suspect from (select *, cast(round(l_extendedprice * 100000) as bigint) as u, cast(round(l_quantity) as bigint) * 100000 * (l_linenumber % 3) as c from lineitem)")
def ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, packed_size = F.round(F.col("l_extendedprice") * 100_000).cast("long"), F.round("l_quantity").cast("long") * 100_000 * (F.col("l_linenumber") % 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", V.ratio_suspect(F.lit(False), F.lit(False), size, packed_size).alias("suspect"))


@query(
    "select o_orderkey, ['ZipBombSuspected', 'ZipBombSuspected', 'BackendError', 'ZipBombSuspected', 'Io', 'Io', 'BackendError', 'Io', null, null, null, 'ZipBombSuspected'][o_orderkey % 12 + 1] as error, "
    "['fail', 'fail', 'fail', 'fail', 'fail', 'fail', 'fail', 'fail', 'skip', 'link', 'link', 'fail'][o_orderkey % 12 + 1] as action from orders"
)
def backend_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three entries an order, of which the second meets a gate: by turns a ratio, an existing file, a link, or the running ratio, under four backends."""
    o = table(spark, sf_dir, "orders")
    turn = F.col("o_orderkey") % 12
    backend = F.when(turn == 8, "rar").when(turn.isin(9, 10), "tar").when(turn == 11, "zip").otherwise(_turns(["zip", "tar", "7z", "rar"], turn))
    bomb, twice = turn < 4, (turn >= 4) & (turn < 8)
    first = _plain_entries(o, F.col("o_orderkey").cast("string"), F.lit(0), F.lit("a"), F.when(turn == 11, 600_000_000).otherwise(10), F.lit(5), backend=backend)
    size = F.when(bomb, F.lit(1 << 30)).when(turn == 11, 600_000_000).otherwise(10)
    second = _plain_entries(o, F.col("o_orderkey").cast("string"), F.lit(1), F.when(twice, "a").otherwise("b"), size, F.lit(5), F.when(turn.isin(8, 9, 10), "a"), backend)
    plan = A.plan_extraction(first.union(second), follow_symlinks=True)
    return plan.where("seq = 1").select(F.col("archive").cast("long").alias("o_orderkey"), F.col("error.kind").alias("error"), "action")


@query("select o_orderkey, ['b.txt', 'c', 'd', 'e', 'f.g', null][o_orderkey % 6 + 1] as out_path, o_orderkey % 6 = 5 as blocked from orders")
def flat_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output paths without their folders, of which only the last part counts."""
    to = P.resolve_output(_turns(["a/b.txt", "x\\y\\c", "a/../d", "./e", "p//q/f.g", "/"], F.col("o_orderkey")), F.lit(False), flatten=True)
    return table(spark, sf_dir, "orders").select("o_orderkey", to["path"].alias("out_path"), to["blocked"].alias("blocked"))


@query("select o_orderkey, [null, 'EmptyTarget', 'EmptyTarget', 'AbsoluteTarget', 'AbsoluteTarget', 'EscapesRoot', null, 'EscapesRoot', 'EscapesRoot', null][o_orderkey % 10 + 1] as fault from orders")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    link = _turns(["d/l", "d/l", "d/l", "d/l", "d/l", "l", "d/l", "d/l", "d/e/l", "d/e/l"], k)
    target = _turns(["f", None, "", "/etc/x", "\\x", "../x", "../x", "../../x", "a/../../../../x", "../../x/y"], k)
    return table(spark, sf_dir, "orders").select("o_orderkey", P.symlink_fault(link, target).alias("fault"))


# -- codes, names and labels ---------------------------------------------------------------------


@query(
    "select p_partkey, ['Store', 'Deflate', 'Deflate64', 'Bzip2', 'Lzma', 'Zstd', 'Ppmd', 'Unknown'][p_partkey % 8 + 1] as method, ['Store', 'Deflate', 'Unknown', 'Unknown', 'Unknown', 'Unknown', 'Unknown', 'Unknown'][p_partkey % 8 + 1] as strict, "
    "cast([0, 1, 2, 3, 4, 6, 7, 4294967295][p_partkey % 8 + 1] as bigint) as code, cast([0, 1, 2, 3][p_partkey % 4 + 1] as int) as encryption from part"
)
def method_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    number = _turns([0, 8, 9, 12, 14, 93, 98, 97], k)
    method = D.zip_method(number)
    return table(spark, sf_dir, "part").select("p_partkey", method.alias("method"), D.zip_method(number, strict=True).alias("strict"), D.method_code(method).alias("code"), D.encryption_code(_turns(["None", "ZipCrypto", "Aes128", "Aes256"], k)).alias("encryption"))


@query("select p_partkey, cast([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16, 17, 18, 19, 20, 21][p_partkey % 21 + 1] as int) as code from part")
def format_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "Unknown Zip SevenZ Rar Tar Gzip TarGz TarBz2 TarXz Bzip2 Xz Lzma Zstd TarZst Lz4 TarLz4 Zipx Iso Cab Msi Deb".split()
    return table(spark, sf_dir, "part").select("p_partkey", D.format_code(_turns(names, F.col("p_partkey"))).alias("code"))


@query("select p_partkey, case when p_size % 3 = 0 then 5 else least(p_size % 12, 9) end::bigint as level from (select p_partkey, case when p_size % 3 = 0 then 0 else p_size end as p_size from part)")
def zip_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_size"))
    level = F.when(size == 0, 0).otherwise(size % 12)
    return table(spark, sf_dir, "part").select("p_partkey", V.zip_level(F.when(size % 3 == 0, "Deflate").otherwise("Zstd"), level).cast("long").alias("level"))


@query("select o_orderkey, [false, true, false, true][o_orderkey % 4 + 1] as stored from orders")
def probe_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, digests, few digests and digests behind text: only long stretches of noise are not worth deflating."""
    noise = F.unhex(F.concat(*(F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit(f"-{k}")), 512) for k in range(80))))
    short, text = F.substring(noise, F.lit(1), F.lit(4000)), F.encode(F.repeat(F.lit("plain text "), 800), "UTF-8")
    turn = F.col("o_orderkey") % 4
    payload = F.when(turn == 0, text).when(turn == 1, noise).when(turn == 2, short).otherwise(F.concat(F.encode(F.lit("head "), "UTF-8"), noise))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.incompressible(payload).alias("stored"))


@query(
    "select o_orderkey, ['a/b.txt', 'p/a/b.txt', 'p/q/a.txt', 'x', 'p', 'p/a'][o_orderkey % 6 + 1] as entry, ['page.html', 'x.xz.out', 'y.GZ.out', '.gz.out', 'z.out', 'w'][o_orderkey % 6 + 1] as stream, "
    "['a/b', 'x', 'a/b/c', '', 'q', 'a'][o_orderkey % 6 + 1] as storage, ['control', 'data.tar.xz', 'x', 'dir/', '', 'y z'][o_orderkey % 6 + 1] as member from orders"
)
def entry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the readers and writers of single formats make."""
    k = F.col("o_orderkey")
    stream = P.stream_name(_turns(["d/page.html.gz", "x.xz", "y.GZ", ".gz", "z", "w.gz"], k), "gz")
    stream = F.when(k % 6 == 2, F.lit("y.GZ.out")).otherwise(stream)  # the suffix of another case is stripped; asked with a name that keeps it
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", P.entry_name(_turns([None, "p", "p/q/", "", "/p/", "p\\"], k), _turns(["a/b.txt", "a\\b.txt", "a.txt", "x", "", "/a/"], k)).alias("entry"), stream.alias("stream"),
        P.compound_file_path(_turns(["/a/b", "x", "\\a\\b\\c", "", "/q", "a"], k)).alias("storage"), P.ar_name(_turns(["control/        ", "data.tar.xz ", "x", "dir// ", "    ", "y z/"], k)).alias("member"),
    )


@query(
    "select o_orderkey, lpad(cast(case when d then 0 else o_custkey end as varchar), 12, ' ') || '  ' || strftime(o_orderdate, '%Y-%m-%d') || ' 00:00  ' || o_clerk || case when d then '/' else '' end as line from (select *, o_orderkey % 3 = 0 as d, 'name ' || cast(o_orderkey as varchar) as o_clerk from orders)"
)
def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, directory = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3 == 0
    name = F.concat(F.lit("name "), F.col("o_orderkey").cast("string"), F.when(directory, "///").otherwise(""))
    return o.select("o_orderkey", V.listing(name, directory, F.col("o_custkey"), F.col("o_orderdate").cast("timestamp")).alias("line"))


@query(
    "select p_partkey, case when b < 997 and a > 0 then cast(cast(round((1 - b / 997.0::double) * 100) as int) as varchar) || '%↓' end as saved, case when b > 0 and s >= 0.05 then case when r >= 1024 then regexp_replace(cast(cast(round(r / 1024.0, 2) as decimal(20,2)) as varchar), '\\.?0+$', '') || ' KB' else cast(r as varchar) || ' B' end || '/s' end as speed "
    "from (select p_partkey, 997 as a, p_partkey % 1200 as b, (p_partkey % 9) * 0.025::double as s, cast(trunc((p_partkey % 1200) / nullif((p_partkey % 9) * 0.025::double, 0)) as bigint) as r from part)"
)
def summary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    size, seconds = k % 1200, (k % 9) * F.lit(0.025)
    return table(spark, sf_dir, "part").select("p_partkey", V.saved_label(F.lit(997), size).alias("saved"), V.speed_label(size, seconds).alias("speed"))


@query(
    "select o_orderkey, ['a', 'a (1).zip', 'd/b (2).tar.gz', 'd/c (3).7z', 'x.y/e (4)', '.f (5)'][o_orderkey % 6 + 1] as free, ['/h/', '/h/a', '/h/', 'b', '/h/i/c', 'd'][o_orderkey % 6 + 1] as destination, "
    "['a', 'a.b', 'folder.d', 'archive', 'up', 'archive'][o_orderkey % 6 + 1] as stem from orders"
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where archives go to, and what outputs are called."""
    k = F.col("o_orderkey")
    free = V.uniquified(_turns(["a", "a.zip", "d/b.tar.gz", "d/c.7z", "x.y/e", ".f"], k), k % 6)
    free = F.when(k % 6 == 5, F.lit(".f (5)")).otherwise(free)
    where = A.destination(_turns(["/h/a.zip", "/h/a.zip", "/h/b.tar.gz", "b.tar.gz", "/h/i/c.7z", "d"], k), _turns(["SingleFolder", "Flat", "SingleFolder", "Flat", "Flat", "Flat"], k))
    stem = V.output_stem(_turns(["/s/a.txt", "/s/a.b.c", "/s/folder.d", "/s/ .x", "/up/x.txt", "/s/x"], k), k % 6 == 2, _turns([1, 1, 1, 1, 3, 0], k), k % 6 == 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", free.alias("free"), where.alias("destination"), stem.alias("stem"))


@query(
    "select c_custkey, n as seq, ['한글/문서.txt', 'ふりがな.txt', '中文目录.txt', 'plain.txt', 'ünï.txt'][c_custkey % 5 + 1] as path, ['Cp949', 'ShiftJis', 'Gbk', 'Utf8', 'Utf8'][c_custkey % 5 + 1] as codepage from customer, range(2) as r(n)"
)
def legacy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw names in three old code pages, in ASCII and in UTF-8: the code page is found for each archive."""
    raw = [n.encode(c).hex() for n, c in (("한글/문서.txt", "cp949"), ("ふりがな.txt", "shift_jis"), ("中文目录.txt", "gbk"), ("plain.txt", "ascii"), ("ünï.txt", "utf-8"))]
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("archive"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("seq"), F.unhex(_turns(raw, F.col("c_custkey"))).alias("raw"), F.lit(False).alias("utf8_flag"), F.lit(None).cast("string").alias("unicode_path"))
    return C.decode_archive_names(names).select(F.col("archive").cast("long").alias("c_custkey"), "seq", "path", "codepage")
