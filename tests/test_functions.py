"""Column functions against tables of cases."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from stowage.formats.sniff import detect as sniff
from stowage.functions import detect as D
from stowage.functions import paths as P
from stowage.functions import values as V
from stowage.operators import archives as A
from stowage.plans import queries as plans


def ask(spark, cases, schema, *columns):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "row long, " + schema)
    return [tuple(r)[1:] for r in sorted(df.select("row", *columns).collect())]


def one(spark, cases, schema, column):
    return [r[0] for r in ask(spark, cases, schema, column)]


def test_detect(spark):
    tar = bytes(257) + b"ustar\x0000" + bytes(200)
    cases = [(n, bytes.fromhex(m)) for m, _ in D.MAGICS for n in ("x", "x.zipx", "x.tgz", "a.tar.gz", "x.bz2", "a.tar.bz2", "x.xz", "x.txz", "a.tar.zst", "a.TAR.LZ4", "x.msi", "x.deb", "x.doc", ".gz", "d.x/y")]
    cases += [(f"f.{e}", b"") for e in D.EXTENSIONS] + [(f"f.{e}", b"junk") for e in D.COMPOUND] + [("x", tar), ("x.iso", tar), ("x", tar[:262]), ("x.tar.", b""), ("noext", b"\x1f"), ("a.b/c", b"")]
    got = one(spark, cases, "p string, c binary", D.detect(F.col("p"), F.col("c")))
    assert got == [sniff(c, p) for p, c in cases]
    assert {*got} >= {*D.FORMATS} - {"Unknown"} and got[-6:] == ["Tar", "Tar", "Unknown", "Unknown", "Unknown", "Unknown"]
    assert dict(zip([p for p, _ in cases], got, strict=True))["f.tlz"] == "TarXz"


def test_codes(spark):
    formats = "Unknown Zip SevenZ Rar Tar Gzip TarGz TarBz2 TarXz Bzip2 Xz Lzma Zstd TarZst Lz4 TarLz4 Zipx Iso Cab Msi Deb other".split()
    assert one(spark, [(f,) for f in formats], "f string", D.format_code(F.col("f"))) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16, 17, 18, 19, 20, 21, 0]
    methods = "Store Deflate Deflate64 Bzip2 Lzma Lzma2 Zstd Ppmd Unknown other".split()
    assert one(spark, [(m,) for m in methods], "m string", D.method_code(F.col("m"))) == [0, 1, 2, 3, 4, 5, 6, 7, 4294967295, 4294967295]
    assert one(spark, [(n,) for n in (0, 8, 9, 12, 14, 93, 98, 1)], "n int", D.zip_method(F.col("n"))) == ["Store", "Deflate", "Deflate64", "Bzip2", "Lzma", "Zstd", "Ppmd", "Unknown"]
    assert one(spark, [(n,) for n in (0, 8, 12)], "n int", D.zip_method(F.col("n"), strict=True)) == ["Store", "Deflate", "Unknown"]
    assert one(spark, [(k,) for k in ("None", "ZipCrypto", "Aes256")], "k string", D.encryption_code(F.col("k"))) == [0, 1, 3]
    assert one(spark, [("a.ZIP",), (".deb",), ("zip",), ("a.txt",)], "p string", D.has_archive_extension(F.col("p"))) == [True, True, False, False]


def test_metadata(spark):
    yes = [".DS_Store", "a/thumbs.DB", "._x", "a/._b", "$recycle.BIN/f", "p/System Volume Information/q", "x/.Trashes", "desktop.ini"]
    no = ["a.txt", "._d/x", "Thumbs.db.txt", "a/ds_store", "", "..", "recycle/x"]
    got = one(spark, [(p,) for p in yes + no], "p string", P.is_system_metadata(F.col("p")))
    assert got == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("flatten", [False, True])
def test_resolve(spark, flatten):
    cases = {
        "a/b.txt": ("a/b.txt", "b.txt"), "a\\b.txt": ("a/b.txt", "b.txt"), "./a//b/": ("a/b", "b"), "/etc/x": (None, None), "\\w": (None, None), "a/../b": (None, "b"), "..": (None, None),
        "a/..": (None, None), "f:s": (None, None), "CON.txt": (None, None), "x/nul": (None, None), "com1/x": (None, "x"), "a.": (None, None), "a ": (None, None), "a\x01": (None, None), "": (None, None), "./": (None, None), "console": ("console", "console"),
    }
    got = one(spark, [(p,) for p in cases], "p string", P.resolve_output(F.col("p"), F.lit(False), flatten))
    assert [g.path for g in got] == [v[flatten] for v in cases.values()] and all(g.blocked == (g.path is None) for g in got)
    if not flatten:
        root = one(spark, [("./",), ("",), ("..",)], "p string", P.resolve_output(F.col("p"), F.lit(True)))
        assert [r.blocked for r in root] == [False, False, True]


def test_rename(spark):
    rows = [(k, "z", t) for k, t in enumerate(["a.txt", "a.txt", "a (2).txt", "a.txt", "b", "b", "d.x/c", "d.x/c"])]
    df = spark.createDataFrame(rows, "k long, g string, t string")
    taken = spark.createDataFrame([("z", "b"), ("z", "b (2)")], "g string, path string")
    got = {r.k: r.out_path for r in P.rename_collisions(df, "t", ["k"], ["g"], taken).collect()}
    assert got == {0: "a.txt", 1: "a (3).txt", 2: "a (2).txt", 3: "a (4).txt", 4: "b (3)", 5: "b (4)", 6: "d.x/c", 7: "d.x/c (2)"}


def test_symlinks(spark):
    cases = [("l", "x", None), ("l", "../x", "EscapesRoot"), ("a/l", "../x", None), ("a/l", "../../x", "EscapesRoot"), ("a/l", "b/../../../a/x", "EscapesRoot"), ("l", "/etc", "AbsoluteTarget"), ("l", "\\w", "AbsoluteTarget"), ("l", "", "EmptyTarget"), ("l", None, "EmptyTarget"), ("l", "a/../b", None)]
    assert one(spark, [c[:2] for c in cases], "l string, t string", P.symlink_fault(F.col("l"), F.col("t"))) == [c[2] for c in cases]


def test_small_names(spark):
    assert one(spark, [("pre", "a\\b"), ("", "/x/"), ("p/", ""), (None, "y")], "p string, r string", P.entry_name(F.col("p"), F.col("r"))) == ["pre/a/b", "x", "p", "y"]
    assert one(spark, [("/d/a.GZ",), ("logo.svgz",), (".gz",), ("a.gz.gz",)], "p string", P.stream_name(F.col("p"), "gz")) == ["a", "logo.svgz.out", ".gz.out", "a.gz"]
    assert one(spark, [("\\a\\b",), ("/x",)], "p string", P.compound_file_path(F.col("p"))) == ["a/b", "x"]
    assert one(spark, [("debian-binary   ",), ("data.tar/",), ("a//",)], "p string", P.ar_name(F.col("p"))) == ["debian-binary", "data.tar", "a/"]
    assert one(spark, [("a/b",), ("a\\b",), ("a",), ("/x",)], "p string", P.top_component(F.col("p"))) == ["a", "a", None, ""]


def test_times(spark):
    cases = [(0, 0), (0x21, 0), (0x2C21, 0xBF7D), (0x2C01, 0x1F), (0, 1), (0x2DBF, 0)]
    got = one(spark, cases, "d int, t int", F.date_format(V.dos_to_timestamp(F.col("d"), F.col("t")), "yyyy-MM-dd HH:mm:ss"))
    assert got == [None, "1980-01-01 00:00:00", "2002-01-01 23:59:58", None, None, None]
    ts = [dt.datetime(1970, 1, 1), dt.datetime(2024, 2, 29, 13, 5, 7), dt.datetime(2200, 1, 1)]
    got = one(spark, [(t,) for t in ts], "t timestamp", V.timestamp_to_dos(F.col("t")))
    assert [tuple(g) for g in got] == [(0x21, 0), ((44 << 9) + (2 << 5) + 29, (13 << 11) + (5 << 5) + 3), ((127 << 9) + (12 << 5) + 31, (23 << 11) + (59 << 5) + 29)]
    assert one(spark, [(116444736000000000,), (0,), (116444736010000000,)], "t long", V.filetime_seconds(F.col("t"))) == [0, None, 1]


def test_large_filetimes(spark):
    """Ticks beyond 2^53 are not rounded, those beyond 2^63 not refused."""
    cases = [116444736009999999, 116444735999999999, 2**63 - 1, 2**64 - 1, 74710 * 123456789012345, 6_000_000 * 123456789012345, -(2**63), None]
    got = one(spark, [(None if t is None else Decimal(t),) for t in cases], "t decimal(38,0)", V.filetime_seconds(F.col("t")))
    assert got == [None if t is None or t < 116444736 * 10**9 else t // 10**7 - 11644473600 for t in cases]
    with pytest.raises(ArithmeticException):  # seconds that no long holds do not wrap
        one(spark, [(Decimal(10**30),)], "t decimal(38,0)", V.filetime_seconds(F.col("t")))


def test_filetime_of_many_events(spark, tmp_path):
    """Ids whose ticks are no 64-bit integer, which the SQL cannot hold either; the SQL over 128-bit integers is the measure."""
    ids = [0, 943, 944, 74709, 74710, 99_999, 5_999_999, 10**11, None]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    sql = plans.oracle_sql()["filetime"].replace("(event_id * ", "(event_id::hugeint * ")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in plans.queries()["filetime"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, con.execute(sql).fetchall())) and len(got) == 9


def test_modes(spark):
    cases = [(0o100644 << 16, "Windows", 0o644), (0o104755, "Unknown", 0o4755), (0o644, "Unix", 0o644), (0x20, "Windows", None), (0, "Unix", None), (0o10000, "Unix", 0), ((0o120777 << 16) | 0x20, "Unix", 0o777)]
    assert one(spark, [c[:2] for c in cases], "a long, h string", V.unix_mode(F.col("a"), F.col("h"))) == [c[2] for c in cases]
    cases = [(0o4777, False, 0o755), (0o000, False, 0o600), (0o444, True, 0o744), (None, True, None)]
    assert one(spark, [c[:2] for c in cases], "m int, d boolean", V.effective_mode(F.col("m"), F.col("d"))) == [c[2] for c in cases]


def test_ratio(spark):
    g = 1 << 30
    cases = [(g, 1_000_000, True), (g, 2_000_000, False), (g - 1, 1, False), (g, 0, False), (2**62, 1, True)]
    assert one(spark, [c[:2] for c in cases], "u long, c long", V.ratio_suspect(F.lit(False), F.lit(False), F.col("u"), F.col("c"))) == [c[2] for c in cases]


def test_choices(spark):
    assert one(spark, [(".ZIP",), (" tar.gz ",), ("rar",), ("what",), ("7z",)], "t string", V.parse_format(F.col("t"))["format"]) == ["Zip", "TarGz", None, None, "SevenZ"]
    assert one(spark, [("rar",), ("what",), ("zip",)], "t string", V.parse_format(F.col("t"))["error"]) == ["read only", "unknown format", None]
    assert one(spark, [("/o/x.tar.gz",), ("x.GZ",), ("x",), ("x.zstd",), ("tar.gz",)], "p string", V.infer_format(F.col("p"))) == ["TarGz", "Gzip", "Zip", "Zstd", "Gzip"]
    assert one(spark, [("Zip", 0), ("Zip", 5), ("Zipx", 5), ("Tar", 9), ("Rar", 1)], "f string, l int", V.codec_for(F.col("f"), F.col("l"))) == ["Store", "Deflate", "Bzip2", "Store", "Deflate"]
    assert one(spark, [("Deflate", 0), ("Deflate", 12), ("Store", 0)], "m string, l int", V.zip_level(F.col("m"), F.col("l"))) == [5, 9, 0]
    assert one(spark, [("TarGz",), ("SevenZ",), ("Rar",)], "f string", V.primary_extension(F.col("f"))) == ["tar.gz", "7z", "zip"]
    got = one(spark, [("100m",), ("1G",), ("512 k",), ("77",), ("x",), ("-1",), ("99999999999g",), ("",)], "t string", V.parse_size(F.col("t")))
    assert [None if x is None else int(x) for x in got] == [100 << 20, 1 << 30, 512 << 10, 77, None, None, None, None]


def test_labels(spark):
    got = one(spark, [(0,), (1023,), (1024,), (1536,), (5 << 20,), (1234567890,), (1 << 40,)], "b long", V.size_label(F.col("b")))
    assert got == ["0 B", "1023 B", "1 KB", "1.5 KB", "5 MB", "1.15 GB", "1024 GB"]
    assert one(spark, [(1 << 20, 1 << 21, 2.0), (10, 5, 1.0), (1, 2, 0.01)], "a long, o long, s double", V.summary_label(F.col("a"), F.col("o"), F.col("s"))) == ["1 MB  ·  50%↓  ·  1 MB/s", "10 B  ·  5 B/s", "1 B  ·  50%↓"]
    line = one(spark, [("d", True, 5, dt.datetime(2020, 1, 2, 3, 4, 5)), ("f", False, 7, None)], "p string, d boolean, s long, m timestamp", V.listing(F.col("p"), F.col("d"), F.col("s"), F.col("m")))
    assert line == ["           0  2020-01-02 03:04  d/", "           7  -                 f"]
    assert one(spark, [("/a/b.c.txt", False), ("/a/Dir.1.0/", True)], "p string, d boolean", V.source_stem(F.col("p"), F.col("d"))) == ["b.c", "Dir.1.0"]
    assert one(spark, [("/a/b.txt", 1), ("/a/b.txt", 2), ("/x.txt", 2)], "p string, n int", V.output_stem(F.col("p"), F.lit(False), F.col("n"), F.lit(True))) == ["b", "a", "archive"]
    assert one(spark, [("{parent}/{name}{count}",), (" ",), ("<>",)], "t string", V.fill_template(F.col("t"), F.lit("n"), F.lit("/q/p"), F.lit(3), F.current_timestamp())) == ["pn3", "n", "n"]
    assert one(spark, [("/o/foo.zip", 1), ("foo.tar.GZ", 2), ("foo", 3), ("a.zip", 0)], "p string, n int", V.uniquified(F.col("p"), F.col("n"))) == ["/o/foo (1).zip", "foo (2).tar.GZ", "foo (3)", "a.zip"]


def test_error_codes(spark):
    kinds = ["Io", "Corrupted", "Canceled", None, "Strange"]
    assert one(spark, [(k,) for k in kinds], "k string", V.exit_code(F.col("k"))) == [3, 5, 130, 0, 2]
    assert one(spark, [("Io", "NotFound"), ("Io", None), ("WrongPassword", None), (None, None), ("Strange", None)], "k string, i string", V.library_code(F.col("k"), F.col("i"))) == [-11, -10, -22, 0, -1]


def test_split_sets(spark):
    files = ["x.zip.001", "x.zip.002", "x.zip.004", "y.7z.0001", "y.7z.0002", "q.z01", "q.z02", "q.zip", "alone.zip", "r.z01", "no.txt.001", "no.txt.002"]
    got = {(r.kind, r.stem): r.volumes for r in A.split_sets(spark.createDataFrame([(f,) for f in files], "path string")).collect()}
    assert got == {("RawByteSplit", "x.zip"): ["x.zip.001", "x.zip.002"], ("RawByteSplit", "y.7z"): ["y.7z.0001", "y.7z.0002"], ("Spanned", "q"): ["q.z01", "q.z02", "q.zip"]}
    assert one(spark, [("/d/a.tar.gz", "Flat"), ("/d/a.zip", "SingleFolder")], "p string, l string", A.destination(F.col("p"), F.col("l"))) == ["/d/a", "/d/"]
