"""The Spark layer: source, tests, plans, extraction, creation, appending, volumes."""

import os

import pytest
from pyspark.sql import functions as F

from stowage.errors import ArchiveError
from stowage.formats import open_archive
from stowage.formats import write as Wr
from stowage.operators import archives as A
from stowage.sources import archive as src

ITEMS = [Wr.Item("d/", None), Wr.Item("d/a.txt", b"alpha" * 99), Wr.Item("b.bin", bytes(range(256)) * 9), Wr.Item("empty", b"")]


def files(spark, **named):
    return spark.createDataFrame([(n.replace("__", "."), bytearray(b) if b is not None else None) for n, b in named.items()], "path string, content binary")


@pytest.fixture
def mixed(spark):
    return files(spark, a__zip=Wr.write_archive(ITEMS), b__tgz=Wr.write_archive(ITEMS, "TarGz"), c__7z=Wr.write_archive(ITEMS, "SevenZ"), bad__zip=b"PK\3\4 nothing", none__zip=None, what__txt=b"plain")


def test_entries(spark, mixed):
    rows = src.entries(mixed, content=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.archive, []).append(r)
    for name in ("a.zip", "b.tgz", "c.7z"):
        assert [r.seq for r in by[name]] == [0, 1, 2, 3]
        assert {r.path: bytes(r.content) for r in by[name] if not r.is_directory} == {i.path: i.payload for i in ITEMS if i.payload is not None}
    assert by["bad.zip"][0].error.kind == "Corrupted" and by["bad.zip"][0].seq == -1
    assert by["what.txt"][0].error.kind == "UnsupportedFormat" and by["none.zip"][0].error is not None
    assert src.entries(mixed).columns == [c for c in src.entries(mixed, content=True).columns if c != "content"]
    assert src.entries(mixed.limit(0)).count() == 0


def test_content_limit(spark):
    rows = src.entries(files(spark, a__zip=Wr.write_archive(ITEMS)), content=True, limit=500).collect()
    assert [r.error.kind if r.error else None for r in rows] == [None, None, "ZipBombSuspected", None]


def test_data_source(spark, tmp_path):
    src.register(spark)
    for name, kind in (("x.zip", "Zip"), ("sub/y.tar", "Tar")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(Wr.write_archive(ITEMS, kind))
    df = spark.read.format("archive").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 2 and df.count() == 8
    one = df.where(F.col("archive") == str(tmp_path / "x.zip"))
    assert one.select("path").count() == 4
    full = spark.read.format("archive").option("includeContent", "true").load(str(tmp_path / "x.zip"))
    assert {r.path: bytes(r.content or b"") for r in full.collect()}["d/a.txt"] == b"alpha" * 99
    assert {r.archive for r in df.where("format = 'Tar'").select("archive", "format").collect()} == {str(tmp_path / "sub/y.tar")}
    listed = src.read_archives(spark, str(tmp_path), pattern="*.zip")
    assert listed.count() == 4 and A.totals(listed).collect()[0].entries == 4


def test_read_by_parts(spark, tmp_path):
    """The same rows as of whole files, for names that URIs would escape too."""
    for name, kind in (("x y%20z.zip", "Zip"), ("x.zipx", "Zipx"), ("y.tar", "Tar"), ("y.tgz", "TarGz"), ("z.7z", "SevenZ")):
        (tmp_path / name).write_bytes(Wr.write_archive(ITEMS, kind))
    (tmp_path / "hurt.zip").write_bytes(Wr.write_archive(ITEMS)[:-40])
    (tmp_path / "no.zip").write_bytes(b"PK\3\4")
    rows = lambda **o: sorted(map(str, src.read_archives(spark, str(tmp_path), content=True, **o).collect()))
    assert rows(by_parts=True) == rows() and len(rows()) >= 21


def test_files_over_two_gib(spark, tmp_path):
    """A tar and a stored ZIP of more than 2 GiB are listed, and a small entry read, though no row could hold them."""
    import tarfile
    import zipfile

    size = 3 << 30
    info = tarfile.TarInfo("big")
    info.size = size
    last = tarfile.TarInfo("small")
    last.size = 5
    with open(tmp_path / "t.tar", "wb") as f:  # a hole in the file stands for the payload
        f.write(info.tobuf())
        f.seek(size, 1)
        f.write(last.tobuf() + b"hello" + bytes(507 + 1024))
    with open(tmp_path / "z.zip", "wb") as f:
        z = zipfile.ZipFile(f, "w")
        big = zipfile.ZipInfo("big")
        big.file_size, big.compress_size, big.CRC = size, size, 0
        f.write(big.FileHeader())
        f.seek(size, 1)
        big.header_offset = 0
        z.filelist.append(big)
        z.NameToInfo["big"] = big
        z.start_dir = f.tell()
        z._didModify = True
        z.writestr("small", b"hello")
        z.close()
    df = src.read_archives(spark, str(tmp_path), by_parts=True, content=True, limit=1000)
    got = {(r.archive[-1], r.path): (r.uncompressed_size, r.error.kind if r.error else None, r.content and bytes(r.content)) for r in df.collect()}
    assert got == {(k, "big"): (size, "ZipBombSuspected", None) for k in "rp"} | {(k, "small"): (5, None, b"hello") for k in "rp"}
    src.register(spark)
    assert spark.read.format("archive").load(str(tmp_path)).count() == 4


def test_reports(spark):
    hurt = bytearray(Wr.write_zip(ITEMS, level=0))
    hurt[hurt.find(b"alpha")] ^= 1
    locked = Wr.write_archive(ITEMS[1:], "Zip", password="p")
    df = files(spark, ok__zip=Wr.write_archive(ITEMS), hurt__zip=bytes(hurt), locked__zip=locked, bad__7z=b"7z\xbc\xaf\x27\x1c" + bytes(40))
    got = {r.archive: r for r in A.test_report(A.verify(df)).collect()}
    assert (got["ok.zip"].tested, got["ok.zip"].corrupted) == (3, 0)
    assert (got["hurt.zip"].tested, got["hurt.zip"].corrupted, got["hurt.zip"].corrupted_paths) == (2, 1, ["d/a.txt"])
    assert got["locked.zip"].error.kind == "WrongPassword" and got["bad.7z"].error.kind == "BackendError"
    kinds = src.entries(df).where("error is not null").select(F.col("error.kind").alias("kind"))
    assert A.worst_exit(kinds).collect()[0].exit_code == 12
    totals = {r.archive: r for r in A.totals(src.entries(df)).collect()}
    assert totals["locked.zip"].encrypted and not totals["ok.zip"].encrypted and totals["bad.7z"].entries == 0


def test_layout(spark):
    wrap = lambda *names: Wr.write_tar([Wr.Item(n, None if n.endswith("/") else b"") for n in names])
    df = files(spark, one__tar=wrap("p/", "p/x", "p/q/y"), flat__tar=wrap("p/x", "y"), two__tar=wrap("p/x", "q/y"), none__tar=Wr.write_tar([]), bad__7z=b"7z\xbc\xaf\x27\x1c")
    got = {r.archive: (r.layout, r.folder) for r in A.root_layout(src.entries(df), df).collect()}
    assert got == {"one.tar": ("SingleFolder", "p"), "flat.tar": ("Flat", None), "two.tar": ("Flat", None), "none.tar": ("Flat", None), "bad.7z": ("Flat", None)}


def plan_rows(spark, rows):
    schema = "archive string, seq long, path string, is_directory boolean, is_symlink boolean, uncompressed_size long, compressed_size long, link_target string"
    return spark.createDataFrame([("z", k, *r) for k, r in enumerate(rows)], schema)


def actions(df):
    return [(r.action, r.out_path, r.reached, r.error.kind if r.error else None) for r in df.orderBy("seq").collect()]


def test_plan(spark):
    f = lambda p, u=10, c=5: (p, False, False, u, c, None)
    rows = plan_rows(spark, [("d/", True, False, 0, 0, None), f("d/a"), ("l", False, True, 1, 1, "../x"), ("k", False, True, 1, 1, "d/a"), f("d/a"), f("../x")])
    got = actions(A.plan_extraction(rows, policy="Always", follow_symlinks=True))
    assert got == [("mkdir", "d", True, None), ("write", "d/a", True, None), ("skip", "l", True, None), ("link", "k", True, None), ("write", "d/a", True, None), ("fail", None, True, "PathTraversalBlocked")]
    assert [x[0] for x in actions(A.plan_extraction(rows, policy="Always"))][2:4] == ["skip", "skip"]
    never = actions(A.plan_extraction(rows))
    assert never[4] == ("fail", "d/a", True, "Io") and never[5][2] is False
    renamed = actions(A.plan_extraction(rows, policy="Rename", existing=spark.createDataFrame([("z", "d/a")], "archive string, path string")))
    assert [x[1] for x in renamed][1] == "d/a (2)" and renamed[4][1] == "d/a (3)"
    report = A.extract_report(A.plan_extraction(rows)).collect()[0]
    assert (report.extracted, report.skipped, report.bytes, report.error.kind) == (1, 2, 10, "Io")
    only = A.plan_extraction(rows, policy="Always", only=["d/a"])
    assert only.count() == 2
    with pytest.raises(ArchiveError):
        A.plan_extraction(rows, policy="Maybe")


def test_bomb_gates(spark):
    g = 1 << 30
    f = lambda u, c: ("f", False, False, u, c, None)
    one = plan_rows(spark, [f(g, 1000)])
    assert actions(A.plan_extraction(one, policy="Always"))[0][3] == "ZipBombSuspected"
    slow = plan_rows(spark, [f(g // 2, 1000), f(g // 2 - 1, 1000), f(1, 1), f(5, 5)])
    assert [x[3] for x in actions(A.plan_extraction(slow, policy="Always"))][:3] == [None, None, "ZipBombSuspected"]
    small = plan_rows(spark, [f(600, 600), f(600, 600)])
    got = A.running_gate(small, cap=1000).orderBy("seq").collect()
    assert [r.breach for r in got] == [False, True] and got[1].so_far == 1200


def test_extract(spark, tmp_path):
    evil = Wr.write_zip([Wr.Item("ok.txt", b"1"), Wr.Item("../evil", b"2"), Wr.Item("late", b"3")])
    df = files(spark, a__zip=Wr.write_archive(ITEMS), b__tar__gz=Wr.write_archive(ITEMS, "TarGz"), evil__zip=evil)
    got = A.extract(df, str(tmp_path)).collect()
    assert (tmp_path / "a/d/a.txt").read_bytes() == b"alpha" * 99 and (tmp_path / "b/empty").read_bytes() == b""
    assert sorted(os.listdir(tmp_path)) == ["a", "b", "evil"] and os.listdir(tmp_path / "evil") == ["ok.txt"]
    assert [(r.action, r.error.kind if r.error else None) for r in sorted(got) if r.archive == "evil.zip"] == [("write", None), ("fail", "PathTraversalBlocked")]


def test_extract_over_existing(spark, tmp_path):
    """What is there already decides by policy, files with a leading dot too; nothing is replaced under Never."""
    items = [Wr.Item("x.txt", b"NEW"), Wr.Item(".env", b"NEW"), Wr.Item("y.txt", b"NEW")]

    def run(policy, name):
        place = tmp_path / name / "a"
        place.mkdir(parents=True)
        (place / "x.txt").write_bytes(b"OLD")
        (place / ".env").write_bytes(b"OLD")
        rows = sorted(A.extract(files(spark, a__zip=Wr.write_archive(items)), str(tmp_path / name), policy=policy).collect(), key=lambda r: r.seq)
        assert sorted(os.listdir(tmp_path / name)) == ["a"]
        return [(r.action, r.error.kind if r.error else None) for r in rows], {p.name: p.read_bytes() for p in place.iterdir()}

    assert run("Never", "n") == ([("fail", "Io")], {"x.txt": b"OLD", ".env": b"OLD"})
    for policy in ("IfNewer", "Ask"):
        assert run(policy, policy) == ([("skip", None), ("skip", None), ("write", None)], {"x.txt": b"OLD", ".env": b"OLD", "y.txt": b"NEW"})
    assert run("Always", "w") == ([("write", None)] * 3, {"x.txt": b"NEW", ".env": b"NEW", "y.txt": b"NEW"})
    got, left = run("Rename", "r")
    assert got == [("write", None)] * 3 and left["x.txt"] == left[".env"] == b"OLD" and left["x (2).txt"] == left["y.txt"] == b"NEW" and len(left) == 5


def test_place_never_replaces(tmp_path):
    """A file that has appeared since the plan stays; a repeated attempt of the task finds its own work done."""
    from pyarrow import fs

    local, row = fs.LocalFileSystem(), {"action": "write", "out_path": "t", "mode": 0o644, "modified": None, "link_target": None}
    source, target = tmp_path / "s", tmp_path / "d/t"
    source.write_bytes(b"NEW")
    A._put(local, str(source), str(target), row, False)
    A._put(local, str(source), str(target), row, False)
    assert target.read_bytes() == b"NEW" and not source.exists()
    source.write_bytes(b"LATER")
    with pytest.raises(ArchiveError, match="already exists"):
        A._put(local, str(source), str(target), row, False)
    A._put(local, str(source), str(target), row, True)
    assert target.read_bytes() == b"LATER"


def test_archives_of_one_name(spark, tmp_path):
    """Archives that share a folder or file name do not mix."""
    one, two = (Wr.write_archive([Wr.Item("f", c)]) for c in (b"1", b"2"))
    df = spark.createDataFrame([("p/x.zip", bytearray(one)), ("q/x.zip", bytearray(two)), ("x.tar", bytearray(Wr.write_archive([Wr.Item("f", b"3")], "Tar")))], "path string, content binary")
    assert {r.error for r in A.extract(df, str(tmp_path / "e")).collect()} == {None}
    assert sorted(p.read_bytes() for p in (tmp_path / "e").rglob("f")) == [b"1", b"2", b"3"] and len(os.listdir(tmp_path / "e")) == 3 and (tmp_path / "e/x/f").read_bytes() == b"1"
    saved = {r.path: r.file for r in A.save(df, str(tmp_path / "s")).collect()}
    assert len(set(saved.values())) == 3 and all(open(f, "rb").read() == bytes(b) for (p, b) in df.collect() for f in [saved[p]])
    assert all(f.endswith((".zip", ".tar")) for f in saved.values()) and saved["p/x.zip"].endswith("/x.zip")


def test_extract_counts_what_is_decoded(spark, tmp_path):
    """A stream that states no size is held to the cap while it is decoded."""
    import gzip

    df = files(spark, big__gz=gzip.compress(bytes(5_000_000)), small__gz=gzip.compress(b"s" * 100))
    got = {r.archive: r for r in A.extract(df, str(tmp_path), cap=1_000_000).collect()}
    assert got["big.gz"].error.kind == "ZipBombSuspected" and got["big.gz"].action == "fail" and got["small.gz"].bytes == 100
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == ["small"]


def test_backends_differ(spark):
    """Kinds of errors, the ratio of totals and links depend on the backend that opened the archive."""
    schema = "archive string, backend string, seq long, path string, is_directory boolean, is_symlink boolean, uncompressed_size long, compressed_size long, link_target string"
    g = 1 << 30

    def rows(backend, *entries):
        return spark.createDataFrame([("z", backend, k, p, False, link is not None, u, c, link) for k, (p, u, c, link) in enumerate(entries)], schema)

    kinds = lambda df, **o: [(r.action, r.error.kind if r.error else None) for r in A.plan_extraction(df, **o).orderBy("seq").collect() if r.reached]
    for backend, kind in (("zip", "ZipBombSuspected"), ("tar", "ZipBombSuspected"), ("7z", "BackendError")):
        assert kinds(rows(backend, ("a", g, 1000, None))) == [("fail", kind)]
    for backend, kind in (("zip", "Io"), ("tar", "Io"), ("7z", "BackendError")):
        assert kinds(rows(backend, ("a", 5, 5, None), ("a", 5, 5, None)))[1] == ("fail", kind)
    steep = [("a", g // 2, 1000, None), ("b", g // 2, 1000, None)]
    assert kinds(rows("zip", *steep))[1] == ("fail", "ZipBombSuspected")
    assert [k for b in ("tar", "7z", "rar") for k in kinds(rows(b, *steep))] == [("write", None)] * 6
    many = [(f"f{k}", g // 4, 40_000_000 if k < 2 else 1000, None) for k in range(8)]
    assert kinds(rows("zip", *many), limit=20) == [("write", None)] * 8  # by many workers, which keep no running ratio
    link = [("l", 1, 1, "t"), ("t", 1, 1, None)]
    assert kinds(rows("rar", *link), follow_symlinks=True)[0] == ("skip", None) and kinds(rows("tar", *link), follow_symlinks=True)[0] == ("link", None)
    report = A.extract_report(A.plan_extraction(rows("tar", *link))).collect()[0]
    assert (report.extracted, report.skipped, report.warnings) == (1, 1, ["symbolic link skipped: links are not followed"])


def test_reader_warnings(spark):
    whole = bytearray(Wr.write_zip(ITEMS))
    at = whole.rfind(b"PK\1\2", 0, whole.rfind(b"PK\1\2"))
    whole[at : at + 4] = b"XXXX"
    got = A.reader_warnings(files(spark, hurt__zip=bytes(whole), ok__zip=Wr.write_archive(ITEMS), bad__7z=b"7z")).collect()
    assert {r.archive for r in got} == {"hurt.zip"} and "resynchronised" in got[0].warning


def test_create_and_append(spark):
    rows = [("x.zip", k, p, bytearray(b) if b is not None else None, None, None) for k, (p, b) in enumerate([("t/a", b"1"), ("t/Thumbs.db", b"2"), ("t/", None)])] + [("y.zip", 0, "q", bytearray(b"9"), None, None)]
    items = spark.createDataFrame(rows, "archive string, seq long, path string, payload binary, modified timestamp, mode int")
    made = {r.path: r for r in A.create(items).collect()}
    assert (made["x.zip"].entries, made["y.zip"].entries) == (2, 1)
    assert [e.path for e in open_archive(bytes(made["x.zip"].content), "x.zip").entries] == ["t/a", "t/"]
    assert {r.entries for r in A.create(items, exclude_metadata=False).collect()} == {3, 1}
    assert A.create(items, "Rar").collect()[0].error.kind == "FeatureDisabled"
    assert {r.path for r in A.batch_create(items, "Tar").collect()} == {"t.tar", "q.tar"}
    archives = A.create(items).select("path", "content")
    out = {r.path: r for r in A.append(archives, items.withColumn("path", F.concat("path", F.lit("")))).collect()}
    assert out["y.zip"].skipped_existing == ["q"] and out["x.zip"].added == 1
    new, old = A.append_plan(src.entries(archives), items)
    assert [r.path for r in new.collect()] == ["t/Thumbs.db"] and old.count() == 3
    assert A.without(src.entries(archives), ["q"]).count() == 2


def test_volumes(spark):
    df = files(spark, a__zip=bytes(range(250)) * 10, e__zip=b"")
    volumes = A.split_volumes(df, 1000)
    assert [(r.path, len(r.content)) for r in volumes.orderBy("path").collect()] == [("a.zip.001", 1000), ("a.zip.002", 1000), ("a.zip.003", 500), ("e.zip.001", 0)]
    back = {r.path: bytes(r.content) for r in src.join_volumes(volumes.repartition(3)).collect()}
    assert back == {"a.zip": bytes(range(250)) * 10, "e.zip": b""}
    assert {r.set: (r.volumes, r.bytes) for r in A.volume_totals(volumes).collect()} == {"a.zip": (3, 2500), "e.zip": (1, 0)}
    whole = Wr.write_archive(ITEMS)
    cut = A.split_volumes(files(spark, s__zip=whole), 300)
    assert src.entries(src.join_volumes(cut, spanned=True)).count() == 4
    with pytest.raises(Exception, match="InvalidArgument"):
        A.split_volumes(df, 1).collect()


def test_save_and_tree(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.txt").write_bytes(b"A")
    (tmp_path / "in/b.txt").write_bytes(b"B")
    items = A.source_tree(spark, str(tmp_path / "in"), "t.zip", "pre")
    saved = A.save(A.create(items).select("path", "content"), str(tmp_path / "out")).collect()
    assert [r.bytes for r in saved] == [os.path.getsize(tmp_path / "out/t.zip")]
    rows = src.read_archives(spark, str(tmp_path / "out"), content=True).collect()
    assert [r.path for r in sorted(rows, key=lambda r: r.seq)] == ["pre/sub/", "pre/b.txt", "pre/sub/a.txt"]
    assert {r.path: bytes(r.content) for r in rows if not r.is_directory} == {"pre/sub/a.txt": b"A", "pre/b.txt": b"B"}


def test_verbs(spark, tmp_path):
    """Create, list, test, extract, append, cut and batch, by their verbs; exit codes tell what went wrong."""
    from stowage.cli import main

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.txt").write_bytes(b"A" * 5000)
    (tmp_path / "in/b.txt").write_bytes(b"B")
    (tmp_path / "lone.txt").write_bytes(b"L")
    said: list[str] = []
    run = lambda *args: (said.clear(), main(list(map(str, args)), spark, said.append))[1]
    out = tmp_path / "out"
    assert run("a", "-t", out / "x.zip", tmp_path / "in", tmp_path / "lone.txt") == 0 and "4 entries" not in said
    assert run("l", out / "x.zip") == 0 and said[-1].endswith(": 4 entries, 5002 bytes, " + said[-1].rsplit(", ", 1)[1]) and any(x.endswith("  sub/a.txt") for x in said)
    assert run("t", out / "x.zip") == 0 and "3 tested, 0 corrupted" in said[0]
    assert run("x", "-o", tmp_path / "x", out / "x.zip") == 0 and (tmp_path / "x/x/sub/a.txt").read_bytes() == b"A" * 5000 and (tmp_path / "x/x/lone.txt").read_bytes() == b"L"
    assert run("x", "-o", tmp_path / "x", out / "x.zip") == 3 and run("x", "--aos", "-o", tmp_path / "x", out / "x.zip") == 0 and run("-y", "x", "-o", tmp_path / "x", out / "x.zip") == 0
    assert run("e", "-o", tmp_path / "flat", out / "x.zip") == 0 and (tmp_path / "flat/x/a.txt").exists()
    (tmp_path / "in/c.txt").write_bytes(b"C")
    assert run("a", out / "x.zip", tmp_path / "in") == 0 and "1 added, 3 there already" in said[0]
    assert run("a", "-v", "1k", "--format", "tar", out / "v.tar", tmp_path / "in") == 0 and (out / "v.tar.002").exists()
    assert run("a", "-p", "pw", "--storeroot", out / "s.7z", tmp_path / "in") == 0 and run("t", "-p", "pw", out / "s.7z") == 0
    assert run("bc", tmp_path / "batch", tmp_path / "in") == 0 and sorted(os.listdir(tmp_path / "batch")) == ["b.zip", "c.zip", "sub.zip"]
    (tmp_path / "bad.zip").write_bytes(b"PK\3\4 nothing")
    assert run("bt", out / "x.zip", tmp_path / "bad.zip") == 5 and run("l", tmp_path / "bad.zip") == 5 and run("x", "-o", tmp_path / "y", tmp_path / "bad.zip") == 5
    assert run("a", "--format", "rar", out / "r.rar", tmp_path / "in") == 8 and run("a", out / "n.zip") == 2 and run("nonsense") == 2


def test_writer(spark, tmp_path):
    src.register(spark)
    rows = [(f"x{k % 2}.tar", k, f"f{k}", bytearray(b"%d" % k)) for k in range(6)] + [("sub/y.tar", 0, "q", bytearray(b"9"))]
    items = spark.createDataFrame(rows, "archive string, seq long, path string, payload binary")
    items.repartition("archive").sortWithinPartitions("archive", "seq").write.format("archive").option("kind", "Tar").mode("append").save(str(tmp_path / "o"))
    assert sorted(p.relative_to(tmp_path / "o").as_posix() for p in (tmp_path / "o").rglob("*.*")) == ["sub/y.tar", "x0.tar", "x1.tar"]
    assert src.read_archives(spark, str(tmp_path / "o")).count() == 7
    with pytest.raises(Exception, match="FeatureDisabled|cannot be created"):
        items.coalesce(1).sortWithinPartitions("archive").write.format("archive").option("kind", "Rar").mode("append").save(str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]


def test_links_modes_times(spark, tmp_path):
    import datetime as dt
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, kind, link, mode in (("d/f", tarfile.REGTYPE, "", 0o4755), ("d/l", tarfile.SYMTYPE, "f", 0o777), ("d/out", tarfile.SYMTYPE, "../../x", 0o777), ("d/h", tarfile.LNKTYPE, "d/f", 0o600)):
            info = tarfile.TarInfo(name)
            info.type, info.linkname, info.mode, info.mtime, info.size = kind, link, mode, 631152000, 4 if kind == tarfile.REGTYPE else 0
            t.addfile(info, io.BytesIO(b"data"))
    got = {r.out_path: r.action for r in A.extract(files(spark, a__tar=out.getvalue()), str(tmp_path), follow_symlinks=True).collect()}
    assert got == {"d/f": "write", "d/l": "link", "d/out": "skip", "d/h": "write"}
    f = tmp_path / "a/d/f"
    assert os.readlink(tmp_path / "a/d/l") == "f" and (tmp_path / "a/d/h").read_bytes() == b"data"
    assert f.stat().st_mode & 0o7777 == 0o755 and dt.datetime.fromtimestamp(f.stat().st_mtime, dt.timezone.utc).year == 1990


def test_sets_and_verified(spark, tmp_path):
    whole = Wr.write_archive(ITEMS)
    for k in range(0, len(whole), 400):
        (tmp_path / f"x.zip.{k // 400 + 1:03}").write_bytes(whole[k : k + 400])
    (tmp_path / "lone.zip").write_bytes(whole)
    assert A.read_sets(spark, str(tmp_path)).count() == 4
    rows = [("v.zip", 0, "a", bytearray(b"1"), None, None), ("v.zip", 1, "b", bytearray(b"2"), None, None)]
    made = A.create_verified(spark.createDataFrame(rows, "archive string, seq long, path string, payload binary, modified timestamp, mode int")).collect()
    assert [(r.path, r.tested, r.corrupted) for r in made] == [("v.zip", 2, 0)]
