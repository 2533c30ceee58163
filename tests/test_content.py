"""Payload functions, name decoding and the stream of arriving archives."""

import random

from pyspark.sql import functions as F

from stowage.formats import write as Wr
from stowage.functions import content as C
from stowage.streaming import arrivals, watch_archives


def test_probe(spark):
    noise = random.Random(1).randbytes(70_000)
    df = spark.createDataFrame([(0, bytearray(noise)), (1, bytearray(b"a" * 70_000)), (2, bytearray(noise[:100])), (3, None), (4, bytearray(noise + b"z" * (4 << 20)))], "row long, c binary")
    got = [tuple(r) for r in df.select("row", C.incompressible(F.col("c")), C.deflate_ratio("c").isNull()).orderBy("row").collect()]
    assert got == [(0, True, False), (1, False, False), (2, False, True), (3, False, True), (4, False, False)]


def test_preflight(spark):
    data = Wr.write_zip([Wr.Item("a", b"x" * 5000)])
    big = Wr.write_zip([Wr.Item("a", random.Random(2).randbytes(2 << 20))])
    cases = [data, data[:-30], data + b"c" * 200, b"", big, big[1000:]]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(cases)], "row long, c binary")
    got = [r[1] for r in df.select("row", C.zip_fault(F.col("c"))).orderBy("row").collect()]
    assert [g is None for g in got] == [True, False, False, False, True, False]


def test_names(spark):
    rows = [("k", 0, bytearray("한글.txt".encode("cp949")), False, None), ("k", 1, bytearray(b"plain"), False, None), ("u", 0, bytearray("é".encode()), True, None), ("u", 1, bytearray(b"x"), False, "y"), ("u", 2, None, None, None)]
    df = spark.createDataFrame(rows, "archive string, seq long, raw binary, utf8_flag boolean, unicode_path string")
    got = sorted(map(tuple, C.decode_archive_names(df).collect()))
    assert got == [("k", 0, "한글.txt", "Cp949"), ("k", 1, "plain", "Cp949"), ("u", 0, "é", "Utf8"), ("u", 1, "y", "Utf8"), ("u", 2, "", "Utf8")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.zip").write_bytes(Wr.write_archive([Wr.Item("x", b"1"), Wr.Item("y", b"22")]))
    (tmp_path / "in/b.tar").write_bytes(Wr.write_archive([Wr.Item("z", b"333")], "Tar"))
    q = watch_archives(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (tmp_path / "in/c.zip").write_bytes(b"PK\3\4")
    q.processAllAvailable()
    q.stop()
    assert sorted((r.path, r.seq) for r in spark.table("seen").collect() if r.path) == [("x", 0), ("y", 1), ("z", 0)]
    assert spark.table("seen").where("error is not null").count() == 1
    w = arrivals(watch_archives(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).start()
    w.processAllAvailable()
    w.stop()
    assert {r.format: (r.entries, r.bytes) for r in spark.table("sums").collect()} == {"Zip": (2, 3), "Tar": (1, 3)}
