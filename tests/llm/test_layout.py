"""WARC archives, mixing and sharding against plain Python."""

import gzip
import hashlib
import io
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pytest

from stowage.llm import mixing, slots, warc
from stowage.session import scratch

BIG = "<p>ü</p>" * 200


def test_round_trip(spark):
    rows = [(1, "http://a/", BIG), (7, "http://b/", BIG), (3, None, BIG), (7, "http://b/", BIG), (4, "u\r\nv", None), (5, "", ""), (6, "x", "small"), (8, "y", "small"), (9, "z", "\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08" * 90), (None, "n", "<i>")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, sha int").repartition(3)
    got = sorted((r for r in warc.round_trip(df).collect()), key=lambda r: (r.page_id is None, r.page_id))
    assert len(got) == len(rows)
    text = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(text[r.page_id]), hashlib.sha1(text[r.page_id]).hexdigest())
        want = ("revisit", 7) if r.page_id in (1, 3) else ("response", None)
        assert (r.record_type, r.refers_to) == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_files_hold_payloads(spark):
    df = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}</p>" * (k + 1)) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    for compress in (True, False):
        files = warc.write(df, scratch(spark, "w"), compress=compress, file_bytes=4000)
        assert files.count() > 2
        got = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, files).collect()}
        assert got == {k: f"<p>{k}</p>" * (k + 1) for k in range(40)}


@pytest.mark.parametrize("compress", [True, False])
def test_long_urls(spark, compress):
    """A header of any length that the writer makes is read; a page and the one that refers to it both come back."""
    long = "data:text/html," + "x" * 100_000
    df = spark.createDataFrame([(1, long, BIG), (2, "http://a/", BIG), (3, long * 7, "small"), (4, "http://b/", "y")], "page_id long, url string, html string").coalesce(1)
    files = warc.write(df, scratch(spark, "long"), compress=compress)
    got = {r.page_id: (r.record_type, r.refers_to, r.reason) for r in warc.read(spark, files, complete=True).collect()}
    assert got == {1: ("revisit", 2, None), 2: ("response", None, None), 3: ("response", None, None), 4: ("response", None, None)}
    assert sorted(r.page_id for r in warc.round_trip(df).collect()) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="4 records read, 5 written"):
        warc.read(spark, files.withColumn("records", files.records + 1), complete=True).collect()


def archive(compress, n=12, size=3000):
    pack, parts = (warc.member if compress else bytes), []
    rng = random.Random(5)
    for k in range(n):
        parts.append(pack(warc.page_record(k, "u", bytes(rng.choices(b"abcdefgh <>\r\n", k=size + k)))))
    return parts


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = archive(compress)
    clean = list(warc.salvage(io.BytesIO(b"".join(parts))))
    assert [r.headers["warc-page-id"] for r in clean] == [str(k) for k in range(12)]
    hurt = list(parts)
    hurt[2] = hurt[2][:400] + b"\x00\xff\x00\xff" + hurt[2][404:]
    hurt[5] = hurt[5][: len(hurt[5]) // 2]
    hurt[8] = b"junk \x1f\x8b\x08 WARC/1.1\r\n junk" + hurt[8]
    hurt[11] = hurt[11][:-20]
    found = list(warc.salvage(io.BytesIO(b"".join(hurt))))
    kept = [int(r.headers["warc-page-id"]) for r in found if isinstance(r, warc.Record)]
    assert kept == [0, 1, 3, 4, 6, 7, 8, 9, 10]
    starts = [sum(map(len, hurt[:k])) for k in range(13)]
    gaps = [x[:2] for x in found if isinstance(x, tuple)]
    assert gaps == [(starts[2], starts[3]), (starts[5], starts[6]), (starts[8], starts[8] + len(hurt[8]) - len(parts[8])), (starts[11], starts[12])]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_never_invents(compress):
    parts = archive(compress, 6, 300)
    whole, rng = b"".join(parts), random.Random(9)
    true = {hashlib.sha1(r.block).hexdigest() for r in warc.salvage(io.BytesIO(whole))}
    for _ in range(120):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data))
            data[at : at + rng.randint(0, 40)] = rng.randbytes(rng.randint(0, 40))
        found = list(warc.salvage(io.BytesIO(bytes(data)), True))
        kept = [r for r in found if isinstance(r, warc.Record)]
        assert {hashlib.sha1(r.block).hexdigest() for r in kept} <= true and len(kept) + 4 >= len(parts)


def lying(size, digest=False):
    """A member of zeros whose header tells its true length, or one more record than there is."""
    z, parts = zlib.compressobj(9, zlib.DEFLATED, 31), []
    about = f"WARC-Block-Digest: sha1:{'0' * 40}\r\n" if digest else ""
    parts.append(z.compress(f"WARC/1.1\r\nWARC-Type: response\r\n{about}Content-Length: {size}\r\n\r\n".encode()))
    for _ in range(size >> 20):
        parts.append(z.compress(bytes(1 << 20)))
    return b"".join([*parts, z.compress(b"\r\n\r\n"), z.flush()])


def test_damage_takes_no_memory():
    """A member that inflates without end, and a length behind the end of a large file, are skipped in bounded memory."""
    good, plain = archive(True, 2), archive(False, 2)
    bomb = lying(300 << 20, digest=True)
    far = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2000000000\r\n\r\n" + b"x" * (30 << 20)
    near = far.replace(b"2000000000", str(25 << 20).encode())
    file = io.BytesIO(good[0] + bomb + good[1] + plain[0] + far + plain[1] + near + good[0])
    tracemalloc.start()
    found = [x if isinstance(x, tuple) else x.headers["warc-page-id"] for x in warc.salvage(file)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x for x in found if isinstance(x, str)] == ["0", "1", "0", "1", "0"]
    assert [x[1] - x[0] for x in found if isinstance(x, tuple)] == [len(bomb), len(far), len(near)]
    assert peak < 40 << 20


@pytest.mark.parametrize("compress", [True, False])
def test_large_records(compress):
    """A record over the size that is held comes back whole."""
    payload = random.Random(2).randbytes(warc.HELD + 12345)
    data = (warc.member if compress else bytes)(warc.page_record(1, "u", payload))
    found = list(warc.salvage(io.BytesIO(data * 2), True))
    assert [r.payload == payload for r in found] == [True, True]
    hurt = bytearray(data * 2)
    hurt[len(data) // 2] ^= 1
    assert [isinstance(x, tuple) for x in warc.salvage(io.BytesIO(bytes(hurt)), True)] == [True, False]


def test_foreign_archives():
    """One member over several records is damage to this reader unless each record has its own; plain text reads on."""
    plain = b"".join(archive(False, 3))
    mixed = gzip.compress(archive(False, 1)[0]) + plain + b"\r\n" + plain
    kinds = [isinstance(x, warc.Record) for x in warc.salvage(io.BytesIO(mixed))]
    assert kinds == [True, True, True, True, False, True, True, True]


# -- mixing --------------------------------------------------------------------------------------


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, full, total = set(names), {}, share * sum(sizes.values())
    while left:
        level = (total - sum(full.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > most * sizes[s]}
        if not over:
            return {**full, **{s: weight[s] * level for s in left}}
        full |= {s: most * sizes[s] for s in over}
        left -= over
    return full


def test_mix(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(["w\t\x0bé"] * rng.choice([0, 1, 3, 40])), rng.choice(["a", "b", "é", "Z", None, "c"])) for k in range(400)]
    docs += [(950, "repeated row", "a")] * 3 + [(None, "x y", "b"), (901, None, "c"), (902, "big " * 5000, "solo"), (903, "", "empty")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert len(got) == len(docs)
    sizes = defaultdict(int)
    of = {d[0]: d[2] for d in docs}
    for d in docs:
        sizes[d[2]] += words(d[1])
    goal, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        s = of[r.doc_id]
        assert r.target == pytest.approx(goal[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 0.5
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert mixing.mix(df.limit(0)).count() == 0


def test_positions_invert_the_demand(spark):
    """The area of a schedule up to a document's position is the words drawn before it."""
    for schedule in mixing.SCHEDULES:
        df = spark.createDataFrame([(float(k), 1000.0) for k in range(0, 1001, 50)], "drawn double, target double")
        for drawn, t in df.select("drawn", mixing.position_of(df.drawn, df.target, schedule)).collect():
            area = lambda upto: sum((min(b[0], upto) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (min(b[0], upto) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(schedule, schedule[1:], strict=False) if a[0] < upto)
            assert area(t) / area(1.0) == pytest.approx(drawn / 1000, abs=1e-9)


def test_dealt(spark):
    df = spark.createDataFrame([(k, "w " * (k % 9), f"s{k % 4}", k) for k in range(120)], "doc_id long, text string, source string, n_chars long")
    got, plan = mixing.dealt(df).collect(), {r.id: r for r in mixing.plan(df).collect()}
    assert mixing.dealt(df).columns == df.columns
    times = Counter(r.doc_id for r in got)
    for k, r in plan.items():
        assert times[k] == (1 if r.size == 0 else r.epochs + (2 * r.last_words >= r.size and r.last_words > 0))
    for s in {r.source for r in got}:
        taken = sum(words(r.text) for r in got if r.source == s)
        goal = next(p.target for p in plan.values() if p.source == s)
        assert abs(taken - goal) <= 0.5 * 8 + 0.5


@pytest.mark.parametrize("text", [lambda k: "same words", lambda k: f"w{k} " * (k % 5)])
def test_repeated_rows_spread_over_ranges(spark, text):
    """Rows without id, and rows equal in all, do not meet in one range; reruns agree however rows are dealt."""
    docs = [(None if k % 3 else 7, text(k), "s") for k in range(6000)] + [(100 + k, f"own {k}", "s") for k in range(200)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, row int")
    rows = mixing.plan(df).collect()
    assert len(rows) == len(docs) and max(Counter(r.range for r in rows).values()) < 16
    again = mixing.plan(df.repartition(9)).collect()
    same = lambda rows: Counter((r.id, r.size, r.taken, r.position) for r in rows)
    assert same(rows) == same(again)
    assert mixing.dealt(df).columns == df.columns and sum(words(r.text) for r in mixing.dealt(df).collect()) == pytest.approx(rows[0].target, abs=3)


def test_targets_of_many_sources(spark):
    """Turns and levels over many ranges equal those by plain search."""
    rng = random.Random(8)
    sizes = {f"d{k}": rng.choice([0, 1, 7, 300, 5000]) for k in range(300)} | {None: 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    goal, got = plain_targets(sizes), {r.source: r for r in mixing.targets(df).collect()}
    names = [*sorted(s for s in sizes if s is not None), None]
    assert {s: (got[s].turn, pytest.approx(goal[s])) for s in sizes} == {s: (names.index(s), got[s].target) for s in sizes}
    assert mixing.targets(df.limit(0)).count() == 0


# -- sharding ------------------------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(4)
    docs = [(k, "é" * rng.choice([0, 5, 50, 900])) for k in range(3000)] + [(None, None), (None, None), (5, "again"), (5, "again"), (7, "x" * 9000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shard int")
    got = slots.shard(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, slots.shard(df.repartition(5)).collect()))
    want = Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    load, places = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert set(load) == set(range(16)) and max(load.values()) - min(load.values()) <= 10
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert slots.shard(df.limit(0)).count() == 0


def test_map_versions(spark):
    """Each run edits the latest version and writes the next; a failed write is no version."""
    path = scratch(spark, "maps")
    df = spark.createDataFrame([(k, "x" * (k % 50)) for k in range(500)], "doc_id long, text string")
    assert slots.latest(spark, path) is None
    assert {r.version for r in slots.shard(df, map_path=path).collect()} == {1}
    old, new = slots.load_map(spark, path, 0), slots.load_map(spark, path, 1)
    assert old == slots.even_map() and len(new) == slots.SLOTS
    assert sum(a == b for a, b in zip(old, new, strict=True)) > 0.8 * slots.SLOTS
    more = df.union(spark.createDataFrame([(900 + k, "y" * 400) for k in range(40)], df.schema))
    rows = slots.shard(more, map_path=path).collect()
    assert {r.version for r in rows} == {2} and slots.latest(spark, path) == 2
    third = slots.load_map(spark, path, 2)
    assert 0 < sum(a != b for a, b in zip(new, third, strict=True)) < 600 and all(third[r.virtual_slot] == r.shard for r in rows)
    assert slots.load_map(spark, path, 0) == old and slots.load_map(spark, path, 1) == new
    with pytest.raises(ValueError, match="fixed for good"):
        slots.shard(df, slots=64, map_path=path)
    fewer = slots.shard(more, shards=4, map_path=path).groupBy("shard").sum("size").collect()
    assert {r.shard for r in fewer} == {0, 1, 2, 3}


@pytest.mark.parametrize("id_of", [lambda k: 7, lambda k: None])
def test_repeated_rows_are_spread(spark, id_of):
    """Half of all rows equal: shards stay near each other, by as little as one row's bytes."""
    docs = [(id_of(k), "same text " * 30) if k % 2 else (k, "t" * (k % 700)) for k in range(20_000)]
    got = slots.shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(docs)
    load, places = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert max(load.values()) - min(load.values()) <= 701
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_long_text_in_shards(spark):
    long = "é" * 3_000_000
    got = slots.shard(spark.createDataFrame([(1, long), (2, "a")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == [(1, 6_000_001, zlib.crc32(long.encode())), (2, 2, zlib.crc32(b"a"))]


def test_rebalance_against_heavy_slot():
    weight = {0: 1000, **dict.fromkeys(range(1, 400), 10)}
    load = Counter()
    for s, k in enumerate(slots.rebalance(slots.even_map(400, 4), weight, 4)):
        load[k] += weight.get(s, 0)
    assert sorted(load.values())[-1] - sorted(load.values())[0] <= 10
