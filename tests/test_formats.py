"""Parsers and writers on synthetic archives: round trips, damage, limits, and agreement with the standard library."""

import bz2
import datetime as dt
import gzip
import io
import lzma
import random
import struct
import tarfile
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.errors import KINDS, ArchiveError
from stowage.formats import Ranged, open_archive
from stowage.formats import streams as S
from stowage.formats import write as Wr
from stowage.formats.aes import cbc_decrypt, cbc_encrypt, encrypt, expand
from stowage.formats.containers import cab_checksum
from stowage.formats.names import RawName, decode_names, detect_codepage
from stowage.formats.sniff import detect
from stowage.formats.zip import find_directory, is_recoverable, join_spanned, open_lenient, open_strict

UTC = dt.timezone.utc
WHEN = dt.datetime(1999, 12, 31, 23, 59, 58, tzinfo=UTC)
ITEMS = [Wr.Item("dir/", None, WHEN, 0o750), Wr.Item("dir/a.txt", b"alpha\n" * 50, WHEN, 0o755), Wr.Item("empty", b"", WHEN), Wr.Item("b.bin", random.Random(1).randbytes(5000), WHEN)]


def payloads(a):
    return {e.path.rstrip("/"): a.read(k) for k, e in enumerate(a.entries) if not e.is_directory}


WANT = {i.path: i.payload for i in ITEMS if i.payload is not None}


@pytest.mark.parametrize("kind,name", [("Zip", "x.zip"), ("Zipx", "x.zipx"), ("SevenZ", "x.7z"), ("Tar", "x.tar"), ("TarGz", "x.tgz")])
def test_round_trip(kind, name):
    data = Wr.write_archive(ITEMS, kind)
    a = open_archive(data, name)
    assert a.format == kind and payloads(a) == WANT
    assert [e.path.rstrip("/") for e in a.entries] == [i.path.rstrip("/") for i in ITEMS]
    assert [e.is_directory for e in a.entries] == [True, False, False, False]
    assert all(e.modified == WHEN for e in a.entries)
    if kind in ("Zip", "Tar"):
        assert a.entries[1].attributes & 0o777 == 0o755


@pytest.mark.parametrize("kind,name", [("Zip", "x.zip"), ("SevenZ", "x.7z")])
def test_encryption(kind, name):
    data = Wr.write_archive(ITEMS[1:], kind, password="pass wörd")
    assert payloads(open_archive(data, name, "pass wörd")) == WANT
    for wrong in (None, "nope"):
        with pytest.raises(ArchiveError) as e:
            payloads(open_archive(data, name, wrong))
        assert e.value.kind == "WrongPassword"


def test_aes_vectors():
    """The examples of the standard, and a round trip of chained blocks."""
    import numpy as np

    plain = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8).reshape(1, 16)
    assert encrypt(plain, expand(bytes(range(16)))).tobytes().hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert encrypt(plain, expand(bytes(range(32)))).tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert cbc_decrypt(cbc_encrypt(b"0123456789abcdef" * 3, bytes(32), bytes(16)), bytes(32), bytes(16)) == b"0123456789abcdef" * 3


def test_own_files_open_elsewhere():
    with zipfile.ZipFile(io.BytesIO(Wr.write_archive(ITEMS, "Zip"))) as z:
        assert z.testzip() is None and {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()} == WANT
    with tarfile.open(fileobj=io.BytesIO(Wr.write_archive(ITEMS, "TarGz"))) as t:
        assert {m.name: t.extractfile(m).read() for m in t if m.isfile()} == WANT
    assert lzma.decompress(Wr.write_archive([ITEMS[1]], "Xz")) == ITEMS[1].payload


@pytest.mark.parametrize("kind", ["Rar", "Iso", "Cab", "Msi", "Deb", "Gzip", "TarBz2", "TarXz", "Bzip2", "Lzma", "Zstd", "Lz4", "TarZst", "TarLz4"])
def test_refused_formats(kind):
    with pytest.raises(ArchiveError) as e:
        Wr.write_archive(ITEMS, kind)
    assert e.value.kind in ("FeatureDisabled", "UnsupportedFormat")


def test_xz_takes_one_file():
    with pytest.raises(ArchiveError, match="exactly one"):
        Wr.write_archive(ITEMS, "Xz")


def test_smart_store():
    noise = random.Random(2).randbytes(65536)
    a = open_archive(Wr.write_archive([Wr.Item("photo.jpg", b"x" * 9000), Wr.Item("inner.zip", noise), Wr.Item("t.txt", b"t" * 9000), Wr.Item("noise.dat", noise)]), "a.zip")
    assert [e.compression for e in a.entries] == ["Store", "Store", "Deflate", "Store"]
    assert Wr.probe_says_store(noise) and not Wr.probe_says_store(b"z" * 65536) and not Wr.probe_says_store(noise[:100])


def test_append():
    base = Wr.write_archive(ITEMS[1:3])
    data, added, skipped = Wr.append_zip(base, [Wr.Item("empty", b"other"), Wr.Item("new", b"n"), Wr.Item("d/", None)])
    assert (added, skipped) == (["new", "d/"], ["empty"])
    assert payloads(open_archive(data, "a.zip")) == {"dir/a.txt": WANT["dir/a.txt"], "empty": b"", "new": b"n"}


# -- streams and tars ----------------------------------------------------------------------------

BODY = b"line of text\n" * 1300
PACKERS = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "lzma": lambda b: lzma.compress(b, lzma.FORMAT_ALONE), "lz4": S.lz4_frame}


@pytest.mark.parametrize("suffix", [*PACKERS, "zst"])
def test_streams(suffix):
    import zstandard

    data = (PACKERS.get(suffix) or zstandard.ZstdCompressor().compress)(BODY)
    a = open_archive(data, f"/x/Notes.TXT.{suffix}")
    assert a.entries[0].path == "Notes.TXT" and a.entries[0].uncompressed_size == 0 and a.read(0) == BODY
    with pytest.raises(ArchiveError) as e:
        a.read(0, 1000)
    assert e.value.kind == "ZipBombSuspected"
    with pytest.raises(ArchiveError) as e:
        open_archive(data[: len(data) // 2], f"x.{suffix}").read(0)
    assert e.value.kind in KINDS
    assert open_archive(data, "logo.svgz" if suffix == "gz" else f"x.{suffix}").entries[0].path != "logo.svgz"


@pytest.mark.parametrize("suffix", ["gz", "bz2", "xz"])
def test_multi_member(suffix):
    pack = PACKERS[suffix]
    assert open_archive(pack(BODY) + pack(b"more"), f"x.{suffix}").read(0) == BODY + b"more"
    tar = Wr.write_tar(ITEMS)
    cut = pack(tar[:700]) + pack(tar[700:1500]) + pack(tar[1500:])
    assert payloads(open_archive(cut, f"x.tar.{suffix}")) == WANT


@pytest.mark.parametrize("suffix", ["gz", "bz2", "xz", "zst", "lz4"])
def test_large_tars_are_streams(suffix, monkeypatch):
    """A tar that is not held is listed and read piece by piece, forwards and back, with the same rows; memory stays small."""
    import zstandard

    from stowage.formats import tar as T

    items = [Wr.Item(f"f{k}", bytes([k]) * (400_000 + k)) for k in range(12)]
    data = (PACKERS.get(suffix) or zstandard.ZstdCompressor().compress)(Wr.write_tar(items))
    held = payloads(open_archive(data, f"x.tar.{suffix}"))
    monkeypatch.setattr(T, "HELD", 100_000)
    a = open_archive(Ranged(io.BytesIO(data)), f"x.tar.{suffix}")
    assert payloads(a) == held == {i.path: i.payload for i in items}
    assert a.read(11) == items[11].payload and a.read(2) == items[2].payload and a.read(3) == items[3].payload
    with pytest.raises(ArchiveError) as e:
        open_archive(data[:-40], f"x.tar.{suffix}").read(11)
    assert e.value.kind in KINDS


def test_streams_that_swell(monkeypatch):
    """A compressed tar a thousand times its stream, from a gibibyte on, is a bomb, and takes no memory to be told."""
    import tracemalloc

    from stowage.formats import tar as T

    monkeypatch.setattr(T, "HELD", 1 << 20)
    info = tarfile.TarInfo("zeros")
    info.size = 3 << 30
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    data = b"".join([z.compress(info.tobuf()), *(z.compress(bytes(1 << 24)) for _ in range(192)), z.compress(bytes(1024)), z.flush()])
    tracemalloc.start()
    with pytest.raises(ArchiveError) as e:
        open_archive(data, "x.tar.gz")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert e.value.kind == "ZipBombSuspected" and peak < 24 << 20


def test_lz4_matches():
    """A block with an overlapping match, by hand: four literals, then twelve bytes from two back."""
    block = bytes([0x48]) + b"abcd" + struct.pack("<H", 2) + bytes([0x50]) + b"vwxyz"
    assert S.lz4_block(block, b"", 99) == b"abcd" + b"cd" * 6 + b"vwxyz"


def test_tar_kinds():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT, pax_headers={"comment": "global"}) as t:
        for name, kind, link in (("p/f", tarfile.REGTYPE, ""), ("p/h", tarfile.LNKTYPE, "p/f"), ("p/s", tarfile.SYMTYPE, "../x"), ("p/lost", tarfile.LNKTYPE, "gone")):
            info = tarfile.TarInfo(name)
            info.type, info.linkname, info.size = kind, link, 4 if kind == tarfile.REGTYPE else 0
            t.addfile(info, io.BytesIO(b"data"))
    a = open_archive(out.getvalue(), "x.tar")
    assert [(e.path, e.is_symlink, e.is_hardlink) for e in a.entries] == [("p/f", False, False), ("p/h", False, True), ("p/s", True, False), ("p/lost", False, True)]
    assert a.read(1) == b"data"
    with pytest.raises(ArchiveError, match="link target"):
        a.read(3)


def test_legacy_names():
    names = [RawName("한글 파일.txt".encode("cp949")), RawName(b"plain"), RawName("é".encode())]
    assert decode_names(names) == (["한글 파일.txt", "plain", "é"], "Cp949")
    assert detect_codepage([RawName("新しいフォルダー".encode("shift_jis"))]) == "ShiftJis"
    assert detect_codepage([RawName("中文".encode("gbk"))], "Big5") == "Big5" and detect_codepage([RawName(b"a")]) == "Utf8"
    assert decode_names([RawName(b"\xff\xfe"), RawName(b"x", unicode_path="y")])[0][1] == "y"
    t = tarfile.TarInfo("x")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", encoding="cp949", format=tarfile.GNU_FORMAT) as tar:
        t.name = "문서/보고서.txt"
        tar.addfile(t)
    assert open_archive(out.getvalue(), "k.tar").entries[0].path == "문서/보고서.txt"


# -- damaged ZIPs --------------------------------------------------------------------------------


def test_codepages():
    """Names in old code pages are told apart by how common their characters are there; ties and doubt go by script, then locale."""
    from stowage.formats.names import RawName, decode_names, detect_codepage

    for text, codec, page in (
        ("새 폴더/사진 모음.txt", "cp949", "Cp949"), ("ふりがな.txt", "shift_jis", "ShiftJis"), ("新しいフォルダー/写真.txt", "shift_jis", "ShiftJis"),
        ("中文目录/照片.txt", "gbk", "Gbk"), ("新建文件夹.txt", "gbk", "Gbk"), ("新資料夾/照片.txt", "big5", "Big5"),
    ):
        names, found = decode_names([RawName(text.encode(codec)), RawName(b"plain")])
        assert (names, found) == ([text, "plain"], page), text
    rare = RawName(b"\x94\xee")
    assert detect_codepage([rare], locale="ja_JP.UTF-8") in ("ShiftJis", "Cp949") and detect_codepage([rare], "Big5") == "Big5"
    assert detect_codepage([RawName(b"\xff\xfe")]) == "Utf8" and detect_codepage([RawName("ü".encode())]) == "Utf8"


def small_zip(n=4):
    return Wr.write_zip([Wr.Item(f"payload_{k}.bin", bytes([k]) * 1024) for k in range(n)])


def test_lenient_equals_strict():
    data = Wr.write_archive(ITEMS)
    s, t = open_strict(data), open_lenient(data)
    assert payloads(s) == payloads(t)
    for a, b in zip(s.entries, t.entries, strict=True):
        assert (a.path, a.uncompressed_size, a.compressed_size, a.compression, a.crc32, a.modified) == (b.path, b.uncompressed_size, b.compressed_size, b.compression, b.crc32, b.modified)


@pytest.mark.parametrize("hurt", ["offset", "size", "zero", "record", "comment", "beyond"])
def test_recovery(hurt):
    data = bytearray(small_zip())
    end = data.rfind(b"PK\5\6")
    first = data.find(b"PK\1\2")
    lost = set()
    if hurt == "offset":
        struct.pack_into("<I", data, end + 16, 0x7FFFFFF0)
    elif hurt == "size":
        struct.pack_into("<I", data, end + 12, 0x7FFFFFF0)
    elif hurt == "zero":
        struct.pack_into("<I", data, end + 12, 0)
    elif hurt == "record":
        second = data.find(b"PK\1\2", first + 4)
        data[second] = 0
        lost = {"payload_1.bin"}
    elif hurt == "comment":
        struct.pack_into("<H", data, end + 20, 300)
        data += b"c" * 300
    else:
        struct.pack_into("<I", data, first + 42, 0x7FFFFFF0)
        lost = {"payload_0.bin"}
    a = open_archive(bytes(data), "x.zip")
    assert a.backend == "zip-lenient" or hurt == "beyond"
    got = {}
    for k, e in enumerate(a.entries):
        try:
            got[e.path] = a.read(k)
        except ArchiveError as x:
            assert x.kind in KINDS
    assert {f"payload_{k}.bin" for k in range(4)} - lost <= set(got) and all(v == bytes([int(p[8])]) * 1024 for p, v in got.items())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 6))
def test_mutations_never_invent(seed, edits):
    rng, whole = random.Random(seed), small_zip()
    data = bytearray(whole)
    for _ in range(edits):
        data[rng.randrange(max(0, len(data) - 420), len(data))] = rng.randrange(256)
    try:
        a = open_archive(bytes(data), "x.zip")
    except ArchiveError as e:
        assert e.kind in KINDS
        return
    for k in range(len(a.entries)):
        try:
            payload = a.read(k, 1 << 20)
        except ArchiveError as e:
            assert e.kind in KINDS
            continue
        if a.entries[k].crc32 == zlib.crc32(payload) and payload:
            assert len(set(payload)) == 1 or payload in whole


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=1023), st.sampled_from(["x", "x.zip", "x.7z", "x.tar.gz", "x.iso", "x.cab", "x.msi", "x.deb", "x.rar", "x.zst", "x.lz4"]))
def test_noise(data, name):
    for head in (b"", b"PK\3\4", b"7z\xbc\xaf\x27\x1c", b"MSCF", b"!<arch>\n", b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"\x04\x22\x4d\x18"):
        try:
            a = open_archive(head + data, name)
            for k in range(min(3, len(a.entries))):
                a.read(k, 1 << 16)
        except ArchiveError as e:
            assert e.kind in KINDS


def test_recoverable_phrases():
    assert is_recoverable(ArchiveError("Corrupted", "Could not find EOCD")) and is_recoverable(ArchiveError("UnsupportedFormat", "x"))
    assert not is_recoverable(ArchiveError("Corrupted", "other")) and not is_recoverable(ArchiveError("UnsupportedFormat", "")) and not is_recoverable(ArchiveError("Io", "malformed"))


def test_spanned():
    data = small_zip(3)
    second, end, directory = data.find(b"PK\3\4", 4), data.rfind(b"PK\5\6"), data.find(b"PK\1\2")
    disks = bytearray(data)
    at, origin = directory, [0, second]
    for k in range(3):
        n, x, c = struct.unpack_from("<HHH", disks, at + 28)
        (local,) = struct.unpack_from("<I", disks, at + 42)
        disk = int(local >= second)
        struct.pack_into("<H", disks, at + 34, disk)
        struct.pack_into("<I", disks, at + 42, local - origin[disk])
        at += 46 + n + x + c
    struct.pack_into("<HHHH", disks, end + 4, 1, 1, 3, 3)
    struct.pack_into("<I", disks, end + 16, directory - second)
    volumes = [bytes(disks[:second]), bytes(disks[second:])]
    assert payloads(open_archive(join_spanned(volumes), "x.zip")) == payloads(open_archive(data, "x.zip"))
    assert join_spanned([data[:100], data[100:]]) == data
    with pytest.raises(ArchiveError):
        join_spanned([b"x" * 10])
    assert find_directory(data)[0] == directory


# -- other containers ----------------------------------------------------------------------------


def make_iso(depth=1, shared=False):
    """A minimal image: directories of one record area each, a file in the root."""
    def record(name, sector, size, directory):
        body = struct.pack("<BBIIII", 0, 0, sector, 0, size, 0) + bytes(7) + bytes([2 if directory else 0, 0, 0]) + struct.pack("<HHB", 1, 0, len(name)) + name
        body += bytes(len(body) % 2)
        return bytes([len(body)]) + body[1:]

    sectors = {16: bytearray(2048), 17: bytearray(2048)}
    sectors[16][:8] = b"\x01CD001\x01\x00"
    sectors[17][:7] = b"\xffCD001\x01"
    root = record(b"\0", 18, 2048, True)
    sectors[16][156 : 156 + len(root)] = root
    for d in range(depth):
        here, below = 18 + d, 18 + d + 1
        parts = record(b"\0", here, 2048, True) + record(b"\1", here, 2048, True)
        if d + 1 < depth:
            parts += record(b"A", below, 2048, True) + (record(b"B", below, 2048, True) if shared else b"")
        else:
            parts += record(b"FILE.TXT;1", 18 + depth, 11, False)
        sectors[here] = bytearray(parts.ljust(2048, b"\0"))
    sectors[18 + depth] = bytearray(b"hello world".ljust(2048, b"\0"))
    return b"".join(bytes(sectors.get(k, bytes(2048))) for k in range(19 + depth))


def test_iso():
    a = open_archive(make_iso(), "x.iso")
    assert payloads(a) == {"FILE.TXT": b"hello world"}
    deep = open_archive(make_iso(20, True), "x.iso")
    assert len(deep.entries) == 2 * 19 + 1
    with pytest.raises(ArchiveError):
        open_archive(make_iso(80), "x.iso")
    with pytest.raises(ArchiveError) as e:
        open_archive(bytes(40000), "x.iso")
    assert e.value.kind == "UnsupportedFormat"
    huge = bytearray(make_iso())
    at = huge.find(b"FILE.TXT")
    struct.pack_into("<I", huge, at - 33 + 10, 0xFFFFFFF0)
    assert len(open_archive(bytes(huge), "x.img").read(0)) == 2048


def make_cab(method):
    body = b"cabinet text " * 900
    blocks, out, window = [], b"", b""
    for k in range(0, len(body), 4096):
        piece = body[k : k + 4096]
        if method:
            z = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=window) if window else zlib.compressobj(9, zlib.DEFLATED, -15)
            packed = b"CK" + z.compress(piece) + z.flush()
            window = body[max(0, k + 4096 - 32768) : k + 4096]
        else:
            packed = piece
        sizes = struct.pack("<HH", len(packed), len(piece))
        blocks.append(struct.pack("<I", cab_checksum(packed, cab_checksum(sizes))) + sizes + packed)
    files = b"".join(struct.pack("<IIHHHH", n, o, 0, 0, 0, 0x20) + name + b"\0" for name, o, n in ((b"a.txt", 0, 5000), (b"d\\b.txt", 5000, len(body) - 5000)))
    data_at = 36 + 8 + len(files)
    out = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, data_at + sum(map(len, blocks)), 0, 44, 0, 3, 1, 1, 2, 0, 0, 0) + struct.pack("<IHH", data_at, len(blocks), method) + files
    return out + b"".join(blocks), body


@pytest.mark.parametrize("method", [0, 1])
def test_cab(method):
    data, body = make_cab(method)
    a = open_archive(data, "x.cab")
    assert payloads(a) == {"a.txt": body[:5000], "d\\b.txt": body[5000:]} and a.entries[0].host_os == "Windows"
    with pytest.raises(ArchiveError) as e:
        bad = bytearray(data)
        bad[42] = 3
        open_archive(bytes(bad), "x.cab").read(0)
    assert e.value.kind == "FeatureDisabled"


def test_msi():
    """A compound file with a stream in the mini area and a larger one inside a storage."""
    big, small = b"B" * 5000, b"tiny"
    def node(name, kind, child=0xFFFFFFFF, right=0xFFFFFFFF, start=0, size=0):
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<IQ", start, size)

    fat = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, 0xFFFFFFFE] + [k + 1 for k in range(4, 13)] + [0xFFFFFFFE]
    directory = node("Root Entry", 5, 1, start=3, size=64) + node("dir", 1, 3, 2) + node("small", 2, start=0, size=4) + node("big", 2, start=4, size=5000)
    mini_fat = struct.pack("<128I", 0xFFFFFFFE, *[0xFFFFFFFF] * 127)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIIII", 1, 1, 0, 4096, 2, 1, 0xFFFFFFFE, 0, 0)
    head = head[:44] + struct.pack("<I", 1) + struct.pack("<IIIIIII", 1, 0, 4096, 2, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    sectors = struct.pack(f"<{128}I", *fat, *[0xFFFFFFFF] * (128 - len(fat))), directory, mini_fat, small.ljust(64, b"\0").ljust(512, b"\0"), big.ljust(5120, b"\0")
    a = open_archive(head.ljust(512, b"\0") + b"".join(sectors), "x.msi")
    assert payloads(a) == {"dir/big": big, "small": small}
    assert detect(head, "x.doc") == "Unknown"


def make_deb(extra=0):
    out = b"!<arch>\n"
    for name, body in (("debian-binary", b"2.0\n"), ("control.tar.gz/", b"ctl"), ("data.tar.xz", b"payload!")):
        out += f"{name:<16}{0:<12}{0:<6}{0:<6}{'100644':<8}{len(body) + extra * (name[0] == 'd' and name[1] == 'a'):<10}`\n".encode() + body + b"\n" * (len(body) % 2)
    return out


def test_deb():
    assert payloads(open_archive(make_deb(), "x.deb")) == {"debian-binary": b"2.0\n", "control.tar.gz": b"ctl", "data.tar.xz": b"payload!"}
    a = open_archive(make_deb(100), "x.deb")
    assert len(a.entries) == 3
    with pytest.raises(ArchiveError, match="cut off") as e:
        a.read(2)
    assert e.value.kind == "Corrupted"
    with pytest.raises(ArchiveError):
        open_archive(make_deb()[:40], "x.deb")


def vint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def make_rar5(method=0):
    def block(body, data=b""):
        head = vint(len(body)) + body
        return struct.pack("<I", zlib.crc32(head)) + head + data

    payload = b"stored bytes"
    name = b"d/f.txt"
    file = vint(2) + vint(2) + vint(len(payload)) + vint(6) + vint(len(payload)) + vint(0o100644) + struct.pack("<II", 1_000_000_000, zlib.crc32(payload)) + vint(method << 7) + vint(1) + vint(len(name)) + name
    return b"Rar!\x1a\x07\x01\x00" + block(vint(1) + vint(0) + vint(0)) + block(file, payload) + block(vint(5) + vint(0) + vint(0))


def make_rar4():
    payload, name = b"four", b"x\\y.txt"
    body = struct.pack("<BHH", 0x74, 0x8000, 32 + len(name)) + struct.pack("<IIBIIBBHI", 4, 4, 3, zlib.crc32(payload), 0x27B4_0000 | 0x6000, 29, 0x30, len(name), 0o100644) + name
    main = struct.pack("<BHH", 0x73, 0, 13) + bytes(6)
    return b"Rar!\x1a\x07\x00" + struct.pack("<H", zlib.crc32(main) & 0xFFFF) + main + struct.pack("<H", zlib.crc32(body) & 0xFFFF) + body + payload


def test_rar():
    a = open_archive(make_rar5(), "x.rar")
    assert payloads(a) == {"d/f.txt": b"stored bytes"} and a.entries[0].compressed_size == 0
    assert payloads(open_archive(make_rar4(), "x.rar")) == {"x/y.txt": b"four"}
    with pytest.raises(ArchiveError) as e:
        open_archive(make_rar5(3), "x.rar").read(0)
    assert e.value.kind == "FeatureDisabled"


def test_sevenz_damage():
    data = Wr.write_archive(ITEMS, "SevenZ")
    for at in (0, 8, 12, 40, len(data) - 5):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises(ArchiveError) as e:
            payloads(open_archive(bytes(bad), "x.7z", kind="SevenZ"))
        assert e.value.kind in KINDS


def test_limits_in_containers():
    data = Wr.write_zip([Wr.Item("z", bytes(1 << 22))])
    for opened in (open_strict(data), open_lenient(data)):
        with pytest.raises(ArchiveError) as e:
            opened.read(0, 1000)
        assert e.value.kind == "ZipBombSuspected"
    with pytest.raises(ArchiveError) as e:
        open_archive(data, "x.zip").index_of("nope")
    assert e.value.kind == "EntryNotFound"
