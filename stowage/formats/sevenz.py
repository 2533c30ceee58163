"""7z: the property tree of the header, blocks decoded by the standard library's filters, AES-256; a writer of plain blocks."""

from __future__ import annotations

import bz2
import lzma
import os
import struct
import zlib

from stowage.errors import ArchiveError
from stowage.formats import aes
from stowage.formats.model import Archive, Entry, file_time, need
from stowage.formats.ranged import unpack_at

MAGIC = b"7z\xbc\xaf\x27\x1c"
AES = bytes.fromhex("06f10701")
# Property ids of the header.
HEADER, ADDITIONAL, MAIN_STREAMS, FILES, PACK, UNPACK, SUBSTREAMS, SIZE, CRC, FOLDER, CODER_SIZES, NUM_STREAMS = 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13
EMPTY_STREAM, EMPTY_FILE, ANTI, NAMES, CTIME, ATIME, MTIME, ATTRIBUTES, ENCODED, DUMMY = 14, 15, 16, 17, 18, 19, 20, 21, 23, 25
# Coder ids that can be undone here.
BRANCHES = {"03030103": lzma.FILTER_X86, "03030205": lzma.FILTER_POWERPC, "03030401": lzma.FILTER_IA64, "03030501": lzma.FILTER_ARM, "03030701": lzma.FILTER_ARMTHUMB, "03030805": lzma.FILTER_SPARC}


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        need(len(out) == n, "7z header cut off", "BackendError")
        self.at += n
        return out

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """Leading ones of the first byte say how many bytes follow; its other bits are the highest."""
        first, value, mask = self.byte(), 0, 0x80
        for k in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << 8 * k
            value |= self.byte() << 8 * k
            mask >>= 1
        return value

    def count(self) -> int:
        n = self.number()
        need(n <= 50_000_000, "7z: count too large", "BackendError")
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.take(-(-n // 8))
        return [bool(raw[k // 8] & 0x80 >> k % 8) for k in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def crcs(self, n: int) -> list[int | None]:
        return [struct.unpack("<I", self.take(4))[0] if d else None for d in self.defined(n)]


class Folder:
    """Coders of a block, how their streams are bound, sizes and CRC."""

    def __init__(self, r: Reader):
        self.coders, ins, outs = [], 0, 0
        for _ in range(r.count()):
            flags = r.byte()
            need(not flags & 0xC0, "7z: coder flags", "BackendError")
            method = r.take(flags & 15)
            n_in, n_out = (r.count(), r.count()) if flags & 16 else (1, 1)
            self.coders.append((method, n_in, n_out, r.take(r.count()) if flags & 32 else b""))
            ins, outs = ins + n_in, outs + n_out
        need(outs > 0, "7z: no coders", "BackendError")
        self.binds = {r.count(): r.count() for _ in range(outs - 1)}
        packed = ins - (outs - 1)
        self.packed = [k for k in range(ins) if k not in self.binds][:1] if packed == 1 else [r.count() for _ in range(packed)]
        self.outs, self.sizes, self.crc = outs, [], None
        free = [k for k in range(outs) if k not in self.binds.values()]
        need(bool(free), "7z: coders in a ring", "BackendError")
        self.main = free[0]

    @property
    def encrypted(self) -> bool:
        return any(m == AES for m, *_ in self.coders)

    def decode(self, streams: list[bytes], password: str | None, limit: int) -> bytes:
        need(all(i == o == 1 for _, i, o, _ in self.coders), "7z: coder with several streams", "FeatureDisabled")

        def output(k: int, depth: int = 0) -> bytes:
            need(depth < 32, "7z: coders in a ring", "BackendError")
            source = output(self.binds[k], depth + 1) if k in self.binds else streams[self.packed.index(k)]
            need(self.sizes[k] <= limit, f"more than {limit} bytes", "ZipBombSuspected")
            return undo(self.coders[k][0], self.coders[k][3], source, self.sizes[k], password)

        out = output(self.main)
        if self.crc is not None and zlib.crc32(out) != self.crc:
            raise ArchiveError("WrongPassword", "checksum differs")
        return out


def undo(method: bytes, props: bytes, data: bytes, size: int, password: str | None) -> bytes:
    name = method.hex()
    try:
        if name == "00":
            return data[:size]
        if name == "21":
            filters = [{"id": lzma.FILTER_LZMA2, "dict_size": lzma2_dictionary(props[0])}]
        elif name == "030101":
            p = props[0]
            filters = [{"id": lzma.FILTER_LZMA1, "lc": p % 9, "lp": p // 9 % 5, "pb": p // 45, "dict_size": max(4096, struct.unpack_from("<I", props, 1)[0])}]
        elif name == "03":
            filters = None
            dist, out = (props[0] if props else 0) + 1, bytearray(data[:size])
            for k in range(dist, len(out)):
                out[k] = (out[k] + out[k - dist]) & 255
            return bytes(out)
        elif name in BRANCHES:
            # a branch filter stands before a compressor; stored chunks of LZMA2 carry the data to it
            return lzma.decompress(stored_lzma2(data), lzma.FORMAT_RAW, filters=[{"id": BRANCHES[name]}, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])[:size]
        elif name == "040108":
            return zlib.decompressobj(-15).decompress(data, size + 1)[:size]
        elif name == "040202":
            return bz2.decompress(data)[:size]
        elif method == AES:
            if not password:
                raise ArchiveError("WrongPassword", "password needed")
            power, first = props[0] & 0x3F, props[0]
            salt_n, iv_n = (first >> 7 & 1) + (props[1] >> 4), (first >> 6 & 1) + (props[1] & 15) if len(props) > 1 else 0
            need(power <= 24 or power == 0x3F, "7z: key rounds", "FeatureDisabled")
            salt, iv = props[2 : 2 + salt_n], props[2 + salt_n : 2 + salt_n + iv_n]
            return aes.cbc_decrypt(data, aes.sevenz_key(password, salt, power), iv.ljust(16, b"\0"))[:size]
        else:
            raise ArchiveError("FeatureDisabled", f"7z coder {name}")
        d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters)
        out = d.decompress(data, size) if size else b""
        need(len(out) == size, "7z block ends early", "Corrupted")
        return out
    except (lzma.LZMAError, zlib.error, OSError, ValueError, IndexError, struct.error, EOFError) as e:
        kind = "WrongPassword" if password else "BackendError"
        raise ArchiveError(kind, f"7z: {e}") from e


def lzma2_dictionary(bits: int) -> int:
    need(bits <= 40, "7z: dictionary", "BackendError")
    return 0xFFFFFFFF if bits == 40 else (2 | bits & 1) << (bits // 2 + 11)


def stored_lzma2(data: bytes) -> bytes:
    """Bytes as stored chunks of an LZMA2 stream."""
    out = bytearray()
    for k in range(0, len(data), 1 << 16):
        piece = data[k : k + (1 << 16)]
        out += bytes([1 if k == 0 else 2]) + struct.pack(">H", len(piece) - 1) + piece
    return bytes(out) + b"\0"


def _streams(r: Reader) -> tuple[int, list[int], list[Folder], list[list[tuple[int, int | None]]]]:
    """Where packed streams begin, their sizes, the blocks, and the files' sizes and CRCs in each."""
    start, packs, folders, subs = 0, [], [], None
    kind = r.byte()
    if kind == PACK:
        start, n = r.number(), r.count()
        while (kind := r.byte()) != 0:
            if kind == SIZE:
                packs = [r.number() for _ in range(n)]
            elif kind == CRC:
                r.crcs(n)
            else:
                raise ArchiveError("BackendError", f"7z property {kind}")
        kind = r.byte()
    if kind == UNPACK:
        need(r.byte() == FOLDER, "7z: no blocks", "BackendError")
        n = r.count()
        need(r.byte() == 0, "7z: external blocks", "FeatureDisabled")
        folders = [Folder(r) for _ in range(n)]
        need(r.byte() == CODER_SIZES, "7z: no sizes", "BackendError")
        for f in folders:
            f.sizes = [r.number() for _ in range(f.outs)]
        while (kind := r.byte()) != 0:
            need(kind == CRC, f"7z property {kind}", "BackendError")
            for f, c in zip(folders, r.crcs(n), strict=True):
                f.crc = c
        kind = r.byte()
    counts = [1] * len(folders)
    if kind == SUBSTREAMS:
        kind = r.byte()
        if kind == NUM_STREAMS:
            counts, kind = [r.count() for _ in folders], r.byte()
        sizes = []
        for f, n in zip(folders, counts, strict=True):
            own = [r.number() for _ in range(n - 1)] if kind == SIZE and n else []
            sizes.append([*own, f.sizes[f.main] - sum(own)] if n else [])
        if kind == SIZE:
            kind = r.byte()
        unknown = sum(n for f, n in zip(folders, counts, strict=True) if not (n == 1 and f.crc is not None))
        found: list[int | None] = [None] * unknown
        while kind != 0:
            if kind == CRC:
                found = r.crcs(unknown)
            kind = r.byte()
        it = iter(found)
        subs = [[(s, f.crc if n == 1 and f.crc is not None else next(it)) for s in own] for f, n, own in zip(folders, counts, sizes, strict=True)]
        kind = r.byte()
    if subs is None:
        subs = [[(f.sizes[f.main], f.crc)] for f in folders]
    return start, packs, folders, subs


def open_sevenz(data: bytes, password: str | None = None) -> Archive:
    need(data[:6] == MAGIC and len(data) >= 32, "7z: no signature", "BackendError")
    need(zlib.crc32(data[12:32]) == unpack_at("<I", data, 8)[0], "7z: start header checksum", "BackendError")
    offset, size, crc = unpack_at("<QQI", data, 12)
    header = data[32 + offset : 32 + offset + size]
    need(len(header) == size and zlib.crc32(header) == crc, "7z: header checksum", "BackendError")
    if not size:
        return Archive("SevenZ", "7z", [], lambda k, limit: b"")
    r = Reader(header)
    kind = r.byte()
    for _ in range(4):
        if kind != ENCODED:
            break
        start, packs, folders, _ = _streams(r)
        need(len(folders) == 1 and bool(packs), "7z: packed header", "BackendError")
        r = Reader(folders[0].decode([data[32 + start : 32 + start + packs[0]]], password, 1 << 30))
        kind = r.byte()
    need(kind == HEADER, "7z: no header", "BackendError")
    start, packs, folders, subs, entries, owner = 0, [], [], [], [], []
    kind = r.byte()
    if kind == ADDITIONAL:
        raise ArchiveError("FeatureDisabled", "7z: additional streams")
    if kind == MAIN_STREAMS:
        start, packs, folders, subs = _streams(r)
        kind = r.byte()
    if kind == FILES:
        n = r.count()
        names, empty, folders_flag, times, attributes = [""] * n, [False] * n, [], [None] * n, [None] * n
        while (kind := r.number()) != 0:
            body = Reader(r.take(r.number()))
            if kind == NAMES:
                need(body.byte() == 0, "7z: external names", "FeatureDisabled")
                names = body.data[1:].decode("utf-16-le", "replace").split("\0")[:n]
                need(len(names) == n, "7z: names", "BackendError")
            elif kind == EMPTY_STREAM:
                empty = body.bits(n)
            elif kind == EMPTY_FILE:
                folders_flag = body.bits(sum(empty))
            elif kind in (MTIME, ATTRIBUTES):
                there = body.defined(n)
                need(body.byte() == 0, "7z: external values", "FeatureDisabled")
                values = [struct.unpack("<Q" if kind == MTIME else "<I", body.take(8 if kind == MTIME else 4))[0] if d else None for d in there]
                times, attributes = (values, attributes) if kind == MTIME else (times, values)
        slots = [(f, k) for f, own in enumerate(subs) for k in range(len(own))]
        at, nth_empty = 0, 0
        for k in range(n):
            if empty[k]:
                is_file = folders_flag[nth_empty] if nth_empty < len(folders_flag) else False
                nth_empty += 1
                entries.append(Entry(names[k], not is_file, compression="Lzma2", modified=file_time(times[k]) if times[k] is not None else None))
                owner.append(None)
                continue
            need(at < len(slots), "7z: more files than streams", "BackendError")
            f, j = slots[at]
            at += 1
            size_, crc_ = subs[f][j]
            packed = sum(packs[sum(len(g.packed) for g in folders[:f]) :][: len(folders[f].packed)]) if j == 0 else 0
            entries.append(Entry(names[k], False, False, size_, packed, "Lzma2", "Aes256" if folders[f].encrypted else "None", crc_, file_time(times[k]) if times[k] is not None else None))
            owner.append((f, j))
    origins, where, pack_index = [], 32 + start, 0
    for f in folders:
        own = packs[pack_index : pack_index + len(f.packed)]
        pack_index += len(own)
        origins.append([])
        for p in own:
            origins[-1].append((where, p))
            where += p
    last: dict[int, bytes] = {}

    def read(k: int, limit: int) -> bytes:
        if owner[k] is None:
            return b""
        f, j = owner[k]
        need(subs[f][j][0] <= limit, f"more than {limit} bytes", "ZipBombSuspected")
        if f not in last:  # one block is kept: files are mostly read in order
            last.clear()
            last[f] = folders[f].decode([data[a : a + p] for a, p in origins[f]], password, max(limit, 1 << 30))
        begin = sum(s for s, _ in subs[f][:j])
        out = last[f][begin : begin + subs[f][j][0]]
        if entries[k].crc32 is not None and zlib.crc32(out) != entries[k].crc32:
            raise ArchiveError("WrongPassword", "checksum differs")
        return out

    return Archive("SevenZ", "7z", entries, read)


# -- writing -------------------------------------------------------------------------------------


def _number(n: int) -> bytes:
    for k in range(8):
        if n < 1 << 7 * (k + 1):
            return bytes([(0xFF00 >> k) & 0xFF | n >> 8 * k]) + (n & ((1 << 8 * k) - 1)).to_bytes(k, "little")
    return b"\xff" + n.to_bytes(8, "little")


def write_sevenz(files: list[tuple[str, bytes | None, int]], password: str | None = None, level: int = 1, power: int = 16) -> bytes:
    """An archive of ``(name, payload or None for a directory, Unix seconds)``: one LZMA2 block a file, header plain.

    With a password each block is encrypted, and so is the header.
    """
    filters = [{"id": lzma.FILTER_LZMA2, "preset": level}]
    dictionary = next(b for b in range(41) if lzma2_dictionary(b) >= (1 << 20 if level < 2 else 8 << 20))

    def sealed(payloads: list[bytes]) -> list[tuple[bytes, bytes, list[int]]]:
        """Each payload's block, its coders, and the sizes between them."""
        packed = [lzma.compress(p, lzma.FORMAT_RAW, filters=filters) for p in payloads]
        coder = b"\x21\x21\x01" + bytes([dictionary])
        if not password:
            return [(b, b"\x01" + coder, [len(p)]) for b, p in zip(packed, payloads, strict=True)]
        ivs = [os.urandom(16) for _ in packed]
        shut = aes.cbc_encrypt_many(packed, aes.sevenz_key(password, b"", power), ivs)
        lock = b"\x24" + AES + b"\x12" + bytes([power | 0x40, 0x0F])
        return [(c, b"\x02" + coder + lock + iv + b"\x00\x01", [len(p), len(b)]) for c, b, p, iv in zip(shut, packed, payloads, ivs, strict=True)]

    full = [(n, p, t) for n, p, t in files if p]
    made = sealed([p for _, p, _ in full])

    def streams(start: int, blocks, crcs: list[int]) -> bytes:
        out = bytes([PACK]) + _number(start) + _number(len(blocks)) + bytes([SIZE]) + b"".join(_number(len(b[0])) for b in blocks) + b"\0"
        out += bytes([UNPACK, FOLDER]) + _number(len(blocks)) + b"\0" + b"".join(b[1] for b in blocks) + bytes([CODER_SIZES]) + b"".join(_number(s) for b in blocks for s in b[2])
        return out + bytes([CRC, 1]) + b"".join(struct.pack("<I", c) for c in crcs) + b"\0\0"

    header = bytes([HEADER])
    if made:
        header += bytes([MAIN_STREAMS]) + streams(0, made, [zlib.crc32(p) for _, p, _ in full])
    bits = lambda flags: b"".join(bytes([sum(0x80 >> j for j, f in enumerate(flags[k : k + 8]) if f)]) for k in range(0, len(flags), 8))
    prop = lambda kind, body: bytes([kind]) + _number(len(body)) + body
    if files:
        header += bytes([FILES]) + _number(len(files))
        empty = [not p for _, p, _ in files]
        if any(empty):
            header += prop(EMPTY_STREAM, bits(empty)) + prop(EMPTY_FILE, bits([p is not None for _, p, _ in files if not p]))
        header += prop(NAMES, b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _, _ in files))
        header += prop(MTIME, b"\1\0" + b"".join(struct.pack("<Q", (t + 11_644_473_600) * 10_000_000) for _, _, t in files)) + b"\0"
    header += b"\0"
    packed = b"".join(b[0] for b in made)
    if password:
        own = sealed([header])
        header = bytes([ENCODED]) + streams(len(packed), own, [zlib.crc32(header)])
        packed += own[0][0]
    head = struct.pack("<QQI", len(packed), len(header), zlib.crc32(header))
    return MAGIC + b"\0\4" + struct.pack("<I", zlib.crc32(head)) + head + packed + header
