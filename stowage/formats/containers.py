"""Containers without compression of their own or with little: ISO images, cabinets, compound files, ar packages."""

from __future__ import annotations

import struct
import zlib

from stowage.errors import ArchiveError
from stowage.formats.model import READ_LIMIT, Archive, Entry, need

# -- ISO 9660, Joliet, Rock Ridge ----------------------------------------------------------------

SECTOR, MOST_DEPTH, MOST_ENTRIES = 2048, 64, 1_000_000
JOLIET = (b"%/@", b"%/C", b"%/E")


def _rock_ridge(area: bytes) -> str | None:
    """The alternate name in a record's system area."""
    at, name = 0, b""
    found = False
    while at + 4 <= len(area) and area[at + 2] >= 4:
        if area[at : at + 2] == b"NM":
            name, found = name + area[at + 5 : at + area[at + 2]], True
        at += area[at + 2]
    return name.decode("utf-8", "replace") if found else None


def open_iso(data: bytes) -> Archive:
    """Depth first from the root of the best volume; a directory extent is walked once, however often it is named."""
    volumes, at = [], 16 * SECTOR
    while data[at + 1 : at + 6] == b"CD001" and data[at] != 255:
        volumes.append((data[at], data[at : at + SECTOR]))
        at += SECTOR
    need(any(t == 1 for t, _ in volumes), "no ISO 9660 volume descriptor", "UnsupportedFormat")
    primary = next(v for t, v in volumes if t == 1)
    joliet = next((v for t, v in volumes if t == 2 and v[88:91] in JOLIET), None)
    root = primary[156:190]
    children = lambda record: _iso_records(data, record)
    rocky = any(_rock_ridge(r[3]) is not None for r in children(struct.unpack_from("<I", root, 2) + struct.unpack_from("<I", root, 10)))
    if joliet is not None and not rocky:
        root = joliet[156:190]
    wide = joliet is not None and not rocky
    entries, places, seen = [], [], set()
    # a stack of iterators, so that depth costs no recursion
    stack = [("", iter(children(struct.unpack_from("<I", root, 2) + struct.unpack_from("<I", root, 10))))]
    seen.add(struct.unpack_from("<I", root, 2)[0])
    while stack:
        prefix, rest = stack[-1]
        record = next(rest, None)
        if record is None:
            stack.pop()
            continue
        where, flags, raw, area = record
        if raw in (b"\0", b"\1"):
            continue
        name = _rock_ridge(area)
        if name is None:
            name = raw.decode("utf-16-be", "replace") if wide else raw.decode("utf-8", "replace")
            name = name.split(";")[0].rstrip(".") or name
        path = f"{prefix}/{name}" if prefix else name
        need(len(entries) <= MOST_ENTRIES, "too many entries", "BackendError")
        entries.append(Entry(path, bool(flags & 2), uncompressed_size=where[1], compressed_size=where[1]))
        places.append(where)
        if flags & 2 and where[0] not in seen:
            need(len(stack) <= MOST_DEPTH, "directories too deep", "BackendError")
            seen.add(where[0])
            stack.append((path, iter(children(where))))

    def read(k: int, limit: int) -> bytes:
        sector, size = places[k]
        size = 0 if entries[k].is_directory else min(size, max(0, len(data) // SECTOR - sector) * SECTOR)
        if size > limit:
            raise ArchiveError("ZipBombSuspected", f"more than {limit} bytes")
        return data[sector * SECTOR : sector * SECTOR + size]

    return Archive("Iso", "iso", entries, read)


def _iso_records(data: bytes, where: tuple[int, int]) -> list[tuple[tuple[int, int], int, bytes, bytes]]:
    """Records of a directory: extent, flags, name, system area."""
    out, at = [], where[0] * SECTOR
    end = min(at + where[1], len(data))
    while at < end:
        n = data[at]
        if n == 0:  # records do not cross sectors
            at = (at // SECTOR + 1) * SECTOR
            continue
        if n < 34 or at + n > end or 33 + data[at + 32] > n:
            raise ArchiveError("BackendError", "invalid directory record")
        name = data[at + 33 : at + 33 + data[at + 32]]
        area = data[at + 33 + len(name) + (len(name) % 2 == 0) : at + n]
        out.append(((struct.unpack_from("<I", data, at + 2)[0], struct.unpack_from("<I", data, at + 10)[0]), data[at + 25], name, area))
        at += n
    return out


# -- cabinets ------------------------------------------------------------------------------------


def open_cab(data: bytes) -> Archive:
    """Stored and MSZIP folders; others can be listed."""
    need(data[:4] == b"MSCF" and len(data) >= 36, "cab: no signature", "UnsupportedFormat")
    files_at, folders, files, flags = struct.unpack_from("<I", data, 16)[0], *struct.unpack_from("<HHH", data, 26)
    at, per_folder, per_data = 36, 0, 0
    try:
        if flags & 4:
            header, per_folder, per_data = struct.unpack_from("<HBB", data, at)
            at += 4 + header
        for _ in range(2 * (bool(flags & 1) + bool(flags & 2))):
            at = data.index(0, at) + 1
        spans = []
        for _ in range(folders):
            spans.append(struct.unpack_from("<IHH", data, at))
            at += 8 + per_folder
        entries, places, at = [], [], files_at
        for _ in range(files):
            size, offset, folder, date, time, attributes = struct.unpack_from("<IIHHHH", data, at)
            end = data.index(0, at + 16)
            name = data[at + 16 : end].decode("utf-8" if attributes & 0x80 else "cp1252", "replace")
            entries.append(Entry(name, uncompressed_size=size, compressed_size=size, host_os="Windows"))
            places.append((folder, offset, size))
            at = end + 1
    except (struct.error, ValueError) as e:
        raise ArchiveError("BackendError", f"cab: {e}") from e
    done: dict[int, bytes] = {}

    def unpacked(folder: int, limit: int) -> bytes:
        need(folder < len(spans), "cab: folder continued in another cabinet", "FeatureDisabled")
        start, blocks, method = spans[folder]
        need(method & 15 in (0, 1), f"cab method {method & 15}", "FeatureDisabled")
        out, at, window = bytearray(), start, b""
        for _ in range(blocks):
            if len(out) >= limit:  # what the entry needs lies before
                break
            check, packed, size = struct.unpack_from("<IHH", data, at)
            block = data[at + 8 + per_data : at + 8 + per_data + packed]
            need(len(block) == packed, "cab block cut off", "BackendError")
            need(not check or check == cab_checksum(block, cab_checksum(data[at + 4 : at + 8 + per_data])), "cab block checksum", "BackendError")
            if method & 15:
                need(block[:2] == b"CK", "cab block signature", "BackendError")
                d = zlib.decompressobj(-15, zdict=window) if window else zlib.decompressobj(-15)
                try:
                    block = d.decompress(block[2:], size + 1)
                except zlib.error as e:
                    raise ArchiveError("BackendError", f"cab: {e}") from e
            need(len(block) == size, "cab block size", "BackendError")
            out += block
            window = bytes(out[-32768:])
            at += 8 + per_data + packed
        return bytes(out)

    def read(k: int, limit: int) -> bytes:
        folder, offset, size = places[k]
        if size > limit:
            raise ArchiveError("ZipBombSuspected", f"more than {limit} bytes")
        if folder not in done or len(done[folder]) < offset + size:
            if offset + size > READ_LIMIT:
                raise ArchiveError("ZipBombSuspected", f"more than {READ_LIMIT} bytes up to the entry's end")
            done[folder] = unpacked(folder, offset + size)
        out = done[folder][offset : offset + size]
        need(len(out) == size, "cab folder too short", "BackendError")
        return out

    return Archive("Cab", "cab", entries, read)


def cab_checksum(block: bytes, seed: int = 0) -> int:
    """XOR of little-endian words; the odd bytes at the end count high byte first."""
    whole = len(block) // 4 * 4
    for (w,) in struct.iter_unpack("<I", block[:whole]):
        seed ^= w
    return seed ^ int.from_bytes(block[whole:], "big")


# -- compound files ------------------------------------------------------------------------------

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


def open_msi(data: bytes) -> Archive:
    """Storages and streams of a compound file, names as they are stored."""
    need(data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" and len(data) >= 512, "no compound file", "BackendError")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    need(shift in (9, 12) and mini_shift == 6, "compound file: sector size", "BackendError")
    size, per = 1 << shift, (1 << shift) // 4
    first_dir, _, cutoff, first_mini, mini_count, first_more, more_count = struct.unpack_from("<IIIIIII", data, 48)
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    try:
        tables = [t for t in struct.unpack_from("<109I", data, 76) if t < END - 3]
        for _ in range(min(more_count, len(data) // size + 1)):
            more = struct.unpack(f"<{per}I", sector(first_more))
            tables += [t for t in more[:-1] if t < END - 3]
            first_more = more[-1]
        fat = [x for t in tables for x in struct.unpack(f"<{per}I", sector(t))]
    except struct.error as e:
        raise ArchiveError("BackendError", f"compound file: {e}") from e

    def chain(k: int, table: list[int]) -> list[int]:
        out, seen = [], set()
        while k < END - 3:
            need(k < len(table) and k not in seen, "compound file: broken chain", "BackendError")
            seen.add(k)
            out.append(k)
            k = table[k]
        return out

    directory = b"".join(sector(k) for k in chain(first_dir, fat))
    mini_fat = [x for k in chain(first_mini, fat) for x in struct.unpack(f"<{per}I", sector(k))] if mini_count else []
    nodes = []
    for at in range(0, len(directory) - 127, 128):
        n, kind = struct.unpack_from("<HB", directory, at + 64)
        left, right, child = struct.unpack_from("<III", directory, at + 68)
        start, length = struct.unpack_from("<IQ", directory, at + 116)
        name = directory[at : at + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
        nodes.append((name, kind, left, right, child, start, length & (0xFFFFFFFF if shift == 9 else 2**63 - 1)))
    need(bool(nodes) and nodes[0][1] == 5, "compound file: no root", "BackendError")
    mini = b"".join(sector(k) for k in chain(nodes[0][5], fat)) if nodes[0][6] else b""
    entries, places = [], []
    stack, seen = [(nodes[0][4], "")], set()
    while stack:  # siblings in order of their tree, a storage before what it holds
        k, prefix = stack.pop()
        if isinstance(k, tuple):
            name, kind, _, _, child, start, length = nodes[k[0]]
            path = f"{prefix}/{name}" if prefix else name
            entries.append(Entry(path.replace("\\", "/").lstrip("/"), kind == 1, uncompressed_size=length if kind == 2 else 0, compressed_size=length if kind == 2 else 0, host_os="Windows"))
            places.append((start, length, kind))
            if kind == 1:
                stack.append((child, path))
            continue
        if k >= len(nodes) or k in seen:
            continue
        seen.add(k)
        stack += [(nodes[k][3], prefix), ((k,), prefix), (nodes[k][2], prefix)]

    def read(k: int, limit: int) -> bytes:
        start, length, kind = places[k]
        if kind != 2 or not length:
            return b""
        if length > limit:
            raise ArchiveError("ZipBombSuspected", f"more than {limit} bytes")
        out = b"".join(mini[64 * s : 64 * s + 64] for s in chain(start, mini_fat)) if length < cutoff else b"".join(sector(s) for s in chain(start, fat))
        need(len(out) >= length, "stream cut off", "BackendError")
        return out[:length]

    return Archive("Msi", "msi", entries, read)


# -- Debian packages -----------------------------------------------------------------------------


def open_deb(data: bytes) -> Archive:
    """Members of the ar archive; a member that states more bytes than there are is listed, and fails when read."""
    need(data[:8] == b"!<arch>\n", "no ar magic", "UnsupportedFormat")
    entries, places, at = [], [], 8
    need(at == len(data) or at + 60 <= len(data), "ar header cut off", "BackendError")
    while at + 60 <= len(data):
        header = data[at : at + 60]
        need(header[58:] == b"`\n", "ar header without end mark", "BackendError")
        try:
            size = int(header[48:58].decode("ascii").strip())
            need(size >= 0, "ar size", "BackendError")
        except ValueError as e:
            raise ArchiveError("BackendError", "ar size") from e
        name = header[:16].rstrip(b" \0")
        name = name[:-1] if name.endswith(b"/") else name
        entries.append(Entry(name.decode("utf-8", "replace"), uncompressed_size=size, compressed_size=size, host_os="Unix"))
        places.append((at + 60, size))
        at += 60 + size + size % 2
    def read(k: int, limit: int) -> bytes:
        start, size = places[k]
        if size > limit:
            raise ArchiveError("ZipBombSuspected", f"more than {limit} bytes")
        out = data[start : start + size]
        need(len(out) == size, f"member cut off: {len(out)} of {size} bytes", entry=entries[k].path)
        return out

    return Archive("Deb", "deb", entries, read)
