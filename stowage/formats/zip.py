"""ZIP: a strict reader with random access, a tolerant one for damaged files, and spanned sets.

The strict reader refuses what is not in order; a refusal that speaks of damage is retried tolerantly.
"""

from __future__ import annotations

import struct
import zipfile
import zlib

from stowage.errors import ArchiveError
from stowage.formats import aes
from stowage.formats.model import UTC, Archive, Entry, dos_time, need
from stowage.formats.ranged import as_file, unpack_at

EOCD, LOCATOR, EOCD64, CDFH, LFH = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"
PREFLIGHT, TAIL, SCAN = 96, 65_557, 64 << 20
INFLATE_LIMIT = 4 << 30
# Phrases in the reason of a refusal that make it worth a tolerant retry.
RECOVERABLE = (
    "invalid cdfh offset", "could not find central directory", "could not find eocd", "invalid zip archive", "invalid signature",
    "invalid local header", "data descriptor", "malformed", "deadline exceeded", "sanity check failed",
)
METHODS = {0: "Store", 8: "Deflate", 9: "Deflate64", 12: "Bzip2", 14: "Lzma", 93: "Zstd", 98: "Ppmd"}
UNREADABLE = -1
#: A link target of more bytes is none.
LINK_BYTES = 4096


def is_recoverable(e: ArchiveError) -> bool:
    return e.kind == "Corrupted" and any(p in e.message.lower() for p in RECOVERABLE) or e.kind == "UnsupportedFormat" and bool(e.message)


def preflight(data: bytes) -> None:
    """Looks at the last bytes only: an end record must be there, and the directory must end inside the file."""
    tail = data[-PREFLIGHT:]
    at = tail.rfind(EOCD)
    need(at >= 0 and len(tail) - at >= 22, "sanity check failed: could not find EOCD")
    size, offset = struct.unpack_from("<II", tail, at + 12)
    if 0xFFFFFFFF in (size, offset):
        loc = at - 20
        need(loc >= 0 and tail[loc : loc + 4] == LOCATOR, "sanity check failed: no ZIP64 locator")
        (where,) = struct.unpack_from("<Q", tail, loc + 8)
        need(data[where : where + 4] == EOCD64 and len(data) >= where + 56, "sanity check failed: no ZIP64 end record")
        size, offset = unpack_at("<QQ", data, where + 40)
    need(offset + size <= len(data), "sanity check failed: directory ends behind the file")


def _mode(info: zipfile.ZipInfo) -> int | None:
    """The Unix mode that an entry states (Unix hosts) or implies (DOS attributes)."""
    external = info.external_attr
    if not external:
        return None
    if info.create_system == 3:
        return external >> 16
    if info.create_system == 0:
        mode = 0o040775 if external & 0x10 else 0o100664
        return mode & 0o170555 if external & 1 else mode
    return None


def _strict_entry(info: zipfile.ZipInfo) -> Entry:
    mode = _mode(info)
    raw = info.date_time
    return Entry(
        info.orig_filename, info.orig_filename.endswith(("/", "\\")), mode is not None and mode & 0o170000 == 0o120000, info.file_size, info.compress_size,
        {0: "Store", 8: "Deflate"}.get(info.compress_type, "Unknown"), "ZipCrypto" if info.flag_bits & 1 else "None", info.CRC,
        dos_time((raw[0] - 1980) << 9 | raw[1] << 5 | raw[2], raw[3] << 11 | raw[4] << 5 | raw[5] // 2), mode or 0,
        info.comment.decode("utf-8" if info.flag_bits & 0x800 else "cp437", "replace") or None,
    )


def inflate(data: bytes, limit: int) -> bytes:
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data, max(1, min(limit, INFLATE_LIMIT) + 1))
    except zlib.error as e:
        raise ArchiveError("Corrupted", f"deflate: {e}") from e
    need(d.eof or len(out) > limit, "deflate data ends early")
    return out


def _aes_payload(data: bytes, info: zipfile.ZipInfo, password: str | None, limit: int) -> bytes:
    extra, at, found = info.extra, 0, None
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 0x9901:
            found = struct.unpack_from("<H2sBH", extra, at + 4)
        at += 4 + n
    need(found is not None, "AES entry without its extra field")
    version, _, strength, method = found
    if not password:
        raise ArchiveError("WrongPassword", "password needed")
    name, extra_len = unpack_at("<HH", data, info.header_offset + 26)
    start = info.header_offset + 30 + name + extra_len
    raw = data[start : start + info.compress_size]
    salt = 4 * strength + 4
    key, mac, check = aes.zip_keys(password, raw[:salt], 64 + 64 * strength)
    if raw[salt : salt + 2] != check:
        raise ArchiveError("WrongPassword", "wrong password")
    body = raw[salt + 2 : -10]
    need(aes.zip_tag(mac, body) == raw[-10:], "authentication failed")
    plain = aes.ctr_little(body, key)
    if method == 0:
        out = plain
    elif method == 8:
        out = inflate(plain, limit)
    else:
        raise ArchiveError("FeatureDisabled", f"method {method} in an encrypted entry")
    need(version != 1 or zlib.crc32(out) == info.CRC, "CRC differs")
    return out


def open_strict(data: bytes, password: str | None = None, kind: str = "Zip") -> Archive:
    preflight(data)
    try:
        z = zipfile.ZipFile(as_file(data))
    except (zipfile.BadZipFile, struct.error, OverflowError, ValueError, IndexError, UnicodeDecodeError) as e:
        raise ArchiveError("Corrupted", f"invalid Zip archive: {e}") from e
    except NotImplementedError as e:
        raise ArchiveError("UnsupportedFormat", str(e)) from e
    infos = z.infolist()
    stated = unpack_at("<H", data, data.rfind(EOCD) + 10)[0]
    need(stated == 0xFFFF or stated == len(infos) & 0xFFFF, "invalid Zip archive: another number of entries")

    def read(k: int, limit: int) -> bytes:
        info = infos[k]
        if info.is_dir():
            return b""
        if info.compress_type == 99:
            return _aes_payload(data, info, password, limit)
        if info.flag_bits & 1 and not password:
            raise ArchiveError("WrongPassword", "password needed")
        try:
            with z.open(info, pwd=password.encode() if password else None) as f:
                return f.read(limit + 1)
        except RuntimeError as e:
            raise ArchiveError("WrongPassword", str(e)) from e
        except NotImplementedError as e:
            raise ArchiveError("FeatureDisabled", str(e)) from e
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, struct.error, UnicodeDecodeError) as e:
            if info.flag_bits & 1 and isinstance(e, (zlib.error, zipfile.BadZipFile)) and info.compress_size == 0:
                raise ArchiveError("WrongPassword", str(e)) from e
            raise ArchiveError("Corrupted", f"{e}") from e

    entries = [_strict_entry(i) for i in infos]
    for e, i in zip(entries, infos, strict=True):
        if i.compress_type == 99:
            e.compression = "Unknown"
    return Archive(kind, "zip", entries, read)


# -- tolerant reading ----------------------------------------------------------------------------


def _first_record(data: bytes, end: int) -> int:
    """The first directory record in the stretch before the end record."""
    at = data.find(CDFH, max(0, end - SCAN), end)
    need(at >= 0, "no directory record before the end record")
    return at


def _is_record(data: bytes, at: int) -> bool:
    return data[at : at + 4] == CDFH


def find_directory(data: bytes) -> tuple[int, int]:
    """Where the central directory lies, start and length; stated values that cannot be right are replaced."""
    end = data.rfind(EOCD, max(0, len(data) - TAIL))
    need(end >= 0, "no end record in the tail")
    need(end + 22 <= len(data), "end record cut off")
    count, size, offset = unpack_at("<HII", data, end + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (size, offset):
        loc = end - 20
        need(loc >= 0, "no room for a ZIP64 locator")
        if data[loc : loc + 4] != LOCATOR:
            start = offset if offset != 0xFFFFFFFF and offset < end and _is_record(data, offset) else _first_record(data, end)
            return start, end - start
        (where,) = unpack_at("<Q", data, loc + 8)
        need(where < len(data), "ZIP64 end record behind the file")
        need(data[where : where + 4] == EOCD64 and where + 56 <= len(data), "no ZIP64 end record at its place")
        size, offset = unpack_at("<QQ", data, where + 40)
        need(offset <= len(data), "ZIP64 directory behind the file")
        room = max(0, where - offset)
        return offset, size if 0 < size <= room else room
    if offset >= end or not _is_record(data, offset):
        start = _first_record(data, end)
        return start, end - start
    return offset, size if 0 < size <= end - offset else end - offset


def _wide(extra: bytes, fields: list[int]) -> list[int]:
    """Values of the ZIP64 extra field for those that are at their limit, in the order of the field."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            body, out = extra[at + 4 : at + 4 + n], []
            for v in fields:
                if v == 0xFFFFFFFF:
                    if len(body) < 8:
                        return fields
                    v, body = int.from_bytes(body[:8], "little"), body[8:]
                out.append(v)
            return out
        at += 4 + n
    return fields


def open_lenient(data: bytes, password: str | None = None, kind: str = "Zip") -> Archive:
    """Keeps every directory record that can be read; goes on at the next signature after one that cannot."""
    start, size = find_directory(data)
    end = min(len(data), start + size)
    entries, places, warnings, at = [], [], [], start
    while at + 46 <= end:
        if data[at : at + 4] != CDFH:
            at = data.find(CDFH, at + 1, end)
            if at < 0:
                break
            warnings.append(f"resynchronised at {at}")
            continue
        flags, method, time, date, crc, packed, size_, n, x, c = unpack_at("<HHHHIIIHHH", data, at + 8)
        external, offset = unpack_at("<II", data, at + 38)
        stop = at + 46 + n + x + c
        if stop > end:
            warnings.append(f"record at {at} cut off")
            at = data.find(CDFH, at + 4, end)
            if at < 0:
                break
            continue
        name, extra, comment = data[at + 46 : at + 46 + n], data[at + 46 + n : at + 46 + n + x], data[stop - c : stop]
        size_, packed, offset = _wide(extra, [size_, packed, offset])
        if offset >= len(data):
            warnings.append(f"record at {at} points behind the file")
            offset = UNREADABLE
        path = name.decode("utf-8", "replace")
        entries.append(
            Entry(
                path, path.endswith("/"), external >> 16 & 0o170000 == 0o120000, size_, packed, METHODS.get(method, "Unknown"), "ZipCrypto" if flags & 1 else "None",
                crc, dos_time(date, time), external, comment.decode("utf-8", "replace") or None,
            )
        )
        places.append((offset, method, flags))
        at = stop

    def read(k: int, limit: int) -> bytes:
        offset, method, flags = places[k]
        if entries[k].is_directory:
            return b""
        need(offset != UNREADABLE, "entry lies behind the file")
        if flags & 1:
            raise ArchiveError("FeatureDisabled", "encrypted entry in a damaged archive")
        need(data[offset : offset + 4] == LFH and offset + 30 <= len(data), "invalid local header")
        n, x = unpack_at("<HH", data, offset + 26)
        begin = offset + 30 + n + x
        body = data[begin : begin + entries[k].compressed_size]
        need(len(body) == entries[k].compressed_size, "payload cut off")
        if method == 0:
            return body
        if method == 8:
            return inflate(body, limit)
        raise ArchiveError("FeatureDisabled", f"method {METHODS.get(method, method)} in a damaged archive")

    return Archive(kind, "zip-lenient", entries, read, warnings)


def open_zip(data: bytes, password: str | None = None, kind: str = "Zip") -> Archive:
    try:
        opened = open_strict(data, password, kind)
    except ArchiveError as e:
        if not is_recoverable(e):
            raise
        opened = open_lenient(data, password, kind)
    for k, e in enumerate(opened.entries):
        if e.is_symlink:  # the payload is the target
            try:
                e.link_target = opened.read(k, LINK_BYTES).decode("utf-8", "replace")
            except ArchiveError as x:
                opened.warnings.append(f"{e.path}: {x.message}")
    return opened


# -- spanned sets --------------------------------------------------------------------------------


def join_spanned(volumes: list[bytes]) -> bytes:
    """Volumes as one file. Those of a real multi-disk archive get directory and end record with whole offsets.

    Plain byte splits are joined as they are; ZIP64 sets are refused.
    """
    whole = b"".join(volumes)
    need(len(whole) >= 22, "set shorter than an end record", "Io")
    end = whole.rfind(EOCD, max(0, len(whole) - TAIL))
    need(end >= 0, "no end record in the last volume", "Io")
    need(whole[max(0, end - 20) : end][:4] != LOCATOR or end < 20, "spanned ZIP64", "Io")
    disk, directory_disk, here, total, size, offset = struct.unpack_from("<HHHHII", whole, end + 4)
    if not disk and not directory_disk and here == total:
        return whole
    origin = [0]
    for v in volumes:
        origin.append(origin[-1] + len(v))
    need(directory_disk < len(volumes), "directory on a volume that is missing", "Io")
    start = origin[directory_disk] + offset
    need(start + size <= end, "directory larger than its room", "Io")
    out, at = bytearray(whole), start
    while at + 46 <= start + size and out[at : at + 4] == CDFH:
        n, x, c, on_disk = struct.unpack_from("<HHHH", out, at + 28)
        (local,) = struct.unpack_from("<I", out, at + 42)
        need(on_disk < len(volumes), "entry on a volume that is missing", "Io")
        struct.pack_into("<H", out, at + 34, 0)
        struct.pack_into("<I", out, at + 42, origin[on_disk] + local)
        at += 46 + n + x + c
    struct.pack_into("<HHH", out, end + 4, 0, 0, total)
    struct.pack_into("<I", out, end + 16, start)
    return bytes(out)


# -- writing -------------------------------------------------------------------------------------


def encrypted_member(name: str, payload: bytes, password: str, level: int, modified, mode: int, salt: bytes) -> tuple[bytes, bytes]:
    """An AES-256 entry: its local part, and its directory record with offset 0 (at byte 42)."""
    packed = zlib.compressobj(level, zlib.DEFLATED, -15)
    deflated = packed.compress(payload) + packed.flush()
    method, body = (8, deflated) if len(deflated) < len(payload) else (0, payload)
    key, mac, check = aes.zip_keys(password, salt, 256)
    body = aes.ctr_little(body, key)
    body = salt + check + body + aes.zip_tag(mac, body)
    extra = struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", 3, method)
    t = modified.astimezone(UTC)
    date, time = (t.year - 1980) << 9 | t.month << 5 | t.day, t.hour << 11 | t.minute << 5 | t.second // 2
    raw = name.encode()
    common = struct.pack("<HHHHHIIIHH", 51, 0x801, 99, time, date, 0, len(body), len(payload), len(raw), len(extra))
    local = LFH + common + raw + extra + body
    record = CDFH + struct.pack("<H", 3 << 8 | 51) + common + struct.pack("<HHHII", 0, 0, 0, mode << 16, 0) + raw + extra
    return local, record


def end_record(count: int, size: int, offset: int) -> bytes:
    need(count < 0xFFFF and offset + size < 0xFFFFFFFF, "encrypted archive needs ZIP64", "FeatureDisabled")
    return EOCD + struct.pack("<HHHHIIH", 0, 0, count, count, size, offset, 0)
