"""RAR, versions 4 and 5: headers are listed, stored entries are read; compressed ones need a decoder that is not here."""

from __future__ import annotations

import struct
import zlib

from stowage.errors import ArchiveError
from stowage.formats.model import Archive, Entry, dos_time, need, unix_time

RAR4, RAR5 = b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"


def open_rar(data: bytes, password: str | None = None) -> Archive:
    if data.startswith(RAR5):
        return _open5(data, password)
    need(data.startswith(RAR4), "rar: no signature", "BackendError")
    return _open4(data, password)


def _archive(entries: list[Entry], places: list[tuple[bytes | None, str]]) -> Archive:
    def read(k: int, limit: int) -> bytes:
        body, why = places[k]
        if entries[k].is_directory:
            return b""
        if body is None:
            raise ArchiveError("MissingVolume" if why == "split" else "FeatureDisabled", f"rar: {why}", entries[k].path)
        need(len(body) <= limit, f"more than {limit} bytes", "ZipBombSuspected")
        need(entries[k].crc32 is None or zlib.crc32(body) == entries[k].crc32, "rar: checksum differs")
        return body

    return Archive("Rar", "rar", entries, read)


def _open4(data: bytes, password: str | None) -> Archive:
    entries, places, at = [], [], len(RAR4)
    while at + 7 <= len(data):
        crc, kind, flags, size = struct.unpack_from("<HBHH", data, at)
        need(size >= 7 and at + size <= len(data), "rar: header cut off")
        need(zlib.crc32(data[at + 2 : at + size]) & 0xFFFF == crc or kind == 0x72, "rar: header checksum")
        extra = struct.unpack_from("<I", data, at + 7)[0] if flags & 0x8000 and size >= 11 or kind in (0x74, 0x7A) else 0
        if kind == 0x73 and flags & 0x80 and not password:
            raise ArchiveError("WrongPassword", "rar: headers are encrypted")
        if kind == 0x73 and flags & 0x80:
            raise ArchiveError("FeatureDisabled", "rar: encrypted headers")
        if kind == 0x74:
            packed, full, host, file_crc, time, version, method, n, attributes = struct.unpack_from("<IIBIIBBHI", data, at + 7)
            begin = at + 32
            if flags & 0x100:
                high_packed, high = struct.unpack_from("<II", data, begin)
                packed, full, begin, extra = packed | high_packed << 32, full | high << 32, begin + 8, packed | high_packed << 32
            raw = data[begin : begin + n]
            name = (_wide_name(raw) if flags & 0x200 and b"\0" in raw else raw.split(b"\0")[0].decode("utf-8", "replace")).replace("\\", "/")
            directory = flags & 0xE0 == 0xE0
            unix = host == 3
            entries.append(Entry(name, directory, unix and attributes & 0xF000 == 0xA000, full, 0, "Unknown", "Aes256" if flags & 4 else "None", file_crc, dos_time(time >> 16, time & 0xFFFF), attributes))
            whole = method == 0x30 and not flags & 7
            places.append((data[at + size : at + size + packed] if whole else None, "split" if flags & 3 else "encrypted" if flags & 4 else f"method {method:#x}"))
        at += size + extra
        if kind == 0x7B:
            break
    return _archive(entries, places)


def _wide_name(raw: bytes) -> str:
    """The Unicode name that is packed behind the plain one: two flag bits a character say how it is stored."""
    plain, _, code = raw.partition(b"\0")
    if not code:
        return plain.decode("utf-8", "replace")
    high, at, flags, left, out = code[0], 1, 0, 0, []
    while at < len(code):
        if not left:
            flags, left, at = code[at], 8, at + 1
        left -= 2
        way = flags >> left & 3
        if way == 3:
            if at >= len(code):
                break
            n, at = code[at], at + 1
            shift = code[at] if n & 0x80 and at < len(code) else None
            at += shift is not None
            for _ in range((n & 0x7F) + 2):
                if len(out) < len(plain):
                    b = plain[len(out)]
                    out.append(chr((b + shift & 255) | high << 8) if shift is not None else chr(b))
            continue
        width = 2 if way == 2 else 1
        if at + width > len(code):
            break
        out.append(chr(code[at] | (code[at + 1] << 8 if way == 2 else high << 8 if way == 1 else 0)))
        at += width
    return "".join(out)


def _open5(data: bytes, password: str | None) -> Archive:
    entries, places, at = [], [], len(RAR5)

    def vint(k: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            need(k < len(data) and shift < 70, "rar: header cut off")
            b = data[k]
            value |= (b & 0x7F) << shift
            k, shift = k + 1, shift + 7
            if not b & 0x80:
                return value, k

    while at + 7 <= len(data):
        (crc,) = struct.unpack_from("<I", data, at)
        size, k = vint(at + 4)
        end = k + size
        need(end <= len(data) and size, "rar: header cut off")
        need(zlib.crc32(data[at + 4 : end]) == crc, "rar: header checksum")
        kind, k = vint(k)
        flags, k = vint(k)
        extra = packed = 0
        if flags & 1:
            extra, k = vint(k)
        if flags & 2:
            packed, k = vint(k)
        if kind == 4:
            raise ArchiveError("FeatureDisabled" if password else "WrongPassword", "rar: headers are encrypted")
        if kind == 2:
            file_flags, k = vint(k)
            full, k = vint(k)
            attributes, k = vint(k)
            modified = file_crc = None
            if file_flags & 2:
                modified, k = unix_time(struct.unpack_from("<I", data, k)[0]), k + 4
            if file_flags & 4:
                file_crc, k = struct.unpack_from("<I", data, k)[0], k + 4
            method, k = vint(k)
            host, k = vint(k)
            n, k = vint(k)
            name = data[k : k + n].decode("utf-8", "replace").replace("\\", "/")
            locked, at_extra = False, end - extra
            while extra and at_extra < end:
                length, at_extra = vint(at_extra)
                what, _ = vint(at_extra)
                locked |= what == 1
                at_extra += length
            stored = method >> 7 & 7 == 0
            entries.append(Entry(name, bool(file_flags & 1), host == 1 and attributes & 0xF000 == 0xA000, full, 0, "Unknown", "Aes256" if locked else "None", file_crc, modified, attributes & 0xFFFFFFFF))
            whole = stored and not locked and not flags & 0x18
            places.append((data[end : end + packed] if whole else None, "split" if flags & 0x18 else "encrypted" if locked else f"method {method >> 7 & 7}"))
        at = end + packed
        if kind == 5:
            break
    return _archive(entries, places)
