"""Writers of archive files: entries in, bytes out."""

from __future__ import annotations

import datetime as dt
import gzip
import io
import lzma
import os
import tarfile
import zipfile
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from stowage.errors import ArchiveError
from stowage.formats import zip as zips
from stowage.formats.model import UTC
from stowage.formats.sevenz import write_sevenz
from stowage.functions.values import INCOMPRESSIBLE

#: Payloads from this size are probed before they are deflated.
PROBE_FROM, PROBE_BYTES, PROBE_LEAST = 256 << 20, 1 << 20, 4096
# Mean ratio from which a payload is stored, by its size.
PROBE_RATIOS = ((1 << 30, 0.65), (256 << 20, 0.75), (0, 0.85))
WRITABLE = ("Zip", "Zipx", "SevenZ", "Tar", "TarGz", "Xz")
EPOCH = dt.datetime(1980, 1, 1, tzinfo=UTC)


@dataclass
class Item:
    """What goes into an archive; a null payload is a directory."""

    path: str
    payload: bytes | None
    modified: dt.datetime | None = None
    mode: int | None = None

    @property
    def time(self) -> dt.datetime:
        return self.modified or EPOCH

    @property
    def unix_mode(self) -> int:
        directory = self.payload is None
        return (0o040000 if directory else 0o100000) | (self.mode if self.mode is not None else 0o755 if directory else 0o644)

    @property
    def name(self) -> str:
        return self.path if self.payload is not None else self.path.rstrip("/") + "/"


def probe_ratio(payload: bytes, level: int = 6) -> float | None:
    """Mean deflate ratio of up to three samples: the start, and of larger payloads the middle and the end; null if too small."""
    n = len(payload)
    if n < PROBE_LEAST:
        return None
    places = [0] if n < 3 * PROBE_BYTES else [0, n // 2, n - PROBE_BYTES]
    ratios = []
    for at in places:
        sample = payload[at : at + PROBE_BYTES]
        if len(sample) >= PROBE_LEAST:
            z = zlib.compressobj(level, zlib.DEFLATED, -15)
            ratios.append((len(z.compress(sample)) + len(z.flush())) / len(sample))
    return sum(ratios) / len(ratios) if ratios else None


def probe_says_store(payload: bytes, level: int = 6) -> bool:
    ratio = probe_ratio(payload, level)
    return ratio is not None and ratio >= next(r for least, r in PROBE_RATIOS if len(payload) >= least)


def stored_by_choice(item: Item, level: int, smart: bool = True) -> bool:
    """Whether a payload is stored before anything is tried: if asked for, empty, or by name or probe of large payloads."""
    if level == 0 or not item.payload:
        return True
    if smart and "." in item.path and item.path.rpartition(".")[2].lower() in INCOMPRESSIBLE:
        return True
    return smart and len(item.payload) >= PROBE_FROM and probe_says_store(item.payload, level)


def deflated(payload: bytes, level: int) -> bytes | None:
    """The payload deflated, null if that does not make it smaller."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    parts, size = [], 0
    for k in range(0, len(payload), PROBE_BYTES):
        parts.append(z.compress(payload[k : k + PROBE_BYTES]))
        size += len(parts[-1])
        if size >= len(payload):
            return None
    parts.append(z.flush())
    return b"".join(parts) if size + len(parts[-1]) < len(payload) else None


def zip_method(item: Item, level: int, smart: bool = True) -> int:
    """Stored by choice, or if deflating does not make a payload smaller."""
    if stored_by_choice(item, level, smart) or deflated(item.payload or b"", level) is None:
        return zipfile.ZIP_STORED
    return zipfile.ZIP_DEFLATED


def _info(item: Item, method: int) -> zipfile.ZipInfo:
    t = min(max(item.time.astimezone(UTC), EPOCH), dt.datetime(2107, 12, 31, 23, 59, 58, tzinfo=UTC))
    info = zipfile.ZipInfo(item.name, (t.year, t.month, t.day, t.hour, t.minute, t.second // 2 * 2))
    info.create_system, info.compress_type = 3, method
    info.external_attr = item.unix_mode << 16 | (0x10 if item.payload is None else 0)
    return info


def write_zip(items: Iterable[Item], level: int = 6, kind: str = "Zip", smart: bool = True, onto: bytes | None = None) -> bytes:
    """A ZIP, or with kind Zipx one of bzip2; ``onto`` is an archive that is kept and continued."""
    if kind == "Zip" and not onto:
        return _plain_zip(items, level, smart)
    out = io.BytesIO(onto or b"")
    with zipfile.ZipFile(out, "a" if onto else "w", allowZip64=True) as z:
        for item in items:
            if kind == "Zipx":
                method = zipfile.ZIP_BZIP2 if item.payload and level else zipfile.ZIP_STORED
            else:
                method = zip_method(item, level or 5 if level else 0, smart)
            z.writestr(_info(item, method), item.payload or b"", compresslevel=min(max(level, 1), 9))
    return out.getvalue()


def _plain_zip(items: Iterable[Item], level: int, smart: bool) -> bytes:
    """Each payload is deflated once, and stored if that was for nothing; the directory is the library's."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", allowZip64=True) as z:
        for item in items:
            payload = item.payload or b""
            body = None if stored_by_choice(item, level, smart) else deflated(payload, min(max(level, 1), 9))
            info = _info(item, zipfile.ZIP_STORED if body is None else zipfile.ZIP_DEFLATED)
            info.CRC, info.file_size, info.compress_size = zlib.crc32(payload), len(payload), len(payload if body is None else body)
            info.header_offset = out.tell()
            out.write(info.FileHeader())
            out.write(payload if body is None else body)
            z.filelist.append(info)
            z.NameToInfo[info.filename] = info
            z.start_dir, z._didModify = out.tell(), True
    return out.getvalue()


def write_encrypted_zip(items: Iterable[Item], password: str, level: int = 6, salt=os.urandom) -> bytes:
    """AES-256 entries; directories stay plain."""
    body, directory, count = bytearray(), bytearray(), 0
    for item in items:
        offset = len(body)
        local, record = zips.encrypted_member(item.name, item.payload or b"", password, level, max(item.time, EPOCH), item.unix_mode, salt(16))
        body += local
        directory += record[:42] + offset.to_bytes(4, "little") + record[46:]
        count += 1
    return bytes(body + directory) + zips.end_record(count, len(directory), len(body))


def write_tar(items: Iterable[Item]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as tar:
        for item in items:
            info = tarfile.TarInfo(item.name.rstrip("/"))
            info.type = tarfile.DIRTYPE if item.payload is None else tarfile.REGTYPE
            info.size, info.mode, info.mtime = len(item.payload or b""), item.unix_mode & 0o7777, int(item.time.timestamp())
            tar.addfile(info, io.BytesIO(item.payload or b""))
    return out.getvalue()


def write_archive(items: Iterable[Item], kind: str = "Zip", level: int = 6, password: str | None = None, smart: bool = True) -> bytes:
    """Bytes of an archive of one of the writable kinds; others raise the error that the kind calls for."""
    if kind not in WRITABLE:
        raise ArchiveError("FeatureDisabled" if kind in ("Rar", "Iso", "Cab", "Msi", "Deb") else "UnsupportedFormat", f"{kind} cannot be created")
    if password and kind not in ("Zip", "Zipx", "SevenZ"):
        raise ArchiveError("FeatureDisabled", f"{kind} cannot be encrypted")
    if kind in ("Zip", "Zipx"):
        return write_encrypted_zip(items, password, level or 5) if password else write_zip(items, level, kind, smart)
    if kind == "SevenZ":
        return write_sevenz([(i.path.rstrip("/"), i.payload, int(i.time.timestamp())) for i in items], password)
    if kind == "Tar":
        return write_tar(items)
    if kind == "TarGz":
        return gzip.compress(write_tar(items), min(level, 9), mtime=0)
    items = list(items)
    if len(items) != 1 or items[0].payload is None:
        raise ArchiveError("InvalidArgument", "xz holds exactly one file")
    return lzma.compress(items[0].payload, preset=min(level or 6, 9))


def append_zip(data: bytes, items: Iterable[Item], level: int = 6) -> tuple[bytes, list[str], list[str]]:
    """An archive with what it lacks of ``items`` added; names added, and names skipped. Existing bytes stay."""
    have = {i.filename for i in zipfile.ZipFile(io.BytesIO(data)).infolist()}
    added, skipped = [], []
    for item in items:
        (skipped if item.name in have else added).append(item)
        have.add(item.name)
    return write_zip(added, level, onto=data) if added else data, [i.name for i in added], [i.name for i in skipped]
