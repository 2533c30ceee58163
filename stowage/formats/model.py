"""What every parser gives: entries with the fixed schema, and payloads on demand. No Spark here."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from stowage.errors import ArchiveError, as_error

UTC = dt.timezone.utc
#: Decoded bytes of one entry that a read gives at most, unless the caller says otherwise.
READ_LIMIT = 2**31 - 1


@dataclass
class Entry:
    """One row: metadata only. Times are null where a format has none; ``accessed`` and ``created`` always are."""

    path: str
    is_directory: bool = False
    is_symlink: bool = False
    uncompressed_size: int = 0
    compressed_size: int = 0
    compression: str = "Store"
    encryption: str = "None"
    crc32: int | None = None
    modified: dt.datetime | None = None
    attributes: int = 0
    comment: str | None = None
    host_os: str = "Unknown"
    link_target: str | None = None
    is_hardlink: bool = False


@dataclass
class Archive:
    """A parsed archive: entries in archive order, and a reader of one entry's bytes by position."""

    format: str
    backend: str
    entries: list[Entry]
    reader: Callable[[int, int], bytes]
    warnings: list[str] = field(default_factory=list)

    def read(self, index: int, limit: int = READ_LIMIT) -> bytes:
        """The decoded payload; more than ``limit`` bytes is an error of the bomb kind, not a shorter payload."""
        entry = self.entries[index]
        try:
            data = self.reader(index, limit)
        except Exception as e:  # every failure of a codec becomes one of the kinds
            raise as_error(e, entry.path) from e
        if len(data) > limit:
            raise ArchiveError("ZipBombSuspected", f"more than {limit} bytes", entry.path)
        return data

    def index_of(self, path: str) -> int:
        """The first entry of that path."""
        for k, e in enumerate(self.entries):
            if e.path == path:
                return k
        raise ArchiveError("EntryNotFound", f"entry not found: {path}", path)


def need(ok: bool, message: str, kind: str = "Corrupted", entry: str | None = None) -> None:
    if not ok:
        raise ArchiveError(kind, message, entry)


def unix_time(seconds: float | None) -> dt.datetime | None:
    """A time of the range that a timestamp column takes, else null."""
    if seconds is None or not -62135596800 <= seconds < 253402300800:
        return None
    return dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=seconds)


def dos_time(date: int, time: int) -> dt.datetime | None:
    """DOS date and time read as UTC; null for 0/0 and for what is no date."""
    if not date and not time:
        return None
    try:
        return dt.datetime((date >> 9) + 1980, date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, (time & 31) * 2, tzinfo=UTC)
    except ValueError:
        return None


def file_time(ticks: int) -> dt.datetime | None:
    """FILETIME to whole seconds; null before 1970."""
    seconds = ticks // 10_000_000 - 11_644_473_600
    return unix_time(seconds) if seconds >= 0 else None


def unix_mode(attributes: int, host_os: str) -> int | None:
    """Permission bits of attributes, as ``functions.values.unix_mode`` finds them."""
    for word in (attributes >> 16 & 0xFFFF, attributes):
        if word & 0o170000:
            return word & 0o7777
    return attributes if host_os == "Unix" and 0 < attributes <= 0o7777 else None


def disk_mode(entry: Entry, umask: int = 0o022) -> int | None:
    """What is set on disk: no special bits, the umask off, the owner's access kept."""
    mode = unix_mode(entry.attributes, entry.host_os)
    return None if mode is None else mode & 0o777 & ~umask | (0o700 if entry.is_directory else 0o600)
