"""Parsers and writers of archive formats: bytes in, entries and payloads out. Nothing here knows Spark."""

from __future__ import annotations

from stowage.errors import ArchiveError, as_error
from stowage.formats.containers import open_cab, open_deb, open_iso, open_msi
from stowage.formats.model import READ_LIMIT, Archive, Entry, need
from stowage.formats.ranged import Ranged
from stowage.formats.rar import open_rar
from stowage.formats.sevenz import open_sevenz
from stowage.formats.sniff import detect
from stowage.formats.streams import STREAMS, open_stream
from stowage.formats.tar import CODECS, open_tar
from stowage.formats.zip import open_zip

__all__ = ["Archive", "ArchiveError", "Entry", "Ranged", "detect", "open_archive"]
#: Formats whose readers take only what they need of a file; others are read whole.
BY_PARTS = ("Zip", "Zipx", "SevenZ", *CODECS, *STREAMS)


def open_archive(data: bytes | Ranged, path: str, password: str | None = None, kind: str | None = None) -> Archive:
    """Opens by format, sniffed unless given; any failure is an ``ArchiveError``.

    ``data`` may be a file that is read by parts; one of a format that cannot be is read whole.
    """
    try:
        kind = kind or detect(data, path)
        if isinstance(data, Ranged) and kind not in BY_PARTS:
            need(len(data) <= READ_LIMIT, f"{kind} of more than {READ_LIMIT} bytes", "FeatureDisabled")
            data = data[:]
        if kind in ("Zip", "Zipx"):
            return open_zip(data, password, kind)
        if kind in CODECS:
            return open_tar(data, path, kind)
        if kind in STREAMS:
            return open_stream(data, path, kind)
        if kind == "SevenZ":
            return open_sevenz(data, password)
        if kind == "Rar":
            return open_rar(data, password)
        if kind in ("Iso", "Cab", "Msi", "Deb"):
            return {"Iso": open_iso, "Cab": open_cab, "Msi": open_msi, "Deb": open_deb}[kind](data)
    except Exception as e:  # a parser's failure of any sort is a row, not the end of a job
        raise as_error(e) from e
    raise ArchiveError("UnsupportedFormat", "")
