"""Tar in its compressed forms: names decoded once for the archive, pax headers folded in, links kept."""

from __future__ import annotations

import tarfile
from bisect import bisect_left

from stowage.errors import ArchiveError
from stowage.formats.model import Archive, Entry, need, unix_time
from stowage.formats.names import RawName, decode_names
from stowage.formats.ranged import STRETCH, as_file
from stowage.formats.streams import PIECES, Decoded

CODECS = {"Tar": None, "TarGz": "Gzip", "TarBz2": "Bzip2", "TarXz": "Xz", "TarZst": "Zstd", "TarLz4": "Lz4"}
#: A compressed tar of up to so many bytes is decoded once and held; a larger one is read as a stream, again for each step back.
HELD = 64 << 20


def _opened(data, path: str, kind: str):
    """The tar's bytes, or a file of them."""
    codec = "Lzma" if kind == "TarXz" and path.lower().endswith(".tlz") else CODECS[kind]
    if codec is None:
        return data
    held = bytearray()
    for piece in PIECES[codec](data):
        held += piece
        if len(held) > HELD:
            return Decoded(lambda: PIECES[codec](data), len(data))
    return bytes(held)


def open_tar(data: bytes, path: str, kind: str, codepage: str | None = None) -> Archive:
    """Entries up to the first end mark; a name ending ``.tlz`` means the old LZMA format."""
    whole = _opened(data, path, kind)
    stream = isinstance(whole, Decoded)
    try:
        tar = tarfile.open(fileobj=whole if stream else as_file(whole), mode="r:", encoding="utf-8", errors="surrogateescape")
        members = tar.getmembers()
    except tarfile.ReadError as e:
        if str(e) in ("empty file", "file could not be opened successfully") and not stream and not any(whole[k : k + STRETCH].strip(b"\0") for k in range(0, len(whole), STRETCH)):
            members, tar = [], None
        else:
            raise ArchiveError("Io", f"tar: {e}") from e
    raw = [RawName(m.name.encode("utf-8", "surrogateescape") + b"/" * m.isdir()) for m in members]
    names, _ = decode_names(raw, codepage)
    entries = [
        Entry(
            name, m.isdir(), m.issym(), m.size if m.isreg() else 0, m.size if m.isreg() else 0, modified=unix_time(int(m.mtime)), attributes=m.mode, host_os="Unix",
            link_target=m.linkname if m.issym() or m.islnk() else None, is_hardlink=m.islnk(),
        )
        for name, m in zip(names, members, strict=True)
    ]

    places: dict[str, list[int]] = {}
    for k, m in enumerate(members):
        places.setdefault(m.name, []).append(k)

    def read(k: int, most: int) -> bytes:
        m = members[k]
        if m.islnk():  # the last entry of that name before it holds the bytes
            own = places.get(m.linkname, [])
            j = bisect_left(own, k) - 1
            if j >= 0:
                return read(own[j], most)
            raise ArchiveError("EntryNotFound", f"link target not found: {m.linkname}", names[k])
        if not m.isreg():
            return b""
        if m.size > most:
            raise ArchiveError("ZipBombSuspected", f"more than {most} bytes", names[k])
        out = tar.extractfile(m).read()
        need(len(out) == m.size, "tar data cut off", entry=names[k])
        return out

    return Archive(kind, "tar", entries, read)
