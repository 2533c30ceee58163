"""Format detection for parsers, by the same tables as the column functions."""

from __future__ import annotations

from stowage.functions.detect import COMPOUND, EXTENSIONS, MAGICS, USTAR, USTAR_AT

_MAGICS = [(bytes.fromhex(m), name) for m, name in MAGICS]
_USTAR = bytes.fromhex(USTAR)
# Signatures that a compound name turns into a tar, and its short names.
_TARS = {"Gzip": ("TarGz", "tar.gz", ("tgz",)), "Zstd": ("TarZst", "tar.zst", ("tzst",)), "Lz4": ("TarLz4", "tar.lz4", ())}
_PLAIN = {"TarBz2": ("Bzip2", "bz2"), "TarXz": ("Xz", "xz")}


def detect(data: bytes, path: str) -> str:
    """Signature first, narrowed by the name; else the name; else Unknown."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    stem, dot, ext = name.rpartition(".")
    ext = ext if dot and stem else ""
    both = next((c for c in COMPOUND if name.endswith(c)), "")
    found = next((n for m, n in _MAGICS if data.startswith(m)), None)
    if found is None and len(data) > USTAR_AT + len(_USTAR) and data[USTAR_AT : USTAR_AT + len(_USTAR)] == _USTAR:
        found = "Tar"
    if found is None:
        return COMPOUND[both] if both and both.endswith(ext) and ext else EXTENSIONS.get(ext, "Unknown")
    if found == "Zip" and ext == "zipx":
        return "Zipx"
    if found in _TARS:
        tar, compound, short = _TARS[found]
        return tar if both == compound or ext in short else found
    if found in _PLAIN and ext == _PLAIN[found][1] and both != f"tar.{ext}":
        return _PLAIN[found][0]
    if found in ("Msi", "Deb") and ext != found.lower():
        return "Unknown"
    return found
