"""Error kinds of archive operations: data in an ``error`` struct, exceptions only inside parsers."""

from __future__ import annotations

ERROR = "struct<kind:string,message:string,entry:string>"

# Each error kind with its process exit code and its library code.
KINDS: dict[str, tuple[int, int]] = {
    "InvalidArgument": (2, -2),
    "Io": (3, -10),
    "WrongPassword": (4, -22),
    "Corrupted": (5, -21),
    "EntryNotFound": (6, -24),
    "UnsupportedFormat": (7, -20),
    "FeatureDisabled": (8, -40),
    "MissingVolume": (9, -23),
    "PathTraversalBlocked": (10, -41),
    "ZipBombSuspected": (11, -42),
    "BackendError": (12, -50),
    "Canceled": (130, -30),
}
# Library codes of the finer I/O kinds, and exit codes that belong to no kind.
IO_CODES = {"NotFound": -11, "PermissionDenied": -12}
EXIT_OK, EXIT_USAGE = 0, 2


class ArchiveError(Exception):
    """An error of one of the kinds above; ``entry`` names the entry concerned, if one is."""

    def __init__(self, kind: str, message: str, entry: str | None = None):
        super().__init__(message)
        self.kind, self.message, self.entry = kind, message, entry

    def row(self) -> dict:
        return {"kind": self.kind, "message": self.message, "entry": self.entry}

    def __reduce__(self):
        return ArchiveError, (self.kind, self.message, self.entry)


def as_error(e: BaseException, entry: str | None = None) -> ArchiveError:
    """Any failure of a parser as one of the kinds; what is not an archive error or I/O is a backend's failure."""
    if isinstance(e, ArchiveError):
        return e if e.entry or not entry else ArchiveError(e.kind, e.message, entry)
    if isinstance(e, OSError):
        return ArchiveError("Io", str(e), entry)
    if isinstance(e, EOFError):
        return ArchiveError("Corrupted", "unexpected end of data", entry)
    return ArchiveError("BackendError", f"{type(e).__name__}: {e}", entry)
