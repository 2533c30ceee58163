"""Archive formats as columns: sniffing magics, extensions, code tables. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and their codes (12 is reserved).
FORMATS = {
    "Unknown": 0, "Zip": 1, "SevenZ": 2, "Rar": 3, "Tar": 4, "Gzip": 5, "TarGz": 6, "TarBz2": 7, "TarXz": 8, "Bzip2": 9, "Xz": 10,
    "Lzma": 11, "Zstd": 13, "TarZst": 14, "Lz4": 15, "TarLz4": 16, "Zipx": 17, "Iso": 18, "Cab": 19, "Msi": 20, "Deb": 21,
}
# Compression and encryption methods and their codes.
METHODS = {"Store": 0, "Deflate": 1, "Deflate64": 2, "Bzip2": 3, "Lzma": 4, "Lzma2": 5, "Zstd": 6, "Ppmd": 7, "Unknown": 0xFFFFFFFF}
ENCRYPTIONS = {"None": 0, "ZipCrypto": 1, "Aes128": 2, "Aes256": 3}
# Signatures at offset 0, first match wins; what they mean is narrowed by the extension.
MAGICS = (
    ("504B0304", "Zip"), ("504B0506", "Zip"), ("504B0708", "Zip"), ("377ABCAF271C", "SevenZ"), ("526172211A070100", "Rar"), ("526172211A0700", "Rar"),
    ("FD377A585A00", "TarXz"), ("1F8B", "Gzip"), ("425A68", "TarBz2"), ("28B52FFD", "Zstd"), ("04224D18", "Lz4"), ("4D534346", "Cab"),
    ("D0CF11E0A1B11AE1", "Msi"), ("213C617263683E0A", "Deb"),
)
SNIFF, USTAR_AT, USTAR = 512, 257, "7573746172"
# What an extension alone says; a compound one counts before its last part.
COMPOUND = {"tar.gz": "TarGz", "tar.bz2": "TarBz2", "tar.xz": "TarXz", "tar.zst": "TarZst", "tar.lz4": "TarLz4"}
EXTENSIONS = {
    "zip": "Zip", "jar": "Zip", "war": "Zip", "ear": "Zip", "ipa": "Zip", "apk": "Zip", "aab": "Zip", "appx": "Zip", "msix": "Zip", "xpi": "Zip",
    "crx": "Zip", "zipx": "Zipx", "7z": "SevenZ", "rar": "Rar", "tar": "Tar", "gz": "Gzip", "tgz": "TarGz", "bz2": "Bzip2", "tbz": "TarBz2",
    "tbz2": "TarBz2", "xz": "Xz", "txz": "TarXz", "tlz": "TarXz", "lzma": "Lzma", "zst": "Zstd", "tzst": "TarZst", "lz4": "Lz4", "iso": "Iso",
    "img": "Iso", "cab": "Cab", "msi": "Msi", "deb": "Deb",
}
# Names under which archives are offered for extraction.
ARCHIVE_EXTENSIONS = (
    "zip", "zipx", "7z", "rar", "tar", "tgz", "tbz", "tbz2", "tlz", "txz", "tzst", "gz", "bz2", "xz", "lzma", "zst", "lz4", "jar", "war", "ear",
    "ipa", "apk", "aab", "xpi", "crx", "iso", "img", "cab", "msi", "deb", "appx", "msix",
)
# ZIP method numbers that the tolerant reader names; the strict one knows 0 and 8.
ZIP_METHODS = {0: "Store", 8: "Deflate", 9: "Deflate64", 12: "Bzip2", 14: "Lzma", 93: "Zstd", 98: "Ppmd"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def file_name(path: Column) -> Column:
    """The last component; separators at the end do not count."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """The lower-cased last extension, null without one: no dot, or only a leading one."""
    found = F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1)
    has = file_name(path).rlike(r"(?s)^.+\.[^.]*$") & (file_name(path) != "..")
    return F.when(has, ascii_lower(found))


def compound_extension(path: Column) -> Column:
    """One of the tar compounds if the name ends with it, else null."""
    name, out = ascii_lower(file_name(path)), F.lit(None).cast("string")
    for ext in COMPOUND:
        out = F.when(name.endswith(ext), ext).otherwise(out)
    return out


def _mapped(key: Column, table: dict) -> Column:
    """The entry of a literal map, null if none: ``key`` is computed once, whatever the size of the table."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def detect_bytes(content: Column) -> Column:
    """The format that the first bytes tell, null if none; a tar has its mark at byte 257."""
    head = F.hex(F.substring(content, 1, SNIFF))
    out = F.when(F.substring(head, 2 * USTAR_AT + 1, len(USTAR)) == F.when(F.length(head) > 2 * USTAR_AT + len(USTAR), F.lit(USTAR)), F.lit("Tar"))
    for magic, name in reversed(MAGICS):
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def extension_hint(path: Column) -> Column:
    """The format that the name tells, null if none."""
    ext = extension(path)
    last = F.element_at(F.split(compound_extension(path), r"\."), -1)
    return F.coalesce(F.when(ext == last, _mapped(compound_extension(path), COMPOUND)), _mapped(ext, EXTENSIONS))


def narrow(tentative: Column, path: Column) -> Column:
    """What a signature says, narrowed by the name: tar in a stream, ZIPX, and the shared OLE2 and ar signatures."""
    ext, both = F.coalesce(extension(path), F.lit("")), F.coalesce(compound_extension(path), F.lit(""))
    tar = lambda stem, *short: (both == stem) | ext.isin(*short)
    return (
        F.when((tentative == "Zip") & (ext == "zipx"), "Zipx")
        .when((tentative == "Gzip") & tar("tar.gz", "tgz"), "TarGz")
        .when((tentative == "TarBz2") & ~tar("tar.bz2", "tbz", "tbz2") & (ext == "bz2"), "Bzip2")
        .when((tentative == "TarXz") & ~tar("tar.xz", "txz") & (ext == "xz"), "Xz")
        .when((tentative == "Zstd") & tar("tar.zst", "tzst"), "TarZst")
        .when((tentative == "Lz4") & (both == "tar.lz4"), "TarLz4")
        .when(tentative.isin("Msi", "Deb") & (ext != F.lower(tentative)), "Unknown")
        .otherwise(tentative)
    )


def detect(path: Column, content: Column) -> Column:
    """Signature first, narrowed by the name; else the name; else Unknown."""
    return F.coalesce(narrow(detect_bytes(content), path), extension_hint(path), F.lit("Unknown"))


def format_code(name: Column) -> Column:
    return F.coalesce(_mapped(name, FORMATS).cast("int"), F.lit(0))


def method_code(name: Column) -> Column:
    """The code as an unsigned 32-bit number, so a long."""
    return F.coalesce(_mapped(name, METHODS).cast("long"), F.lit(METHODS["Unknown"]).cast("long"))


def encryption_code(name: Column) -> Column:
    return F.coalesce(_mapped(name, ENCRYPTIONS).cast("int"), F.lit(0))


def zip_method(number: Column, strict: bool = False) -> Column:
    known = {k: v for k, v in ZIP_METHODS.items() if not strict or k in (0, 8)}
    return F.coalesce(_mapped(number, known), F.lit("Unknown"))


def has_archive_extension(path: Column) -> Column:
    """Whether the text after the last dot is an archive's extension; here a leading dot counts as one."""
    return F.coalesce(F.lower(F.regexp_extract(path, r"(?s)\.([^.]*)$", 1)).isin(*ARCHIVE_EXTENSIONS), F.lit(False))
