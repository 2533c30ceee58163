"""Times, modes, sizes, ratios, codes and labels as columns. Built-in functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.errors import IO_CODES, KINDS
from stowage.functions.detect import COMPOUND, ascii_lower, file_name

FILETIME_UNIX, TICKS = 11_644_473_600, 10_000_000
S_IFMT, PERMISSIONS = 0o170000, 0o7777
BOMB_BYTES, BOMB_RATIO = 1 << 30, 1000
# Extensions whose files do not get smaller.
INCOMPRESSIBLE = (
    "zip", "7z", "rar", "gz", "tgz", "bz2", "tbz", "tbz2", "xz", "txz", "zst", "tzst", "lz", "lz4", "tlz4", "lzma", "lzh", "lha", "cab", "arj",
    "ace", "alz", "egg", "iso", "img", "vhd", "vhdx", "wim", "jar", "war", "ear", "apk", "ipa", "aab", "msi", "msix", "appx", "xpi", "crx",
    "jpg", "jpeg", "jpe", "jp2", "png", "gif", "webp", "heic", "heif", "avif", "tif", "tiff", "raw", "cr2", "nef", "dng", "arw", "orf", "rw2", "3fr",
    "mp3", "aac", "m4a", "m4b", "m4r", "ogg", "oga", "opus", "wma", "flac", "ape", "dsf", "dff",
    "mp4", "m4v", "mov", "mkv", "avi", "wmv", "flv", "webm", "3gp", "3g2", "ts", "mts", "m2ts", "vob",
    "pdf", "docx", "docm", "xlsx", "xlsm", "pptx", "pptm", "odt", "ods", "odp", "epub", "mobi", "azw", "azw3", "djvu",
)
# Names of formats that can be asked for, and those that can only be read.
FORMAT_TOKENS = {
    "zip": "Zip", "zipx": "Zipx", "7z": "SevenZ", "sevenz": "SevenZ", "tar": "Tar", "gz": "Gzip", "gzip": "Gzip", "tgz": "TarGz", "tar.gz": "TarGz",
    "bz2": "Bzip2", "bzip2": "Bzip2", "tbz": "TarBz2", "tbz2": "TarBz2", "tar.bz2": "TarBz2", "xz": "Xz", "txz": "TarXz", "tar.xz": "TarXz",
    "lzma": "Lzma", "zst": "Zstd", "zstd": "Zstd", "tzst": "TarZst", "tar.zst": "TarZst", "lz4": "Lz4", "tar.lz4": "TarLz4",
}
READ_ONLY_TOKENS = ("rar", "iso", "cab", "msi", "deb")
# The method that a format takes where compression is asked for, and its extension.
CODECS = {
    "Zip": "Deflate", "Gzip": "Deflate", "TarGz": "Deflate", "Zipx": "Bzip2", "SevenZ": "Lzma2", "Xz": "Lzma2", "TarXz": "Lzma2", "Bzip2": "Bzip2",
    "TarBz2": "Bzip2", "Lzma": "Lzma", "Zstd": "Zstd", "TarZst": "Zstd", "Tar": "Store", "Lz4": "Store", "TarLz4": "Store",
}
PRIMARY_EXTENSIONS = {
    "Zip": "zip", "Zipx": "zipx", "SevenZ": "7z", "Tar": "tar", "Gzip": "gz", "TarGz": "tar.gz", "Bzip2": "bz2", "TarBz2": "tar.bz2", "Xz": "xz",
    "TarXz": "tar.xz", "Lzma": "lzma", "Zstd": "zst", "TarZst": "tar.zst", "Lz4": "lz4", "TarLz4": "tar.lz4",
}


def _mapped(key: Column, table: dict, kind: str = "string") -> Column:
    out = F.lit(None).cast(kind)
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


# -- times and modes -----------------------------------------------------------------------------


def dos_to_timestamp(date: Column, time: Column) -> Column:
    """DOS date and time as UTC, to two seconds; null for 0/0 and for dates or times that are none."""
    date, time = date.cast("int"), time.cast("int")
    y, m, d = F.shiftright(date, 9).bitwiseAND(0x7F) + 1980, F.shiftright(date, 5).bitwiseAND(0xF), date.bitwiseAND(0x1F)
    h, mi, s = F.shiftright(time, 11).bitwiseAND(0x1F), F.shiftright(time, 5).bitwiseAND(0x3F), time.bitwiseAND(0x1F) * 2
    made = F.try_make_timestamp(y, m, d, h, mi, s.cast("decimal(8,6)"), F.lit("UTC"))
    return F.when((date == 0) & (time == 0), None).when((h < 24) & (mi < 60) & (s < 60), made)


def timestamp_to_dos(ts: Column) -> Column:
    """``struct<date, time>`` of a time as UTC, clamped to 1980..2107."""
    t = F.from_utc_timestamp(ts, "UTC")
    y = F.year(t)
    date = F.shiftleft(F.least(F.greatest(y - 1980, F.lit(0)), F.lit(127)), 9) + F.shiftleft(F.month(t), 5) + F.dayofmonth(t)
    time = F.shiftleft(F.hour(t), 11) + F.shiftleft(F.minute(t), 5) + F.floor(F.second(t) / 2).cast("int")
    low, high = y < 1980, y > 2107
    date = F.when(low, (1 << 5) + 1).when(high, (127 << 9) + (12 << 5) + 31).otherwise(date)
    time = F.when(low, 0).when(high, (23 << 11) + (59 << 5) + 29).otherwise(time)
    return F.struct(date.cast("int").alias("date"), time.cast("int").alias("time"))


def filetime_seconds(ticks: Column) -> Column:
    """Seconds since 1970 of a FILETIME, null before. Exact for ticks beyond 2^53, as long or as decimals without fraction."""
    whole = ticks.cast("decimal(38,0)")
    whole = F.when(whole < Decimal(TICKS << 63), F.call_function("div", ticks, F.lit(TICKS))).otherwise(F.floor(whole / TICKS).cast("long"))  # div wraps beyond a long; the cast is an error
    return F.when(ticks >= FILETIME_UNIX * TICKS, whole - FILETIME_UNIX)


def unix_mode(attributes: Column, host_os: Column) -> Column:
    """Permission bits hidden in attributes, null if there are none: in the high word, in the low word, or bare from Unix."""
    a = attributes.cast("long")
    high = F.shiftrightunsigned(a, 16).bitwiseAND(0xFFFF)
    return (
        F.when(high.bitwiseAND(S_IFMT) != 0, high.bitwiseAND(PERMISSIONS))
        .when(a.bitwiseAND(S_IFMT) != 0, a.bitwiseAND(PERMISSIONS))
        .when((host_os == "Unix") & (a != 0) & (a <= PERMISSIONS), a)
        .cast("int")
    )


def effective_mode(mode: Column, is_directory: Column, umask: int = 0o022) -> Column:
    """What is set on disk: no special bits, the umask off, the owner's access kept."""
    return F.when(mode.isNotNull(), mode.bitwiseAND(0o777).bitwiseAND(~umask & 0o777).bitwiseOR(F.when(is_directory, 0o700).otherwise(0o600)))


# -- gates and choices ---------------------------------------------------------------------------


def ratio_suspect(is_directory: Column, is_symlink: Column, uncompressed: Column, compressed: Column, limit: int = BOMB_RATIO) -> Column:
    """Whether one entry alone looks like a bomb: 1 GiB or more, and a whole ratio above the limit."""
    big = (uncompressed >= BOMB_BYTES) & (compressed > 0)
    ratio = F.floor(F.try_divide(uncompressed.cast("decimal(20,0)"), compressed.cast("decimal(20,0)")))
    return F.coalesce(~is_directory & ~is_symlink & big & (ratio > limit), F.lit(False))


def has_incompressible_extension(name: Column) -> Column:
    ext = ascii_lower(F.regexp_extract(name, r"(?s)\.([^.]*)$", 1))
    return F.coalesce(ext.isin(*INCOMPRESSIBLE), F.lit(False))


def codec_for(format_name: Column, level: Column) -> Column:
    return F.when(level == 0, "Store").otherwise(F.coalesce(_mapped(format_name, CODECS), F.lit("Deflate")))


def zip_level(method: Column, level: Column) -> Column:
    """The level that is used: 0 with Deflate means 5, and 9 is the most."""
    return F.when((method == "Deflate") & (level == 0), 5).otherwise(F.least(level, F.lit(9)))


def parse_format(token: Column) -> Column:
    """``struct<format, error>`` of what a user typed; case, blanks and leading dots do not matter."""
    key = ascii_lower(F.regexp_replace(F.trim(token), r"^\.+", ""))
    found = _mapped(key, FORMAT_TOKENS)
    error = F.when(key.isin(*READ_ONLY_TOKENS), "read only").when(found.isNull(), "unknown format")
    return F.struct(found.alias("format"), error.alias("error"))


def infer_format(path: Column) -> Column:
    """The format of an output by its name, the longest token first, ZIP if none fits."""
    name, out = ascii_lower(file_name(path)), F.lit("Zip")
    for token in sorted(FORMAT_TOKENS, key=len):
        out = F.when(name.endswith("." + token), FORMAT_TOKENS[token]).otherwise(out)
    return out


def primary_extension(format_name: Column) -> Column:
    return F.coalesce(_mapped(format_name, PRIMARY_EXTENSIONS), F.lit("zip"))


def parse_size(text: Column) -> Column:
    """Bytes of ``100m``, ``1g``, ``512k`` or a plain number; null if it is none or too large for 64 bits."""
    low = ascii_lower(F.trim(text))
    unit = F.when(low.endswith("g"), 1 << 30).when(low.endswith("m"), 1 << 20).when(low.endswith("k"), 1 << 10).otherwise(1)
    digits = F.regexp_extract(low, r"^\+?([0-9]+)\s*[kmg]?$", 1)
    n = F.when(digits != "", digits).try_cast("decimal(38,0)") * unit.cast("decimal(12,0)")
    return F.when(n < F.lit(str(1 << 64)).cast("decimal(38,0)"), n.cast("decimal(20,0)"))


# -- codes and labels ----------------------------------------------------------------------------


def exit_code(kind: Column) -> Column:
    """The process exit code of an error kind; 0 for none, 2 for what is no archive error."""
    return F.when(kind.isNull(), 0).otherwise(F.coalesce(_mapped(kind, {k: v[0] for k, v in KINDS.items()}, "int"), F.lit(2)))


def library_code(kind: Column, io_kind: Column | None = None) -> Column:
    """The library code of an error kind; I/O errors are told apart by their own kind."""
    code = _mapped(kind, {k: v[1] for k, v in KINDS.items()}, "int")
    if io_kind is not None:
        code = F.when(kind == "Io", F.coalesce(_mapped(io_kind, IO_CODES, "int"), code)).otherwise(code)
    return F.when(kind.isNull(), 0).otherwise(F.coalesce(code, F.lit(-1)))


def listing(path: Column, is_directory: Column, size: Column, modified: Column) -> Column:
    """A line of a listing: size, UTC minute, name; directories have size 0 and end with a slash."""
    when = F.when(modified >= F.lit("1970-01-01 00:00:00").cast("timestamp"), F.date_format(modified, "yyyy-MM-dd HH:mm"))
    name = F.when(is_directory, F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"))).otherwise(path)
    bytes_ = F.when(is_directory, 0).otherwise(size).cast("string")
    pad = lambda c, n: F.when(F.length(c) < n, F.lpad(c, n, " ")).otherwise(c)
    return F.concat(pad(bytes_, 12), F.lit("  "), F.rpad(F.coalesce(when, F.lit("-")), 16, " "), F.lit("  "), name)


def size_label(size: Column) -> Column:
    """``12.34 MB`` by powers of 1024, at most two decimals, no zeros at the end."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, name in ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB")):
        text = F.regexp_replace(F.round(size / unit, 2).cast("decimal(20,2)").cast("string"), r"\.?0+$", "")
        out = F.when(size >= unit, F.concat(text, F.lit(f" {name}"))).otherwise(out)
    return out


def speed_label(size: Column, seconds: Column) -> Column:
    """Bytes a second, null for runs too short to tell or of nothing."""
    rate = F.try_divide(size.cast("double"), seconds).cast("long")
    return F.when((size > 0) & (seconds >= 0.05), F.concat(size_label(rate), F.lit("/s")))


def saved_label(original: Column, archive: Column) -> Column:
    """The share saved in whole percent, null unless the archive is smaller."""
    share = F.round((1 - F.try_divide(archive.cast("double"), original.cast("double"))) * 100, 0).cast("int")
    return F.when((original > 0) & (archive < original), F.concat(share.cast("string"), F.lit("%↓")))


def summary_label(archive: Column, original: Column | None, seconds: Column) -> Column:
    """Size, share saved and speed joined by dots; without ``original`` the line of an extraction."""
    saved = [saved_label(original, archive)] if original is not None else []
    return F.concat_ws("  ·  ", size_label(archive), *saved, speed_label(archive if original is None else original, seconds))


def source_stem(path: Column, is_directory: Column) -> Column:
    """The name of a source: of a file without its last extension, of a folder whole."""
    name = file_name(path)
    return F.when(is_directory, name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def output_stem(first: Column, first_is_directory: Column, count: Column, use_parent: Column) -> Column:
    """One source gives its own name, several that of their folder if asked for; blank names become ``archive``."""
    parent = file_name(F.regexp_replace(first, r"/[^/]*/*$", ""))
    stem = F.when((count > 1) & use_parent, parent).otherwise(source_stem(first, first_is_directory))
    return F.when((count < 1) | stem.isNull() | (F.trim(stem) == ""), "archive").otherwise(stem)


def fill_template(template: Column, name: Column, parent: Column, count: Column, now: Column) -> Column:
    """A file name of ``{name} {date} {time} {count} {parent}``; characters that a name must not have are dropped."""
    out = template
    for token, value in (("{name}", name), ("{date}", F.date_format(now, "yyyy-MM-dd")), ("{time}", F.date_format(now, "HHmm")), ("{count}", count.cast("string")), ("{parent}", F.coalesce(file_name(parent), F.lit("")))):
        out = F.replace(out, F.lit(token), value)
    out = F.regexp_replace(out, r'[\x00-\x1f"<>|:*?\\/]', "")
    return F.when(template.isNull() | (F.trim(template) == "") | (F.trim(out) == ""), name).otherwise(out)


def uniquified(path: Column, number: Column) -> Column:
    """``foo (1).zip``; the tar compounds of gz, bz2 and xz stay together; number 0 leaves the path."""
    last = file_name(path)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(last))
    both = "|".join(k.replace(".", r"\.") for k in COMPOUND if k in ("tar.gz", "tar.bz2", "tar.xz"))
    ext = F.regexp_extract(last, rf"(?is)(\.(?:{both})|\.[^.]*)$", 1)
    stem = F.substring(last, F.lit(1), F.length(last) - F.length(ext))
    return F.when(number == 0, path).otherwise(F.concat(folder, stem, F.lit(" ("), number.cast("string"), F.lit(")"), ext))
