"""Paths inside archives as columns: safety, metadata noise, names of outputs. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.functions.detect import LOWER, UPPER, ascii_lower, extension, file_name

# Files and folders that operating systems leave behind.
METADATA_FILES = (".DS_Store", "Thumbs.db", "ehthumbs.db", "ehthumbs_vista.db", "desktop.ini")
METADATA_FOLDERS = ("$RECYCLE.BIN", "$Recycle.Bin", "System Volume Information", ".Spotlight-V100", ".Trashes", ".AppleDouble", ".fseventsd", ".TemporaryItems")
# Device names that Windows reserves.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10)))
MOST_RENAMES = 9999


def parts(path: Column) -> Column:
    """A path in an archive split at either separator."""
    return F.split(path, r"[/\\]")


def is_system_metadata(path: Column) -> Column:
    """A shadow file, a file of the list as last component, or a folder of the list as any component; ASCII case ignored."""
    components = F.filter(F.split(path, "/"), lambda c: (c != "") & (c != "."))
    name = F.coalesce(F.try_element_at(components, F.lit(-1)), F.lit(""))
    folders = {f.lower() for f in METADATA_FOLDERS}
    by_name = (name != "..") & (name.startswith("._") | ascii_lower(name).isin(*(f.lower() for f in METADATA_FILES)))
    return F.coalesce(by_name | F.exists(components, lambda c: ascii_lower(c).isin(*sorted(folders))), F.lit(False))


def component_fault(c: Column) -> Column:
    """Why a component must not be written, null if it may."""
    stem = F.translate(F.split_part(c, F.lit("."), F.lit(1)), LOWER, UPPER)
    return (
        F.when(c == "", "empty component")
        .when(c.rlike(r"[\x00-\x1f\x7f]"), "control character")
        .when(c.contains("\\"), "backslash")
        .when(c.contains(":"), "colon")
        .when(stem.isin(*RESERVED), "reserved device name")
        .when(c.endswith(".") | c.endswith(" "), "trailing dot or space")
    )


def resolve_output(path: Column, is_directory: Column, flatten: bool = False) -> Column:
    """``struct<path, blocked>``: where an entry goes below the destination, or that it would leave it.

    An absolute path, a ``..`` and any faulty component block; empty and ``.`` components vanish. A
    directory may resolve to the destination itself (empty path), a file may not.
    """
    kept = F.filter(parts(path), lambda c: (c != "") & (c != "."))
    absolute = path.startswith("/") | path.startswith("\\")
    if flatten:
        last = F.try_element_at(kept, F.lit(-1))
        blocked = absolute | last.isNull() | (last == "..") | component_fault(last).isNotNull()
        target = last
    else:
        faulty = F.exists(kept, lambda c: (c == "..") | component_fault(c).isNotNull())
        blocked = absolute | faulty | ((F.size(kept) == 0) & ~is_directory)
        target = F.array_join(kept, "/")
    blocked = F.coalesce(blocked, F.lit(True))
    return F.struct(F.when(~blocked, target).alias("path"), blocked.alias("blocked"))


def top_component(path: Column) -> Column:
    """Text before the first separator of either kind, null without one."""
    return F.when(path.rlike(r"[/\\]"), F.regexp_extract(path, r"(?s)^([^/\\]*)[/\\]", 1))


def numbered(name: Column, number: Column) -> Column:
    """``stem (n).ext``; a name without extension gets the number at its end."""
    last = file_name(name)
    has = extension(name).isNotNull()
    folder = F.substring(name, F.lit(1), F.length(name) - F.length(last))
    stem = F.when(has, F.regexp_extract(last, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(last)
    ext = F.when(has, F.concat(F.lit("."), F.regexp_extract(last, r"(?s)^.+\.([^.]*)$", 1))).otherwise("")
    return F.concat(folder, stem, F.lit(" ("), number.cast("string"), F.lit(")"), ext)


def rename_collisions(entries: DataFrame, target: str, order: list[str], by: list[str], taken: DataFrame | None = None, out: str = "out_path") -> DataFrame:
    """Keep-both names: the first claim of a free target keeps it, later ones get ``(2)``, ``(3)``, ... where free.

    ``taken`` has ``by`` and ``path`` of files that exist, and any target of ``entries`` counts as taken as
    well, so a generated name never collides. After 9999 the target is kept. Claims of one target are a
    window; a numbered name that is itself taken is skipped by ranking the free numbers and the claims alike.
    """
    claims = entries.withColumn("_nth", F.row_number().over(W.partitionBy(*by, target).orderBy(*order)))
    names = entries.select(*by, F.col(target).alias("path")).distinct()
    if taken is not None:
        there = taken.select(*by, "path").distinct()
        names = names.unionByName(there).distinct()
        claims = claims.join(there.withColumn("_there", F.lit(True)).withColumnRenamed("path", target), [*by, target], "left")
        claims = claims.withColumn("_nth", F.col("_nth") + F.when(F.col("_there"), 1).otherwise(0)).drop("_there")
    need = claims.groupBy(*by, target).agg(F.max("_nth").alias("_most")).where("_most > 1")
    # a taken number moves later claims up by one: as many spare numbers as names that look like numbered forms of the target
    shape = names.select(*by, F.regexp_replace("path", r" \(\d+\)(?=(\.[^./]*)?$)", "").alias(target)).groupBy(*by, target).agg(F.count("*").alias("_used"))
    need = need.join(shape, [*by, target], "left")
    upto = F.least(F.lit(MOST_RENAMES), F.col("_most") + F.coalesce("_used", F.lit(0)) + 1).cast("int")
    tries = need.withColumn("_i", F.explode(F.sequence(F.lit(2), upto)))
    tries = tries.withColumn("_name", numbered(F.col(target), F.col("_i")))
    free = tries.join(names.withColumnRenamed("path", "_name"), [*by, "_name"], "left_anti")
    free = free.withColumn("_nth", F.row_number().over(W.partitionBy(*by, target).orderBy("_i")) + 1).select(*by, target, "_nth", "_name")
    named = claims.join(free, [*by, target, "_nth"], "left")
    return named.withColumn(out, F.coalesce(F.when(F.col("_nth") > 1, F.col("_name")), F.col(target))).drop("_nth", "_name")


def symlink_fault(link: Column, target: Column) -> Column:
    """Why a link must not be made, null if it may: its target is walked from the link's own folder."""
    start = F.size(F.filter(F.split(link, "/"), lambda c: (c != "") & (c != "."))) - 1
    first = F.struct(F.greatest(start, F.lit(0)).alias("depth"), F.lit(False).alias("out"))

    def step(at: Column, c: Column) -> Column:
        depth = at["depth"] + F.when(c == "..", -1).when((c == "") | (c == "."), 0).otherwise(1)
        return F.struct(depth.alias("depth"), (at["out"] | (depth < 0)).alias("out"))

    walked = F.aggregate(parts(target), first, step)
    return (
        F.when(target.isNull() | (target == ""), "EmptyTarget")
        .when(target.startswith("/") | target.startswith("\\"), "AbsoluteTarget")
        .when(walked["out"], "EscapesRoot")
    )


def entry_name(prefix: Column, relative: Column) -> Column:
    """A name in the archive below a prefix; separators become ``/``, an empty side leaves the other."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", "/"), "^/+|/+$", "")
    return F.concat_ws("/", F.nullif(clean(prefix), F.lit("")), F.nullif(clean(relative), F.lit("")))


def stream_name(path: Column, suffix: str) -> Column:
    """The name of a single stream's one entry: the suffix stripped, or ``.out`` added."""
    name = file_name(path)
    has = ascii_lower(name).endswith("." + suffix) & (F.length(name) > len(suffix) + 1)
    return F.when(has, F.substring(name, F.lit(1), F.length(name) - len(suffix) - 1)).otherwise(F.concat(name, F.lit(".out")))


def compound_file_path(path: Column) -> Column:
    """A storage path without leading separator, with ``/``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/", "")


def ar_name(raw: Column) -> Column:
    """A member name of an ar archive: padding off, then one slash."""
    return F.regexp_replace(F.regexp_replace(raw, r"[ \x00]+$", ""), "/$", "")
