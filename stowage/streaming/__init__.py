"""Archives that arrive in a folder, as a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.sources.archive import entries

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_archives(spark: SparkSession, path: str, pattern: str = "*", password: str | None = None, content: bool = False, per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame of entries: each new file is one archive, parsed once."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)
    return entries(files.select("path", "content"), password=password, content=content)


def arrivals(found: DataFrame, delay: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Entries and bytes by the window of their own times; entries later than ``delay`` are not counted any more."""
    timed = found.where(F.col("modified").isNotNull()).withWatermark("modified", delay)
    return timed.groupBy(F.window("modified", window), "format").agg(F.count("*").alias("entries"), F.sum("uncompressed_size").alias("bytes"))
