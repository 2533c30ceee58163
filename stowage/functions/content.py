"""Functions of payloads that need a codec or a parser: Arrow batches, no rows in Python loops of Spark's making."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.errors import ArchiveError
from stowage.formats.names import RawName, decode_name, detect_codepage
from stowage.formats.write import PROBE_RATIOS, probe_ratio
from stowage.formats.zip import PREFLIGHT, preflight


@F.pandas_udf(T.DoubleType())
def deflate_ratio(content: pd.Series) -> pd.Series:
    """Mean deflate ratio of up to three samples of each payload; null below 4 KiB."""
    return content.map(lambda b: None if b is None else probe_ratio(bytes(b))).astype("float64")


def incompressible(content: Column) -> Column:
    """Whether the probe says that deflating a payload is not worth it; larger payloads need less of a ratio."""
    size, least = F.octet_length(content), F.lit(None).cast("double")
    for at, ratio in reversed(PROBE_RATIOS):
        least = F.when(size >= at, ratio).otherwise(least)
    return F.coalesce(deflate_ratio(content) >= least, F.lit(False))


@F.pandas_udf(T.StringType())
def _preflight(tail: pd.Series, size: pd.Series) -> pd.Series:
    def look(b: bytes, n: int) -> str | None:
        try:
            preflight(bytes(n - len(b)) + b if n < 1 << 20 else _Far(b, n))
        except ArchiveError as e:
            return e.message
        return None

    return pd.Series([look(bytes(b or b""), int(n or 0)) for b, n in zip(tail, size, strict=True)], dtype="object")


class _Far(bytes):
    """A long file of which only the tail is there."""

    def __new__(cls, tail: bytes, size: int):
        out = super().__new__(cls, tail)
        out.size = size
        return out

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if isinstance(at, slice) and at.start is not None and at.start >= 0:
            shift = self.size - super().__len__()
            return b"" if at.start < shift else super().__getitem__(slice(at.start - shift, at.stop - shift if at.stop is not None else None))
        return super().__getitem__(at)


def zip_fault(content: Column) -> Column:
    """Why the last bytes of a file do not end a ZIP, null if they do; only the tail goes to Python."""
    n = F.octet_length(content)
    return _preflight(F.substring(content, F.greatest(F.lit(1), n - PREFLIGHT + 1), F.lit(PREFLIGHT)), n)


def decode_archive_names(names: DataFrame, override: str | None = None) -> DataFrame:
    """Adds ``path`` and ``codepage`` to ``archive, seq, raw, utf8_flag, unicode_path``: the code page is decided by archive.

    Names of an archive are dealt to one task and stream through it in order; one archive's are held.
    """
    rows = names.select("archive", "seq", "raw", "utf8_flag", "unicode_path").repartition("archive").sortWithinPartitions("archive", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            own = [RawName(bytes(r[2] or b""), bool(r[3]), r[4]) for r in held]
            page = detect_codepage(own, override)
            cols = [pa.array([r[0] for r in held], pa.string()), pa.array([r[1] for r in held], pa.int64()), pa.array([decode_name(n, page) for n in own], pa.string()), pa.array([page] * len(held), pa.string())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["archive", "seq", "path", "codepage"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != r[0]:
                    yield done()
                held.append(r)
        if held:
            yield done()

    return rows.mapInArrow(run, "archive string, seq long, path string, codepage string")
