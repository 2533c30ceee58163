"""Session helpers shared by the operators: tables, the shared folder, written cuts of lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and all runs on this machine (local tests), a temporary folder is made and set, for the
    session's life; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stowage-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(_remove, spark, base)
    return base.rstrip("/")


#: The paths made in each open ``tidied`` block.
_blocks: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when its ``tidied`` block or the driver ends."""
    path = f"{shared_dir(spark)}/stowage-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path.rsplit("/", 1)[0])
    if _blocks:
        _blocks[-1].append(path.rsplit("/", 1)[0])
    return path


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Removes at the end the scratch paths that were made within; what is still to be read must lie elsewhere by then."""
    _blocks.append([])
    try:
        yield
    finally:
        for path in _blocks.pop():
            _remove(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a scratch path that nothing reads any more."""
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended first; the folder is scratch space
        return


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` as a table written to the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
