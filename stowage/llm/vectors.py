"""What the vector operators share: which vectors take part, distinct vectors, packs of rows for matrix work."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.session import written

#: Rows in a pack: small enough that a few thousand rows make many packs, large enough for matrix products.
PACK = 512


def sound(vec: Column, dimensions: int) -> Column:
    """Whether a vector takes part: of the given length, every component there and finite, not all zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vec) == dimensions) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def dimensions_of(df: DataFrame, vec_col: str) -> int:
    """The commonest length of a vector (the shorter of equally common ones); vectors of another length take no part."""
    n = F.size(F.col(vec_col))
    top = df.where(n > 0).groupBy(n.alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return top[0].n if top else 0


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def distinct_vectors(df: DataFrame, id_col: str, vec_col: str, ids_kept: int) -> DataFrame:
    """``key, n, ids, vec``: distinct vectors, how many rows hold each, their ``ids_kept`` smallest ids in order.

    Equal vectors meet within their task first, so a vector that a third of all rows hold is shuffled as
    one short row a task. Written; ``key`` numbers the rows and is fixed by that.
    """
    vec_type = df.schema[vec_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            rows = list(seen.items())
            seen.clear()
            vecs = pa.array([np.frombuffer(v, dtype) for v, _ in rows], pa.list_(value_type))
            n = pa.array([x[0] for _, x in rows], pa.int64())
            return pa.RecordBatch.from_arrays([vecs, n, pa.array([sorted(-i for i in x[1]) for _, x in rows], pa.list_(pa.int64()))], ["vec", "n", "ids"])

        value_type = dtype = None
        for batch in batches:
            value_type = batch.column(1).type.value_type
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0  # -0 becomes 0
            x = x.reshape(batch.num_rows, -1)
            dtype = x.dtype
            for i, row in zip(batch.column(0).to_pylist(), x, strict=True):
                own = seen.setdefault(row.tobytes(), [0, []])
                own[0] += 1
                if len(own[1]) < ids_kept:
                    heapq.heappush(own[1], -i)
                elif -i > own[1][0]:
                    heapq.heapreplace(own[1], -i)
            if len(seen) > 50_000:
                yield flush()
        if seen:
            yield flush()

    parts = df.select(id_col, vec_col).mapInArrow(run, f"vec {vec_type}, n long, ids array<long>")
    whole = parts.groupBy("vec").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("ids")).alias("ids"))
    whole = whole.select("n", F.slice(F.sort_array("ids"), 1, ids_kept).alias("ids"), "vec")
    return written(whole.select(F.monotonically_increasing_id().alias("key"), "*"), "distinct")


def sample_of(vectors: DataFrame, total: int, size: int, dimensions: int) -> np.ndarray:
    """About ``size`` vectors of those of ``distinct_vectors`` (all, if fewer), those of the least hashes: the same in every run."""
    share = max(1, -(-total // size))
    order = F.xxhash64(F.lit(1), "vec")
    rows = vectors.where(F.pmod(F.xxhash64("vec"), F.lit(share)) == 0).select("vec", order.alias("at")).orderBy("at").limit(2 * size)
    column = rows.select("vec").toArrow().column(0).combine_chunks()
    x = matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, dimensions)
    return x[np.lexsort(x.T)] if len(x) else x


def packs(rows: DataFrame, key: str, name: str, payload: list[str], size: int = PACK) -> DataFrame:
    """Rows grouped by ``key`` into packs of about ``size``: ``key, name`` with ``name`` a list of the payload structs.

    Rows of a key are dealt over as many packs as its count needs, so no task gathers a large key. The
    counts, a row a key, are written first, so that Spark sends them to all tasks only if they are small.
    """
    counts = rows.groupBy(F.col(key).alias("of")).agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    counts = written(counts, "counts")
    dealt = rows.join(counts, F.col(key) == F.col("of"))
    part = F.pmod(F.xxhash64(F.lit(7), F.col(payload[0])), F.col("parts"))
    return dealt.groupBy(key, part.alias("part")).agg(F.collect_list(F.struct(*payload)).alias(name)).drop("part")
