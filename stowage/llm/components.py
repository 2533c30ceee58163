"""Connected components by alternating large and small stars, in DataFrames.

Each round points every node's neighbours at the least node seen among them; the number of rounds grows
with the logarithm of the component sizes. Minima are pre-aggregated and written before they are joined
back, so that a hub's edges form a plain skewed join, which adaptive execution splits; lineage is cut in
the shared folder. Only a count and a checksum come to the driver.

Defined results: edges with a null end are left out; self links name their node; repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.session import drop, scratch


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, root``: every node of ``edges`` with the least node that it reaches."""
    spark = edges.sparkSession
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(hi, lo).distinct()

    def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    first, _ = cut(known, "links")
    state, path, before = first.where("hi > lo"), None, None
    for left in range(most_rounds, -1, -1):
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if mark == before or mark[0] == 0:
            break
        if not left:
            raise RuntimeError(f"components still change after {most_rounds} rounds")
        before = mark
        both = state.union(state.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least, p1 = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).where("v > m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large, p2 = cut(large, "large")
        small, p3 = cut(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "w"), "small")
        near = large.join(small, F.col("hi") == F.col("w")).where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        state, p4 = cut(near.union(small.select("w", "m")).distinct(), "state")
        for p in (p1, p2, p3, path):
            if p:
                drop(spark, p)
        path = p4
    rooted = state.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    nodes = first.select(F.explode(F.array("hi", "lo")).alias("n")).distinct()
    return nodes.join(rooted, F.col("n") == F.col("node"), "left").select(F.col("n").alias("node"), F.coalesce("root", "n").alias("root"))
