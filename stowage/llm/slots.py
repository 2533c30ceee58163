"""Sharding by fixed virtual slots.

A record hashes into one of a few thousand slots for good. Bytes are summed by slot, and a versioned map
says which shard holds which slot. The first version deals slots evenly; each run reads the latest
version, edits it by the bytes (moves slots from full shards to light ones) and stores the edit as the
next one, so that readers of an older version stay consistent and only moved slots travel. A version is
never written twice. The law held is ``bytes``: shard sizes near equal.

Hot keys: the slot is the hash of id and text, so a third of rows with one id still spreads. Rows equal in
both would share a slot; where such a group outweighs ``HEAVY`` of a slot's fair share, each of its rows
is hashed with its number in the table written first. Only slots over that share are searched for such
groups, so the groups found are at most ``slots / HEAVY``. Everything on the driver is a row a slot.

Defined results: a null text has size 1 and the crc of the empty string; null ids hash as null; repeated
rows have positions of their own; an empty table gives an even map and no rows; columns other than id
and text are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.session import scratch, written

SLOTS, SHARDS = 4096, 16
#: Share of a slot's fair part of all bytes that equal rows may hold together.
HEAVY = 0.25


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def even_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    return [k % shards for k in range(slots)]


def rebalance(old: list[int], weight: dict[int, int], shards: int = SHARDS) -> list[int]:
    """The map edited: shards above the mean give up slots, lightest slots last, which go to the lightest shards.

    Then single slots move, or swap, between the fullest and the lightest shard while that narrows the gap.
    ``old`` may be of another number of shards: those that are no more give up all slots.
    """
    new, load = list(old), [0] * shards
    mean = sum(weight.values()) / shards
    held: list[list[int]] = [[] for _ in range(shards)]
    pool = []
    for slot, shard in enumerate(old):
        (held[shard] if shard < shards else pool).append(slot)
    for shard, own in enumerate(held):
        own.sort(key=lambda s: (-weight.get(s, 0), s))
        kept = []
        for s in own:
            if load[shard] + weight.get(s, 0) <= mean or not kept and weight.get(s, 0) >= mean:
                kept.append(s)
                load[shard] += weight.get(s, 0)
            else:
                pool.append(s)
        held[shard] = kept
    light = [(w, k) for k, w in enumerate(load)]
    heapq.heapify(light)
    for s in sorted(pool, key=lambda s: (-weight.get(s, 0), s)):
        w, k = heapq.heappop(light)
        new[s] = k
        held[k].append(s)
        heapq.heappush(light, (w + weight.get(s, 0), k))
    for w, k in light:
        load[k] = w
    for _ in range(4 * shards):
        full, low = max(range(shards), key=lambda k: (load[k], k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[full] - load[low]
        give = [(weight.get(s, 0), s) for s in held[full]]
        take = [(0, -1), *((weight.get(s, 0), s) for s in held[low])]
        best = _nearest(give, take, gap / 2)
        if best is None or not 0 < best[0] < gap:
            break
        change, a, b = best
        load[full], load[low] = load[full] - change, load[low] + change
        held[full].remove(a)
        held[low].append(a)
        new[a] = low
        if b >= 0:
            held[low].remove(b)
            held[full].append(b)
            new[b] = full
    return new


def _nearest(give: list[tuple[int, int]], take: list[tuple[int, int]], want: float) -> tuple[int, int, int] | None:
    """The exchange whose difference of weights is nearest ``want``, found by two sorted walks."""
    give, take, j, best = sorted(give), sorted(take), 0, None
    for w, a in give:
        while j + 1 < len(take) and w - take[j + 1][0] >= want:
            j += 1
        for k in (j, j + 1):
            if k < len(take) and w > take[k][0] and (best is None or abs(w - take[k][0] - want) < abs(best[0] - want)):
                best = (w - take[k][0], a, take[k][1])
    return best


def store_map(spark: SparkSession, path: str, version: int, slot_map: list[int]) -> None:
    rows = [(k, s) for k, s in enumerate(slot_map)]
    spark.createDataFrame(rows, "slot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.schema("slot int, shard int").parquet(f"{path}/version={version}").collect()
    return [r.shard for r in sorted(rows)]


def latest(spark: SparkSession, path: str) -> int | None:
    """The newest complete version below ``path``; None if there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    found = [f.getPath() for f in files.listStatus(folder)]
    done = [int(p.getName()[8:]) for p in found if p.getName().startswith("version=") and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def spread(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows(id, crc, size, row)`` with ``virtual_slot``: by id and crc, and by the row as well in groups of equal rows that outweigh a slot."""
    rows = rows.withColumn("virtual_slot", slot_of(F.col("id"), F.col("crc"), slots=slots))
    sums = {r.virtual_slot: r["sum(size)"] for r in rows.groupBy("virtual_slot").sum("size").collect()}
    most = HEAVY * sum(sums.values()) / slots
    full = [k for k, w in sums.items() if w > max(most / HEAVY, 1) * 2]
    if not full:
        return rows
    again = rows.where(F.col("virtual_slot").isin(full)).groupBy("id", "crc").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    heavy = written(again.where((F.col("n") > 1) & (F.col("bytes") > most)).select(F.col("id").alias("h_id"), F.col("crc").alias("h_crc")), "heavy")
    marked = rows.join(F.broadcast(heavy), F.col("id").eqNullSafe(F.col("h_id")) & (F.col("crc") == F.col("h_crc")), "left")
    own = slot_of(F.col("id"), F.col("crc"), F.col("row"), slots=slots)
    return marked.withColumn("virtual_slot", F.when(F.col("h_crc").isNotNull(), own).otherwise(F.col("virtual_slot"))).drop("h_id", "h_crc")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """``id, size, text_crc32, virtual_slot, shard, slot, version``: slot is the row's place in its shard, gapless from 0.

    The map below ``map_path`` is edited and its next version written and used; without a path the map is a
    temporary one. The text is read once, for its size and crc; places come from counts by virtual slot and from
    the order within one.
    """
    spark = docs.sparkSession
    path = map_path or scratch(spark, "slot_map")
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("crc"))
    rows = spread(written(rows.withColumn("row", F.monotonically_increasing_id()), "records"), slots)
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    version = latest(spark, path)
    if version is None:
        version = 0
        store_map(spark, path, version, even_map(slots, shards))
    old = load_map(spark, path, version)
    if len(old) != slots:
        raise ValueError(f"the map below {path} has {len(old)} slots, not {slots}: the number of slots is fixed for good")
    version += 1
    store_map(spark, path, version, rebalance(old, {r.virtual_slot: r.size for r in sums}, shards))
    slot_map = load_map(spark, path, version)
    seen, first = [0] * shards, {}
    for r in sorted(sums):
        first[r.virtual_slot] = seen[slot_map[r.virtual_slot]]
        seen[slot_map[r.virtual_slot]] += r.n
    places = spark.createDataFrame([(k, s, first.get(k, 0)) for k, s in enumerate(slot_map)], "of int, shard int, first long")
    at = F.row_number().over(W.partitionBy("virtual_slot").orderBy("id", "crc", "size", "row")) - 1
    rows = rows.withColumn("at", at).join(F.broadcast(places), F.col("virtual_slot") == F.col("of"))
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "virtual_slot", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), F.lit(version).alias("version"))
