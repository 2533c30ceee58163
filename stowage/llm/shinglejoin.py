"""Near-duplicate texts: an exact Jaccard join of word shingles by grouped prefixes.

Texts with equal shingle sets form a *class*; classes of equal size and equal prefix form a *group*. In
any fixed order of shingles, two sets of similarity t or more share one of their first n - ceil(t n) + 1,
so only prefixes are matched, and of a group only once. Shingles that many texts hold stand last in the
order, so that passages and lines that unrelated documents share stay out of prefixes.

A list of more than ``WIDE`` rows is taken up only for pairs that could be similar by wide lists alone: sets
share a least part of their prefixes, one that holds fewer shingles of wide lists must meet its partner in a
narrow list as well, and one of the shared shingles stands early in both.

Whether two documents are in one component does not need all pairs of a group of near copies. First each
group is verified against two groups that it meets most often in the lists of its prefix shingles. Then
the lists that still hold several components are taken up again, and every pair of members of different
components that passes the size filter and may share enough of its prefixes is verified. So no link
between components is lost, and none within a component is needed.

Shingles and words are 64-bit hashes; sets are compared in full. Pairs are found by one family of hashes and
verified by another, and texts count as equal only if they agree in both. The order only steers the amount of
work: a shingle is frequent if several texts of one task hold it, summed over all tasks and texts, and
kept in bitmaps of fixed size.

Defined results: a text's words are split at ASCII white space, A-Z lower-cased; one with fewer than
``size`` words has its whole sequence as its one shingle; null or empty texts have no shingles and link
with nothing; of repeated ids each row counts its own shingles and the id is one node; a null id is no
node, its row gets the component of its class (null if nothing else is in it); columns other than id and
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.llm.components import components
from stowage.llm.memory import release, small_batches
from stowage.session import drop, written

SIZE, PERCENT = 5, 75
#: Texts (several in one task) that must hold a shingle for each step back in the order.
FREQUENT = (12, 96, 768, 6144)
#: Bits of each bitmap of frequent shingles, and of the filter for the texts to be verified. A fuller map moves
#: more shingles back, or lets more texts through; neither changes a result.
MAP_BITS, TEXT_BITS = 22, 24
#: Bytes of text that are turned into shingles at once, and of the longest word that is mixed in eight at a time.
SLICE, WORD = 1 << 20, 128
#: Rows of a list from which it counts as wide.
WIDE = 8
#: Shingles that a task compares at once when it looks for frequent ones.
CHUNK = 4 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _avalanche(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Words and shingles of many texts at once, as 64-bit hashes of the families that ``seeds`` number.

    A word, with A-Z as a-z, is mixed in eight bytes at a time, after its length; one of more than ``WORD``
    bytes goes through BLAKE2. Texts are joined by blanks and cut at white space into stretches of about
    ``SLICE`` bytes.
    """

    def __init__(self, size: int, seeds: tuple[int, ...] = (0,)):
        self.size, self.seeds = size, seeds
        self.keys = [np.random.default_rng(20 + seed).integers(0, 1 << 63, 3, np.uint64) * np.uint64(2) + np.uint64(1) for seed in seeds]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] = self.low[97:123]
        self.masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def _words(self, data: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Hashes, by family, and starts of the words of a stretch."""
        gap = self.space[data]
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        starts, left = edge[::2], edge[1::2] - edge[::2]
        low = np.concatenate([self.low[data], np.zeros(8, np.uint8)])
        blocks = np.ndarray(len(data) + 1, "<u8", low, strides=(1,))
        out = [_avalanche(left.astype(np.uint64) * k[0]) for k in self.keys]
        live, at, n = np.flatnonzero(left <= WORD), starts, left
        at, n = at[live], n[live]
        while len(live):
            x = blocks[at] & self.masks[np.minimum(n, 8)]
            for h, k in zip(out, self.keys, strict=True):
                h[live] = _avalanche(h[live] ^ x * k[1])
            on = n > 8
            live, at, n = live[on], at[on] + 8, n[on] - 8
        for w in np.flatnonzero(left > WORD).tolist():
            word = low[starts[w] : starts[w] + left[w]].tobytes()
            for h, seed in zip(out, self.seeds, strict=True):
                h[w] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([seed])).digest(), "little")
        return out, starts

    def shingles(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
        """All texts' shingles, by family, and where each text's lie; the one of a text of few words stands behind all others."""
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        data = np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]), np.uint8)
        hashes, starts, at = [[np.empty(0, np.uint64)] for _ in self.seeds], [np.empty(0, np.int64)], 0
        while at < len(data):
            end = min(at + SLICE, len(data))
            while end < len(data):
                back = np.flatnonzero(self.space[data[at:end]])
                if len(back):
                    end = at + int(back[-1]) + 1
                    break
                end = min(end + SLICE, len(data))
            own, s = self._words(data[at:end])
            for have, h in zip(hashes, own, strict=True):
                have.append(h)
            starts.append(s + at)
            at = end
        upto = np.searchsorted(np.concatenate(starts), np.cumsum(sizes)).tolist()
        spans, few, at = [], [], 0
        whole = max((upto[-1] if upto else 0) - self.size + 1, 0)
        for to in upto:
            n = to - at
            if n >= self.size:
                spans.append((at, to - self.size + 1))
            elif n:
                spans.append((whole + len(few), whole + len(few) + 1))
                few.append((at, to))
            else:
                spans.append((0, 0))
            at = to
        out = []
        for have, k in zip(hashes, self.keys, strict=True):
            w = np.concatenate(have)
            h = np.full(whole + len(few), np.uint64(self.size))
            for j in range(self.size):
                h[:whole] = h[:whole] * k[2] + w[j : j + whole]
            for j, (low, high) in enumerate(few):
                one = np.array([high - low], np.uint64)
                for x in w[low:high]:
                    one = one * k[2] + x
                h[whole + j] = one[0]
            out.append(_avalanche(h))
        return out, spans

    def sets(self, texts: list[bytes | None], sums: bool = False):
        """For each UTF-8 text its sorted distinct shingles of the first family; with ``sums`` also the sum of all its shingles of the second."""
        hashes, spans = self.shingles(texts)
        out, h = [], hashes[0].view(np.int64)
        for low, high in spans:
            own = np.sort(h[low:high])
            if high - low > 1:
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
            out.append(own)
        return (out, [int(hashes[1][low:high].sum()) for low, high in spans]) if sums else out


def prefix_length(n, percent: int = PERCENT, floor=int):
    """How many elements of a set of ``n``, a number or a column, are its prefix."""
    return n - floor((percent * n + 99) / 100) + 1


def needed(n1, n2, percent: int = PERCENT):
    """The least intersection of sets of these sizes: 100 i >= p (n1 + n2 - i)."""
    return (percent * (n1 + n2) + 99 + percent) // (100 + percent)


class Order:
    """The order of shingles: by how frequent, then by hash."""

    def __init__(self, maps: list[np.ndarray]):
        self.maps = maps

    def levels(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.uint64) & np.uint64((1 << MAP_BITS) - 1)
        out = np.zeros(len(h), np.int8)
        for m in self.maps:
            out += (m[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(np.int8)
        return out

    def prefixes(self, sets: list[np.ndarray], percent: int) -> tuple[list[np.ndarray], list[int]]:
        """Of each set the first elements in the order, as many as similar sets must share one of; how many are not frequent."""
        levels, out, rare, at = self.levels(np.concatenate([np.empty(0, np.int64), *sets])), [], [], 0
        for h in sets:
            own, p = levels[at : at + len(h)], prefix_length(len(h), percent) if len(h) else 0
            out.append(h[np.argsort(own, kind="stable")[:p]] if own.any() else h[:p])
            rare.append(min(p, len(h) - int(np.count_nonzero(own))))
            at += len(h)
        return out, rare


def _slices(batch: pa.RecordBatch, column: int, rows: int = 256) -> Iterator[tuple[int, list[bytes | None]]]:
    """A batch's texts in small parts, with where each begins: only a part is held as Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield at, batch.column(column).slice(at, rows).cast(pa.binary()).to_pylist()


def _bitmap(rows: DataFrame, bit: str, bits: int, *by: str) -> dict[tuple, np.ndarray]:
    """Bitmaps of ``bits`` bits for each value of ``by``, of the bit numbers in column ``bit``."""
    words = rows.groupBy(*by, F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({bit} & 63 as int))")).alias("m"))
    out: dict[tuple, np.ndarray] = {}
    for r in words.collect():
        out.setdefault(tuple(r[k] for k in by), np.zeros(1 << (bits - 6), np.uint64))[r.w] = np.uint64(r.m & 0xFFFFFFFFFFFFFFFF)
    return out


def find_order(docs: DataFrame, text_col: str, size: int = SIZE) -> Order:
    """Looks at every shingle of every text: those that several texts of a stretch of a task hold are summed by count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = Hasher(size), [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([np.empty(0, np.int64), *held])
            held.clear()
            h.sort()
            again, count = np.unique(h[1:][h[1:] == h[:-1]], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(again), pa.array(count + 1)], ["h", "n"])

        for batch in batches:
            for _, texts in _slices(batch, 0):
                for s in hasher.sets(texts):
                    held.append(s)
                    n += len(s)
                if n >= CHUNK:
                    yield flush()
                    n = 0
        yield flush()
        release()

    seen = docs.select(text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT[0])
    level = sum((F.col("n") >= least).cast("int") for least in FREQUENT)
    steps = seen.select(F.explode(F.sequence(F.lit(1), level)).alias("level"), (F.col("h").bitwiseAND((1 << MAP_BITS) - 1)).alias("bit"))
    return Order(list(_bitmap(steps, "bit", MAP_BITS, "level").values()))


def _sketch(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, order: Order) -> DataFrame:
    """``id, n, sig, gkey, rare, prefix`` of every text; of equal groups in a task only the first row with an id carries its prefix."""
    known = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, told = Hasher(size, (0, 1)), set()
        for batch in batches:
            for at, texts in _slices(batch, 1):
                sets, sums = hasher.sets(texts, sums=True)
                sigs, keys, prefixes = [], [], []
                found, rare = known.value.prefixes(sets, percent)
                ids = batch.column(0).slice(at, len(texts))
                for h, more, p, named in zip(sets, sums, found, ids.is_valid().to_pylist(), strict=True):
                    sigs.append(hashlib.blake2b(h.tobytes() + more.to_bytes(8, "little"), digest_size=16).digest())
                    keys.append(int.from_bytes(hashlib.blake2b(p.tobytes(), digest_size=8).digest(), "little", signed=True))
                    tells = named and len(h) > 0 and (keys[-1], len(h)) not in told
                    prefixes.append(p if tells else None)
                    if tells:
                        told.add((keys[-1], len(h)))
                cols = [ids, pa.array([len(h) for h in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.int64()), pa.array(rare, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "sig", "gkey", "rare", "prefix"])
        del hasher, told
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, n long, sig binary, gkey long, rare long, prefix array<long>")


def _lists(sketch: DataFrame) -> DataFrame:
    """Prefix shingles that several groups share: ``token, np, gkey``, and of the list the group before and the first one.

    ``np`` is the size times 2^32 plus the place in the prefix. A list is sorted by how many shingles of the
    prefix are not frequent, so that the first one, the hub, is the least edited of a family of near copies.
    The rows are dealt by ranges of that order, so that a long list lies over many tasks, and stream through each;
    a list is never held. Of a list that may go on in the next task no row is left out, and each task's part has a
    hub of its own.
    """
    rows = sketch.select("gkey", "n", "rare", F.posexplode("prefix").alias("pos", "token"))
    rows = rows.select("token", "rare", (F.shiftleft("n", 32) + F.col("pos")).alias("np"), "gkey")
    order = ("token", "rare", "np", "gkey")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("token", "np", "gkey")
    names = ["token", "np", "gkey", "prev_np", "prev_gkey", "hub_np", "hub_gkey"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3  # the last row, not yet given out, and before it the one before, given out
        hub = (None, 0, 0)
        context, head = 0, None

        def give(cols: list[np.ndarray], upto: int, ended: bool = False) -> pa.RecordBatch:
            nonlocal hub, head
            token, place, key = cols
            head = token[0] if head is None else head
            same = np.concatenate([[False], token[1:] == token[:-1]])
            first = np.flatnonzero(~same)[np.cumsum(~same) - 1]
            hub_place, hub_key = place[first], key[first]
            if token[0] == hub[0]:
                hub_place[first == 0], hub_key[first == 0] = hub[1:]
            hub = (token[upto - 1], hub_place[upto - 1], hub_key[upto - 1])
            shared = same | np.append(same[1:], False) | (token == head)
            if ended:
                shared |= token == token[-1]
            shared[:context] = False
            shared[upto:] = False
            at = np.flatnonzero(shared)
            none = ~same[at]
            idle = none | ((hub_place[at] == place[at - 1]) & (hub_key[at] == key[at - 1]))
            cols = [pa.array(token[at]), pa.array(place[at]), pa.array(key[at]), pa.array(place[at - 1], mask=none), pa.array(key[at - 1], mask=none), pa.array(hub_place[at], mask=idle), pa.array(hub_key[at], mask=idle)]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            cols = [np.concatenate([a, b.to_numpy(zero_copy_only=False)]) for a, b in zip(held, batch.columns, strict=True)]
            again = np.ones(len(cols[0]), bool)
            for c in cols:
                again[1:] &= c[1:] == c[:-1]
            again[:1] = False
            cols = [c[~again] for c in cols]
            if len(cols[0]) > context + 1:
                yield give(cols, len(cols[0]) - 1)
                context = 1
                cols = [c[-2:] for c in cols]
            held = cols
        if len(held[0]):
            yield give(held, len(held[0]), True)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar enough; only texts in pairs are turned into sets again."""
    kind = docs.schema[id_col].dataType.simpleString()
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << TEXT_BITS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    filled = docs.sparkSession.sparkContext.broadcast(_bitmap(ids.select(spot.alias("bit")), "bit", TEXT_BITS).get((), np.zeros(1 << (TEXT_BITS - 6), np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = Hasher(size, (1,)), filled.value
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            own = batch.filter(pa.array((m[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))
            for k, texts in _slices(own, 2):
                yield pa.RecordBatch.from_arrays([own.column(0).slice(k, len(texts)), pa.array(hasher.sets(texts), pa.list_(pa.int64()))], ["id", "x"])
        del hasher
        release()

    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_col).select("id", spot.alias("spot"), text_col)
    sets = written(known.mapInArrow(run, f"id {kind}, x array<long>"), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    inter = F.size(F.array_intersect("x", "y"))
    return written(both.where(inter * (100 + percent) >= percent * (F.size("x") + F.size("y"))).select("a", "b").distinct(), "links")


def _least_shared(n1, n2, percent: int):
    """The least intersection, as a column."""
    return F.floor((percent * (n1 + n2) + 99 + percent) / (100 + percent))


def _least_in_prefix(small, large, percent: int):
    """Similar sets of these sizes share more than so many elements of their prefixes.

    They share percent / (100 + percent) of both sizes' sum; of those at most percent / 100 of the larger
    size stand behind the prefix that ends first.
    """
    return percent * ((small + large) / (100 + percent) - large / 100)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row."""
    small_batches(docs)
    whole = written(_sketch(docs, id_col, text_col, size, percent, find_order(docs, text_col, size)), "whole")
    lists = written(_lists(whole.where("prefix is not null and id is not null")), "lists")
    sketch = written(whole.drop("prefix", "rare"), "sketch")
    drop(docs.sparkSession, whole.inputFiles()[0].rsplit("/", 1)[0]) if not whole.isEmpty() else None
    some = sketch.where("n > 0 and id is not null")
    classes = written(some.groupBy("sig").agg(F.min("id").alias("sid"), F.max("n").alias("n"), F.max("gkey").alias("gkey")), "classes")
    member = classes.select("sid", F.col("n").alias("m_n"), F.col("gkey").alias("m_key"))
    groups = written(classes.groupBy("gkey", "n").agg(F.min("sid").alias("rep"), F.count("*").alias("members")), "groups")
    several = groups.where("members > 1").select(F.col("gkey").alias("s_key"), F.col("n").alias("s_n"))

    # First links: of the groups before it and the hubs of its lists, each group with the two that it meets most
    # often, and a group's classes in a row. A pair that meets in too few lists is left to the second part.
    size_of, place_of = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF))
    n1, n2 = size_of("np"), size_of("o_np")
    met = lists.select("gkey", "np", F.explode(F.array(*(F.struct(F.col(f"{x}_np").alias("np"), F.col(f"{x}_gkey").alias("gkey")) for x in ("prev", "hub")))).alias("o"))
    met = met.select("gkey", "np", F.col("o.np").alias("o_np"), F.col("o.gkey").alias("o_gkey")).where(F.col("o_np").isNotNull() & (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)))
    follows = met.groupBy("gkey", n1.alias("n"), F.col("o_gkey").alias("p_key"), n2.alias("p_n")).count()
    follows = follows.where(F.col("count") * 32 >= F.col("n"))
    rank = F.row_number().over(W.partitionBy("gkey", "n").orderBy(F.desc("count"), "p_n", "p_key"))
    follows = follows.withColumn("at", rank).where("at <= 2").drop("at", "count")
    first = groups.select(F.col("gkey").alias("p_key"), F.col("n").alias("p_n"), F.col("rep").alias("a"))
    pairs = follows.join(first, ["p_key", "p_n"]).join(groups.select("gkey", "n", F.col("rep").alias("b")), ["gkey", "n"]).select("a", "b")
    inner = member.join(several, (F.col("m_key") == F.col("s_key")) & (F.col("m_n") == F.col("s_n")), "left_semi")
    inner = inner.withColumn("before", F.lag("sid").over(W.partitionBy("m_key", "m_n").orderBy("sid"))).where("before is not null")
    pairs = written(pairs.union(inner.select("before", "sid")).where("a <> b").distinct(), "pairs")
    links = _verified(pairs, docs, id_col, text_col, size, percent)
    # A repeated id with different texts is one node: it links the classes that hold it, which other ids may name.
    torn = written(some.groupBy(F.col("id").alias("t")).agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi").select("t"), "torn")
    if not torn.isEmpty():
        held = some.join(torn, F.col("id") == F.col("t"), "left_semi").select("id", F.col("sig").alias("of"))
        held = held.join(classes.select("sig", "sid"), F.col("of") == F.col("sig")).where("sid <> id")
        links = links.union(written(held.select("sid", "id").distinct(), "same"))
    roots = components(links)

    # All other links: the lists, and groups, that still hold several components.
    rooted = member.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "m_n", "m_key", F.coalesce("root", "sid").alias("comp"))
    rooted = written(rooted, "rooted")
    rows = lists.select("token", "np", "gkey").join(rooted, (F.col("gkey") == F.col("m_key")) & (size_of("np") == F.col("m_n"))).select("token", "np", "sid", "comp")
    within = rooted.join(several, (F.col("m_key") == F.col("s_key")) & (F.col("m_n") == F.col("s_n")), "left_semi")
    rows = rows.select("*", F.lit(False).alias("inner")).union(within.select("m_key", F.shiftleft("m_n", 32), "sid", "comp", F.lit(True)))
    mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), (F.count("*") > WIDE).alias("wide")).where("lo < hi")
    rows = rows.join(written(mixed.select(F.col("token").alias("t"), "wide"), "mixed"), F.col("token") == F.col("t"))
    rows = written(rows.select("token", size_of("np").alias("n"), place_of("np").alias("p"), "sid", "comp", "inner", (F.col("wide") & ~F.col("inner")).alias("wide")), "open")
    held = rows.where("wide").groupBy(F.col("sid").alias("of")).agg(F.count("*").alias("e"))
    rows = written(rows.join(held, F.col("sid") == F.col("of"), "left").select(*rows.columns, F.coalesce("e", F.lit(0)).alias("e")), "weighed")
    # similar sets lie in the same or in neighbouring bands of sizes: only those meet
    rows = rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int"))
    here = rows.groupBy("token", "comp", "wide", "band").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("p").alias("p"), F.max("e").alias("e"))
    one, two = (here.select("token", *(F.col(c).alias(f"{c}{k}") for c in ("comp", "wide", "band", "least", "most", "p", "e"))) for k in (1, 2))
    two = two.withColumn("band1", F.explode(F.array(*(F.col("band2") + k for k in (-1, 0, 1)))))
    near = (100 * F.col("most1") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least1"))
    enough = F.least("e1", "e2") >= _least_in_prefix(F.least("least1", "least2"), F.greatest("most1", "most2"), percent)
    least = _least_shared(F.col("least1"), F.col("least2"), percent)
    early = (F.col("p1") <= F.col("most1") - least) & (F.col("p2") <= F.col("most2") - least)
    across = one.join(two.drop("wide2"), ["token", "band1"]).where((F.col("comp1") < F.col("comp2")) & near & (~F.col("wide1") | (enough & early))).select("token", "comp1", "band1", "comp2", "band2")
    one, two = (rows.select("token", *(F.col(c).alias(f"{c}{k}") for c in ("comp", "band", "n", "p", "sid", "inner", "wide", "e"))) for k in (1, 2))
    n1, n2 = F.col("n1"), F.col("n2")
    enough = F.least("e1", "e2") >= _least_in_prefix(F.least(n1, n2), F.greatest(n1, n2), percent)
    near = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    # sets that share m elements have one among the first n1 - m + 1 and n2 - m + 1
    early = (F.col("p1") <= n1 - _least_shared(n1, n2, percent)) & (F.col("p2") <= n2 - _least_shared(n1, n2, percent))
    met = across.join(one, ["token", "comp1", "band1"]).join(two.drop("wide2"), ["token", "comp2", "band2"]).where(near & (~F.col("wide1") | (enough & early)))
    met = met.groupBy(F.col("sid1").alias("a"), F.col("sid2").alias("b"), n1, n2, F.least("e1", "e2").alias("e")).agg(F.count_if(~F.col("wide1")).alias("c"), F.bool_or(F.col("inner1") & F.col("inner2")).alias("inner"))
    # All shared prefix shingles of narrow lists are counted here, those of wide ones are bounded. What else the sets
    # share stands behind the prefix that ends first.
    tail = lambda n: n - prefix_length(n, percent, F.floor)
    most = F.col("c") + F.col("e") + F.greatest(tail(n1), tail(n2))
    rest = written(met.where((most >= _least_shared(n1, n2, percent)) | F.col("inner")).select("a", "b").distinct(), "rest")
    final = roots if rest.isEmpty() else components(links.union(_verified(rest, docs, id_col, text_col, size, percent)))

    told = classes.join(final, F.col("sid") == F.col("node"), "left").select(F.col("sig").alias("of"), F.coalesce("root", "sid").alias("component"))
    told = written(told, "told")
    out = sketch.select("id", "n", "sig").join(told, F.col("sig") == F.col("of"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
