"""Approximate nearest neighbours by balanced posting lists.

Vectors lie in posting lists around centroids. The centroids come from a balanced splitting of a bounded
sample; of lists that would still be too full, those around a centroid near which all short vectors lie,
the members are halved along lines of the sample, so that lists hold about as many vectors each. A vector
near a boundary is replicated to a second list whose centroid is nearly as near, unless that one is full.

Centroids are searched by a graph held in memory: a beam search over each one's neighbours. A query first
reads the few lists that promise most; the k + 1st best found there is its bar. Of the others it reads
those whose distance to the bar, from what their farthest members along the centroid would score, is at
most ``RATIO`` times the spread of their members across it. No list is read whose longest vector could not reach the
bar, so lists of short vectors go unread, however near they lie to each other.

Equal vectors are one posting with their k + 1 smallest ids, which is all that any query can return of them.

Scale: lists hold ``LIST`` vectors up to ``MOST_LISTS`` lists, about eight million distinct vectors, and more
beyond, as what tasks get of the index is bounded: some 30 MB at 64 dimensions.

Defined results: vectors that are null, zero, hold null or non-finite components, or are not of the
table's commonest length take no part, as query or as candidate, nor do null ids; of repeated rows a
query leaves out itself only; ties go to the smaller id; an empty table gives no rows; columns other than id and
vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.llm.vectors import dimensions_of, distinct_vectors, matrix, packs, sample_of, sound
from stowage.session import written

K = 20
#: Vectors a list should hold, lists at most, and the sample that places them: rows a list, and rows at least.
LIST, MOST_LISTS, SAMPLE_A_LIST, SAMPLE = 512, 16384, 16, 16384
#: A vector goes to a second list if its centroid is at most so many times as far as the nearest one.
CLOSE = 1.05
#: Share of the mean beyond which a list is full, and below which its centroid goes.
FULL, POOR = 1.5, 1 / 4
#: Share of the median beyond which a list, with those that are near it, takes none that are at home elsewhere.
CROWD = 2.0
#: The measured recall of the tests' data hangs on RATIO; the FIRST lists are read without a bar.
RATIO, FIRST = 3.0, 4
DEGREE, BEAM = 24, 96


def balanced_centroids(x: np.ndarray, count: int) -> np.ndarray:
    """Means of ``count`` parts of near equal size: halved along the line between two means, over and over."""
    parts = [(x, count)]
    out = []
    while parts:
        own, n = parts.pop()
        if n <= 1 or len(own) < 2:
            if len(own):
                out.append(own.mean(0))
            continue
        a = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
        b = own[((own - a) ** 2).sum(1).argmax()]
        for _ in range(6):
            side = ((own - a) ** 2).sum(1) - ((own - b) ** 2).sum(1)
            first = side < np.median(side)
            if first.all() or not first.any():
                break
            a, b = own[first].mean(0), own[~first].mean(0)
        left = n // 2
        order = np.argsort(((own - a) ** 2).sum(1) - ((own - b) ** 2).sum(1), kind="stable")
        at = round(len(own) * left / n)
        parts += [(own[order[:at]], left), (own[order[at:]], n - left)]
    return np.array(out)


class CentroidGraph:
    """Centroids with their nearest neighbours, both ways, and entry points spread over them."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.c = centroids.astype(np.float64)
        self.sq = (self.c**2).sum(1)
        n = len(self.c)
        near = np.empty((n, min(degree, max(n - 1, 0))), np.int64)
        for at in range(0, n, 1024):
            d = self.sq[None] - 2 * self.c[at : at + 1024] @ self.c.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + len(d)] = np.argsort(d, 1, kind="stable")[:, : near.shape[1]]
        back: list[list[int]] = [[] for _ in range(n)]
        for i, row in enumerate(near.tolist()):
            for j in row:
                if len(back[j]) < degree:
                    back[j].append(i)
        self.links = np.array([(list(dict.fromkeys([*a, *b])) + [i] * 2 * degree)[: 2 * degree] for i, (a, b) in enumerate(zip(near.tolist(), back, strict=True))], np.int64).reshape(n, -1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distance from each row of q to its own ids."""
        return np.maximum((q**2).sum(1)[:, None] - 2 * np.einsum("bd,bnd->bn", q, self.c[ids]) + self.sq[ids], 0)

    def search(self, q: np.ndarray, want: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q about ``want`` nearest centroids in order: ids (-1: none) and distances."""
        n, rows = len(q), np.arange(len(q))[:, None]
        beam = max(beam, want)
        seen = np.zeros((n, len(self.c) + 1), bool)
        ids = np.full((n, beam), len(self.c))
        dist = np.full((n, beam), np.inf)
        done = np.ones((n, beam), bool)

        def add(new: np.ndarray, fresh: np.ndarray) -> None:
            nonlocal ids, dist, done
            d = np.where(fresh, self._distance(q, np.where(fresh, new, 0)), np.inf)
            all_i, all_d = np.concatenate([ids, new], 1), np.concatenate([dist, d], 1)
            all_x = np.concatenate([done, ~fresh], 1)
            top = np.argsort(all_d, 1, kind="stable")[:, :beam]
            ids, dist, done = all_i[rows, top], all_d[rows, top], all_x[rows, top]

        first = self.entries[None].repeat(n, 0)
        seen[rows, first] = True
        add(first, np.ones(first.shape, bool))
        while not done.all():
            step = np.argsort(np.where(done, np.inf, dist), 1, kind="stable")[:, :4]
            live = ~done[rows, step]
            done[rows, step] = True
            new = self.links[np.where(live, ids[rows, step], 0)].reshape(n, -1)
            fresh = np.repeat(live, self.links.shape[1], 1) & ~seen[rows, new]
            order = np.argsort(np.where(fresh, new, -1), 1, kind="stable")
            new, fresh = new[rows, order], fresh[rows, order]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[rows, np.where(fresh, new, len(self.c))] = True
            add(new, fresh)
        ids = np.where(np.isfinite(dist), ids, -1)
        return ids[:, :want], np.sqrt(dist[:, :want])


class Halving:
    """A list's members halved along lines, over and over, into parts of near equal size: for each node a direction and a threshold."""

    def __init__(self, x: np.ndarray, parts: int):
        self.normal, self.at, self.next, self.means = [], [], [], []
        self._grow(x, parts)
        self.normal, self.at, self.next = np.array(self.normal), np.array(self.at), np.array(self.next)

    def _grow(self, x: np.ndarray, parts: int) -> int:
        """The node made: its number, or of a part -1 less its number."""
        if parts <= 1 or len(x) < 2:
            self.means.append(x.mean(0))
            return -len(self.means)
        a = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
        b = x[((x - a) ** 2).sum(1).argmax()]
        for _ in range(4):
            along = x @ (b - a)
            low = along < np.median(along)
            if not low.any():
                break
            a, b = x[low].mean(0), x[~low].mean(0)
        size = np.linalg.norm(b - a)
        way = (b - a) / size if size else b - a
        along, left = x @ way, parts // 2
        order = np.argsort(along, kind="stable")
        cut = min(max(round(len(x) * left / parts), 1), len(x) - 1)
        me = len(self.at)
        self.normal.append(way)
        self.at.append((along[order[cut - 1]] + along[order[cut]]) / 2)
        self.next.append([0, 0])
        self.next[me] = [self._grow(x[order[:cut]], left), self._grow(x[order[cut:]], parts - left)]
        return me

    def part(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64) if len(self.at) else np.full(len(x), -1)
        while (live := np.flatnonzero(node >= 0)).size:
            n = node[live]
            over = np.einsum("ij,ij->i", x[live], self.normal[n]) >= self.at[n]
            node[live] = self.next[n, over.astype(np.int64)]
        return -1 - node


class Index:
    """The fitted part: centroids, the halvings of full ones, and once measured what each list's members are like, with the graph that queries search."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centroids = self._centroids(sample, lists)
        self.sq = (self.centroids**2).sum(1)
        home = self._nearest(sample, self.centroids)
        held, mean = np.bincount(home, minlength=len(self.centroids)), len(sample) / lists
        close = np.zeros(len(held), np.int64)
        for k in range(0, len(sample), 1024) if len(held) > 1 else ():
            ids, dist = self._two_nearest(sample[k : k + 1024])
            np.add.at(close, ids[dist[:, 1] <= CLOSE * dist[:, 0], 1], 1)
        self.open = held + close <= CROWD * np.median(held + close)
        self.halvings, means = {}, []
        self.first = np.empty(len(held), np.int64)
        for k, c in enumerate(self.centroids):
            self.first[k] = len(means)
            if held[k] > FULL * mean:
                self.halvings[k] = Halving(sample[home == k], int(np.ceil(held[k] / mean)))
                means += self.halvings[k].means
            else:
                means.append(c)
        self.means = np.array(means)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        sq = (c**2).sum(1)
        return np.concatenate([np.empty(0, np.int64), *((sq - 2 * x[k : k + 1024] @ c.T).argmin(1) for k in range(0, len(x), 1024))])

    def _centroids(self, x: np.ndarray, lists: int) -> np.ndarray:
        """Means of balanced parts; then, a few times, those of full lists give way to several and those of poor ones go."""
        c, mean = balanced_centroids(x, lists), len(x) / lists
        for _ in range(8 if lists <= 2048 else 2):
            home = self._nearest(x, c)
            order = np.argsort(home, kind="stable")
            ends = np.cumsum(np.bincount(home, minlength=len(c)))
            new, changed = [], False
            for low, high in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                n, own = high - low, x[order[low:high]]
                if n < POOR * mean:
                    changed = True
                elif n > FULL * mean:
                    new.append(balanced_centroids(own, int(np.ceil(n / mean))))
                    changed = True
                else:
                    new.append(own.mean(0)[None])
            if not new:
                break
            c = np.concatenate(new)
            if not changed:
                break
        return c

    def _leaf(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = self.first[k]
        for full in np.unique(k):
            if full in self.halvings:
                own = k == full
                out[own] += self.halvings[full].part(x[own])
        return out

    def _two_nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest two centroids (or the only one) of each row, and their distances: all are looked at, as one product is cheaper than a search."""
        d = self.sq - 2 * x @ self.centroids.T
        ids = np.argpartition(d, 1, 1)[:, :2] if d.shape[1] > 2 else np.argsort(d, 1, kind="stable")
        near = np.take_along_axis(d, ids, 1)
        order = np.lexsort((ids, near), axis=1)
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        return ids, np.sqrt(np.maximum(near + (x**2).sum(1)[:, None], 0))

    def homes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each vector lies in, one or two."""
        ids, dist = self._two_nearest(x)
        one = self._leaf(x, ids[:, 0])
        if ids.shape[1] < 2:
            return [one[i : i + 1] for i in range(len(x))]
        also = self.open[ids[:, 1]] & (dist[:, 1] <= CLOSE * dist[:, 0])
        two = self._leaf(x, ids[:, 1])
        return [np.array([a, b]) if c else np.array([a]) for a, b, c in zip(one.tolist(), two.tolist(), also.tolist(), strict=True)]

    def along(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's part along its list's mean, and the square of the rest."""
        c = self.means[lists]
        size = np.linalg.norm(c, axis=1)
        part = np.einsum("ij,ij->i", x, c) / np.where(size > 0, size, 1)
        return part, np.maximum((x**2).sum(1) - part**2, 0)

    def measure(self, rows: list) -> None:
        """Takes what ``_spreads`` found, a row a list: the members' least and most along the mean, their spread across it, their greatest length."""
        n, d = self.means.shape
        self.least, self.most, self.across, self.longest = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -np.inf)
        for r in rows:
            self.least[r.list], self.most[r.list], self.longest[r.list] = r.least, r.most, r.longest
            self.across[r.list] = np.sqrt(r.rest / r.n / max(d - 1, 1))
        size = np.linalg.norm(self.means, axis=1, keepdims=True)
        self.ways = self.means / np.where(size > 0, size, 1)
        # nearest to (q, 1, 0) is the largest of q times mean plus spread
        lifted = np.concatenate([self.means, RATIO * self.across[:, None]], 1)
        sq = (lifted**2).sum(1)
        self.asked = CentroidGraph(np.concatenate([lifted, np.sqrt(np.maximum(sq.max(initial=0) - sq, 0))[:, None]], 1))

    def reads(self, q: np.ndarray, bars: np.ndarray | None = None, ratio: float = RATIO) -> list[np.ndarray]:
        """Without ``bars`` the ``FIRST`` lists that promise most; with them all that may hold what beats a query's bar."""
        size = np.linalg.norm(q, axis=1, keepdims=True)
        unit = q / size
        lifted = np.concatenate([unit, np.ones((len(q), 1)), np.zeros((len(q), 1))], 1)
        want = BEAM
        while True:
            ids, _ = self.asked.search(lifted, want, want)
            near = np.maximum(ids, 0)
            cos = np.einsum("bd,bnd->bn", unit, self.ways[near])
            end = np.where(cos > 0, self.most[near], self.least[near])
            best = cos * end + ratio * np.sqrt(np.maximum(1 - cos**2, 0)) * self.across[near]
            best = np.where(ids >= 0, np.minimum(best, self.longest[near]), -np.inf)
            order = np.argsort(-best, 1, kind="stable")
            ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
            if bars is None:
                return [i[:FIRST][b[:FIRST] > -np.inf] for i, b in zip(ids, best, strict=True)]
            ok = (best * size >= bars[:, None]) & (best > -np.inf)
            # the search goes by a linear form of the promise: on until the beam reaches well beyond what is read
            if want >= len(self.means) or not (ok.sum(1) > want // 2).any():
                return [i[o] for i, o in zip(ids, ok, strict=True)]
            want *= 2


def fit(vectors: DataFrame, total: int, dimensions: int) -> Index:
    lists = min(MOST_LISTS, max(1, total // LIST))
    return Index(sample_of(vectors, total, max(SAMPLE, SAMPLE_A_LIST * lists), dimensions), lists)


def _spreads(posted: DataFrame, known, dimensions: int) -> list:
    """A row a list: how many members it has, and what they are like; summed by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(known.value.means)
        count, rest = np.zeros(n, np.int64), np.zeros(n)
        least, most, longest = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lists = part.column(1)
                own = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                k = lists.flatten().to_numpy(zero_copy_only=False)
                x = matrix(part.column(0), dimensions)[own]
                along, across = known.value.along(x, k)
                np.add.at(count, k, 1)
                np.add.at(rest, k, across)
                np.minimum.at(least, k, along)
                np.maximum.at(most, k, along)
                np.maximum.at(longest, k, np.linalg.norm(x, axis=1))
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(has), *(pa.array(c[has]) for c in (count, rest, least, most, longest))], ["list", "n", "rest", "least", "most", "longest"])

    found = posted.select("vec", "lists").mapInArrow(run, "list long, n long, rest double, least double, most double, longest double")
    merged = (F.sum("n").alias("n"), F.sum("rest").alias("rest"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("longest").alias("longest"))
    return found.groupBy("list").agg(*merged).collect()


def _rank(dimensions: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q_at, p_at = (batch.schema.get_field_index(c) for c in ("queries", "postings"))
            for r in range(batch.num_rows):
                q, p = batch.column(q_at).slice(r, 1).flatten(), batch.column(p_at).slice(r, 1).flatten()
                q_key, p_key, p_id = (x.to_numpy(zero_copy_only=False) for x in (q.field("key"), p.field("key"), p.field("rep")))
                s = matrix(q.field("vec"), dimensions) @ matrix(p.field("vec"), dimensions).T
                order = np.argsort(p_id, kind="stable")  # ties go to the smaller id
                top = order[np.argsort(-s[:, order], 1, kind="stable")[:, :k]]
                best = np.take_along_axis(s, top, 1)
                good = best >= q.field("bar").to_numpy(zero_copy_only=False)[:, None]
                rows = np.repeat(q_key, good.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(p_key[top][good]), pa.array(best[good]), pa.array(p_id[top][good])], ["q_key", "p_key", "score", "rep"])

    return run


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, ratio: float = RATIO) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that ``is_query`` (of the id) marks, against all other rows."""
    own = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), is_query.alias("asks"))
    dim = dimensions_of(own, "v")
    own = own.where(sound(F.col("v"), dim) & F.col("id").isNotNull())
    vectors = distinct_vectors(own, "id", "v", k + 1)
    total = vectors.count() if dim else 0
    index = fit(vectors, total, dim) if total else None
    context = df.sparkSession.sparkContext
    spread = max(context.defaultParallelism, total // 20_000)  # small rows, but much work for each
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vec_type = vectors.schema["vec"].dataType.simpleString()

    def lists(known, method: str, **options):
        """Adds the lists that a method of the index finds; a column ``bar`` holds the bars that it is given."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                barred = batch.schema.get_field_index("bar")
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    bars = {"bars": part.column(barred).to_numpy(zero_copy_only=False)} if barred >= 0 else {}
                    found = getattr(known.value, method)(matrix(part.column(2), dim), **bars, **options)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int64()))], [*part.schema.names, "lists"])

        return run

    schema = f"key long, rep long, vec {vec_type}"
    rows = vectors.select("key", F.col("ids")[0].alias("rep"), "vec")
    placing = context.broadcast(index)
    posted = written(rows.mapInArrow(lists(placing, "homes"), f"{schema}, lists array<long>"), "posted")
    index.measure(_spreads(posted, placing, dim))
    known = context.broadcast(index)
    asked = written(own.where("asks").select("id", "v").join(vectors, F.col("v") == F.col("vec")).select("id", "key"), "asked")
    asking = rows.join(asked.select(F.col("key").alias("q")).distinct(), F.col("key") == F.col("q"), "left_semi")
    reading = written(asking.mapInArrow(lists(known, "reads", ratio=ratio), f"{schema}, lists array<long>"), "reading")
    payload = ["key", "rep", "vec"]
    postings = packs(posted.select(F.explode("lists").alias("list"), *payload), "list", "postings", payload)

    def hits_of(asking: DataFrame) -> DataFrame:
        """The k + 1 best of each query in its lists, of those that reach its bar."""
        queries = packs(asking.select(F.explode("lists").alias("of_list"), *payload, "bar"), "of_list", "queries", [*payload, "bar"])
        pairs = queries.join(postings, F.col("list") == F.col("of_list")).select("queries", "postings")
        return pairs.mapInArrow(_rank(dim, k + 1), "q_key long, p_key long, score double, rep long")

    def best_of(hits: DataFrame) -> DataFrame:
        once = hits.groupBy("q_key", "p_key").agg(F.max("score").alias("score"), F.min("rep").alias("rep"))
        order = W.partitionBy("q_key").orderBy(F.desc("score"), "rep")
        return once.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)

    none = F.lit(float("-inf"))
    near = written(best_of(hits_of(reading.withColumn("bar", none))), "near")
    bars = near.where(F.col("at") == k + 1).select(F.col("q_key").alias("b_key"), F.col("score").alias("least"))
    barred = reading.join(bars, F.col("key") == F.col("b_key"), "left").repartition(spread, "key").select(*payload, F.coalesce("least", none).alias("bar"), F.col("lists").alias("read"))
    later = barred.mapInArrow(lists(known, "reads", ratio=ratio), f"{schema}, bar double, read array<long>, lists array<long>")
    later = written(later.select(*payload, "bar", F.array_except("lists", "read").alias("lists")), "later")
    hits = written(best_of(near.drop("at").union(hits_of(later))), "hits")
    each = hits.join(vectors.select("key", "ids"), F.col("p_key") == F.col("key")).select("q_key", "score", F.explode("ids").alias("hit"))
    # at most (k + 1)^2 rows a query vector meet here
    lined = each.groupBy("q_key").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "hit"))), 1, k + 1).alias("found"))
    lined = written(lined, "lined")
    out = asked.join(lined, F.col("key") == F.col("q_key"))
    itself = F.array_position(F.transform("found", lambda x: x["hit"]), F.col("id")).cast("int")
    others = F.when(itself > 0, F.concat(F.slice("found", 1, itself - 1), F.slice("found", itself + 1, k + 1))).otherwise(F.col("found"))
    out = out.select("id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return out.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.hit").alias("vec_id"), (-F.col("x.s")).alias("score"))
