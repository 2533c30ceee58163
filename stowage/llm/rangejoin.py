"""Near-duplicate vectors: an exact metric range join.

Unit vectors at cosine c lie sqrt(2 - 2c) apart. Pivots partition the vectors: each belongs to the cell of its
nearest pivot, and cells lie in blocks of some thousand vectors, several blocks a file in the shared folder. That
shuffle and these files are all the copies of the vectors that are made: a task takes the vectors of one group of
files and reads half of all other groups, by turns, so that each pair of groups meets once and its links are
counted for both sides. Nothing is replicated, whatever the data: the disk is about twice the vectors.

Of a pair of blocks only those vectors are compared that the triangle inequality does not exclude. If v is in cell
i and |u - v| <= r, then |u - p_i| <= |u - p_home| + 2r, and u's projection onto the line between the two pivots
lies within r of their bisecting plane; and the angles of u and v to a pivot differ by at most the angle of the
cosine, so that u's lies within that of what the block's vectors have. What is left is compared along the few
axes in which the vectors vary most: with lengths of the rests, they bound the cosine from above, and only pairs
whose bound reaches it are computed in full, in double precision.

The number of pivots grows with the vectors up to ``MOST_PIVOTS``. A cell that is still large is parted by its
vectors' second nearest pivots, then by hash. That, the sizes of cells, which come from a part of the vectors, and
the axes only decide how fast the join is: the bounds are those of the blocks as they are.

Copies of a vector are one row with a count; they are known by a digest of 128 bits. A cell's links are counted and
never emitted; of a pair of blocks only a spanning forest goes on to the connected components.

Scale: the work grows with the vectors times the blocks that are not excluded. These are few where clusters lie
apart. Where no pivot tells vectors apart, as on isotropic data at a radius like this one, they are half of all: an
exact join then is a blocked comparison of all distinct vectors, halved, and grows with their square.

Defined results: vectors that are null, zero, hold null or non-finite components, or are not of the
table's commonest length, link with nothing (0 links, a component of their own); rows with a null id
take no part either and have a null component; of repeated ids the rows count as vectors of their own
and the id is one node; an empty table gives no rows; columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import acos, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.components import components
from stowage.llm.memory import small_batches
from stowage.llm.vectors import dimensions_of, matrix, sample_of, sound
from stowage.llm.warc import _open
from stowage.session import scratch, written

COSINE = 0.9
#: Vectors that a cell should hold, pivots at most, and the sample that places them: vectors a pivot, and vectors at least.
CELL, MOST_PIVOTS, SAMPLE_A_PIVOT, SAMPLE = 2048, 8192, 8, 8192
#: Cells of more than so many times ``CELL`` are parted by second pivots; vectors a cell from which sizes are told.
LARGE, COUNTED = 4, 256
#: Blocks in a file, and files at least; bytes of a block's vectors as doubles, at most.
FILE, FILES, BLOCK_BYTES = 8, 24, 8 << 20
#: Pivots that are chosen far from each other; any more are taken from the sample in order.
FAR = 1024
EPS = 1e-9
#: What single precision may err by in a product of unit vectors, with room to spare, and rows that are compared at a time.
SINGLE, STRIP = 3e-5, 128


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow, no underflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def place_pivots(sample: np.ndarray, count: int, steps: int = 8) -> np.ndarray:
    """Farthest-first points of the sample's directions, then moved to the means of their cells."""
    u = _unit(sample)
    chosen = [0]
    near = ((u - u[0]) ** 2).sum(1)
    while len(chosen) < min(count, FAR, len(u)) and near.max() > EPS:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((u - u[chosen[-1]]) ** 2).sum(1))
    if len(chosen) == FAR < count:
        rest = np.setdiff1d(np.arange(len(u)), chosen)
        chosen += rest[:: max(1, len(rest) // (count - FAR))][: count - FAR].tolist()
    p = u[chosen]
    for _ in range(steps):
        home = np.concatenate([(u[k : k + 1024] @ p.T).argmax(1) for k in range(0, len(u), 1024)])
        sums = np.zeros_like(p)
        np.add.at(sums, home, u)
        size = np.linalg.norm(sums, axis=1)
        ok = size > 0.05
        p[ok] = sums[ok] / size[ok, None]
    return p


def cells_of(u: np.ndarray, pivots: np.ndarray, radius: float, turns: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Home cells, and which cells each unit vector must be known to, its own among them.

    With ``turns`` a pair of cells meets in the lower one if the sum of their numbers is odd, else in the higher
    one; without, the vectors are at home elsewhere and are known to every cell that may hold a partner.
    """
    d = np.sqrt(np.maximum(2 - 2 * u @ pivots.T, 0))
    home = d.argmin(1)
    near = d[np.arange(len(u)), home][:, None]
    close = d <= near + 2 * radius + EPS
    gaps = np.sqrt(np.maximum(2 - 2 * pivots[home] @ pivots.T, 0))
    close &= (d**2 - near**2) <= 2 * radius * gaps + EPS
    if turns:
        cell = np.arange(len(pivots))[None]
        close &= (cell < home[:, None]) == ((cell + home[:, None]) % 2 == 1)
    close[np.arange(len(u)), home] = True
    return home, close


def _forest(linked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (row or column, row or column) that join what the block's links join; columns count on after the rows."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return
    m = linked[np.ix_(rows, cols)]
    top = len(linked) + linked.shape[1]
    own_r, own_c = rows.astype(np.int64), cols + len(linked)
    lab_r, lab_c = own_r.copy(), own_c.copy()
    while True:
        new_c = np.minimum(lab_c, np.where(m, lab_r[:, None], top).min(0))
        new_r = np.minimum(lab_r, np.where(m, new_c, top).min(1))
        if (new_c == lab_c).all() and (new_r == lab_r).all():
            break
        lab_r, lab_c = new_r, new_c
    own, lab = np.concatenate([own_r, own_c]), np.concatenate([lab_r, lab_c])
    yield own[own != lab], lab[own != lab]


def axes_of(sample: np.ndarray, cosine: float) -> np.ndarray:
    """Orthonormal axes, as columns, on which pairs are compared first: as many as cost least on the sample, all for no such bound."""
    u = _unit(sample)
    axes = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    some = u[:: max(1, len(u) // 1024)][:1024]
    best = None
    for k in sorted({*range(8, u.shape[1], 8), u.shape[1]}):
        x = _along(some, axes[:, :k])
        cost = 20 + k + 4000 * (x @ x.T >= cosine - SINGLE).mean()  # a pair that passes costs as much as some thousand products
        if best is None or cost < best[0]:
            best = cost, k
    return np.ascontiguousarray(axes[:, : best[1]])


def _along(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes and the length of the rest: their products are never less than the cosine."""
    x = u @ axes
    if axes.shape[1] < len(axes):
        x = np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))])
    return x.astype(np.float32)


class Block:
    """Distinct vectors of one cell: keys, smallest ids, numbers of rows, unit vectors, and bounds of their angles to the cell's pivot."""

    def __init__(self, row: dict, dimensions: int, axes: np.ndarray):
        self.home, self.low, self.high = row["home"], row["low"], row["high"]
        self.key = row["key"] + np.arange(row["size"])
        self.rep, self.n = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["counts"], np.int64)
        self.u = _unit(np.frombuffer(row["vecs"], row["kind"]).astype(np.float64).reshape(-1, dimensions))
        self.x = _along(self.u, axes)
        self.links = np.zeros(len(self.n), np.int64)


def may_link(u: np.ndarray, home: int, other: Block, pivots: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors of cell ``home`` may have a partner in the other block."""
    angle = np.arccos(np.clip(u @ pivots[other.home], -1, 1))
    reach = acos(max(-1.0, min(1.0, cosine))) + 1e-6
    may = (angle >= other.low - reach) & (angle <= other.high + reach)
    if home != other.home and may.any():
        may &= cells_of(u, pivots[[home, other.home]], sqrt(max(0.0, 2 - 2 * cosine)), turns=False)[1][:, 1]
    return may


def links_of(a: Block, b: Block, pivots: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts the links between two blocks, or within one, in both; gives the ends of edges that join what they join."""
    rows = np.flatnonzero(may_link(a.u, a.home, b, pivots, cosine))
    cols = np.flatnonzero(may_link(b.u, b.home, a, pivots, cosine)) if len(rows) else rows
    if not len(cols):
        return
    y = b.x if len(cols) == len(b.x) else b.x[cols]
    step = max(1, (1 << 16) // a.u.shape[1])
    bound, near = np.empty((STRIP, len(cols)), np.float32), np.empty((STRIP, len(cols)), bool)
    for at in range(0, len(rows), STRIP):
        few = rows[at : at + STRIP]
        np.matmul(a.x[few], y.T, out=bound[: len(few)])
        np.greater_equal(bound[: len(few)], np.float32(cosine - SINGLE), out=near[: len(few)])
        i, j = np.divmod(np.flatnonzero(near[: len(few)]), len(cols))
        if not len(i):
            continue
        if 16 * len(i) > len(few) * len(cols):
            i, j = np.nonzero(a.u[few] @ b.u[cols].T >= cosine)
            i, j = few[i], cols[j]
        else:
            i, j = few[i], cols[j]
            sure = np.concatenate([np.einsum("ij,ij->i", a.u[i[k : k + step]], b.u[j[k : k + step]]) >= cosine for k in range(0, len(i), step)])
            i, j = i[sure], j[sure]
        if a is b:
            i, j = i[i != j], j[i != j]
        else:
            b.links += np.bincount(j, a.n[i], len(b.n)).astype(np.int64)
        a.links += np.bincount(i, b.n[j], len(a.n)).astype(np.int64)
        own, r = np.unique(i, return_inverse=True)
        far, c = np.unique(j, return_inverse=True)
        ends = a.rep[i], b.rep[j]
        if len(i) > len(own) + len(far):
            linked = np.zeros((len(own), len(far)), bool)
            linked[r, c] = True
            ids = np.concatenate([a.rep[own], b.rep[far]])
            ends = next(((ids[p], ids[q]) for p, q in _forest(linked)))
        apart = ends[0] != ends[1]
        yield ends[0][apart], ends[1][apart]


def turns(group: int, groups: int) -> list[int]:
    """The groups that a group meets: itself, and of the others half, so that each pair meets once."""
    last = (groups - 1) // 2 + (groups % 2 == 0 and group < groups // 2)
    return [group, *((group + k) % groups for k in range(1, last + 1))]


def _join(files: list[list[tuple[str, list]]], dimensions: int, cosine: float, pivots: np.ndarray, axes: np.ndarray):
    """Links of a group's vectors with those of the groups that it meets: ``a``, ``n`` for a key and its links, ``a, b`` for an edge."""

    def blocks(path: str, want: set[int]) -> Iterator[Block]:
        import pyarrow.parquet as pq

        fs, name = _open(path)
        with fs.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(4, columns=["slot", "home", "low", "high", "size", "key", "reps", "counts", "kind", "vecs"]):
                for k in range(batch.num_rows):
                    if batch.column(0)[k].as_py() in want:
                        yield Block(batch.slice(k, 1).to_pylist()[0], dimensions, axes)

    def edges(a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> pa.RecordBatch:
        n = np.full(len(a), n) if isinstance(n, int) else n
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

    def counted(block: Block) -> pa.RecordBatch:
        has = block.links > 0
        return edges(block.key[has], np.full(has.sum(), -1), block.links[has])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in (g for batch in batches for g in batch.column(0).to_pylist()):
            own = [b for path, rows in files[group] for b in blocks(path, {r.slot for r in rows})]
            for k, a in enumerate(own):
                for b in own[k:]:
                    for ends in links_of(a, b, pivots, cosine):
                        yield edges(*ends, -1)
            reach = acos(max(-1.0, min(1.0, cosine))) + 1e-6
            for other in turns(group, len(files))[1:]:
                for path, rows in files[other]:
                    near = np.arccos(np.clip(pivots[[a.home for a in own]] @ pivots[[r.home for r in rows]].T, -1, 1))
                    least = near - np.array([[a.high] for a in own]) - np.array([r.high for r in rows])  # between any vectors of the two blocks
                    want = {r.slot for r, c in zip(rows, (least <= reach).any(0), strict=True) if c}
                    for b in blocks(path, want) if want else ():
                        for a in own:
                            for ends in links_of(a, b, pivots, cosine):
                                yield edges(*ends, -1)
                        yield counted(b)
            for a in own:
                yield counted(a)

    return run


def _digests(x: np.ndarray) -> np.ndarray:
    """Two 64-bit integers a vector; -0 is 0, and single and double precision of a value are equal."""
    x = np.ascontiguousarray(x, np.float64) + 0.0
    return np.frombuffer(b"".join(blake2b(v, digest_size=16).digest() for v in x), np.int64).reshape(-1, 2)


def _homes(u: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest pivot (-1: there is none)."""
    s = u @ pivots.T
    home = s.argmax(1)
    if len(pivots) == 1:
        return home, np.full(len(u), -1)
    s[np.arange(len(u)), home] = -np.inf
    return home, s.argmax(1)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield held
            held = []
    if held:
        yield held


def _most(dimensions: int) -> int:
    """Vectors in a block."""
    return max(1, min(2 * CELL, BLOCK_BYTES // (8 * dimensions)))


def _units(vectors: DataFrame, pivots: np.ndarray, total: int, dimensions: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of cells: numbers of (pivot, second pivot or -1) in order, how many units each has, and where these begin."""
    count = len(pivots)
    step = max(16, (1 << 21) // count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                homes = _homes(_unit(matrix(part.column(1), dimensions)), pivots)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(h, pa.int64()) for h in homes)], ["h", "home", "second"])

    share = max(1, total // (COUNTED * count))
    few = vectors.select(F.xxhash64("vec").alias("h"), "vec").where(F.pmod("h", F.lit(share)) == 0)
    sizes = written(few.mapInArrow(run, "h long, home long, second long").distinct().groupBy("home", "second").agg((F.count("*") * share).alias("size")), "sizes")
    cells = dict.fromkeys(range(count), 0) | {r[0]: r[1] for r in sizes.groupBy("home").agg(F.sum("size")).collect()}
    large = [h for h, n in cells.items() if n > LARGE * CELL]
    parts = {(r.home, r.second): r["size"] for r in sizes.where(F.col("size") >= CELL).collect() if r.home in set(large)} if large else {}
    for (home, _), n in parts.items():
        cells[home] -= n
    parts |= {(h, -1): n for h, n in cells.items()}
    codes = np.array(sorted((h * (count + 1) + s + 1, max(1, -(-n // most))) for (h, s), n in parts.items()), np.int64).reshape(-1, 2)
    return codes[:, 0], codes[:, 1], np.concatenate([[0], codes[:, 1].cumsum()])


def _blocks(vectors: DataFrame, pivots: np.ndarray, total: int, dimensions: int) -> tuple[DataFrame, str]:
    """Distinct vectors in blocks, those of a cell together, written; and the path."""
    kind = {"float": "f4"}.get(vectors.schema["vec"].dataType.elementType.simpleString(), "f8")
    most = _most(dimensions)
    codes, parts, first = _units(vectors, pivots, total, dimensions, most)
    homes = np.repeat(codes // (len(pivots) + 1), parts)
    step = max(16, (1 << 21) // len(pivots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches, 8192):
            ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
            x = np.concatenate([matrix(b.column(1), dimensions) for b in held]) + 0.0
            n = np.ones(len(ids), np.int64)
            digest = _digests(x)
            order = np.lexsort((ids, digest[:, 1], digest[:, 0]))
            starts = np.flatnonzero(np.concatenate([[True], (digest[order[1:]] != digest[order[:-1]]).any(1)]))
            n, at = np.add.reduceat(n[order], starts), order[starts]
            u = _unit(x[at])
            home, second = (np.concatenate(z) for z in zip(*(_homes(u[k : k + step], pivots) for k in range(0, len(u), step)), strict=True))
            code = home * (len(pivots) + 1) + second + 1
            where = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            where = np.where(codes[where] == code, where, np.searchsorted(codes, home * (len(pivots) + 1)))
            unit = first[where] + (digest[at, 0].view(np.uint64) % parts[where].astype(np.uint64)).astype(np.int64)
            vecs = pa.array([v.tobytes() for v in x[at].astype(kind)], pa.binary())
            cols = [*(pa.array(c, pa.int64()) for c in (unit, digest[at, 0], digest[at, 1], ids[at], n)), vecs]
            yield pa.RecordBatch.from_arrays(cols, ["unit", "d0", "d1", "rep", "n", "vec"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, slot = TaskContext.get().partitionId() << 40, 0

        def made(unit: int, digest: np.ndarray, rep: np.ndarray, n: np.ndarray, vecs: list[bytes]) -> dict:
            starts = np.flatnonzero(np.concatenate([[True], (digest[1:] != digest[:-1]).any(1)]))
            vec = b"".join(vecs[k] for k in starts)
            angle = np.arccos(np.clip(_unit(np.frombuffer(vec, kind).astype(np.float64).reshape(-1, dimensions)) @ pivots[homes[unit]], -1, 1))
            return {
                "slot": slot, "home": int(homes[unit]), "low": float(angle.min()), "high": float(angle.max()), "size": len(starts), "key": key, "kind": kind, "vecs": vec,
                "digests": digest[starts].tobytes(), "reps": np.minimum.reduceat(rep, starts).tobytes(), "counts": np.add.reduceat(n, starts).tobytes(),
            }

        unit, held = None, []

        def flush() -> pa.RecordBatch:
            nonlocal key, slot
            row = made(unit, *(np.concatenate([h[k] for h in held]) for k in range(3)), [v for h in held for v in h[3]])
            key, slot = key + row["size"], slot + 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], BLOCK)

        for batch in batches:
            units, d0, d1, rep, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            ends = np.flatnonzero(np.concatenate([units[1:] != units[:-1], [True]])) + 1
            for at, end in zip([0, *ends[:-1]], ends, strict=True):
                if held and (units[at] != unit or sum(len(h[1]) for h in held) >= 2 * most):
                    yield flush()
                unit = units[at]
                held.append((np.column_stack([d0[at:end], d1[at:end]]), rep[at:end], n[at:end], batch.column(5).slice(at, end - at).to_pylist()))
        if held:
            yield flush()

    fields = "slot int, home int, low double, high double, size int, key long, kind string, digests binary, reps binary, counts binary, vecs binary"
    names = {"int": pa.int32(), "double": pa.float64(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    BLOCK = pa.schema([(f.split()[0], names[f.split()[1]]) for f in fields.split(", ")])
    files = max(min(FILES, int(first[-1])), -(-total // (FILE * most)))
    rows = vectors.select("id", "vec").mapInArrow(place, "unit long, d0 long, d1 long, rep long, n long, vec binary")
    rows = rows.repartition(files, "unit").sortWithinPartitions("unit", "d0", "d1").mapInArrow(block, fields)
    path = scratch(vectors.sparkSession, "blocks")
    rows.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return vectors.sparkSession.read.schema(rows.schema).parquet(path), path


def _groups(blocks: DataFrame, path: str, dimensions: int) -> list[list[tuple[str, list]]]:
    """The files with the bounds of their blocks, in groups of about as many vectors."""
    files: dict[str, list] = {}
    for r in sorted(blocks.select(F.col("_metadata.file_name").alias("file"), "slot", "home", "high", "size").collect()):
        files.setdefault(r.file, []).append(r)
    least = 0.75 * min(FILE * _most(dimensions), sum(r["size"] for rows in files.values() for r in rows) / FILES)
    groups, held = [[]], 0
    for name, rows in files.items():
        if held >= least:
            groups.append([])
            held = 0
        groups[-1].append((f"{path}/{name}", rows))
        held += sum(r["size"] for r in rows)
    return groups


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row."""
    small_batches(df)
    spark = df.sparkSession
    own = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    dim = dimensions_of(own, "v")
    fit = sound(F.col("v"), dim) & F.col("id").isNotNull()
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")]
    rest = own.where(~fit).select("id", *alone)
    if not dim:
        return rest.withColumnRenamed("id", id_col)
    vectors = own.where(fit).select(F.col("id").cast("long").alias("id"), F.col("v").alias("vec"))
    total = vectors.agg(F.approx_count_distinct(F.xxhash64("vec"))).first()[0]
    if not total:
        return rest.withColumnRenamed("id", id_col)
    count = min(MOST_PIVOTS, max(1, total // CELL))
    size = max(SAMPLE, SAMPLE_A_PIVOT * count)
    some = vectors.where(F.pmod(F.xxhash64("vec"), F.lit(max(1, -(-total // size)))) == 0).select("vec").distinct()
    sample = sample_of(some, total, size, dim)
    if not len(sample):  # so few vectors that the hashes leave none
        sample = sample_of(vectors, 1, 1, dim)
    pivots, axes = place_pivots(sample, count), axes_of(sample, cosine)
    blocks, path = _blocks(vectors, pivots, total, dim)
    groups = _groups(blocks, path, dim)
    found = written(spark.range(0, len(groups), 1, len(groups)).mapInArrow(_join(groups, dim, cosine, pivots, axes), "a long, b long, n long"), "found")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, digests, reps, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rep, digest = np.frombuffer(reps, np.int64), np.frombuffer(digests, np.int64).reshape(-1, 2)
                cols = (key + np.arange(len(rep)), digest[:, 0], digest[:, 1], rep, np.frombuffer(counts, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "d0", "d1", "rep", "n"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = _digests(matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(digest[:, k], pa.int64()) for k in (0, 1))], ["id", "d0", "d1"])

    each = blocks.select("key", "digests", "reps", "counts").mapInArrow(rows, "key long, d0 long, d1 long, rep long, n long")
    counts = found.where("n >= 0").groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("links"))
    roots = components(found.where("n < 0"))
    told = each.join(counts, F.col("key") == F.col("of"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    # a vector as far from two pivots may be in both cells: all its copies have the same links and, linked, the same root
    told = told.groupBy("d0", "d1").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.min(F.coalesce("root", "rep")).alias("component_id"))
    told = written(told, "told")
    id_type = own.schema["id"].dataType.simpleString()
    known = own.where(fit).select("id", F.col("v").alias("vec")).mapInArrow(digested, f"id {id_type}, d0 long, d1 long")
    linked = known.join(told, ["d0", "d1"]).select("id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(rest).withColumnRenamed("id", id_col)
