"""Range join and nearest neighbours against brute force."""

from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from stowage.llm import components, postings, rangejoin, vectors


def union_find(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 400, (260, 2))] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)] + [(7, 7), (5000, 5000)]
    df = spark.createDataFrame([*edges, *edges[:9]], "a long, b long").union(spark.createDataFrame([(None, 3)], "a long, b long"))
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == union_find(edges, {x for e in edges for x in e})


def test_no_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def clustered(rng, n, d, centers, noise):
    c = rng.normal(size=(centers, d))
    x = c[rng.integers(0, centers, n)] + noise * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


ODD = [None, [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0, 2.0], []]


@pytest.mark.parametrize(("cell", "most", "large"), [(60, 8192, 4), (20, 4, 1), (20, 3, 3)])
def test_range_join(spark, monkeypatch, cell, most, large):
    monkeypatch.setattr(rangejoin, "CELL", cell)
    monkeypatch.setattr(rangejoin, "MOST_PIVOTS", most)
    monkeypatch.setattr(rangejoin, "LARGE", large)
    monkeypatch.setattr("stowage.llm.vectors.PACK", 40)
    rng = np.random.default_rng(7)
    x = clustered(rng, 500, 16, 12, 0.11)
    x[100:160] = x[3]  # copies
    x[200:220] = 2 * x[5] + 0.001 * rng.normal(size=(20, 16))  # near copies, other length
    x[300] = -0.0 * x[300] + np.eye(16)[0]
    rows = [(k * 3, v.tolist(), 1) for k, v in enumerate(x)] + [(9000 + k, v, 2) for k, v in enumerate(ODD)] + [(None, x[0].tolist(), 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int").repartition(6)
    got = rangejoin.near_duplicates(df).collect()
    assert len(got) == len(rows)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    root = union_find([(3 * a, 3 * b) for a, b in zip(*np.nonzero(linked), strict=True)], [3 * k for k in range(500)])
    by = {r.vec_id: r for r in got}
    assert len(set(root.values())) > 5
    for k in range(500):
        r = by[3 * k]
        assert (r.n_links, r.component_id, r.kept) == (linked[k].sum() - 1, root[3 * k], root[3 * k] == 3 * k)
    for k in range(len(ODD)):
        assert tuple(by[9000 + k])[1:] == (0, 9000 + k, True)
    assert tuple(by[None]) == (None, 0, None, True)
    assert rangejoin.near_duplicates(df.limit(0)).count() == 0


def test_cells_know_all_partners():
    rng = np.random.default_rng(2)
    x = clustered(rng, 900, 8, 20, 0.2).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    p = rangejoin.place_pivots(x, 15)
    home, close = rangejoin.cells_of(u, p, np.sqrt(0.2))
    a, b = np.nonzero(u @ u.T >= 0.9)
    assert (close[b, home[a]] | close[a, home[b]]).all() and close.mean() < 0.5
    foreign = rangejoin.cells_of(u, p, np.sqrt(0.2), turns=False)[1]
    assert foreign[b, home[a]].all() and foreign.mean() < 0.8


@pytest.mark.parametrize("centers", [0, 30])
def test_nothing_is_replicated(spark, monkeypatch, centers):
    """However many cells there are, and whether or not pivots tell vectors apart, vectors are shuffled once."""
    for name, value in {"CELL": 60, "SAMPLE": 200, "SAMPLE_A_PIVOT": 2}.items():
        monkeypatch.setattr(rangejoin, name, value)
    rng = np.random.default_rng(4)
    x = clustered(rng, 6000, 128, centers, 0.1) if centers else clustered(rng, 6000, 128, 1, 1e3)
    x[50:2000:50] = x[7] + 0.01 * rng.normal(size=(39, 128)) / np.sqrt(128)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorList(True).apply(0).totalShuffleWrite()
    got = {r.vec_id: r.n_links for r in rangejoin.near_duplicates(df).collect()}
    shuffled = store.executorList(True).apply(0).totalShuffleWrite() - before
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert [got[k] for k in range(6000)] == ((u @ u.T >= 0.9).sum(1) - 1).tolist()
    assert shuffled < 2 * x.nbytes


@pytest.mark.parametrize("groups", [1, 2, 3, 8, 9])
def test_groups_meet_once(groups):
    met = sorted(tuple(sorted((g, o))) for g in range(groups) for o in rangejoin.turns(g, groups))
    assert met == [(a, b) for a in range(groups) for b in range(a, groups)]


@pytest.mark.parametrize("cosine", [0.9, 0.3, -0.5])
def test_blocks_lose_no_link(cosine):
    """By every bound and with few axes: the links of two blocks, and of one, are those of a full product."""
    rng = np.random.default_rng(6)
    x = clustered(rng, 600, 24, 6, 0.2).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = rangejoin.place_pivots(x, 5)
    home = rangejoin._homes(x, p)[0]
    n = rng.integers(1, 5, 600)
    for axes in (rangejoin.axes_of(x, cosine), np.linalg.eigh(x.T @ x)[1][:, -2:], np.eye(24)):

        def block(of):
            angle = np.arccos(np.clip(x[of] @ p[home[of[0]]], -1, 1))
            row = {"home": home[of[0]], "low": angle.min(), "high": angle.max(), "key": 0, "size": len(of), "reps": of.tobytes(), "counts": n[of].tobytes(), "vecs": x[of].tobytes(), "kind": "f8"}
            return rangejoin.Block(row, 24, axes)

        blocks = [block(np.flatnonzero(home == h)) for h in np.unique(home)]
        edges = [(int(a), int(b)) for k, one in enumerate(blocks) for two in blocks[k:] for ends in rangejoin.links_of(one, two, p, cosine) for a, b in zip(*ends, strict=True)]
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        for b in blocks:
            assert (b.links == (linked @ n)[b.rep]).all()
        assert union_find(edges, range(600)) == union_find(zip(*np.nonzero(linked), strict=True), range(600))


def test_many_pivots(monkeypatch):
    monkeypatch.setattr(rangejoin, "FAR", 10)
    x = np.random.default_rng(3).normal(size=(400, 6))
    p = rangejoin.place_pivots(x, 50)
    assert len(p) == 50 and len(np.unique(p, axis=0)) == 50
    assert len(rangejoin.place_pivots(x[:7], 50)) == 7


def brute(ids, x, k, asks):
    out = {}
    for i, (own, v) in enumerate(zip(ids, x, strict=True)):
        if asks(own):
            s = x @ v
            out[own] = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != i)[:k]
    return out


def test_search(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 3000, 24, 8, 0.35)
    x[500:1500:4] = x[40]  # a vector that many rows hold, queries among them
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(20 * 1000 + 20 * k, (v or [])[:24], 0) for k, v in enumerate([None, [], [0.0] * 24, [float("nan")] * 24])] + [(None, x[1].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(5)
    got = defaultdict(list)
    from pyspark.sql import functions as F

    for r in postings.search(df, F.col("id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y = x.astype(np.float64)
    want = brute(list(range(3000)), y, 20, lambda i: i % 20 == 0)
    assert set(got) == set(want)
    hit = 0
    for q, near in want.items():
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        assert all(s == pytest.approx(y[q] @ y[v], abs=1e-12) for _, v, s in own)
        hit += len({v for _, v, _ in own} & {v for _, v in near})
    assert hit / (20 * len(want)) >= 0.9
    tied = sorted(got[560])  # holds the common vector: its copies in order of id
    assert [v for _, v, _ in tied] == [40, *[k for k in range(500, 1500, 4) if k != 560][:19]]


def test_search_small(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 9.0]), (40, [-1.0, 0.1])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in postings.search(df, F.col("id") % 20 == 0).collect())
    assert got == sorted([(20, 1, 20, 1.0), (20, 2, 3, 0.5), (20, 3, 40, -1.0)] * 2 + [(40, 1, 3, 0.4), (40, 2, 20, -1.0), (40, 3, 20, -1.0)])
    assert postings.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def uneven(rng, n, d, centers):
    """Unit vectors, clustered if there are centers, and lengths that differ much."""
    x = clustered(rng, n, d, centers, 0.06 * np.sqrt(d)) if centers else rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True), rng.lognormal(0, 0.5, size=(n, 1))


@pytest.mark.parametrize(("centers", "even", "most"), [(0, True, 0.85), (150, True, 0.15), (0, False, 0.5), (150, False, 0.15)])
def test_lists_are_balanced_and_pruned(centers, even, most):
    """Whatever the lengths: no list holds three times the median, most lists go unread, and few neighbours are missed."""
    rng = np.random.default_rng(9)
    x, length = uneven(rng, 20_000, 64, centers)
    x = (x if even else x * length).astype(np.float64)
    index = postings.Index(x[rng.permutation(len(x))[:8192]], len(x) // postings.LIST)
    posted = [h for k in range(0, len(x), 1024) for h in index.homes(x[k : k + 1024])]
    flat, owner = np.concatenate(posted), np.repeat(np.arange(len(x)), [len(p) for p in posted])
    sizes = np.bincount(flat, minlength=len(index.means))
    assert sizes.max() <= 3 * np.median(sizes) and sizes.sum() <= 2 * len(x)
    rows = []
    for k in np.flatnonzero(sizes):
        own = x[owner[flat == k]]
        along, rest = index.along(own, np.full(len(own), k))
        rows.append(SimpleNamespace(list=k, n=len(own), rest=rest.sum(), least=along.min(), most=along.max(), longest=np.linalg.norm(own, axis=1).max()))
    index.measure(rows)
    asks = rng.permutation(len(x))[:300]
    s = x[asks] @ x.T
    s[np.arange(300), asks] = -np.inf
    first = index.reads(x[asks])
    bars = np.array([np.sort(s[i, np.isin(np.arange(len(x)), owner[np.isin(flat, f)])])[-20] for i, f in enumerate(first)])
    hit = read = 0
    for i, (f, later) in enumerate(zip(first, index.reads(x[asks], bars), strict=True)):
        lists = np.union1d(f, later)
        known = np.unique(owner[np.isin(flat, lists)])
        hit += np.isin(np.argsort(-s[i])[:20], known).sum()
        read += sizes[lists].sum()
    assert hit / 6000 >= 0.95 and read / sizes.sum() / 300 <= most


def test_sample_is_the_same_in_every_run(spark):
    rng = np.random.default_rng(1)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(3000, 4)))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    one, two = (vectors.sample_of(vectors.distinct_vectors(df.repartition(k), "id", "v", 1), 3000, 400, 4) for k in (2, 7))
    assert (one == two).all() and 300 < len(one) < 500


def test_graph_search_is_nearly_exact():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 12))
    c = postings.balanced_centroids(x, 500)
    assert len(c) == 500
    q = rng.normal(size=(200, 12))
    ids, dist = postings.CentroidGraph(c).search(q, 10)
    d = np.sqrt(((q[:, None] - c[None]) ** 2).sum(2))
    true = np.argsort(d, 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids, true, strict=True)]) > 9.8
    assert np.allclose(dist, np.take_along_axis(d, ids, 1))
