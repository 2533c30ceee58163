"""The grouped prefix join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from stowage.llm import shinglejoin
from tests.llm.test_vectors import union_find


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    edges = []
    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if a and sets[j] and 100 * inter >= 75 * (len(a) + len(sets[j]) - inter):
                edges.append((docs[i][0], docs[j][0]))
    return [len(s) for s in sets], union_find(edges, [d[0] for d in docs])


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    make = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, texts = make(60), []
    for _ in range(n // 4):
        texts.append(" ".join(make(rng.choice([0, 1, 3, 4, 5, 6, 9, 40, 120]))))
    for _ in range(n // 8):  # a passage that unrelated texts share
        texts.append(" ".join(make(rng.randint(5, 90)) + passage + make(rng.randint(5, 90))))
    for _ in range(n // 20):  # chains of ever more edits, and copies
        base = make(rng.choice([30, 80, 200]))
        for _ in range(8):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 30])):
                base[rng.randrange(len(base))] = rng.choice(vocab)
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(shinglejoin, "FREQUENT", ((3, 9, 30), (1000,), (2, 3))[seed])
    monkeypatch.setattr(shinglejoin, "WIDE", (8, 2, 1)[seed])
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n string").repartition(1 + 3 * seed)
    got = {r.doc_id: r for r in shinglejoin.near_duplicates(df).collect()}
    sizes, root = brute(docs)
    assert len(set(root.values())) < len(docs)
    for (k, _), n in zip(docs, sizes, strict=True):
        assert (got[k].n_shingles, got[k].component_id) == (n, root[k])


def test_odd_rows(spark):
    text = " ".join(f"v{k}" for k in range(30))
    docs = [(5, text), (5, text), (9, "V0" + text[2:].replace(" ", "\t\x0b")), (1, None), (2, ""), (3, " \n"), (4, "a b"), (6, "A b"), (7, "a\xa0b"), (8, "a b"), (10, " ".join(["same"] * 20000))]
    df = spark.createDataFrame([*docs, (None, text), (None, "alone")], "doc_id long, text string")
    got = Counter(map(tuple, shinglejoin.near_duplicates(df).collect()))
    assert got == Counter([(5, 26, 5), (5, 26, 5), (9, 26, 5), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (6, 1, 4), (7, 1, 7), (8, 1, 4), (10, 1, 10), (None, 26, 5), (None, 1, None)])
    assert shinglejoin.near_duplicates(df.limit(0)).count() == 0


def test_null_ids_first(spark):
    """A row without id that comes first in its task does not take the prefix of its group from those with ids."""
    words = [f"u{k}" for k in range(50)]
    text, near = " ".join(words), " ".join([*words[:25], "other", *words[26:]])
    df = spark.createDataFrame([(None, text), (5, text), (None, near), (7, near), (None, None)], "doc_id long, text string").coalesce(1)
    got = Counter(map(tuple, shinglejoin.near_duplicates(df).collect()))
    assert got == Counter([(None, 46, 5), (5, 46, 5), (None, 46, 5), (7, 46, 5), (None, 0, None)])


def test_ids_with_several_texts(spark):
    """An id is one node, so that its texts link the ids that share them."""
    x, y, z = (" ".join(f"{c}{k}" for k in range(30)) for c in "xyz")
    df = spark.createDataFrame([(5, x), (5, y), (3, y), (8, x), (9, z), (7, z), (8, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in shinglejoin.near_duplicates(df).where("n_shingles > 0").collect())
    assert got == Counter([(5, 3), (5, 3), (3, 3), (8, 3), (9, 7), (7, 7)])


def test_bounds():
    for n1 in range(1, 60):
        for n2 in range(1, 60):
            least = next(i for i in range(200) if 100 * i >= 75 * (n1 + n2 - i))
            assert shinglejoin.needed(n1, n2) == least
        assert shinglejoin.prefix_length(n1) == n1 - int(np.ceil(0.75 * n1)) + 1


def test_hashes_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["Ab", "c", "dé", "x" * 50], k=rng.randint(0, 300))).encode() for _ in range(40)] + [None, b"y" * 900 + b" a b c d e f"]
    want = [len(shingles(t and t.decode())) for t in texts]
    whole = shinglejoin.Hasher(5).sets(texts)
    assert [len(x) for x in whole] == want
    monkeypatch.setattr(shinglejoin, "SLICE", 101)
    cut = shinglejoin.Hasher(5)
    assert all((a == b).all() for a, b in zip(whole, cut.sets(texts), strict=True))
    assert all((a == cut.sets([t])[0]).all() for a, t in zip(whole, texts, strict=True))
    assert shinglejoin.Hasher(5).sets([]) == []


def test_words_that_polynomials_confuse(spark):
    """Words that polynomials modulo a power of two take for one another, and long ones that differ in a byte."""
    morse = "".join("ab"[k.bit_count() & 1] for k in range(1024))
    words = [morse, morse.translate(str.maketrans("ab", "ba")), morse[:128], morse[:127] + "c", morse[:129], morse[:8], morse[:7] + "c", "x" * 16, "x" * 17]
    df = spark.createDataFrame([(k, w) for k, w in enumerate([*words, morse.upper()])], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shinglejoin.near_duplicates(df).collect()}
    assert got == {k: (1, k % len(words)) for k in range(len(words) + 1)}


def test_families_are_independent():
    """Both families tell the same shingles apart, and share no hash."""
    texts = [" ".join(random.Random(k).choices("abcdef", k=40)).encode() for k in range(30)]
    one, two = (shinglejoin.Hasher(5, (k,)).sets(texts) for k in (0, 1))
    assert [len(x) for x in one] == [len(x) for x in two] == [len(shingles(t.decode())) for t in texts]
    assert not set(np.concatenate(one)) & set(np.concatenate(two))
    sets, sums = shinglejoin.Hasher(5, (0, 1)).sets([*texts, texts[0] + b" ", b"a b", None, b"A\nb"], sums=True)
    assert sums[30] == sums[0] and sums[31] == sums[33] and sums[32] == 0 and len(set(sums)) == 32


def test_repeated_passages_of_a_text(spark):
    """Texts of one set that hold its shingles a different number of times are copies."""
    words = " ".join(f"r{k}" for k in range(12))
    df = spark.createDataFrame([(3, f"{words} {words}"), (1, f"{words} {words} {words}"), (2, f"{words} {words}")], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in shinglejoin.near_duplicates(df).collect()} == {(3, 12, 1), (1, 12, 1), (2, 12, 1)}


def test_long_lists_over_many_tasks(spark):
    """A shingle of a third of all texts, over more tasks than its list has rows, loses no link."""
    rng = random.Random(4)
    docs = []
    for k in range(0, 240, 2):
        own = [f"s{rng.randrange(10**6)}" for _ in range(24)]
        docs += [(k, " ".join(["the common opening line here", *own])), (k + 1, " ".join(["the common opening line here", *own, f"e{k}"]))]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.component_id for r in shinglejoin.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: k - k % 2 for k, _ in docs}


def test_groups_with_several_classes(spark):
    """Sets of one size with equal prefixes but different tails: told apart, and verified with each other."""
    order = shinglejoin.Order([])
    base = np.sort(np.random.default_rng(1).integers(-(2**62), 2**62, 40))
    other = base.copy()
    other[-1] += 1
    (a, b), _ = order.prefixes([base, other], 75)
    assert (a == b).all() and len(a) == shinglejoin.prefix_length(40)
    words = [f"t{k}" for k in range(44)]
    docs = [(k, " ".join([*words[:-1], f"end{k}"])) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.component_id for r in shinglejoin.near_duplicates(df).collect()} == {0}
