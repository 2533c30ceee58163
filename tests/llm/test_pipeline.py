"""The pipeline against a plain run of its rules, and the registry of queries."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stowage.llm import bpe, mixing, qda, queries, secrets
from tests.llm.test_shingles import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, tmp_path):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 9))) for _ in range(600)]
    prose = lambda: ". ".join(" ".join(rng.choices(vocab, k=9)).capitalize() for _ in range(rng.randint(3, 12))) + "."
    docs = []
    for k in range(160):
        text = prose() if k % 4 else "SALE!! " * 40 + str(k)
        if k % 16 == 1:
            text += " token = abcdef0123456789abcdef99 " + prose()
        docs.append((k, text))
    docs += [(200 + k, docs[4 * k + 1][1] + " tail.") for k in range(10)] + [(300, None), (301, ""), (302, docs[5][1])]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows


def test_stages(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    good = {r.doc_id for r in qda.classify(docs, labels).where("predicted = 1").collect()}
    assert {k for k in range(160) if k % 4} <= good and not any(k in good for k in range(0, 160, 4))
    left = [r for r in rows if r[0] in good]
    root = brute([r[:2] for r in left])[1]
    left = [r for r in left if root[r[0]] == r[0]]
    assert not any(200 <= r[0] < 210 or r[0] == 302 for r in left)
    ranks = secrets.vocabulary(spark.createDataFrame(left, COLUMNS))
    hidden = []
    for r in left:
        hide = set()
        for _, _, end, value in secrets.spans(r[1] or "", ranks):
            hide |= set(range(value, end))
        text = r[1] and re.sub("\0+", "[REDACTED]", "".join("\0" if k in hide else c for k, c in enumerate(r[1])))
        hidden.append((r[0], text, r[2], r[3], r[4] if text == r[1] else len(text)))
    assert sum("[REDACTED]" in (r[1] or "") for r in hidden) >= 9
    plan = mixing.plan(spark.createDataFrame(hidden, COLUMNS)).collect()
    copies = {p.id: 1 if p.size == 0 else p.epochs + (2 * p.last_words >= p.size and p.last_words > 0) for p in plan}
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    want = Counter()
    for r in hidden:
        want[r[0], len(lib.encode(r[1] or "", add_special_tokens=False).ids)] += copies[r[0]]
    got = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


def test_order_of_the_mixture(spark, tmp_path):
    """The last rows' positions are the mixture's order, though its part files are read in another one."""
    tables(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = corpus_pipeline.mixture(spark, docs, str(tmp_path))
        path = str(tmp_path / "mixed")
        mixed.write.parquet(path)
        want = [r.doc_id for r in mixed.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    again = spark.read.parquet(path)
    assert len(again.inputFiles()) >= 4
    for read in (again, spark.read.parquet(*sorted(again.inputFiles(), reverse=True))):
        got = sorted(corpus_pipeline.encoding(spark, read, str(tmp_path)).collect(), key=lambda r: r.position)
        assert [r.position for r in got] == list(range(len(want)))
        assert [r.doc_id for r in got] == want


def test_near_copies_by_row(spark, tmp_path):
    """Of an id with several texts only the copies go; repeated rows stay, and rows without id."""
    x, y, z = (" ".join(f"{c}{k}" for k in range(30)) for c in "xyz")
    rows = [(5, x), (5, y), (3, y), (4, z), (4, z), (6, z + " end"), (5, z), (None, y), (None, None), (9, None)]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], COLUMNS)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, df, str(tmp_path)).collect())
    assert got == Counter([(5, x), (3, y), (4, z), (4, z), (None, y), (None, None), (9, None)])


CLASHES = ("copy", "hash", "component_id", "row", "position", "spans", "of", "size", "key", "range", "_file", "_row", "at")


def test_stages_keep_columns(spark, tmp_path):
    """Columns of any name come through, in order, empty tables too; the last stage has columns of its own."""
    tables(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, _stored(spark, docs.limit(0), tmp_path / f"e{k}"), str(tmp_path))
        assert empty.count() == 0
        out = stage(spark, docs, str(tmp_path))
        if name != "encoding":
            assert out.columns == empty.columns == docs.columns
            docs = _stored(spark, out, tmp_path / f"o{k}")
            assert docs.count() > 50 and {tuple(r) for r in docs.select(*CLASHES).distinct().collect()} == {tuple(range(len(CLASHES)))}
        else:
            assert out.columns == empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "position"]
            assert sorted(r.position for r in out.collect()) == list(range(docs.count()))


def _stored(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_odd_rows(spark, tmp_path):
    """Null, empty, repeated and very long texts, null and repeated ids, null sources and nulls elsewhere: each row goes where the stages' rules say."""
    tables(spark, tmp_path)
    words = "the plain old morning went over to their garden and under one house without any trouble".split()
    rng = random.Random(4)
    prose = lambda n: ". ".join(" ".join(rng.choices(words, k=9)).capitalize() for _ in range(n)) + "."
    long, same = prose(30_000), prose(8)
    odd = [(900, None, None, None, None), (901, "", "en", None, 0), (None, None, "en", "s0", 0), (None, same, "en", "s1", None), (None, same, "en", "s1", None), (903, same, None, "s1", 5), (903, same, None, "s1", 5), (904, long, "en", None, len(long)), (905, same + " more words.", "en", "s2", 1)]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).union(spark.createDataFrame(odd, COLUMNS))
    docs.write.parquet(str(tmp_path / "odd/documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(tmp_path / "odd/labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted(r.position for r in got) == list(range(len(got)))
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(odd, COLUMNS), str(tmp_path)).collect()
    assert Counter(r.doc_id for r in kept) == Counter({None: 3, 900: 1, 901: 1, 903: 2, 904: 1})
    hidden = corpus_pipeline.hide_secrets(spark, spark.createDataFrame(odd, COLUMNS), str(tmp_path)).collect()
    assert sorted(map(str, hidden)) == sorted(str(r) for r in spark.createDataFrame(odd, COLUMNS).collect())
    mixed = corpus_pipeline.mixture(spark, spark.createDataFrame(odd, COLUMNS), str(tmp_path)).collect()
    assert [r.doc_id for r in mixed if not r.text] == [None, 900, 901] or {r.doc_id for r in mixed[-3:]} == {None, 900, 901}
    assert spark.createDataFrame(odd, COLUMNS).count() == len(odd) and corpus_pipeline.quality(spark, spark.createDataFrame(odd, COLUMNS), str(tmp_path)).count() <= len(odd)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.queries()) | {"pipeline"} <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
