import hashlib
import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stowage.llm import bpe

PATH = bpe.tokenizer_path()
LIB = Tokenizer.from_file(PATH)
OWN = bpe.WordBpe(PATH)
HARD = ["", " ", "I'LL can't don'tstop", "<|endoftext|>x<|startoftext|> <|other|>", "ΑΣ ΣΑΣ é é İ ſ K ﬁ ǅ", "a\x1cb \x1d! \x85x\xa0y", "½² 12345", "🎉🎉 foo_bar", "a" * 900, "ab!?" * 300]


def same(texts):
    for text, ids, want in zip(texts, OWN.encode(texts), LIB.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert LIB.decode(want.ids, skip_special_tokens=False) == OWN.decode(want.ids)


def test_hard_texts():
    same(HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdehiorst'!1 \t\x1c\x1fé 　Ωß")), max_size=6))
def test_random_texts(texts):
    same(texts)


def test_every_code_point():
    """Between letters, and on its own, each code point of the first planes; those that Python does not know too."""
    points = [chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200), 0x10FFFF)]
    for at in range(0, len(points), 20_000):
        same([f"a{c}b {c} 1{c}" for c in points[at : at + 20_000]])


def test_long_words():
    rng = random.Random(3)
    words = ["a" * 200_000, "".join(rng.choices("etaoinshrdlu", k=200_000)), "é" * 3000, "x" * 513 + " the", "!?" * 40_000]
    began = time.perf_counter()
    list(OWN.encode(words))
    assert time.perf_counter() - began < 8
    OWN.ids.clear()
    same([*words, "plain words " + "ing" * 300 + " end"])


def test_exact_forms_agree():
    words = ["strthnationing", "x" * 40, "éèê", "thththth"]
    symbols, ends = OWN._symbols(words)
    starts = np.concatenate([[0], ends[:-1]])
    n = ends - starts
    spots = np.minimum(starts[:, None] + np.arange(n.max() + 1), len(symbols) - 1)
    ids, count = OWN._exact_many(symbols[spots], n)
    for k, w in enumerate(words):
        assert ids[k, : count[k]].tolist() == OWN.exact(symbols[starts[k] : ends[k]]) == LIB.encode(w, add_special_tokens=False).ids


def test_query(spark):
    rows = [(k, t, "x") for k, t in enumerate([*HARD, None])] + [(0, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(bpe.digest(df).collect())
    assert len(got) == len(rows)
    for r in got:
        ids = LIB.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back[2] == LIB.decode(LIB.encode(HARD[2]).ids, skip_special_tokens=False)
    assert bpe.digest(df.limit(0)).count() == 0
