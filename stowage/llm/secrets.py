"""Secret scans: fixed patterns, and guess costs for values in a credential context.

The fixed kinds are ``assign``, ``access`` and ``hex``. The method adds kind ``guess``: a value that
follows a credential word is cut into dictionary words, dates, repeats, keyboard walks and brute-force
spans so that the sum of their guess costs in bits is least (dynamic programming over positions). A
value whose least cost reaches ``min_bits`` is a secret; a cheaper one is prose or a placeholder. The
dictionary is the corpus' own: its most frequent words, with the rank as the cost of guessing one. A
word must occur ``least`` times to be in it, so that a secret does not vouch for itself.

The costs, in bits, of a span of a value of n characters: a brute-force span the sum of its characters';
a word log2(rank + 2) and its capitals; a date that of its choices; a repeat its block's characters and
log2(n) for how often; a walk its first key and way, two for each turn and log2(n) for its length. Every
span but the first and brute-force ones costs one more. No span has a greatest length, and the work is
linear in the value.

Offsets are code points of the whole text, end exclusive; a match's span is the whole match, a guess'
span its value. Defined results: a null text is empty and has no spans; an empty corpus has an empty
dictionary; repeated rows each get their row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.memory import release, small_batches
from stowage.session import written

#: Words in the dictionary at most (a fixed size; what is broadcast stays under 2 MB), and how often each must occur.
DICTIONARY, LEAST_COUNT = 30_000, 8
#: Bits that the cheapest segmentation of a value must cost.
MIN_BITS = 44.0
#: Distinct words that a task counts before it hands them on.
FLUSH = 150_000
#: Steps of the scale of word counts for each factor of e.
STEPS_A_LOG = 64
#: Letters of a dictionary word: what makes a run of letters a word, so that the dictionary's bytes are bounded.
WORD_LETTERS = 64

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # of AKIA[A-Z0-9]+ those of 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")  # of [0-9a-f]+ those of 16 characters or more
KINDS = ("assign", "access", "hex", "guess")

# A key's name is a whole run of letters, digits, "_" and "-" that holds a credential word which ends there or at a
# digit, "_", "-" or a new capitalised part: DB_PASSWORD, clientSecret, SECRET_ACCESS_KEY, tokenValue, password2, but not
# secretary. Each run is tried at its start only, so that the work is linear.
CONTEXT = re.compile(
    r"""(?<![a-z0-9_-])(?=[a-z0-9_-]*?(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|secret)[_-]?key|auth(?:orization)?|login)"""
    r"""(?:(?![a-z])|(?-i:(?=[A-Z][a-z0-9]))))[a-z0-9_-]++["']?"""
    r"""[\x20\t]*+(?:=>|:=|[:=]|\bis\b)[\x20\t]*+(?:bearer[\x20\t]+)?["'`]?([^\s"'`<>]{8,})""",
    re.A | re.I,
)
#: Without one of these a text has no match of ASSIGN, or of CONTEXT; looked for in the lower-cased text.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "login")
WORD = re.compile(r"[^\W\d_]{3,}")
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:1[0-2]|0?[1-9])\1(?:[12]\d|3[01]|0?[1-9]))?|(?:[12]\d|3[01]|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\2(?:19|20)?\d\d", re.A)
# Rows of the common keyboard, and the two plain sequences.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")


def _steps() -> dict[tuple[str, str], int]:
    """Neighbouring keys, with the direction of the step: along a row or alphabet, or to the row below or above."""
    out = {}
    for r, row in enumerate(ROWS):
        for k in range(len(row) - 1):
            out.setdefault((row[k], row[k + 1]), 10 + (r == 4))
            out.setdefault((row[k + 1], row[k]), 20 + (r == 4))
    for upper, lower, shift in ((ROWS[0][1:], ROWS[1], 0), (ROWS[1], ROWS[2], 0), (ROWS[2], ROWS[3], 0)):
        for k, key in enumerate(upper):
            for side in (-1, 0):
                if 0 <= k + side + shift < len(lower):
                    out.setdefault((key, lower[k + side + shift]), 30 + side)
                    out.setdefault((lower[k + side + shift], key), 40 + side)
    return out


STEPS = _steps()


def char_bits(c: str) -> float:
    return log2(10) if c.isdigit() else log2(26) if c.isascii() and c.isalpha() else log2(33) if c.isascii() else log2(100)


def _word_bits(part: str, low: str, rank: int) -> float:
    return log2(rank + 2) + (0 if part == low else 1 if part[1:] == low[1:] or part.isupper() else len(part))


def _date_bits(length: int) -> float:
    return log2(365 * 60) if length > 4 else log2(120)


def guess_bits(value: str, ranks: dict[str, int], limit: float = MIN_BITS, longest: int = WORD_LETTERS) -> float:
    """Least cost in bits of a segmentation of ``value`` if that is under ``limit``; else something not under it.

    Repeats and walks that end at a place are those that start in the same run, so the best start is kept by
    run and nothing is tried twice. A span that costs ``limit`` alone is in no cheaper segmentation: that bounds
    the blocks of repeats, and the search ends where no start under ``limit`` is left to go on from.
    """
    n, low, inf = len(value), value.lower(), float("inf")
    if len(low) != n:
        low = value
    count = log2(max(n, 2))
    walk = log2(47) + 2.0 + count
    most = min(int(limit / log2(10)), n // 2)
    best = [0.0] + [inf] * n
    bits = [char_bits(c) for c in value]
    sums = [0.0, *accumulate(bits)]
    # by length of the block: where its run starts, and the best cost before a repeat in that run
    begins, before = [0] * (most + 1), [inf] * (most + 1)
    ways = [STEPS.get((low[k], low[k + 1])) for k in range(n - 1)]
    turns, ahead = [0] * max(n, 1), inf  # turns: how often the way has changed up to a step
    for k in range(1, n - 1):
        turns[k] = turns[k - 1] + (ways[k] != ways[k - 1])
    last = 0  # the last place that costs less than the limit
    for end in range(n + 1):
        if end:
            cost = best[end - 1] + bits[end - 1]
            for p in range(1, most + 1):
                if end > p and value[end - 1] != value[end - 1 - p]:
                    begins[p], before[p] = end - p, inf
                i = end - max(3, 2 * p)
                if i >= begins[p]:
                    before[p] = min(before[p], best[i] + (i > 0))
                    cost = min(cost, before[p] + sums[i + p] - sums[i] + count)
            if end >= 3:
                i = end - 3
                if ways[end - 2] is None:
                    ahead = inf
                elif ways[i] is not None:
                    ahead = min(ahead, best[i] + (i > 0) - 2 * turns[i])
                    cost = min(cost, ahead + walk + 2 * turns[end - 2])
            best[end] = min(best[end], cost)
        here = best[end] + (end > 0)
        if best[end] < limit:
            last = max(last, end)
            if end < n and low[end].isalpha():
                for to in range(end + 2, min(n, end + longest) + 1):
                    if not low[to - 1].isalpha():
                        break
                    rank = ranks.get(low[end:to])
                    if rank is not None:
                        cost = here + _word_bits(value[end:to], low[end:to], rank)
                        best[to] = min(best[to], cost)
                        last = max(last, to if cost < limit else 0)
            if end < n and low[end].isdigit() and (m := DATE.match(low, end)):
                best[m.end()] = min(best[m.end()], here + _date_bits(m.end() - end))
                last = max(last, m.end() if best[m.end()] < limit else 0)
        if end > last + max(2 * most, 3) and min(min(before, default=inf), ahead + 2 * turns[max(end - 2, 0)]) >= limit:
            return inf
    return best[n]


def spans(text: str, ranks: dict[str, int], min_bits: float = MIN_BITS) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, start of the value)`` by start, then kind; values that a fixed span covers whole are not guessed."""
    low = text.lower()
    assigns = ASSIGN.finditer(text) if any(w in low for w in ASSIGN_WORDS) else ()
    out = [(m.start(), 0, m.end(), m.start(2)) for m in assigns if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    # by start of the value: how far any span that starts there or before reaches
    fixed = sorted((v, e) for _, _, e, v in out)
    starts, reach = [v for v, _ in fixed], list(accumulate((e for _, e in fixed), max))
    added = []
    for m in CONTEXT.finditer(text) if any(w in low for w in CONTEXT_WORDS) else ():
        start, value = m.start(1), m.group(1).rstrip(".,;:!?)]}|")
        end, at = start + len(value), bisect_right(starts, start) - 1
        if len(value) >= 8 and not (at >= 0 and reach[at] >= end) and guess_bits(value, ranks, min_bits) >= min_bits:
            added.append((start, 3, end, start))
    return sorted(out + added)


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY, least: int = LEAST_COUNT) -> dict[str, int]:
    """The corpus' most frequent words (lower case, 3 to ``WORD_LETTERS`` letters) by rank, counted over all texts.

    At most ``size``, of those that occur ``least`` times; in order of count, then word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(w for w in WORD.findall((text.as_py() or "").lower()) if len(w) <= WORD_LETTERS)
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()
        release()

    counts = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.col("n") >= least), "words")
    # by a short histogram of counts, so that no task sends more than its part of the dictionary: the steps that fit
    # whole, and of the next one the first ranges of its order that do, with the head of the range after them
    step = F.floor(F.log("n") * STEPS_A_LOG)
    bar, held, crossing = None, 0, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if held + r["count"] > size:
            crossing = r.step
            break
        held += r["count"]
        bar = r.step
    top = counts.where(step >= bar).collect() if bar is not None else []
    if crossing is not None and held < size:
        order = (F.desc("n"), F.asc("word"))
        rest = counts.where(step == crossing).repartitionByRange(*order).sortWithinPartitions(*order)
        rest = written(rest.select("word", "n", F.spark_partition_id().alias("range")), "crossing")
        whole = -1
        for r in rest.groupBy("range").count().orderBy("range").collect():
            if held + r["count"] > size:
                top += rest.where(F.col("range") == r["range"]).orderBy(*order).limit(size - held).collect()
                break
            held, whole = held + r["count"], r["range"]
        top += rest.where(F.col("range") <= whole).collect()
    return {r.word: k for k, r in enumerate(sorted(top, key=lambda r: (-r.n, r.word)))}


def _scan(docs: DataFrame, names: list[str], schema: str, row, min_bits: float, ranks: dict[str, int] | None, text_col: str) -> DataFrame:
    small_batches(docs)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, text_col) if ranks is None else ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text_col) if at is None else at
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [row(t or "", spans(t or "", known.value, min_bits)) for t in part.column(at).to_pylist()]
                yield from row.batch(part, rows)
        release()

    return docs.select(*names).mapInArrow(run, schema)


class _Digest:
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def __call__(self, text: str, found: list) -> tuple:
        said = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found if k < 3]
        count = Counter(k for _, k, _, _ in found)
        every = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found)
        return count[0], count[1], count[2], hashlib.sha256(",".join(said).encode()).hexdigest(), every

    def batch(self, part: pa.RecordBatch, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        names = [part.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([part.column(0), *cols], names)


class _Redact:
    def __init__(self, mark: str, text_at: int, chars_at: int):
        self.mark, self.text_at, self.chars_at = mark, text_at, chars_at

    def __call__(self, text: str, found: list) -> str:
        out, at = [], 0
        for start, _, end, value in sorted(found, key=lambda x: x[3]):
            if value >= at:
                out += [text[at:value], self.mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if found else text

    def batch(self, part: pa.RecordBatch, rows: list[str]) -> Iterator[pa.RecordBatch]:
        cols = list(part.columns)
        old = cols[self.text_at].is_null().to_pylist()
        cols[self.text_at] = pa.array([None if gone else t for t, gone in zip(rows, old, strict=True)], pa.string())
        if self.chars_at >= 0:
            kind = cols[self.chars_at].type
            before = part.column(self.text_at).to_pylist()
            cols[self.chars_at] = pa.array([c if t == b or b is None else len(t) for c, t, b in zip(part.column(self.chars_at).to_pylist(), rows, before, strict=True)], kind)
        yield pa.RecordBatch.from_arrays(cols, part.schema.names)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = MIN_BITS, ranks: dict[str, int] | None = None) -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, base_sha256, spans`` for every text."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_Digest.schema}"
    return _scan(docs, [id_col, text_col], schema, _Digest(), min_bits, ranks, text_col)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[REDACTED]", min_bits: float = MIN_BITS, ranks: dict[str, int] | None = None) -> DataFrame:
    """All rows and columns, each secret's value replaced by ``mark``; ``chars_col``, if there, follows the text."""
    names = docs.columns
    row = _Redact(mark, names.index(text_col), names.index(chars_col) if chars_col in names else -1)
    return _scan(docs, [f"`{n}`" for n in names], docs.schema, row, min_bits, ranks, text_col)
