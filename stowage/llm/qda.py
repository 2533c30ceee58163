"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its own mean and a covariance shrunk towards the pooled one and towards a multiple of the
identity. A document's raw score is the difference of the two log densities, each a Mahalanobis distance
by a cached inverse Cholesky factor plus the log determinant. A logistic link, fitted on binned raw
scores of the learning rows, turns it into a probability.

The fit needs class counts, sums and cross products only, which are summed over all labelled rows in
Spark; the driver sees a few hundred numbers. Defined results: null texts count as empty; empty texts
have statistics of zero and get a score like any other; rows without label are scored but not learned
from; repeated labels count again; with fewer than two rows of either class the score is the smoothed
share of label 1; a null id is scored, never learned from, and its ``held_out`` is false.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.memory import release, small_batches
from stowage.session import written

SHRINK, RIDGE = 0.2, 0.02
THRESHOLD = 0.7
REACH, BIN = 200.0, 0.25  # raw scores are cut at -REACH and REACH and binned in steps of BIN
MANY_WORDS = 5000
SYMBOLS = "#$%&*+<=>@[\\]^_`{|}~/"


def _logit(part: float, whole: float) -> float:
    """Log odds of a share, half a case added to either side."""
    return log((part + 0.5) / (max(whole - part, 0.0) + 0.5))


def _neighbours(words: list[str], counts: Counter) -> tuple[int, int]:
    """How many words stand behind their like, and how many different pairs of neighbours there are; of long texts by numbers, which take less memory."""
    if len(words) < MANY_WORDS:
        return sum(a == b for a, b in zip(words, words[1:], strict=False)), len(set(zip(words, words[1:], strict=False)))
    number = {w: k for k, w in enumerate(counts)}
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return int((at[1:] == at[:-1]).sum()), len(np.unique(at[:-1] * len(number) + at[1:]))


def statistics(text: str) -> list[float]:
    """What a score may see: shape of words and lines, never language, source or id."""
    words = text.split()
    n, chars = len(words), len(text)
    counts = Counter(words)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n if n else 0.0
    spread = sqrt(max(sum(x * x for x in lengths) / n - mean * mean, 0.0)) if n else 0.0
    again, pairs = _neighbours(words, counts)
    lines = [x for x in text.split("\n") if x]
    upper = sum(map(str.isupper, words))
    ends = text.count(". ") + text.count(".\n") + text.endswith(".")
    symbols = sum(map(text.count, SYMBOLS))
    top = max(counts.values(), default=0)
    letters = chars - text.count(" ") - text.count("\n")
    return [
        log1p(n),
        log1p(mean),
        log1p(spread),
        _logit(len(counts), n),
        _logit(pairs, max(n - 1, 0)),
        _logit(top, n),
        _logit(again, max(n - 1, 0)),
        _logit(upper, n),
        _logit(symbols, letters),
        _logit(text.count("!") + text.count("?"), letters),
        _logit(sum(map(text.count, "0123456789")), letters),
        _logit(text.count(",") + text.count(";") + text.count(":"), letters),
        _logit(ends, n),
        _logit(len(set(lines)), len(lines)),
        log1p(n / (len(lines) or 1)),
    ]


DIMENSIONS = len(statistics(""))


@dataclass(frozen=True)
class Model:
    means: np.ndarray
    inverse: np.ndarray  # of each class' Cholesky factor
    logdet: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        dens = [-0.5 * (((x - m) @ inv.T) ** 2).sum(1) - 0.5 * d for m, inv, d in zip(self.means, self.inverse, self.logdet, strict=True)]
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip(self.slope * self.raw(x).clip(-REACH, REACH) + self.offset, -500, 500)
        return 1 / (1 + np.exp(-z))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, x``: each whole text's statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], [id_col, "x"])
        release()

    small_batches(docs)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, x array<double>")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def _moments(known: DataFrame) -> dict[tuple[int, int], float]:
    """Sums of each class over ``(label, x)``: the count at -1, then x and its products, by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + DIMENSIONS + DIMENSIONS**2))
        for batch in batches:
            y, x = batch.column(0).to_numpy(zero_copy_only=False), _vectors(batch.column(1))
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        at = np.tile(np.arange(total.shape[1]) - 1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1])), pa.array(at), pa.array(total.ravel())], ["label", "at", "v"])

    sums = known.mapInArrow(run, "label long, at long, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    return {(r.label, r["at"]): r.v for r in sums}


def _calibrate(model: Model, known: DataFrame) -> Model:
    """Slope and offset of the logistic link by Newton steps on binned raw scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_vectors(batch.column(1))).clip(-REACH, REACH)
            at = np.rint((raw + REACH) / BIN).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], ["label", "at"])

    rows = known.mapInArrow(run, "label long, at long").groupBy("label", "at").count().collect()
    z = np.array([r["at"] * BIN - REACH for r in rows])
    y, w = np.array([float(r.label) for r in rows]), np.array([float(r["count"]) for r in rows])
    a, b = 0.1, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = w * (y - p), w * p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * z).sum() - 1e-3 * a, g.sum() - 1e-3 * b])
        a, b = a + step[0] * min(1, 1 / np.abs(step).max()), b + step[1] * min(1, 1 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.means, model.inverse, model.logdet, float(max(a, 1e-6)), float(b))


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    """Learns from the labelled rows outside the held-out fold, all of them."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marks = marks.select(F.col(id_col).alias("of"), F.col(label_col).cast("long").alias("label"))
    known = written(features.join(marks, F.col(id_col) == F.col("of")).select("label", "x"), "known")
    m = _moments(known)
    n = np.array([m.get((k, -1), 0.0) for k in (0, 1)])
    d = DIMENSIONS
    if n.min() < 2:
        return Model(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), constant=float((n[1] + 1) / (n.sum() + 2)))
    sums = np.array([[m[k, i] for i in range(d)] for k in (0, 1)])
    cross = np.array([[m[k, d + i] for i in range(d * d)] for k in (0, 1)]).reshape(2, d, d)
    means = sums / n[:, None]
    cov = cross / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.tensordot(n / n.sum(), cov, 1)
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    shrunk = [(1 - ridge) * ((1 - shrink) * c + shrink * pooled) + ridge * scale + 1e-9 * np.eye(d) for c in cov]
    factors = np.array([np.linalg.cholesky((c + c.T) / 2) for c in shrunk])
    inverse = np.array([np.linalg.inv(f) for f in factors])
    logdet = np.array([2 * np.log(np.diag(f)).sum() for f in factors])
    return _calibrate(Model(means, inverse, logdet), known)


def score(features: DataFrame, model: Model, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_vectors(batch.column(2)))
            cols = [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "held_out", "score", "predicted"])

    schema = f"`{id_col}` {features.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return features.select(id_col, held_out(F.col(id_col)).alias("held_out"), "x").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of all texts once, written; a fit on the labelled ones; a score for all."""
    features = written(featurise(docs, id_col, text_col), "features")
    return score(features, fit(features, labels, id_col), id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier accepts; texts are read twice and never shuffled."""
    model = fit(written(featurise(docs, id_col, text_col), "features"), labels, id_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                x = np.array([statistics(t.as_py() or "") for t in part.column(at)])
                yield part.filter(pa.array(model.score(x) >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema)
