"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has its own mean and shrinkage covariance; a score is the difference of the two
Mahalanobis log densities, each through a Cholesky factor that is computed once.  Class
moments are summed over ALL labelled training rows in Spark; the driver only sees two
d-by-d matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselle.llm import textkit as tk
from tesselle.llm.labelled import held_out, one_label
from tesselle.scratch import stash

FEATURES = ("words", "word_len", "upper", "digits", "stops", "symbols", "high", "lines", "distinct", "repeats", "line_repeats", "marked", "singles")
_EPS = 0.004
#: Shares are drawn towards _EPS as if so many more bytes or words had been seen, so that one odd word in a short text weighs little.
_BYTES, _WORDS = 150, 25
_UPPER, _DIGIT = tk.lut(range(65, 91)), tk.lut(range(48, 58))
_STOPS, _LETTER = tk.lut(b".,;:'-"), tk.lut([*range(65, 91), *range(97, 123), *range(128, 256)])
_SYMBOL = tk.lut([b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) and b not in b".,;:'-"])
_NEWLINE = tk.lut(b"\n")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text; an empty text has all counts at zero."""
    n = len(offsets) - 1
    size = offsets[1:] - offsets[:-1]
    starts, ends, first = tk.spans(data, offsets, tk.SPACES)
    rows, words = tk.row_of(first), np.diff(first)
    many = np.maximum(words, 1)
    share = lambda table: np.log((tk.per_row(table[data], offsets) + _EPS * _BYTES) / (size + _BYTES))
    rate = lambda counted: np.log((counted + _EPS * _WORDS) / (words + _WORDS))
    h = tk.span_hashes(data, starts, ends)
    again = np.zeros(len(h), bool)
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    ls, le, lf = tk.spans(data, offsets, _NEWLINE)
    lines = np.diff(lf)
    line_distinct = tk.distinct_per_row(tk.span_hashes(data, ls, le), tk.row_of(lf), n)
    # A word is marked if its last byte is a symbol; alone if it is one byte and no letter.
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    alone = (ends - starts == 1) & ~_LETTER[last]
    count = lambda mask: np.bincount(rows[mask], minlength=n)
    plain = np.stack(
        [
            np.log1p(words),
            np.log1p(np.bincount(rows, weights=(ends - starts), minlength=n) / many),
            *(share(x) for x in (_UPPER, _DIGIT, _STOPS, _SYMBOL, tk.lut(range(128, 256)))),
            rate(lines),
            rate(words - tk.distinct_per_row(h, rows, n)),
            rate(count(again)),
            np.log((lines - line_distinct + 0.05) / (lines + 5)),
            rate(count(_SYMBOL[last])),
            rate(count(alone)),
        ],
        axis=1,
    )
    return plain


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, x array<double>)`` for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column(2)):
                x = statistics(data, offsets)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), flat], names=["doc_id", "held_out", "x"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, x array<double>")


@dataclass
class QuadraticDiscriminant:
    """Two Gaussians: class means, inverse Cholesky factors and log determinants."""

    mean: np.ndarray  # 2 x d
    whiten: np.ndarray  # 2 x d x d, inverse of the lower Cholesky factor
    log_det: np.ndarray  # 2
    log_prior: np.ndarray  # 2

    @classmethod
    def from_moments(cls, count: np.ndarray, first: np.ndarray, second: np.ndarray, shrink: float) -> QuadraticDiscriminant | None:
        """``shrink``: the share of each covariance replaced by its own diagonal and mean variance."""
        if min(count) < 2:
            return None
        d = first.shape[1]
        mean = first / count[:, None]
        whiten, log_det = np.empty((2, d, d)), np.empty(2)
        for k in (0, 1):
            cov = second[k] / count[k] - np.outer(mean[k], mean[k])
            weight = max(shrink, d / (count[k] + d))
            cov = (1 - weight) * cov + weight * (0.5 * np.diag(np.diag(cov)) + 0.5 * np.eye(d) * np.trace(cov) / d) + 1e-6 * np.eye(d)
            chol = np.linalg.cholesky(cov)
            whiten[k], log_det[k] = np.linalg.inv(chol), 2 * np.log(np.diag(chol)).sum()
        return cls(mean, whiten, log_det, np.log(count / count.sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        log = np.stack([self.log_prior[k] - 0.5 * (self.log_det[k] + (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(1)) for k in (0, 1)])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))


def fit(feats: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = 0.05) -> QuadraticDiscriminant | None:
    """Learn from all labelled rows that aren't held out; None if a class has under two rows.

    The class moments come from one grouped aggregate (with partial sums before the
    shuffle), so no row reaches the driver.
    """
    d = len(FEATURES)
    known = feats.filter(~F.col("held_out")).join(one_label(labels, label), "doc_id")
    x = [F.col("x")[i] for i in range(d)]
    sums = known.groupBy("y").agg(F.count("*").alias("n"), F.array(*(F.sum(c) for c in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i in range(d) for j in range(i + 1))).alias("q"))
    count, first, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    low = np.tril_indices(d)
    for r in sums.collect():  # two rows
        count[r.y], first[r.y] = r.n, r.s
        second[r.y][low] = r.q
        second[r.y] += np.tril(second[r.y], -1).T
    return QuadraticDiscriminant.from_moments(count, first, second, shrink)


def score(feats: DataFrame, model: QuadraticDiscriminant | None, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; without a model every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            p = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return feats.select("doc_id", "held_out", "x").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(model: QuadraticDiscriminant | None, text: str = "text", threshold: float = 0.5) -> Column:
    """Whether the model accepts a text: the same decision as :func:`score`, as a column."""

    @F.arrow_udf("boolean")
    def decide(column: pa.Array) -> pa.Array:
        out = [np.zeros(0, bool)]
        for _, _, data, offsets in tk.chunks(column):
            out.append(model.score(statistics(data, offsets)) >= threshold if model else np.ones(len(offsets) - 1, bool))
        return pa.array(np.concatenate(out))

    return decide(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, shrink: float = 0.05) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    One pass over the texts: the statistics are written to the scratch folder, the model
    comes from their labelled part, and the scores from the written statistics.

    Null and empty texts have the statistics of an empty text and are scored like any other;
    equal texts get equal scores; a null doc_id is scored and never learned from; repeated
    rows each get a row; other columns are ignored; an empty table gives an empty result.
    """
    feats = stash(features(docs))
    return score(feats, fit(feats, labels, "quality", shrink), threshold)
