"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of statistics (lengths, vocabulary, repeats, symbols, case, lines), on logarithmic or ratio
scales. Each class has a mean and a covariance, shrunk towards the diagonal of the pooled covariance and a multiple of
the identity. The Cholesky factors are made once on the driver (a few hundred numbers) and sent to the executors; the
score is the logistic of the Mahalanobis log-density difference and the prior's log-odds.

Statistics are computed once per row and settled; the fit sums moments over all labelled rows, and the scores come from
the same settled table. Moments count vectors of one label that are equal to `digits` decimals once (the parameter's
default is DIGITS; None counts every row), so that a group of copies doesn't set a class's shape: each such vector is
there by its mean. The prior counts every labelled row.

Defined results: null or empty text: the vector of no words; null labels: not used; several labels of one doc_id: the
least; a class without rows, or no labels at all: every score is 0.5; repeated rows: scored each; empty table: no rows;
other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_words, mix, owners, settle, small_batches, split_words, text_chunks

NAMES = ["length", "word_length", "variety", "symbols", "upper", "shouts", "digits", "line_length", "stops", "echoes", "bars", "repeats"]
#: Shares of the pooled diagonal and of the identity in each class's covariance; decimals to which copies' vectors agree;
#: the log-odds beyond which the logistic function overflows.
SHRINK, RIDGE, DIGITS, LIMIT = 0.1, 1e-3, 3, 700.0


def _byte_counts(texts: pa.Array, classes: list[bytes]) -> np.ndarray:
    """For each class of ASCII characters its count in each text."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(x.as_buffer() for x in texts), np.uint8) if len(texts) else np.empty(0, np.uint8)
    out = np.zeros((len(classes), len(sizes)))
    some = sizes > 0
    if some.any():
        for k, c in enumerate(classes):
            member = np.zeros(256, np.uint8)
            member[list(c)] = 1
            out[k, some] = np.add.reduceat(member[data], (ends - sizes)[some], dtype=np.int64)
    return out


def _distinct(own: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Number of different codes of each text."""
    if not len(codes):
        return np.zeros(n)
    width = int(codes.max()) + 1
    return np.bincount(np.unique(own * width + codes) // width, minlength=n).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    flat, offsets = split_words(texts)
    n, w = len(offsets) - 1, np.diff(offsets).astype(float)
    own = owners(offsets)
    _, codes = distinct_words(flat)
    chars = np.bincount(own, pc.utf8_length(flat).to_numpy(zero_copy_only=False), n) if len(flat) else np.zeros(n)
    same = np.zeros(n)
    fresh = np.zeros(n)
    if len(flat) > 1:
        same = np.bincount(own[1:], (codes[1:] == codes[:-1]) & (own[1:] == own[:-1]), n)
    if len(flat) > 2:
        whole = own[2:] == own[:-2]
        c = codes.astype(np.uint64)
        g = mix(mix(mix(c[:-2] + np.uint64(1)) + c[1:-1]) + c[2:])[whole]
        _, g = np.unique(g, return_inverse=True)
        fresh = _distinct(own[2:][whole], g, n)
    windows = np.maximum(w - 2, 0)
    upper, lower, symbols, shouts, digits, stops, bars, lines = _byte_counts(
        texts, [bytes(range(65, 91)), bytes(range(97, 123)), b"#*$%&|<>", b"!", b"0123456789", b".", b"|", b"\n"]
    )
    rate = lambda x, y: np.log((x + 0.5) / (y + 10.0))
    return np.stack(
        [
            np.log1p(w), np.log1p(chars / np.maximum(w, 1)), _distinct(own, codes, n) / np.maximum(w, 1) + 0.1 * np.log1p(w), rate(symbols, w), upper / (upper + lower + 10.0),
            rate(shouts, w), rate(digits, chars), np.log1p(w / (lines + 1)), rate(stops, w), rate(same, w), rate(bars, w), rate(windows - fresh, w),
        ],
        axis=1,
    )


def _features(batches):
    for batch in batches:
        for part in text_chunks(batch, "text"):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x[:, i]) for i in range(len(NAMES)))], ["doc_id", *NAMES])


def document_statistics(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return settle(docs.select("doc_id", "text").mapInArrow(_features, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES)), "quality-statistics")


@dataclass(frozen=True)
class Model:
    means: np.ndarray
    whiten: np.ndarray  # inverse Cholesky factors, one for each class
    log_dets: np.ndarray
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        dens = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - 0.5 * d for m, w, d in zip(self.means, self.whiten, self.log_dets, strict=True)]
        return np.clip(dens[1] - dens[0] + self.prior, -LIMIT, LIMIT)


def fit(stats: DataFrame, labels: DataFrame, use: Column, label: str = "quality", shrink: float = SHRINK, digits: int | None = DIGITS) -> Model | None:
    known = labels.filter(use & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    rows = stats.join(known, "doc_id").select("y", *NAMES, F.lit(1).alias("seen"))
    if digits is not None:
        rows = rows.groupBy("y", *[F.round(c, digits).alias(f"_{c}") for c in NAMES]).agg(*[F.avg(c).alias(c) for c in NAMES], F.sum("seen").alias("seen"))
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("y").agg(F.count("*").alias("n"), F.sum("seen").alias("seen"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(NAMES)], *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    got = {r["y"]: r for r in sums}
    if set(got) != {0, 1}:
        return None
    n, seen, means, covs = np.zeros(2), np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for y, r in got.items():
        n[y], seen[y] = r["n"], r["seen"]
        means[y] = [r[f"s{i}"] / n[y] for i in range(d)]
        for i, j in pairs:
            covs[y, i, j] = covs[y, j, i] = r[f"p{i}_{j}"] / n[y] - means[y, i] * means[y, j]
    pooled = np.diag((n[0] * covs[0] + n[1] * covs[1]).diagonal() / n.sum())
    whiten, dets = [], []
    for y in (0, 1):
        a = shrink + (1 - shrink) * d / (d + n[y])  # few rows: more of the pooled diagonal
        low = np.linalg.cholesky((1 - a) * covs[y] + a * pooled + RIDGE * np.eye(d))
        whiten.append(np.linalg.inv(low)), dets.append(2 * np.log(low.diagonal()).sum())
    return Model(means, np.array(whiten), np.array(dets), float(np.log(seen[1] / seen[0])))


def quality(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", shrink: float = SHRINK, digits: int | None = DIGITS) -> DataFrame:
    """doc_id, score (0 to 1), log_odds of every row; learns from labels where use holds."""
    stats = document_statistics(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, use, label, shrink, digits))

    def run(batches):
        m = shared.value
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in NAMES], axis=1)
            odds = m.log_odds(x) if m and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-odds))), pa.array(odds)], ["doc_id", "score", "log_odds"])

    return stats.mapInArrow(run, "doc_id long, score double, log_odds double")
