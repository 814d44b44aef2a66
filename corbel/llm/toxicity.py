"""Toxicity by maximum-scoring segments.

Training. Words (lower case, outer punctuation off) and their beginnings of 4 and 6 letters are counted in toxic and in
other labelled texts, once in each text that has them. The log-odds of having a form have a Dirichlet prior: its two
parameters (has, lacks) are PRIOR times the background counts, those in all labelled texts, and SMOOTH each. Forms whose
difference of log-odds between both classes is Z standard errors or more weigh its lower bound less a margin; words
without a positive weight of their own fall back on their beginnings', and all others cost a small constant, so that a
random text's expected score is negative.

Scan. All maximal-scoring segments of a text are found in linear time (Ruzzo and Tompa 1999): tokens between two
positive ones only add their number times the constant, so the scan visits positive tokens alone.

Calibration. The best segment scores of clean texts, from labelled rows that the weights did not see (a third is
left out for this, then the weights are taken again from all), give a Gumbel distribution whose place moves with the
logarithm of the text's length. A segment's significance is its tail probability there; the evidence of a text is the sum of -ln p over its significant segments, and a logistic curve fitted to
the same rows turns it into the score. Evidence has no upper bound; where the score is 1 to the last bit, it still ranks texts.

The fit uses at most train_rows labelled rows (the first in a seeded order), near copies among them counted once, by
their least doc_id. Scoring covers every row and the whole of its text.

Defined results: null or empty text: no segments, the score of no evidence; repeated rows: scored each; null labels:
not used; several labels of one doc_id: toxic if any says so; no labels at all or one class only: no weights, every
score is that of no evidence; empty table: no rows; other columns are not carried (drop_toxic keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_words, hash_array, hash_words, mix, owners, settle, small_batches, split_words, text_chunks

TRAIN_ROWS = 40_000
PREFIXES = (4, 6)
#: A form counts from this many standard errors of its log-odds on, and scores what is above MARGIN one error lower;
#: prior parameter by background count, and of every form; cost of any other word; p below which a segment counts.
Z, MARGIN, PRIOR, SMOOTH, DRIFT, SIGNIFICANT = 2.4, 2.0, 0.01, 0.5, 0.05, 0.05
#: Most that a toxic row weighs in the logistic fit, where toxic rows are rarer than others.
RARE_WEIGHT = 3.0
OUTER = ".,;:!?\"'()[]{}*#$%&|<>~-_=+/\\"


@dataclass(frozen=True)
class Model:
    word_keys: np.ndarray
    word_weights: np.ndarray
    prefix_keys: np.ndarray
    prefix_weights: np.ndarray
    place: float = 0.0
    spread: float = 1.0
    log_length: float = 6.0
    bias: float = -2.0
    slope: float = 1.0


def _clean(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=OUTER)


def _keys(flat: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each word the number of its form, and the forms' hashes: the whole and each beginning (0: no such)."""
    words, at = distinct_words(flat)
    forms = _clean(words)
    sizes = pc.utf8_length(forms).to_numpy(zero_copy_only=False)
    out = [np.where(sizes > 0, hash_array(forms, 1), np.uint64(0))]
    for n in PREFIXES:
        out.append(np.where(sizes >= n, hash_array(pc.utf8_slice_codeunits(forms, 0, n), n), np.uint64(0)))
    return at, out


def _look_up(keys: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[i] == wanted) & (wanted != 0), weights[i], 0.0)


def token_weights(flat: pa.Array, model: Model) -> np.ndarray:
    if not len(flat):
        return np.empty(0)
    at, (whole, *starts) = _keys(flat)
    own = _look_up(model.word_keys, model.word_weights, whole)
    begin = np.max([_look_up(model.prefix_keys, model.prefix_weights, x) for x in starts], axis=0)
    w = np.where(own > 0, own, begin)
    return np.where(w > 0, w, -DRIFT)[at]


def maximal_segments(at: list[int], weights: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last token, score) of a sequence whose tokens score weights at the
    positions at, and -drift anywhere else."""
    total, last = 0.0, -1
    found: list[list[float]] = []  # left sum, right sum, first, last
    for p, w in zip(at, weights, strict=True):
        total -= drift * (p - last - 1)
        left, last = total, p
        total += w
        seg = [left, total, p, p]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= seg[0]:
                j -= 1
            if j < 0 or found[j][1] >= seg[1]:
                break
            seg = [found[j][0], seg[1], found[j][2], seg[3]]
            del found[j:]
        found.append(seg)
    return [(int(a), int(b), r - q) for q, r, a, b in found]


def _segments(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Number of words and maximal segments of each text."""
    flat, offsets = split_words(texts)
    w = token_weights(flat, model)
    hits = np.flatnonzero(w > 0)
    bounds = np.searchsorted(hits, offsets)
    out = []
    for i in range(len(offsets) - 1):
        h = hits[bounds[i] : bounds[i + 1]]
        out.append(maximal_segments((h - offsets[i]).tolist(), w[h].tolist()) if len(h) else [])
    return np.diff(offsets), out


def tail(scores: np.ndarray, n_words: float, model: Model) -> np.ndarray:
    """P that a clean text of so many words has a segment of such a score at least."""
    shift = model.place + model.spread * (np.log(max(n_words, 1.0)) - model.log_length)
    with np.errstate(over="ignore"):
        return -np.expm1(-np.exp(np.clip(-(scores - shift) / model.spread, -700, 50)))


def evidence(n_words: int, segments: list[tuple[int, int, float]], model: Model) -> tuple[float, list[tuple[int, int, float, float]]]:
    if not segments:
        return 0.0, []
    p = tail(np.array([s for _, _, s in segments]), n_words, model)
    kept = [(a, b, s, float(q)) for (a, b, s), q in zip(segments, p, strict=True) if q < SIGNIFICANT]
    return float(sum(-np.log(max(q, 1e-300)) for *_, q in kept)), kept


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Bias and slope by Newton's method with halved steps; a ridge holds them near (-2, 1) where the classes part."""
    start, now = np.array([-2.0, 1.0]), np.array([-2.0, 1.0])
    design = np.stack([np.ones(len(x)), x], axis=1)
    weight = np.where(y == 1, np.clip((1 - y.mean()) / max(y.mean(), 1e-9), 1, RARE_WEIGHT), 1.0)
    loss = lambda t: float(np.sum(weight * (np.logaddexp(0, design @ t) - y * (design @ t))) + ridge * np.sum((t - start) ** 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ now, -30, 30)))
        slope = design.T @ (weight * (p - y)) + 2 * ridge * (now - start)
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 2 * ridge * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(now - size * step) > loss(now):
            size /= 2
        now = now - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(now[0]), float(max(now[1], 0.05))


def _counts(batches):
    """Counts of forms, once a text: (kind 0 word or 1 beginning, key, toxic and other ones; then those not left out)."""
    for batch in batches:
        for part in text_chunks(batch, "text"):
            flat, offsets = split_words(part.column("text"))
            if not len(flat):
                continue
            at, hashes = _keys(flat)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            seen = 1 - part.column("check").to_numpy(zero_copy_only=False).astype(np.int64)
            own, cols = owners(offsets), []
            for kind, h in enumerate(hashes):
                k, code = np.unique(h, return_inverse=True)
                pairs, use = np.unique(own * len(k) + code[at]), k != 0
                d = pairs // len(k)
                sums = [np.bincount(pairs % len(k), x[d], len(k)).astype(np.int64)[use] for x in (toxic, 1 - toxic, toxic * seen, (1 - toxic) * seen)]
                cols.append([np.full(use.sum(), min(kind, 1), np.int32), k[use].view(np.int64), *sums])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*cols, strict=True)], ["kind", "key", "n1", "n0", "s1", "s0"])


def _sketch(batches):
    """Three minima over hashes of 5-word windows: near copies mostly share them."""
    for batch in batches:
        for part in text_chunks(batch, "text"):
            flat, offsets = split_words(part.column("text"))
            h = hash_words(flat)
            n = len(offsets) - 1
            mins = np.zeros((3, n), np.uint64)
            for k in range(5):
                g = h if not k else mix(g + np.roll(h, -k))
            for i in range(n):
                a, b = int(offsets[i]), int(offsets[i + 1])
                if b > a:
                    w = g[a : max(a + 1, b - 4)]
                    mins[:, i] = w.min(), mix(w + np.uint64(77)).min(), mix(w + np.uint64(770)).min()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *(pa.array(m.view(np.int64)) for m in mins)], ["doc_id", "toxic", "k1", "k2", "k3"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most rows labelled rows, the first in the order of a hash; rows bounds what is broadcast."""
    some = labels.filter(use & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias(label))
    some = some.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def log_odds(one: Column, zero: Column, total_one: float, total_zero: float) -> tuple[Column, Column]:
    """Difference of a form's log-odds in both classes under the Dirichlet prior, and its standard error."""
    has = PRIOR * (one + zero) + SMOOTH
    lacks = PRIOR * (F.lit(total_one + total_zero) - one - zero) + SMOOTH
    odds = lambda c, total: F.log((c + has) / (F.lit(total) - c + lacks))
    return odds(one, total_one) - odds(zero, total_zero), F.sqrt(1 / (one + has) + 1 / (zero + has))


def fit(docs: DataFrame, labels: DataFrame, use: Column, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from labels (doc_id, toxic) where use holds."""
    sample = settle(labelled_sample(docs, labels, "toxic", use, train_rows), "tox-sample")
    ids = sample.mapInArrow(_sketch, "doc_id long, toxic int, k1 long, k2 long, k3 long")
    for k in ("k1", "k2", "k3"):
        ids = ids.groupBy(k, "toxic").agg(F.min(F.struct("doc_id", *(x for x in ("k1", "k2", "k3") if x > k))).alias("r")).select("toxic", "r.*")
    ids = ids.select("doc_id", (F.pmod(F.crc32(F.concat(F.lit("check"), F.col("doc_id").cast("string"))), F.lit(3)) == 0).alias("check")).distinct()
    sample = settle(sample.join(F.broadcast(settle(ids, "tox-ids")), "doc_id"), "tox-rows")  # train_rows at most
    schema = "kind int, key long, " + ", ".join(f"{c} long" for c in ("n1", "n0", "s1", "s0"))
    names = ("n1", "n0", "s1", "s0")
    counts = settle(sample.mapInArrow(_counts, schema).groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in names]), "tox-counts")
    toxic, seen = F.col("toxic"), F.when(F.col("check"), 0).otherwise(1)
    texts = (toxic, 1 - toxic, toxic * seen, (1 - toxic) * seen)
    size = sample.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(c) for c, x in zip(names, texts, strict=True)]).first()
    none = np.empty(0)
    empty = Model(none.astype(np.uint64), none, none.astype(np.uint64), none)
    if not all(size):
        return empty

    def weight(one: str, zero: str) -> Column:
        delta, error = log_odds(F.col(one), F.col(zero), size[one], size[zero])
        found = (F.col(one) > 0) & (delta >= Z * error)
        return F.when(found, F.greatest(delta - error - MARGIN, F.lit(0.0))).otherwise(0.0)

    # Only forms with a positive weight leave the executors; the sample's size bounds them.
    got = counts.withColumn("w", weight("n1", "n0")).withColumn("v", weight("s1", "s0")).filter("w > 0 OR v > 0").select("kind", "key", "w", "v").toPandas()

    def tables(column: str) -> list[np.ndarray]:
        out = []
        for kind in (0, 1):
            g = got[(got.kind == kind) & (got[column] > 0)]
            k = g.key.to_numpy(np.int64).view(np.uint64)
            o = np.argsort(k)
            out += [k[o], g[column].to_numpy(float)[o]]
        return out

    m = _calibrate(sample.filter("check"), Model(*tables("v")))
    return Model(*tables("w"), m.place, m.spread, m.log_length, m.bias, m.slope)


def _calibrate(sample: DataFrame, model: Model) -> Model:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def best(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                n, segs = _segments(part.column("text"), shared.value)
                flat = [[s for _, _, s in x] for x in segs]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(n.astype(np.int64)), pa.array(flat, pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    rows = sample.mapInArrow(best, "toxic int, n long, scores array<double>").collect()  # train_rows / 3, about
    clean = [(max(r["scores"], default=0.0), r["n"]) for r in rows if not r["toxic"]]
    if not clean:
        return model
    top, length = np.array([s for s, _ in clean]), np.log(np.maximum([n for _, n in clean], 1))
    spread = max(float(top.std() * np.sqrt(6) / np.pi), 0.25)
    parts = model.word_keys, model.word_weights, model.prefix_keys, model.prefix_weights
    model = Model(*parts, float(top.mean() - 0.5772 * spread), spread, float(length.mean()))
    y = np.array([r["toxic"] for r in rows], float)
    if not y.any():
        return model
    x = np.array([evidence(r["n"], [(0, 0, s) for s in r["scores"]], model)[0] for r in rows])
    return Model(*parts, model.place, model.spread, model.log_length, *_logistic(x, y))


SCHEMA = "doc_id long, score double, evidence double, n_words long, passages array<struct<first:int,last:int,score:double,p:double>>"


def judge(found: list[float], model: Model) -> np.ndarray:
    """Scores (0 to 1) of texts by their evidence."""
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(model.bias + model.slope * np.array(found, float))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), evidence, n_words, passages (significant segments, as word numbers) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in text_chunks(batch, "text"):
                n, segs = _segments(part.column("text"), m)
                got = [evidence(int(k), s, m) for k, s in zip(n, segs, strict=True)]
                said = pa.array([[{"first": a, "last": b, "score": s, "p": p} for a, b, s, p in k] for _, k in got], passage)
                found = [e for e, _ in got]
                cols = [part.column("doc_id"), pa.array(judge(found, m)), pa.array(found, pa.float64()), pa.array(n.astype(np.int64)), said]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "evidence", "n_words", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, use: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    small_batches(docs.sparkSession)
    return score(docs, fit(docs, labels, use, train_rows))


def drop_toxic(docs: DataFrame, labels: DataFrame, use: Column, threshold: float = 0.7, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs, all columns, without the rows whose text scores threshold or more. Rows are judged where they stand, without a join."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, use, train_rows))

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in text_chunks(batch, "text"):
                n, segs = _segments(part.column("text"), m)
                yield part.filter(pa.array(judge([evidence(int(k), s, m)[0] for k, s in zip(n, segs, strict=True)], m) < threshold))

    return docs.mapInArrow(run, docs.schema)
