"""Benchmark decontamination by latent semantic retrieval.

Passages. Benchmark items are cut into passages of PASSAGE words at most; documents into windows of WINDOW words, one
every STRIDE. Words are lower case without outer punctuation.

Latent space. Inverse document frequencies of the benchmark's words are counted over all documents, in one pass for the
whole benchmark. The benchmark's TF-IDF passages A (as many rows as passages, as many columns as words) get a randomised
singular value decomposition, distributed over their rows: one pass sums A'(A O) for a random O (a range finder with a
power step), a second sums the Gram matrix of A Q; the eigenvectors of that small matrix give the right singular vectors.
The space is that of the passages asked for, so rare words that mark them keep their directions.

Search. Every window of every document is projected; nothing is left out beforehand. Passages whose latent cosine is
COSINE or more are candidates. Each candidate is confirmed on words: the longest common subsequence of the passage and the
text around the window. It is a leak if that covers STRONG of the passage, or WEAK of it and the answer (its own column,
or else the passage's last ANSWER words) is found there too. Projection and cosine are one product with the folded matrix
(singular vectors times passages): the words that are frequent in a batch by a dense product, all others by sums.

Sizes. The benchmark is taken in blocks of at most RANK passages (a long item goes on in the next block), so that each
space holds its passages whole. The folded matrices of as many blocks as fit into FOLDED bytes are broadcast together and
searched in one scan of the documents; a block's matrix has at most RANK * PASSAGE * 5 / 4 words by RANK passages, 15 MB.
The vocabulary of the whole benchmark (8 bytes a word, KEYS words at once) is broadcast for the frequencies.

Defined results: null or empty texts of documents or items: no leak; items without words: never found; short items
(fewer than 8 words): all words must be found, in a stretch twice as long at most; several windows of a document with
one item: one row, its best; repeated rows: by doc_id; empty tables: no rows; other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom, distinct_words, hash_array, hash_strings, owners, settle, small_batches, split_likely, split_words, text_chunks

PASSAGE, WINDOW, STRIDE, ANSWER = 48, 64, 32, 5
COSINE, STRONG, WEAK = 0.25, 0.6, 0.45
#: Items of a block, dimensions of the latent space (and so passages of a block) and of the random range beyond them.
ITEMS, RANK, MORE = 1024, 256, 16
#: Bytes of folded matrices that are broadcast at once, and words whose frequencies are counted at once.
FOLDED, KEYS = 128 << 20, 4 << 20
#: Windows that are compared with all passages at once, and words of them that go through the dense product.
SEARCHED, DENSE = 2048, 384
OUTER = ".,;:!?\"'()[]{}*#$%&|<>~-_=+/\\"
SPLIT_ROWS = 256


def _forms(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words in lower case without outer punctuation, and for each word its number among them."""
    words, at = distinct_words(flat)
    return pc.utf8_trim(pc.utf8_lower(words), characters=OUTER), at


def words_of(text: str | None) -> list[str]:
    flat, _ = split_words(pa.array([text or ""]))
    forms, at = _forms(flat)
    return [f for f in forms.take(pa.array(at)).to_pylist() if f]


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a machine word of a per step."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = v & at.get(w, 0)
        if m:
            v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


@dataclass(frozen=True)
class Space:
    keys: np.ndarray  # sorted hashes of the vocabulary
    idf: np.ndarray  # in the order of keys
    folded: np.ndarray  # words x passages: latent products, by passages' latent norms
    items: np.ndarray  # passage -> item_id
    passages: list[list[str]]
    answers: list[list[str]]


def _numbers(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each hash its number in keys, or -1."""
    if not len(keys):
        return np.full(len(hashes), -1)
    i = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where((keys[i] == hashes) & (hashes != 0), i, -1)


def _vocabulary(flat: pa.Array, keys: np.ndarray) -> np.ndarray:
    """For each word its number in keys, or -1."""
    forms, at = _forms(flat)
    return _numbers(hash_array(forms), keys)[at]


def document_frequency(docs: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each vocabulary word occurs, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                flat, offsets = split_words(part.column("text"))
                ids = _vocabulary(flat, shared.value)
                own = owners(offsets)[ids >= 0] if len(ids) else np.empty(0, np.int64)
                n = len(shared.value)
                pairs = np.unique(own * n + ids[ids >= 0]) if len(own) else own
                counts = np.bincount(pairs % n, minlength=n) if len(pairs) else np.zeros(n, np.int64)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], part.num_rows))], ["w", "c"])

    got = docs.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).collect()  # a row for each vocabulary word
    out, total = np.zeros(len(keys), np.int64), 0
    for w, c in got:
        if w < 0:
            total = c
        else:
            out[w] = c
    return out, total


def singular_vectors(rows: DataFrame, n_words: int, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """Right singular vectors (n_words x rank at most) of the sparse rows (ids array<int>, weights array<double>)."""
    r = min(rank + MORE, n_words)

    def sketch(batches):
        omega = np.random.default_rng(seed).standard_normal((n_words, r))
        total = np.zeros((n_words, r))
        for b in batches:
            for ids, w in zip(b.column("ids").to_pylist(), b.column("weights").to_pylist(), strict=True):
                total[ids] += np.outer(w, np.asarray(w) @ omega[ids])
        some = [s for s in range(0, n_words, SPLIT_ROWS) if total[s : s + SPLIT_ROWS].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([total[s : s + SPLIT_ROWS].tobytes() for s in some], pa.binary())], ["at", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "part": [sum(np.frombuffer(x) for x in pdf["part"]).tobytes()]})

    got = rows.mapInArrow(sketch, "at long, part binary").groupBy("at").applyInPandas(add, "at long, part binary").collect()
    y = np.zeros((n_words, r))
    for at, part in got:
        block = np.frombuffer(bytes(part)).reshape(-1, r)
        y[at : at + len(block)] = block
    q, _ = np.linalg.qr(y)
    shared = rows.sparkSession.sparkContext.broadcast(q)

    def gram(batches):
        total = np.zeros((q.shape[1], q.shape[1]))
        for b in batches:
            for ids, w in zip(b.column("ids").to_pylist(), b.column("weights").to_pylist(), strict=True):
                x = np.asarray(w) @ shared.value[ids]
                total += np.outer(x, x)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], ["at", "part"])

    parts = rows.mapInArrow(gram, "at long, part binary").groupBy("at").applyInPandas(add, "at long, part binary").collect()
    values, vectors = np.linalg.eigh(np.frombuffer(bytes(parts[0][1])).reshape(q.shape[1], -1))
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-300)]
    return q @ vectors[:, keep]


def _tf_idf(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ids):
        return ids, np.empty(0)
    k = np.sort(ids)
    first = np.ones(len(k) + 1, bool)
    np.not_equal(k[1:], k[:-1], out=first[1:-1])
    at = np.flatnonzero(first)
    k = k[at[:-1]]
    return k, (1 + np.log(at[1:] - at[:-1])) * idf[k]


def blocks(asked, items: int, most: int):
    """Lists of passages (item_id, words, answer's words) of rows (item_id, text, answer or None): of up to items items
    and most passages."""
    block, n = [], 0
    for item, text, answer in asked:
        if n == items:
            yield block
            block, n = [], 0
        n += 1
        words = words_of(text)
        for s in range(0, max(1, len(words) - PASSAGE // 4), PASSAGE):
            piece = words[s : s + PASSAGE] if len(words) - s > PASSAGE * 5 // 4 else words[s:]
            if not piece:
                continue
            if len(block) == most:
                yield block
                block, n = [], 1
            block.append((item, piece, words_of(answer) if answer else piece[-ANSWER:]))
    yield block


def vocabulary(block: list) -> np.ndarray:
    return np.unique(hash_strings(sorted({w for _, p, _ in block for w in p})))


def latent_space(spark: SparkSession, block: list, keys: np.ndarray, idf: np.ndarray, rank: int = RANK) -> Space:
    """block: passages (item_id, words, answer's words), rank of them at most, or the space doesn't hold them all; idf
    of its vocabulary keys."""
    items, passages, answers = (list(x) for x in zip(*block, strict=True))
    rows = [_tf_idf(np.searchsorted(keys, hash_strings(p)), idf) for p in passages]
    table = spark.createDataFrame([(k.tolist(), w.tolist()) for k, w in rows], "ids array<int>, weights array<double>")
    basis = singular_vectors(table, len(keys), rank)
    vectors = np.stack([w @ basis[k] for k, w in rows])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
    return Space(keys, idf, (basis @ vectors.T).astype(np.float32), np.array(items), passages, answers)


def frequencies(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Inverse document frequencies of the words with the sorted hashes keys, KEYS of them a pass."""
    out = [np.empty(0)]
    for s in range(0, len(keys), KEYS):
        df, total = document_frequency(docs, keys[s : s + KEYS])
        out.append(np.log((total + 1) / (df + 1)) + 0.01)
    return np.concatenate(out)


def cosines(ids: np.ndarray, start: np.ndarray, end: np.ndarray, s: Space) -> np.ndarray:
    """Latent cosines of the windows [start, end) of words' numbers (-1: not in the vocabulary) with all passages."""
    size = end - start
    own = np.repeat(np.arange(len(start)), size)
    words = ids[np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]
    own, words = own[words >= 0], words[words >= 0]
    pair, tf = np.unique(own * len(s.keys) + words, return_counts=True)
    own, words = pair // len(s.keys), pair % len(s.keys)
    w = ((1 + np.log(tf)) * s.idf[words]).astype(np.float32)
    norm = np.sqrt(np.bincount(own, w.astype(float) ** 2, len(start)))
    used = np.bincount(words, minlength=len(s.keys))
    top = np.argsort(-used, kind="stable")[:DENSE]
    place = np.full(len(s.keys), -1)
    place[top] = np.arange(len(top))
    often = place[words] >= 0
    x = np.zeros((len(start), len(top)), np.float32)
    x[own[often], place[words[often]]] = w[often]
    out = x @ s.folded[top]
    own, words, w = own[~often], words[~often], w[~often]
    if len(own):
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[first]] += np.add.reduceat(s.folded[words] * w[:, None], first, axis=0)
    return out / np.maximum(norm, 1e-12)[:, None]


def _confirm(words: list[str], start: int, passage: list[str], answer: list[str]) -> tuple[int, bool]:
    """Longest common subsequence with the text around a window, and whether the answer is there."""
    n = len(passage)
    around = words[max(0, start - n // 2) : start + WINDOW + n // 2]
    if n < 8:
        reach = 2 * n
        best = max((common_length(passage, around[i : i + reach]) for i in range(0, max(1, len(around) - n + 1))), default=0)
    else:
        reach = n + n // 2 + 8  # a passage's words stand close together
        best = max((common_length(passage, around[i : i + reach]) for i in range(0, max(1, len(around) - reach + 8), 8)), default=0)
    return best, bool(answer) and 2 * common_length(answer, around) >= len(answer)


def is_leak(common: int, n: int, answered: bool) -> bool:
    if n < 8:
        return common == n
    return common >= STRONG * n or common >= WEAK * n and answered


def _search(shared):
    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                flat, offsets = split_words(part.column("text"))
                forms, at = _forms(flat)
                hashes = hash_array(forms)
                n = np.diff(offsets)
                count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
                own = np.repeat(np.arange(len(n)), count)
                first = np.concatenate([[0], np.cumsum(count)])[:-1]
                start = offsets[own] + (np.arange(len(own)) - first[own]) * STRIDE
                end = np.minimum(start + WINDOW, offsets[own + 1]) if len(own) else start
                doc, found = part.column("doc_id").to_numpy(zero_copy_only=False), []
                cached: tuple[int, list[str]] = (-1, [])
                for s in shared.value:
                    ids = _numbers(hashes, s.keys)[at]
                    for some in range(0, len(start), SEARCHED):
                        cos = cosines(ids, start[some : some + SEARCHED], end[some : some + SEARCHED], s)
                        for x, p in zip(*np.nonzero(cos >= COSINE), strict=True):
                            a, i = int(start[some + x]), int(own[some + x])
                            if cached[0] != i:
                                cached = (i, forms.take(pa.array(at[offsets[i] : offsets[i + 1]])).to_pylist())
                            common, answered = _confirm(cached[1], a - int(offsets[i]), s.passages[p], s.answers[p])
                            if is_leak(common, len(s.passages[p]), answered):
                                found.append((int(doc[i]), int(s.items[p]), common, len(s.passages[p]), answered, float(cos[x, p])))
                cols = list(zip(*found, strict=True)) if found else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "common", "passage", "answered", "cosine"])

    return run


def scans(spark: SparkSession, every: list, keys: np.ndarray, idf: np.ndarray, rank: int):
    """Lists of spaces whose folded matrices fit into FOLDED bytes together (or one space alone)."""
    held, size = [], 0
    for block in every:
        own = vocabulary(block)
        space = latent_space(spark, block, own, idf[np.searchsorted(keys, own)], rank)
        if held and size + space.folded.nbytes > FOLDED:
            yield held
            held, size = [], 0
        held.append(space)
        size += space.folded.nbytes
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, answer: str | None = None, items: int = ITEMS, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, common, passage, answered, cosine): one row for each document and item that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    asked = benchmark.select(F.col("item_id").cast("long"), "text", (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer")).filter("item_id IS NOT NULL").orderBy("item_id", "text", "answer")
    schema = "doc_id long, item_id long, common long, passage long, answered boolean, cosine double"
    out = spark.createDataFrame([], schema)
    every = [b for b in blocks(asked.toLocalIterator(), items, rank) if b]
    keys = np.unique(np.concatenate([np.empty(0, np.uint64), *map(vocabulary, every)]))
    idf = frequencies(docs, keys)
    for spaces in scans(spark, every, keys, idf, rank):
        out = out.unionByName(docs.mapInArrow(_search(spark.sparkContext.broadcast(spaces)), schema))
    best = F.max_by(F.struct("common", "passage", "answered", "cosine"), F.struct(F.col("common") / F.col("passage"), "common", "answered", "cosine")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """docs without those that hold a benchmark item. Only rows that a filter takes for such ones are shuffled."""
    found = settle(leaks(docs, benchmark, answer).select("doc_id").distinct(), "leaks")
    some, rest = split_likely(docs, "doc_id", bloom(found, "doc_id"))
    return some.join(found, "doc_id", "left_anti").select(*docs.columns).unionByName(rest)
