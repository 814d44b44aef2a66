"""Line dedup by overlapping three-line windows.

Lines. A text's lines end at newlines; lines without a word are none. As passages are also repeated inside longer lines,
lines of more than PLAIN words are wrapped at points that the content alone decides: after a word whose hash, with its
predecessor's, is the least among its neighbours within RADIUS words of the same line. A line gets the same pieces
wherever it stands, so three equal consecutive lines are always equal windows, whatever stands around them; pieces add
to that the passages inside longer lines, but for up to a line or piece at each end.

Windows. Every three consecutive lines (or pieces) of a text make a window; its hash is that of all their words. Windows
are found in all texts; the first occurrence in the order (doc_id, position) stays, later ones are marked, in the same
text too. The lines that marked windows cover are merged to runs and removed, from a run's first word up to the next kept
one; what stands between runs is kept as it was.

Counting is one aggregation by hash (least doc_id and count, pre-aggregated on the map side); later occurrences come
from an equi-join with the repeated hashes, which adaptive execution can split when one window is very common. A Bloom
filter of fixed size goes before that join; where it is full it saves nothing, and the join shuffles 28 bytes a window.
Only texts that a second filter takes for marked ones are shuffled; all others are passed on where they are.

Defined results: null text: stays null; empty texts, and texts of fewer than three lines: unchanged; repeated rows with
one doc_id: each counts as the first holder of its windows, so they don't cut each other; null doc_id: unchanged; a text
all of whose lines are removed: what stands before its first word; empty table: no rows; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, hash_words, likely, mix, settle, small_batches, split_likely, split_words, text_chunks

#: Lines of a window; words to each side of a wrap point; words of the longest line that is never wrapped.
LINES, RADIUS, PLAIN = 3, 3, 24
#: A column name that documents don't have.
MARKED = "__line_dedup_marked"


def _newline_before(texts: pa.Array, flat: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """For each word whether a newline stands between it and the word before it in its text."""
    _, at = split_words(pc.split_pattern(pc.fill_null(texts, ""), "\n").flatten())
    out = np.zeros(len(flat) + 1, bool)
    out[at[:-1]] = True
    out[offsets[:-1]] = False
    return out[:-1]


def line_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, where each text's words begin, and for each word whether a line or piece starts there."""
    flat, offsets = split_words(texts)
    h = hash_words(flat)
    hard = _newline_before(texts, flat, offsets)
    first = np.zeros(len(h) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    pair = mix(h + mix(np.roll(h, 1)) * np.uint64(3))
    pair[first | hard] = np.uint64(2**64 - 1)  # a line that starts anyway isn't wrapped by what stands before it
    least, own = np.ones(len(h), bool), np.cumsum(first | hard)
    for k in range(1, RADIUS + 1):
        if len(h) > k:
            other = own[k:] != own[:-k]  # what stands beyond a newline or in another text doesn't count
            least[k:] &= other | (pair[k:] < pair[:-k])
            least[:-k] &= other | (pair[:-k] <= pair[k:])
    long = np.bincount(own)[own] > PLAIN if len(own) else first
    return h, offsets, first | hard | (least & long)


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first line (its number in the text) of every window."""
    h, offsets, start = line_starts(texts)
    none = np.empty(0, np.int64)
    if not len(h):
        return none.view(np.uint64), none, none
    at = np.flatnonzero(start)
    own = np.searchsorted(offsets, at, side="right") - 1
    place = np.arange(len(h)) - np.repeat(at, np.diff(np.concatenate([at, [len(h)]])))
    line = mix(np.add.reduceat(mix(h + mix(place.astype(np.uint64) + np.uint64(1))), at))
    n = len(at) - LINES + 1
    if n <= 0:
        return none.view(np.uint64), none, none
    w = line[:n].copy()
    for k in range(1, LINES):
        w = mix(w * np.uint64(31) + line[k : k + n])
    whole = own[:n] == own[LINES - 1 :]
    number = np.arange(len(at)) - np.searchsorted(own, own)
    return w[whole], own[:n][whole], number[:n][whole]


def _repeats(w: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each window whether the same text has it further up."""
    order = np.lexsort((w, own))
    same = np.zeros(len(w), bool)
    same[1:] = (w[order][1:] == w[order][:-1]) & (own[order][1:] == own[order][:-1])
    out = np.empty(len(w), bool)
    out[order] = same
    return out


def _hashes(batches):
    for batch in batches:
        for part in text_chunks(batch, "text"):
            w, own, _ = windows(part.column("text"))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(ids[own], pa.int64())], ["h", "doc_id"])


def _places(shared):
    def run(batches):
        """Places of the windows that the filter of repeated hashes passes; nothing else leaves the worker."""
        for batch in batches:
            for part in text_chunks(batch, "text"):
                w, own, number = windows(part.column("text"))
                keep = likely(w.view(np.int64), shared.value)
                w, own, number = w[keep], own[keep], number[keep]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                again = pa.array(_repeats(w, own))
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(ids[own], pa.int64()), pa.array(number.astype(np.int32)), again], ["h", "doc_id", "line", "again"])

    return run


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes start and end; the six space characters are bytes of their own there."""
    word = np.ones(len(data) + 2, bool)
    word[0] = word[-1] = False
    word[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def cut(text: str, starts: np.ndarray, marked: list[int]) -> str:
    """text without the lines that the windows starting at the marked lines cover; starts: each line's first word."""
    n = len(starts)
    gone = np.zeros(n + LINES, bool)
    for k in range(LINES):
        gone[np.asarray(marked, np.int64) + k] = True
    gone = gone[:n]
    if not gone.any():
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at, _ = word_spans(np.frombuffer(raw, np.uint8))
    edges = np.append(at[starts], len(raw))
    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, kept_to = [], 0
    for i, j in zip(turns[::2], turns[1::2], strict=True):
        out.append(raw[kept_to : edges[i]])
        kept_to = edges[j]
    out.append(raw[kept_to:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def _rebuild(batches):
    """Rows with marked lines get their text cut; all others pass through."""
    for batch in batches:
        for part in text_chunks(batch, "text"):
            rest = part.drop_columns([MARKED])
            todo = np.flatnonzero(pc.greater(pc.fill_null(pc.list_value_length(part.column(MARKED)), 0), 0).to_numpy(zero_copy_only=False))
            if len(todo):
                texts, some = part.column("text"), part.column("text").take(pa.array(todo))
                _, offsets, start = line_starts(some)
                out = texts.to_pylist()
                for i, (row, marked) in enumerate(zip(todo, part.column(MARKED).take(pa.array(todo)).to_pylist(), strict=True)):
                    a, b = offsets[i], offsets[i + 1]
                    out[row] = cut(out[row], np.flatnonzero(start[a:b]), marked)
                rest = rest.set_column(rest.schema.get_field_index("text"), "text", pa.array(out, texts.type))
            yield rest


def later_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, marked): numbers of the lines at which windows start that occur earlier."""
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    first = texts.mapInArrow(_hashes, "h long, doc_id long").groupBy("h").agg(F.count("*").alias("c"), F.min("doc_id").alias("d0")).filter("c > 1").select("h", "d0")
    first = settle(first, "line-first")
    shared = docs.sparkSession.sparkContext.broadcast(bloom(first, "h"))
    found = texts.mapInArrow(_places(shared), "h long, doc_id long, line int, again boolean")
    later = found.join(first, "h").filter("doc_id <> d0 OR again")
    return settle(later.groupBy("doc_id").agg(F.collect_set("line").alias("marked")), "line-marked")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with repeated passages taken out of text."""
    small_batches(docs.sparkSession)
    later = later_windows(docs).withColumnRenamed("marked", MARKED)
    some, rest = split_likely(docs, "doc_id", bloom(later, "doc_id"))
    joined = some.join(later, "doc_id", "left").select(*docs.columns, MARKED)
    return joined.mapInArrow(_rebuild, docs.schema).unionByName(rest)
