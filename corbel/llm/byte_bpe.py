"""Byte-level BPE by prefix dynamic programming.

Of a byte string's prefixes, each has one encoding, and that is the encoding of a shorter prefix and one more token. So a single
number for each prefix, its last token, holds the encodings of all of them. A token may follow another one exactly if merging
their joined bytes gives the two back; the last token of a prefix is the one of the tokens ending there that may follow the last
token of the prefix before it. The entry of a prefix hangs on the bytes and entries of one token's length before it alone:

* bytes can be appended without touching the entries that are there;
* after an edit, entries are remade from its start until as many in a row as the longest token has bytes are the old ones.

A text is first split by a pattern; each match is encoded by itself, as a whole if it is a token. Any blank after something that is
no space begins a match, whatever stands around it, so a changed text is split anew only between two such places.

Matches repeat, so each Python process keeps the tokens of those it has met, and the entries of their beginnings (within HELD bytes,
then it starts afresh); a text's tokens are one join over its matches. Tokens are kept as little-endian unsigned 32-bit integers in binary columns.

Defined results: null text or tokens count as empty; empty texts have no tokens; repeated rows are encoded each; empty tables give
no rows; texts and single matches may have any length (a byte costs as many lookups as the longest token has bytes, and four bytes of memory);
other columns stay, and an output column that the table has already is an error.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import text_chunks

#: Bytes of matches and tokens that a process keeps at most, the longest match that it keeps, and bytes of the beginnings that
#: matches share: their entries are kept too, and what follows is appended.
HELD, LONGEST, STEM = 128 << 20, 256, 5
#: Answers on pairs of tokens that a process keeps at most; then it starts afresh.
ANSWERS = 1 << 19
#: Entries of a vocabulary that is sent to every task at most.
MOST_TOKENS = 1 << 20


class Vocabulary:
    """Tokens by rank, with what has been learnt of which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.bytes = ranks, {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.may: dict[int, bool] = {}

    @cached_property
    def endings(self) -> dict[bytes, int]:
        """Every ending of a token: its rank, or -1 if it is none itself. A search backwards stops at the first string that isn't
        here. Made when something is encoded first; decoding needs none."""
        return dict.fromkeys((t[i:] for t in self.ranks for i in range(1, len(t))), -1) | self.ranks

    def merged(self, b: bytes) -> list[bytes]:
        """The least rank is merged first, the leftmost of equal ones: what the dynamic programming stands for. For short strings."""
        rank, none = self.ranks.get, len(self.ranks)
        parts, scores = [b[i : i + 1] for i in range(len(b))], [rank(b[i : i + 2], none) for i in range(len(b) - 1)]
        while scores and (least := min(scores)) < none:
            i = scores.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def may_follow(self, before: int, token: int) -> bool:
        """Whether token may stand after before (-1: at the start). Answers are kept in may, by (before + 1) << 32 | token."""
        if len(self.may) >= ANSWERS:
            self.may.clear()
        pair = [self.bytes[before]] if before >= 0 else []
        pair.append(self.bytes[token])
        known = self.may[(before + 1) << 32 | token] = self.merged(b"".join(pair)) == pair
        return known


class Prefixes:
    """The last token of each prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", known: array | None = None) -> None:
        """known: entries of data's first bytes, if there are some already."""
        self.vocabulary, self.data, self.last = vocabulary, data, known[:] if known else array("i")
        self._extend(len(data))

    def _extend(self, end: int) -> None:
        """Entries of the prefixes up to end bytes."""
        data, last, endings, may = self.data, self.last, self.vocabulary.endings.get, self.vocabulary.may.get
        for stop in range(len(last) + 1, end + 1):
            start = stop - 1
            while (token := endings(data[start:stop])) is not None:
                if token >= 0:
                    before = last[start - 1] if start else -1
                    if (follows := may((before + 1) << 32 | token)) or follows is None and self.vocabulary.may_follow(before, token):
                        last.append(token)
                        break
                if not start:
                    raise ValueError("a byte that is no token")
                start -= 1
            else:
                raise ValueError("a byte that is no token")

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def replace(self, low: int, high: int, new: bytes) -> int:
        """Puts new in place of the bytes from low to high; how many entries were made."""
        old, shift = self.last, low + len(new) - high
        self.data = self.data[:low] + new + self.data[high:]
        self.last, same = old[:low], 0
        for end in range(low + 1, len(self.data) + 1):
            self._extend(end)
            same = same + 1 if end - shift > high and self.last[-1] == old[end - shift - 1] else 0
            if same >= self.vocabulary.longest:
                self.last.extend(old[end - shift :])
                return end - low
        return len(self.data) - low

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class Encoder(dict):
    """Tokens of matches, as bytes: those met before, and others made when asked for."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.split, self.held = vocabulary, regex.compile(pattern).findall, 0
        self.stems: dict[bytes, array] = {}

    def __missing__(self, match: str) -> bytes:
        data = match.encode()
        whole = self.vocabulary.ranks.get(data)
        out = _packed([whole] if whole is not None else Prefixes(self.vocabulary, data, self._stem(data[:STEM])).tokens())
        if len(data) <= LONGEST:
            self.held += 4 * len(data) + 200
            if self.held > HELD:
                self.clear()
                self.stems.clear()
                self.held = 0
            self[match] = out
        return out

    def _stem(self, data: bytes) -> array:
        known = self.stems.get(data)
        if known is None:
            known = self.stems[data] = Prefixes(self.vocabulary, data).last
            self.held += 200
        return known

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, tokens: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, memoryview(tokens).cast("I")))

    def update(self, old: str, tokens: bytes, new: str) -> bytes:
        """Tokens of new from those of old; only what lies between two sure beginnings of matches around the change is encoded."""
        low, high = _common(old, new)
        left = _sure(old, low - 2, -1)
        right = _sure(old, len(old) - high + 1, 1)
        rest = len(old) - right
        before, after = len(old[:left].encode()), len(old[right:].encode())
        sizes, ids = self.vocabulary.bytes, memoryview(tokens).cast("I")
        a = b = 0
        while before:
            before -= len(sizes[ids[a]])
            a += 1
        while after:
            after -= len(sizes[ids[-1 - b]])
            b += 1
        return tokens[: 4 * a] + self.encode(new[left : len(new) - rest]) + tokens[len(tokens) - 4 * b :]


def _packed(tokens: list[int]) -> bytes:
    return b"".join(t.to_bytes(4, "little") for t in tokens)


def _common(a: str, b: str) -> tuple[int, int]:
    """Characters that both begin and, beside these, end with: found by halving, so that whole slices are compared."""

    def most(equal, top: int) -> int:
        low = 0
        while low < top:
            mid = (low + top + 1) // 2
            low, top = (mid, top) if equal(mid) else (low, mid - 1)
        return low

    n = min(len(a), len(b))
    start = most(lambda k: a[:k] == b[:k], n)
    return start, most(lambda k: a[len(a) - k :] == b[len(b) - k :], n - start)


def _sure(text: str, at: int, way: int) -> int:
    """From at on in the direction way: the first place where a blank follows something that is no space, or that end of the text."""
    while 0 < at < len(text):
        if text[at] in " \t\n\r" and not text[at - 1].isspace():
            return at
        at += way
    return 0 if way < 0 else len(text)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, base64 and rank. Its size is checked, as every task gets a copy."""
    url = path if "://" in path else f"file://{path}"
    lines = spark.read.text(url).limit(MOST_TOKENS + 1).toArrow().column(0).to_pylist()
    if len(lines) > MOST_TOKENS:
        raise ValueError(f"a vocabulary of more than {MOST_TOKENS} tokens")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


_ENCODERS: dict[str, Encoder] = {}  # of this Python process, which runs many tasks: one, by what it is made of


def _encoder(key: str, ranks, pattern: str) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(ranks.value), pattern)
    return _ENCODERS[key]


def _with(df: DataFrame, ranks: dict[bytes, int], pattern: str, source: str, added: list[tuple[str, T.DataType]], make) -> DataFrame:
    """df with columns that make(encoder, batch) gives, batches cut so that column source stays small."""
    clash = [name for name, _ in added if name in df.columns]
    if clash:
        raise ValueError(f"columns that the table has already: {clash}")
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = _encoder(key, shared, pattern)
        for batch in batches:
            for part in text_chunks(batch, source):
                yield pa.RecordBatch.from_arrays([*part.columns, *make(encoder, part)], [*part.schema.names, *(name for name, _ in added)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in added)]))


def _texts(part: pa.RecordBatch, column: str) -> list[str]:
    return pc.fill_null(part.column(column), "").to_pylist()


def _binary(part: pa.RecordBatch, column: str) -> list[bytes]:
    return pc.fill_null(part.column(column), b"").to_pylist()


def encode(df: DataFrame, text: str, ranks: dict[bytes, int], pattern: str, tokens: str = "tokens") -> DataFrame:
    """df with the tokens of a text column."""
    return _with(df, ranks, pattern, text, [(tokens, T.BinaryType())], lambda e, p: [pa.array([e.encode(t) for t in _texts(p, text)], pa.binary())])


def decode(df: DataFrame, tokens: str, ranks: dict[bytes, int], pattern: str, data: str = "data") -> DataFrame:
    """df with the bytes that a token column stands for."""
    return _with(df, ranks, pattern, tokens, [(data, T.BinaryType())], lambda e, p: [pa.array([e.decode(t) for t in _binary(p, tokens)], pa.binary())])


def update(df: DataFrame, old: str, tokens: str, new: str, ranks: dict[bytes, int], pattern: str, out: str = "new_tokens") -> DataFrame:
    """df with the tokens of column new, made from those of column old: for tables of texts that were appended to or edited."""
    make = lambda e, p: [pa.array([e.update(*x) for x in zip(_texts(p, old), _binary(p, tokens), _texts(p, new), strict=True)], pa.binary())]
    return _with(df, ranks, pattern, new, [(out, T.BinaryType())], make)
