"""Secret scans: base patterns, and guess-cost scoring of values in a credential context.

Base spans are the matches of three fixed patterns (whole matches, leftmost, not overlapping within a kind; matches
that fail the length test are dropped after matching). The method adds spans of kind `guess`: a wider set of contexts
(key words joined to a value by `:`, `=` or `is`, and user:password in addresses) gives candidate values, of any length.

Guess cost. A value's cost is the least sum of log10 guesses over its segmentations into words of a ranked dictionary,
dates, repeats, keyboard walks and brute-force spans, PLACE for every segment after the first; it is found by dynamic
programming over the whole value. A repeat or walk is a part of a maximal one that starts where that starts or ends where
that ends (repeats of blocks of 2 to BLOCK characters: where it starts), so the work is linear in the value's length. Values that cost GUESS_LIMIT or more are secrets. As costs only
grow along a segmentation, the scan stops once every place within reach of a segment costs that much; that changes no verdict.
Values of base matches are scored too: they keep their base span and get no second one, but their cost is given, so that
`password: password1` and a random token can be told apart. Costs are given up to COST_SHOWN.

Dictionary. Fixed common words of passwords and names, and then the words of the texts themselves, by the number of
documents they occur in outside credential values, the first DICTIONARY of them; what is collected and broadcast is
bounded by that parameter.

Defined results: null or empty text: no spans, no costs; a value inside a base match of kind assign stays with it (no second
span); ties between kinds at one start: in the order of KINDS; words with equal counts: in the order of their letters;
repeated rows: scanned each; empty table: no rows; very long texts are scanned whole; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_words, settle, small_batches, split_words, text_chunks

KINDS = ("assign", "access", "hex", "guess")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Contexts of the method: words that announce a credential, and addresses with user and password. No value of fewer
#: than 6 characters reaches GUESS_LIMIT.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z])(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret|auth[_-]?key|private[_-]?key|credential)s?["']?(?:\x20*+[:=]|\x20++is(?=\x20))\x20*+["']?([^\s"'<>,;]{6,}+)|(?<=[a-z0-9+.-])://[^\s:/@"'<>]++:([^\s@/"'<>]{6,}+)@)""",
    re.I | re.A,
)
#: One cheap test that every text with any span passes.
ANY = r"(?i)password|passwd|passphrase|pwd|secret|token|key|credential|://[^\s:/@]+:[^\s@/]{6,}@|AKIA[A-Z0-9]|[0-9a-f]{32}"

#: log10 of the guesses from which a value is a secret; cost of each further segment; words of the dictionary at most.
GUESS_LIMIT, PLACE, DICTIONARY = 8.0, 0.3, 20_000
#: Costs that are given end here: a value that costs more is given this cost.
COST_SHOWN = 40.0
#: Least and greatest length of a dictionary word taken from the texts; longest block of a repeat.
SHORTEST, LONGEST, BLOCK = 3, 24, 16
#: Common words of passwords and names, most common first; a word costs the log of its rank.
WORDS = (
    "password the and that have for not with you this but from they say her she will one all would there their what "
    "out about who get which when make can like time just him know take people into year your good some could them "
    "see other than then now look only come over think also back after use two how our work first well way even new "
    "want because any these give day most admin login welcome letmein monkey dragon master shadow secret token test "
    "user root guest default change example sample pass word key love hello sunshine princess football baseball "
    "michael jennifer jordan michelle thomas daniel andrew joshua jessica charlie ashley matthew robert liverpool "
    "chelsea arsenal barcelona superman batman pokemon starwars ranger buster soccer hockey killer george "
    "pepper cookie ginger summer winter spring autumn january february march april may june july august september "
    "october november december monday tuesday wednesday thursday friday saturday sunday null none true false "
    "undefined required your_password your_token placeholder redacted hidden unknown value string"
).split()
LEET = str.maketrans("430157$@!", "aeoistsai")
#: Keyboard rows.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qwertzuiop", "abcdefghijklmnopqrstuvwxyz")
NEXT = {p for row in ROWS for r in (row, row[::-1]) for p in zip(r, r[1:])}
WALK = math.log10(4 * len(ROWS) * 26) / 2
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


@dataclass(frozen=True)
class Words:
    """Ranks of words, and the longest word's length."""

    rank: dict[str, int]
    longest: int = field(default=0)

    @staticmethod
    def of(more: list[str] = []) -> Words:  # noqa: B006
        every = dict.fromkeys([*WORDS, *more])
        return Words({w: i + 1 for i, w in enumerate(every)}, max(map(len, every)))


PLAIN = Words.of()


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def _runs(n: int, same) -> list[tuple[int, int]]:
    """Maximal stretches [start, end) in which same(i) holds for every place but the first."""
    out, start = [], 0
    for i in range(1, n + 1):
        if i == n or not same(i):
            if i - start > 1:
                out.append((start, i))
            start = i
    return out


def _spans(v: str, low: str, words: Words) -> dict[int, list[tuple[int, float]]]:
    """Repeats and walks by their start: (end, cost). Those of single characters have 3 or more."""
    n, out = len(v), {}

    def offer(i: int, j: int, cost: float) -> None:
        out.setdefault(i, []).append((j, cost))

    for same, one in ((lambda i: low[i] == low[i - 1], None), (lambda i: (low[i - 1], low[i]) in NEXT, WALK)):
        for start, end in _runs(n, same):
            base = _alphabet(v[start]) if one is None else one
            for j in range(start + 3, end + 1):
                offer(start, j, base + math.log10(j - start))
            for i in range(start + 1, end - 2):
                offer(i, end, base + math.log10(end - i))
    for w in range(2, min(BLOCK, n // 2) + 1):
        for start, end in _runs(n - w + 1, lambda i, w=w: low[i - 1] == low[i + w - 1]):
            times = (end - 1 - start) // w + 1  # end - 1 - start places are followed by the same character w further on
            if times > 1:
                block = guess_cost(v[start : start + w], words)
                for k in range(2, times + 1):
                    offer(start, start + k * w, block + math.log10(k))
    return out


def guess_cost(value: str, words: Words = PLAIN, limit: float = math.inf) -> float:
    """log10 of the guesses that the value withstands; limit if it is at least that."""
    n = len(value)
    low = "".join(c if len(c.lower()) > 1 else c.lower() for c in value)
    plain, spans = low.translate(LEET), _spans(value, low, words)
    best, brute, reach = [0.0] + [math.inf] * n, math.inf, 0  # best segmentation up to a place; its last span brute force

    def offer(j: int, cost: float) -> None:
        nonlocal reach
        if cost < best[j]:
            best[j] = cost
            if cost < limit:
                reach = max(reach, j)

    for i in range(n):
        if i > reach and brute >= limit:
            return limit
        at = best[i] + (PLACE if i else 0.0)
        brute = min(brute, at) + _alphabet(value[i])
        offer(i + 1, brute)
        if at >= limit:
            continue
        for j in range(i + SHORTEST, min(n, i + words.longest) + 1):
            r = words.rank.get(low[i:j])
            if r:
                offer(j, at + math.log10(r + 1) + (PLACE if value[i:j] != low[i:j] else 0.0))
            r = words.rank.get(plain[i:j])
            if r:
                offer(j, at + math.log10(r + 1) + 2 * PLACE)
        m = DATE.match(value, i)
        if m:
            offer(m.end(), at + (math.log10(36525) if m.end() - i > 4 else math.log10(120)))
        for j, cost in spans.get(i, ()):
            offer(j, at + cost)
    return min(best[n], limit)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def contexts(text: str) -> list[tuple[int, int, int]]:
    """Start of the context, start and end of the value, of all credential contexts."""
    out = []
    for m in CONTEXT.finditer(text):
        a, b = m.span(1) if m.group(1) is not None else m.span(2)
        out.append((m.start(), a, b))
    return out


def scored_values(text: str, words: Words = PLAIN, most: float = COST_SHOWN) -> list[tuple[int, int, float]]:
    """Start, end and guess cost (most at most) of every credential value, by start: those of base assignments and of contexts."""
    found: dict[int, int] = {}
    for start, a, b in contexts(text):
        while b > a and text[b - 1] in ".,!?):]":
            b -= 1
        prose = text[start:a].rstrip("\"' ").lower().endswith(" is") and text[a:b].isalpha()  # a plain word after "is"
        if b - a >= 6 and not prose:
            found[a] = b
    found |= {m.start(2): m.end(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8}
    return [(a, b, guess_cost(text[a:b], words, most)) for a, b in sorted(found.items())]


def guess_spans(taken: list[tuple[str, int, int]], scored: list[tuple[int, int, float]], limit: float = GUESS_LIMIT) -> list[tuple[str, int, int]]:
    """The values of scored that cost limit or more and don't begin inside an assignment of taken."""
    assigned = [(a, b) for k, a, b in taken if k == "assign"]
    out, at = [], 0
    for a, b, cost in scored:
        while at < len(assigned) and assigned[at][1] <= a:
            at += 1
        if cost >= limit and not (at < len(assigned) and assigned[at][0] <= a):
            out.append(("guess", a, b))
    return out


def _order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans_of(text: str, words: Words = PLAIN) -> list[tuple[str, int, int]]:
    return _scan(text, words)[0]


def _scan(text: str, words: Words) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, float]]]:
    base, scored = base_spans(text), scored_values(text, words)
    return _order(base + guess_spans(base, scored)), scored


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _without_values(text: str) -> str:
    out, upto = [], 0
    for _, a, b in contexts(text):
        out.append(text[upto:a])
        upto = b
    return "".join([*out, text[upto:]])


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> Words:
    """The fixed words, then the most frequent of the texts (by documents, then letters), most at most."""
    small_batches(docs.sparkSession)

    def count(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                maybe = pc.match_substring_regex(texts, ANY).to_numpy(zero_copy_only=False).astype(bool)
                if maybe.any():
                    some = pa.array([_without_values(t) for t in texts.filter(pa.array(maybe)).to_pylist()], texts.type)
                    texts = pc.replace_with_mask(texts, pa.array(maybe), some)
                flat, offsets = split_words(texts)
                words, at = distinct_words(flat)
                forms, back = distinct_words(pc.utf8_trim(pc.utf8_lower(words), characters=".,;:!?\"'()[]{}"))
                if not len(forms):
                    continue
                own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                pairs = np.unique(own * len(forms) + back[at])
                n = np.bincount(pairs % len(forms), minlength=len(forms))
                sizes = pc.utf8_length(forms)
                fit = pc.and_(pc.utf8_is_alpha(forms), pc.and_(pc.greater_equal(sizes, SHORTEST), pc.less_equal(sizes, LONGEST)))
                yield pa.RecordBatch.from_arrays([forms.filter(fit), pa.array(n).filter(fit)], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    top = settle(counts.orderBy(F.desc("n"), "word").limit(most), "secret-words")  # written, so no task's own top goes to the driver
    return Words.of([r["word"] for r in top.orderBy(F.desc("n"), "word").collect()])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
COST = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())])


def find_secrets(docs: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """doc_id, found (array of kind, start, end in code points; by start, then kind) and scored (array of start, end, cost
    of every credential value, those of base matches too) of every row. most: words of the texts that the dictionary takes
    at most; 0 saves the pass that counts them."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, most) if most else PLAIN)

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                maybe = pc.match_substring_regex(texts, ANY).to_pylist()
                found, scored = [], []
                for i, m in enumerate(maybe):
                    spans, costs = _scan(texts[i].as_py(), shared.value) if m else ([], [])
                    found.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans])
                    scored.append([dict(zip(("start", "end", "cost"), x, strict=True)) for x in costs])
                columns = [part.column("doc_id"), pa.array(found, pa.list_(SPAN)), pa.array(scored, pa.list_(COST))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "found", "scored"])

    kinds = "doc_id long, found array<struct<kind:string,start:long,end:long>>, scored array<struct<start:long,end:long,cost:double>>"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
