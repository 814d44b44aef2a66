"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. One pass makes each text's set of distinct word shingles (64-bit hashes), its size, a 128-bit digest and a MinHash
   signature. Texts with equal sets form a class, named by a hash of the digest and represented by its least doc_id.
2. The forest: each tree is a sorted order of the signatures, with their values in an order of the tree's own. Rows are
   partitioned by range and sorted; runs whose longest common prefix is the level's depth or more are regions. Regions
   of 2 to REGION members are compared within themselves: signatures that agree at loose(threshold) or more are
   neighbours, and a spanning forest of the neighbours goes on. Sizes are counted beforehand, so that single documents
   and larger regions never meet in a sort, and regions with the same members in several trees are looked at once.
   Members of larger regions go to the next of LEVELS, which sorts them to greater depth in more trees. Those of the first
   level are also compared with their central member, the one that agrees most with their commonest values; where
   every member is its neighbour, the region is done. At the last level members hang on their least one.
3. Neighbours' components are clusters. Only there full sets are made again from the texts and compared exactly:
   clusters of up to BLOCK documents in one piece, larger ones by pairs of blocks. In large clusters every document is
   first compared with one pivot, the document that agrees best with the cluster's most common values; those that link
   to it need no comparison among themselves.
4. Exact links' components, with the classes, are the result.

A pair at the threshold shares a prefix of depth d in a tree with the chance of threshold ** d. Were the trees
independent, all trees of a level would miss it with the chances below (at 0.85; at 0.80); a pair is lost if it is missed by
the levels it goes through, the last of which is the first one with a small region for it or a hub next to both.

    depth  3, 16 trees  2.4e-7  1.0e-5        depth 16, 64 trees  7.1e-3  0.16
    depth  8, 32 trees  3.8e-5  2.8e-3        depth 32, 96 trees  0.59    0.93

So only families of several thousand texts that are nearly as similar as the threshold, and not within it to their central
one, lose links; their members are more often connected through others.

Hashes stand for words and shingles (64 bits, 128 for whole sets); they aren't compared as strings.

Defined results: null or empty text, or no words: size 0, linked with nothing; fewer words than a shingle: the whole
sequence is the one shingle; null doc_id: left to itself; repeated doc_id: rows are classed by their own text; ties:
the least doc_id stands for a class; empty table: no rows; other columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, hash_words, keep_likely, mix, settle, small_batches, split_likely, split_words, text_chunks
from .components import components

SHINGLE = 5
SIGNATURE = 96
#: Depth and number of trees of each level of the forest; members of a region; ranges of a level's sorted orders; the
#: share of pairs at the threshold whose signatures may agree too little to be neighbours.
LEVELS = ((3, 16), (8, 32), (16, 64), (32, 96))
REGION, RANGES, DROPPED = 512, 2048, 1e-6
#: Documents of a block of exact comparison, and of a chunk of shingles in it.
BLOCK, COLUMNS = 384, 8192
_RNG = np.random.default_rng(20240607)
#: Odd multipliers and offsets of the signature's hash functions.
MULTIPLIERS = _RNG.integers(1, 2**63, SIGNATURE, dtype=np.uint64) | np.uint64(1)
OFFSETS = _RNG.integers(0, 2**63, SIGNATURE, dtype=np.uint64)
#: The order of values in each tree. The first level's trees begin with places of their own, so they are independent.
FIRST = np.stack([np.roll(np.arange(SIGNATURE), -LEVELS[0][0] * t) for t in range(LEVELS[0][1])])
DEEPER = np.stack([_RNG.permutation(SIGNATURE) for _ in range(max(n for _, n in LEVELS))])


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, one text after the other and sorted in each, and where each begins."""
    flat, offsets = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    h = hash_words(flat)
    n = np.diff(offsets)
    if not len(h):
        return h, np.zeros(len(n) + 1, np.int64)
    g = np.zeros(len(h) + shingle, np.uint64)  # rolled hashes of whole shingles
    w = np.concatenate([h, np.zeros(shingle, np.uint64)])
    for k in range(shingle):
        g[: len(h)] = mix(g[: len(h)] + w[k : k + len(h)])
    at = np.arange(len(h))
    own = np.repeat(np.arange(len(n)), n)
    whole = at + shingle <= offsets[1:][own]
    for i in np.flatnonzero((n > 0) & (n < shingle)):  # the whole sequence, hashed with its length
        x = np.array([n[i]], np.uint64)
        for k in range(offsets[i], offsets[i + 1]):
            x = mix(x + h[k : k + 1])
        g[offsets[i]] = x[0]
        whole[offsets[i]] = True
    g, own = g[: len(h)][whole], own[whole]
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    g, own = g[fresh], own[fresh]
    return g, np.searchsorted(own, np.arange(len(n) + 1))


def signatures(g: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SIGNATURE values for each set that has members: the low 16 bits of each least hash. Zeros for the others."""
    some = np.diff(starts) > 0
    out = np.zeros((len(some), SIGNATURE), np.uint16)
    if some.any():
        at = starts[:-1][some]
        for k in range(SIGNATURE):
            x = (g * MULTIPLIERS[k] + OFFSETS[k]) >> np.uint64(32)
            out[some, k] = np.minimum.reduceat(x, at).astype(np.uint16)
    return out


def loose(threshold: int) -> float:
    """The agreement of signatures from which documents are neighbours: fewer than DROPPED of the pairs at the threshold
    (in percent) have less."""
    p, k, below = threshold / 100, 0, 0.0
    while k < SIGNATURE and (below := below + math.comb(SIGNATURE, k) * p**k * (1 - p) ** (SIGNATURE - k)) < DROPPED:
        k += 1
    return k / SIGNATURE


def _sketch(batches):
    for batch in batches:
        for part in text_chunks(batch, "text"):
            g, starts = shingle_sets(part.column("text"))
            n = np.diff(starts)
            sums, xors = _digests(g, starts)
            sig = signatures(g, starts)
            raw = pa.array([s.tobytes() if k else None for s, k in zip(sig, n, strict=True)], pa.binary())
            cols = [part.column("doc_id"), part.column("text_hash"), pa.array(n), pa.array(sums), pa.array(xors), raw]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n", "h1", "h2", "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SIGNATURE)


def _orders(level: int) -> np.ndarray:
    """The level's trees: orders of the signature's places."""
    return FIRST if not level else DEEPER[: LEVELS[level][1]]


def _keys(level: int):
    depth, trees = LEVELS[level]

    def run(batches):
        """A row for each tree, with a hash of the first values in the tree's order."""
        for b in batches:
            sig, rep = _matrix(b.column("sig")), b.column("rep")
            for t, order in enumerate(_orders(level)):
                key = np.full(len(sig), t + 1 + SIGNATURE * depth, np.uint64)
                for k in order[:depth]:
                    key = mix(key * np.uint64(31) + sig[:, k].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([rep, pa.array(np.full(len(sig), t, np.int32)), pa.array(key.view(np.int64))], ["rep", "tree", "key"])

    return run


def _in_order(level: int):
    trees = LEVELS[level][1]

    def run(batches):
        """Rows with their place in the sorted order of their tree: tree and signature as sortable bytes. The range is
        that of tree and first value, cut by arithmetic: the low bits of a minimum are spread evenly."""
        for b in batches:
            tree = b.column("tree").to_numpy(zero_copy_only=False)
            sig = np.take_along_axis(_matrix(b.column("sig")), _orders(level)[tree], axis=1)
            out = np.empty((len(sig), 1 + 2 * SIGNATURE), np.uint8)
            out[:, 0], out[:, 1:] = tree, np.ascontiguousarray(sig.astype(">u2")).view(np.uint8)
            ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
            raw = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(ends), pa.py_buffer(out)])
            cut = (tree.astype(np.int64) * 65536 + sig[:, 0]) * RANGES // (trees * 65536)
            yield pa.RecordBatch.from_arrays([pa.array(cut.astype(np.int32)), raw, b.column("rep")], ["range", "sorted", "rep"])

    return run


def regions_of(batches, depth: int):
    """(rep, signature) arrays of runs of sorted rows whose longest common prefix is the tree and depth values or more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        rows, rep = np.frombuffer(b"".join(b.column("sorted").to_pylist()), np.uint8).reshape(b.num_rows, -1), b.column("rep").to_numpy(zero_copy_only=False)
        head, sig = rows[:, : 1 + 2 * depth], np.ascontiguousarray(rows[:, 1:]).view(np.uint16)
        cuts = np.concatenate([[0], np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1, [len(rows)]])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (last != head[s]).any():
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            held.append((rep[s:e], sig[s:e]))
            last = head[s]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def in_groups(batches, key: str):
    """Tables of rows with equal keys, from batches in which equal keys stand together."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and k[s] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = k[s]
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def labels(near: np.ndarray) -> np.ndarray:
    """Least index reachable over a symmetric matrix of links."""
    out = np.arange(len(near))
    while True:
        least = np.where(near, out[None, :], len(near)).min(axis=1)
        new = np.minimum(out, least)
        new = new[new]
        if (new == out).all():
            return out
        out = new


def _neighbours(least: float, depth: int):
    def run(batches):
        """A spanning forest of the neighbours in each region, as (a, b)."""
        for reps, sig in regions_of(batches, depth):
            near = np.zeros((len(reps), len(reps)), bool)
            for s in range(0, len(reps), 64):
                near[s : s + 64] = (sig[s : s + 64, None, :] == sig[None, :, :]).mean(axis=2) >= least
            lab = labels(near)
            use = lab != np.arange(len(lab))
            if use.any():
                yield pa.RecordBatch.from_arrays([pa.array(reps[lab[use]]), pa.array(reps[use])], ["a", "b"])

    return run


def central(rows: DataFrame) -> DataFrame:
    """(cluster, pivot, hub: its signature) of rows (rep, cluster, sig): the document that agrees most with the
    commonest values at the signature's first 16 places. Each batch sends its commonest values only."""
    places, tops = 16, 4

    def votes(batches):
        for b in batches:
            coded = b.column("cluster").dictionary_encode()
            sig, cluster = _matrix(b.column("sig"))[:, :places], coded.indices.to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for c in range(len(coded.dictionary)):
                for place, column in enumerate(sig[cluster == c].T):
                    values, counts = np.unique(column, return_counts=True)
                    out += [(c, place, int(values[k]), int(counts[k])) for k in np.argsort(-counts, kind="stable")[:tops]]
            cols = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(cols[0]), *cols[1:]], ["cluster", "place", "value", "c"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf.groupby(["place", "value"], as_index=False)["c"].sum().sort_values(["place", "c", "value"], ascending=[True, False, True])
        mode = total.drop_duplicates("place").sort_values("place")["value"].tolist()
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[:1], "mode": [mode]})

    kind = rows.schema["cluster"].dataType.simpleString()
    common = rows.select("cluster", "sig").mapInArrow(votes, f"cluster {kind}, place long, value long, c long").groupBy("cluster").applyInPandas(merge, f"cluster {kind}, mode array<long>")

    def agree(batches):
        for b in batches:
            sig = _matrix(b.column("sig"))[:, :places].astype(np.int64)
            mode = np.array(b.column("mode").to_pylist(), np.int64).reshape(len(sig), places)
            yield b.select(["cluster", "rep", "sig"]).append_column("score", pa.array((sig == mode).sum(axis=1)))

    scored = rows.join(settle(common, "lsh-common"), "cluster").select("cluster", "rep", "sig", "mode").mapInArrow(agree, f"cluster {kind}, rep long, sig binary, score long")
    best = scored.groupBy("cluster").agg(F.min_by(F.struct("rep", "sig"), F.struct(-F.col("score"), "rep")).alias("b"))
    return best.select("cluster", F.col("b.rep").alias("pivot"), F.col("b.sig").alias("hub"))


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the documents: always by sorting, so that the plan is the same at every size."""
    return left.join(right.hint("merge"), on, how)


def hub_links(rows: DataFrame, least: float) -> DataFrame:
    """(cluster, rep, hub: the region's central document, near) of large regions (rep, cluster, sig). Linear."""
    hub = settle(central(rows), "lsh-hub")

    def compare(batches):
        for b in batches:
            near = (_matrix(b.column("sig")) == _matrix(b.column("hub"))).mean(axis=1) >= least if b.num_rows else np.empty(0, bool)
            yield b.select(["cluster", "rep", "pivot"]).rename_columns(["cluster", "rep", "hub"]).append_column("near", pa.array(near))

    return settle(rows.join(hub, "cluster").select("cluster", "rep", "pivot", "sig", "hub").mapInArrow(compare, "cluster long, rep long, hub long, near boolean"), "lsh-near-hub")


def forest_edges(reps: DataFrame, threshold: int) -> DataFrame:
    """Candidate edges (a, b) between representatives (rep, sig)."""
    agree, found, now = loose(threshold), [], reps.select("rep", "sig")
    for level, (depth, _) in enumerate(LEVELS):
        rows = settle(now.mapInArrow(_keys(level), "rep long, tree int, key long"), "lsh-keys")
        shared = settle(rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "lsh-regions")
        member = settle(joined(keep_likely(rows, "key", bloom(shared, "key")), shared, "key"), "lsh-members")
        small = member.filter(f"m <= {REGION}")
        who = small.groupBy("key", "m").agg(F.bit_xor(F.xxhash64("rep")).alias("who")).groupBy("who", "m").agg(F.min("key").alias("key")).select("key")
        pairs = joined(small, who, "key").select("rep", "tree")
        ordered = joined(now, pairs, "rep").select("rep", "tree", "sig").mapInArrow(_in_order(level), "range int, sorted binary, rep long")
        found.append(settle(ordered.repartition("range").sortWithinPartitions("sorted").mapInArrow(_neighbours(agree, depth), "a long, b long"), "lsh-near"))
        held = member.filter(f"m > {REGION}").select("rep", "key")
        if held.isEmpty():
            break
        if level == len(LEVELS) - 1:
            least = held.groupBy("key").agg(F.min("rep").alias("least"))
            found.append(settle(joined(held, least, "key").filter("rep <> least").selectExpr("least AS a", "rep AS b"), "lsh-hang"))
            break
        if level:
            left = held.select("rep").distinct()
        else:
            links = hub_links(joined(now, held.select("rep", F.col("key").alias("cluster")), "rep").select("rep", "cluster", "sig"), agree)
            found.append(links.filter("near AND rep <> hub").selectExpr("hub AS a", "rep AS b"))
            open_ = links.groupBy("cluster").agg(F.min("near").alias("all_near")).filter("NOT all_near").select("cluster")
            left = links.join(open_, "cluster").select("rep").distinct()
        now = settle(joined(now, left, "rep").select("rep", "sig"), "lsh-deeper")
        if now.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _digests(g: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    sums, xors, some = np.zeros(len(starts) - 1, np.uint64), np.zeros(len(starts) - 1, np.uint64), np.diff(starts) > 0
    if some.any():
        sums[some] = np.add.reduceat(mix(g), starts[:-1][some])
        xors[some] = np.bitwise_xor.reduceat(mix(g + np.uint64(0x9E3779B97F4A7C15)), starts[:-1][some])
    return sums.view(np.int64), xors.view(np.int64)


def _sets(batches):
    """rep, cluster, m and the sorted shingles, as bytes, of the rows that have their class's set (a doc_id may be repeated)."""
    for batch in batches:
        for part in text_chunks(batch, "text"):
            g, starts = shingle_sets(part.column("text"))
            sums, xors = _digests(g, starts)
            own = (sums == part.column("h1").to_numpy(zero_copy_only=False)) & (xors == part.column("h2").to_numpy(zero_copy_only=False))
            raw = pa.array([g[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("cluster"), part.column("m"), raw], ["rep", "cluster", "m", "members"]).filter(pa.array(own))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over chunks of the shingles that both sides have."""
    lv, rv = np.concatenate(left), np.concatenate(right)
    li, ri = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    common = np.intersect1d(lv, rv)
    lc, rc = np.searchsorted(common, lv), np.searchsorted(common, rv)
    lk = (lc < len(common)) & (common[np.minimum(lc, len(common) - 1)] == lv) if len(common) else np.zeros(len(lv), bool)
    rk = (rc < len(common)) & (common[np.minimum(rc, len(common) - 1)] == rv) if len(common) else np.zeros(len(rv), bool)
    lc, li, rc, ri = lc[lk], li[lk], rc[rk], ri[rk]
    lo, ro = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
    lc, li, rc, ri = lc[lo], li[lo], rc[ro], ri[ro]
    out = np.zeros((len(left), len(right)), np.int64)
    for s in range(0, len(common), COLUMNS):
        a, b = np.searchsorted(lc, [s, s + COLUMNS]), np.searchsorted(rc, [s, s + COLUMNS])
        width = min(COLUMNS, len(common) - s)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[li[a[0] : a[1]], lc[a[0] : a[1]] - s] = 1
        y[ri[b[0] : b[1]], rc[b[0] : b[1]] - s] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def _linked(threshold: int):
    def run(batches):
        """Exact links of each piece as (a, b): a spanning forest. side: 0 both, 1 left, 2 right block."""
        for g in in_groups(batches, "piece"):
            reps, side, raw = g.column("rep").to_numpy(), g.column("side").to_numpy(), g.column("members").to_pylist()
            _, once = np.unique(reps, return_index=True)  # a repeated row comes again
            reps, side, sets = reps[once], side[once], [np.frombuffer(raw[i], np.uint64) for i in once]
            size = np.array([len(x) for x in sets])
            left = np.flatnonzero(side < 2)
            right = left if (side == 0).all() else np.flatnonzero(side == 2)
            if not len(left) or not len(right):
                continue
            inter = overlaps([sets[i] for i in left], [sets[i] for i in right])
            union = size[left][:, None] + size[right][None, :] - inter
            near = np.zeros((len(reps), len(reps)), bool)
            near[np.ix_(left, right)] = 100 * inter >= threshold * union
            near |= near.T
            lab = labels(near)
            use = lab != np.arange(len(lab))
            if use.any():
                yield pa.RecordBatch.from_arrays([pa.array(reps[lab[use]]), pa.array(reps[use])], ["a", "b"])

    def of_texts(batches):
        """The same of whole clusters that come as texts."""
        pieces = (b.rename_columns(["rep", "piece", "m", "members"]).append_column("side", pa.array(np.zeros(b.num_rows, np.int32))) for b in _sets(batches))
        return run(pieces)

    return run, of_texts


def exact_links(docs: DataFrame, clusters: DataFrame, signs: DataFrame, threshold: int) -> DataFrame:
    """Spanning edges of all exact links within clusters (rep, cluster, m members, doc and digest of the class)."""
    likely = keep_likely(docs.select(F.col("doc_id").alias("doc"), "text"), "doc", bloom(clusters, "doc"))
    texts = settle(joined(likely, clusters, "doc").select("rep", "cluster", "m", "h1", "h2", "text"), "near-texts")
    run, of_texts = _linked(threshold)
    schema = "a long, b long"
    small = texts.filter(f"m <= {BLOCK}").repartition("cluster").sortWithinPartitions("cluster")
    out = settle(small.mapInArrow(of_texts, schema), "near-links")
    large = settle(texts.filter(f"m > {BLOCK}").mapInArrow(_sets, "rep long, cluster long, m long, members binary"), "near-sets")
    if large.isEmpty():
        return out
    # Every document of a large cluster against its pivot: pairs are joined, not gathered.
    pivot = central(joined(signs, large.select("rep", "cluster").distinct(), "rep")).select("cluster", "pivot")
    pivot = settle(pivot.join(large.select(F.col("rep").alias("pivot"), F.col("members").alias("pm")), "pivot").dropDuplicates(["cluster"]), "near-pivot")

    def to_pivot(batches):
        for b in batches:
            keep = []
            for x, p in zip(b.column("members").to_pylist(), b.column("pm").to_pylist(), strict=True):
                x, p = np.frombuffer(x, np.uint64), np.frombuffer(p, np.uint64)
                inter = len(np.intersect1d(x, p, assume_unique=True))
                keep.append(100 * inter >= threshold * (len(x) + len(p) - inter))
            yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("rep"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    star = settle(large.join(pivot, "cluster").mapInArrow(to_pivot, "a long, b long, linked boolean").distinct(), "near-star")
    # Blocks of linked documents need no pairs among themselves; every other pair of blocks is one piece.
    member = large.join(star.selectExpr("b AS rep", "linked"), "rep")
    counts = member.groupBy("cluster").agg(F.count(F.when(F.col("linked"), 1)).alias("n1"), F.count(F.when(~F.col("linked"), 1)).alias("n0"))
    member = member.join(counts, "cluster")
    b1, b0 = F.ceil(F.col("n1") / BLOCK), F.ceil(F.col("n0") / BLOCK)
    member = member.withColumn("b1", b1).withColumn("b0", b0)
    own = F.when(F.col("linked"), F.col("b0") + F.pmod(F.xxhash64("rep"), F.greatest("b1", F.lit(1)))).otherwise(F.pmod(F.xxhash64("rep"), F.greatest("b0", F.lit(1))))
    member = member.withColumn("own", own).filter("b0 > 0")
    others = F.when(F.col("linked"), F.sequence(F.lit(0).cast("bigint"), F.col("b0") - 1)).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("b0") + F.col("b1") - 1))
    member = member.withColumn("other", F.explode(others))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    pieces = member.select(F.xxhash64("cluster", low, high).alias("piece"), side.alias("side"), "rep", "members")
    more = settle(pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(run, schema), "near-blocks")
    return out.unionByName(star.filter("linked AND a <> b").select("a", "b")).unionByName(more)


def near_duplicates(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash of every row of docs (doc_id, text); threshold is in percent."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    sketch = settle(hashed.mapInArrow(_sketch, "doc_id long, text_hash long, n long, h1 long, h2 long, sig binary"), "near-sketch")
    known = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    reps = known.groupBy("h1", "h2", "n").agg(F.min_by("sig", "doc_id").alias("sig"), F.min("doc_id").alias("doc"))
    reps = settle(reps.withColumn("rep", F.xxhash64("h1", "h2", "n")), "near-reps")
    clusters = components(forest_edges(reps.select("rep", "sig"), threshold))
    size = clusters.groupBy("root").agg(F.count("*").alias("m"))
    clusters = joined(joined(clusters, size, "root").selectExpr("node AS rep", "root AS cluster", "m"), reps.select("rep", "doc", "h1", "h2"), "rep")
    roots = components(exact_links(docs, settle(clusters, "near-clusters"), reps.select("rep", "sig"), threshold))
    linked = settle(joined(roots.selectExpr("node AS rep", "root"), reps.select("rep", "doc"), "rep"), "near-roots")
    linked = joined(linked, linked.groupBy("root").agg(F.min("doc").alias("component")), "root").select("rep", "component")
    reps = joined(reps, linked, "rep", "left").select("h1", "h2", "n", F.coalesce("component", "doc").alias("component"))
    out = joined(sketch.select("doc_id", "text_hash", "n", "h1", "h2"), reps, ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Column names that documents don't have.
HASH, KEEP = "__near_dedup_hash", "__near_dedup_keep"


def drop_near_duplicates(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """docs, all columns, with one row of each group. Rows are told apart by doc_id and text; of rows equal in both one
    stays. Rows without a shingle or a doc_id stay. Only rows that a filter takes for members of a group are shuffled."""
    found = near_duplicates(docs, threshold).filter("n_shingles > 0 AND doc_id IS NOT NULL")
    verdict = found.groupBy("doc_id", F.col("text_hash").alias(HASH)).agg(F.max("kept").alias(KEEP), F.count("*").alias("c"))
    marked = settle(verdict.filter(f"NOT {KEEP} OR c > 1").drop("c"), "near-marked")
    some, rest = split_likely(docs.withColumn(HASH, F.xxhash64("text")), "doc_id", bloom(marked, "doc_id"))
    some = some.join(marked, ["doc_id", HASH], "left")
    once = some.filter(F.col(KEEP).isNull())
    again = some.filter(KEEP).dropDuplicates(["doc_id", HASH])
    return rest.select(*docs.columns).unionByName(once.select(*docs.columns)).unionByName(again.select(*docs.columns))
