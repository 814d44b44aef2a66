"""Each operator against brute force, and on odd and empty tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corbel.llm import chat_format, decontaminate, html_text, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, queries, secrets, toxicity
from corbel.llm.common import bloom, hash_strings, keep_likely, split_words
from corbel.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ common


def test_split_words_is_the_contract():
    texts = ["a  b\n", None, "", "\x0bé\xa0x\x1cy z\x85", " \t"]
    flat, at = split_words(pa.array(texts))
    got = [flat[a:b].to_pylist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]


def test_hashes_tell_strings_apart():
    some = [f"{a}{b}" for a in "abcé" for b in ("", "a", "b" * 70, "b" * 71, "b" * 69 + "c")] + ["ab", "ba"]
    assert len(set(hash_strings(some).tolist())) == len(set(some)) and hash_strings(["q", "q"])[0] == hash_strings(["q"])[0]


def test_bloom_keeps_all(spark):
    ids = spark.range(0, 3000, 3)
    bits = bloom(ids, "id")
    got = {r[0] for r in keep_likely(spark.range(3000), "id", bits).collect()}
    assert set(range(0, 3000, 3)) <= got and len(got) < 1100


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == least
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 1 mixing


def _mix_model(leaves, weights, budget, epochs):
    """Water-filling by repetition over exact fractions, top down."""

    def fill(nodes, given):
        share, open_ = {}, {k for k, (w, c) in nodes.items() if w > 0}
        for k, (w, _) in nodes.items():
            if w == 0:
                share[k] = 0
        while True:
            left, total = given - sum(share.values()), sum(nodes[k][0] for k in open_)
            full = {k for k in open_ if nodes[k][1] * total <= left * nodes[k][0]}
            if not full:
                return share | {k: left * nodes[k][0] // total for k in open_}
            share |= {k: nodes[k][1] for k in full}
            open_ -= full
            if not open_:
                return share

    w = lambda level, name: weights.get(level, {}).get(name, 1)
    cap = lambda prefix: sum(t * epochs * all(w(x, y) > 0 for x, y in zip(mixing.LEVELS, k, strict=True)) for k, t in leaves.items() if k[: len(prefix)] == prefix)
    out, todo = {}, [((), min(budget, cap(())))]
    for depth, level in enumerate(mixing.LEVELS):
        nxt = []
        for prefix, given in todo:
            names = sorted({k[depth] for k in leaves if k[:depth] == prefix})
            for n, s in fill({n: (w(level, n), cap((*prefix, n))) for n in names}, given).items():
                nxt.append(((*prefix, n), s))
        todo = nxt
    for k, s in todo:
        out[k] = s
    return out


@pytest.mark.parametrize("budget", [0, 7, 100, 260, 10_000])
def test_mixing_shares_and_prefixes(spark, budget):
    rng = random.Random(budget)
    rows = [(i, " ".join(["w"] * rng.randint(0, 6)), rng.choice("xy"), rng.choice(["en", "de"]), rng.choice(["s", "t", None])) for i in range(60)]
    weights = {"domain": {"x": 3}, "lang": {"de": 2}, "source": {"t": 4, "": 0}}
    got = [tuple(r) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string"), weights, budget, 2).collect()]
    leaves, docs = collections.Counter(), {}
    for i, t, d, la, s in rows:
        if t:
            leaves[(d, la, s or "")] += len(t.split())
            docs[i] = ((d, la, s or ""), len(t.split()))
    want = _mix_model(leaves, weights, budget, 2)
    by = collections.defaultdict(lambda: collections.defaultdict(set))
    for i, d, la, s, n, e in got:
        assert docs[i] == ((d, la, s), n) and i not in by[(d, la, s)][e]
        by[(d, la, s)][e].add(i)
    for leaf, share in want.items():
        mine = {i for i, (k, _) in docs.items() if k == leaf}
        whole, rest = divmod(share, leaves[leaf])
        assert all(by[leaf][e] == mine for e in range(1, whole + 1))
        order = sorted(mine, key=lambda i: (hashlib.md5(f"11:{whole + 1}:{i}".encode()).hexdigest(), i))
        run = list(itertools.accumulate(docs[i][1] for i in order))
        assert by[leaf][whole + 1] == {i for i, r in zip(order, run, strict=True) if r <= rest}


def test_mixing_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    rows = [(i, "a b c", "d", "en", "s") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string"), {}, 70, 3).collect()
    order = sorted(range(50), key=lambda i: (hashlib.md5(f"11:1:{i}".encode()).hexdigest(), i))
    assert {r["doc_id"] for r in got} == set(order[:23])


def test_mixing_of_repeated_and_nameless_rows(spark, monkeypatch):
    """Repeated doc_ids with equal and with different texts, and null ones: each row counts, carried texts stay its own."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = [(i % 20 if i % 3 else None, " ".join(f"w{i // 2}" for _ in range(1 + i // 2 % 5)), "d", "en", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    total = sum(len(t.split()) for _, t, *_ in rows)
    copies = collections.Counter((i, t) for i, t, *_ in rows)
    for budget in (total // 3, total, total + total // 2, 5 * total):
        got = [(r["doc_id"], r["text"], r["epoch"]) for r in mixing.mix(df, {}, budget, 2, carry=("text",)).collect()]
        n = collections.Counter(got)
        assert all(c == copies[i, t] for (i, t, _), c in n.items())
        assert budget - 12 <= sum(len(t.split()) for _, t, _ in got) <= budget or budget > 2 * total and len(got) == 2 * len(rows)
        assert got and sorted(map(str, got)) == sorted(map(str, ((r["doc_id"], r["text"], r["epoch"]) for r in mixing.mix(df.repartition(3), {}, budget, 2, carry=("text",)).collect())))


# ------------------------------------------------------------------ 2 decontamination


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            row[j + 1], prev = (prev + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2)]
        assert decontaminate.common_length(a, b) == _lcs(a, b)


def test_leaks_and_paraphrases(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rng, items = random.Random(2), [(r["item_id"], r["text"]) for r in bench.collect()]
    body = [r["text"].split() for r in docs.limit(30).collect()]
    rows, want = [], set()
    for k, (item, text) in enumerate(items):
        words = [w.upper() if rng.random() < 0.2 else w for w in text.split() if rng.random() > 0.2]
        fill = rng.choice(body)
        at = rng.randint(0, len(fill))
        rows.append((10_000 + k, " ".join(fill[:at] + words + fill[at:])))
        want.add((10_000 + k, item))
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(more, bench).collect()}
    assert want <= got
    # Brute force over the original rows: an item's words in a row.
    norm = lambda t: decontaminate.words_of(t)
    texts = {r["doc_id"]: " ".join(norm(r["text"])) for r in docs.collect()}
    exact = {(i, j) for i, t in texts.items() for j, b in items if " ".join(norm(b)) in t}
    assert exact == {(i, j) for i, j in got if i < 10_000}
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == set(texts) - {i for i, _ in exact}
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench, items=17).collect()}
    assert blocks == exact


@pytest.mark.parametrize("lost", ["random", "rarest"])
def test_recall_against_the_exhaustive_search(spark, docs, lost):
    """Paraphrases that lose a third of their words, at random or the rarest ones, against every window and passage."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rng, items = random.Random(22), [(r["item_id"], r["text"]) for r in bench.collect()]
    df = collections.Counter(w for r in docs.collect() for w in set(decontaminate.words_of(r["text"])))
    body, rows = [r["text"].split() for r in docs.orderBy("doc_id").limit(30).collect()], []
    for k, (_, text) in enumerate(items):
        words = text.split()
        key = (lambda i: rng.random()) if lost == "random" else (lambda i, words=words: df["".join(decontaminate.words_of(words[i]))])
        gone = set(sorted(range(len(words)), key=key)[: len(words) // 3])
        fill = rng.choice(body)
        at = rng.randint(0, len(fill))
        rows.append((10_000 + k, " ".join([*fill[:at], *(w for i, w in enumerate(words) if i not in gone), *fill[at:]])))
    more = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs.select("doc_id", "text").unionByName(more), bench).collect() if r["doc_id"] >= 10_000}
    passages, want = next(decontaminate.blocks([(*r, None) for r in items], 1024, 256)), set()
    for i, t in rows:
        words = decontaminate.words_of(t)
        for start in range(0, max(1, len(words) - decontaminate.WINDOW + decontaminate.STRIDE), decontaminate.STRIDE):
            for item, p, answer in passages:
                if (i, item) not in want:
                    common, answered = decontaminate._confirm(words, start, p, answer)
                    if decontaminate.is_leak(common, len(p), answered):
                        want.add((i, item))
    assert got <= want and len(want) >= 0.9 * len(items) and len(got) >= 0.95 * len(want)
    print(lost, len(got), len(want), len(items))


def test_cosines_are_those_of_the_latent_space(spark, docs):
    """The folded product against plain projection of each window on the singular vectors."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    block = next(decontaminate.blocks(((r["item_id"], r["text"], None) for r in bench.collect()), 1024, 256))
    keys = decontaminate.vocabulary(block)
    idf = decontaminate.frequencies(docs, keys)
    space = decontaminate.latent_space(spark, block, keys, idf)
    rows = [decontaminate._tf_idf(np.searchsorted(keys, hash_strings(p)), idf) for _, p, _ in block]
    dense = np.zeros((len(rows), len(keys)))
    for i, (k, w) in enumerate(rows):
        dense[i, k] = w
    v = np.linalg.svd(dense, full_matrices=False)[2].T
    rng, ids = random.Random(4), np.array([random.Random(i).randrange(-1, len(keys)) for i in range(500)])
    start = np.array([rng.randrange(450) for _ in range(40)])
    end = start + np.array([rng.randrange(0, 50) for _ in range(40)])
    got = decontaminate.cosines(ids, start, end, space)
    for a, b, c in zip(start, end, got, strict=True):
        x = np.zeros(len(keys))
        for k, n in collections.Counter(i for i in ids[a:b].tolist() if i >= 0).items():
            x[k] = (1 + math.log(n)) * idf[k]
        p = dense @ v
        want = (p @ (x @ v)) / np.maximum(np.linalg.norm(p, axis=1) * max(np.linalg.norm(x), 1e-12), 1e-12)
        assert np.allclose(c, want, atol=1e-3)


def test_leaks_of_many_items(spark, docs):
    """Every exact copy is found however many items and passages there are."""
    rng = random.Random(5)
    words = [w for r in docs.orderBy("doc_id").limit(100).collect() for w in r["text"].split()]
    cut = lambda n: words[(s := rng.randrange(len(words) - n)) : s + n]
    items = [(k, " ".join(rng.sample(cut(90), 30 if k else 60))) for k in range(1000)]
    items.append((1000, " ".join(rng.choice(words) for _ in range(48 * 300))))  # one item of more passages than a block has
    copies = [(20_000 + k, " ".join([*cut(40), t, *cut(40)])) for k, t in items]
    found = decontaminate.leaks(spark.createDataFrame(copies, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert len({(20_000 + k, k) for k, _ in items} - got) == 0
    sizes = [len(b) for b in decontaminate.blocks([(*r, None) for r in items], decontaminate.ITEMS, decontaminate.RANK)]
    assert max(sizes) <= decontaminate.RANK and sum(sizes) > 1250


def test_singular_vectors(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 5)) @ rng.standard_normal((5, 40))
    rows = spark.createDataFrame([(list(range(40)), r.tolist()) for r in a], "ids array<int>, weights array<double>").repartition(3)
    v = decontaminate.singular_vectors(rows, 40, 10)
    assert v.shape == (40, 5) and np.allclose(a @ v @ v.T, a) and np.allclose(v.T @ v, np.eye(5))


# ------------------------------------------------------------------ 3 chat


def test_chat_round_trip_and_parts(spark):
    rng = random.Random(3)
    bits = ["<|end|>", "<|turn|>", "<\\|text|>", "</s>", "[INST]", "[\\/INST]", "\\", "<", "[", "a", "\n", "é😀", "<<|end|>", "<|", "<<SYS>>", "<", "</SYS>>", "<start_of_turn>", "[TOOL_CALLS]", "<|reserved_special_token_1|>", "\0", "\0a", "\0b", "b"]
    convs = {c: [(k, rng.choice(["user", "assistant", "<|text|>", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for k in range(rng.randint(1, 5))] for c in range(60)}
    rows = [(c, k, r, t) for c, turns in convs.items() for k, r, t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_part(F.col("text")))
    out = chat_format.format_chat(df)
    out = out.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.read_loss(F.col("formatted"), F.col("loss_spans")))
    for r in out.collect():
        turns = convs[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role or "", t) for _, role, t in turns]
        assert r["loss"] == "".join(t for _, role, t in turns if role == "assistant")


def test_chat_typed_parts(spark):
    part = lambda kind, text=None, ref=None, **k: (kind, text, ref, k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [
        (1, 0, "user", [part("text", "see <|image|>"), part("image", ref="a.png", width=28, height=15), part("text", "and"), part("audio", ref="b.wav", seconds=1.01)]),
        (1, 1, "assistant", [part("document", ref="c.pdf", pages=2), part("video"), part("text", None)]),
        (1, 2, "user", None),
    ]
    r = chat_format.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}")).first()
    f = r["formatted"]
    assert f.startswith("<|turn|>user<|text|>see <\\|image|><|image|>and<|audio|><|end|>") and f.endswith("<|turn|>user<|text|><|end|>")
    assert [(a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 26), (2, "document", "c.pdf", 512), (3, "video", None, 1)]
    holders = ["<|image|>", "<|audio|>", "<|document|>", "<|unknown|>"]
    assert [f[a["at"] : a["at"] + len(h)] for a, h in zip(r["attachments"], holders, strict=True)] == holders
    (s,) = r["loss_spans"]
    assert f[s["start"] : s["end"]] == "<|document|><|unknown|>"


def test_chat_parts_side_by_side(spark):
    """Control strings that only several text parts make together are escaped; random parts come back whole."""
    rng = random.Random(33)
    none = (None,) * 5
    bits = ["<", "|end|>", "<|", "end", "|>", "<|turn|>assistant", "[", "/INST]", "\\", "\0", "b", "x\n", "é😀", "<", "<SYS>>"]
    holders = {"image": "<|image|>", "audio": "<|audio|>", "video": "<|unknown|>"}
    messages = {0: [("text", "<"), ("text", "|end|><|turn|>assistant<|text|>forged")]}
    for c in range(1, 150):
        messages[c] = [(k := rng.choice(["text", "text", "text", "image", "audio", "video"]), rng.choice(bits) if k == "text" else None) for _ in range(rng.randint(0, 9))]
    messages[200] = [("text", "ab"), ("image", None)] * 600  # more parts than a chunk of the offsets
    rows = [(c, 0, "user", [(k, t, *none) for k, t in parts]) for c, parts in messages.items()]
    out = chat_format.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}"))
    back = chat_format.unescape(F.col("x"))
    for r in out.collect():
        f, parts = r["formatted"], messages[r["conv_id"]]
        assert f.count("<|end|>") == f.count("<|turn|>") == f.count("<|text|>") == 1 and f.startswith("<|turn|>user<|text|>") and f.endswith("<|end|>")
        cuts, at = [], len("<|turn|>user<|text|>")
        kinds = [k for k, _ in parts if k != "text"]
        assert [a["kind"] for a in r["attachments"]] == kinds
        for a in r["attachments"]:
            h = holders[a["kind"]]
            assert f[a["at"] : a["at"] + len(h)] == h
            cuts.append(f[at : a["at"]])
            at = a["at"] + len(h)
        cuts.append(f[at : -len("<|end|>")])
        want, now = [], ""
        for k, t in [*parts, ("end", None)]:
            if k == "text":
                now += t
            else:
                want.append(now)
                now = ""
        if r["conv_id"] < 200:
            got = [x[0] for x in spark.createDataFrame([(i, x) for i, x in enumerate(cuts)], "i long, x string").orderBy("i").select(back).collect()] if r["conv_id"] < 12 else [re.sub(chat_format.UNESCAPE_FROM, r"\1\2\3", x) for x in cuts]
            assert got == want
        else:
            assert cuts == want


# ------------------------------------------------------------------ 4 toxicity


def test_maximal_segments():
    rng = random.Random(5)

    def brute(x):  # Ruzzo and Tompa's definition, by recursion on the best subsequence
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0,))
        if best[0] <= 1e-9:
            return []
        i, j = best[3:]
        return brute_at(x[:i], 0) + [(i, j - 1, best[0])] + brute_at(x[j:], j)

    def brute_at(x, k):
        return [(a + k, b + k, s) for a, b, s in brute(x)]

    for _ in range(300):
        x = [rng.choice([-0.5, -0.5, -0.5, 1.0, 2.3]) for _ in range(rng.randint(0, 14))]
        at = [i for i, v in enumerate(x) if v > 0]
        got = toxicity.maximal_segments(at, [x[i] for i in at], 0.5)
        assert [round(s, 6) for *_, s in got] == [round(s, 6) for *_, s in brute(x)]


@pytest.mark.parametrize("gap", [0.0, 3.0, 50.0])
@pytest.mark.parametrize("share", [0.02, 0.1, 0.5])
def test_logistic_stays_put(gap, share):
    """Also where the classes part: rows without evidence stay low, rows with much stay high."""
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < share).astype(float)
    x = y * (gap + rng.random(4000) * 5)
    a, b = toxicity._logistic(x, y)
    assert abs(a) < 50 and 0 < b < 50
    if gap:
        assert 1 / (1 + math.exp(-a)) < 0.5 < 1 / (1 + math.exp(-a - b * (gap + 5)))


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.QUERIES["op4_toxicity"](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n.get((0, 1), 0) / n[0, 0] < 0.01


def test_toxicity_weights_by_plain_code(spark):
    """Every word's weight from its log-odds under the Dirichlet prior, and the result's independence of the rows' order."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels, F.lit(True))
    again = toxicity.fit(docs.repartition(7, "n_chars"), labels.orderBy(F.desc("doc_id")), F.lit(True))
    for x, y in zip(vars(m).values(), vars(again).values(), strict=True):
        assert np.allclose(x, y)
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    sample = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 1000).mapInArrow(toxicity._sketch, "doc_id long, toxic int, k1 long, k2 long, k3 long").collect()
    rows = sample
    for k in ("k1", "k2", "k3"):  # of near copies the least doc_id counts
        least = {}
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            least.setdefault((r[k], r["toxic"]), r)
        rows = list(least.values())
    ids = {r["doc_id"] for r in rows}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    form = lambda w: w.lower().strip(toxicity.OUTER)
    n = [collections.Counter(w for i in ids if toxic[i] == y for w in {form(x) for x in WORD.findall(text[i])} if w) for y in (0, 1)]
    size = [sum(toxic[i] == y for i in ids) for y in (0, 1)]
    got = dict(zip(m.word_keys.tolist(), m.word_weights.tolist(), strict=True))
    want = {}
    for w in n[1]:
        both = n[0][w] + n[1][w]
        has, lacks = toxicity.PRIOR * both + toxicity.SMOOTH, toxicity.PRIOR * (sum(size) - both) + toxicity.SMOOTH
        odds = [math.log((c[w] + has) / (s - c[w] + lacks)) for c, s in zip(n, size, strict=True)]
        error = math.sqrt(sum(1 / (c[w] + has) for c in n))
        if odds[1] - odds[0] >= toxicity.Z * error and odds[1] - odds[0] - error > toxicity.MARGIN:
            want[int(toxicity.hash_array(pa.array([w]), 1)[0])] = odds[1] - odds[0] - error - toxicity.MARGIN
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(v) for k, v in want.items()) and len(want) > 3


def test_toxicity_of_clashing_labels_and_much_evidence(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    clash = labels.unionByName(labels.withColumn("toxic", F.lit(0))).unionByName(labels.withColumn("toxic", F.lit(None).cast(labels.schema["toxic"].dataType)))
    m, same = toxicity.fit(docs, labels, F.lit(True)), toxicity.fit(docs, clash, F.lit(True))
    assert np.allclose(m.word_weights, same.word_weights) and m.bias == pytest.approx(same.bias)
    worst = [r["text"] for r in toxicity.score(docs, m).join(docs, "doc_id").orderBy(F.desc("evidence")).limit(1).collect()][0]
    more = spark.createDataFrame([(k, " ".join([worst] * k)) for k in (1, 5, 40)], "doc_id long, text string")
    got = [r["evidence"] for r in toxicity.score(more, m).orderBy("doc_id").collect()]
    assert got[0] < got[1] < got[2] and got[2] > 50


def test_toxicity_without_labels(spark, docs, labels):
    out = toxicity.toxicity(docs, labels.limit(0), F.lit(True)).agg(F.min("score"), F.max("score"), F.count("*")).first()
    assert out[0] == out[1] < 0.7 and out[2] == 200


# ------------------------------------------------------------------ 5 quality classifier


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = queries.QUERIES["op5_quality_classifier"](spark, d)
    got = out.filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert out.count() == 1000 and got.filter("quality = predicted").count() / got.count() > 0.97


@pytest.mark.parametrize("digits", [None, 3])
def test_discriminant_by_plain_code(spark, docs, labels, digits):
    """Densities with plain covariances, inverses and determinants."""
    stats = quality_classifier.document_statistics(docs)
    clash = labels.unionByName(labels.filter("doc_id % 5 = 0").withColumn("quality", F.lit(0).cast(labels.schema["quality"].dataType)))
    m = quality_classifier.fit(stats, clash, F.lit(True), digits=digits)
    y = {}
    for r in clash.collect():
        if r["quality"] is not None:
            y[r["doc_id"]] = min(r["quality"], y.get(r["doc_id"], 1))
    rows = {r["doc_id"]: np.array([r[c] for c in quality_classifier.NAMES]) for r in stats.collect()}
    xs = [[rows[i] for i in rows if y.get(i) == k] for k in (0, 1)]
    seen = [len(x) for x in xs]
    if digits is not None:
        groups = [collections.defaultdict(list) for _ in xs]
        for g, x in zip(groups, xs, strict=True):
            for v in x:
                g[tuple(np.floor(v * 10**digits + 0.5))].append(v)
        xs = [[np.mean(v, axis=0) for v in g.values()] for g in groups]
    xs = [np.array(x) for x in xs]
    covs, d = [np.cov(x.T, bias=True) for x in xs], len(quality_classifier.NAMES)
    pooled = np.diag(sum(len(x) * np.diag(c) for x, c in zip(xs, covs, strict=True)) / sum(map(len, xs)))
    every, dens = np.array(list(rows.values())), []
    for x, c in zip(xs, covs, strict=True):
        a = quality_classifier.SHRINK + (1 - quality_classifier.SHRINK) * d / (d + len(x))
        s = (1 - a) * c + a * pooled + quality_classifier.RIDGE * np.eye(d)
        off = every - x.mean(axis=0)
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(s), off) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(m.log_odds(every), dens[1] - dens[0] + math.log(seen[1] / seen[0]), atol=1e-5, rtol=1e-5)


def test_quality_statistics_match_plain_code():
    texts = ["A b b b!\n#c. 12 |", "", None, "x y z x y z", "é É"]
    x = quality_classifier.statistics(pa.array(texts))
    for t, row in zip(texts, x, strict=True):
        w = WORD.findall(t or "")
        assert row[0] == pytest.approx(math.log1p(len(w)))
        assert row[9] == pytest.approx(math.log((sum(a == b for a, b in itertools.pairwise(w)) + 0.5) / (len(w) + 10)))
        tri = list(zip(w, w[1:], w[2:]))
        assert row[11] == pytest.approx(math.log((len(tri) - len(set(tri)) + 0.5) / (len(w) + 10)))
        assert row[4] == pytest.approx(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t or "") / (sum(c.isascii() and c.isalpha() for c in t or "") + 10))


# ------------------------------------------------------------------ 6 quality rules


def test_rule_metrics(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b", "cc", "#", " ", " ", "\n", "\t", "é!"]) for _ in range(rng.randint(0, 120))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.base_metrics(df).collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        rep = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(w), len(rep), sum(map(len, w)))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w))


def test_cascade_order_changes_no_verdict(spark, docs, monkeypatch):
    want = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    order = quality_rules.cascade_order(docs)
    assert [x[1] / x[2] for x in order] == sorted((x[1] / x[2] for x in order), reverse=True)
    monkeypatch.setattr(quality_rules, "cascade_order", lambda *a, **k: order[::-1])
    assert {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()} == want


# ------------------------------------------------------------------ 7 near-dedup


def _brute_components(rows, percent=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates(spark, monkeypatch, small):
    if small:  # all paths for large regions and clusters
        monkeypatch.setattr(near_dedup, "REGION", 6)
        monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 40, 150]))]
        for _ in range(rng.choice([1, 4, 40])):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            rows.append((len(rows) * 3 % 1009, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE  two"), (5005, "two one")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in _brute_components(rows).items()}


def test_near_duplicates_of_repeated_ids(spark):
    """One doc_id with several texts: each row is classed by its own text."""
    text = lambda k, n: " ".join(f"t{k}w{i}" for i in range(n))
    rows = [(1, text(1, 50)), (1, text(2, 50)), (1, text(1, 50)), (2, text(1, 50) + " more"), (3, text(2, 50) + " x"), (4, text(2, 50) + " x"), (5, text(3, 9))]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, 46, 1): 3, (2, 47, 1): 1, (3, 47, 1): 1, (4, 47, 1): 1, (5, 5, 5): 1}


@pytest.mark.parametrize("region", [8, 32])
def test_pairs_inside_a_large_family(spark, monkeypatch, region):
    """Texts of one template, half of their words equal, each with one partner just above the threshold: regions far
    larger than REGION at the first levels."""
    monkeypatch.setattr(near_dedup, "REGION", region)
    rng = random.Random(region)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    template, rows = [word() for _ in range(200)], []
    for k in range(400):
        own = [word() for _ in range(200)]
        other = list(own)
        for i in (30, 90, 150):
            other[i] = word()
        rows += [(2 * k, " ".join(template + own)), (2 * k + 1, " ".join(template + other))]
    pairs = _brute_components(rows[:60])
    assert {c for _, c in pairs.values()} == set(range(0, 60, 2))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(400)) >= 399


def test_regions_are_runs_of_common_prefixes():
    """Sorted rows in several batches, against grouping by the first values of each tree's order."""
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 2, (60, near_dedup.SIGNATURE)).astype(np.uint16)
    for level, (depth, trees) in enumerate(near_dedup.LEVELS[:2]):
        orders = near_dedup._orders(level)
        assert len(orders) == trees and all(sorted(o) == list(range(near_dedup.SIGNATURE)) for o in orders.tolist())
        rep, tree = np.tile(np.arange(60), trees), np.repeat(np.arange(trees, dtype=np.int32), 60)
        batch = pa.RecordBatch.from_arrays([pa.array(rep), pa.array(tree), pa.array([sig[i].tobytes() for i in rep], pa.binary())], ["rep", "tree", "sig"])
        (out,) = near_dedup._in_order(level)([batch])
        rows = sorted(out.to_pylist(), key=lambda r: r["sorted"])
        assert [r["range"] for r in rows] == sorted(r["range"] for r in rows) and 0 <= rows[0]["range"] <= rows[-1]["range"] < near_dedup.RANGES
        batches = pa.RecordBatch.from_pylist(rows, out.schema)
        got = sorted(sorted(r.tolist()) for r, s in near_dedup.regions_of([batches.slice(k, 97) for k in range(0, len(rows), 97)], depth) if (s.sum(axis=1) >= 0).all())
        want = collections.defaultdict(list)
        for t, i in itertools.product(range(trees), range(60)):
            want[t, *sig[i][orders[t][:depth]].tolist()].append(i)
        assert got == sorted(want.values())


# ------------------------------------------------------------------ 8 secrets


def test_base_spans_by_brute_force():
    rng = random.Random(8)
    bits = ["password", "Token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "deadbeef", "AKIA", "ABCD1234", "x", "0", "\n", "é", "-", "/"]
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        want = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 8]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert secrets.base_spans(t) == want
        assert not want or re.search(secrets.ANY, t)


def test_guess_costs():
    weak = ["password", "password123", "qwerty123", "2020-01-02", "aaaaaaaaaa", "abcabcabc", "P@ssw0rd", "12345678", "placeholder", "liverpool", "jennifer", "michael1", "monkeymonkey"]
    strong = ["Xk9#pQ!2zLw", "tr0ub4dor&3", "zkqvxjwhgyfp", "9f8e7d6c5b4a"]
    assert max(map(secrets.guess_cost, weak)) < secrets.GUESS_LIMIT < min(map(secrets.guess_cost, strong))


def _plain_cost(v, words):
    """The least cost over all segmentations into spans of the documented kinds, each judged by itself."""
    low, n = v.lower(), len(v)
    grow = lambda ok, i, j: all(ok(k) for k in range(i + 1, j))

    def edge(ok, i, j):  # a part of a maximal run from its start or to its end
        return grow(ok, i, j) and (i == 0 or not ok(i) or j == n or not ok(j))

    def cost(i, j):
        s, out = low[i:j], [sum(map(secrets._alphabet, v[i:j]))]
        if s in words.rank:
            out.append(math.log10(words.rank[s] + 1) + (secrets.PLACE if v[i:j] != s else 0))
        if s.translate(secrets.LEET) in words.rank:
            out.append(math.log10(words.rank[s.translate(secrets.LEET)] + 1) + 2 * secrets.PLACE)
        m = secrets.DATE.match(v, i)
        if m and m.end() == j:
            out.append(math.log10(36525 if j - i > 4 else 120))
        if j - i >= 3 and edge(lambda k: low[k] == low[k - 1], i, j):
            out.append(secrets._alphabet(next(v[k] for k in range(i, -1, -1) if k == 0 or low[k - 1] != low[k])) + math.log10(j - i))
        if j - i >= 3 and edge(lambda k: (low[k - 1], low[k]) in secrets.NEXT, i, j):
            out.append(secrets.WALK + math.log10(j - i))
        for w in range(2, secrets.BLOCK + 1):
            if (j - i) % w == 0 and j - i >= 2 * w and s == s[:w] * ((j - i) // w) and (i == 0 or low[i - 1] != low[i + w - 1]):
                out.append(_plain_cost(v[i : i + w], words) + math.log10((j - i) // w))
        return min(out)

    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        best[j] = min(best[i] + cost(i, j) + (secrets.PLACE if i else 0) for i in range(j))
    return best[n]


def test_guess_costs_by_plain_code():
    rng = random.Random(12)
    words = secrets.Words.of(["thered", "onstly", "ab"])
    bits = ["password", "Monkey", "l0ve", "2020-01-02", "1999", "aaaa", "AAa", "qwer", "asd", "xyzxyz", "q", "Z", "7", "#", "thered", "hered", "bababa", "İ"]
    for _ in range(250):
        v = "".join(rng.choice(bits) for _ in range(rng.randint(1, 6)))
        if len(v.lower()) == len(v):
            want = _plain_cost(v, words)
            assert secrets.guess_cost(v, words) == pytest.approx(want), v
            for limit in (3.0, secrets.GUESS_LIMIT, 20.0):
                assert secrets.guess_cost(v, words, limit) == pytest.approx(min(want, limit)), v
        assert secrets.guess_cost(v, words) >= 0


def test_long_values_are_scored_whole():
    """No length at which a value is cut: long repeats, walks and words stay weak, long random values strong."""
    for n in (24, 25, 127, 128, 129, 1000, 100_000):
        assert secrets.guess_cost("a" * n) == pytest.approx(math.log10(26) + math.log10(n))
        assert n > 1000 or secrets.guess_cost("zq8!" * n) < 5.5 + math.log10(n)
    assert secrets.guess_cost("qwertyuiop" * 40) < 6
    rng = random.Random(1)
    v = "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(500))
    assert secrets.guess_cost(v) > 200 and secrets.guess_cost(v, limit=8.0) == 8.0


def test_planted_credentials():
    """Values made at random against values that people choose, in a context: recall and precision of the guess spans."""
    rng = random.Random(88)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    strong = ["".join(rng.choice(alphabet) for _ in range(rng.randint(10, 40))) for _ in range(500)]
    pick = lambda: rng.choice(secrets.WORDS)
    makers = [
        lambda: pick() + str(rng.randint(1, 999)), lambda: pick().capitalize() + pick(), lambda: pick() + str(rng.randint(1960, 2024)), lambda: rng.choice("abcxyz019") * rng.randint(6, 30),
        lambda: "qwertyuiop"[: rng.randint(6, 10)] + str(rng.randint(1, 99)), lambda: f"{rng.randint(1950, 2024)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: pick() * 3,
    ]
    weak = [v for v in (rng.choice(makers)() for _ in range(500)) if len(v) >= 6]
    found = lambda v: [s for s in secrets.spans_of(f"passphrase: {v} end") if s[0] == "guess"]
    hit, wrong = sum(bool(found(v)) for v in strong), sum(bool(found(v)) for v in weak)
    print(hit, len(strong), wrong, len(weak))
    assert hit == len(strong) and hit / (hit + wrong) >= 0.98


def test_dictionary_of_the_texts(spark):
    """Frequent words of the texts are cheap, values of credentials never become words."""
    rows = [(i, f"the quibblefrost stood. password: zkqvxjwhgyfp and passphrase: vexmoorland {'rarelyseen' if i == 3 else ''}") for i in range(50)]
    df = spark.createDataFrame([*rows, (60, "secret = quibblefrost"), (61, None), (62, "pwd: quibblefrost1 db://x:quibblefrost@h")], "doc_id long, text string")
    words = secrets.dictionary(df, 100)
    assert "quibblefrost" in words.rank and not {"zkqvxjwhgyfp", "vexmoorland", "rarelyseen"} & set(words.rank)
    got = {r["doc_id"]: [tuple(s) for s in r["found"]] for r in secrets.find_secrets(df).collect()}
    assert [k for k, *_ in got[0]] == ["assign", "guess"] and [k for k, *_ in got[60]] == ["assign"] and got[62] == []
    assert len(secrets.find_secrets(df, most=0).filter("doc_id = 62").first()["found"]) == 2
    assert len(secrets.dictionary(df, 2).rank) <= len(secrets.WORDS) + 2


@pytest.mark.parametrize("n", [1, 8, 9, 500])
def test_any_number_of_spaces(n):
    t = f"pwd:{' ' * n}Xk9#pQ!2zLw and passphrase{' ' * n}is{' ' * n}Xk9#pQ!2zLw"
    assert [t[a:b] for _, a, b in secrets.spans_of(t)] == ["Xk9#pQ!2zLw"] * 2


def test_guess_spans_add_only():
    t = "the password is hunter22!x and passphrase: correct-horse9 but password: password1 token = 'abcdefgh1234' db://u:S3cr%tPw@h/ the secret is safe"
    got = secrets.spans_of(t)
    assert [s for s in got if s[0] != "guess"] == sorted(secrets.base_spans(t), key=lambda s: s[1])
    assert [t[a:b] for k, a, b in got if k == "guess"] == ["hunter22!x", "correct-horse9", "S3cr%tPw"]


@pytest.mark.parametrize("n", [12, 64, 65, 100, 1000, 100_000])
def test_long_passwords_in_addresses(spark, n):
    rng = random.Random(n)
    user, value = ["".join(rng.choice("ghjkmpqrXYZ789") for _ in range(k)) for k in (max(1, n // 2), n)]
    t = f"see db://{user}:{value}@host/x and db://u:{value}/x"
    at = t.index(value)
    found = secrets.find_secrets(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()["found"]
    assert [tuple(s) for s in found] == [("guess", at, at + n)]


def test_values_of_base_matches_are_scored(spark):
    """Every credential value of the table has a cost, by patterns and costs of plain code; base spans stay as they are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    planted = [(-1, "password: password1"), (-2, "api_key='zk8Qv9xJw2hG'"), (-3, "mytoken=abcabcabcabc and pwd: 2020-01-02, end"), (-4, None), (-5, "")]
    rows = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    words = secrets.PLAIN
    value = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.I | re.A)
    got = {r["doc_id"]: r for r in secrets.find_secrets(rows, most=0).collect()}
    seen = 0
    for doc, text in rows.collect():
        scored = {(s["start"], s["end"]): s["cost"] for s in got[doc]["scored"]}
        for m in value.finditer(text or ""):
            seen += 1
            want = min(_plain_cost(m[1], words), secrets.COST_SHOWN) if len(m[1]) <= 60 else secrets.COST_SHOWN
            assert scored[m.span(1)] == pytest.approx(want)
        assert [tuple(s) for s in got[doc]["found"] if s["kind"] != "guess"] == secrets._order(secrets.base_spans(text or ""))
    cost = lambda doc: [s["cost"] for s in got[doc]["scored"]]
    assert seen >= 3 and cost(-1)[0] < secrets.GUESS_LIMIT < cost(-2)[0] and len(cost(-3)) == 2 and max(cost(-3)) < secrets.GUESS_LIMIT
    assert cost(-4) == cost(-5) == []


def test_weak_and_strong_values_of_other_words():
    """People's values from words that the fixed list lacks: they are weak once the texts' words are in the dictionary."""
    rng = random.Random(4)
    own = ["manchester", "alexander", "trustno", "harvest", "orchard", "window", "guitar", "bridge", "copper", "falcon", "garden", "island"]
    assert not set(own) & set(secrets.WORDS)
    words = secrets.Words.of(own)
    for _ in range(200):
        v = rng.choice([lambda: rng.choice(own) + str(rng.randint(1, 99)), lambda: rng.choice(own).capitalize() + rng.choice(own), lambda: rng.choice(own) + str(rng.randint(1960, 2024))])()
        (_, _, cost), = secrets.scored_values(f"token: {v}", words)
        assert cost < secrets.GUESS_LIMIT
        strong = "".join(rng.choice("bcdfghjkmnpqrtvwxyz23456789") for _ in range(14))
        (_, _, cost), = secrets.scored_values(f"token: {strong}", words)
        assert cost >= secrets.GUESS_LIMIT


def test_texts_with_a_value_pass_the_gate():
    rng = random.Random(6)
    bits = ["password", "Secrets", "is ", " is  ", ":", "=", "://", "u:", "@h", "Xk9pQ2zLwv", "\"", " ", "api_key", "pwd", "a", "AKIA", "client-secret", "\n"]
    hits = 0
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(2, 9)))
        if secrets.scored_values(t):
            hits += 1
            assert re.search(secrets.ANY, t), t
    assert hits > 500


# ------------------------------------------------------------------ 9 html


def test_pages_of_the_table(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        inner = re.sub("<[^>]+>", "", re.sub("</?(?:p|h1|br)[^>]*>", " ", inner))
        assert html_text.main_text(r["html"]) == " ".join(html.unescape(inner).split())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<!-- x", ""), ("<script>a", ""), ("plain < text > ok", "plain < text > ok"), ("<p>a&amp;b<br>c&nbsp; d</p>", "a&b c d"),
        ("<header>H</header><main><header><h1>T</h1></header><p>a<b>b</b>c</p><form>q</form><div class='ad'>z</div>tail</main><footer>f</footer>", "T abc tail"),
        ("<div class=menu><a>x</a></div><p>Long text that stands here</p><p>more<aside>no</aside></p><div id='comments'><p>bad words of readers</p></div>", "Long text that stands here more"),
        ("<nav><ul><li>a<li>b</ul></nav><article><p>one<p>two<table><tr><td>x<td>y</table><div hidden>no</div></article><div role=contentinfo>z</div>", "one two x y"),
        ("<article><p>yes</p><section class='reader-comments'><article><p>a very long comment of someone</p></article></section></article>", "yes"),
        ("<p title=\"a>b\">x</p></div></p><p>y", "x y"),
        ("<table><tr><td><a href=/>Home</a> <a href=/n>News</a></td><td><p>Some long text with <a href=/x>a link</a> in it.</p></td></tr></table>", "Some long text with a link in it."),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>{0}</p><div class=ad><p>Buy</p><p>this</p><p>now</p></div><p>{1}</p>", "{0} {1}"),
        ("<p>{0}</p><ul class=menu><li>a<li>b<li>c<li>d</ul><div class=ad>z</div><aside><p>x</p><p>y</p></aside><p>{1}</p>", "{0} {1}"),
        ("<p>{0}</p><nav>n</nav><nav>o</nav><nav>p</nav><p>Home</p><nav>q</nav><nav>r</nav><nav>s</nav><p>{1}</p>", "{0} {1}"),
        ("<p>Top</p><article><p>{0}</p></article><p>Between</p><article><h2>T</h2><p>{1}</p></article><article><p>Short.</p></article><p>End</p>", "{0} T {1} Short."),
        ("<article><p>Teaser</p></article><p>{0}</p><div class=ad><p>a</p></div><p>{1}</p>", "Teaser {0} {1}"),
        ("<main><p>{0}</p><div class=ad><p>a</p><p>b</p><p>c</p></div><p>{1}</p></main><p>{1}</p>", "{0} {1}"),
    ],
)
def test_pages_of_several_regions(page, text):
    parts = "The first part has a good many words in its only line.", "The second part has hardly fewer words in its own line."
    assert html_text.main_text(page.format(*parts)) == text.format(*parts)


TEXT = "This sentence of the main text has enough words to be long, as the sentences of articles are. "


@pytest.mark.parametrize("tag", ["p", "div", "li"])
@pytest.mark.parametrize("n", [4, 20, 300])
def test_boilerplate_without_names_goes(tag, n):
    """Blocks that nothing but their length tells from the text, before it and after it; advert blocks inside it."""
    chrome = "".join(f"<{tag}>Part {k}</{tag}>" for k in range(n))
    body = [TEXT * (1 + k % 4) for k in range(9)]
    page = "<h1>Title</h1>" + "".join(f"<p>{b}</p>" + "<div class=ad><p>Buy</p><p>now</p></div>" * (k % 3 == 2) for k, b in enumerate(body)) + "<p>End.</p>"
    assert html_text.main_text(f"<body>{chrome}{page}{chrome}</body>") == " ".join(["Title", *(b.strip() for b in body), "End."])[: -len(" End.")]
    assert html_text.main_text(f"<body><div>{chrome}</div><div>{page}</div><div>{chrome}</div></body>") == " ".join(["Title", *(b.strip() for b in body), "End."])


@pytest.mark.parametrize("name", ["social history", "related work", "search results", "share", "top"])
def test_loose_names_dont_empty_an_article(name):
    assert html_text.main_text(f"<article><h1>T</h1><div class='{name}'><p>{TEXT * 3}</p></div></article>") == f"T {(TEXT * 3).strip()}"
    assert html_text.main_text(f"<article><p>{TEXT * 3}</p><div class='share'><p>Send it</p></div></article>") == (TEXT * 3).strip()
    assert html_text.main_text(f"<div class='comment-page'><p>{TEXT}</p></div>") == TEXT.strip()


def test_pages_without_their_article_element(spark):
    """The distribution alone finds what the article element encloses."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert html_text.main_text(r["html"].replace("<article>", "").replace("</article>", "")) == html_text.main_text(r["html"])


def test_window_sums_and_threshold():
    rng = random.Random(9)
    for _ in range(50):
        size = [rng.choice([0, 0, 5, 300]) for _ in range(rng.randint(0, 12))]
        want = [sum(size[max(0, i - 2) : i + 1]) for i in range(len(size) + 2)]
        assert html_text.window_sums(size) == want
    assert html_text.threshold([30, 30, 28]) == 1.0 and 10 < html_text.threshold([10, 12, 9, 200, 220]) < 200 and html_text.threshold([400, 9000, 20000]) == 300


@pytest.mark.parametrize("part", ["<a ", "<b>", "</i>", "<a b=\"", "<!", "<p class='a'>", "< ", "<div>", "<a b=", "<table><td>", "&amp", "<a x='"])
def test_hostile_pages_take_linear_time(part):
    import time

    def took(n):
        page, t = "<b>" * (n // 8) + part * (n // len(part)) + "<p>x" * (n // 16), time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - t

    took(10_000)
    assert took(1_000_000) < 12 * took(200_000) + 0.5


@pytest.mark.parametrize("quote", ["'", '"'])
def test_pages_with_long_attributes(quote):
    other = "'" if quote == '"' else '"'
    value = quote + f"<b class={other}ad{other}>x</b> {{}} > " * 5000 + quote
    assert len(value) > 100_000
    gone = f"<div data-x={value} class=sidebar>menu</div><nav data-x={value}>n</nav><form data-x={value}>f</form><script data-x={value}>var s</script>"
    assert html_text.main_text(f"{gone}<article data-x={value}><p data-x={value}>The text</p><p>goes on</p></article>") == "The text goes on"


SIX = "".join(f"<p>P{k} {TEXT}</p>" for k in range(6))


def _paragraphs(page):
    text = html_text.main_text(page)
    return sum(f"P{k} " in text for k in range(6))


@pytest.mark.parametrize(
    "name",
    ["content has-sidebar", "with-sidebar", "no-sidebar", "no-comments", "post-with-ads", "nav-content", "page-footer-fixed", "menu-open", "modal-open", "hasSidebar"],
)
def test_names_of_layout_and_state_dont_empty_an_article(name):
    for inner in (SIX, f"<article>{SIX}</article>", f"<main><div>{SIX}</div></main>"):
        assert _paragraphs(f"<body><div class='{name}'>{inner}</div><p>{TEXT}</p></body>") == 6
        assert _paragraphs(f"<body id='x'><div id='{name}'>{inner}<div class='ad'>Buy</div></div><p>{TEXT}</p></body>") == 6


def test_forms_around_the_page_and_forms_in_it():
    assert _paragraphs(f"<form id=aspnetForm>{SIX}</form>") == _paragraphs(f"<form><fieldset>{SIX}</fieldset></form>") == 6
    assert _paragraphs(f"<form id=aspnetForm><article>{SIX}</article></form><p>{TEXT}</p>") == 6
    for page in (f"<article>{SIX}</article><form>{{}}</form>", f"<div>{SIX}<form>{{}}</form></div>", f"<article>{SIX}<fieldset>{{}}</fieldset></article>"):
        got = html_text.main_text(page.format(f"<label>Name</label><p>Sign up here. {TEXT}</p>"))
        assert "Sign up" not in got and "Name" not in got and "P5" in got


@pytest.mark.parametrize("raw", ['<svg class="i"/>', '<iframe src="x"/>', "<iframe src=x>", "<svg>", "<object>", "<textarea>", "<noscript>", "<math/>"])
def test_raw_elements_without_end_are_empty(raw):
    page = SIX.replace("</p>", "</p>" + raw, 1)
    assert _paragraphs(page) == _paragraphs(f"<article>{page}</article>") == _paragraphs(page.replace("</p>", "</p>" + raw)) == 6
    tag = re.match("<([a-z]+)", raw)[1]
    assert html_text.main_text(f"<article>{SIX}<{tag}>gone</{tag}></article>") == html_text.main_text(f"<article>{SIX}</article>")


def test_links_that_are_sentences_and_an_open_head():
    assert _paragraphs(SIX.replace("<p>", "<p><a href=/>").replace("</p>", "</a></p>")) == 6
    assert "Latest" not in html_text.main_text(SIX + "<ul><li><a href=/>Latest news of the town</a><li><a href=/>Latest sports</a></ul>")
    assert _paragraphs(f"<html><head><title>x</title><meta charset=utf-8><body>{SIX}") == 6


@pytest.mark.parametrize("name", ["discussion", "user-reviews", "userComments", "taboola", "ad-container", "comment-content", "cookie notice", "sidebar-left"])
def test_adverts_and_readers_words_go(name):
    bad = f"<div class='{name}'><p>BAD {TEXT * 2}</p><p>BAD {TEXT}</p></div>"
    for page in (f"<article>{SIX}{bad}</article>", f"<article>{SIX}</article>{bad}", f"<div class='page-content'>{SIX}{bad}</div>", f"<div>{SIX}</div>{bad}"):
        assert "BAD" not in html_text.main_text(page) and _paragraphs(page) == 6
    assert "BAD" not in html_text.main_text(f"<article><p>{TEXT}</p><div class='comments'>{bad * 9}</div></article>")
    assert html_text.main_text(bad).count("BAD") == 2


def test_wrappers_of_any_name_change_nothing():
    """Pages wrapped in boxes whose class is drawn at random give what the unwrapped page gives."""
    rng = random.Random(90)
    words = ["has", "with", "no", "sidebar", "menu", "ads", "content", "page", "wrap", "main", "nav", "open", "footer", "modal", "left", "site", "banner", "widget", "share"]
    for _ in range(300):
        body = "".join(f"<p>P{k} {TEXT * rng.randint(1, 4)}</p>" + "<div class='ad'><p>Buy</p></div>" * rng.randint(0, 1) for k in range(6))
        want = html_text.main_text(f"<div>{body}</div>")
        assert "Buy" not in want and all(f"P{k} " in want for k in range(6))
        page = body
        for _ in range(rng.randint(1, 4)):
            page = f"<{'div'} class='{'-'.join(rng.sample(words, rng.randint(1, 3)))} {rng.choice(words)}x'>{page}</div>"
        assert html_text.main_text(f"<body><nav>n</nav>{page}<footer>f</footer></body>") == want


def test_deeply_nested_groups_take_linear_time():
    import time

    def took(n):
        t = time.perf_counter()
        assert html_text.main_text("<div class=ad>" * n + "deep") == "deep"
        return time.perf_counter() - t

    took(2000)
    assert took(100_000) < 12 * took(20_000) + 0.5


def test_pages_of_the_table_without_articles_and_names(spark):
    """Neither article elements nor classes: what tells the text is its lines. The key is the article element, read by a
    pattern. Where an article is hardly longer than the advert before it, nothing is left that could tell them apart."""
    import html

    seen = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        inner = re.sub("<[^>]+>", "", re.sub("</?(?:p|h1|br)[^>]*>", " ", inner))
        advert = max(re.findall(r"<div class=\"ad\"[^>]*>(.*?)</div>", r["html"], re.S), key=len, default="")
        bare = re.sub(r' (?:class|id|role)="[^"]*"', "", re.sub("</?article>", "", r["html"]))
        for page in (bare, re.sub(r"(</?)(?:nav|footer)>", r"\1div>", bare)):
            if len(inner) > max(5 * len(advert), 300):
                seen += 1
                assert html_text.main_text(page) == " ".join(html.unescape(inner).split())
    assert seen > 80


# ------------------------------------------------------------------ 10 line dedup


def _plain_line_dedup(texts):
    """Three-line windows over newline-ended lines in plain code: nothing of the operator is used."""
    seen, out = set(), {}
    for i in sorted(texts):
        t, lines, at = texts[i], [], 0
        for line in t.split("\n"):
            words = list(WORD.finditer(line))
            if words:
                lines.append((at + words[0].start(), tuple(w[0] for w in words)))
            at += len(line) + 1
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(x for _, x in lines[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        edges = [a for a, _ in lines] + [len(t)]
        keep = [t[: edges[0]]] + [t[edges[k] : edges[k + 1]] for k in range(len(lines)) if k not in gone]
        out[i] = "".join(keep)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_is_plain_windows_on_short_lines(spark, seed):
    rng = random.Random(seed)
    some = [" ".join(rng.choice(["a", "b", "é", "dd"]) for _ in range(rng.randint(1, line_dedup.PLAIN))) for _ in range(6)] + ["", " \t"]
    texts = {i: "".join(rng.choice(some) + rng.choice(["\n", "\n", " \n", "\n\n"]) for _ in range(rng.randint(0, 14))) for i in range(120)}
    got = dict(line_dedup.line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect())
    assert got == _plain_line_dedup(texts)


def test_line_dedup_of_passages_inside_lines(spark, docs):
    rng = random.Random(10)
    fill = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(6)) for _ in range(n))
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    passages = [words(rng.randint(51, 90)) if k % 2 else "\n".join(words(rng.randint(5, 15)) for _ in range(7)) for k in range(30)]
    rows = [(1000 + 3 * k + j, f"{fill(30)}{rng.choice([' ', chr(10)])}{p} {fill(30)}") for k, p in enumerate(passages) for j in range(3)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    text, got = dict(every.collect()), dict(line_dedup.line_dedup(every).collect())
    for k, p in enumerate(passages):
        assert got[1000 + 3 * k] == text[1000 + 3 * k]
        for j in (1, 2):  # a line or piece at each end may stay
            assert len(set(p.split()) & set(got[1000 + 3 * k + j].split())) <= (24 if k % 2 else 30)
    # Whatever plain windows remove is removed; rows without a repeat stay.
    plain = _plain_line_dedup(text)
    assert all(len(got[i]) <= len(plain[i]) for i in text) and sum(got[i] == t for i, t in text.items() if i < 1000) > 150


@pytest.mark.parametrize("size", [4, 6, 8, 10, 14])
def test_three_lines_go_in_any_surroundings(spark, size):
    rng = random.Random(size)
    line = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for k in range(100):
        block = [line(size) for _ in range(3)]
        for j in range(2):
            before, after = line(rng.randint(1, 30)), line(rng.randint(1, 30))
            rows.append((2 * k + j, "\n".join([before, *block, after])))
            want[2 * k + j] = "\n".join([before, after] if j else [before, *block, after])
    assert dict(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_repeated_lines_go_whatever_their_neighbours(spark):
    """Blocks of three or more whole lines, against plain windows of three lines."""
    rng = random.Random(11)
    line = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for k in range(400):
        block = [line(rng.randint(1, 12)) for _ in range(3 + k % 4)]
        for j in range(2):
            before, after = [line(rng.randint(1, 12)) for _ in range(2)], [line(rng.randint(1, 12)) for _ in range(2)]
            rows.append((2 * k + j, "\n".join([*before, *block, *after])))
            want[2 * k + j] = "\n".join([*before, *after] if j else [*before, *block, *after])
    got = dict(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(got[i] != want[i] for i in want) == 0


# ------------------------------------------------------------------ all


def test_odd_rows(spark, odd, labels):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string")
    n = odd.count()
    assert toxicity.toxicity(odd, labels, F.lit(True)).count() == n
    assert toxicity.drop_toxic(odd, labels, F.lit(True)).columns == odd.columns
    assert quality_classifier.quality(odd, labels, F.lit(True)).count() == n
    assert quality_rules.quality_rules(odd).filter("kept IS NULL").count() == 0
    near = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd).collect()}
    assert {(0, 0, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (5, 5, True), (6, 5, False), (7, 7, True), (None, None, True)} <= near
    out = line_dedup.line_dedup(odd)
    assert out.columns == odd.columns and out.count() == n
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, bench).collect()} == {(5, 3), (6, 3)}
    assert secrets.find_secrets(odd).count() == n
    got = mixing.mix(odd.withColumn("domain", F.lit(None).cast("string")), {}, 10**9, 1)
    assert got.count() == 8
    pages = odd.selectExpr("doc_id AS page_id", "lang AS url", "text AS html")
    assert html_text.extract_main_text(pages).filter("text IS NULL").count() == 0
    chat = odd.selectExpr("doc_id AS conv_id", "n_chars AS turn", "lang AS role", "text").withColumn("parts", chat_format.text_part(F.col("text")))
    assert chat_format.format_chat(chat).count() == odd.select("doc_id").distinct().count()


def test_empty_tables(spark, odd, labels):
    none, bench = odd.limit(0), spark.createDataFrame([], "item_id long, text string")
    assert toxicity.toxicity(none, labels, F.lit(True)).count() == 0
    assert quality_classifier.quality(none, labels, F.lit(True)).count() == 0
    assert quality_rules.quality_rules(none).count() == 0 and near_dedup.near_duplicates(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0 and secrets.find_secrets(none).count() == 0
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench).count() == 0
    assert mixing.mix(none.withColumn("domain", F.lit("d")), {}, 5).count() == 0
    assert html_text.extract_main_text(none.selectExpr("doc_id AS page_id", "lang AS url", "text AS html")).count() == 0
    assert chat_format.format_chat(none.selectExpr("doc_id AS conv_id", "n AS turn", "lang AS role", "text").withColumn("parts", chat_format.text_part(F.col("text")))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_sql(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]}) q").fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want))
