"""The pipeline's stages take effect and keep clean rows."""

from __future__ import annotations

import random

import corpus_pipeline as P
from corbel.llm import near_dedup
from corbel.llm.common import settle

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    now, seen = docs, {}
    for k, (name, stage) in enumerate(P.STAGES):
        now = settle(stage(spark, now, SF), "t")
        seen[name] = now
        if k < 4:
            assert now.columns == docs.columns
    n = {k: v.count() for k, v in seen.items()}
    assert 150 < n["toxicity"] <= 200 and n["line_dedup"] == n["toxicity"] and n["near_dedup"] <= n["line_dedup"]
    bad = ("trash", "moron", "stupid", "clown", "loser", "idiot", "scum", "pathetic", "disgusting", "worthless")
    assert seen["toxicity"].filter(" OR ".join(f"text LIKE '% {w} %'" for w in bad)).count() <= 3
    assert seen["line_dedup"].filter("n_chars <> length(text)").count() == 0
    left = {r["doc_id"] for r in seen["near_dedup"].collect()} - {r["doc_id"] for r in seen["decontaminate"].collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in seen["near_dedup"].collect()}
    assert {i for i, t in texts.items() if any(b in t for b in bench)} <= left
    mixed = seen["mixing"].selectExpr("sum(n_tokens) AS n", "max(epoch) AS e").first()
    total = sum(len(t.split()) for i, t in texts.items() if i not in left)
    # Leaves of one or two documents leave up to a document of their rest unused.
    assert 0.6 * total < mixed["n"] <= 0.9 * total and mixed["e"] <= 3


def test_run(spark):
    assert P.run(spark, SF).count() > 100


def test_near_dedup_stage_links_at_four_fifths(spark, docs):
    """Pairs of 0.80 to below 0.85: one goes."""
    rows = []
    for k in range(20):
        words = [f"w{k}x{i}" for i in range(104)]  # 100 shingles; two changed words leave 90 common of 110
        rows += [(50_000 + 2 * k, " ".join(words)), (50_001 + 2 * k, " ".join("other" if i in (20, 60) else w for i, w in enumerate(words)))]
    some = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], docs.select("doc_id", "text", "lang", "source", "n_chars").schema).select(*docs.columns)
    kept = {r["doc_id"] for r in P.near_dedup_stage(spark, some, SF).collect()}
    assert kept == {50_000 + 2 * k for k in range(20)}


def test_neighbours_agree_by_the_threshold():
    for percent, most in ((80, 0.6), (85, 0.66)):
        assert 0.5 < near_dedup.loose(percent) < most


def _stages(spark, docs):
    out = []
    for _, stage in P.STAGES:
        docs = settle(stage(spark, docs, SF), "odd")
        out.append(docs)
    return out


def test_odd_rows_through_all_stages(spark, odd):
    """Nulls, empty and long texts, repeated rows and columns with clashing names."""
    toxic, lines, near, clean, mixed = _stages(spark, odd.withColumn("__mix_text", odd["lang"]).withColumn("rest", odd["n"]))
    n = odd.count()
    assert toxic.count() == n and lines.count() == n and lines.columns == toxic.columns == clean.columns
    ids = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.collect())
    # One of 3, 4 and 4 stays, and one of the long copies (line dedup empties the later one, which then has no group).
    assert ids(near) == [(False, 0), *((True, i) for i in (0, 1, 2, 3, 5, 6, 7, 8))]
    assert ids(clean) == ids(near)
    assert {r["doc_id"] for r in mixed.collect()} <= {None, 3, 5, 7, 8} and mixed.filter("text IS NULL OR n_tokens = 0").count() == 0


def test_empty_table_through_all_stages(spark, docs):
    assert [x.count() for x in _stages(spark, docs.limit(0))] == [0] * 5


def test_repeated_rows_neither_multiply_nor_vanish(spark, docs):
    """60 documents twice each, and 20 ids with two texts."""
    some = docs.orderBy("doc_id").limit(60)
    near = P.near_dedup_stage(spark, settle(some.unionByName(some), "t"), SF)
    assert sorted(r[0] for r in near.select("doc_id").collect()) == sorted(r[0] for r in P.near_dedup_stage(spark, some, SF).select("doc_id").collect())
    other = [(i, " ".join(f"x{i}y{k}" for k in range(80)), "en", "src1", 1) for i in range(20)]
    both = some.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(other, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = [tuple(r) for r in P.near_dedup_stage(spark, settle(both, "t"), SF).select("doc_id", "text").collect()]
    assert {(i, t) for i, t, *_ in other} <= set(kept) and len(kept) == len(set(kept))
    mixed = P.mixing_stage(spark, settle(some.unionByName(some), "t"), SF)
    chosen = [tuple(r) for r in mixed.select("doc_id", "epoch", "text").collect()]
    assert chosen and all(chosen.count(x) == 2 for x in chosen)


def test_near_copies_are_caught_in_the_pipeline(spark, docs):
    """Texts with a few changed words: one of each group reaches the later stages whole."""
    rng, rows = random.Random(1), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    for k in range(30):
        base = [word() for _ in range(200)]
        for j in range(3):
            words = list(base)
            for at in rng.sample(range(200), 2 * j):
                words[at] = word()
            rows.append((70_000 + 3 * k + j, " ".join(words), "en", "src1", 1))
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = settle(P.line_dedup_stage(spark, now, SF), "t")
    whole = {r["doc_id"] for r in lines.join(now.select("doc_id", "text"), ["doc_id", "text"]).collect()}
    assert {70_000 + 3 * k for k in range(30)} == whole
    # What line dedup leaves of the copies is a small part of them.
    left = sum(len(r["text"].split()) for r in lines.collect() if r["doc_id"] not in whole)
    assert left < 0.45 * sum(len(t.split()) for i, t, *_ in rows if i not in whole)
    direct = {r["doc_id"] for r in P.near_dedup_stage(spark, now, SF).collect()}
    assert direct == whole
