"""Kernels for tables of any size: spans over ranges, pairs behind hashed counters, kept snapshots."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corbel.operators import links as L
from corbel.operators import pairs as P
from corbel.operators import snapshots as S
from corbel.operators.spans import first_over, innermost_span, placed

POINTS, SPANS = "grp string, at long, id long", "grp string, lo long, hi long, span string, ord long"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ spans


def plain_spans(points, spans):
    out = Counter()
    for g, at, k in points:
        hit = [(hi - lo, o, s) for gg, lo, hi, s, o in spans if g is not None and gg == g and None not in (at, lo, hi) and lo <= at <= hi]
        if hit:
            out[k, min(hit)[2]] += 1
    return out


@pytest.mark.parametrize("seed", range(20))
def test_first_interval_over_each_place(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 70))
    begin = rng.integers(0, n, int(rng.integers(0, 40)))
    end = np.minimum(begin + rng.integers(1, (3, n + 1)[seed % 2], len(begin)) if len(begin) else begin, n)
    want = [next((k for k in range(len(begin)) if begin[k] <= x < end[k]), -1) for x in range(n)]
    assert first_over(begin, end, n).tolist() == want


@pytest.mark.parametrize(("ranges", "length", "top"), [(1, 90, 200), (3, 5, 200), (8, 1, 500), (13, 1_000_000, 1_000_000), (8, 60, 50)])
def test_innermost_spans_of_any_length(spark, ranges, length, top):
    rng = random.Random(length)
    spans = [(rng.choice("ab"), s := rng.randint(-top, top), s + rng.randint(-1, length), f"s{k}", k % 50) for k in range(300)]
    points = [(rng.choice("abz"), rng.randint(-top, top + length // 2), k) for k in range(500)]
    # one place with a third of all points, starts and ends of many spans; rows with nulls
    points += [("a", 7, 1000 + k) for k in range(400)] + [(None, 3, -1), ("a", None, -2), ("a", 7, 1000)]
    spans += [("a", 7, 7 + rng.randint(0, 40), f"h{k}", k) for k in range(100)] + [("a", rng.randint(0, 9), 7, f"e{k}", k) for k in range(100)]
    spans += [(None, 0, 9, "n", 0), ("a", None, 3, "m", 0), ("a", 3, None, "m", 0)]
    got = innermost_span(spark.createDataFrame(points, POINTS).repartition(4), spark.createDataFrame(spans, SPANS).repartition(3), ranges)
    assert Counter(map(tuple, got.collect())) == plain_spans(points, spans)


def test_spans_of_other_types_and_empty_tables(spark):
    points, spans = spark.createDataFrame([(1, 1.5, "p"), (2, 9.0, "q")], "grp long, at double, id string"), spark.createDataFrame([(1, 1.0, 2.0, 5, "x"), (1, 1.0, 1.5, 4, "y")], "grp long, lo double, hi double, span long, ord string")
    assert [tuple(r) for r in innermost_span(points, spans, 4).collect()] == [("p", 4)]
    none_p, none_s = spark.createDataFrame([], POINTS), spark.createDataFrame([], SPANS)
    some_p, some_s = spark.createDataFrame([("a", 1, 1)], POINTS), spark.createDataFrame([("a", 1, 1, "s", 0)], SPANS)
    for p, s in ((none_p, some_s), (some_p, none_s), (none_p, none_s)):
        assert innermost_span(p, s, 4).collect() == []


@pytest.mark.parametrize("length", [1, 300, 10**6])
def test_spans_are_sent_twice_at_most_and_ranges_are_even(spark, length):
    """However long spans are, and with a third of the points, of the starts and of the ends at one place."""
    n, ranges = 3000, 16
    third = lambda c: F.when(F.col("id") % 3 == 0, 500).otherwise(c)
    points = spark.range(n).select(F.lit("a").alias("grp"), third(F.col("id")).alias("at"), "id")
    spans = spark.range(n).select(F.lit("a").alias("grp"), third(F.col("id")).alias("lo"), (F.col("id") + length).alias("hi"), F.col("id").alias("ord"), F.col("id").alias("span"))
    back = spans.select("grp", (F.col("lo") - length).alias("lo"), F.col("lo").alias("hi"), "ord", "span")  # these end together
    at, over = placed(points.repartition(2), spans.filter("lo <= hi").union(back).repartition(2), ranges)
    sizes = lambda df: [r["count"] for r in df.groupBy("range").count().collect()]
    assert sum(sizes(at)) == n and max(sizes(at)) < 4 * (5 * n / ranges)
    assert sum(sizes(over)) <= 2 * 2 * n + 2 * ranges and max(sizes(over)) < 4 * (5 * n / ranges)


def test_classify_keeps_repeated_items(spark):
    items = spark.createDataFrame([(1, "f", 3, "x"), (1, "f", 3, "x"), (2, "f", 10, "y"), (3, "t", 1, "z"), (4, None, 1, "e")], "id long, grp string, at long, name string")
    exact, spans = spark.createDataFrame([("f", 10, "ten"), ("f", 10, "aten")], "grp string, at long, target string"), spark.createDataFrame([("f", 1, 5, "s", 0)], SPANS)
    got = L.classify(items, exact, spans, F.col("grp") == "t", F.col("grp").isNotNull()).select("id", "kind", "target").collect()
    assert Counter(map(tuple, got)) == Counter({(1, "sym", "s"): 2, (2, "sym", "aten"): 1, (3, "test", None): 1, (4, "ext", None): 1})


# ------------------------------------------------------------------ pairs


def plain_pairs(rows, lo, hi, support):
    sets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            sets[b].add(i)
    count = Counter(p for s in sets.values() if lo <= len(s) <= hi for p in itertools.combinations(sorted(s), 2))
    return {p: n for p, n in count.items() if n >= support}


@pytest.mark.parametrize("counters", [0, 64, 1 << 10, 1 << 16])
@pytest.mark.parametrize("support", [1, 2, 3])
def test_counters_never_change_the_pairs(spark, counters, support):
    rng = random.Random(support)
    rows = [(b, f"f{min(rng.randint(0, 40), rng.randint(0, 40))}") for b in range(200) for _ in range(rng.randint(1, 8))]
    rows += [(1000, f"f{i}") for i in range(30)] + [(None, "f1"), (5, None)] + rows[:50]
    df = spark.createDataFrame(rows, "b long, i string").repartition(3)
    got = {(a, b): n for a, b, n in P.pair_counts(df, "b", "i", 2, 25, support, counters).collect()}
    assert got == plain_pairs(rows, 2, 25, support)


def test_crowded_lanes_are_exactly_those_that_reach_the_support(spark):
    rows = [(b, i) for b in range(300) for i in random.Random(b).sample(range(60), 5)]
    sets = P.baskets(spark.createDataFrame(rows, "b long, i long"), "b", "i").repartition(4)
    held = {r["word"]: r["bits"] % (1 << 64) for r in P.crowded_lanes(sets, 3, 1 << 12).collect()}
    got = {w * 64 + k for w, bits in held.items() for k in range(64) if bits >> k & 1}
    lanes = Counter(r[0] for r in P.pairs_of(sets).select(P._lane(1 << 12)).collect())
    assert got == {lane for lane, n in lanes.items() if n >= 3}


def test_rare_items_leave_before_pairs_are_made(spark):
    rows = [(b, x) for b in range(50) for x in (f"own{b}", f"other{b}", "all")]
    sets = P.baskets(spark.createDataFrame(rows, "b long, i string"), "b", "i", support=2)
    assert sets.count() == 0
    assert P.pair_counts(spark.createDataFrame([], "b long, i string"), "b", "i", counters=64).count() == 0
    for support, counters in ((1000, 64), (2, 63), (2, 96)):
        with pytest.raises(ValueError):
            P.crowded_lanes(sets, support, counters)


def test_a_hot_basket_is_never_gathered(spark):
    """Sizes are counted first, so the gathering aggregate sees small baskets only."""
    df = spark.range(100_000).selectExpr("IF(id % 3 = 0, 0, id) AS b", "id AS i")
    assert P.baskets(df.union(df.selectExpr("b", "i + 1")), "b", "i").agg(F.max(F.size("items"))).first()[0] == 2


# ------------------------------------------------------------------ snapshots


def some_rows(rng, n):
    return {k: rng.choice(["a", "b", None]) for k in rng.sample(range(2 * n), n)}


def write(spark, rows, folder, parts=8, buckets=3):
    S.write_snapshot(spark.createDataFrame(list(rows.items()), "id long, h string"), "id", "h", folder, parts, buckets)


def plain_changes(old, new):
    status = {k: "new" if k not in old else "gone" if k not in new else "changed" if old[k] != new[k] else "same" for k in old | new}
    return {k: s for k, s in status.items() if s != "same"}


@pytest.mark.parametrize("seed", range(3))
def test_changes_of_snapshots(spark, tmp_path, seed):
    rng = random.Random(seed)
    old = some_rows(rng, 60)
    new = {k: (h if rng.random() < 0.8 else "c") for k, h in old.items() if rng.random() < 0.8} | (some_rows(rng, 10) if seed else {})
    before = spark.conf.get("spark.sql.hive.manageFilesourcePartitions")
    write(spark, old, f"{tmp_path}/old")
    write(spark, new, f"{tmp_path}/new")
    assert dict(S.snapshot_changes(spark, f"{tmp_path}/old", f"{tmp_path}/new").collect()) == plain_changes(old, new)
    assert dict(S.snapshot_changes(spark, f"{tmp_path}/old", f"{tmp_path}/old").collect()) == {}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("corbel_")] and spark.conf.get("spark.sql.hive.manageFilesourcePartitions") == before


def test_one_change_reads_one_part_and_shuffles_nothing(spark, tmp_path):
    old = {k: "a" for k in range(500)}
    write(spark, old, f"{tmp_path}/old", 16, 4)
    write(spark, old | {77: "b"}, f"{tmp_path}/new", 16, 4)
    got = S.snapshot_changes(spark, f"{tmp_path}/old", f"{tmp_path}/new")
    assert len(S.changed_parts(spark, f"{tmp_path}/old", f"{tmp_path}/new")) == 1
    assert "Exchange" not in plan(got) and got.count() == 1 and dict(got.collect()) == {77: "changed"}
    assert plan(got).count("PartitionFilters: [isnotnull(part") == plan(got).count("FileScan") > 0


def test_snapshots_that_differ_in_layout_are_compared_whole(spark, tmp_path):
    write(spark, {1: "a", 2: "b"}, f"{tmp_path}/old", 8, 3)
    write(spark, {2: "c", 3: "b"}, f"{tmp_path}/new", 4, 2)
    assert dict(S.snapshot_changes(spark, f"{tmp_path}/old", f"{tmp_path}/new").collect()) == {1: "gone", 2: "changed", 3: "new"}


def test_empty_snapshots_null_keys_and_repeats(spark, tmp_path):
    write(spark, {}, f"{tmp_path}/none")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "id long, h string")
    S.write_snapshot(rows, "id", "h", f"{tmp_path}/some", 8, 3)
    assert dict(S.snapshot_changes(spark, f"{tmp_path}/none", f"{tmp_path}/some").collect()) == {1: "new", 2: "new"}
    assert dict(S.snapshot_changes(spark, f"{tmp_path}/some", f"{tmp_path}/none").collect()) == {1: "gone", 2: "gone"}
    write(spark, {1: "b", 2: None}, f"{tmp_path}/same")
    assert S.snapshot_changes(spark, f"{tmp_path}/some", f"{tmp_path}/same").count() == 0
    write(spark, {5: "x"}, f"{tmp_path}/some")  # in place of the one that is there
    assert dict(S.snapshot_changes(spark, f"{tmp_path}/none", f"{tmp_path}/some").collect()) == {5: "new"}


def test_a_hot_name_is_linked_by_many_tasks(spark):
    """Two small files that share one name join to 4,500,000 rows: no task makes most of them, and repeats stay."""
    rows = spark.range(3000).selectExpr("id", "IF(id < 2999, 'hot', NULL) AS name", "id % 7 AS more").coalesce(1)
    targets = spark.range(1500).selectExpr("id AS target", "'hot' AS name").coalesce(1)
    made = L.name_equi_link(rows.union(rows.filter("id = 5")), targets)
    assert made.columns == ["id", "more", "target"]
    by_task = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(by_task) == 3000 * 1500 - 1501
    assert max(by_task) < 0.6 * sum(by_task)
    assert made.filter("id = 5").count() == 2 * 1499 and made.filter("id = 5").distinct().count() == 1499


def test_equal_rows_are_linked_by_many_tasks(spark):
    """3,000 copies of one row meet 1,500 copies of one target: they differ in nothing, but no task makes most of the rows."""
    rows = spark.range(3000).selectExpr("5L AS id", "'hot' AS name").coalesce(1)
    targets = spark.range(1500).selectExpr("7L AS target", "'hot' AS name").coalesce(1)
    made = L.name_equi_link(rows, targets)
    by_task = [tuple(r) for r in made.groupBy(F.spark_partition_id(), "id", "target").agg(F.count("*").alias("n")).select("id", "target", "n").collect()]
    assert {r[:2] for r in by_task} == {(5, 7)} and sum(r[2] for r in by_task) == 3000 * 1500
    assert max(r[2] for r in by_task) < 0.6 * 3000 * 1500


def joined_rows(df) -> int:
    """Rows out of the topmost join of a plan that has run."""
    node = df._jdf.queryExecution().executedPlan()
    while "Join" not in node.nodeName():
        name = node.nodeName()
        node = node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan() if name.endswith("QueryStage") else node.children().head()
    return node.metrics().apply("numOutputRows").value()


def test_rows_of_a_hot_name_are_matched_once_in_a_cell(spark):
    """The join gives each row once for each part of the targets; the rows of the result are made of the parts after it."""
    rows = spark.range(3000).selectExpr("id", "'hot' AS name", "IF(id % 2 = 0, NULL, struct(id AS k)) AS more")
    targets = spark.range(1500).selectExpr("IF(id = 3, NULL, id) AS target", "'hot' AS name")
    made = L.name_equi_link(rows, targets)
    got = made.collect()
    assert joined_rows(made) == 3000 * 2
    assert len(got) == len({(r["id"], r["target"]) for r in got}) == 3000 * 1499 - 1499
    assert all((r["more"] is None) if r["id"] % 2 == 0 else (r["more"]["k"] == r["id"]) for r in got[::1000])


def test_pairs_beyond_the_counters_are_counted_once(spark, monkeypatch):
    rows = [(b, i) for b in range(60) for i in random.Random(b % 40).sample(range(50), 5)]
    monkeypatch.setattr(P, "crowded_lanes", lambda *_: pytest.fail("600 pairs don't fit 64 counters"))
    got = {(a, b): n for a, b, n in P.pair_counts(spark.createDataFrame(rows, "b long, i long"), "b", "i", 2, 25, 2, 64).collect()}
    assert got == plain_pairs(rows, 2, 25, 2)


def test_history_counts_people_apart(spark):
    rows = [("x", 1, "p", "a"), ("x", 2, "q", "b"), ("x", 3, "p", "c"), (None, 5, "p", "d"), (None, 4, None, "e"), ("y", 1, None, "f")]
    df = spark.createDataFrame(rows, "k string, pos long, who string, v string")
    made = P.group_history(df, "k", "pos", "who", {"one": "v"}, {"end": "v"})
    assert made.columns == ["k", "n", "n_who", "one", "end"]
    assert {tuple(r) for r in made.collect()} == {("x", 3, 2, "a", "c"), (None, 2, 1, "e", "d"), ("y", 1, 0, "f", "f")}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "max_by" in line and "who" in line]
