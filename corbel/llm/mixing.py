"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

Leaves are sources within languages within domains. A budget of tokens goes down the tree. At each node it is shared
among the children by weight; a child that can't use its share (its documents' tokens times max_epochs) is filled and
what it leaves goes to its siblings by weight, again and again until nothing changes. As a node never gets more than
its subtree can use, a shortage stays among siblings as long as they can take it and only then moves to the ancestors'
siblings. That fixed point has a closed form: children ordered by capacity per weight fill up from the front, so a
running sum finds the last filled child, without a loop.

A leaf's share is so many whole epochs and a rest. The rest is a token prefix of one more epoch in a seeded order: the
documents in that order as long as their running sum stays within the rest. The order is cut into buckets of its key.
Bucket sums, and sums of groups of buckets (as many groups as a group has buckets), give the running sum up to each bucket
in two steps of at most the square root of their number; only the bucket in which the rest ends is sorted, for the last
document that fits. All rows are then held against that place where they stand, so texts that are carried along are
never shuffled, and a leaf with a third of all rows is no single task's work.

Defined results: null text or text without words: no tokens, never selected; null domain, language or source: the
empty name; names without a weight: default_weight; weight 0: nothing; budget beyond all capacity: everything
max_epochs times; the seeded order: by md5 of seed, epoch and doc_id (the text's hash for a null one), ties by doc_id and the
text's hash; repeated rows count each, and rows equal in doc_id and text are taken together or not at all; empty table:
no rows. Whole-number shares are rounded down, so a node may leave fewer tokens than it has children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, settle

LEVELS = ("domain", "lang", "source")
#: Documents of one bucket of the seeded order, about.
BUCKET_ROWS = 1000
BIG = "decimal(38,0)"


def count_tokens(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, SPACE), "")).cast("bigint")


def weight_column(name: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, v in sorted(weights.items()):
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("bigint")


def _fill(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds share to nodes of (parent, child, w, cap, given); given is the parent's budget."""
    own = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by = own.orderBy(F.try_divide("cap", F.col("w").cast("double")).asc_nulls_last(), child)
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(BIG)
    rest_w = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast(BIG)
    full = (F.col("w") == 0) | (F.col("cap").cast(BIG) * rest_w <= (F.col("given").cast(BIG) - before) * F.col("w").cast(BIG))
    nodes = nodes.withColumn("full", full)
    nodes = nodes.withColumn("left", F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(own))
    nodes = nodes.withColumn("open_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(own))
    split = F.expr(f"(CAST(left AS {BIG}) * CAST(w AS {BIG})) div nullif(CAST(open_w AS {BIG}), 0)")
    return nodes.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(split).cast("bigint")).drop("full", "left", "open_w")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: Column | int, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """leaves (domain, lang, source, tokens, docs) with w and share. The table has a row per leaf, not per document."""
    n = leaves
    for level in LEVELS:
        n = n.withColumn(f"w_{level}", weight_column(F.col(level), weights.get(level, {}), default_weight))
    open_ = (F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0)
    n = n.withColumn("cap", F.when(open_, F.col("tokens") * max_epochs).otherwise(0).cast("bigint"))
    langs = n.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.first("w_lang").alias("w"))
    domains = n.groupBy("domain").agg(F.sum("cap").alias("cap"), F.first("w_domain").alias("w"))
    every = Window.partitionBy(F.lit(0))
    want = budget if isinstance(budget, Column) else F.lit(budget)
    # The budget's own expression may use total, the tokens of all leaves.
    total = n.groupBy().agg(F.sum("tokens").alias("total"))
    domains = domains.join(F.broadcast(total)).withColumn("given", F.least(want.cast("bigint"), F.sum("cap").over(every))).drop("total")  # one row
    domains = _fill(domains, [], "domain").select("domain", F.col("share").alias("given"))
    langs = _fill(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("share").alias("given"))
    return _fill(n.withColumn("w", F.col("w_source")).join(langs, ["domain", "lang"]), ["domain", "lang"], "source").select(*LEVELS, "tokens", "docs", "share")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], budget: Column | int, max_epochs: int = 3, seed: int = 11, default_weight: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, domain, lang, source, n_tokens, epoch, and the columns to carry) of docs (doc_id, text, domain,
    lang, source): a document is there once for each epoch that takes it. budget: tokens, or a column over total (all
    tokens of the table)."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS]
    own = [F.col(c).alias(f"__mix_{c}") for c in carry]
    slim = docs.select("doc_id", *named, count_tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("fine"), *own).filter("n_tokens > 0")
    slim = settle(slim, "mix-tokens")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = leaf_budgets(leaves, weights, budget, max_epochs, default_weight).filter("share > 0")
    plan = settle(plan.select(*LEVELS, F.expr("share div tokens").alias("full"), F.expr("share % tokens").alias("rest"), F.expr(f"greatest(1, docs div {BUCKET_ROWS})").alias("buckets")), "mix-plan")

    rows = slim.join(plan, list(LEVELS))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("fine").cast("string")))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("full") + 1, name)))
    rows = rows.withColumn("bucket", F.expr("(CAST(conv(substring(key, 1, 8), 16, 10) AS BIGINT) * buckets) div 4294967296"))
    asked = rows.filter("rest > 0").select(*LEVELS, "rest", "bucket", "key", "doc_id", "fine", "n_tokens", F.expr("bucket div CAST(ceil(sqrt(buckets)) AS BIGINT)").alias("part"))
    sums = settle(asked.groupBy(*LEVELS, "part", "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest")), "mix-sums")

    def ends(of: DataFrame, by: list[str], at: str) -> DataFrame:
        """The place in each group of by in which the rest ends, with the sum before it; earlier places are taken whole, later ones not at all."""
        upto = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = of.withColumn("upto", F.col("base") + F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))
        return out.filter("before <= rest AND upto > rest").select(*LEVELS, at, "before")

    parts = sums.groupBy(*LEVELS, "part").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")).withColumn("base", F.lit(0).cast("bigint"))
    part = ends(parts, list(LEVELS), "part").withColumnRenamed("before", "base")
    edge = settle(ends(sums.join(part, [*LEVELS, "part"]), list(LEVELS), "bucket").withColumnRenamed("bucket", "edge"), "mix-edge")
    place = F.struct("key", "doc_id", "fine")
    upto = Window.partitionBy(*LEVELS).orderBy("key", "doc_id", "fine").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = asked.join(edge, list(LEVELS)).filter("bucket = edge").withColumn("run", F.col("before") + F.sum("n_tokens").over(upto)).filter("run <= rest")
    last = last.groupBy(*LEVELS).agg(F.max(place).alias("last"))
    cut = settle(edge.join(last, list(LEVELS), "left").select(*LEVELS, "edge", "last"), "mix-cut")

    fits = (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & F.coalesce(place <= F.col("last"), F.lit(False)))
    times = F.col("full") + F.when((F.col("rest") > 0) & fits, 1).otherwise(0)
    out = rows.join(cut, list(LEVELS), "left").withColumn("times", times).filter("times > 0")
    epoch = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("epoch")
    return out.select("doc_id", *LEVELS, "n_tokens", epoch, *[F.col(f"__mix_{c}").alias(c) for c in carry])
