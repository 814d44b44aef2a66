"""Quality rules as a short-circuit cascade (DataFrame functions only).

Words are runs of characters other than space and \t..\r. Base rules come first: fewer than 50 words, or more than
half of the words in 3-word windows that occur twice or more in the text. The other rules form a cascade. Each one's cost
is its time on a sample: the fastest of REPEATS runs over the sample's measured rows, less that of a run without a
rule. Its selectivity is the share of them that it rejects. Rules are ordered by rejection per cost, and a CASE evaluates
them in that order until one rejects. The order changes the work, never the verdict.

Base metrics are made once per row, behind a generator that yields each row once, so that no later expression repeats
them. Windows of words are compared by 64-bit hashes, of which a text of n words keeps 64 less log2(n) bits.

Defined results: null text: no words (rejected by the base rules); empty table: default order, no rows; ties in
rejection per cost: by rule name; repeated rows are judged each on its own; other columns are kept, but for those that
have a metric's name, which are replaced.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, settle

#: Rows of the sample that costs and selectivities are estimated on, about, and times that each rule runs over it.
SAMPLE_ROWS, REPEATS = 2000, 2
#: Least cost of a rule, in seconds: what a run's time tells at all.
LEAST_COST = 1e-3
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed"]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeat_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more. Each window is a long: its hash in the upper
    bits, its place in the lower ones; sorting brings equal hashes together (neighbours that differ in lower bits only),
    and the covered places are summed."""
    n = F.size(words)
    bits = F.length(F.bin(n.cast("bigint")))
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda x, y: F.least(F.lit(3).cast("bigint"), F.coalesce(y - x, F.lit(3).cast("bigint"))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, b: a + b)

    def of(low: Column) -> Column:
        high = F.bitwise_not(low)
        window = lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).bitwiseAND(high).bitwiseOR(i.cast("bigint"))

        def repeated(s: Column) -> Column:
            # For each window whether it equals the one before it, and so whether either of a pair counts.
            same = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda x, y: F.coalesce(x.bitwiseXOR(y).bitwiseAND(high) == 0, F.lit(False)))
            return _let(same, lambda e: F.filter(s, lambda x, i: F.get(e, i) | F.coalesce(F.get(e, i - 1), F.lit(False))))

        hits = _let(F.sort_array(F.transform(F.sequence(F.lit(1), n - 2), window)), repeated)
        places = lambda h: F.sort_array(F.transform(h, lambda x: x.bitwiseAND(low)))
        return _let(hits, lambda h: F.when(F.size(h) == 0, F.lit(0).cast("bigint")).otherwise(_let(places(h), covered)))

    return F.when(n < 4, F.lit(0).cast("bigint")).otherwise(_let(low, of))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with METRICS."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).alias("r"), F.length(F.array_join(w, "")).cast("bigint").alias("c"))
    of_lines = lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("d"))
    symbols = _count(t, r"[#*$%&|<>]")

    def every(w: Column, x: Column) -> Column:
        failed = (w["n"] < 50) | (100 * w["r"] > 50 * w["n"])
        values = (w["n"], w["c"], symbols, x["d"], w["r"], x["n"], failed)
        return F.struct(*[v.alias(name) for v, name in zip(values, METRICS, strict=True)])

    both = F.transform(F.array(F.struct(_let(words_of(t), of_words).alias("w"), _let(lines, of_lines).alias("x"))), lambda b: every(b["w"], b["x"]))
    return docs.select(*[c for c in docs.columns if c not in METRICS], F.inline(both))


#: name -> rejecting condition, from the text and the metrics. Whole numbers only.
RULES = {
    "long_words": lambda t: F.col("word_chars") > 20 * F.col("n_words"),
    "short_words": lambda t: F.col("word_chars") < 2 * F.col("n_words"),
    "symbols": lambda t: 10 * F.col("n_symbols") > F.col("n_words"),
    "dup_lines": lambda t: (F.col("n_lines") >= 8) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
    "shouting": lambda t: 2 * _count(t, "!") > F.col("n_words"),
    "upper_case": lambda t: 2 * _count(t, r"\p{Lu}") > F.col("word_chars"),
    "digits": lambda t: 2 * _count(t, "[0-9]") > F.col("word_chars"),
    "few_letters": lambda t: 10 * _count(t, r"\p{L}[^\x20\x09-\x0D]*+") < 7 * F.col("n_words"),
}


def _seconds(df: DataFrame) -> float:
    """The fastest of some runs."""
    out = []
    for _ in range(REPEATS):
        start = time.perf_counter()
        df.collect()  # one row
        out.append(time.perf_counter() - start)
    return min(out)


def cascade_order(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, rejection rate, cost in seconds), best first. The sample is measured once and written; each rule's run
    reads it again."""
    total = docs.count()
    if not total:
        return [(name, 0.0, LEAST_COST) for name in sorted(RULES)]
    t = F.coalesce(F.col(text), F.lit(""))
    some = base_metrics(docs.sample(min(1.0, sample_rows / total), seed=17), text).filter(~F.col("base_failed"))
    some = settle(some.select(F.col(text), *METRICS), "rules-sample").coalesce(1)
    rate = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    rates = some.agg(*[rate(cond(t)).alias(name) for name, cond in RULES.items()]).first()
    nothing = _seconds(some.agg(rate(F.length(t) < 0)))
    cost = {name: max(_seconds(some.agg(rate((F.length(t) < 0) | cond(t)))) - nothing, LEAST_COST) for name, cond in RULES.items()}
    out = [(name, rates[name] or 0.0, cost[name]) for name in RULES]
    return sorted(out, key=lambda x: (-x[1] / x[2], x[2], x[0]))


def quality_rules(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the base metrics, kept, and rejected_by (first rule of the cascade that rejects, or base)."""
    measured = base_metrics(docs, text)
    t = F.coalesce(F.col(text), F.lit(""))
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for name, _, _ in cascade_order(docs, text, sample_rows):
        verdict = verdict.when(RULES[name](t), F.lit(name))
    judged = measured.select("*", F.inline(F.array(F.struct(verdict.alias("rejected_by")))))
    return judged.withColumn("kept", F.col("rejected_by").isNull())
