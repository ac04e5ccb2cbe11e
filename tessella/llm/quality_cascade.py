"""Operator 5: quality rules as a short-circuit cascade.

Every rule is a Boolean column over the text, its words and counts. On a bounded
sample of the rows that reach the cascade, its cost is timed (the least of a few runs, beyond
those of a rule that reads nothing, so counts that already stand in columns are free) and
its selectivity is taken among the rows that the rules before it leave. The next
rule is the one with the most rejection per cost, and a row that one rule rejects
never reaches the next, as the verdict is one CASE expression. The order changes
the work, never the verdict, so reruns agree whatever the timings.

Defined results: a null or empty text has no words, fails the base rules and is
not kept; rows keep their multiplicity; extra columns pass through where the
operator filters; an empty table gives an empty one and the rules' given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE_CLASS, free_name, let, words_of, written

#: Rows that the estimates are made on, about.
SAMPLE_ROWS = 2_000
#: Runs that are timed for each rule, and the least cost of one on the whole sample.
TRIES, LEAST_SECONDS = 2, 1e-4
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = r"[#*$%&|<>]"


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.char_length(F.regexp_replace(x, SPACE_CLASS, "")) > 0)


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Only texts in which a hash repeats go
    on: hashes are sorted with their positions, so the work is n log n at most.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = let(
            pairs,
            lambda s: F.filter(s, lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"])),
        )
        at = F.sort_array(F.transform(repeated, lambda e: e["i"]))
        gaps = let(at, lambda p: F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    n = F.size(words)
    hashes = F.transform(
        F.slice(words, F.lit(1), F.greatest(n - (width - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, width)]),
    )
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))).cast("bigint")


def n_stutters(words: Column) -> Column:
    """Words equal to the word before."""
    return F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("bigint")


class Counts:
    """What rules look at: the text, its words, and counts that are computed where a rule needs them unless they are given."""

    def __init__(self, text: Column, words: Column, **given: Column):
        self.text, self.words, self.given = text, words, given

    def __getattr__(self, name: str) -> Column:
        made = {
            "n_words": lambda: F.size(self.words),
            "word_chars": lambda: word_chars(self.words),
            "n_symbols": lambda: n_symbols(self.text),
            "n_dup_lines": lambda: n_dup_lines(self.text),
            "n_repeat_words": lambda: n_repeat_words(self.words),
            "n_lines": lambda: F.size(_lines(self.text)),
            "n_stutters": lambda: n_stutters(self.words),
        }
        return self.given[name] if name in self.given else made[name]()


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Counts], Column]


def base_fails(n_words: Column, repeated: Column) -> Column:
    return (n_words < 10) | (100 * repeated > 20 * n_words)


BASE_RULES = (
    Rule("too_short", lambda c: c.n_words < 10),
    Rule("repetitive", lambda c: 100 * c.n_repeat_words > 20 * c.n_words),
)
#: Beyond the base rules: markup or table debris, odd word lengths, repeated lines, stuttered words.
RULES = (
    Rule("symbols", lambda c: 10 * c.n_symbols > c.n_words),
    Rule("word_length", lambda c: let(c.word_chars, lambda n: (n < 2 * c.n_words) | (n > 15 * c.n_words))),
    Rule("dup_lines", lambda c: let(c.n_dup_lines, lambda n: (n > 0) & (2 * n > c.n_lines))),
    Rule("stutter", lambda c: 10 * c.n_stutters > 3 * c.n_words),
)


@dataclass(frozen=True)
class Estimate:
    """Seconds a row, and the share that the rule rejects of the rows that reach it."""

    rule: Rule
    cost: float
    rejected: float


def _seconds(sample: DataFrame, rejects: Column) -> float:
    """The least time of counting the sample's rows that a rule rejects."""
    took = []
    for _ in range(TRIES):
        began = time.perf_counter()
        sample.agg(F.count_if(rejects)).collect()
        took.append(time.perf_counter() - began)
    return min(took)


def sampled(docs: DataFrame, text: str = "text") -> DataFrame:
    """(t, w): the texts and words of about SAMPLE_ROWS rows."""
    total = docs.select(F.count(F.lit(1))).first()[0]
    rows = docs.select(F.coalesce(text, F.lit("")).alias("t"))
    return rows.sample(min(1.0, SAMPLE_ROWS / total) if total else 1.0, seed=5).withColumn("w", words_of(F.col("t")))


def estimates(sample: DataFrame, rules: tuple[Rule, ...], given: tuple[str, ...] = (), seconds: Callable[[DataFrame, Column], float] = _seconds) -> list[Estimate]:
    """The rules in the order in which they run; ``sample`` has the rows (t, w) that reach the first, and counts in the columns ``given``."""
    sample = written(sample.select("t", "w", *given), "rule-sample")
    counts = Counts(F.col("t"), F.col("w"), **{c: F.col(c) for c in given})
    hits = F.concat(*[F.when(r.rejects(counts), "1").otherwise("0") for r in rules])
    # one row per set of rules that reject together
    left = {r["hits"]: r["n"] for r in sample.groupBy(hits.alias("hits")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not left:
        return [Estimate(r, 0.0, 0.0) for r in rules]
    rows = sum(left.values())
    nothing = seconds(sample, F.length("t") < 0)
    cost = [max(seconds(sample, r.rejects(counts)) - nothing, LEAST_SECONDS) / rows for r in rules]
    todo, found = list(range(len(rules))), []
    while todo:
        n = sum(left.values())
        rejected = {i: sum(k for h, k in left.items() if h[i] == "1") / n if n else 0.0 for i in todo}
        best = max(todo, key=lambda i: (rejected[i] / cost[i], -cost[i], -i))
        found.append(Estimate(rules[best], cost[best], rejected[best]))
        left = {h: k for h, k in left.items() if h[best] == "0"}
        todo.remove(best)
    return found


def verdict(counts: Counts, order: list[Rule]) -> Column:
    """Name of the first rule that rejects, null where all pass."""
    case = F
    for rule in order:
        case = case.when(rule.rejects(counts), rule.name)
    return F.lit(None).cast("string") if case is F else case


def _features(rows: DataFrame, *others: str) -> DataFrame:
    """Adds the counts of the base rules to rows with t and w."""
    t, w = F.col("t"), F.col("w")
    features = {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": word_chars(w),
        "n_symbols": n_symbols(t),
        "n_dup_lines": n_dup_lines(t),
        "n_repeat_words": n_repeat_words(w),
    }
    rows = rows.select(*others, "t", "w", *[features[n].alias(n) for n in FEATURES])
    return rows.withColumn("base_failed", base_fails(F.col("n_words"), F.col("n_repeat_words")))


def annotate(docs: DataFrame) -> DataFrame:
    """doc_id, the base features, base_failed, kept and the rejecting rule of every row; rows that the base rules reject reach no other rule."""
    # written with its counts before the filter, which Spark would move below them and so split the text again for each word
    sample = written(_features(sampled(docs)), "rule-sample")
    order = [e.rule for e in estimates(sample.filter(~F.col("base_failed")), RULES, FEATURES)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("w", words_of(F.col("t")))
    rows = _features(rows, "doc_id")
    found = verdict(Counts(F.col("t"), F.col("w"), **{n: F.col(n) for n in FEATURES}), order)
    rows = rows.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(found))
    return rows.withColumn("kept", F.col("rejected_by").isNull()).select("doc_id", *FEATURES, "base_failed", "kept", "rejected_by")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and all others, with all their columns."""
    order = [e.rule for e in estimates(sampled(docs), BASE_RULES + RULES)]
    text, found = free_name(docs, "t_"), free_name(docs, "rejected_")
    rows = docs.withColumn(text, F.coalesce("text", F.lit("")))
    # the words are bound inside the expression: a filter on it moves below any projection
    rejected = let(words_of(F.col(text)), lambda w: verdict(Counts(F.col(text), w), order))
    return rows.withColumn(found, rejected).filter(F.col(found).isNull()).select(*docs.columns)
