"""Quality rules with risk-controlled thresholds.

Signals are counted in each whole text. In a stratum one joint rule (a cutoff for each signal) may
reject only if labelled good documents prove it: the exact binomial tail of the rule's false
rejections, under a false rejection rate of the allowed size, must be below the error level. Rules
are tested in a fixed order that lowers one cutoff at a time, up to the first that is not proven, so
the level is divided by the strata only. Strata with too few labels take the rule of the pooled ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import SPACES, col, cut, put_back, set_apart

#: Signals: numerator, denominator and the grid's end; the grid has CUTOFFS equal steps.
SIGNALS = {
    "symbols": ("n_symbols", "word_chars", 1.0),
    "dup_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeats": ("n_repeat_words", "n_words", 1.0),
    "word_length": ("word_chars", "n_words", 40.0),
}
CUTOFFS = 20
#: The order of lowered cutoffs (signal, step): all in turn, then symbols to the end, as prose has the
#: fewest, and the mean word lengths of 4 and 2 last.
_FIRST = [(s, j) for j in range(CUTOFFS - 1, 2, -1) for s in SIGNALS] + [("symbols", j) for j in (2, 1, 0)]
_LINES = [(s, j) for j in (1, 0) for s in ("dup_lines", "repeats")]
ORDER = [*_FIRST, *[(s, 2) for s in SIGNALS if s != "symbols"], *_LINES, ("word_length", 1), ("word_length", 0)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _size(x: Column) -> Column:
    return F.size(x).cast("long")


def text_counts(docs: DataFrame, text_col: str = "text", window_hash: str = "xxhash64({0})") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long).

    Nulls count as empty texts. Words in repeated 3-word windows are found by sorting, within the
    row, longs that hold a window's hash (high bits) and its place (low bits, as many as the text
    needs); windows that occur again are neighbours then, and neighbours are compared word by word.
    A text in which unlike windows share a hash has its windows sorted by their words instead.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    df = docs.withColumns(
        {
            "_words": F.array_remove(F.split(text, SPACES), ""),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
        }
    )
    df = df.withColumn("n_words", _size(F.col("_words"))).withColumn("n_lines", _size(F.col("_lines")))
    df = df.withColumn("n_dup_lines", F.col("n_lines") - _size(F.array_distinct("_lines"))).drop("_lines")
    df = df.withColumn("_low", F.expr("shiftleft(1L, length(bin(n_words))) - 1"))
    hashed = window_hash.format("w, get(_words, i + 1), get(_words, i + 2)")
    place = F.expr(f"transform(_words, (w, i) -> ({hashed} & ~_low) | i)")
    df = df.withColumn("_marks", F.sort_array(F.slice(place, 1, F.greatest(F.size("_words") - 2, F.lit(0)))))
    near = "coalesce((x ^ get(_marks, i {0} 1)) & ~_low = 0, false)"
    word = lambda x, k: f"get(_words, cast({x} & _low as int) + {k})"
    unlike = " or ".join(f"{word('x', k)} <> {word('get(_marks, i + 1)', k)}" for k in range(3))
    clash = f"exists(transform(_marks, (x, i) -> {near.format('+')} and ({unlike})), v -> v)"
    again = f"filter(_marks, (x, i) -> {near.format('-')} or {near.format('+')})"
    windows = "sort_array(slice(transform(_words, (w, i) -> struct(struct(w, get(_words, i + 1), get(_words, i + 2)) as w, cast(i as bigint) as i)), 1, greatest(size(_words) - 2, 0)))"
    by_words = "transform(filter({0}, (x, i) -> coalesce(x.w = get({0}, i - 1).w, false) or coalesce(x.w = get({0}, i + 1).w, false)), x -> x.i)"
    df = df.withColumn("_clash", F.expr(clash))
    df = df.withColumn("_sorted", F.expr(f"case when _clash then {windows} end"))
    df = df.withColumn("_at", F.expr(f"sort_array(case when _clash then {by_words.format('_sorted')} else transform({again}, x -> x & _low) end)"))
    df = df.drop("_words", "_marks", "_low", "_sorted", "_clash")
    covered = "aggregate(transform(_at, (p, i) -> least(3L, coalesce(get(_at, i + 1) - p, 3L))), 0L, (s, x) -> s + x)"
    # Not a constant expression to the optimizer, so filters stay above and nothing is counted twice.
    return df.withColumn("n_repeat_words", F.expr(covered) + 0 * F.spark_partition_id()).drop("_at")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exactly: the logarithms of the terms are summed up."""
    first = n.cast("double") * math.log1p(-p)
    odds = math.log(p / (1 - p))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))

    def add(acc, i):
        term = acc["term"] + F.log((n - i + 1).cast("double") / i) + odds
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(acc["sum"], term) - top))).alias("sum"))

    start = F.struct(first.alias("term"), first.alias("sum"))
    tail = F.exp(F.aggregate(steps, start, add)["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(tail)


def _ratio(signal: str) -> Column:
    top, under, _ = SIGNALS[signal]
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(under).cast("double")), F.lit(0.0))


def proven_cutoffs(labelled: DataFrame, false_rejection: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row per stratum with a cutoff for each signal (null: none is proven).

    labelled: _stratum and the counts of good documents that the fixed rules keep. The allowed
    false rejection is shared out equally among the signals, and the error among all tests.
    """
    share = false_rejection / len(SIGNALS)
    grid = [(s, j, SIGNALS[s][2] * (j + 1) / CUTOFFS) for s in SIGNALS for j in range(CUTOFFS)]
    wide = cut(labelled.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(_ratio(s) > c).alias(f"{s}_{j}") for s, j, c in grid]))
    tests = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(c).alias("cutoff"), F.col(f"{s}_{j}").alias("k")) for s, j, c in grid])
    long = wide.select("_stratum", "n", F.explode(tests).alias("t")).select("_stratum", "n", "t.*")
    n_strata = max(1, wide.count())
    level = error / (n_strata * len(grid))
    proven = long.where(binomial_tail(F.col("k"), F.col("n"), share) <= level)
    return proven.groupBy("_stratum").agg(*[F.min(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"cut_{s}") for s in SIGNALS])


def joint_cutoffs(labelled: DataFrame, false_rejection: float = 0.02, error: float = 0.05) -> DataFrame:
    """A row for each stratum with enough labels, and one with a null _stratum for all labels pooled.

    labelled as in proven_cutoffs. The cutoffs (null: none) are those of the strictest proven joint
    rule. A rule's false rejections only grow along ORDER, so the last proven one ends the sequence.
    Only strata whose labels could prove a rule at all share the error, with the pool.
    """
    grid = [(t, s, SIGNALS[s][2] * (j + 1) / CUTOFFS) for t, (s, j) in enumerate(ORDER)]
    first = F.array_min(F.array(*[F.when(_ratio(s) > c, F.lit(t)) for t, s, c in grid]))
    seen = labelled.select("_stratum", first.alias("_first"))
    by_rule = [F.count_if(F.col("_first") <= t).alias(f"k{t}") for t, _, _ in grid]
    wide = cut(seen.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n"), *by_rule))
    least = math.log(error) / math.log1p(-false_rejection)
    level = error / (1 + wide.where(F.col("n") >= least).count())
    able = wide.where(F.col("n") >= math.log(level) / math.log1p(-false_rejection))
    names = ["n", *[f"k{t}" for t, _, _ in grid]]
    pool = wide.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names]).select(F.lit(None).cast("string").alias("_stratum"), *names)
    tests = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"k{t}").alias("k")) for t, _, _ in grid])
    long = able.unionByName(pool).select("_stratum", "n", F.explode(tests).alias("x")).select("_stratum", "n", "x.*")
    proven = F.max(F.when(binomial_tail(F.col("k"), F.col("n"), false_rejection) <= level, F.col("t"))).alias("t")

    def cutoff(signal):
        steps = [[c for u, s, c in grid if s == signal and u <= t] for t, _, _ in grid]
        return F.get(F.array(*[F.lit(min(x, default=None)).cast("double") for x in steps]), F.col("t")).alias(f"cut_{signal}")

    return long.groupBy("_stratum").agg(proven).select("_stratum", *[cutoff(s) for s in SIGNALS])


def quality_filter(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
    keep: list[str] | None = None,
    false_rejection: float = 0.02,
    error: float = 0.05,
    max_strata: int = 100_000,
    reread: bool = False,
) -> DataFrame:
    """Add the counts, base_failed and kept to each document; rows are never dropped.

    base_failed: under 50 words, or more than half of the words in repeated 3-word windows. kept:
    not base_failed, and no signal above its cutoff in the stratum's proven joint rule; strata with
    too few labels to prove one take the rule that all labels together prove. labels (id, quality): a
    document is a good one if all its labels say 1; null labels and unknown ids do not count. A
    null stratum is a stratum of its own, apart from the blank one. Null and empty texts fail the base
    rules. Repeated rows are judged alike; input columns with the names of new ones are replaced, others
    may have any names. The texts are read once and the kept columns and counts go through a
    checkpoint; with reread they are counted twice instead, for when texts are to be kept. The
    cutoffs, a row a stratum, are broadcast up to max_strata.
    """
    new = [*COUNTS, "base_failed", "kept"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in new]
    stratum = F.coalesce(F.concat(F.lit("="), col(stratum_col).cast("string")), F.lit("null"))
    source = docs.select(*set_apart(kept), col(id_col).alias("_id"), stratum.alias("_stratum"), col(text_col).alias("_text"))
    counts = text_counts(source, "_text").drop("_text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = counts.withColumn("base_failed", failed)
    counts = counts if reread else cut(counts)
    named = labels.select(col(label_id_col).alias("_label_id"), col(label_col).alias("_label")).where("_label_id is not null and _label is not null")
    good = named.groupBy("_label_id").agg(F.min("_label").alias("_good")).where("_good = 1")
    labelled = counts.where("not base_failed").join(good, F.col("_id") == F.col("_label_id"), "left_semi")
    cutoffs = cut(joint_cutoffs(labelled, false_rejection, error))
    pool = cutoffs.where("_stratum is null").first()
    own = cutoffs.where("_stratum is not null").withColumn("_own", F.lit(True))
    if own.count() <= max_strata:
        own = F.broadcast(own)
    rejected = F.lit(False)
    for s in SIGNALS:
        cutoff = F.when(F.col("_own"), F.col(f"cut_{s}")).otherwise(F.lit(pool[f"cut_{s}"]).cast("double"))
        rejected = rejected | F.coalesce(_ratio(s) > cutoff, F.lit(False))
    judged = counts.join(own, "_stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)
    return judged.select(*put_back(kept), *new)
