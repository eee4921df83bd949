"""Exact quantiles of any number of groups by histograms that close in on the ranks.

Each round counts, for every wanted rank at once, the values in bins of the range that is left around
it; the rank's bin is the next range. A range with one distinct value is done. Counts are added up
before they are shuffled, so a group may hold any share of the rows and no value list is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.storage import cut

#: Bins of a range and round.
BINS = 4096
#: Ranges that are broadcast at most; beyond, they are joined by shuffle.
MAX_BROADCAST_RANGES = 100_000


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left with the other columns of its group in right, null keys being groups."""
    renamed = right.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(keys)], *[c for c in right.columns if c not in keys])
    joined = F.col(keys[0]).eqNullSafe(F.col("_on0"))
    for i, c in enumerate(keys[1:], 1):
        joined &= F.col(c).eqNullSafe(F.col(f"_on{i}"))
    return left.join(renamed, joined, how).drop(*[f"_on{i}" for i in range(len(keys))])


def exact_quantiles(df: DataFrame, keys: list[str], features: list[str], probabilities: list[float], bins: int = BINS) -> DataFrame:
    """(keys, feature, p, value): the quantiles of each group's features, between two values by their distance.

    As by percentile(): p * (n - 1) is the rank among n values. Null and NaN are no values; a group
    without any in a feature gives no row for it. Null keys are groups. Values are finite doubles.
    """
    named = [f"_key{i}" for i in range(len(keys))]
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("f")
    long = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], one).select(*named, "f.*").where("value is not null and not isnan(value)")
    group = [*named, "feature"]
    whole = long.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    at = lambda p: p * (F.col("n") - 1)
    ranks = [F.struct(F.lit(p).alias("p"), F.lit(side).alias("side"), f(at(F.lit(p))).cast("long").alias("rank"), (at(F.lit(p)) - F.floor(at(F.lit(p)))).alias("part")) for p in probabilities for side, f in ((0, F.floor), (1, F.ceil))]
    wanted = cut(whole.select(*group, "low", "high", F.explode(F.array(*ranks)).alias("r")).select(*group, "low", "high", "r.*"))
    found = None
    while True:
        closed = wanted.where("low = high").select(*group, "p", "side", "part", F.col("low").alias("value"))
        found = closed if found is None else found.unionByName(closed)
        still = wanted.where("low < high")
        ranges = still.select(*group, "low", "high").distinct()
        n_ranges = ranges.count()
        if not n_ranges:
            break
        near = join_groups(long, F.broadcast(ranges) if n_ranges <= MAX_BROADCAST_RANGES else ranges, group, "inner").where(F.col("value").between(F.col("low"), F.col("high")))
        # Halves, so that the width of a range is finite; the tiniest ranges are split at their lower end.
        width = F.col("high") / 2 - F.col("low") / 2
        place = F.when(width > 0, F.floor((F.col("value") / 2 - F.col("low") / 2) / width * bins)).otherwise(F.when(F.col("value") > F.col("low"), bins - 1).otherwise(0))
        counts = near.groupBy(*group, "low", "high", F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("least"), F.max("value").alias("most"))
        before = F.sum("c").over(Window.partitionBy(*group, "low", "high").orderBy("bin")) - F.col("c")
        counts = counts.withColumn("before", before)
        picked = join_groups(still, counts, [*group, "low", "high"], "inner").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
        wanted = cut(picked.select(*group, F.col("least").alias("low"), F.col("most").alias("high"), "p", "side", (F.col("rank") - F.col("before")).alias("rank"), "part"))
    ends = found.groupBy(*group, "p").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("b"), F.max("part").alias("part"))
    value = F.when(F.col("part") == 0, F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    return ends.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], "feature", "p", value.alias("value"))


def wide_quantiles(df: DataFrame, keys: list[str], features: list[str], probabilities: list[float], name) -> DataFrame:
    """One row for each group, with a column name(feature, p) for each quantile; a group without values has nulls."""
    long = exact_quantiles(df, keys, features, probabilities)
    columns: list[Column] = [F.max(F.when((F.col("feature") == c) & (F.col("p") == p), F.col("value"))).alias(name(c, p)) for c in features for p in probabilities]
    return long.groupBy(*keys).agg(*columns)
