"""Tables over clustered events: summaries, breakdowns by K, lineage, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.quantiles import exact_quantiles, join_groups, wide_quantiles
from corvane.storage import cut

#: Rows of a table of groups that are broadcast at most.
MAX_BROADCAST_GROUPS = 100_000


def _small(groups: DataFrame) -> DataFrame:
    """groups, computed once, with a hint to broadcast them if there are not too many."""
    groups = cut(groups)
    return F.broadcast(groups) if groups.count() <= MAX_BROADCAST_GROUPS else groups


def cluster_summary(df: DataFrame, cluster: str, features: list[str], k: int) -> DataFrame:
    """N, percent and mean, population deviation and exact median of each feature for clusters 0..k-1."""
    stats = [f.alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg(c)), ("std", F.stddev_pop(c)))]
    found = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *stats)
    medians = wide_quantiles(df, [cluster], features, [0.5], lambda c, _: f"{c}_median")
    grid = df.sparkSession.range(k).select(F.col("id").cast(df.schema[cluster].dataType).alias(cluster))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # k rows
    out = grid.join(found, cluster, "left").join(medians, cluster, "left")
    out = out.withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("percent", 100 * F.col("n") / F.nullif(total, F.lit(0)))


def counts_by_file(df: DataFrame, file: str, cluster: str) -> DataFrame:
    """Events by file and cluster, and the share within the file."""
    counts = df.groupBy(file, cluster).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(file)))


def exploded_labels(labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per event and k: labels[k - 1] is the cluster among k."""
    return labels.select(*(keep or []), F.posexplode("labels").alias("_p", "cluster")).withColumn("k", F.col("_p") + 1).drop("_p")


def k_breakdown(labels: DataFrame, max_k: int, best_k: int, final_k: int) -> DataFrame:
    """N and percent for each k and cluster, empty ones included, with the chosen ones flagged."""
    counts = exploded_labels(labels).groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("n"))
    spark = labels.sparkSession
    grid = spark.range(1, max_k + 1).select(F.col("id").cast("int").alias("k")).withColumn("cluster", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    full = grid.join(counts, ["k", "cluster"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = 100 * F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("k")), F.lit(0))
    return full.select("k", "cluster", "n", share.alias("percent"), (F.col("k") == final_k).alias("recommended"), (F.col("k") == best_k).alias("best_bic"))


def k_breakdown_wide(labels: DataFrame, max_k: int) -> DataFrame:
    """One row per cluster place, one column per k."""
    wide = exploded_labels(labels).groupBy("cluster").pivot("k", list(range(1, max_k + 1))).agg(F.count(F.lit(1)))
    return wide.select("cluster", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"k{k}") for k in range(1, max_k + 1)])


def all_k_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """Per k and cluster: n, percent of all and feature means."""
    rows = exploded_labels(df, features)
    stats = rows.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in features])
    return stats.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("k")))


def cluster_overlap(labels: DataFrame) -> DataFrame:
    """(k, parent, child, n): events in cluster parent at k and child at k + 1."""
    pairs = F.expr("transform(sequence(1, size(labels) - 1), k -> struct(k AS k, labels[k - 1] AS parent, labels[k] AS child))")
    return labels.where("size(labels) > 1").select(F.explode(pairs).alias("p")).groupBy("p.k", "p.parent", "p.child").agg(F.count(F.lit(1)).alias("n"))


def cluster_parents(overlap: DataFrame) -> DataFrame:
    """The parent that shares most events with each child (lowest on ties), for k + 1."""
    best = F.max_by(F.struct("parent", "n"), F.struct(F.col("n"), -F.col("parent")))
    return overlap.groupBy(F.expr("k + 1").alias("k"), "child").agg(best.alias("b")).select("k", F.col("child").alias("cluster"), F.col("b.parent").alias("parent"), F.col("b.n").alias("shared"))


def cluster_lineage(labels: DataFrame, max_k: int) -> DataFrame:
    """(k, cluster, place, lineage): children stay where their parent is, the largest first, and
    a parent's largest child keeps its lineage; others start one named k.cluster."""
    overlap = cluster_overlap(labels)
    parents = cluster_parents(overlap)
    sizes = exploded_labels(labels).groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("n"))
    nodes = sizes.join(parents, ["k", "cluster"], "left").cache()
    level = nodes.where("k = 1").select("k", "cluster", F.lit(1).alias("place"), F.concat_ws(".", F.lit("1"), "cluster").alias("lineage"))
    out = level
    for k in range(2, max_k + 1):  # tables of at most max_k rows
        above = level.select(F.col("cluster").alias("parent"), F.col("place").alias("above"), F.col("lineage").alias("kept"))
        here = nodes.where(F.col("k") == k).join(above, "parent")
        order = [F.desc("n"), F.asc("cluster")]
        first = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("shared"), "cluster")) == 1
        place = F.row_number().over(Window.partitionBy("k").orderBy("above", *order))
        level = here.select("k", "cluster", place.alias("place"), F.when(first, F.col("kept")).otherwise(F.concat_ws(".", F.col("k").cast("string"), "cluster")).alias("lineage"))
        out = out.unionByName(level)
    return out


def cluster_tracking(labels: DataFrame, k0: int, c0: int) -> DataFrame:
    """Where the members of cluster c0 at k0 are at every k."""
    members = labels.where(F.get("labels", F.lit(k0 - 1)) == c0)
    return exploded_labels(members).groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("n"))


def feature_boxes(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 box lengths) and outliers by cluster and feature."""
    long = df.select(cluster, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features])).alias("f")).select(cluster, "f.*").where("value is not null")
    found = exact_quantiles(df, [cluster], features, [0.25, 0.5, 0.75])
    q = found.groupBy(cluster, "feature").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    joined = join_groups(long, _small(q), [cluster, "feature"], "inner")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(cluster, "feature", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("value"))).alias("low"), F.max(F.when(inside, F.col("value"))).alias("high"), F.count_if(~inside).alias("outliers"))


def robust_range(df: DataFrame, key: str, value: str) -> DataFrame:
    """1st and 99th percentile widened by a fifth of their distance (by 1 if they are equal)."""
    p = wide_quantiles(df, [key], [value], [0.01, 0.99], lambda _, p: "p1" if p == 0.01 else "p99")
    pad = F.when(F.col("p1") == F.col("p99"), 1.0).otherwise(0.2 * (F.col("p99") - F.col("p1")))
    return p.select(key, (F.col("p1") - pad).alias("low"), (F.col("p99") + pad).alias("high"))


def rank_clusters(df: DataFrame, label: str, out: str = "cluster") -> DataFrame:
    """Clusters renumbered by size, the largest 0, ties by old label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranks = counts.withColumn(out, F.row_number().over(Window.orderBy(F.desc("_n"), label)) - 1).drop("_n")  # a row per cluster
    return df.join(_small(ranks), label)


def imputation(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, median, filled): what each feature's missing values become, and how many there are."""
    filled = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"f{i}") for i, c in enumerate(features)])
    each = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"f{i}").alias("filled")) for i, c in enumerate(features)])).alias("x")).select("x.*")
    medians = exact_quantiles(df, [], features, [0.5]).select("feature", F.col("value").alias("median"))
    return each.join(medians, "feature", "left").select("feature", "median", "filled")


def impute_median(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing values replaced by their feature's exact median (null where a feature has no value at all)."""
    medians = {r["feature"]: r["median"] for r in imputation(df, features).collect()}  # a row per feature
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c]).cast("double")) for c in features})
