"""Queries: summaries, breakdowns by K, lineage and inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import reports as R
from corvane.operators import catalog as K
from corvane.plans import bindings as B
from corvane.plans.registry import query

WIDE = ["duration", "entry_peak"]


@query(f"""WITH {B.FEAT}, g AS (SELECT unnest([0, 1, 2, 3, 4]) AS cluster) SELECT CAST(g.cluster AS INTEGER) AS cluster, count(source_file) AS n, 100 * count(source_file) / sum(count(source_file)) OVER () AS percent,
 round(avg(duration), 6) AS duration_mean, round(stddev_pop(duration), 6) AS duration_std, median(duration) AS duration_median, round(avg(entry_peak), 6) AS entry_peak_mean, round(stddev_pop(entry_peak), 6) AS entry_peak_std, median(entry_peak) AS entry_peak_median
 FROM g LEFT JOIN feat ON feat.cluster = g.cluster GROUP BY g.cluster""")
def cluster_summary(spark, sf_dir):
    out = R.cluster_summary(B.feat(spark, sf_dir), "cluster", WIDE, 5)
    return out.withColumns({f"{c}_{s}": F.round(f"{c}_{s}", 6) for c in WIDE for s in ("mean", "std")})


@query(f"""WITH {B.FEAT} SELECT source_file, cluster, count(*) AS n, 100 * count(*) / sum(count(*)) OVER (PARTITION BY source_file) AS percent FROM feat GROUP BY 1, 2""")
def counts_by_file(spark, sf_dir):
    return R.counts_by_file(B.feat(spark, sf_dir), "source_file", "cluster")


@query(f"""WITH {B.LABELS}, g AS (SELECT k, CAST(unnest(range(0, k)) AS INTEGER) AS cluster FROM (SELECT unnest([1, 2, 3, 4]) AS k)), c AS (SELECT k, cluster, count(*) AS n FROM lab GROUP BY 1, 2)
SELECT g.k, g.cluster, coalesce(n, 0) AS n, 100 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.k) AS percent, g.k = 3 AS recommended, g.k = 4 AS best_bic FROM g LEFT JOIN c ON c.k = g.k AND c.cluster = g.cluster""")
def k_breakdown(spark, sf_dir):
    return R.k_breakdown(B.labels(spark, sf_dir), 4, 4, 3)


@query(f"""WITH {B.LABELS} SELECT cluster, count(CASE WHEN k = 1 THEN 1 END) AS k1, count(CASE WHEN k = 2 THEN 1 END) AS k2, count(CASE WHEN k = 3 THEN 1 END) AS k3, count(CASE WHEN k = 4 THEN 1 END) AS k4 FROM lab GROUP BY 1""")
def k_breakdown_wide(spark, sf_dir):
    return R.k_breakdown_wide(B.labels(spark, sf_dir), 4)


@query(f"""WITH {B.LABELS} SELECT k, cluster, count(*) AS n, round(avg(duration), 6) AS duration_mean, round(avg(size), 6) AS size_mean, 100 * count(*) / sum(count(*)) OVER (PARTITION BY k) AS percent FROM lab GROUP BY 1, 2""")
def all_k_stats(spark, sf_dir):
    out = R.all_k_stats(B.labels(spark, sf_dir), ["duration", "size"])
    return out.withColumns({c: F.round(c, 6) for c in ("duration_mean", "size_mean")})


OVER = f"""{B.LABELS}, ov AS (SELECT a.k, a.cluster AS parent, b.cluster AS child, count(*) AS n FROM lab a JOIN lab b ON a.id = b.id AND b.k = a.k + 1 GROUP BY 1, 2, 3)"""


@query(f"WITH {OVER} SELECT * FROM ov")
def cluster_overlap(spark, sf_dir):
    return R.cluster_overlap(B.labels(spark, sf_dir))


PARENTS = f"""{OVER}, par AS (SELECT k + 1 AS k, child AS cluster, parent, n AS shared FROM (SELECT *, row_number() OVER (PARTITION BY k, child ORDER BY n DESC, parent) AS r FROM ov) WHERE r = 1)"""


@query(f"WITH {PARENTS} SELECT * FROM par")
def cluster_parents(spark, sf_dir):
    return R.cluster_parents(R.cluster_overlap(B.labels(spark, sf_dir)))


LEVELS = ", ".join(
    f"""l{k} AS (SELECT h.k, h.cluster, row_number() OVER (ORDER BY l.place, h.n DESC, h.cluster) AS place,
 CASE WHEN row_number() OVER (PARTITION BY h.parent ORDER BY h.shared DESC, h.cluster) = 1 THEN l.lineage ELSE h.k || '.' || h.cluster END AS lineage FROM nodes h JOIN l{k - 1} l ON l.cluster = h.parent WHERE h.k = {k})"""
    for k in (2, 3, 4)
)


@query(f"""WITH {PARENTS}, nodes AS (SELECT s.k, s.cluster, n, parent, shared FROM (SELECT k, cluster, count(*) AS n FROM lab GROUP BY 1, 2) s LEFT JOIN par ON par.k = s.k AND par.cluster = s.cluster),
l1 AS (SELECT k, cluster, 1 AS place, '1.' || cluster AS lineage FROM nodes WHERE k = 1), {LEVELS} SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4""")
def cluster_lineage(spark, sf_dir):
    return R.cluster_lineage(B.labels(spark, sf_dir), 4)


@query(f"WITH {B.LABELS} SELECT k, cluster, count(*) AS n FROM lab WHERE id IN (SELECT id FROM lab WHERE k = 3 AND cluster = 1) GROUP BY 1, 2")
def cluster_tracking(spark, sf_dir):
    return R.cluster_tracking(B.labels(spark, sf_dir), 3, 1)


@query(f"""WITH {B.FEAT}, f AS (SELECT cluster, 'duration' AS feature, duration AS v FROM feat UNION ALL SELECT cluster, 'base', base FROM feat), q AS (SELECT cluster, feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM f WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT f.cluster, f.feature, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, min(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END) AS low, max(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END) AS high,
 count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers FROM f JOIN q USING (cluster, feature) WHERE v IS NOT NULL GROUP BY ALL""")
def feature_boxes(spark, sf_dir):
    out = R.feature_boxes(B.feat(spark, sf_dir), "cluster", ["duration", "base"])
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(f"""WITH {B.SIG}, p AS (SELECT key, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM sig GROUP BY 1) SELECT key, round(a - CASE WHEN a = b THEN 1 ELSE 0.2 * (b - a) END, 6) AS low, round(b + CASE WHEN a = b THEN 1 ELSE 0.2 * (b - a) END, 6) AS high FROM p""")
def robust_range(spark, sf_dir):
    return R.robust_range(B.sig(spark, sf_dir), "key", "v").select("key", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH r AS (SELECT l_suppkey % 7 AS label, row_number() OVER (ORDER BY count(*) DESC, l_suppkey % 7) - 1 AS cluster FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, cluster FROM lineitem JOIN r ON label = l_suppkey % 7""")
def rank_clusters(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem").withColumn("label", F.col("l_suppkey") % 7)
    return R.rank_clusters(li, "label").select("l_orderkey", "l_linenumber", "l_partkey", "cluster")


@query(f"""WITH {B.FEAT} SELECT source_file, source_row, coalesce(duration, (SELECT median(duration) FROM feat)) AS duration FROM feat""")
def impute_median(spark, sf_dir):
    return R.impute_median(B.feat(spark, sf_dir).select("source_file", "source_row", "duration"), ["duration"])


@query("""SELECT k, bic FROM (SELECT p_size AS k, round(avg(p_retailprice), 6) AS bic FROM part GROUP BY 1) ORDER BY bic, k LIMIT 1""")
def best_bic(spark, sf_dir):
    p = B.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("k")).agg(F.round(F.avg("p_retailprice"), 6).alias("bic"))
    return K.best_bic(p)


@query("""WITH r AS (SELECT s_nationkey AS exp_id, count(*) AS recordings, CAST(sum(s_suppkey) AS BIGINT) AS bytes, count(CASE WHEN s_acctbal > 0 THEN 1 END) AS ready FROM supplier GROUP BY 1), s AS (SELECT c_nationkey AS exp_id, count(*) AS sets, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS reports FROM customer GROUP BY 1)
SELECT n_nationkey AS exp_id, coalesce(recordings, 0) AS recordings, coalesce(bytes, 0) AS bytes, coalesce(ready, 0) AS ready, coalesce(sets, 0) AS sets, coalesce(reports, 0) AS reports FROM nation LEFT JOIN r ON r.exp_id = n_nationkey LEFT JOIN s ON s.exp_id = n_nationkey""")
def experiment_stats(spark, sf_dir):
    r = B.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("exp_id"), F.col("s_suppkey").alias("size"), F.when(F.col("s_acctbal") > 0, "ready").otherwise("missing").alias("status"))
    c = B.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("exp_id"), "c_acctbal")
    return K.experiment_stats(B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("exp_id")), r, c, c.where("c_acctbal < 0"))


@query("""SELECT l_orderkey AS set_id, l_suppkey AS recording_id, count(CASE WHEN l_discount <> 0 THEN 1 END) AS live, max(l_shipdate) AS last_edit, count(DISTINCT l_returnflag) AS authors FROM lineitem GROUP BY 1, 2""")
def set_stats(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    events = li.select(F.col("l_orderkey").alias("set_id"), F.col("l_suppkey").alias("recording_id"), (F.col("l_discount") == 0.0).alias("deleted"), F.col("l_shipdate").alias("updated_at"), F.col("l_returnflag").alias("author"))
    return K.set_stats(events, ["set_id", "recording_id"])


@query("""SELECT s_nationkey AS exp_id, count(*) AS files, count(CASE WHEN s_acctbal >= 0 THEN 1 END) AS owned, CAST(sum(CASE WHEN s_acctbal >= 0 THEN s_suppkey ELSE 0 END) AS BIGINT) AS bytes FROM supplier GROUP BY 1""")
def inventory_summary(spark, sf_dir):
    return K.inventory(B.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("exp_id"), (F.col("s_acctbal") >= 0).alias("owned"), F.col("s_suppkey").alias("size")))


@query("""SELECT c_nationkey AS exp_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'other' ELSE c_mktsegment END AS condition, count(*) AS n FROM customer GROUP BY 1, 2""")
def condition_counts(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").withColumn("condition", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(""))
    return K.condition_counts(c.select(F.col("c_nationkey").alias("exp_id"), "condition"))


@query("""SELECT l_returnflag AS table_name, len(list_distinct(list(l_suppkey))) AS n_named, min(l_suppkey) AS first_named FROM lineitem GROUP BY 1""")
def named_files(spark, sf_dir):
    return K.named_files(B.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("table_name"), "l_suppkey"), "table_name", "l_suppkey")
