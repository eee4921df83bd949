"""Queries: matching, pairing, import plans, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import names as N
from corvane.operators import catalog as K
from corvane.operators import edits as D
from corvane.operators import events as E
from corvane.operators import history as H
from corvane.operators import matching as J
from corvane.operators import signal as S
from corvane.plans import bindings as B
from corvane.plans.registry import query
from corvane.storage import new_folder, stored
from corvane.streaming import jobs


def _refs(spark, sf_dir):
    """Messy references to recordings, one in ten to an unknown one."""
    li, n = B.table(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    num = F.lpad(n.cast("string"), 9, "0")
    name = F.when(n % 10 == 3, F.concat(F.lit("unknown_"), num)).when(n % 10 == 4, F.lit("")).otherwise(F.concat(F.lit("C:\\data\\supplier__"), num, F.lit(".ABF")))
    ref = li.select("l_orderkey", "l_linenumber", "l_partkey", name.alias("ref"))
    return N.with_name_key(ref, "ref", "key")


def _keyed_rec(spark, sf_dir):
    return B.rec(spark, sf_dir).withColumn("key", F.regexp_replace(N.name_key(F.col("file_name")), "#", " "))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 10 IN (3, 4) THEN -1 ELSE l_suppkey END AS rec_id FROM lineitem""")
def match_recordings(spark, sf_dir):
    return J.match_recordings(_refs(spark, sf_dir), _keyed_rec(spark, sf_dir), "key", "rec_id", -1).select("l_orderkey", "l_linenumber", "l_partkey", "rec_id")


@query("""SELECT CASE WHEN l_suppkey % 10 = 4 THEN '' ELSE 'unknown_' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') END AS ref, count(*) AS n_rows FROM lineitem WHERE l_suppkey % 10 IN (3, 4) GROUP BY 1""")
def unmatched_refs(spark, sf_dir):
    return J.unmatched_refs(_refs(spark, sf_dir), _keyed_rec(spark, sf_dir), "key", "ref")


@query("""SELECT s_suppkey AS rec_id FROM supplier WHERE s_suppkey % 10 IN (3, 4) OR s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)""")
def orphan_recordings(spark, sf_dir):
    return J.orphans(_keyed_rec(spark, sf_dir), _refs(spark, sf_dir), "key").select("rec_id")


@query("""SELECT s_suppkey AS rec_id, CASE WHEN s_suppkey % 3 = 0 THEN 'rec' || s_suppkey || ' Event.txt' ELSE 'rec' || s_suppkey || '.csv' END AS table_name FROM supplier WHERE s_suppkey % 4 <> 1""")
def pair_by_name(spark, sf_dir):
    s = B.table(spark, sf_dir, "supplier")
    folder, key = F.col("s_nationkey").alias("folder"), F.concat(F.lit("rec"), "s_suppkey").alias("key")
    recs = s.select(F.col("s_suppkey").alias("rec_id"), folder, key)
    n = F.col("s_suppkey")
    plain = s.where(n % 4 != 1).select(folder, key, F.concat(F.lit("rec"), "s_suppkey", F.lit(".csv")).alias("table_name"))
    event = s.where((n % 3 == 0) & (n % 4 != 1)).select(folder, F.regexp_replace(F.concat(F.lit("rec"), "s_suppkey", F.lit(" Event")), "(?i) events?$", "").alias("key"), F.concat(F.lit("rec"), "s_suppkey", F.lit(" Event.txt")).alias("table_name"))
    other = s.where(n % 4 != 1).select(folder, key, F.concat(F.lit("rec"), "s_suppkey", F.lit(".txt")).alias("table_name"))
    return J.pair_by_name(recs, plain.unionByName(event).unionByName(other))


@query("""SELECT s_suppkey AS rec_id, 't' || s_suppkey AS table_name FROM supplier WHERE s_suppkey % 2 = 0""")
def pair_by_content(spark, sf_dir):
    s = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rec_id"), F.concat(F.lit("k"), "s_suppkey").alias("key"))
    one = s.where("rec_id % 2 = 0").select(F.concat(F.lit("t"), "rec_id").alias("table_name"), "key")
    two = s.where("rec_id % 2 = 1").select(F.lit("mixed").alias("table_name"), "key")
    again = s.where("rec_id % 4 = 0").select(F.concat(F.lit("z"), "rec_id").alias("table_name"), "key")
    return J.pair_by_content(s, one.unionByName(one).unionByName(two).unionByName(again))


@query("""SELECT 't' || o_orderkey AS table_name, CASE o_orderkey % 6 WHEN 1 THEN 'unreadable' WHEN 2 THEN 'no file column' WHEN 3 THEN 'several files' WHEN 4 THEN 'not in folder' ELSE 'duplicate' END AS reason FROM orders WHERE o_orderkey % 6 <> 0""")
def unused_tables(spark, sf_dir):
    k = F.col("o_orderkey")
    o = B.table(spark, sf_dir, "orders").select(F.concat(F.lit("t"), "o_orderkey").alias("table_name"), (k % 6 != 1).alias("readable"), (k % 6 != 2).alias("has_column"), F.when(k % 6 == 3, 2).otherwise(1).alias("n_named"), (k % 6 != 4).alias("in_folder"), k)
    return J.unused_reasons(o, o.where(k % 6 == 0).select("table_name"))


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT c_name AS name, 'E' || c_custkey % 30 AS experiment, s_suppkey IS NOT NULL AS exists, s_suppkey IS NOT NULL AND coalesce(n, 0) <> 600 AS differs, s_suppkey IS NULL AS selected
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND s_nationkey = c_custkey % 30 LEFT JOIN c ON l_suppkey = s_suppkey""")
def import_plan(spark, sf_dir):
    files = B.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("key"), F.concat(F.lit("E"), F.col("c_custkey") % 30).alias("experiment"), F.lit(600).alias("n_events"))
    experiments = B.table(spark, sf_dir, "nation").select(F.concat(F.lit("E"), "n_nationkey").alias("experiment"), F.col("n_nationkey").alias("exp_id"))
    recs = B.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("exp_id"), F.col("s_suppkey").alias("key"), F.col("s_suppkey").alias("rec_id"))
    events = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rec_id"))
    return J.import_plan(files, experiments, recs, events)


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT 'E' || c_custkey % 30 AS experiment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'other' ELSE c_mktsegment END AS condition, s_suppkey IS NOT NULL AS e, s_suppkey IS NOT NULL AND coalesce(n, 0) <> 600 AS d FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND s_nationkey = c_custkey % 30 LEFT JOIN c ON l_suppkey = s_suppkey),
g AS (SELECT experiment, condition, count(*) AS n FROM f GROUP BY 1, 2)
SELECT f.experiment, count(*) AS n_files, count(CASE WHEN NOT e THEN 1 END) AS n_selected, count(CASE WHEN e THEN 1 END) AS n_exists, count(CASE WHEN d THEN 1 END) AS n_differs, (SELECT string_agg(condition || ':' || n, ',' ORDER BY condition) FROM g WHERE g.experiment = f.experiment) AS conditions FROM f GROUP BY 1""")
def plan_by_experiment(spark, sf_dir):
    conditions = B.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("condition"))
    grouped = J.plan_by_experiment(import_plan(spark, sf_dir).join(conditions, "name"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("conditions")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return grouped.withColumn("conditions", text)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 10 IN (3, 4) THEN NULL ELSE s_nationkey END AS exp_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")
def route_rows(spark, sf_dir):
    return J.route_rows(_refs(spark, sf_dir), _keyed_rec(spark, sf_dir), "key").select("l_orderkey", "l_linenumber", "l_partkey", "exp_id")


@query("""WITH n AS (SELECT c_nationkey AS exp_id, 's' || c_custkey % 40 AS stem, c_name AS file_name, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 40 ORDER BY c_name) AS n FROM customer)
SELECT n.exp_id, n.stem, file_name, CASE WHEN n > 1 THEN 'reject: repeated in batch' WHEN s.s_suppkey IS NULL THEN 'insert' WHEN s.s_suppkey % 2 = 0 THEN 'update' ELSE 'reject: already there' END AS action
FROM n LEFT JOIN (SELECT s_nationkey, 's' || s_suppkey % 40 AS stem, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1, 2) s ON s.s_nationkey = exp_id AND s.stem = n.stem""")
def register_recordings(spark, sf_dir):
    new = B.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("exp_id"), F.concat(F.lit("s"), F.col("c_custkey") % 40).alias("stem"), F.col("c_name").alias("file_name"))
    s = B.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("exp_id"), F.concat(F.lit("s"), F.col("s_suppkey") % 40).alias("stem")).agg(F.min("s_suppkey").alias("k"))
    return J.register_recordings(new, s.select("exp_id", "stem", F.when(F.col("k") % 2 == 0, "missing").otherwise("ready").alias("status")))


@query("""WITH n AS (SELECT c_nationkey AS exp_id, 's' || c_custkey % 40 AS stem, c_name AS file_name, c_mktsegment AS condition, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 40 ORDER BY c_name) AS n FROM customer),
k AS (SELECT min(s_suppkey) AS rec_id, s_nationkey AS exp_id, 's' || s_suppkey % 40 AS stem FROM supplier GROUP BY 2, 3), known AS (SELECT *, 'old' AS file_name, CASE WHEN rec_id % 2 = 0 THEN 'missing' ELSE 'ready' END AS status, 'e' AS error, 'DC' AS condition FROM k),
i AS (SELECT n.* FROM n LEFT JOIN known k ON k.exp_id = n.exp_id AND k.stem = n.stem WHERE n = 1 AND k.rec_id IS NULL)
SELECT k.rec_id, k.exp_id, k.stem, CASE WHEN u THEN n.file_name ELSE k.file_name END AS file_name, CASE WHEN u THEN 'pending' ELSE status END AS status, CASE WHEN u THEN NULL ELSE error END AS error, CASE WHEN u THEN n.condition ELSE k.condition END AS condition FROM (SELECT *, status = 'missing' AS m FROM known) k LEFT JOIN (SELECT *, TRUE AS hit FROM n WHERE n = 1) n ON n.exp_id = k.exp_id AND n.stem = k.stem, LATERAL (SELECT coalesce(hit AND m, FALSE) AS u)
UNION ALL SELECT 10000 + row_number() OVER (ORDER BY exp_id, stem) - 1, exp_id, stem, file_name, 'pending', NULL, condition FROM i""")
def registered(spark, sf_dir):
    """The table after the registration, done twice: the second time changes nothing."""
    new = B.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("exp_id"), F.concat(F.lit("s"), F.col("c_custkey") % 40).alias("stem"), F.col("c_name").alias("file_name"), F.col("c_mktsegment").alias("condition"))
    s = B.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("exp_id"), F.concat(F.lit("s"), F.col("s_suppkey") % 40).alias("stem")).agg(F.min("s_suppkey").alias("rec_id"))
    known = s.select("rec_id", "exp_id", "stem", F.lit("old").alias("file_name"), F.when(F.col("rec_id") % 2 == 0, "missing").otherwise("ready").alias("status"), F.lit("e").alias("error"), F.lit("DC").alias("condition"))
    once = stored(J.registered(new, known, 10000))
    return J.registered(new, once, 20000)


def _exclusions(f):
    return f.where("cluster = 1 and duration > 25").select("source_file", "source_row")


@query(f"WITH {B.FEAT} SELECT source_file, source_row, duration FROM feat f WHERE NOT EXISTS (SELECT 1 FROM feat x WHERE x.cluster = 1 AND x.duration > 25 AND x.source_file = f.source_file AND x.source_row = f.source_row)")
def exclude_points(spark, sf_dir):
    f = B.feat(spark, sf_dir)
    return K.exclude_points(f, _exclusions(f), ["source_file", "source_row"]).select("source_file", "source_row", "duration")


@query(f"""WITH {B.EV}, {B.REC} SELECT set_id % 3 AS run, 'set ' || set_id AS set_name, file_name, number, CASE WHEN id % 4 = 1 AND set_id % 3 = 0 THEN 'C1 (long)' ELSE 'C' || id % 4 END AS label FROM ev JOIN rec ON rec_id = recording_id AND recording_id % 7 <> 0
UNION ALL SELECT set_id % 3, 'set ' || set_id, NULL, number, CASE WHEN id % 4 = 1 AND set_id % 3 = 0 THEN 'C1 (long)' ELSE 'C' || id % 4 END FROM ev WHERE recording_id % 7 = 0""")
def labels_export(spark, sf_dir):
    ev = B.ev(spark, sf_dir).withColumn("event", F.xxhash64("set_id", "recording_id", "id", "number", "deleted"))
    events = ev.select("event", "set_id", F.col("recording_id").alias("rec_id"), "number").distinct()
    labels = ev.select(F.pmod("set_id", F.lit(3)).alias("run"), "event", F.pmod("id", F.lit(4)).alias("cluster"))
    names = spark.createDataFrame([(0, 1, "long"), (1, 2, " ")], "run long, cluster long, name string")
    sets = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("set_id"), F.concat(F.lit("set "), "o_orderkey").alias("set_name"))
    return K.labels_export(labels, events, sets, B.rec(spark, sf_dir).where("rec_id % 7 <> 0"), names)


@query(f"""WITH {B.REC} SELECT conv_id AS event, turn AS at, role AS action, CASE WHEN c_custkey IS NOT NULL THEN c_custkey % 9 END AS number, file_name FROM conversations LEFT JOIN customer ON c_custkey = conv_id AND c_custkey % 5 <> 0 LEFT JOIN rec ON rec_id = c_custkey % 10 + 1""")
def edit_history(spark, sf_dir):
    n = F.col("c_custkey")
    events = B.table(spark, sf_dir, "customer").where(n % 5 != 0).select(n.alias("event"), (n % 9).alias("number"), (n % 10 + 1).alias("rec_id"))
    log = B.log(spark, sf_dir).select("event", "at", F.col("role").alias("action"))
    return K.edit_history(log, events, B.rec(spark, sf_dir)).select("event", "at", "action", "number", "file_name")


@query("""SELECT n_nationkey AS exp_id, n_name FROM nation WHERE n_regionkey <> 0 OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 7)""")
def visible_experiments(spark, sf_dir):
    n = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("exp_id"), "n_name", (F.col("n_regionkey") == 0).alias("restricted"))
    access = B.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("exp_id"), F.col("c_custkey").alias("user"))
    return K.visible_experiments(n, access, 7).drop("restricted")


@query("""WITH r AS (SELECT user_id AS run, unnest([user_id % 25, (user_id + 7) % 25]) AS set_id, unnest([0, 1]) AS p FROM (SELECT DISTINCT user_id FROM events))
SELECT run, string_agg(n_name, ', ' ORDER BY p) AS names, count(CASE WHEN n_nationkey = 3 THEN 1 END) > 0 AS uses FROM r JOIN nation ON n_nationkey = set_id GROUP BY run""")
def runs_using_set(spark, sf_dir):
    users = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("run")).distinct()
    runs = users.withColumn("set_ids", F.to_json(F.array(F.col("run") % 25, (F.col("run") + 7) % 25)))
    sets = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("set_id"), F.col("n_name").alias("set_name"))
    return K.runs_with_set_names(runs, sets, 3)


@query("""SELECT 's' || s_suppkey % 60 AS stem, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS experiments, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def files_used_in(spark, sf_dir):
    files = B.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") % 60).alias("stem"), F.col("s_nationkey").alias("exp_id"))
    return K.files_used_in(files, B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("exp_id"), F.col("n_name").alias("exp_name")))


@query(f"""WITH {B.LABELS}, names AS (SELECT 3 AS k, 1 AS cluster, 'long' AS name) SELECT lab.k, lab.cluster, CASE WHEN name IS NULL THEN 'C' || lab.cluster ELSE 'C' || lab.cluster || ' (' || name || ')' END AS label, count(*) AS n FROM lab LEFT JOIN names USING (k, cluster) GROUP BY 1, 2, 3""")
def cluster_names(spark, sf_dir):
    from corvane.operators.reports import exploded_labels

    rows = exploded_labels(B.labels(spark, sf_dir))
    names = spark.createDataFrame([(3, 1, "long")], "k int, cluster int, name string")
    counts = rows.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return K.cluster_names(counts, names, ["k", "cluster"]).select("k", "cluster", "label", "n")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + o AS event_start FROM lineitem JOIN (SELECT s_suppkey, coalesce(sum(1 + abs(s_acctbal)) OVER (PARTITION BY s_nationkey ORDER BY upper(s_name) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM supplier) ON l_suppkey = s_suppkey""")
def shift_to_experiment_time(spark, sf_dir):
    offsets = S.recording_offsets(B.rec(spark, sf_dir), "exp_id", "file_name", "duration")
    li = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("rec_id"), F.col("l_quantity").alias("event_start"))
    return E.shift_times(li, offsets, ["event_start"]).drop("rec_id")


@query("""WITH f AS (SELECT 'a.csv' AS source_file, l_quantity AS duration, l_tax AS osc, NULL::DOUBLE AS ref_osc, row_number() OVER (ORDER BY l_quantity, l_tax, l_discount) - 1 AS source_row FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT 'rest.csv', l_quantity, NULL, l_discount, row_number() OVER (ORDER BY l_quantity, l_discount) - 1 FROM lineitem WHERE l_returnflag <> 'A') SELECT * FROM f""")
def pool_files(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    a = li.where("l_returnflag = 'A'").select(F.col("l_quantity").alias("duration"), F.col("l_tax").alias("osc"))
    b = li.where("l_returnflag <> 'A'").select(F.col("l_quantity").alias("duration"), F.col("l_discount").alias("ref_osc"))
    pooled = K.pool_files({"a.csv": a}, ["duration", "osc"])
    return pooled.unionByName(K.pool_files({"rest.csv": b}, ["duration", "ref_osc"]), allowMissingColumns=True)


@query("SELECT unnest(['duration', 'entry_peak', 'exit_peak']) AS feature")
def common_features(spark, sf_dir):
    f = B.feat(spark, sf_dir).withColumn("same", F.lit(1.0))
    found = K.common_features(f.where("source_file = 'A'"), f.where("source_file = 'N'"), "source_file", ["duration", "entry_peak", "same", "exit_peak"])
    return f.limit(1).select(F.explode(F.array(*map(F.lit, found))).alias("feature"))


@query(f"""WITH {B.FEAT} SELECT CASE WHEN source_file = 'A' THEN 'A' ELSE 'B' END AS grp, cluster, count(*) AS n, round(avg(duration), 6) AS duration_mean FROM feat WHERE source_file IN ('A', 'N') GROUP BY 1, 2""")
def compare_groups(spark, sf_dir):
    f = B.feat(spark, sf_dir)
    both = K.side_by_side(f.where("source_file = 'A'"), f.where("source_file = 'N'"))
    return both.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 6).alias("duration_mean"))


@query("""SELECT conv_id AS run, role AS cluster, name FROM (SELECT conv_id, role, max_by(CASE WHEN length(text) % 5 = 0 THEN '' ELSE role || ' ' || length(text) END, turn) AS name FROM conversations GROUP BY 1, 2) WHERE name <> ''""")
def upsert_names(spark, sf_dir):
    log = B.log(spark, sf_dir)
    edits = log.select(F.col("event").alias("run"), F.col("role").alias("cluster"), F.when(F.col("size") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "role", F.lit("   "), "size")).alias("name"), "at")
    current = log.where("at = 0").select(F.col("event").alias("run"), F.col("role").alias("cluster"), F.lit("old").alias("name"))
    return H.upsert_names(current, edits, ["run", "cluster"])


@query("""SELECT o_orderkey % 5 AS run, o_orderkey AS event, o_custkey AS recording, CAST(CASE WHEN o_orderkey % 5 = 2 THEN o_orderkey % 3 ELSE o_orderkey % 2 END AS INTEGER) AS cluster FROM orders WHERE o_orderkey % 5 <> 3""")
def run_labels(spark, sf_dir):
    """All runs are written, then run 2 again with other labels (twice) and run 3 without any."""
    path = new_folder(spark, "labels")
    o = B.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("run"), F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("recording"))
    H.replace_run_labels(o.withColumn("cluster", (F.col("event") % 2).cast("int")), o.select("run"), path)
    again = o.where("run = 2").withColumn("cluster", (F.col("event") % 3).cast("int"))
    for _ in range(2):
        H.replace_run_labels(again, o.where("run in (2, 3)").select("run"), path)
    return H.run_labels(spark, path)


@query(f"""WITH {B.EV} SELECT 99999 AS set_id, recording_id, number, 7000000 + row_number() OVER (ORDER BY id, recording_id) - 1 AS id, deleted FROM ev WHERE set_id = 7 AND NOT deleted""")
def copy_set(spark, sf_dir):
    return H.copy_set(B.ev(spark, sf_dir), 7, 99999, 7000000, ["id", "recording_id"])


@query(f"""WITH {B.EV} SELECT 7000000 + row_number() OVER (ORDER BY id, recording_id) - 1 AS event, 99999 AS set_id, 'copy' AS action, 'me' AS username, 12.5 AS at, CASE WHEN number IS NULL THEN '{{}}' ELSE '{{"number":' || number || '}}' END AS after_json FROM ev WHERE set_id = 7 AND NOT deleted""")
def copy_log(spark, sf_dir):
    """The log rows of the copied events."""
    return H.insert_log(copy_set(spark, sf_dir), "copy", "me", 12.5, ["number"])


@query(f"WITH {B.FEAT} SELECT DISTINCT source_file, source_row FROM feat WHERE cluster IN (0, 2) OR (cluster = 1 AND duration > 25)")
def exclude_clusters(spark, sf_dir):
    f = B.feat(spark, sf_dir)
    return H.exclude_clusters(f, [0, 2], _exclusions(f), ["source_file", "source_row"])


@query(f"""WITH {B.FEAT}, m AS (SELECT DISTINCT source_file, source_row FROM feat WHERE cluster IN (0, 1)), b AS (SELECT DISTINCT source_file, source_row FROM feat WHERE cluster = 1 AND duration > 25)
SELECT '0,1' AS clusters, (SELECT count(*) FROM m) AS members, (SELECT count(*) FROM (SELECT * FROM m EXCEPT SELECT * FROM b)) AS n_new, (SELECT count(*) FROM (SELECT * FROM m UNION SELECT * FROM b)) AS total""")
def exclusion_log(spark, sf_dir):
    f = B.feat(spark, sf_dir)
    return H.exclusion_log(f, [1, 0], _exclusions(f), ["source_file", "source_row"]).withColumn("clusters", F.array_join(F.col("clusters").cast("array<string>"), ","))


@query("""WITH old AS (SELECT l_suppkey AS rec_id, l_orderkey AS id, l_discount = 0 AS deleted FROM lineitem WHERE l_orderkey % 2 = 0), new AS (SELECT l_suppkey AS rec_id, -l_orderkey AS id, FALSE AS deleted FROM lineitem WHERE l_orderkey % 3 = 0),
o AS (SELECT rec_id, count(*) AS n FROM old WHERE NOT deleted GROUP BY 1), n AS (SELECT rec_id, count(*) AS m FROM new GROUP BY 1), take AS (SELECT coalesce(o.rec_id, n.rec_id) AS rec_id FROM o FULL JOIN n ON o.rec_id = n.rec_id WHERE n IS NULL OR (m > 0 AND n <> m))
SELECT rec_id, id, deleted OR rec_id IN (SELECT rec_id FROM take) AS deleted FROM old UNION ALL SELECT * FROM new WHERE rec_id IN (SELECT rec_id FROM take)""")
def reimport_events(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    old = li.where("l_orderkey % 2 = 0").select(F.col("l_suppkey").alias("rec_id"), F.col("l_orderkey").alias("id"), (F.col("l_discount") == 0).alias("deleted"))
    new = li.where("l_orderkey % 3 = 0").select(F.col("l_suppkey").alias("rec_id"), (-F.col("l_orderkey")).alias("id"), F.lit(False).alias("deleted"))
    return H.reimport_events(old, new, "rec_id", True)


@query(f"WITH {B.EV} SELECT * FROM ev WHERE set_id BETWEEN 10 AND 12 AND NOT deleted AND set_id = 11")
def list_events(spark, sf_dir):
    return H.list_events(B.ev(spark, sf_dir), 11)


@query(f"""WITH {B.EV}, m AS (SELECT set_id, recording_id, max(number) AS top FROM ev GROUP BY 1, 2)
SELECT ev.set_id, ev.recording_id, id, deleted, CASE WHEN number IS NOT NULL THEN number ELSE coalesce(top, 0) + row_number() OVER (PARTITION BY ev.set_id, ev.recording_id, number IS NULL ORDER BY id, deleted) END AS number FROM ev JOIN m ON m.set_id = ev.set_id AND m.recording_id = ev.recording_id""")
def number_events(spark, sf_dir):
    ev = B.ev(spark, sf_dir)
    return H.number_events(ev, ev.where("deleted"), ["set_id", "recording_id"], "number", ["id", "deleted"])


@query("""SELECT conv_id AS event, max(turn) AS at, max_by(role, turn) AS role, max_by(length(text), turn) AS size FROM conversations GROUP BY 1""")
def latest_edit(spark, sf_dir):
    return H.latest_edit(B.log(spark, sf_dir), ["event"], ["at"]).select("event", "at", "role", "size")


@query("""SELECT set_id, count(DISTINCT CASE WHEN role = 'user' THEN turn // 2 END) + count(CASE WHEN role <> 'user' THEN 1 END) AS revision FROM (SELECT conv_id % 50 AS set_id, turn, role FROM conversations) GROUP BY 1""")
def set_revisions(spark, sf_dir):
    log = B.log(spark, sf_dir)
    rows = log.select((F.col("event") % 50).alias("set_id"), F.floor(F.col("at") / 2).alias("at"), F.when(F.col("role") == "user", "create").otherwise("update").alias("action"))
    return H.set_revisions(rows)


@query("""WITH g AS (SELECT conv_id AS event, min(CASE WHEN role = 'user' AND turn > 1 THEN turn END) AS gone FROM conversations GROUP BY 1),
f AS (SELECT c.conv_id AS event, turn, gone, CASE WHEN turn % 3 <> 2 THEN CAST(length(text) AS VARCHAR) END AS val FROM conversations c JOIN g ON g.event = c.conv_id WHERE gone IS NULL OR turn <= gone)
SELECT event, count(*) AS version, bool_or(gone IS NOT NULL) AS deleted, (list(val ORDER BY turn DESC))[1] AS size FROM f GROUP BY 1""")
def fold_history(spark, sf_dir):
    log = B.log(spark, sf_dir)
    value = F.when(F.col("at") % 3 != 2, F.col("size").cast("string"))
    rows = log.select("event", "at", F.when((F.col("role") == "user") & (F.col("at") > 1), "delete").otherwise("update").alias("action"), F.create_map(F.lit("size"), value, F.col("role"), value).alias("changes"))
    return H.fold_history(rows).select("event", "version", "deleted", F.col("state")["size"].alias("size"))


#: Edits out of conversations: each event is made by its first turn; some later ones are stale, unchecked, empty or deletes.
FOLD = """WITH RECURSIVE e AS (SELECT conv_id AS event, turn AS edit, CASE WHEN turn = 0 THEN 'create' WHEN turn % 7 = 6 THEN 'delete' ELSE 'update' END AS action, CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 5 = 4 THEN 1 ELSE turn END AS expected, turn % 3 AS kind, CAST(length(text) AS VARCHAR) AS size FROM conversations),
x AS (SELECT event, edit, TRUE AS accepted, CAST(NULL AS VARCHAR) AS reason, CAST(1 AS BIGINT) AS version, FALSE AS deleted, size AS event_start, CAST(NULL AS VARCHAR) AS notes, CAST(event AS DOUBLE) AS duration FROM e WHERE edit = 0
UNION ALL SELECT event, edit, code < 2, CASE code WHEN 1 THEN 'nothing to change' WHEN 2 THEN 'deleted' WHEN 3 THEN 'stale' END, version + CASE WHEN code = 0 THEN 1 ELSE 0 END, deleted OR (code = 0 AND action = 'delete'),
CASE WHEN code = 0 AND action = 'update' AND kind = 0 THEN size ELSE event_start END, CASE WHEN code = 0 AND action = 'update' AND kind = 1 THEN size ELSE notes END, CASE WHEN code = 0 AND action = 'update' AND kind = 0 THEN NULL ELSE duration END
FROM (SELECT x.event, e.edit, action, kind, size, version, deleted, event_start, notes, duration, CASE WHEN action = 'update' AND kind = 2 THEN 1 WHEN deleted THEN 2 WHEN action = 'update' AND expected IS NOT NULL AND expected <> version THEN 3 ELSE 0 END AS code FROM x JOIN e ON e.event = x.event AND e.edit = x.edit + 1))"""


def _edits(conversations):
    turn, size = F.col("turn"), F.length("text").cast("string")
    action = F.when(turn == 0, "create").when(turn % 7 == 6, "delete").otherwise("update")
    expected = F.when(turn % 4 == 3, F.lit(None)).when(turn % 5 == 4, 1).otherwise(turn).cast("long")
    fields = F.when((turn % 3 == 0) | (turn == 0), F.create_map(F.lit("event_start"), size)).when(turn % 3 == 1, F.create_map(F.lit("notes"), size, F.lit("no_such_field"), size))
    derived = F.when(turn == 0, F.create_map(F.lit("duration"), F.col("conv_id").cast("double")))
    return conversations.select(F.col("conv_id").alias("event"), turn.alias("edit"), action.alias("action"), expected.alias("expected"), fields.alias("fields"), derived.alias("derived"))


def _decisions(decided):
    return decided.select("event", "edit", "accepted", "reason", "version", "deleted", F.col("fields")["event_start"].alias("event_start"), F.col("fields")["notes"].alias("notes"), F.col("derived")["duration"].alias("duration"))


@query(f"{FOLD} SELECT * FROM x")
def apply_edits(spark, sf_dir):
    return _decisions(D.apply_edits(_edits(B.table(spark, sf_dir, "conversations"))))


@query(f"{FOLD} SELECT event, version, deleted, event_start, notes, duration FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY edit DESC) AS r FROM x) WHERE r = 1 UNION ALL SELECT -1 - n_nationkey, 5, n_regionkey = 2, n_name, NULL, 2.5 FROM nation")
def edited_events(spark, sf_dir):
    """The events after the edits, beside events that no edit is for."""
    others = B.table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("event"), F.lit(5).cast("long").alias("version"), (F.col("n_regionkey") == 2).alias("deleted"), F.create_map(F.lit("event_start"), F.col("n_name")).alias("fields"), F.create_map(F.lit("duration"), F.lit(2.5)).alias("derived"))
    after = D.edited_events(others, D.apply_edits(_edits(B.table(spark, sf_dir, "conversations")), others))
    return after.select("event", "version", "deleted", F.col("fields")["event_start"].alias("event_start"), F.col("fields")["notes"].alias("notes"), F.col("derived")["duration"].alias("duration"))


@query(f"{FOLD} SELECT * FROM x")
def stream_edits(spark, sf_dir):
    """The same decisions from a stream of the edits."""
    return _decisions(jobs.run_available(D.stream_edits(_edits(jobs.file_stream(spark, sf_dir, "conversations")))))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def pending_work(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    done = B.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return K.pending_work(o, done, ["o_custkey"])


@query("""SELECT o_orderkey AS run, o_orderdate AS at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def recent_runs(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"))
    return K.recent_runs(o, 20, "F")
