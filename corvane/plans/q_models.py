"""Queries: sources, sinks, streams, signal helpers, landmarks and mixtures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corvane.functions import dsp
from corvane.operators import mixture as G
from corvane.operators import landmarks as Z
from corvane.operators import smoothing as L
from corvane.operators import windows as W
from corvane.operators import signal as S
from corvane.plans import bindings as B
from corvane.plans.q_signal import ROBUST
from corvane.plans.registry import query
from corvane.sources import files, recordings
from corvane.streaming import jobs


@query("""SELECT 'N_' || n_nationkey AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation UNION ALL SELECT r_name, CAST(r_regionkey AS VARCHAR) FROM region""")
def read_event_files(spark, sf_dir):
    root = jobs._scratch(spark)
    B.table(spark, sf_dir, "nation").select(F.concat(F.lit("N_"), "n_nationkey").alias("name"), F.col("n_regionkey").alias("region")).write.option("header", True).csv(f"{root}/a.csv")
    B.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name")).write.option("header", True).csv(f"{root}/b.csv")
    return files.read_event_files(spark, [f"{root}/a.csv", f"{root}/b.csv"]).select("name", "region")


@query("""SELECT c_custkey AS id, c_name || ' é' AS name FROM customer""")
def read_messy_csv(spark, sf_dir):
    root = jobs._scratch(spark)
    c = B.table(spark, sf_dir, "customer")
    for encoding, odd in (("UTF-8", 0), ("ISO-8859-1", 1)):
        part = c.where(F.col("c_custkey") % 2 == odd).select(F.col("c_custkey").alias(" id "), F.concat("c_name", F.lit(" é")).alias("name"))
        part.write.option("header", True).option("sep", ";").option("encoding", encoding).csv(f"{root}/{odd}")
    rows = files.read_messy_csv(spark, root).where("error is null")
    return rows.select(F.col("values")["id"].cast("long").alias("id"), F.col("values")["name"].alias("name"))


@query()
def list_files(spark, sf_dir):
    return files.list_files(spark, sf_dir, [".parquet"])


@query()
def file_digests(spark, sf_dir):
    return recordings.file_digests(spark, sf_dir, "*.parquet")


def _written(spark, sf_dir):
    """Each user's signal as a file of two sweeps at 10 samples a second."""
    root = jobs._scratch(spark)
    spark.range(0).write.parquet(root)  # makes the folder
    recordings.write_recordings(B.sig(spark, sf_dir), root, 10.0, 0.01, 300.0, 2).count()
    return root


def _key():
    return F.regexp_extract("file", r"([0-9]+)[.]rec$", 1).cast("long").alias("key")


@query(f"WITH {B.SIG}, n AS (SELECT key, count(*) AS n FROM sig GROUP BY 1) SELECT sig.key, i, CAST(least(i // greatest(1, n // 2), 1) AS INTEGER) AS sweep, round(round(v * 100) / 100, 2) AS v FROM sig JOIN n ON n.key = sig.key")
def decode_recordings(spark, sf_dir):
    """The files read in ranges of 64 samples; each sample's sweep by its time."""
    root = _written(spark, sf_dir)
    chunks = recordings.decode_recordings(spark, root, chunk=64)
    rows = chunks.select("file", "i0", "fs", F.posexplode("values").alias("k", "v")).withColumn("i", F.col("i0") + F.col("k"))
    sweeps = recordings.sweeps_of(recordings.recording_headers(spark, root)).where("s1 > s0")
    at = rows.join(sweeps, "file").where((F.col("i") / F.col("fs") >= F.col("s0")) & (F.col("i") / F.col("fs") < F.col("s1")))
    return at.select(_key(), "i", "sweep", F.round(F.col("v").cast("double"), 2).alias("v"))


@query(f"WITH {B.SIG} SELECT key, count(*) AS n, 1 AS channels, 10.0 AS fs, 2 AS sweeps, count(*) / 10.0 AS duration FROM sig GROUP BY 1")
def recording_headers(spark, sf_dir):
    return recordings.recording_headers(spark, _written(spark, sf_dir)).select(_key(), "n", "channels", "fs", "sweeps", "duration")


@query(f"WITH {B.FEAT} SELECT source_file, count(*) AS n, round(sum(base), 2) AS base FROM feat GROUP BY 1")
def write_partitioned(spark, sf_dir):
    root = jobs._scratch(spark)
    files.write_partitioned(B.feat(spark, sf_dir).select("source_file", "source_row", "base"), root, "source_file")
    return spark.read.parquet(root).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("base"), 2).alias("base"))


@query(f"WITH {B.FEAT} SELECT cluster, count(*) AS n FROM feat GROUP BY 1")
def write_results(spark, sf_dir):
    root = jobs._scratch(spark)
    f = B.feat(spark, sf_dir)
    files.write_results({"labels": f.select("source_file", "source_row", "cluster"), "sizes": f.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))}, root, "csv")
    return spark.read.option("header", True).schema("cluster int, n long").csv(f"{root}/sizes")


@query(f"WITH {B.EV} SELECT recording_id AS rec_id, set_id, number, 500 + row_number() OVER (ORDER BY recording_id, id, set_id) - 1 AS id, 'S10 (3)' AS experiment FROM ev WHERE recording_id % 10 <> 3")
def bundle_roundtrip(spark, sf_dir):
    root = jobs._scratch(spark)
    ev, rec = B.ev(spark, sf_dir).withColumnRenamed("recording_id", "rec_id"), B.rec(spark, sf_dir)
    files.export_bundle(ev, rec, root, "S10")
    known = B.table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "S10").when(F.col("r_regionkey") == 1, "S10 (2)").otherwise("S11").alias("experiment"))
    name = files.bundle_experiment(spark, root, known)
    return files.import_bundle(spark, root, rec.where("rec_id % 10 <> 3"), 500).select("rec_id", "set_id", "number", "id", F.lit(name).alias("experiment"))


@query("""WITH e AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS bin FROM events) SELECT event_type AS channel, bin, min(value) AS vmin, max(value) AS vmax, count(*) AS n FROM e WHERE bin + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def stream_envelope(spark, sf_dir):
    e = jobs.file_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), F.col("value").alias("v"))
    return jobs.run_available(jobs.stream_envelope(e, "6 hours", "1 hour"))


@query("SELECT DISTINCT user_id FROM events")
def stream_import(spark, sf_dir):
    path = jobs._scratch(spark)
    B.table(spark, sf_dir, "events").where("user_id < 3").select("user_id").distinct().write.parquet(path)
    for _ in range(2):
        jobs.stream_import(jobs.file_stream(spark, sf_dir, "events").select("user_id"), path, "user_id")
    return spark.read.parquet(path)


LIVE = ROBUST.replace(B.SIG, f"""{B.SIG.replace("sig AS", "whole AS")}, sig AS (SELECT * FROM whole WHERE t <= (SELECT floor(max(t) * 1000) / 1000 - 86400 FROM whole))""")


@query(f"""WITH {LIVE}, f AS (SELECT *, abs(z) >= 1.0 AS f, coalesce(lag(abs(z) >= 1.0) OVER (PARTITION BY key ORDER BY i), FALSE) AS p FROM zz), r AS (SELECT *, sum(CASE WHEN f AND NOT p THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS run, max(t) OVER (PARTITION BY key) AS end FROM f),
g AS (SELECT key, run, count(*) AS n, min(t) AS t_start, max(t) AS t_end FROM r WHERE f GROUP BY 1, 2 HAVING count(*) >= 3 AND max(t) < any_value("end")), b AS (SELECT key, run, t, z, d, row_number() OVER (PARTITION BY key, run ORDER BY abs(z) DESC, i) AS k FROM r WHERE f)
SELECT g.key, b.t, round(b.z, 6) AS z, CASE WHEN b.d > 0 THEN 1 ELSE -1 END AS direction, t_start, t_end, n FROM g JOIN b ON b.key = g.key AND b.run = g.run AND b.k = 1""")
def stream_edges(spark, sf_dir):
    """What the watermark of a day has passed; runs that are still open then are not given out yet."""
    e = jobs.file_stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("v"))
    return jobs.run_available(jobs.stream_edges(e, 2, 20, 1.0, 3, "1 day", 1e9)).withColumn("z", F.round("z", 6))


def _windows(spark, sf_dir):
    """Event windows of up to 65 samples around purchases, 100 a second, as arrays of three channels."""
    s = B.sig(spark, sf_dir)
    w = s.where("kind = 'purchase'").select("event", "key", (F.col("i") - 32.0).alias("t0"), (F.col("i") + 32.0).alias("t1"))
    cut = S.cut_arrays(w, s.select("key", "i", F.col("i").cast("double").alias("t"), "v"), 65.0)
    reference, electrical = F.zip_with("v", "i", lambda v, i: 0.4 * v + i % 3), F.transform("v", lambda v: (v * 7) % 31)
    return cut.select("event", F.transform("i", lambda i: i / 100.0).alias("t"), F.col("v").alias("optical"), reference.alias("reference"), electrical.alias("electrical"))


@query()
def bessel_causal(spark, sf_dir):
    """Chunks of 16 samples at 10 samples a second, so that halos matter."""
    s = B.sig(spark, sf_dir)
    rows = s.groupBy("key", F.floor(F.col("i") / 16).cast("long").alias("chunk_idx")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))  # 16 a chunk
    chunks = rows.select(F.col("key").cast("string").alias("file"), F.lit(0).alias("channel"), "chunk_idx", (F.col("chunk_idx") * 16).alias("i0"), F.lit(10.0).alias("fs"), F.col("s.v").alias("values"))
    return W.causal_chunks(chunks, 8, 2.0, 1.6)


@query()
def zero_phase_lowpass(spark, sf_dir):
    return L.zero_phase(B.sig(spark, sf_dir), 10.0, dsp.butterworth_sections(6, 2.0, 10.0))


@query()
def resample_windows(spark, sf_dir):
    return L.resampled(B.sig(spark, sf_dir), 10.0, 4.0)[0]


@query(f"""WITH {B.SIG}, n AS (SELECT key, max(i) + 1 AS n FROM sig GROUP BY 1), j AS (SELECT key, CAST(unnest(range(0, CAST(floor(n * 3 / 10.0) AS BIGINT))) AS BIGINT) AS j FROM n)
SELECT j.key, 'between' AS kind, j.j AS i, round(a.v + (j.j * 10 / 3.0 - floor(j.j * 10 / 3.0 + 1e-9)) * (coalesce(b.v, a.v) - a.v), 5) AS v FROM j JOIN sig a ON a.key = j.key AND a.i = floor(j.j * 10 / 3.0 + 1e-9) LEFT JOIN sig b ON b.key = j.key AND b.i = a.i + 1
UNION ALL SELECT key, 'every fifth', i // 5, round(v, 5) FROM sig WHERE i % 5 = 0""")
def regrid(spark, sf_dir):
    """From 10 samples a second to 3, between samples, and to 2, every fifth one."""
    s = B.sig(spark, sf_dir)
    both = L.regridded(s, 10.0, 3.0)[0].withColumn("kind", F.lit("between")).unionByName(L.regridded(s, 10.0, 2.0)[0].withColumn("kind", F.lit("every fifth")))
    return both.withColumn("v", F.round("v", 5))


SMALL = {"fs": 100.0, "points": 16, "smooth_fs": 50.0, "fast_ms": 60.0, "slow_ms": 120.0}


@query(f"""WITH {B.SIG}, w AS (SELECT a.event AS key, s.i - max(0) OVER () AS i0, s.v, s.i - min(s.i) OVER (PARTITION BY a.event) AS i FROM sig a JOIN sig s ON s.key = a.key AND s.i BETWEEN a.i - 32 AND a.i + 32 WHERE a.kind = 'purchase'),
k AS (SELECT key, i // 2 AS i, v FROM w WHERE i % 2 = 0), e AS (SELECT w.key, max(w.i) AS last, max(w.i) // 2 AS top FROM w GROUP BY 1), v0 AS (SELECT key, arg_min(v, i) AS a, arg_max(v, i) AS b FROM k GROUP BY 1),
tr AS (SELECT key, 0 AS "row", i, v FROM k UNION ALL SELECT k.key, 1, k.i, (sum(v) OVER (PARTITION BY k.key ORDER BY k.i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + greatest(1 - k.i, 0) * a + greatest(k.i + 1 - top, 0) * b) / 3 FROM k JOIN e ON e.key = k.key JOIN v0 ON v0.key = k.key
UNION ALL SELECT k.key, 2, k.i, (sum(v) OVER (PARTITION BY k.key ORDER BY k.i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(2 - k.i, 0) * a + greatest(k.i + 2 - top, 0) * b) / 5 FROM k JOIN e ON e.key = k.key JOIN v0 ON v0.key = k.key),
g AS (SELECT key, point, least(point * (last / 15) / 2, top) AS x FROM e, (SELECT unnest(range(0, 16)) AS point)), r AS (SELECT g.key, a."row", point, a.v + (x - floor(x)) * (coalesce(b.v, a.v) - a.v) AS x FROM g JOIN tr a ON a.key = g.key AND a.i = floor(x) LEFT JOIN tr b ON b.key = a.key AND b."row" = a."row" AND b.i = a.i + 1 UNION ALL SELECT key, 3, point, point / 15 FROM g),
m AS (SELECT key, "row", median(x) AS med FROM r GROUP BY 1, 2), d AS (SELECT r.*, x - med AS d FROM r JOIN m ON m.key = r.key AND m."row" = r."row"), s AS (SELECT key, "row", median(abs(d)) AS mad FROM d GROUP BY 1, 2)
SELECT d.key, CAST(d."row" AS INTEGER) AS "row", CAST(point AS INTEGER) AS point, round(d / (1e-9 + mad), 4) + 0.0 AS value FROM d JOIN s ON s.key = d.key AND s."row" = d."row" """)
def window_features(spark, sf_dir):
    """The model's input on 16 points, at 50 samples a second."""
    w = _windows(spark, sf_dir).select(F.col("event").alias("key"), F.col("optical").alias("v"))
    return L.window_features(w, **SMALL).withColumn("value", F.round("value", 4) + 0.0)  # no -0.0


@query()
def score_windows(spark, sf_dir):
    """Landmark fractions by a small network; the weights are an argument (here seeded ones)."""
    rng = np.random.default_rng(3)
    weights = {f"conv{i}_w": rng.normal(0, 0.3, (6, 4 if i == 0 else 6, 5)) for i in range(4)} | {f"conv{i}_b": np.zeros(6) for i in range(4)}
    weights |= {"dense0_w": rng.normal(0, 0.3, (8, 6)), "dense0_b": np.zeros(8), "dense1_w": rng.normal(0, 0.3, (3, 8)), "dense1_b": np.zeros(3)}
    w = _windows(spark, sf_dir).select(F.col("event").alias("key"), F.col("optical").alias("v"))
    inputs = L.feature_arrays(w, **SMALL).select("key", "features")  # 64 an event
    score = lambda table: [list(dsp.score_landmarks(np.stack(W.arrays_of(table, "features")).reshape(-1, 4, SMALL["points"]), weights))]
    return W.map_columns(inputs, score, ["fractions"], "array<double>").drop("features")


@query()
def detect_landmarks(spark, sf_dir):
    return Z.detect_landmarks(_windows(spark, sf_dir), 100.0, Z.EdgeConfig(threshold=1.5), fewest=8)


@query()
def electrical_landmarks(spark, sf_dir):
    found = Z.detect_landmarks(_windows(spark, sf_dir), 100.0, Z.EdgeConfig(threshold=1.5), fewest=8)
    return found.select("event", "method", *[f"{m}_{x}" for m in list(Z.MARKS)[3:] for x in ("t", "v")])


@query()
def event_measures(spark, sf_dir):
    return Z.event_measures(Z.detect_landmarks(_windows(spark, sf_dir), 100.0, Z.EdgeConfig(threshold=1.5), fewest=8))


DIMS = ["x0", "x1", "x2", "x3"]
#: The settings of a whole run; with 25 replicates p can be as low as 1 / 26.
RUN = {"max_k": 8, "n_init": 15, "alpha": 0.05, "n_boot": 25}


def _points(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(DIMS)])


@query()
def gmm_sweep(spark, sf_dir):
    p = _points(spark, sf_dir)
    return G.sweep_table(p, G.gmm_sweep(p, DIMS, [1, 2, 3], 2, 30), p.count(), len(DIMS))


@query()
def fit_gmm(spark, sf_dir):
    _, (weights, means, _) = G.gmm_sweep(_points(spark, sf_dir), DIMS, [2], 2, 30)[2]
    return spark.createDataFrame([(c, float(w), [float(x) for x in m]) for c, (w, m) in enumerate(zip(weights, means, strict=True))], "component int, weight double, mean array<double>")


@query()
def assign_clusters(spark, sf_dir):
    p = _points(spark, sf_dir)
    best = G.gmm_sweep(p, DIMS, [1, 2, 3], 2, 20)
    return G.assign_clusters(p, DIMS, {k: m for k, (_, m) in best.items()}).select("vec_id", "labels")


@query()
def bootstrap_lrt(spark, sf_dir):
    p = _points(spark, sf_dir)
    return G.bootstrap_lrt(p, G.gmm_sweep(p, DIMS, [1, 2], 2, 20), p.count(), 9, 2)


@query()
def select_k(spark, sf_dir):
    p = _points(spark, sf_dir)
    tests = G.bootstrap_lrt(p, G.gmm_sweep(p, DIMS, [1, 2], 2, 20), p.count(), 9, 2)
    return tests.withColumn("chosen", F.lit(G.select_k(tests, 0.2)))


@query()
def min_cluster_filter(spark, sf_dir):
    out = G.run_clustering(_points(spark, sf_dir), DIMS, **RUN, min_percent=10.0)
    return out.select("vec_id", "cluster", "k", "excluded")


@query()
def cluster_by_condition(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("half", F.col("vec_id") % 2)
    return G.cluster_by_condition(p, "half", DIMS, **RUN).select("vec_id", "half", "cluster", "k")


@query()
def compare_runs(spark, sf_dir):
    p = _points(spark, sf_dir)
    a = G.run_clustering(p.where("label < 5"), DIMS, **RUN).select(F.lit("A").alias("grp"), "vec_id", "cluster")
    b = G.run_clustering(p.where("label >= 5"), DIMS, **RUN).select(F.lit("B").alias("grp"), "vec_id", "cluster")
    return a.unionByName(b)
