"""Queries: windows, runs, envelopes, lookups and edges over signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import names as N
from corvane.operators import levels as V
from corvane.operators import marks as M
from corvane.operators import searches as P
from corvane.operators import signal as S
from corvane.operators import trailing as T
from corvane.plans import bindings as B
from corvane.plans.registry import query
from corvane.storage import new_folder


def _r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


TRACKS = f"""{B.REC}, tr AS (SELECT *, '2026_09_14_' || lpad(CAST(rec_id % 10000 AS VARCHAR), 4, '0') || CASE WHEN rec_id % 2 = 0 THEN ' ac-aom' ELSE '' END AS name, CASE WHEN rec_id % 5 = 2 THEN 'pending' ELSE 'ready' END AS status, CASE rec_id % 3 WHEN 0 THEN 'DC' WHEN 1 THEN ' ' END AS condition FROM rec)"""


def _tracks(rec):
    """Recordings with names that tell run and condition; some have a condition of their own, some are not ready."""
    r = F.col("rec_id")
    name = F.concat(F.lit("2026_09_14_"), F.lpad((r % 10000).cast("string"), 4, "0"), F.when(r % 2 == 0, " ac-aom").otherwise(""))
    parsed = N.parse_file_name(rec.withColumn("file_name", name), "file_name").withColumnRenamed("condition", "name_condition")
    own = F.when(r % 3 == 0, "DC").when(r % 3 == 1, " ")
    return V.experiment_tracks(parsed.withColumn("status", F.when(r % 5 == 2, "pending").otherwise("ready")).withColumn("condition", own))


@query(f"""WITH {TRACKS} SELECT rec_id, round(coalesce(sum(duration) OVER (PARTITION BY exp_id ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) AS t_offset,
trim(lpad(CAST(rec_id % 10000 AS VARCHAR), 4, '0') || ' ' || CASE WHEN rec_id % 3 = 0 THEN 'DC' WHEN rec_id % 2 = 0 THEN 'AC-AOM' ELSE '' END) AS label FROM tr WHERE status = 'ready'""")
def recording_offsets(spark, sf_dir):
    return _r(_tracks(B.rec(spark, sf_dir)), "t_offset").select("rec_id", "t_offset", "label")


@query(f"""WITH {B.SIG} SELECT event, round(v - lag(v, 3) OVER (PARTITION BY key ORDER BY i), 6) AS d FROM sig""")
def lag_diff(spark, sf_dir):
    return _r(S.lag_diff(B.sig(spark, sf_dir), 3), "d").select("event", "d")


@query(f"""WITH {B.SIG} SELECT event, CASE WHEN count(v) OVER w >= 5 THEN round(quantile_cont(v, 0.5) OVER w, 6) END AS med FROM sig WINDOW w AS (PARTITION BY key ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def rolling_median(spark, sf_dir):
    return _r(T.rolling_median(B.sig(spark, sf_dir), 20), "med").select("event", "med")


ROBUST = f"""{B.SIG}, d AS (SELECT *, v - lag(v, 2) OVER (PARTITION BY key ORDER BY i) AS d FROM sig),
own AS (SELECT *, CASE WHEN count(d) OVER w >= 5 THEN quantile_cont(d, 0.5) OVER w END AS own FROM d WINDOW w AS (PARTITION BY key ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
dev AS (SELECT *, abs(d - own) AS dev FROM own), mad AS (SELECT *, CASE WHEN count(dev) OVER w >= 5 THEN quantile_cont(dev, 0.5) OVER w END AS mad FROM dev WINDOW w AS (PARTITION BY key ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, coalesce(CASE WHEN lag(mad) OVER w IS NOT NULL THEN 0.6745 * (d - lag(own) OVER w) / greatest(lag(mad) OVER w, 1e-4) END, 0.0) AS z0, lag(mad) OVER w AS pm FROM mad WINDOW w AS (PARTITION BY key ORDER BY i)),
zz AS (SELECT key, i, t, v, event, d, z0 AS z FROM z)"""


@query(f"WITH {ROBUST} SELECT event, round(z, 4) AS z FROM zz")
def robust_z(spark, sf_dir):
    return _r(T.robust_z(B.sig(spark, sf_dir), 2, 20), "z", digits=4).select("event", "z")


@query(f"""WITH {ROBUST}, f AS (SELECT *, abs(z) >= 1.0 AS f, coalesce(lag(abs(z) >= 1.0) OVER (PARTITION BY key ORDER BY i), FALSE) AS p FROM zz), r AS (SELECT *, sum(CASE WHEN f AND NOT p THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS run FROM f),
g AS (SELECT key, run, count(*) AS n, min(t) AS t_start, max(t) AS t_end FROM r WHERE f GROUP BY 1, 2 HAVING count(*) >= 3), b AS (SELECT key, run, t, z, d, row_number() OVER (PARTITION BY key, run ORDER BY abs(z) DESC, i) AS k FROM r WHERE f)
SELECT g.key, b.t, round(b.z, 6) AS z, CASE WHEN b.d > 0 THEN 1 ELSE -1 END AS direction, t_start, t_end, n FROM g JOIN b ON b.key = g.key AND b.run = g.run AND b.k = 1""")
def edge_candidates(spark, sf_dir):
    return _r(T.edge_candidates(T.robust_z(B.sig(spark, sf_dir), 2, 20), 1.0, 3), "z")


@query(f"""WITH {B.SIG}, n AS (SELECT key, max(i) AS m FROM sig GROUP BY 1), w AS (SELECT key, CAST(unnest(range(0, m + 1)) AS BIGINT) AS i, m FROM n), o AS (SELECT key, i, greatest(least(i + unnest(range(-3, 4)), m), 0) AS j FROM w)
SELECT s.event, round(avg(x.v), 6) AS avg FROM o JOIN sig x ON x.key = o.key AND x.i = o.j JOIN sig s ON s.key = o.key AND s.i = o.i GROUP BY 1""")
def moving_average(spark, sf_dir):
    return _r(S.moving_average(B.sig(spark, sf_dir), 8), "avg").select("event", "avg")


@query(f"""WITH {B.SIG}, q AS (SELECT key, i, round(v / 20) AS v FROM sig), c AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY key ORDER BY i) = v THEN 0 ELSE 1 END AS c FROM q), r AS (SELECT *, sum(c) OVER (PARTITION BY key ORDER BY i) AS r FROM c),
f AS (SELECT key, r, min(i) AS i0, max(i) AS i1, min(v) AS v FROM r GROUP BY 1, 2) SELECT key, (i0 + i1) // 2 AS i, v FROM (SELECT *, v > lag(v) OVER (PARTITION BY key ORDER BY r) AND v > lead(v) OVER (PARTITION BY key ORDER BY r) AS p FROM f) WHERE p""")
def local_peaks(spark, sf_dir):
    s = B.sig(spark, sf_dir)
    return S.local_peaks(s.select("key", "i", F.round(F.col("v") / 20).alias("v")))


def _estimates(s):
    """Purchases are the estimates, several of a key, and reach two days to both sides."""
    return s.where("kind = 'purchase'").select("key", F.col("event").alias("point"), F.col("t").alias("estimate"))


NEAR = f"""{B.SIG}, est AS (SELECT key, event AS point, t AS estimate FROM sig WHERE kind = 'purchase'), near AS (SELECT est.key, point, estimate, s.i, s.t, s.v FROM est JOIN sig s ON s.key = est.key AND s.t BETWEEN estimate - 172800 AND estimate + 172800)"""


@query(f"""WITH {NEAR}, w AS (SELECT *, count(v) OVER f AS n, round(var_pop(v) OVER f, 9) AS s FROM near WINDOW f AS (PARTITION BY key, point ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), b AS (SELECT key, point, t FROM (SELECT *, row_number() OVER (PARTITION BY key, point ORDER BY s, i) AS r FROM w WHERE n = 5) WHERE r = 1)
SELECT est.key, est.point, coalesce(b.t, estimate) AS t, b.t IS NOT NULL AS moved FROM est LEFT JOIN b ON b.key = est.key AND b.point = est.point""")
def flattest_window(spark, sf_dir):
    s = B.sig(spark, sf_dir)
    return P.flattest_window(s, _estimates(s), 172800.0).drop("estimate")


@query(f"""WITH {NEAR}, q AS (SELECT key, point, i, t, CASE WHEN point % 2 = 0 THEN 1 ELSE -1 END * round(v / 20) AS s, row_number() OVER (PARTITION BY key, point ORDER BY i) AS a FROM near), c AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY key, point ORDER BY i) = s THEN 0 ELSE 1 END AS c FROM q), r AS (SELECT *, sum(c) OVER (PARTITION BY key, point ORDER BY i) AS f FROM c),
fl AS (SELECT key, point, f, min(a) AS a0, max(a) AS a1, min(s) AS s FROM r GROUP BY 1, 2, 3), pk AS (SELECT * FROM (SELECT *, s > lag(s) OVER w AND s > lead(s) OVER w AS p FROM fl WINDOW w AS (PARTITION BY key, point ORDER BY f)) WHERE p),
top AS (SELECT key, point, (a0 + a1) // 2 AS a FROM (SELECT *, row_number() OVER (PARTITION BY key, point ORDER BY s DESC, a0) AS k FROM pk) WHERE k = 1), n AS (SELECT key, point, count(*) AS n FROM q GROUP BY 1, 2),
mx AS (SELECT key, point, t, s FROM (SELECT *, row_number() OVER (PARTITION BY key, point ORDER BY s DESC, i) AS k FROM q) WHERE k = 1), pt AS (SELECT q.key, q.point, q.t, q.s FROM q JOIN top ON top.key = q.key AND top.point = q.point AND top.a = q.a)
SELECT est.key, est.point, CASE WHEN n < 3 THEN estimate ELSE coalesce(pt.t, mx.t) END AS t, CASE WHEN n >= 3 THEN CASE WHEN est.point % 2 = 0 THEN 1 ELSE -1 END * coalesce(pt.s, mx.s) END AS v, CASE WHEN n < 3 THEN 'none' WHEN pt.t IS NOT NULL THEN 'peak' ELSE 'maximum' END AS kind
FROM est JOIN n ON n.key = est.key AND n.point = est.point JOIN mx ON mx.key = est.key AND mx.point = est.point LEFT JOIN pt ON pt.key = est.key AND pt.point = est.point""")
def tallest_peak(spark, sf_dir):
    """The tallest peak around even points and the lowest around odd ones."""
    s = B.sig(spark, sf_dir).withColumn("v", F.round(F.col("v") / 20))
    e = _estimates(s)
    up, down = P.tallest_peak(s, e.where("point % 2 = 0"), 172800.0), P.tallest_peak(s, e.where("point % 2 <> 0"), 172800.0, -1)
    return up.unionByName(down).drop("estimate")


@query(f"""WITH {NEAR}, p AS (SELECT *, lag(v) OVER w AS pv, lag(t) OVER w AS pt, count(*) OVER (PARTITION BY key, point) AS n FROM near WINDOW w AS (PARTITION BY key, point ORDER BY i)),
h AS (SELECT *, CASE WHEN pv IS NULL THEN t WHEN v = pv THEN pt ELSE pt + least(greatest((CASE WHEN point % 2 = 0 THEN 60 ELSE 40 END - pv) / (v - pv), 0), 1) * (t - pt) END AS x, row_number() OVER (PARTITION BY key, point ORDER BY CASE WHEN point % 3 = 0 THEN -i ELSE i END) AS r FROM p WHERE n >= 2 AND CASE WHEN point % 2 = 0 THEN v >= 60 ELSE v <= 40 END)
SELECT est.key, est.point, round(x, 4) AS t_cross FROM est LEFT JOIN h ON h.key = est.key AND h.point = est.point AND r = 1""")
def level_crossing(spark, sf_dir):
    """Upwards over 60 for even points, downwards under 40 for odd ones; the last crossing for every third."""
    s = B.sig(spark, sf_dir)
    even = F.col("point") % 2 == 0
    searches = P.around(_estimates(s), 172800.0).select("key", "point", "lo", "hi", F.when(even, 60.0).otherwise(40.0).alias("level"), even.alias("rising"), (F.col("point") % 3 != 0).alias("first"))
    return _r(P.level_crossing(s, searches, 345600.0), "t_cross", digits=4)


@query(f"""WITH {B.SIG}, est AS (SELECT key, event AS point, t AS lo0, CASE WHEN event % 2 = 0 THEN t ELSE t - 432000 END AS lo, CASE WHEN event % 2 = 0 THEN t + 432000 ELSE t END AS hi FROM sig WHERE kind = 'purchase'), near AS (SELECT est.key, point, s.i, s.t, abs(s.v - 40) < 25 AS f, CASE WHEN point % 2 = 0 THEN s.i ELSE -s.i END AS w FROM est JOIN sig s ON s.key = est.key AND s.t BETWEEN lo AND hi),
g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY key, point ORDER BY w) AS o FROM near), c AS (SELECT *, row_number() OVER (PARTITION BY key, point, o ORDER BY w) AS n FROM g WHERE f), b AS (SELECT key, point, min_by(t, w) AS t FROM c WHERE n = 2 GROUP BY 1, 2)
SELECT est.key, est.point, b.t FROM est LEFT JOIN b ON b.key = est.key AND b.point = est.point""")
def baseline_return(spark, sf_dir):
    """Within 25 of 40 for two samples: onward in five days from even points, back from odd ones."""
    s = B.sig(spark, sf_dir)
    even, t = F.col("point") % 2 == 0, F.col("estimate")
    searches = _estimates(s).select("key", "point", F.when(even, t).otherwise(t - 432000).alias("lo"), F.when(even, t + 432000).otherwise(t).alias("hi"), F.lit(40.0).alias("base"), F.lit(10.0).alias("sigma"), even.alias("forward"))
    return P.baseline_return(s, searches, 2, 432000.0)


@query(f"""WITH {B.SIG}, k AS (SELECT key, i // 2 AS i, t, v FROM sig WHERE i % 2 = 0), e AS (SELECT key, max(i) AS last, arg_min(v, i) AS v0, arg_max(v, i) AS v1, count(*) AS n, min(t) AS lo, max(t) AS hi FROM k GROUP BY 1),
sm AS (SELECT k.key, k.i, k.t, (sum(v) OVER (PARTITION BY k.key ORDER BY k.i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + greatest(1 - k.i, 0) * v0 + greatest(k.i + 1 - last, 0) * v1) / 3 AS v FROM k JOIN e ON e.key = k.key),
m AS (SELECT key, median(v) AS med FROM sm GROUP BY 1), o AS (SELECT sm.*, abs(v - med) AS dev FROM sm JOIN m USING (key)), mm AS (SELECT key, median(dev) AS mad FROM o GROUP BY 1),
f AS (SELECT o.*, dev > greatest(1.4826 * mad, 1e-9) AS f FROM o JOIN mm USING (key)), p AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY key ORDER BY i), FALSE) AS p FROM f), r AS (SELECT *, sum(CASE WHEN f AND NOT p THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS run FROM p),
g AS (SELECT key, run, min(t) AS t0, max(t) AS t1, sum(dev) AS w FROM r WHERE f GROUP BY 1, 2), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(w, 9) DESC, t0) AS k FROM g) WHERE k = 1)
SELECT b.key, greatest(lo, t0 - 3600) AS t0, least(hi, t1 + 3600) AS t1, round(w, 6) AS weight FROM b JOIN e ON e.key = b.key WHERE t1 - t0 >= 0.02 AND n >= 8""")
def coarse_event(spark, sf_dir):
    """At 10 samples a second: every second one, averaged over three."""
    return _r(P.coarse_event(B.sig(spark, sf_dir), 10.0, 1.0, 0.02, 3600.0, 5.0, 600.0), "weight")


@query(f"WITH {B.SIG} SELECT key, i // 5 AS i, t, v FROM sig WHERE i % 5 = 0")
def decimate(spark, sf_dir):
    return S.decimate(B.sig(spark, sf_dir), 5).select("key", "i", "t", "v")


PYRAMID = " UNION ALL ".join(f"SELECT key, {k} AS level, i // {4**k} AS bin, min(v) AS vmin, max(v) AS vmax FROM sig WHERE key IN (SELECT key FROM sig GROUP BY 1 HAVING ceil(count(*) / {4.0**k}) >= 16) GROUP BY 1, 3" for k in (1, 2, 3))


@query(f"WITH {B.SIG} {PYRAMID}")
def minmax_pyramid(spark, sf_dir):
    store = V.store_levels(B.sig(spark, sf_dir), new_folder(spark, "levels"), 4, 3, 16)
    return store.pyramid(spark)


#: A day of the events table, in epoch seconds.
DAY0, DAY9 = 1704067200.0, 1704067200.0 + 9 * 86400


#: The ranges' plan and their entries, as operators/levels.py has them.
RANGES = """n AS (SELECT key, max(i) + 1 AS n FROM sig GROUP BY 1), lv AS (SELECT key, n, CASE WHEN ceil(n / 64.0) >= 4 THEN 3 WHEN ceil(n / 16.0) >= 4 THEN 2 WHEN ceil(n / 4.0) >= 4 THEN 1 ELSE 0 END AS levels FROM n),
pl AS (SELECT *, CASE WHEN cnt <= budget THEN 0 WHEN cnt <= 16 THEN 0 WHEN levels >= 1 AND cnt / 4.0 <= 16 THEN 1 WHEN levels >= 2 AND cnt / 16.0 <= 16 THEN 2 WHEN levels >= 3 AND cnt / 64.0 <= 16 THEN 3 ELSE levels END AS level FROM (SELECT *, greatest(0, least(n, CAST(ceil(t1) AS BIGINT) + 1) - greatest(0, CAST(floor(t0) AS BIGINT))) AS cnt, greatest(0, CAST(floor(t0) AS BIGINT)) AS i0, least(n, CAST(ceil(t1) AS BIGINT) + 1) AS i1 FROM asked)),
j AS (SELECT *, i0 // CAST(4 ** level AS BIGINT) AS j0, CAST(ceil(i1 / (4.0 ** level)) AS BIGINT) AS j1, CAST(4 ** level AS BIGINT) AS w FROM pl WHERE cnt > 0), jb AS (SELECT *, greatest(1, least(budget // 2, j1 - j0)) AS bins FROM j),
en AS (SELECT range, jb.key, level, i // w AS e, min(v) AS vmin, max(v) AS vmax, any_value(j0) AS j0, any_value(j1) AS j1, any_value(bins) AS bins, any_value(w) AS w, any_value(cnt) AS cnt, any_value(budget) AS budget FROM jb JOIN sig ON sig.key = jb.key AND i // w >= j0 AND i // w < j1 GROUP BY 1, 2, 3, 4),
found AS (SELECT range, key, 'full' AS mode, level, e AS bin, CAST(e AS DOUBLE) AS t, CAST(e AS DOUBLE) AS t_mid, vmin, vmax, 1.0 AS bin_s FROM en WHERE cnt <= budget
UNION ALL SELECT range, key, 'envelope', level, ((e - j0 + 1) * bins - 1) // (j1 - j0) AS bin, CAST(min(e) * any_value(w) AS DOUBLE), (min(e) + count(*) / 2.0) * any_value(w), min(vmin), max(vmax), any_value((j1 - j0) * w / bins::DOUBLE) FROM en WHERE cnt > budget GROUP BY 1, 2, 4, 5)"""


@query(f"""WITH {B.SIG}, {RANGES.replace("pl AS", "asked AS (SELECT key AS range, key, n, levels, key % 7 * 1.5 AS t0, CASE WHEN key % 11 = 3 THEN 0.0 ELSE n * 0.9 + 0.3 END AS t1, CASE WHEN key % 5 = 0 THEN 1000 ELSE 14 END AS budget FROM lv), pl AS", 1)}
SELECT key, mode, level, bin, t, round(t_mid, 6) AS t_mid, vmin, vmax, round(bin_s, 6) AS bin_s FROM found UNION ALL SELECT key, 'empty', 0, 0, NULL, NULL, NULL, NULL, 0.0 FROM pl WHERE cnt = 0""")
def range_envelope(spark, sf_dir):
    """A range of each user's samples, one a second: exact ones for some, bins out of levels for others."""
    s = B.sig(spark, sf_dir)
    store = V.store_levels(s, new_folder(spark, "levels"), 4, 3, 4)
    n = store.extents(spark)
    t1 = F.when(F.col("key") % 11 == 3, 0.0).otherwise(F.col("n") * 0.9 + 0.3)
    ranges = n.select(F.col("key").alias("range"), "key", F.lit(1.0).alias("fs"), (F.col("key") % 7 * 1.5).alias("t0"), t1.alias("t1"), F.when(F.col("key") % 5 == 0, 1000).otherwise(14).alias("budget"))
    return _r(V.read_ranges(store, ranges, 16), "t_mid", "bin_s").drop("range")


@query(f"""WITH {B.SIG}, {RANGES.replace("pl AS", "rec AS (SELECT key AS rec_id, n, levels, key % 5 AS exp_id, lpad(CAST(key AS VARCHAR), 9, '0') AS name, CAST(n AS DOUBLE) AS duration FROM lv WHERE key % 4 <> 1), tr AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY exp_id ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS off FROM rec), tot AS (SELECT exp_id, sum(duration) AS total FROM rec GROUP BY 1), vw AS (SELECT exp_id, total * 0.1 AS t0, total * 0.8 AS t1, 500 AS budget FROM tot), ov AS (SELECT rec_id, n, levels, off, vw.exp_id, greatest(t0 - off, 0.0) AS a, least(t1 - off, duration) AS b, t0, t1, budget FROM tr JOIN vw ON vw.exp_id = tr.exp_id), asked AS (SELECT rec_id AS range, rec_id AS key, n, levels, off, exp_id, a AS t0, b AS t1, greatest(12, CAST(floor(budget * (b - a) / greatest(t1 - t0, 1e-9)) AS BIGINT)) AS budget FROM ov WHERE b > a), pl AS", 1)}
SELECT exp_id AS view, key AS rec_id, mode, level, bin, round(t + off, 4) AS t, vmin, vmax FROM found JOIN (SELECT range, off, exp_id FROM asked) USING (range)""")
def range_envelope_all(spark, sf_dir):
    """Each experiment from a tenth to four fifths of its length, across its ready recordings."""
    s = B.sig(spark, sf_dir)
    store = V.store_levels(s, new_folder(spark, "levels"), 4, 3, 4)
    k = F.col("key")
    rec = store.extents(spark).select(k.alias("rec_id"), (k % 5).alias("exp_id"), F.lpad(k.cast("string"), 9, "0").alias("file_name"), F.col("n").cast("double").alias("duration"), F.when(k % 4 == 1, "pending").otherwise("ready").alias("status"), *[F.lit(None).cast("string").alias(c) for c in ("condition", "name_condition", "run")], F.lit(1.0).alias("fs"))
    tracks = V.experiment_tracks(rec)
    views = tracks.groupBy("exp_id").agg(F.sum("duration").alias("total")).select(F.col("exp_id").alias("view"), "exp_id", (F.col("total") * 0.1).alias("t0"), (F.col("total") * 0.8).alias("t1"), F.lit(500).alias("budget"))
    return _r(V.read_experiments(store, tracks, views, 12, 16), "t", digits=4).select("view", "rec_id", "mode", "level", "bin", "t", "vmin", "vmax")


def _windows(s, half=3600.0):
    return s.where("kind = 'purchase'").select("event", "key", (F.col("t") - half).alias("t0"), (F.col("t") + half).alias("t1"))


@query(f"""WITH {B.SIG}, w AS (SELECT event, key, t - 3600 AS t0, t + 3600 AS t1 FROM sig WHERE kind = 'purchase'), sw AS (SELECT key, b AS sweep, {DAY0} + b * 432000.0 AS s0, {DAY0} + (b + 1) * 432000.0 AS s1 FROM (SELECT DISTINCT key FROM sig), (SELECT unnest(range(0, 5)) AS b)),
p AS (SELECT event, sweep, s0 <= t0 - 10 AND s1 >= t1 + 10 AS whole, greatest(t0 - 10, s0) AS c0, least(t1 + 10, s1) AS c1, row_number() OVER (PARTITION BY event ORDER BY CASE WHEN s0 <= t0 - 10 AND s1 >= t1 + 10 THEN 0 ELSE 1 END, CASE WHEN s0 <= t0 - 10 AND s1 >= t1 + 10 THEN 0.0 ELSE -round(least(t1 + 10, s1) - greatest(t0 - 10, s0), 6) END, sweep) AS r FROM w JOIN sw USING (key) WHERE s0 < t1 + 10 AND s1 > t0 - 10)
SELECT w.event, sweep, c0, c1, coalesce(whole, FALSE) AS whole FROM w LEFT JOIN p ON p.event = w.event AND r = 1""")
def window_to_sweep(spark, sf_dir):
    s = B.sig(spark, sf_dir)
    sweeps = s.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("sweep"))
    sweeps = sweeps.select("key", "sweep", (DAY0 + F.col("sweep") * 432000.0).alias("s0"), (DAY0 + (F.col("sweep") + 1) * 432000.0).alias("s1"))
    return S.window_to_sweep(_windows(s), sweeps, 10.0)


@query(f"""WITH {B.SIG} SELECT w.event, count(*) AS n, round(sum(s.v), 6) AS total FROM sig w JOIN sig s ON s.key = w.key AND s.t BETWEEN w.t - 3600 AND w.t + 3600 WHERE w.kind = 'purchase' GROUP BY 1""")
def cut_windows(spark, sf_dir):
    s = B.sig(spark, sf_dir)
    arrays = S.gather_windows(S.cut_windows(_windows(s), s.select("key", "i", "t", "v"), 7200.0))
    return _r(arrays.select("event", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


def _channels(s):
    """Three channels out of a signal, one sample a second; the third one lacks some."""
    v = F.col("v")
    each = F.array(*[F.struct(F.lit(c).alias("channel"), x.alias("v")) for c, x in ((0, v), (1, 2 * v + 1), (2, F.when(F.col("i") % 10 != 3, 50 - v)))])
    rows = s.select(F.col("key").alias("recording"), "i", F.col("i").cast("double").alias("t"), F.explode(each).alias("c"))
    return rows.select("recording", "c.channel", "i", "t", "c.v").where("v is not null")


def _roles(s):
    return s.select(F.col("key").alias("recording")).distinct().select("recording", F.lit(1.0).alias("fs"), F.lit(2).alias("electrical"), F.lit(0).alias("optical"), F.when(F.col("recording") % 2 == 0, 1).otherwise(0).alias("reference"))


@query(f"""WITH {B.SIG} SELECT w.event, count(*) AS n, round(sum(50 - s.v), 6) AS electrical, round(sum(s.v), 6) AS optical, round(sum(CASE WHEN w.key % 2 = 0 THEN 2 * s.v + 1 ELSE s.v END), 6) AS reference FROM sig w JOIN sig s ON s.key = w.key AND s.i BETWEEN w.i - 7.5 AND w.i + 9 AND s.i % 10 <> 3 WHERE w.kind = 'purchase' GROUP BY 1""")
def cut_roles(spark, sf_dir):
    s = B.sig(spark, sf_dir)
    windows = s.where("kind = 'purchase'").select("event", F.col("key").alias("recording"), (F.col("i") - 7.5).alias("t0"), (F.col("i") + 9.0).alias("t1"))
    found = M.cut_roles(windows, _channels(s), _roles(s), 16.0)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias(c)
    return found.select("event", F.size("t").cast("long").alias("n"), *[total(c) for c in M.ROLES])


@query(f"""WITH {B.SIG}, p AS (SELECT key, event AS point, t + 100.5 AS t FROM sig WHERE kind = 'purchase'), a AS (SELECT p.*, s.t AS ta, s.v AS va FROM p ASOF LEFT JOIN sig s ON p.key = s.key AND p.t >= s.t), b AS (SELECT a.*, s.t AS tb, s.v AS vb FROM a ASOF LEFT JOIN sig s ON a.key = s.key AND a.t <= s.t)
SELECT key, point, round(CASE WHEN ta = t THEN va ELSE va + (t - ta) / (tb - ta) * (vb - va) END, 6) AS v FROM b""")
def asof_interp(spark, sf_dir):
    s = B.sig(spark, sf_dir)
    points = s.where("kind = 'purchase'").select("key", F.col("event").alias("point"), (F.col("t") + 100.5).alias("t"))
    return _r(S.asof_interp(points, s.select("key", "t", "v")), "v").select("key", "point", "v")


@query(f"""WITH {B.SIG}, p AS (SELECT key, event AS point, (i * 0.7) AS x FROM sig WHERE kind = 'purchase') SELECT p.key, point, round(CASE WHEN x = floor(x) THEN a.v ELSE a.v + (x - floor(x)) * (b.v - a.v) END, 6) AS v FROM p LEFT JOIN sig a ON a.key = p.key AND a.i = floor(x) LEFT JOIN sig b ON b.key = p.key AND b.i = floor(x) + 1""")
def uniform_lookup(spark, sf_dir):
    s = B.sig(spark, sf_dir)
    points = s.where("kind = 'purchase'").select("key", F.col("event").alias("point"), (F.col("i") * F.lit(0.7)).alias("t"))
    return _r(S.uniform_lookup(points, s.select("key", "i", "v"), 1.0), "v").select("key", "point", "v")


def _edges(s):
    """Clicks are rises and errors falls, each a minute long, of the day's pseudo-event."""
    day = F.floor((F.col("t") - DAY0) / 86400).cast("long")
    return s.where("kind in ('click', 'error')").select((F.col("key") * 1000 + day).alias("event"), "t", F.col("t").alias("t_start"), (F.col("t") + 60).alias("t_end"), F.when(F.col("kind") == "click", 1).otherwise(-1).alias("direction"))


EDGES = f"""{B.SIG}, e AS (SELECT key * 1000 + CAST(floor((t - {DAY0}) / 86400) AS BIGINT) AS event, t, t AS t_start, t + 60 AS t_end, CASE WHEN kind = 'click' THEN 1 ELSE -1 END AS direction FROM sig WHERE kind IN ('click', 'error'))"""


@query(f"WITH {EDGES} SELECT r.event, r.t AS rise_t, f.t AS fall_t FROM e r JOIN e f ON r.event = f.event AND r.direction > 0 AND f.direction < 0 AND f.t_start > r.t_end")
def edge_pairs(spark, sf_dir):
    return S.edge_pairs(_edges(B.sig(spark, sf_dir))).select("event", F.col("rise.t").alias("rise_t"), F.col("fall.t").alias("fall_t"))


@query(f"""WITH {EDGES}, s AS (SELECT key * 1000 + CAST(floor((t - {DAY0}) / 86400) AS BIGINT) AS event, t, v FROM sig), p AS (SELECT r.event, r.t AS r, f.t AS f FROM e r JOIN e f ON r.event = f.event AND r.direction > 0 AND f.direction < 0 AND f.t_start > r.t_end),
l AS (SELECT p.event, r, f, median(CASE WHEN t BETWEEN r AND f THEN v END) AS plateau, median(CASE WHEN t >= r - 7200 AND t < r THEN v END) AS base FROM p JOIN s ON s.event = p.event GROUP BY 1, 2, 3),
g AS (SELECT l.*, avg(CASE WHEN v > (plateau + base) / 2 THEN 1.0 ELSE 0.0 END) AS share FROM l JOIN s ON s.event = l.event AND t BETWEEN r AND f WHERE plateau > base GROUP BY ALL)
SELECT event, r, f, round(plateau - base, 6) AS amplitude FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY round(plateau - base, 9) DESC, r, f) AS k FROM g WHERE share >= 0.5) WHERE k = 1""")
def best_edge_pair(spark, sf_dir):
    s = B.sig(spark, sf_dir)
    pairs = S.edge_pairs(_edges(s)).select("event", F.col("rise.t").alias("r"), F.col("fall.t").alias("f"))
    day = F.floor((F.col("t") - DAY0) / 86400).cast("long")
    samples = s.select((F.col("key") * 1000 + day).alias("event"), "t", "v")
    return _r(S.best_edge_pair(pairs, samples, 7200.0, 0.5), "amplitude")


@query(f"""WITH {EDGES}, q AS (SELECT event, min(t) + 5000 AS estimate FROM e GROUP BY 1) SELECT event, estimate, (SELECT t FROM e WHERE e.event = q.event AND direction = 1 AND abs(t - estimate) <= 9000 ORDER BY round(abs(t - estimate), 6), t LIMIT 1) AS snapped FROM q""")
def snap_edge(spark, sf_dir):
    e = _edges(B.sig(spark, sf_dir))
    return S.snap_edge(e, e.groupBy("event").agg((F.min("t") + 5000).alias("estimate")), 1, 9000.0)


@query(f"""WITH {B.SIG}, p AS (SELECT l_orderkey AS event, l_orderkey % 4 AS recording, k, o_custkey % 3 AS c, CASE WHEN k < 3 THEN 10.25 - k * (o_custkey % 3) ELSE k + 0.5 END AS t FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey, (SELECT unnest(range(0, 7)) AS k) WHERE NOT (l_orderkey % 5 = 0 AND k = 6)),
e AS (SELECT event, recording, min(CASE WHEN k < 3 THEN t END) AS event_start, 10.25 - any_value(c) AS event_plateau, max(CASE WHEN k < 3 THEN t END) AS event_end, 3.5 AS entry_base_t, 6.5 AS exit_base_t FROM p GROUP BY 1, 2 HAVING count(*) = 7),
ch AS (SELECT key, 0 AS channel, i, v FROM sig UNION ALL SELECT key, 1, i, 2 * v + 1 FROM sig UNION ALL SELECT key, 2, i, 50 - v FROM sig WHERE i % 10 <> 3)
SELECT event, recording, event_start, event_plateau, event_end, entry_base_t, exit_base_t, {", ".join(f"round((SELECT a.v + ({t} - floor({t})) * (b.v - a.v) FROM ch a JOIN ch b ON b.key = a.key AND b.channel = a.channel AND b.i = a.i + 1 WHERE a.key = recording AND a.channel = {c} AND a.i = floor({t})), 6) AS {n}" for t, c, n in (("event_start", "0", "optical_base"), ("event_end", "CASE WHEN recording % 2 = 0 THEN 1 ELSE 0 END", "opticalre_end"), ("entry_base_t", "2", "entry_base"), ("exit_base_t", "2", "exit_base")))} FROM e""")
def assemble_events(spark, sf_dir):
    """Marked points as events, with the amplitudes at the marks."""
    o = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(B.table(spark, sf_dir, "orders"), "o_orderkey")
    k = F.col("mark")
    rows = o.select(F.col("o_orderkey").alias("event"), (F.col("o_orderkey") % 4).alias("recording"), "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("mark")).where(~((F.col("event") % 5 == 0) & (k == 6)))
    points = rows.select("event", "recording", "mark", F.when(k < 3, "optical").otherwise("electrical").alias("kind"), F.when(k < 3, 10.25 - k * (F.col("o_custkey") % 3)).otherwise(k + 0.5).alias("t"))
    s = B.sig(spark, sf_dir).where("key < 4")
    found = M.read_amplitudes(S.assemble_events(points), _channels(s), _roles(s))
    return _r(found, "optical_base", "opticalre_end", "entry_base", "exit_base").select("event", "recording", "event_start", "event_plateau", "event_end", "entry_base_t", "exit_base_t", "optical_base", "opticalre_end", "entry_base", "exit_base")


@query(f"""WITH {B.SIG}, e AS (SELECT event, key, CASE WHEN event % 3 = 0 THEN i - 0.25 ELSE i + 0.25 END AS event_start, CASE WHEN event % 3 = 1 THEN i + 2.5 ELSE i + 1.5 END AS entry_peak_t FROM sig WHERE kind = 'purchase')
SELECT e.event, event_start, entry_peak_t, CASE WHEN e.event % 3 = 0 THEN round(a.v + (event_start - floor(event_start)) * (b.v - a.v), 6) ELSE -1.0 END AS optical_base, CASE WHEN e.event % 3 = 0 THEN round(CASE WHEN e.key % 2 = 0 THEN 2 ELSE 1 END * (a.v + (event_start - floor(event_start)) * (b.v - a.v)) + CASE WHEN e.key % 2 = 0 THEN 1 ELSE 0 END, 6) ELSE -2.0 END AS opticalre_base,
CASE WHEN e.event % 3 = 1 THEN round(50 - (c.v + 0.5 * (d.v - c.v)), 6) ELSE -3.0 END AS entry_peak
FROM e LEFT JOIN sig a ON a.key = e.key AND a.i = floor(event_start) LEFT JOIN sig b ON b.key = e.key AND b.i = floor(event_start) + 1 LEFT JOIN sig c ON c.key = e.key AND c.i = floor(entry_peak_t) AND c.i % 10 <> 3 LEFT JOIN sig d ON d.key = e.key AND d.i = floor(entry_peak_t) + 1 AND d.i % 10 <> 3""")
def move_landmarks(spark, sf_dir):
    """Some starts and some peaks are moved; the amplitudes at the others stay."""
    s = B.sig(spark, sf_dir)
    at = s.where("kind = 'purchase'").select("event", F.col("key").alias("recording"), "i")
    events = at.select("event", "recording", (F.col("i") + 0.25).alias("event_start"), (F.col("i") + 1.5).alias("entry_peak_t"), F.lit(-1.0).alias("optical_base"), F.lit(-2.0).alias("opticalre_base"), F.lit(-3.0).alias("entry_peak"))
    edits = at.where("event % 3 <> 2").select("event", F.when(F.col("event") % 3 == 0, F.col("i") - 0.25).alias("event_start"), F.when(F.col("event") % 3 == 1, F.col("i") + 2.5).alias("entry_peak_t"))
    return _r(M.move_landmarks(events, edits, _channels(s), _roles(s)), "optical_base", "opticalre_base", "entry_peak").drop("recording")
