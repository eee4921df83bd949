"""Levels, trailing medians, quantiles, searches, edits and live edges: sizes, chunks and edges of ranges."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.operators import edits as D
from corvane.operators import levels as V
from corvane.operators import quantiles as Q
from corvane.operators import searches as P
from corvane.operators import trailing as T
from corvane.storage import new_folder
from corvane.streaming import jobs


def signal(spark, lengths, seed=1, ties=False):
    rng = np.random.default_rng(seed)
    rows = []
    for key, n in enumerate(lengths):
        v = np.cumsum(rng.normal(size=n)) + np.where(np.arange(n) % 50 > 40, 8, 0)
        v = np.round(v) if ties else v
        rows += [(key, i, float(i), None if i % 97 == 5 else float(x)) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "key long, i long, t double, v double").repartition(7), rows


def test_range_reads_touch_only_their_level(spark):
    samples, rows = signal(spark, [3000, 40, 700])
    store = V.store_levels(samples, new_folder(spark, "levels"), 4, 3, 16)
    assert {r["key"]: (r["n"], r["levels"]) for r in store.extents(spark).collect()} == {0: (3000, 3), 1: (40, 0), 2: (700, 2)}
    asked = spark.createDataFrame([("long", 0, 1.0, 0.0, 2999.0, 40), ("all", 0, 1.0, -5.0, 9e9, 3000), ("short", 1, 1.0, 3.2, 8.7, 100), ("out", 2, 1.0, 800.0, 900.0, 10), ("none", 9, 1.0, 0.0, 1.0, 10)], "range string, key long, fs double, t0 double, t1 double, budget int")
    got = V.read_ranges(store, asked, 60).collect()
    by = {n: sorted((r for r in got if r["range"] == n), key=lambda r: r["bin"]) for n in ("long", "all", "short", "out", "none")}
    values = {k: [r[3] for r in rows if r[0] == k] for k in range(3)}
    assert [r["mode"] for r in by["out"]] == [r["mode"] for r in by["none"]] == ["empty"]
    assert [r["vmin"] for r in by["all"]] == values[0] and {r["mode"] for r in by["all"]} == {"full"}
    assert [(r["bin"], r["vmin"]) for r in by["short"]] == [(i, values[1][i]) for i in range(3, 10)]
    assert len(by["long"]) == 20 and {r["level"] for r in by["long"]} == {3}
    assert min(r["vmin"] for r in by["long"]) == min(x for x in values[0] if x is not None)
    assert max(r["vmax"] for r in by["long"]) == max(x for x in values[0] if x is not None)
    assert by["long"][0]["t"] == 0.0 and by["long"][1]["t"] == pytest.approx(2 * 64.0) and by["long"][0]["t_mid"] == 64.0
    files = V.read_ranges(store, asked.where("range = 'long'"), 60).inputFiles()
    assert files and all("/level3/" in f for f in files)  # no samples, and no other level
    assert V.read_ranges(store, asked.where("range = 'none'")).count() == 1


def test_views_share_their_budget(spark):
    samples, _ = signal(spark, [400, 300, 100, 200])
    store = V.store_levels(samples, new_folder(spark, "levels"), 4, 2, 16)
    rec = spark.createDataFrame([(0, 1, "b", 400.0, "ready"), (1, 1, "a", 300.0, "ready"), (2, 1, "aa", 100.0, "pending"), (3, 1, "c", 200.0, "ready")], "rec_id long, exp_id long, file_name string, duration double, status string")
    tracks = V.experiment_tracks(rec.withColumns({"condition": F.lit(" "), "name_condition": F.lit("DC"), "run": F.lit("0001"), "fs": F.lit(1.0)}))
    assert {r["rec_id"]: (r["t_offset"], r["label"]) for r in tracks.collect()} == {1: (0.0, "0001 DC"), 0: (300.0, "0001 DC"), 3: (700.0, "0001 DC")}
    views = spark.createDataFrame([(5, 1, 150.0, 750.0, 120), (6, 2, 0.0, 1.0, 10)], "view long, exp_id long, t0 double, t1 double, budget int")
    got = V.read_experiments(store, tracks, views, 20).collect()
    n = Counter((r["rec_id"], r["mode"]) for r in got)
    assert n == {(1, "envelope"): 15, (0, "envelope"): 40, (3, "envelope"): 10}  # 30, 80 and at least 20 of 120
    assert min(r["t"] for r in got) == 150.0 and max(r["t"] for r in got) < 760.0 and {r["view"] for r in got} == {5}


@pytest.mark.parametrize("chunk", [64, 333, 65_536])
def test_trailing_statistics_of_any_chunks(spark, chunk):
    samples, rows = signal(spark, [900, 3, 150], ties=True)
    got = {(r["key"], r["i"]): r for r in T.robust_z(T.rolling_median(samples, 30, chunk=chunk), 4, 40, chunk=chunk).collect()}
    assert len(got) == len(rows)
    for key in range(3):
        v = pd.Series([np.nan if r[3] is None else r[3] for r in rows if r[0] == key])
        med = v.rolling(30, min_periods=5).median().shift(1)
        d, z = T.lag_z(v.to_numpy(), 4, 40, 5, 1e-4)
        for i in range(len(v)):
            r = got[key, i]
            assert (r["med"] is None) == np.isnan(med[i]) and (r["med"] is None or r["med"] == pytest.approx(med[i]))
            assert (r["d"] is None) == np.isnan(d[i]) and r["z"] == pytest.approx(z[i])


def test_frames_shrink_with_the_signal(spark):
    n = spark.createDataFrame([(3,), (100,), (1000,), (100_000,)], "n long")
    assert [r[0] for r in n.select(T.trailing_frame(F.col("n"), 1000.0)).collect()] == [5, 99, 500, 8000]
    samples, _ = signal(spark, [300, 40])
    framed = samples.withColumn("w", F.when(F.col("key") == 0, 50).otherwise(8))
    both = T.robust_z(framed, 2, "w", chunk=70)
    alone = T.robust_z(samples.where("key = 1"), 2, 8)
    assert sorted(map(tuple, both.where("key = 1").drop("w").collect())) == sorted(map(tuple, alone.collect()))


@pytest.mark.parametrize("chunk", [1, 7, 64, 65_536])
def test_runs_over_chunks(spark, chunk):
    rng = random.Random(3)
    flags = [[rng.random() < p for _ in range(200)] for p in (0.5, 0.97, 0.0)] + [[True] * 130]
    rows = [(k, i, float(i), f, 1.0) for k, fs in enumerate(flags) for i, f in enumerate(fs)]
    samples = spark.createDataFrame(rows, "key long, i long, t double, f boolean, w double").repartition(5)
    want = []
    for k, fs in enumerate(flags):
        start = None
        for i, f in enumerate([*fs, False]):
            if f and start is None:
                start = i
            if not f and start is not None:
                want.append((k, start, i - 1, i - start, float(i - start)))
                start = None
    got = T.long_runs(samples, F.col("f"), {"w": (F.sum("w"), F.sum)}, chunk)
    assert Counter(map(tuple, got.collect())) == Counter(want)


@pytest.mark.parametrize("bins", [2, 4096])
def test_exact_quantiles(spark, bins):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([None, 1.0, 1.0, 2.0, -3.5, float("nan")]), rng.uniform(-1e9, 1e9) ** 3) for _ in range(400)]
    rows += [("one", 5.0, 1e-320), ("two", 1.0, 5e-324), ("two", 2.0, 1.7e308), ("two", 2.0, -1.7e308), ("none", None, float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["feature"], r["p"]): r["value"] for r in Q.exact_quantiles(df, ["g"], ["x", "y"], probabilities, bins).collect()}
    for g in {r[0] for r in rows}:
        for k, feature in ((1, "x"), (2, "y")):
            values = sorted(r[k] for r in rows if r[0] == g and r[k] is not None and not np.isnan(r[k]))
            for p in probabilities:
                if not values:
                    assert (g, feature, p) not in got
                    continue
                low, part = divmod(p * (len(values) - 1), 1)
                a, b = values[int(low)], values[min(int(low) + (part > 0), len(values) - 1)]
                assert got[g, feature, p] == pytest.approx((1 - part) * a + part * b, rel=1e-12, abs=0)
    whole = Q.exact_quantiles(df, [], ["x"], [0.5]).collect()
    assert len(whole) == 1 and Q.exact_quantiles(df.limit(0), ["g"], ["x"], [0.5]).count() == 0


def test_searches_at_a_signals_ends(spark):
    v = [0.0, 5.0, 5.0, 5.0, 1.0, 7.0, 2.0, 2.0, 2.0, 2.0, 9.0, 3.0]
    samples = spark.createDataFrame([(1, i, float(i), x) for i, x in enumerate(v)], "key long, i long, t double, v double")
    est = spark.createDataFrame([(1, 1, 2.0), (1, 2, 11.5), (1, 3, 8.0), (1, 4, 40.0), (2, 5, 3.0)], "key long, point long, estimate double")
    peak = {r["point"]: (r["t"], r["v"], r["kind"]) for r in P.tallest_peak(samples, est, 3.0).collect()}
    assert peak == {1: (2.0, 5.0, "peak"), 2: (10.0, 9.0, "peak"), 3: (10.0, 9.0, "peak"), 4: (40.0, None, "none"), 5: (3.0, None, "none")}
    low = {r["point"]: (r["t"], r["kind"]) for r in P.tallest_peak(samples, est, 2.0, -1).collect()}
    assert low[1] == (4.0, "peak") or low[1] == (0.0, "maximum")
    flat = {r["point"]: (r["t"], r["moved"]) for r in P.flattest_window(samples, est, 2.0, 4).collect()}
    assert flat[3] == (6.0, True) and flat[2] == (11.5, False) and flat[4] == (40.0, False)
    searches = spark.createDataFrame([(1, 1, 0.0, 4.0, 4.0, True, True), (1, 2, 0.0, 11.0, 6.0, True, False), (1, 3, 1.0, 4.0, 4.0, True, True), (1, 4, 5.0, 8.0, 2.0, False, True), (1, 5, 3.0, 3.5, 1.0, True, True)], "key long, point long, lo double, hi double, level double, rising boolean, first boolean")
    at = {r["point"]: r["t_cross"] for r in P.level_crossing(samples, searches, 4.0).collect()}
    assert at == {1: 0.8, 2: pytest.approx(9 + 4 / 7), 3: 1.0, 4: 6.0, 5: None}
    back = spark.createDataFrame([(1, 1, 5.0, 11.0, 2.0, 0.1, True), (1, 2, 0.0, 11.0, 2.0, 0.1, False), (1, 3, 0.0, 4.0, 2.0, 0.1, True), (1, 4, 0.0, 7.0, 2.0, 0.1, False)], "key long, point long, lo double, hi double, base double, sigma double, forward boolean")
    assert {r["point"]: r["t"] for r in P.baseline_return(samples, back, 3, 4.0).collect()} == {1: 8.0, 2: 7.0, 3: None, 4: None}


def test_smoothed_of_any_chunks(spark):
    samples, rows = signal(spark, [333])
    samples = samples.fillna(0.0)
    v = np.array([r[3] or 0.0 for r in rows])[::3]
    padded = np.r_[[v[0]] * 4, v, [v[-1]] * 4]
    want = [padded[i : i + 9].mean() for i in range(len(v))]
    for chunk in (5, 40, 65_536):
        got = [r["v"] for r in P.smoothed(samples, 3, 10, chunk).orderBy("i").collect()]
        assert got == pytest.approx(want)


def test_edits_of_missing_deleted_and_given_events(spark):
    log = [(1, 1, "update", 1, {"event_start": "5"}, None), (1, 2, "update", None, {"notes": None}, None), (1, 3, "update", 1, {"notes": "x"}, None), (1, 4, "delete", 9, None, None), (1, 5, "update", 4, {"notes": "y"}, None), (1, 6, "delete", None, None, None), (2, 1, "update", 1, {"notes": "z"}, None), (2, 2, "create", None, {"notes": "a", "odd": "b"}, {"d": 1.0}), (2, 3, "create", None, {}, None), (2, 4, "update", 1, {"file_name": "no"}, None)]
    edits = spark.createDataFrame(log, D.EDIT_TYPES).repartition(5)
    events = spark.createDataFrame([(1, 1, False, {"notes": "n"}, {"duration": 2.0}), (7, 3, True, {}, None)], "event long, version long, deleted boolean, fields map<string,string>, derived map<string,double>")
    decided = D.apply_edits(edits, events)
    got = [(r["event"], r["edit"], r["accepted"], r["reason"], r["version"]) for r in sorted(decided.collect())]
    assert got == [(1, 1, True, None, 2), (1, 2, True, None, 3), (1, 3, False, "stale", 3), (1, 4, True, None, 4), (1, 5, False, "deleted", 4), (1, 6, False, "deleted", 4), (2, 1, False, "deleted", 0), (2, 2, True, None, 1), (2, 3, False, "exists", 1), (2, 4, True, "nothing to change", 1)]
    after = {r["event"]: r for r in D.edited_events(events, decided).collect()}
    assert after[1]["fields"] == {"notes": None, "event_start": "5"} and after[1]["derived"] is None and after[1]["deleted"]
    assert after[2]["fields"] == {"notes": "a"} and after[2]["derived"] == {"d": 1.0} and after[7]["version"] == 3
    assert D.apply_edits(edits.limit(0)).count() == 0


def test_live_edges_with_late_samples_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)
    rows = []
    for key, n in ((1, 400), (2, 250)):
        v = rng.normal(0, 1, n) + np.where(np.arange(n) % 60 > 30, 12, 0)
        rows += [(key, start + dt.timedelta(seconds=int(i)), i, float(x)) for i, x in enumerate(v)]
    far = [(3, start + dt.timedelta(seconds=2000), 0, 0.0), (3, start + dt.timedelta(seconds=2001), 1, 0.0)]
    schema = "key long, ts timestamp, seq long, v double"
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=int(random.Random(r[2] * 7 + r[0]).randint(0, 25))))  # up to 25 s late
    parts = [order[i : i + 130] for i in range(0, len(order), 130)] + [far[:1], [(1, start + dt.timedelta(seconds=3), 999, 1e6)], far[1:]]  # the last but one is too late
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        edges = jobs.stream_edges(stream, 2, 20, 5.0, 2, "30 seconds", 300.0)
        run = edges.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", out).start()
        run.awaitTermination()
    got = spark.read.parquet(out)
    batch = spark.createDataFrame([(k, s, t.timestamp(), v) for k, t, s, v in rows], "key long, i long, t double, v double")
    want = T.edge_candidates(T.robust_z(batch, 2, 20), 5.0, 2)
    text = lambda df: sorted((r["key"], r["t"], round(r["z"], 6), r["direction"], r["t_start"], r["t_end"], r["n"]) for r in df.collect())
    assert text(got) == text(want) and len(text(want)) > 8
