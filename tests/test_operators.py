"""Edge cases of the operators: nulls, blanks, ties, empty tables, chunk and partition invariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import columns as C
from corvane.functions import dsp
from corvane.operators import filters as X
from corvane.operators import history as H
from corvane.operators import matching as J
from corvane.operators import reports as R
from corvane.operators import signal as S
from corvane.operators import windows as W


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_aliases_and_settings(spark):
    df = spark.createDataFrame([("1.5", "x")], ["Dwell Time", "other"])
    out = C.resolve_columns(df, C.FEATURE_ALIASES)
    assert out.columns == list(C.FEATURE_ALIASES) and out.first()["duration"] == "1.5" and out.first()["OSC"] is None
    assert C.event_header(" Base (V)\t") == "basev"
    with pytest.raises(ValueError):
        C.require_columns(df, ["nope"])
    for bad in ((0.0, 3), (0.05, 1), (0.05, 3, 5, 4)):
        with pytest.raises(ValueError):
            C.check_settings(*bad)


def test_blank_keys_match_nothing(spark):
    recs = spark.createDataFrame([("a", 2), ("a", 1), ("", 9)], "key string, rec_id long")
    refs = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "n long, key string")
    assert rows(J.match_recordings(refs, recs, "key", "rec_id").select("n", "rec_id")) == [(1, 1), (2, None), (3, None), (4, None)]
    assert rows(J.match_recordings(refs, recs, "key", "rec_id", 7).select("n", "rec_id")) == [(1, 1), (2, 7), (3, 7), (4, 7)]
    assert J.match_recordings(refs.limit(0), recs, "key", "rec_id").count() == 0


def test_durations_and_usability(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", None), ("b", 2.0), ("b", 2.0), ("c", None)], "f string, duration double")
    assert rows(X.duration_filter(df, 1, 5)) == [("a", 5.0), ("b", 2.0), ("b", 2.0)]
    assert X.duration_filter(df).count() == 6
    assert {r["f"]: r["reason"] for r in X.feature_usability(df, "f", ["duration"]).collect()} == {"a": "usable", "b": "constant", "c": "too few values"}
    assert X.pooled_features(df.where("f = 'b'"), ["duration"]) == []


def test_names_and_numbers(spark):
    now = spark.createDataFrame([(1, "old")], "k long, name string")
    edits = spark.createDataFrame([(1, " ", 5), (2, " a   b ", 6), (2, "z", 3)], "k long, name string, at long")
    assert rows(H.upsert_names(now, edits, ["k"])) == [(2, "a b")]
    new = spark.createDataFrame([(1, None, 10), (1, 7, 11), (1, None, 12), (2, None, 13)], "s long, number long, id long")
    assert rows(H.number_events(new, new.where("number = 7"), ["s"], "number", ["id"])) == [(1, 7, 11), (1, 8, 10), (1, 9, 12), (2, 1, 13)]


def test_windows(spark):
    sweeps = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 20.0)], "key long, sweep long, s0 double, s1 double")
    wins = spark.createDataFrame([(1, 1, 2.0, 3.0), (2, 1, 8.0, 11.0), (3, 1, 30.0, 31.0), (4, 9, 0.0, 1.0)], "event long, key long, t0 double, t1 double")
    got = {r["event"]: (r["sweep"], r["whole"]) for r in S.window_to_sweep(wins, sweeps, 0.5).collect()}
    assert got == {1: (0, True), 2: (0, False), 3: (None, False), 4: (None, False)}
    samples = spark.createDataFrame([(1, i, i / 10, float(i)) for i in range(300)], "key long, i long, t double, v double")
    for width in (0.3, 7.0):
        cut = S.gather_windows(S.cut_windows(wins.where("event < 3"), samples.repartition(3), width))
        assert {r["event"]: (len(r["v"]), r["v"][0]) for r in cut.collect()} == {1: (11, 20.0), 2: (31, 80.0)}
    points = spark.createDataFrame([(1, 1, 0.25), (1, 2, -1.0), (1, 3, 99.0), (1, 4, 0.5)], "key long, point long, t double")
    got = {r["point"]: r["v"] for r in S.asof_interp(points, samples.select("key", "t", "v")).collect()}
    assert got[1] == pytest.approx(2.5) and got[2] is None and got[3] is None and got[4] == 5.0


def test_chunks_do_not_matter(spark):
    x = np.random.default_rng(6).normal(size=1000)
    whole = dsp.causal_filter(x, dsp.bessel_sections(8, 100.0, 1000.0), 1000.0)
    for size in (300, 1000):
        parts = [("f", 0, k, k * size, 1000.0, x[k * size : (k + 1) * size].tolist()) for k in range(-(-1000 // size))]
        df = spark.createDataFrame(parts, "file string, channel int, chunk_idx long, i0 long, fs double, values array<double>")
        got = W.causal_chunks(df, 8, 100.0).orderBy("i0").collect()
        assert np.allclose(np.concatenate([r["values"] for r in got]), whole, atol=1e-6)


def test_empty_cluster_has_its_row(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (2, None)], "c int, v double")
    got = {r["c"]: (r["n"], r["v_mean"]) for r in R.cluster_summary(df, "c", ["v"], 3).collect()}
    assert got == {0: (2, 2.0), 1: (0, None), 2: (1, None)}
    assert rows(R.rank_clusters(df, "c", "r").select("c", "r")) == [(0, 0), (0, 0), (2, 1)]


def test_legacy_numbers_without_one_task(spark):
    from corvane.operators.events import to_legacy

    rows = [(i * 7919 % 5003, None if i % 3 else 900 + i) for i in range(5003)]
    events = spark.createDataFrame([(k, e, 1, float(k)) for k, e in rows], "k long, event_id long, rec_id long, event_start double")
    out = to_legacy(events, spark.createDataFrame([(1, "a.abf")], "rec_id long, file_name string"), ["k"])
    got = {int(r["event_start (s)"]): r["event_id"] for r in out.collect()}
    free = sorted(k for k, e in rows if e is None)
    assert got == {k: e for k, e in rows if e is not None} | {k: n for n, k in enumerate(free, 1)}
    assert len(out.columns) == 28 and {(r["file_name"], r["sensor"]) for r in out.select("file_name", "sensor").distinct().collect()} == {("a.abf", "")}
    assert "SinglePartition" not in out._jdf.queryExecution().toString()


def test_names_and_conditions(spark):
    from corvane.functions import names as N

    names = ["2026_09_14_0001 B3S8-15\u00a0100 aM  SiO2 DC.abf", "C:\\d\\2026_09_14_00012 S1 v1.5 AC_AOM.fakeabf.npz", "x\u3000Y__z.XLSX", "S1 v1.5", "", None, "AC"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i long, file string")
    rows = N.with_name_key(N.parse_file_name(df, "file"), "file", "key").orderBy("i").collect()
    assert [(r["experiment"], r["condition"], r["run"]) for r in rows] == [
        ("2026_09_14 B3S8-15 100 aM SiO2", "DC", "0001"),
        ("2026_09_14 S1 v1.5", "AC-AOM", "00012"),
        ("x Y__z", "", None),
        ("S1 v1.5", "", None),
        ("Unnamed experiment", "", None),
        ("Unnamed experiment", "", None),
        ("AC", "", None),
    ]
    assert [r["key"] for r in rows] == ["2026 09 14 0001 b3s8-15 100 am sio2 dc", "2026 09 14 00012 s1 v1.5 ac aom", "x y z", "s1 v1.5", "", "", "ac"]
    words = spark.createDataFrame([("ACAOM",), (" ac - aom",), ("Baseline",), (None,), ("dc",)], "w string")
    assert [r[0] for r in words.select(N.normalize_condition(F.col("w"))).collect()] == ["AC-AOM", "AC-AOM", "baseline", "", "DC"]
    keys = spark.createDataFrame([("/d/X  DC.abf",), ("a.tar.gz",), (".hid",), (None,)], "p string").select(N.strict_key(F.col("p"))).collect()
    assert [r[0] for r in keys] == ["x  dc", "a.tar", ".hid", ""]


def test_deleted_events_stay_deleted(spark):
    from corvane.operators.history import fold_history

    log = [(1, 1, "create", {"a": "1"}), (1, 2, "delete", {}), (1, 3, "update", {"a": "2"}), (2, 1, "create", {"a": "1"}), (2, 5, "update", {"a": None})]
    got = {r["event"]: (r["version"], r["deleted"], r["state"]) for r in fold_history(spark.createDataFrame(log, "event long, at long, action string, changes map<string,string>")).collect()}
    assert got == {1: (2, True, {"a": "1"}), 2: (2, False, {"a": None})}


def test_conditions_with_null(spark):
    from corvane.operators.mixture import cluster_by_condition

    rng = np.random.default_rng(3)
    rows = [(c, float(x), float(x * 2)) for c in ("a", None) for x in rng.normal(1e6, 1, 40)]
    df = spark.createDataFrame(rows, "c string, x double, y double")
    out = cluster_by_condition(df, "c", ["x"], max_k=2, n_init=1, n_boot=1)
    assert {(r["c"], r["count"]) for r in out.groupBy("c").count().collect()} == {("a", 40), (None, 40)}


def test_small_cluster_is_left_out(spark):
    """Three separated clusters: more than one is chosen, and the one of 8 rows in 98 goes."""
    from corvane.operators.mixture import run_clustering

    rng = np.random.default_rng(9)
    rows = [(float(a), float(b)) for centre, n in ((0, 45), (30, 45), (90, 8)) for a, b in rng.normal(centre, 1, (n, 2))]
    out = run_clustering(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], max_k=3, n_init=3, n_boot=25, min_percent=10.0).collect()
    assert len(out) == len(rows)
    assert all(r["excluded"] == (r["x"] > 60) and (r["cluster"] is None) == r["excluded"] for r in out)
    assert {r["k"] for r in out if not r["excluded"]} == {2}


def test_catalog_edge_cases(spark):
    """Nulls, blanks, ties, repeats and empty tables of the catalog operators."""
    from corvane.operators import catalog as K

    points = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), (None, 2)], "f string, r long")
    assert K.exclude_points(points, points.where("r = 1"), ["f", "r"]).count() == 2
    assert K.exclude_points(points.limit(0), points, ["f", "r"]).count() == 0
    named = K.cluster_names(spark.createDataFrame([(0,), (1,), (None,)], "cluster int"), spark.createDataFrame([(0, " "), (1, "x")], "cluster int, name string"), ["cluster"])
    assert {r["cluster"]: r["label"] for r in named.collect()} == {0: "C0", 1: "C1 (x)", None: None}
    experiments = spark.createDataFrame([(1, True), (2, None), (3, False), (4, True)], "exp_id int, restricted boolean")
    access = spark.createDataFrame([(1, 7), (1, 7), (4, 8)], "exp_id int, user int")
    assert {r[0] for r in K.visible_experiments(experiments, access, 7).collect()} == {1, 2, 3}
    assert K.visible_experiments(experiments, access.limit(0), 7, is_admin=True).count() == 4
    tables = {"x": spark.createDataFrame([(2.0,), (1.0,), (1.0,)], "d double"), "y": spark.createDataFrame([], "d double, e double")}
    assert sorted((r["source_file"], r["source_row"], r["d"], r["e"]) for r in K.pool_files(tables, ["d"]).collect()) == [("x", 0, 1.0, None), ("x", 1, 1.0, None), ("x", 2, 2.0, None)]
    f = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 5.0)], "g string, u double, v double")
    with pytest.raises(ValueError, match="common features"):
        K.common_features(f, f, "g", ["u", "v"])
    assert K.common_features(f, f, "g", ["v", "u"], least=1) == ["u"]
    recordings = spark.createDataFrame([(1, "  "), (1, None), (1, "DC")], "exp_id int, condition string")
    assert {r["condition"]: r["n"] for r in K.condition_counts(recordings).collect()} == {"other": 2, "DC": 1}
    runs = spark.createDataFrame([(1, "[2, 9, 1]"), (2, "broken"), (3, None)], "run int, set_ids string")
    sets = spark.createDataFrame([(1, "one"), (2, "two")], "set_id long, set_name string")
    assert [tuple(r) for r in K.runs_with_set_names(runs, sets, 1).collect()] == [(1, "two, one", True)]
    models = spark.createDataFrame([(3, 1.5), (2, 1.5), (4, 9.0)], "k int, bic double")
    assert tuple(K.best_bic(models).first()) == (2, 1.5)
    tied = spark.createDataFrame([(2, 5, "done"), (1, 5, "done"), (3, 9, "failed")], "run int, at int, status string")
    assert [r["run"] for r in K.recent_runs(tied, 5).collect()] == [1, 2]
    files = spark.createDataFrame([(1, True, None), (1, False, 5)], "exp_id int, owned boolean, size long")
    assert tuple(K.inventory(files).first()) == (1, 2, 1, 0)
    assert tuple(K.set_stats(spark.createDataFrame([(1, True, None, None)], "set_id int, deleted boolean, updated_at long, author string"), ["set_id"]).first()) == (1, 0, None, 0)
    channels = F.array(F.struct(F.lit(0).alias("index"), F.lit("I").alias("name"), F.lit("pA").alias("units")))
    assert tuple(spark.range(1).select(K.channel_roles(channels)).first()[0]) == (0, 0, 0)
