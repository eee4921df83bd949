"""Windows as arrays: cut, filtered and searched in their rows, against the joined forms and single arrays."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import dsp, picks
from corvane.operators import landmarks as Z
from corvane.operators import searches as P
from corvane.operators import signal as S
from corvane.operators import trailing as T
from corvane.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_windows_cut_as_arrays(spark):
    samples = spark.createDataFrame([(k, i, i / 10 - 3, float(i * k)) for k in (1, 2) for i in range(300) if i % 7], "key long, i long, t double, v double")
    rng = np.random.default_rng(0)
    starts = [*rng.uniform(-6, 30, 60), -3.0, 26.9, 27.0, 99.0]
    wins = spark.createDataFrame([(e, 1 + e % 3, float(t), float(t + (e % 5) / 2)) for e, t in enumerate(starts)], "event long, key long, t0 double, t1 double")
    want = {r["event"]: (r["t"], r["v"]) for r in S.gather_windows(S.cut_windows(wins, samples, 2.0)).collect()}
    for width in (2.0, 50.0):
        cut = S.cut_arrays(wins, samples.repartition(3), width).collect()
        assert {r["event"]: (r["t"], r["v"]) for r in cut} == want and all(r["i"] == sorted(r["i"]) for r in cut)
    with pytest.raises(Exception, match="longer than width"):
        S.cut_arrays(wins, samples, 1.9).collect()


@pytest.mark.parametrize("n, frame", [(5, 5), (65, 50), (400, 40), (400, 160), (3, 5)])
def test_frames_of_many_rows_equal_those_of_one(n, frame):
    v = np.round(np.random.default_rng(n).normal(0, 2, (7, n)), 1)
    d, z = T.lag_z_of_rows(v, 3, frame, 5, 1e-4)
    for row, dd, zz in zip(v, d, z, strict=True):
        for got, want in zip((dd, zz), T.lag_z(row, 3, frame, 5, 1e-4), strict=True):
            np.testing.assert_array_equal(got, want)


def test_filters_of_many_rows_equal_those_of_one():
    v = np.random.default_rng(1).normal(size=(5, 90))
    for n in (90, 65, 8, 7):
        many = dsp.zero_phase_filter(v[:, :n], dsp.bessel_sections(8, 25, 100.0), 100.0)
        assert np.allclose(many, [dsp.zero_phase_filter(x, dsp.bessel_sections(8, 25, 100.0), 100.0) for x in v[:, :n]], atol=1e-12)


def test_scores_of_many_windows_equal_those_of_one():
    rng = np.random.default_rng(5)
    weights = {f"conv{i}_w": rng.normal(0, 0.3, (6, 4 if i == 0 else 6, 5)) for i in range(4)} | {f"conv{i}_b": rng.normal(size=6) for i in range(4)}
    weights |= {"dense0_w": rng.normal(0, 0.3, (8, 6)), "dense0_b": rng.normal(size=8), "dense1_w": rng.normal(0, 0.3, (3, 8)), "dense1_b": rng.normal(size=3)}
    x = rng.normal(size=(4, 4, 16))
    many = dsp.score_landmarks(x, weights)
    assert many.shape == (4, 3) and np.allclose(many, [dsp.score_landmarks(w, weights) for w in x], atol=1e-12)


@pytest.mark.parametrize("fs", [100.0, 4000.0])
def test_edges_of_arrays_equal_those_of_the_joined_form(spark, fs):
    rng = np.random.default_rng(2)
    windows = {k: np.round(np.cumsum(rng.normal(size=n)), 2) for k, n in enumerate((65, 65, 40, 16, 15, 900, 65))}
    rows = spark.createDataFrame([(k, i, i / fs + k, float(x)) for k, v in windows.items() for i, x in enumerate(v)], "key long, i long, t double, v double")
    cfg = Z.EdgeConfig(threshold=1.5)
    want = sorted((r["key"], r["direction"], r["t_start"], r["t_end"]) for r in Z.window_edges(rows, fs, cfg).collect())
    got = sorted((k, *e) for k, edges in enumerate(Z.edges_of([(np.arange(len(v)) / fs + k, v) for k, v in windows.items()], fs, cfg)) for e in edges)
    assert got and [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:] for g in got], [w[2:] for w in want])


def test_searches_in_arrays_equal_the_joined_ones(spark):
    rng = np.random.default_rng(3)
    made = {k: (np.arange(n) / 100, np.round(rng.normal(0, 2, n))) for k, n in enumerate(rng.integers(1, 60, 40))}
    rows = spark.createDataFrame([(k, i, float(a), float(b)) for k, (t, v) in made.items() for i, (a, b) in enumerate(zip(t, v, strict=True))], "key long, i long, t double, v double").cache()
    spans = [(k, p, *map(float, sorted(rng.uniform(-0.05, 0.65, 2)))) for k in made for p in range(6)]
    asked = spark.createDataFrame([(*s, (s[2] + s[3]) / 2, s[1] % 2 == 0, 0.5, 1.0) for s in spans], "key long, point long, lo double, hi double, estimate double, forward boolean, level double, sigma double")
    of = lambda df, column: {(r["key"], r["point"]): r[column] for r in df.collect()}
    tallest = {s: of(P.tallest_peak(rows, asked, 0.3, s, 2).withColumn("x", F.when(F.col("kind") != "none", F.col("t"))), "x") for s in (1, -1)}
    flat = of(P.flattest_window(rows, asked, 0.3).withColumn("x", F.when(F.col("moved"), F.col("t"))), "x")
    crossed = of(P.level_crossing(rows, asked.withColumns({"rising": F.col("forward"), "first": F.lit(True)}), 0.3), "t_cross")
    back = of(P.baseline_return(rows, asked.withColumn("base", F.col("level")), 3, 0.3), "t")
    for k, p, lo, hi in spans:
        t, v = made[k]
        assert [picks.tallest(t, v, lo, hi, s, 2) for s in (1, -1)] == [tallest[s][k, p] for s in (1, -1)]
        assert picks.flattest(t, v, lo, hi) == flat[k, p]
        assert picks.crossing(t, v, lo, hi, 0.5, p % 2 == 0) == pytest.approx(crossed[k, p])
        assert picks.settled(t, v, lo, hi, 0.5, 2.5, 3, p % 2 == 0) == back[k, p]


@pytest.mark.parametrize("name", ["detect_landmarks", "electrical_landmarks", "window_features", "score_windows", "event_measures"])
def test_windows_are_neither_stored_nor_shuffled_again(spark, name):
    """Samples are dealt to recordings and blocks, and windows to blocks; nothing follows with a row a sample."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    found = registry.QUERIES[name](spark, SF)
    assert found.count() > 0 and set(os.listdir(folder)) == before
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1 and plan.count("Window ") <= 2
