"""Filters and grids over chunks, landmarks of windows with known events, replicates in units."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import dsp
from corvane.operators import landmarks as Z
from corvane.operators import mixture as G
from corvane.operators import smoothing as L

FS = 1000.0


def long(spark, signals):
    rows = [(k, i, float(x)) for k, v in signals.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "key long, i long, v double").repartition(6)


def values(df, key):
    return np.array([r["v"] for r in df.where(F.col("key") == key).orderBy("i").collect()])


@pytest.mark.parametrize("chunk", [700, 65_536])
def test_filters_do_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(0)
    signals = {1: np.cumsum(rng.normal(size=3000)), 2: rng.normal(size=7), 3: rng.normal(size=701)}
    samples = long(spark, signals)
    for sections in (dsp.butterworth_sections(6, 100, FS), dsp.bessel_sections(8, 25, FS)):
        got = L.zero_phase(samples, FS, sections, chunk)
        for k, v in signals.items():
            assert np.allclose(values(got, k), dsp.zero_phase_filter(v, sections, FS), atol=1e-5)


@pytest.mark.parametrize("chunk", [64, 65_536])
@pytest.mark.parametrize("target", [400.0, 300.0, 1500.0, 250.0])
def test_grids_do_not_depend_on_chunks(spark, chunk, target):
    rng = np.random.default_rng(1)
    signals = {1: np.cumsum(rng.normal(size=500)), 2: rng.normal(size=65), 3: rng.normal(size=1)}
    samples = long(spark, signals)
    ratio = Fraction(target / FS).limit_denominator(1000)
    sections = dsp.butterworth_sections(6, 0.45 * min(FS, target), FS)
    new, rate = L.resampled(samples, FS, target, chunk=chunk)
    grid, _ = L.regridded(samples, FS, target, chunk)
    assert rate == pytest.approx(target)
    for k, v in signals.items():
        y = dsp.zero_phase_filter(v, sections, FS) if ratio < 1 else v
        n = -(-len(v) * ratio.numerator // ratio.denominator)
        assert np.allclose(values(new, k), np.interp(np.arange(n) / float(ratio), np.arange(len(v)), y), atol=1e-5)
        plain = v[:: round(FS / target)] if (FS / target).is_integer() else np.interp(np.arange(int(len(v) * target / FS)) * FS / target, np.arange(len(v)), v)
        assert np.allclose(values(grid, k), plain, atol=1e-9)


def test_model_input(spark):
    rng = np.random.default_rng(2)
    v = np.cumsum(rng.normal(size=700))
    got = L.window_features(long(spark, {5: v}), FS, 64).orderBy("row", "point").collect()

    def mean(x, w):
        h = (w - (w % 2 == 0)) // 2
        return np.convolve(np.pad(x, h, mode="edge"), np.ones(2 * h + 1) / (2 * h + 1), "valid")

    thin = v[::2]
    at = np.minimum(np.linspace(0, len(v) - 1, 64) / 2, len(thin) - 1)
    rows = [np.interp(at, np.arange(len(thin)), r) for r in (thin, mean(thin, 10), mean(thin, 40))] + [np.linspace(0, 1, 64)]
    want = [(r - np.median(r)) / (1e-9 + np.median(np.abs(r - np.median(r)))) for r in rows]
    assert np.allclose(np.array([r["value"] for r in got]).reshape(4, 64), want, atol=1e-6)


def window(rng, up=0.12, start=1500, stop=2200, n=4000):
    optical = 1 + rng.normal(0, 0.004, n)
    optical[start:stop] += up
    electrical = 100 + rng.normal(0, 2, n)
    electrical[start : start + 6] += 60
    electrical[stop - 6 : stop] -= 50
    return optical, 0.8 + 0.4 * (optical - 1), electrical


def test_landmarks_of_known_events(spark):
    rng = np.random.default_rng(2)
    made = {1: window(rng), 2: window(rng, 0.3, 1000, 3000), 3: tuple(np.r_[x][:900] for x in window(rng, 0.0)), 4: window(rng, 0.12, 2500, 4000), 5: tuple(x[:20] for x in window(rng))}
    rows = [(e, i, i / FS + 7, *map(float, v)) for e, x in made.items() for i, v in enumerate(zip(*x, strict=True))]
    windows = spark.createDataFrame(rows, "event long, i long, t double, optical double, reference double, electrical double").repartition(6)
    guess = spark.createDataFrame([(4, 9.51, 10.0, 10.9)], "event long, base double, plateau double, end double")
    found = Z.detect_landmarks(windows, FS, estimates=guess)
    got = {r["event"]: r for r in found.collect()}
    pair = "edges: full pair + level-crossing"
    assert [got[e]["method"] for e in (1, 2, 5)] == [pair, pair, "too few samples"] and got[5]["start_t"] is None
    assert abs(got[1]["start_t"] - 8.5) < 0.01 and abs(got[1]["end_t"] - 9.2) < 0.06
    assert abs(got[2]["start_t"] - 8.0) < 0.01 and abs(got[2]["end_t"] - 10.0) < 0.06
    assert got[3]["method"] == "edges: no rise found, fallback used; edges: no fall found, fallback used"
    assert (got[3]["start_t"], got[3]["end_t"]) == (7.0, 7.899)
    for e in (1, 2):
        r = got[e]
        assert r["start_t"] <= r["plateau_t"] <= r["end_t"] and r["entry_base_t"] < r["entry_peak_t"] < r["exit_peak_t"] < r["exit_base_t"]
        assert abs(r["entry_base_v"] - 100) < 8
    measures = {r["event"]: r for r in Z.event_measures(found).collect()}
    assert measures[1]["duration"] == pytest.approx(got[1]["end_t"] - got[1]["start_t"])
    assert measures[1]["ref_osc"] > 0 and measures[5]["duration"] is None
    assert got[4]["method"].startswith(("edges: rise snap", "edges: no rise", pair))


def test_edges_of_windows_equal_those_of_one_array(spark):
    """Edges over the joined tables against the same steps on one array."""
    from corvane.operators.trailing import lag_z

    rng = np.random.default_rng(3)
    v = window(rng)[0]
    cfg = Z.EdgeConfig()
    samples = long(spark, {1: v}).withColumn("t", F.col("i") / FS)
    got = sorted((r["direction"], r["t_start"], r["t_end"], round(r["z"], 4)) for r in Z.window_edges(samples, FS, cfg).collect())
    y = dsp.zero_phase_filter(v, dsp.bessel_sections(8, 25, FS), FS)
    frame = int(min(8.0, max(0.5, (len(v) - 1) / FS * 0.4)) * FS + 0.5)
    d, z = lag_z(y, 30, frame, 5, 1e-4)
    want, start = [], None
    for i, on in enumerate([*(np.abs(z) >= 4.5), False]):
        if on and start is None:
            start = i
        if not on and start is not None:
            if i - start >= 20:
                peak = start + int(np.argmax(np.abs(z[start:i])))
                want.append((1 if d[peak] > 0 else -1, start / FS, (i - 1) / FS, round(z[peak], 4)))
            start = None
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], rtol=1e-3)


def test_replicates_are_the_same_in_one_unit_or_many(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, (1500, 2)), rng.normal(6, 1, (1000, 2))]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    best = G.gmm_sweep(df, ["a", "b"], [1, 2, 3], 3, 40)
    one = G.bootstrap_lrt(df, best, len(x), 4, 2, iterations=12).orderBy("k").collect()
    many = G.bootstrap_lrt(df, best, len(x), 4, 2, iterations=12, unit_rows=1024).orderBy("k").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in many] and one[0]["p"] == 0.2
