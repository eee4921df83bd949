"""The numpy helpers against plain definitions and synthetic truth."""

import numpy as np
import pytest

from corvane.functions import dsp
from corvane.operators import mixture as G
from corvane.sources import files


def recursion(x, sections):
    for b0, b1, b2, a1, a2 in sections:
        y = np.zeros(len(x))
        for i in range(len(x)):
            y[i] = b0 * x[i] + (b1 * x[i - 1] - a1 * y[i - 1] if i > 0 else 0) + (b2 * x[i - 2] - a2 * y[i - 2] if i > 1 else 0)
        x = y
    return x


@pytest.mark.parametrize("sections", [dsp.bessel_sections(8, 100, 5000), dsp.butterworth_sections(6, 100, 5000), dsp.butterworth_sections(5, 100, 5000)])
def test_filter_is_the_recursion(sections):
    x = np.random.default_rng(0).normal(size=2500)
    assert np.allclose(dsp.causal_filter(x, sections, 5000), recursion(x, sections), atol=1e-7)


def test_bessel_gain():
    h = dsp.impulse_response(dsp.bessel_sections(8, 100, 10_000), 4000)
    gain = [abs(np.sum(h * np.exp(-2j * np.pi * f / 10_000 * np.arange(4000)))) for f in (0, 50, 100)]
    assert np.allclose(gain, [1, 0.724, 0.235], atol=5e-3)


def test_zero_phase_keeps_a_line_and_short_windows():
    line = np.linspace(0, 5, 400)
    assert np.allclose(dsp.zero_phase_filter(line, dsp.butterworth_sections(6, 25, 1000), 1000), line, atol=1e-3)
    assert (dsp.zero_phase_filter(line[:7], dsp.butterworth_sections(6, 25, 1000), 1000) == line[:7]).all()


def test_table_decoding():
    assert files.decode_table("a;b\n1;é\n".encode("cp1252")) == ([{"a": "1", "b": "é"}], None)
    assert files.decode_table(b"a,b;c\n1,2;3\n4,5,6;7\n") == ([{"a,b": "1,2", "c": "3"}, {"a,b": "4,5,6", "c": "7"}], None)  # the comma varies
    assert files.decode_table(b"") == ([], "no header")


def test_mixture_finds_separate_groups(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, (300, 2)), rng.normal(8, 1, (100, 2))]
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    best = G.gmm_sweep(df, ["a", "b"], [1, 2], 2, 50)
    table = {r["k"]: r["bic"] for r in G.sweep_table(df, best, len(x), 2).collect()}
    assert table[2] < table[1]
    labels = {r["id"]: r["labels"] for r in G.assign_clusters(df, ["a", "b"], {k: m for k, (_, m) in best.items()}).collect()}
    assert all(labels[i] == [0, int(i >= 300)] for i in range(400))
    p = G.bootstrap_lrt(df, best, len(x), 9, 1).first()["p"]
    assert p == 0.1 and G.select_k(G.bootstrap_lrt(df, best, len(x), 9, 1), 0.2) == 2


def test_registered_run_leaves_out_a_small_cluster(spark, monkeypatch):
    from corvane.plans import q_models

    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(0, 1, (120, 4)), rng.normal(12, 1, (100, 4)), rng.normal(-12, 1, (16, 4))]
    points = spark.createDataFrame([(i, 0, *map(float, v)) for i, v in enumerate(x)], "vec_id long, label int, x0 double, x1 double, x2 double, x3 double").coalesce(1).cache()
    monkeypatch.setattr(q_models, "_points", lambda *_: points)
    rows = q_models.min_cluster_filter(spark, "").collect()
    assert {r["vec_id"] for r in rows if r["excluded"]} == set(range(220, 236))
    assert {r["k"] for r in rows if not r["excluded"]} == {2}
