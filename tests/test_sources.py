"""Recordings in ranges, digests, labels per run, registrations and names that are taken."""

import hashlib
import os

import numpy as np
from pyspark.sql import functions as F

from corvane.functions import names as N
from corvane.operators import catalog as K
from corvane.operators import history as H
from corvane.operators import matching as J
from corvane.sources import files, recordings
from corvane.streaming import jobs


def small_reads(most):
    """An opener that refuses more than so many bytes at once; it travels to the tasks by value."""

    class Opened:
        def __init__(self, path):
            self.file = open(path.removeprefix("file:"), "rb")

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read_at(self, n, at):
            assert n <= most, "more than a chunk at once"
            self.file.seek(at)
            return self.file.read(n)

    return Opened


def test_recordings_of_several_sweeps_and_channels(spark, tmp_path):
    rng = np.random.default_rng(1)
    layout = recordings.Int16Format()
    made = {}
    for name, n, channels, sweeps in (("a", 1000, 3, 4), ("b", 7, 1, 1), ("c", 10, 2, 3)):
        h = recordings.Header(n, channels, 50.0, sweeps, [0.01] * channels, [float(c) for c in range(channels)])
        x = np.round(rng.normal(0, 3, (n, channels)), 2)
        made[name] = x
        (tmp_path / f"{name}.rec").write_bytes(layout.packed_header(h) + layout.packed(h, x))
    (tmp_path / "d.rec").write_bytes(layout.packed_header(recordings.Header(0, 1, 50.0, 1, [1.0], [0.0])))
    heads = {os.path.basename(r["file"])[0]: r for r in recordings.recording_headers(spark, str(tmp_path)).collect()}
    assert (heads["a"]["n"], heads["a"]["sweeps"], heads["a"]["duration"]) == (1000, 4, 20.0) and heads["d"]["n"] == 0
    got = recordings.decode_recordings(spark, str(tmp_path), chunk=96, opener=small_reads(recordings.HEADER)).collect()
    for name, x in made.items():
        for c in range(x.shape[1]):
            rows = sorted((r for r in got if r["file"].endswith(f"{name}.rec") and r["channel"] == c), key=lambda r: r["i0"])
            assert np.allclose(np.concatenate([r["values"] for r in rows]), x[:, c], atol=1e-6)
            assert all(len(r["values"]) <= 96 for r in rows)
    assert {r["i0"]: r["sweep0"] for r in got if r["file"].endswith("a.rec")}[960] == 3
    assert not any(r["file"].endswith("d.rec") for r in got)
    sweeps = recordings.sweeps_of(recordings.recording_headers(spark, str(tmp_path))).where("file like '%c.rec'").orderBy("sweep").collect()
    assert [(r["s0"], r["s1"]) for r in sweeps] == [(0.0, 0.06), (0.06, 0.12), (0.12, 0.2)]  # the last sweep takes the rest


def test_values_beyond_int16_and_missing_ones(spark, tmp_path):
    values = {1: [0.0, -27.68, 627.67], 2: [0.0, 627.68, -5000.25, 1e7], 3: [1.5, None, 2.25], 4: [-27.69]}
    rows = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "key long, i long, v double")
    assert recordings.write_recordings(rows, f"file://{tmp_path}", 10.0, 0.01, 300.0).count() == 4
    got = recordings.decode_recordings(spark, str(tmp_path), "*.rec", 2).orderBy("file", "i0").collect()
    for k, vs in values.items():
        found = np.concatenate([r["values"] for r in got if r["file"].endswith(f"/{k}.rec")])
        assert np.allclose(found, np.array(vs, float), atol=1e-4, rtol=1e-7, equal_nan=True)
    assert [os.path.getsize(tmp_path / f"{k}.rec") - recordings.HEADER for k in values] == [6, 32, 24, 8]


def test_digests_block_by_block(spark, tmp_path, monkeypatch):
    contents = {"x.bin": os.urandom(100_000), "sub/y.bin": b"abc"}
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(recordings, "READ_BYTES", 1000)
    got = {r["name"]: (r["size"], r["sha256"]) for r in recordings.file_digests(spark, str(tmp_path), "*.bin").collect()}
    assert got == {os.path.basename(n): (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}


def test_files_of_double_extensions(spark, tmp_path):
    for name in ("a.fakeabf.npz", "b.npz", "c.ABF", ".hidden.abf"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["name"] for r in files.list_files(spark, str(tmp_path), [".fakeabf.npz", ".abf"]).collect()] == ["a.fakeabf.npz", "c.ABF"]


def test_labels_of_one_run_are_replaced(spark, tmp_path):
    path = str(tmp_path / "labels")
    rows = [(r, e, 10 + e, e % 2) for r in (1, 2, 3) for e in range(40)]
    labels = spark.createDataFrame(rows, "run long, event long, recording long, cluster int")
    H.replace_run_labels(labels, labels.select("run"), path)
    before = {f: os.stat(f).st_mtime_ns for d, _, fs in os.walk(f"{path}/run=1") for f in (f"{d}/{x}" for x in fs)}
    new = spark.createDataFrame([(2, 5, 1, 7), (2, 5, 0, 9), (2, 6, 1, 8), (9, 1, 1, 1)], labels.schema)
    runs = spark.createDataFrame([(2,), (3,)], "run long")
    for _ in range(2):
        H.replace_run_labels(new, runs, path)
        assert sorted(map(tuple, H.run_labels(spark, path).collect())) == [*[r for r in rows if r[0] == 1], (2, 5, 1, 7), (2, 6, 1, 8)]
    assert before == {f: os.stat(f).st_mtime_ns for d, _, fs in os.walk(f"{path}/run=1") for f in (f"{d}/{x}" for x in fs)}


def test_registered_recordings(spark):
    known = spark.createDataFrame([(1, 5, "a", "old a", "missing", "gone", "DC"), (2, 5, "b", "old b", "ready", None, "AC")], "rec_id long, exp_id long, stem string, file_name string, status string, error string, condition string")
    new = spark.createDataFrame([(5, "a", "A.abf", "AOM"), (5, "b", "B.abf", "AOM"), (5, "c", "C.abf", None), (5, "c", "C2.abf", "DC"), (6, "a", "A.abf", "DC")], "exp_id long, stem string, file_name string, condition string")
    got = {r["rec_id"]: tuple(r)[1:] for r in J.registered(new, known, 100).collect()}
    assert got == {1: (5, "a", "A.abf", "pending", None, "AOM"), 2: (5, "b", "old b", "ready", None, "AC"), 100: (5, "c", "C.abf", "pending", None, None), 101: (6, "a", "A.abf", "pending", None, "DC")}
    over = {r["rec_id"]: r["file_name"] for r in J.registered(new, known, 100, replace=True).collect()}
    assert over[2] == "B.abf" and len(over) == 4
    assert J.registered(new.limit(0), known, 100).count() == 2


def test_names_that_are_taken(spark):
    rows = [(1, "x"), (2, "x"), (3, "x (2)"), (4, "y"), (5, None), (6, "x (2)"), (7, "new\nline"), (8, "new\nline")]
    taken = spark.createDataFrame([("y",), ("y (2)",), ("y (2)",), ("x (3)",), (None,)], "name string")
    got = {r["k"]: r["unique_name"] for r in N.unique_names(spark.createDataFrame(rows, "k int, name string"), "name", ["k"], taken=taken).collect()}
    assert got == {1: "x", 2: "x (4)", 3: "x (2)", 4: "y (3)", 5: None, 6: "x (2) (2)", 7: "new\nline", 8: "new\nline (2)"}
    alone = N.unique_names(spark.createDataFrame([(1, "a"), (2, "a")], "k int, name string"), "name", ["k"]).collect()
    assert {r["unique_name"] for r in alone} == {"a", "a (2)"}


def test_name_keys_with_and_without_folding(spark):
    names = ["C:\\data\\A_b  C.ABF", "x y.abf", None, " ", "Ａ＿b.abf", "é_É.csv"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(9, "Ａ＿b.abf")], "k int, name string")
    got = {r["k"]: r["key"] for r in N.with_name_key(df, "name", "key").collect()}
    want = {r["k"]: r["key"] for r in df.withColumn("key", N.name_key(F.col("name"))).collect()}
    assert got == want and got[0] == "a b c" and got[2] == got[3] == ""


def test_blank_keys_match_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "z")], "k int, key string")
    recs = spark.createDataFrame([("a", 7), ("a", 5), ("", 6)], "key string, rec_id int")
    for most in (200_000, 0):
        monkeypatch.setattr(J, "MAX_BROADCAST_KEYS", most)
        assert {r["k"]: r["rec_id"] for r in J.match_recordings(rows, recs, "key", "rec_id").collect()} == {1: 5, 2: None, 3: None, 4: None}
        assert {r["k"]: r["rec_id"] for r in J.match_recordings(rows, recs, "key", "rec_id", 9).collect()} == {1: 5, 2: 9, 3: 9, 4: 9}


def test_roles_by_units_and_names(spark):
    role = lambda *cs: F.array(*[F.struct(F.lit(i).alias("index"), F.lit(n).alias("name"), F.lit(u).alias("units")) for i, (n, u) in enumerate(cs)])
    one = lambda *cs: tuple(spark.range(1).select(K.channel_roles(role(*cs))).first()[0])
    assert one(("x", "mV"), ("I", "NA"), ("o", "V"), ("OptREF", "v")) == (1, 2, 3)
    assert one(("o", "V"), ("p", "V"), ("I", "pA")) == (2, 0, 1)  # no name in ref: the second in volts
    assert one(("I", "pA"), ("r ref", "V"), ("o", "V")) == (0, 2, 1)
    assert one(("I", "pA"), ("a", "mV"), ("b", None), ("c", "mV")) == (0, 1, 2)
    assert one(("I", "pA"), ("a", "mV")) == (0, 1, 1) and one(("o", "V")) == (0, 0, 0)


def test_exclusion_log_and_experiments(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("a", 2, 1), ("b", 1, 1), ("b", 2, 2)], "f string, r int, cluster int")
    before = spark.createDataFrame([("a", 2), ("z", 9)], "f string, r int")
    assert tuple(H.exclusion_log(df, [0, 1], before, ["f", "r"]).first()) == ([0, 1], 3, 2, 4)
    assert tuple(H.exclusion_log(df.limit(0), [1], before.limit(0), ["f", "r"]).first()) == ([1], 0, 0, 0)
    plan = spark.createDataFrame([("e", " ", True, False, False), ("e", None, False, True, True), ("e", "DC", True, False, False)], "experiment string, condition string, selected boolean, exists boolean, differs boolean")
    assert tuple(J.plan_by_experiment(plan).first()) == ("e", 3, 2, 1, 1, {"DC": 1, "other": 2})


def test_streams_of_tables_in_one_file_or_in_many(spark, tmp_path):
    rows = spark.range(60).withColumn("text", F.col("id").cast("string"))
    rows.repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "one.parquet")
    for name in ("one", "many"):
        got = jobs.run_available(jobs.file_stream(spark, str(tmp_path), name)).collect()
        assert sorted(map(tuple, got)) == [(i, str(i)) for i in range(60)]
