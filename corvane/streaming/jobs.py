"""Streaming forms: envelopes, imports and live edges (edits: operators/edits.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.trailing import LEAST, lag_z
from corvane.storage import new_folder


def _scratch(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table's files as a stream; the table is a file, or a folder of files under any names."""
    path = f"{sf_dir}/{name}.parquet"
    # As a pattern, for a stream takes a path without one to be a folder.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream into a Parquet sink, read back."""
    root = _scratch(df.sparkSession)
    query = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/state").format("parquet").option("path", f"{root}/out").start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/out")


def stream_envelope(samples: DataFrame, width: str, late: str, time: str = "ts", channel: str = "channel", value: str = "v") -> DataFrame:
    """Min and max per time bin and channel; bins close when the watermark passes them."""
    return samples.withWatermark(time, late).groupBy(F.window(time, width), channel).agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"), F.count(F.lit(1)).alias("n")).select(channel, F.col("window.start").alias("bin"), "vmin", "vmax", "n")


def stream_import(stream: DataFrame, known_path: str, key: str, state_path: str | None = None) -> None:
    """Append rows with keys that the table does not have yet; a repeated run adds nothing.

    state_path: the folder that remembers which files were read, so that a later run goes on with
    new ones only; by default one beside the table.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def add(batch: DataFrame, _: int) -> None:
        known = spark.read.schema(schema).parquet(known_path).select(key).distinct()
        batch.dropDuplicates([key]).join(known, key, "left_anti").select(*schema.names).write.mode("append").parquet(known_path)

    query = stream.writeStream.foreachBatch(add).trigger(availableNow=True).option("checkpointLocation", state_path or f"{known_path.rstrip('/')}-state").start()
    query.awaitTermination()


EDGE_SCHEMA = "key long, t double, z double, direction int, t_start double, t_end double, n long"
EDGE_STATE = "tail array<double>, wait_t array<double>, wait_s array<long>, wait_v array<double>, last double, run array<double>"


def stream_edges(samples: DataFrame, lag: int, frame: int, threshold: float, persist: int, late: str, quiet_s: float = 3600.0, least: int = LEAST, floor: float = 1e-4) -> DataFrame:
    """Edges (EDGE_SCHEMA) of samples (key, ts, seq, v) as they arrive: those that edge_candidates finds
    on the robust z of the same samples in order of ts and seq.

    Samples wait until the watermark (late) has passed them, so that late ones take their place; later
    ones than that are dropped. A run is given out when a sample ends it, or by an event-time timer when
    the key has been silent for quiet_s. State per key: the last 2 * frame + lag values, the waiting
    samples and the open run (length, peak size, and the peak's t, z, d, then its ends).
    """
    reach = 2 * frame + lag

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tail, wait_t, wait_s, wait_v, last, run = state.get if state.exists else ([], [], [], [], 0.0, [])
        run, mark = list(run), state.getCurrentWatermarkMs()
        rows = pd.DataFrame({"t": np.asarray(wait_t, float), "s": np.asarray(wait_s, np.int64), "v": np.asarray(wait_v, float)})
        if not state.hasTimedOut:
            new = pd.concat(list(batches))
            t = (new["ts"] - pd.Timestamp(0)).dt.total_seconds() if new["ts"].dt.tz is None else new["ts"].dt.tz_convert("UTC").astype("int64") / 1e9
            rows = pd.concat([rows, pd.DataFrame({"t": t.to_numpy(float), "s": new["seq"].to_numpy(np.int64), "v": new["v"].to_numpy(float)})])
        rows = rows.sort_values(["t", "s"], kind="stable")
        ready = rows[rows["t"] * 1000 <= mark]
        waits = rows[rows["t"] * 1000 > mark]
        out = []
        if len(ready):
            values = np.r_[np.asarray(tail, float), ready["v"].to_numpy()]
            d, z = lag_z(values, lag, frame, least, floor)
            for t, dd, zz in zip(ready["t"].to_numpy(), d[len(tail) :], z[len(tail) :], strict=True):
                if abs(zz) >= threshold:
                    run = [run[0] + 1, *run[1:6], t] if run else [1.0, -1.0, 0.0, 0.0, 0.0, t, t]
                    if abs(zz) > run[1]:
                        run[1:5] = [abs(zz), t, zz, dd]
                elif run:
                    out.append(run)
                    run = []
            tail, last = values[-reach:].tolist(), float(ready["t"].iloc[-1])
        if run and mark >= (last + quiet_s) * 1000:
            out.append(run)
            run = []
        state.update((tail, waits["t"].tolist(), waits["s"].tolist(), waits["v"].tolist(), last, [float(x) for x in run]))
        if len(waits):
            state.setTimeoutTimestamp(max(mark + 1, int(np.ceil(waits["t"].iloc[0] * 1000))))
        elif run:
            state.setTimeoutTimestamp(max(mark + 1, int(np.ceil((last + quiet_s) * 1000))))
        found = [(key[0], r[2], r[3], 1 if r[4] > 0 else -1, r[5], r[6], int(r[0])) for r in out if r[0] >= persist]
        yield pd.DataFrame(found, columns=[c.split()[0] for c in EDGE_SCHEMA.split(", ")])

    return samples.select("key", "ts", "seq", "v").withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, EDGE_SCHEMA, EDGE_STATE, "append", "EventTimeTimeout")
