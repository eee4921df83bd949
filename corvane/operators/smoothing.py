"""Filters and grids of signals of any length, chunk by chunk with borders on both sides."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import dsp, picks
from corvane.operators.quantiles import join_groups
from corvane.operators.trailing import CHUNK, in_chunks, map_groups
from corvane.operators.windows import arrays_of, map_columns

#: Seconds that a chunk sees beyond its ends: each pass of a filter remembers a quarter of a second.
BORDER_S = 0.5


def _mapped(samples: DataFrame, border: int, chunk: int, helper) -> DataFrame:
    """(key, i, v) of helper(values, start, own, total): the chunk's values with borders, the index of the
    first one, the own range (first, stop) and the signal's length give new indexes and values."""
    sized = join_groups(samples.select("key", "i", F.col("v").cast("double").alias("v")), samples.groupBy("key").agg((F.max("i") + 1).alias("_total")), ["key"])
    source = in_chunks(sized, F.lit(border), chunk, F.lit(border))
    schema = samples.select("key", "i", F.col("v").cast("double").alias("v")).schema
    kind = pa.int64()

    def run(table: pa.Table) -> pa.Table:
        start, total, c = int(table.column("i")[0].as_py()), int(table.column("_total")[0].as_py()), int(table.column("_chunk")[0].as_py())
        own = c * chunk, min(total, (c + 1) * chunk)
        i, v = helper(table.column("v").to_numpy().astype(np.float64), start, own, total)
        key = table.column("key").combine_chunks().take(pa.array(np.zeros(len(i), np.int64)))
        return pa.Table.from_arrays([key, pa.array(i, kind), pa.array(v, pa.float64())], names=["key", "i", "v"])

    return map_groups(source, ["key", "_chunk"], "i", run, schema)


def zero_phase(samples: DataFrame, fs: float, sections, chunk: int = CHUNK) -> DataFrame:
    """(key, i, v): the filter of these sections forward and back over samples (key, i, v); signals of less
    than 8 samples stay as they are. Without gaps and nulls in a key; the result does not depend on the chunks."""

    def helper(v, start, own, total):
        y = dsp.zero_phase_filter(v, sections, fs) if total >= 8 else v
        return np.arange(*own), y[own[0] - start : own[1] - start]

    return _mapped(samples, math.ceil(BORDER_S * fs) + 8, chunk, helper)


def _read_at(v: np.ndarray, start: int, own: tuple[int, int], total: int, step: float, most: int):
    """Indexes j < most with j * step in the own range, and the values there between samples."""
    j = np.arange(math.ceil(own[0] / step - 1e-9), most if own[1] == total else min(most, math.ceil(own[1] / step - 1e-9)))
    return j, np.interp(j * step - start, np.arange(len(v)), v)


def resampled(samples: DataFrame, fs: float, target: float, most: int = 1000, chunk: int = CHUNK) -> tuple[DataFrame, float]:
    """(samples (key, i, v) at about the target rate, their rate): by a ratio with a denominator up to most.

    Going down, the signal is low-passed below the new half rate first; a signal of n samples has
    ceil(n * ratio) new ones.
    """
    ratio = Fraction(target / fs).limit_denominator(most)
    if ratio == 1:
        return samples.select("key", "i", F.col("v").cast("double").alias("v")), fs
    sections = dsp.butterworth_sections(6, 0.45 * min(fs, target), fs)
    step = float(1 / ratio)

    def helper(v, start, own, total):
        y = dsp.zero_phase_filter(v, sections, fs) if ratio < 1 else v
        return _read_at(y, start, own, total, step, -(-total * ratio.numerator // ratio.denominator))

    return _mapped(samples, math.ceil(BORDER_S * fs) + 8, chunk, helper), fs * float(ratio)


def regridded(samples: DataFrame, fs: float, target: float, chunk: int = CHUNK) -> tuple[DataFrame, float]:
    """(samples (key, i, v), their rate): every k-th one where the rates divide, else read between samples."""
    k = fs / target
    if abs(k - round(k)) < 1e-9 and round(k) >= 1:
        kept = samples.where(F.col("i") % round(k) == 0).select("key", F.floor(F.col("i") / round(k)).cast("long").alias("i"), F.col("v").cast("double").alias("v"))
        return kept, fs / round(k)
    return _mapped(samples, 2, chunk, lambda v, start, own, total: _read_at(v, start, own, total, k, int(total / k))), target


def feature_arrays(windows: DataFrame, fs: float, points: int = 256, smooth_fs: float = 500.0, fast_ms: float = 20.0, slow_ms: float = 80.0) -> DataFrame:
    """windows (v, arrays of samples in order, ...) with features, the model's input of each: the trace at about
    smooth_fs, its two centred means and the position, on a number of points from the window's first sample
    to its last, each row less its median over its median deviation, one row after the other.

    Windows are of bounded length; those of one length go through together.
    """
    k = max(1, round(fs / smooth_fs))
    widths = [1, *[max(1, round(ms / 1000 * fs / k)) for ms in (fast_ms, slow_ms)]]

    def made(v: np.ndarray) -> np.ndarray:
        last = v.shape[-1] - 1
        # The thinned trace ends at or before the window's last sample: points beyond take its end.
        place = np.minimum(np.arange(points) * (last / (points - 1)) / k, last // k)
        i = np.floor(place).astype(int)
        traces = [picks.centred(v[:, ::k], width) for width in widths]
        between = [np.where(place == i, x[:, i], x[:, i] + (place - i) * (x[:, np.minimum(i + 1, last // k)] - x[:, i])) for x in traces]
        rows = np.stack([*between, np.broadcast_to(np.arange(points) / (points - 1), between[0].shape)], 1)
        middle = np.nanmedian if np.isnan(rows).any() else np.median
        d = rows - middle(rows, -1, keepdims=True)
        return (d / (1e-9 + middle(np.abs(d), -1, keepdims=True))).reshape(len(v), -1)

    def helper(table: pa.Table) -> list[list]:
        windows = arrays_of(table, "v")
        lengths = np.array([len(v) for v in windows])
        out: list = [None] * len(windows)
        for n in np.unique(lengths[lengths > 0]):
            alike = np.flatnonzero(lengths == n)
            for at in np.array_split(alike, -(-len(alike) * int(n) // 65_536)):
                for w, x in zip(at, made(np.stack([windows[w] for w in at])), strict=True):
                    out[w] = x
        return [out]

    return map_columns(windows, helper, ["features"], "array<double>")


def window_features(samples: DataFrame, fs: float, points: int = 256, smooth_fs: float = 500.0, fast_ms: float = 20.0, slow_ms: float = 80.0) -> DataFrame:
    """(key, row, point, value): the features of each window, (key, v) as an array or (key, i, v) with a row a sample."""
    if "i" in samples.columns:
        rows = samples.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", F.col("v").cast("double").alias("v")))).alias("s"))  # bounded by the longest window
        samples = rows.select("key", F.col("s.v").alias("v"))
    found = feature_arrays(samples, fs, points, smooth_fs, fast_ms, slow_ms).select("key", F.posexplode("features").alias("_at", "value"))
    return found.select("key", F.floor(F.col("_at") / points).cast("int").alias("row"), (F.col("_at") % points).alias("point"), F.when(~F.isnan("value"), F.col("value")).alias("value"))
