"""Trailing medians and edges of long signals, in chunks that overlap.

A chunk takes the samples before it that its frames reach, so that a signal is spread over tasks at any
length and no frame is sorted anew for each sample. The same helper serves the streaming form.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Samples of a chunk.
CHUNK = 65_536
#: The factor from median deviations to standard ones, and a frame's least count of values.
NORMAL, LEAST = 0.6745, 5
#: Values in all frames of a row up to which these are sorted at once.
SHORT = 16_384


def trailing_frame(n: Column, fs: float, longest_s: float = 8.0, share: float = 0.4, shortest_s: float = 0.5) -> Column:
    """Samples of the frame for a signal of n samples: longest_s, or a share of a short signal (shortest_s
    at least), five samples at least and fewer than the signal has where it has more than five."""
    seconds = F.least(F.lit(longest_s), F.greatest(F.lit(shortest_s), (n - 1) / fs * share))
    wanted = F.greatest(F.lit(LEAST), F.bround(seconds * fs).cast("int"))
    return F.least(wanted, F.greatest(F.lit(LEAST), n - 1)).cast("int")


def median_before(v: np.ndarray, frame: int, least: int) -> np.ndarray:
    """Median of the frame of values before each one (missing ones do not count)."""
    return pd.Series(v).rolling(frame, min_periods=least).median().shift(1).to_numpy() if frame >= least else np.full(len(v), np.nan)


def lag_z(v: np.ndarray, lag: int, frame: int, least: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(d, z): changes over `lag` samples and their robust z against the frame before; undefined z are 0.

    Each change's deviation is from the median of the frame that ends at it.
    """
    d = np.full(len(v), np.nan)
    d[lag:] = v[lag:] - v[: len(v) - lag] if lag < len(v) else d[lag:]
    s = pd.Series(d)
    least = min(least, frame)
    own = s.rolling(frame, min_periods=least).median()
    mad = (s - own).abs().rolling(frame, min_periods=least).median()
    before, spread = own.shift(1).to_numpy(), mad.shift(1).to_numpy()
    with np.errstate(all="ignore"):
        z = NORMAL * (d - before) / np.where(np.isnan(spread), np.nan, np.maximum(spread, floor))
    return d, np.nan_to_num(z, nan=0.0, posinf=0.0, neginf=0.0)


def _medians_of_rows(v: np.ndarray, frame: int, least: int) -> np.ndarray:
    """Rolling medians along the rows of v, of short rows at once."""
    if v.shape[-1] * frame > SHORT:
        return np.stack([pd.Series(row).rolling(frame, min_periods=least).median().to_numpy() for row in v])
    ahead = np.full((len(v), frame - 1), np.nan)
    frames = np.sort(np.lib.stride_tricks.sliding_window_view(np.concatenate([ahead, v], -1), frame, -1), -1)  # NaN last
    n = frame - np.isnan(frames).sum(-1)
    at = lambda k: np.take_along_axis(frames, np.maximum(k, 0)[..., None], -1)[..., 0]
    return np.where(n >= least, (at((n - 1) // 2) + at(n // 2)) / 2, np.nan)


def lag_z_of_rows(v: np.ndarray, lag: int, frame: int, least: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """lag_z of each row of v: many signals of one length."""
    d = np.full(v.shape, np.nan)
    if lag < v.shape[-1]:
        d[:, lag:] = v[:, lag:] - v[:, : v.shape[-1] - lag]
    least = min(least, frame)
    own = _medians_of_rows(d, frame, least)
    mad = _medians_of_rows(np.abs(d - own), frame, least)
    before, spread = (np.concatenate([np.full((len(v), 1), np.nan), x[:, :-1]], -1) for x in (own, mad))
    with np.errstate(all="ignore"):
        z = NORMAL * (d - before) / np.where(np.isnan(spread), np.nan, np.maximum(spread, floor))
    return d, np.nan_to_num(z, nan=0.0, posinf=0.0, neginf=0.0)


def in_chunks(samples: DataFrame, reach: Column, chunk: int, ahead: Column | None = None) -> DataFrame:
    """samples (key, i, ...) with _chunk and _own: each in its chunk, and again in those that reach back (or ahead) to it."""
    last = F.floor((F.col("i") + reach) / chunk)
    first = F.col("i") if ahead is None else F.greatest(F.lit(0), F.col("i") - ahead)
    at = F.explode(F.sequence(F.floor(first / chunk).cast("long"), last.cast("long")))
    return samples.withColumn("_chunk", at).withColumn("_own", F.col("_chunk") == F.floor(F.col("i") / chunk))


#: Rows of finished groups that are given out together.
OUT_ROWS = 50_000


def map_groups(df: DataFrame, keys: list[str], order: str, helper: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """helper on each group's rows in order, as groupBy().applyInArrow() has it, for groups that are many and small.

    Groups of a partition pass through sorted, one after the other, without a call of Python for each; they
    are told apart by 128 bits of hashes of the keys.
    """
    marks = {"_g1": F.xxhash64(*keys), "_g2": F.xxhash64(F.lit(1), *keys)}
    source = df.withColumns(marks).repartition("_g1").sortWithinPartitions("_g1", "_g2", order)

    def run(batches):
        held: list[pa.Table] = []
        at = None
        out: list[pa.Table] = []

        def made():
            whole = pa.concat_tables(out).combine_chunks()
            out.clear()
            return whole.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            a, b = table.column("_g1").to_numpy(), table.column("_g2").to_numpy()
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            table = table.drop_columns(["_g1", "_g2"])
            for start, stop in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(a)].tolist(), strict=True):
                mark = (a[start], b[start])
                if mark != at and held:
                    out.append(helper(pa.concat_tables(held).combine_chunks()))
                    held = []
                at = mark
                held.append(table.slice(start, stop - start))
            if sum(t.num_rows for t in out) >= OUT_ROWS:
                yield from made()
        if held:
            out.append(helper(pa.concat_tables(held).combine_chunks()))
        if out:
            yield from made()

    return source.mapInArrow(run, schema)


def _by_chunk(samples: DataFrame, frame: int | str, reach: Column, chunk: int, made: dict[str, str], helper: Callable) -> DataFrame:
    """samples with the columns of helper(values, frame) -> arrays, made chunk by chunk."""
    source = in_chunks(samples.withColumn("_frame", F.col(frame) if isinstance(frame, str) else F.lit(frame)), reach, chunk)
    out = samples.select("*", *[F.lit(None).cast(t).alias(c) for c, t in made.items()]).schema
    names = samples.columns

    def run(table: pa.Table) -> pa.Table:
        v = table.column("_v").to_numpy().astype(np.float64)
        own = table.column("_own").combine_chunks().to_numpy(zero_copy_only=False)
        arrays = helper(v, int(table.column("_frame")[0].as_py()))
        kept = table.filter(pa.array(own)).select(names)
        for (c, _), x in zip(made.items(), arrays, strict=True):
            kept = kept.append_column(c, pa.array(x[own], pa.float64(), from_pandas=True))
        return kept

    return map_groups(source, ["key", "_chunk"], "i", run, out)


def rolling_median(samples: DataFrame, n: int | str, least: int = LEAST, column: str = "v", chunk: int = CHUNK) -> DataFrame:
    """med: median of the n samples before the current one, if `least` of them have values.

    samples: key, i (consecutive within the key), the column and any others. n: samples, or the name of a
    column that has each key's. A missing value (null or NaN) counts as none.
    """
    reach = F.col(n) if isinstance(n, str) else F.lit(n)
    found = _by_chunk(samples.withColumn("_v", F.col(column).cast("double")), n, reach, chunk, {"med": "double"}, lambda v, frame: [median_before(v, frame, least)])
    return found.drop("_v")


def robust_z(samples: DataFrame, lag: int, n: int | str, least: int = LEAST, floor: float = 1e-4, chunk: int = CHUNK) -> DataFrame:
    """d and z of the lag difference against the median and median deviation of the n samples before it.

    A sample's deviation is taken from its own rolling median; undefined values give z 0. n as in rolling_median.
    """
    reach = (F.col(n) if isinstance(n, str) else F.lit(n)) * 2 + lag
    found = _by_chunk(samples.withColumn("_v", F.col("v").cast("double")), n, reach, chunk, {"d": "double", "z": "double"}, lambda v, frame: list(lag_z(v, lag, frame, least, floor)))
    return found.drop("_v")


def long_runs(samples: DataFrame, flag: Column, values: dict[str, tuple[Column, Callable[[str], Column]]], chunk: int = CHUNK) -> DataFrame:
    """(key, i0, i1, n and the values) of each run of consecutive samples with the flag.

    values: by name an aggregate over samples and how aggregates of pieces join, as (F.sum("x"), F.sum).
    Runs are found within chunks; only pieces at a chunk's ends, two a chunk at most, are joined over chunks.
    """
    marked = samples.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_chunk", F.floor(F.col("i") / chunk).cast("long"))
    inside = Window.partitionBy("key", "_chunk").orderBy("i")
    starts = (F.col("_f") & ~F.coalesce(F.lag("_f").over(inside), F.lit(False))).cast("int")
    numbered = marked.withColumn("_run", F.sum(starts).over(inside)).where("_f")
    made = [a.alias(c) for c, (a, _) in values.items()]
    pieces = numbered.groupBy("key", "_chunk", "_run").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.count(F.lit(1)).alias("n"), *made).drop("_run")
    head, tail = F.col("i0") == F.col("_chunk") * chunk, F.col("i1") == (F.col("_chunk") + 1) * chunk - 1
    ends = pieces.where(head | tail)
    over = Window.partitionBy("key").orderBy("i0")
    goes_on = head & F.coalesce(F.lag("i1").over(over) == F.col("i0") - 1, F.lit(False))
    joined = ends.withColumn("_run", F.sum((~goes_on).cast("int")).over(over)).groupBy("key", "_run")
    whole = joined.agg(F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.sum("n").alias("n"), *[merge(c).alias(c) for c, (_, merge) in values.items()])
    names = ["key", "i0", "i1", "n", *values]
    return pieces.where(~(head | tail)).select(*names).unionByName(whole.select(*names))


def edge_candidates(z: DataFrame, threshold: float, least: int, chunk: int = CHUNK) -> DataFrame:
    """Runs of at least so many samples (key, i, t, z, d) with abs(z) at the threshold: the peak sample's
    time, z and direction (1 for a rise, else -1), the run's ends and length."""
    peak = F.max(F.struct(F.abs(F.col("z")).alias("size"), (-F.col("i")).alias("first"), "t", "z", "d"))
    values = {"p": (peak, F.max), "t_start": (F.min("t"), F.min), "t_end": (F.max("t"), F.max)}
    found = long_runs(z, F.abs("z") >= threshold, values, chunk).where(F.col("n") >= least)
    return found.select("key", F.col("p.t").alias("t"), F.col("p.z").alias("z"), F.when(F.col("p.d") > 0, 1).otherwise(-1).alias("direction"), "t_start", "t_end", "n")
