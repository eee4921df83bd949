"""Searches around estimates: flattest spots, peaks, level crossings, baselines and coarse events.

Each estimate has a search range of its own. Ranges meet the samples by equal time blocks, and what
follows is done within a range, never over a whole signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.quantiles import join_groups, wide_quantiles
from corvane.operators.trailing import CHUNK, long_runs


def in_ranges(samples: DataFrame, ranges: DataFrame, width: float) -> DataFrame:
    """(the columns of ranges, i, t, v) of the samples (key, i, t, v) with lo <= t <= hi of each range
    (key, point, lo, hi, ...). width: of the time blocks, about a range's length."""
    block = lambda t: F.floor(t / width).cast("long")
    dealt = ranges.where("lo <= hi").withColumn("_b", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi")))))
    rows = samples.select("key", "i", "t", "v").withColumn("_b", block(F.col("t")))
    return rows.join(dealt, ["key", "_b"]).where(F.col("t").between(F.col("lo"), F.col("hi"))).select(*ranges.columns, "i", "t", "v")


def around(estimates: DataFrame, reach: float, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """estimates (key, point, estimate) with their ranges lo and hi: reach to both sides, within the given bounds."""
    lo, hi = F.col("estimate") - reach, F.col("estimate") + reach
    return estimates.withColumn("lo", lo if low is None else F.greatest(lo, low)).withColumn("hi", hi if high is None else F.least(hi, high))


_RANGE = ["key", "point"]


def _in_order():
    return Window.partitionBy(*_RANGE).orderBy("i")


def flattest_window(samples: DataFrame, estimates: DataFrame, reach: float, n: int = 5, width: float | None = None) -> DataFrame:
    """(key, point, estimate, t, moved): begin of the window of n samples with the least variance wholly
    within reach of the estimate, the first of equals; the estimate itself where fewer samples are there.

    estimates may have lo and hi; else they reach to both sides.
    """
    ranges = estimates if "lo" in estimates.columns else around(estimates, reach)
    near = in_ranges(samples, ranges.select(*_RANGE, "lo", "hi"), width or 2 * reach)
    frame = _in_order().rowsBetween(0, n - 1)
    spread = near.withColumn("_n", F.count("v").over(frame)).withColumn("_var", F.var_pop("v").over(frame)).where(F.col("_n") == n)
    best = spread.groupBy(*_RANGE).agg(F.min_by("t", F.struct(F.round("_var", 9), "i")).alias("_t"))
    return ranges.join(best, _RANGE, "left").select(*_RANGE, "estimate", F.coalesce("_t", "estimate").alias("t"), F.col("_t").isNotNull().alias("moved"))


def tallest_peak(samples: DataFrame, estimates: DataFrame, reach: float, sign: int = 1, fewest: int = 3, width: float | None = None) -> DataFrame:
    """(key, point, estimate, t, v, kind): the tallest local peak within reach (kind peak), else the
    highest sample (maximum), else, with fewer than `fewest` samples, the estimate (none).

    A peak is higher than both neighbours within the range; a flat top counts at its middle sample; of
    equals the first. sign -1 looks for the lowest.
    """
    ranges = estimates if "lo" in estimates.columns else around(estimates, reach)
    near = in_ranges(samples, ranges.select(*_RANGE, "lo", "hi"), width or 2 * reach).withColumn("s", sign * F.col("v"))
    order = _in_order()
    near = near.withColumn("_new", (F.lag("s").over(order).isNull() | (F.lag("s").over(order) != F.col("s"))).cast("int")).withColumn("_flat", F.sum("_new").over(order)).withColumn("_at", F.row_number().over(order))
    flats = near.groupBy(*_RANGE, "_flat").agg(F.min("_at").alias("a0"), F.max("_at").alias("a1"), F.first("s").alias("s"))
    steps = Window.partitionBy(*_RANGE).orderBy("_flat")
    peaks = flats.withColumn("_peak", (F.col("s") > F.lag("s").over(steps)) & (F.col("s") > F.lead("s").over(steps))).where("_peak")
    top = peaks.groupBy(*_RANGE).agg(F.max(F.struct("s", (-F.col("a0")).alias("first"), F.floor((F.col("a0") + F.col("a1")) / 2).alias("at"))).alias("p")).select(*_RANGE, F.col("p.at").alias("_peak_at"))
    joined = near.join(top, _RANGE, "left")
    highest = F.max(F.struct("s", (-F.col("i")).alias("first"), "t", "v")).alias("m")
    found = joined.groupBy(*_RANGE).agg(F.count(F.lit(1)).alias("n"), highest, F.max(F.when(F.col("_at") == F.col("_peak_at"), F.struct("t", "v"))).alias("p"))
    some = F.coalesce(F.col("n") >= fewest, F.lit(False))
    one = F.when(some, F.coalesce("p", F.struct("m.t", "m.v")))
    kind = F.when(~some, "none").when(F.col("p").isNotNull(), "peak").otherwise("maximum")
    return ranges.join(found, _RANGE, "left").select(*_RANGE, "estimate", F.coalesce(one["t"], F.col("estimate")).alias("t"), one["v"].alias("v"), kind.alias("kind"))


def level_crossing(samples: DataFrame, searches: DataFrame, width: float) -> DataFrame:
    """(key, point, t_cross) of searches (key, point, lo, hi, level, rising, first): in the range, the first
    (or last) sample at or beyond the level (over it if rising, else under), its time interpolated with
    the sample before, or its own if it is the range's first. Null if there is none, or a single sample."""
    near = in_ranges(samples, searches, width)
    order = _in_order()
    near = near.withColumn("_pv", F.lag("v").over(order)).withColumn("_pt", F.lag("t").over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*_RANGE)))
    hit = F.when(F.col("rising"), F.col("v") >= F.col("level")).otherwise(F.col("v") <= F.col("level"))
    part = F.when(F.col("v") == F.col("_pv"), 0.0).otherwise(F.least(F.greatest((F.col("level") - F.col("_pv")) / (F.col("v") - F.col("_pv")), F.lit(0.0)), F.lit(1.0)))
    at = F.when(F.col("_pv").isNull(), F.col("t")).otherwise(F.col("_pt") + part * (F.col("t") - F.col("_pt")))
    rows = near.where(hit & (F.col("_n") >= 2)).select(*_RANGE, at.alias("t_cross"), F.when(F.col("first"), F.col("i")).otherwise(-F.col("i")).alias("_o"))
    best = rows.groupBy(*_RANGE).agg(F.min_by("t_cross", "_o").alias("t_cross"))
    return searches.select(*_RANGE).join(best, _RANGE, "left").select(*_RANGE, "t_cross")


def baseline_return(samples: DataFrame, searches: DataFrame, n: int, width: float, factor: float = 2.5) -> DataFrame:
    """(key, point, t) of searches (key, point, lo, hi, base, sigma, forward): where, from the range's begin
    on (or its end back), the signal has been within factor * sigma of the base for n samples; null if never.

    Forward that is the n-th sample of the first such run, backward the n-th one back of the last.
    """
    near = in_ranges(samples, searches, width)
    onward = F.when(F.col("forward"), F.col("i")).otherwise(-F.col("i"))
    walk = Window.partitionBy(*_RANGE).orderBy("_w")
    near = near.withColumn("_w", onward).withColumn("_in", F.coalesce(F.abs(F.col("v") - F.col("base")) < factor * F.col("sigma"), F.lit(False)))
    near = near.withColumn("_out", F.sum((~F.col("_in")).cast("int")).over(walk)).where("_in")
    at = F.row_number().over(Window.partitionBy(*_RANGE, "_out").orderBy("_w"))
    best = near.withColumn("_n", at).where(F.col("_n") == n).groupBy(*_RANGE).agg(F.min_by("t", "_w").alias("t"))
    return searches.select(*_RANGE).join(best, _RANGE, "left").select(*_RANGE, "t")


def smoothed(samples: DataFrame, k: int, width: int, chunk: int = CHUNK) -> DataFrame:
    """(key, i, t, v): every k-th sample, and of these the centred mean over an odd width (an even one is
    lowered by one), the signal's ends going on with their values. Samples are dealt in chunks with borders."""
    kept = samples.where(F.col("i") % k == 0).select("key", F.floor(F.col("i") / k).cast("long").alias("i"), "t", "v")
    h = max(0, (width - (width % 2 == 0)) // 2)
    ends = kept.groupBy("key").agg(F.max("i").alias("_last"), F.min_by("v", "i").alias("_v0"), F.max_by("v", "i").alias("_v1"))
    first = F.floor(F.greatest(F.lit(0), F.col("i") - h) / chunk).cast("long")
    dealt = kept.withColumn("_c", F.explode(F.sequence(first, F.floor((F.col("i") + h) / chunk).cast("long"))))
    frame = Window.partitionBy("key", "_c").orderBy("i").rowsBetween(-h, h)
    sums = dealt.withColumn("_sum", F.sum("v").over(frame)).where(F.col("_c") == F.floor(F.col("i") / chunk))
    whole = join_groups(sums, ends, ["key"])
    before, after = F.greatest(h - F.col("i"), F.lit(0)), F.greatest(F.col("i") + h - F.col("_last"), F.lit(0))
    return whole.select("key", "i", "t", ((F.col("_sum") + before * F.col("_v0") + after * F.col("_v1")) / (2 * h + 1)).alias("v"))


def coarse_event(samples: DataFrame, fs: float, factor: float = 3.0, least_s: float = 0.02, pad_s: float = 0.0, smooth_fs: float = 500.0, smooth_ms: float = 80.0, chunk: int = CHUNK) -> DataFrame:
    """(key, t0, t1, weight): the run of samples furthest from the key's median, by summed deviation.

    On the signal at about smooth_fs samples a second, averaged over smooth_ms: samples over factor *
    1.4826 median deviations from the median, in runs; the best run, if least_s long, padded within the
    signal. Medians are exact, of any size of signal; a key of fewer than 8 samples has no event.
    """
    k = max(1, round(fs / smooth_fs))
    trace = smoothed(samples, k, max(1, round(smooth_ms / 1000 * fs / k)), chunk)
    middle = wide_quantiles(trace, ["key"], ["v"], [0.5], lambda *_: "_med")
    off = join_groups(trace, middle, ["key"]).withColumn("_dev", F.abs(F.col("v") - F.col("_med")))
    spread = wide_quantiles(off, ["key"], ["_dev"], [0.5], lambda *_: "_mad")
    over = F.col("_dev") > factor * F.greatest(1.4826 * F.col("_mad"), F.lit(1e-9))
    values = {"t0": (F.min("t"), F.min), "t1": (F.max("t"), F.max), "weight": (F.sum("_dev"), F.sum)}
    found = long_runs(join_groups(off, spread, ["key"]), over, values, chunk)
    extent = trace.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    best = found.groupBy("key").agg(F.max_by(F.struct("t0", "t1", "weight"), F.struct(F.round("weight", 9), -F.col("i0"))).alias("b"))
    best = best.join(extent, "key").where((F.col("_n") >= 8) & (F.col("b.t1") - F.col("b.t0") >= least_s))
    return best.select("key", F.greatest("_lo", F.col("b.t0") - pad_s).alias("t0"), F.least("_hi", F.col("b.t1") + pad_s).alias("t1"), F.col("b.weight").alias("weight"))
