"""Signal windows and joins as plain DataFrame work over samples (key, i, t, v).

Keys are recordings, channels or events; i counts samples from 0 within a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _by(key: str = "key"):
    return Window.partitionBy(key).orderBy("i")


def lag_diff(samples: DataFrame, n: int) -> DataFrame:
    """d: change over n samples."""
    return samples.withColumn("d", F.col("v") - F.lag("v", n).over(_by()))


def moving_average(samples: DataFrame, width: int) -> DataFrame:
    """avg: centred mean over an odd width (an even one is lowered by one), ends padded with the end values."""
    h = max(0, (width - (width % 2 == 0)) // 2)
    part, frame = Window.partitionBy("key"), _by().rowsBetween(-h, h)
    n = F.count(F.lit(1)).over(part)
    before, after = F.greatest(F.lit(h) - F.col("i"), F.lit(0)), F.greatest(F.col("i") + h - (n - 1), F.lit(0))
    whole = _by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    padded = F.sum("v").over(frame) + before * F.first("v").over(whole) + after * F.last("v").over(whole)
    return samples.withColumn("avg", padded / (2 * h + 1))


def local_peaks(samples: DataFrame) -> DataFrame:
    """Peaks higher than both neighbours; a flat top counts once, at its middle sample."""
    steps = samples.withColumn("_c", (F.lag("v").over(_by()).isNull() | (F.lag("v").over(_by()) != F.col("v"))).cast("int"))
    flats = steps.withColumn("_r", F.sum("_c").over(_by())).groupBy("key", "_r").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.first("v").alias("v"))
    w = Window.partitionBy("key").orderBy("_r")
    higher = (F.col("v") > F.lag("v").over(w)) & (F.col("v") > F.lead("v").over(w))
    return flats.withColumn("_p", higher).where("_p").select("key", F.floor((F.col("i0") + F.col("i1")) / 2).cast("long").alias("i"), "v")


def decimate(samples: DataFrame, k: int) -> DataFrame:
    """Every k-th sample."""
    return samples.where(F.col("i") % k == 0).withColumn("i", F.floor(F.col("i") / k).cast("long"))


def recording_offsets(recordings: DataFrame, experiment: str, file: str, duration: str) -> DataFrame:
    """t_offset: where each recording begins when an experiment's are laid end to end by file name."""
    before = Window.partitionBy(experiment).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    return recordings.withColumn("t_offset", F.coalesce(F.sum(duration).over(before), F.lit(0.0)))


def window_to_sweep(windows: DataFrame, sweeps: DataFrame, pad: float = 0.01) -> DataFrame:
    """Each window's sweep: the first that holds the padded window, else the one of largest overlap.

    windows: event, key, t0, t1; sweeps: key, sweep, s0, s1. The window is clipped to its sweep; no
    overlap gives a null sweep. Sweeps meet windows of their own key only.
    """
    low, high = F.greatest(F.col("t0") - pad, F.lit(0.0)), F.col("t1") + pad
    pairs = windows.join(sweeps, "key").where((F.col("s0") < high) & (F.col("s1") > low))
    overlap = F.least(high, F.col("s1")) - F.greatest(low, F.col("s0"))
    inside = (F.col("s0") <= low) & (F.col("s1") >= high)
    rank = F.struct((~inside).alias("o1"), F.when(inside, 0.0).otherwise(-F.round(overlap, 6)).alias("o2"), F.col("sweep").alias("o3"))
    best = pairs.groupBy("event").agg(F.min_by(F.struct("sweep", F.greatest(low, F.col("s0")).alias("c0"), F.least(high, F.col("s1")).alias("c1"), inside.alias("whole")), rank).alias("b"))
    return windows.select("event").join(best, "event", "left").select("event", "b.sweep", "b.c0", "b.c1", F.coalesce("b.whole", F.lit(False)).alias("whole"))


def cut_windows(windows: DataFrame, samples: DataFrame, width: float) -> DataFrame:
    """Samples of each window (event, key, t0, t1) by way of time blocks, so that it is an equi-join."""
    block = lambda t: F.floor(t / width).cast("long")
    blocks = windows.withColumn("_b", F.explode(F.sequence(block(F.col("t0")), block(F.col("t1")))))
    near = samples.withColumn("_b", block(F.col("t"))).join(blocks, ["key", "_b"])
    return near.where(F.col("t").between(F.col("t0"), F.col("t1"))).select("event", "key", "i", "t", "v")


def gather_windows(cut: DataFrame) -> DataFrame:
    """One row per event with its samples as arrays in order."""
    rows = cut.groupBy("event", "key").agg(F.array_sort(F.collect_list(F.struct("i", "t", "v"))).alias("s"))  # bounded by the longest window
    return rows.select("event", "key", F.col("s.t").alias("t"), F.col("s.v").alias("v"))


def cut_arrays(windows: DataFrame, samples: DataFrame, width: float) -> DataFrame:
    """One row per window (event, key, t0, t1) with its samples as arrays in order (i, t, v); none without samples.

    width: seconds that no window is longer than. Samples are gathered in blocks of it, which each begin in
    one and end in the next at most: a window finds all of its samples in the block where it begins, and
    only the samples are dealt, twice, not those of each window.
    """
    wide = width * (1 + 1e-9)
    block = lambda t: F.floor(t / wide).cast("long")
    dealt = samples.select("key", F.explode(F.array(block(F.col("t")) - 1, block(F.col("t")))).alias("_b"), F.struct("i", "t", "v").alias("_s"))
    blocks = dealt.groupBy("key", "_b").agg(F.sort_array(F.collect_list("_s")).alias("_s"))  # two blocks of samples
    fits = F.when(F.col("t1") - F.col("t0") > width, F.raise_error(F.lit("a window is longer than width"))).otherwise(F.lit(True))
    near = windows.where(fits).withColumn("_b", block(F.col("t0"))).join(blocks, ["key", "_b"])
    cut = near.select("event", "key", F.filter("_s", lambda s: s["t"].between(F.col("t0"), F.col("t1"))).alias("_s")).where(F.size("_s") > 0)
    return cut.select("event", "key", *[F.col(f"_s.{c}").alias(c) for c in ("i", "t", "v")])


def uniform_lookup(points: DataFrame, samples: DataFrame, fs: float) -> DataFrame:
    """Linear interpolation at t of (key, point, t) on samples at rate fs: two equi-joins by index."""
    at = points.withColumn("_x", F.col("t") * fs).withColumn("_i", F.floor("_x").cast("long"))
    left = samples.select("key", F.col("i").alias("_i"), F.col("v").alias("_v0"))
    right = samples.select("key", (F.col("i") - 1).alias("_i"), F.col("v").alias("_v1"))
    found = at.join(left, ["key", "_i"], "left").join(right, ["key", "_i"], "left")
    frac = F.col("_x") - F.col("_i")
    value = F.when(frac == 0, F.col("_v0")).otherwise(F.col("_v0") + frac * (F.col("_v1") - F.col("_v0")))
    return found.select("key", "point", "t", value.alias("v"))


def asof_interp(points: DataFrame, samples: DataFrame) -> DataFrame:
    """Linear interpolation at t of (key, point, t) between the samples around it; outside: null.

    Samples and points are merged once by time and each point takes the last sample before and
    the first after it, so there is no pairwise range join.
    """
    both = samples.select("key", "t", "v", F.lit(None).cast(points.schema["point"].dataType).alias("point"), F.lit(0).alias("_o")).unionByName(
        points.select("key", "t", F.lit(None).cast("double").alias("v"), "point", F.lit(1).alias("_o"))
    )
    pair = F.when(F.col("_o") == 0, F.struct("t", "v"))
    back = Window.partitionBy("key").orderBy("t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("key").orderBy(F.desc("t"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_a", F.last(pair, ignorenulls=True).over(back)).withColumn("_b", F.last(pair, ignorenulls=True).over(ahead)).where("_o = 1")
    a, b = F.col("_a"), F.col("_b")
    value = F.when(a["t"] == F.col("t"), a["v"]).otherwise(a["v"] + (F.col("t") - a["t"]) / (b["t"] - a["t"]) * (b["v"] - a["v"]))
    return found.select("key", "point", "t", value.alias("v"))


def edge_pairs(edges: DataFrame) -> DataFrame:
    """Rises and later falls of the same event: (event, rise, fall) with the fall after the rise's end."""
    rise = edges.where("direction > 0").select("event", F.struct("t", "t_start", "t_end").alias("rise"))
    fall = edges.where("direction < 0").select("event", F.struct("t", "t_start", "t_end").alias("fall"))
    return rise.join(fall, "event").where("fall.t_start > rise.t_end")


def best_edge_pair(pairs: DataFrame, samples: DataFrame, base_s: float, consistency: float = 0.8) -> DataFrame:
    """Of (event, r, f) rise and fall times, the pair with the largest step of the plateau's median
    over that of base_s before the rise; enough of the inside must be on the plateau's side."""
    joined = pairs.join(samples, "event")
    inside, before = F.col("t").between(F.col("r"), F.col("f")), F.col("t").between(F.col("r") - base_s, F.col("r")) & (F.col("t") < F.col("r"))
    levels = joined.groupBy("event", "r", "f").agg(F.median(F.when(inside, F.col("v"))).alias("plateau"), F.median(F.when(before, F.col("v"))).alias("base"))
    back = levels.where("plateau > base").join(samples, "event").where(F.col("t").between(F.col("r"), F.col("f")))
    share = back.groupBy("event", "r", "f", "plateau", "base").agg(F.avg((F.col("v") > (F.col("plateau") + F.col("base")) / 2).cast("double")).alias("share"))
    good = share.where(F.col("share") >= consistency).withColumn("amplitude", F.col("plateau") - F.col("base"))
    best = F.min_by(F.struct("r", "f", "amplitude"), F.struct(-F.round("amplitude", 9), F.col("r"), F.col("f")))
    return good.groupBy("event").agg(best.alias("b")).select("event", "b.*")


def snap_edge(edges: DataFrame, estimates: DataFrame, direction: int, tolerance: float, boundary: str = "t") -> DataFrame:
    """The matching edge nearest to each (event, estimate) within the tolerance, else null."""
    near = edges.where(F.col("direction") == direction).join(estimates, "event").where(F.abs(F.col(boundary) - F.col("estimate")) <= tolerance)
    best = near.groupBy("event").agg(F.min_by(F.col(boundary), F.struct(F.round(F.abs(F.col(boundary) - F.col("estimate")), 6), F.col(boundary))).alias("snapped"))
    return estimates.join(best, "event", "left").select("event", "estimate", "snapped")


def assemble_events(points: DataFrame) -> DataFrame:
    """Events from marked points (event, recording, kind, mark, t): three optical times sorted, four
    electrical ones in marking order; only groups of 3 + 4 points of one recording."""
    optical = F.array_sort(F.collect_list(F.when(F.col("kind") == "optical", F.col("t"))))
    electrical = F.array_sort(F.collect_list(F.when(F.col("kind") == "electrical", F.struct("mark", "t"))))
    groups = points.groupBy("event").agg(optical.alias("o"), electrical.alias("e"), F.min("recording").alias("recording"), F.max("recording").alias("_last"))
    whole = groups.where((F.size("o") == 3) & (F.size("e") == 4) & (F.col("recording") == F.col("_last")))
    names = ["event_start", "event_plateau", "event_end"], ["entry_base_t", "entry_peak_t", "exit_peak_t", "exit_base_t"]
    return whole.select("event", "recording", *[F.get("o", F.lit(i)).alias(n) for i, n in enumerate(names[0])], *[F.get("e.t", F.lit(i)).alias(n) for i, n in enumerate(names[1])])
