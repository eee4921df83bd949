"""Stored min/max levels of signals and range reads from them.

A store holds the samples and, for each level, bins of factor times as many samples as the one below.
Every table is sorted by key and place and carries the number of its block, so that a read of a range
touches the row groups of its blocks only, and a long range reads a coarse level and no samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import cut

#: Entries (samples or bins) of a block.
BLOCK = 4096
#: Ranges that are broadcast to the level's blocks at most; beyond, they are joined by shuffle.
MAX_BROADCAST_RANGES = 100_000


@dataclass
class LevelStore:
    """Where the tables are, and how they were made."""

    path: str
    factor: int
    most: int
    fewest: int

    def samples(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/samples")

    def extents(self, spark: SparkSession) -> DataFrame:
        """(key, n, levels): samples and stored levels of each key."""
        return spark.read.parquet(f"{self.path}/extents")

    def level(self, spark: SparkSession, k: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/level{k}")

    def pyramid(self, spark: SparkSession) -> DataFrame:
        """(key, level, bin, vmin, vmax) of all stored levels."""
        out = None
        for k in range(1, self._highest(spark) + 1):
            rows = self.level(spark, k).select("key", F.lit(k).alias("level"), F.col("entry").alias("bin"), "vmin", "vmax")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _highest(self, spark: SparkSession) -> int:
        return self.extents(spark).agg(F.max("levels")).first()[0] or 0


def _bins(n: Column, width: int) -> Column:
    return F.ceil(n / F.lit(float(width))).cast("long")


def _entry(df: DataFrame, path: str) -> None:
    df.withColumn("block", F.floor(F.col("entry") / BLOCK).cast("long")).repartitionByRange("key", "entry").sortWithinPartitions("key", "entry").write.parquet(path)


def store_levels(samples: DataFrame, path: str, factor: int = 10, most: int = 8, fewest: int = 64) -> LevelStore:
    """Write samples (key, i, v) and their levels under path: level k has bins of factor^k samples, for
    keys with at least `fewest` bins there, up to `most` levels. NaN and null values are left out.

    The samples are read once for their own table and the first level is made from that table; each
    further level is made from the stored one below. A key may hold any share of the samples.
    """
    spark = samples.sparkSession
    clean = samples.select("key", F.col("i").cast("long").alias("entry"), F.when(~F.isnan("v"), F.col("v")).alias("v"))
    _entry(clean, f"{path}/samples")
    store = LevelStore(path, factor, most, fewest)
    sizes = store.samples(spark).groupBy("key").agg((F.max("entry") + 1).alias("n"))
    levels = F.size(F.filter(F.array(*[F.lit(factor**k) for k in range(1, most + 1)]), lambda w: F.ceil(F.col("n") / w) >= fewest))
    sizes.withColumn("levels", levels).write.parquet(f"{path}/extents")
    highest = store._highest(spark)
    for k in range(1, highest + 1):
        below = store.samples(spark).select("key", "entry", F.col("v").alias("vmin"), F.col("v").alias("vmax")) if k == 1 else store.level(spark, k - 1)
        bins = below.groupBy("key", F.floor(F.col("entry") / factor).cast("long").alias("entry")).agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))
        enough = store.extents(spark).where(F.col("levels") >= k).select("key")
        _entry(bins.join(enough, "key", "left_semi"), f"{path}/level{k}")
    return store


def _planned(store: LevelStore, ranges: DataFrame, most_points: int) -> DataFrame:
    """Each range with its samples i0 <= i < i1, the level to read, its entries j0 <= j < j1 and the bins to give."""
    known = ranges.join(store.extents(ranges.sparkSession), "key")
    i0 = F.greatest(F.lit(0).cast("long"), F.floor(F.col("t0") * F.col("fs")).cast("long"))
    i1 = F.least(F.col("n"), F.ceil(F.col("t1") * F.col("fs")).cast("long") + 1)
    known = known.withColumn("i0", i0).withColumn("i1", i1).withColumn("count", F.greatest(F.lit(0).cast("long"), F.col("i1") - F.col("i0")))
    widths = F.array(*[F.lit(store.factor**k).cast("long") for k in range(store.most + 1)])
    # The finest level whose entries in the range are few enough, or else the coarsest that the key has.
    fine = F.transform(F.sequence(F.lit(0), F.col("levels")), lambda k: F.when(F.col("count") / F.get(widths, k) <= most_points, k))
    level = F.when(F.col("count") <= F.col("budget"), 0).otherwise(F.coalesce(F.array_min(fine), F.col("levels")))
    known = known.withColumn("level", level).withColumn("width", F.get(widths, F.col("level")))
    known = known.withColumn("j0", F.floor(F.col("i0") / F.col("width")).cast("long")).withColumn("j1", F.ceil(F.col("i1") / F.col("width")).cast("long"))
    mode = F.when(F.col("count") == 0, "empty").when(F.col("count") <= F.col("budget"), "full").otherwise("envelope")
    bins = F.greatest(F.lit(1).cast("long"), F.least(F.floor(F.col("budget") / 2).cast("long"), F.col("j1") - F.col("j0")))
    return known.withColumn("mode", mode).withColumn("bins", bins)


def _level_of(store: LevelStore, spark: SparkSession, k: int) -> DataFrame:
    if k == 0:
        return store.samples(spark).select("key", "entry", "block", F.col("v").alias("vmin"), F.col("v").alias("vmax"))
    return store.level(spark, k)


def read_ranges(store: LevelStore, ranges: DataFrame, most_points: int = 4_000_000) -> DataFrame:
    """(range, key, mode, level, bin, t, t_mid, vmin, vmax, bin_s) of ranges (range, key, fs, t0, t1, budget).

    t0 and t1 are seconds from the key's begin, fs its samples a second. Up to `budget` samples are given
    as they are (mode full; bin is the sample). A longer range gives about budget / 2 bins (mode
    envelope) made from the finest level that has at most most_points entries in it, so that no more
    than these are read for a range; bins share the level's entries evenly, t is a bin's begin and t_mid
    its middle. A range outside the data, or of a key that is not there, gives one row (mode empty).

    Only levels that some range needs are read, and of them the blocks of the ranges.
    """
    spark = ranges.sparkSession
    plan = cut(_planned(store, ranges, most_points).select("range", "key", "fs", "mode", "level", "width", "j0", "j1", "bins"))
    out = None
    bounds = plan.where("mode <> 'empty'").groupBy("level").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("low"), F.max("key").alias("high"), F.min("j0").alias("j0"), F.max("j1").alias("j1"))
    for b in sorted(bounds.collect()):  # a row for each level, nine at most
        here = plan.where((F.col("level") == b["level"]) & (F.col("mode") != "empty"))
        wanted = here.withColumn("block", F.explode(F.sequence(F.floor(F.col("j0") / BLOCK).cast("long"), F.floor((F.col("j1") - 1) / BLOCK).cast("long"))))
        wanted = F.broadcast(wanted) if b["c"] <= MAX_BROADCAST_RANGES else wanted
        # Literal bounds reach the scan: sorted files are pruned by them.
        rows = _level_of(store, spark, b["level"]).where(F.col("key").between(b["low"], b["high"]) & (F.col("entry") >= b["j0"]) & (F.col("entry") < b["j1"]))
        inside = rows.join(wanted, ["key", "block"]).where((F.col("entry") >= F.col("j0")) & (F.col("entry") < F.col("j1")))
        exact = inside.where("mode = 'full'").select("range", "key", "mode", "level", F.col("entry").alias("bin"), (F.col("entry") / F.col("fs")).alias("t"), (F.col("entry") / F.col("fs")).alias("t_mid"), "vmin", "vmax", (1 / F.col("fs")).alias("bin_s"))
        m, at = F.col("j1") - F.col("j0"), F.col("entry") - F.col("j0")
        bin_ = F.expr("((entry - j0 + 1) * bins - 1) div (j1 - j0)")
        many = inside.where("mode = 'envelope'").groupBy("range", "key", "mode", "level", "fs", "width", "j0", "bins", m.alias("m"), bin_.alias("bin")).agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.min(at).alias("first"), F.count(F.lit(1)).alias("entries"))
        step = F.col("width") / F.col("fs")
        begin = (F.col("j0") + F.col("first")) * step
        many = many.select("range", "key", "mode", "level", "bin", begin.alias("t"), (begin + F.col("entries") / 2 * step).alias("t_mid"), "vmin", "vmax", (F.col("m") / F.col("bins") * step).alias("bin_s"))
        both = exact.unionByName(many)
        out = both if out is None else out.unionByName(both)
    lacking = ranges.select("range", "key").join(plan.where("mode <> 'empty'").select("range"), "range", "left_anti")
    empty = lacking.select("range", "key", F.lit("empty").alias("mode"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("bin"), *[F.lit(None).cast("double").alias(c) for c in ("t", "t_mid", "vmin", "vmax")], F.lit(0.0).alias("bin_s"))
    return empty if out is None else out.unionByName(empty)


def experiment_tracks(recordings: DataFrame) -> DataFrame:
    """Ready recordings of each experiment laid end to end by file name: adds t_offset and label.

    recordings: rec_id, exp_id, file_name, duration, status, condition (null or blank: the name's own) and
    the name's parsed run and name_condition. The label is run and condition, else the file name.
    """
    from pyspark.sql.window import Window

    before = Window.partitionBy("exp_id").orderBy("file_name", "rec_id").rowsBetween(Window.unboundedPreceding, -1)
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    parts = F.concat_ws(" ", blank(F.col("run")), F.coalesce(blank(F.col("condition")), blank(F.col("name_condition"))))
    ready = recordings.where("status = 'ready'").withColumn("t_offset", F.coalesce(F.sum("duration").over(before), F.lit(0.0)))
    return ready.withColumn("label", F.coalesce(F.nullif(parts, F.lit("")), F.col("file_name")))


def read_experiments(store: LevelStore, tracks: DataFrame, views: DataFrame, fewest: int = 200, most_points: int = 4_000_000) -> DataFrame:
    """(view, rec_id, label, mode, level, bin, t, t_mid, vmin, vmax, bin_s): views of experiments across their recordings.

    views: view, exp_id, t0, t1 (seconds from the experiment's begin) and budget; tracks: as of
    experiment_tracks, with fs (rec_id is the key of the store). A recording gets the share of the
    budget that its overlap has in the view, `fewest` at least, and is read in either mode; a recording
    that is not ready takes no place. Times are the experiment's.
    """
    over = views.join(tracks.select("rec_id", "exp_id", "t_offset", "duration", "fs", "label"), "exp_id")
    a = F.greatest(F.col("t0") - F.col("t_offset"), F.lit(0.0))
    b = F.least(F.col("t1") - F.col("t_offset"), F.col("duration"))
    over = over.withColumn("a", a).withColumn("b", b).where("b > a")
    share = F.greatest(F.lit(fewest).cast("long"), F.floor(F.col("budget") * (F.col("b") - F.col("a")) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-9))).cast("long"))
    asked = cut(over.select(F.struct("view", "rec_id").alias("range"), F.col("rec_id").alias("key"), "fs", F.col("a").alias("t0"), F.col("b").alias("t1"), share.alias("budget"), "t_offset", "label"))
    found = read_ranges(store, asked.select("range", "key", "fs", "t0", "t1", "budget"), most_points)
    names = asked.select("range", "t_offset", "label")
    joined = found.join(F.broadcast(names) if names.count() <= MAX_BROADCAST_RANGES else names, "range")
    return joined.select("range.view", "range.rec_id", "label", "mode", "level", "bin", *[(F.col(c) + F.col("t_offset")).alias(c) for c in ("t", "t_mid")], "vmin", "vmax", "bin_s")
