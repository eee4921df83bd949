"""Exports of events, shifts of times and moved landmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.columns import INTERNAL, LEGACY, PREDICTED, TEXTS
from corvane.functions.measures import derived_measures
from corvane.storage import cut


def numbered(df: DataFrame, order: list[str], out: str = "event_id") -> DataFrame:
    """Add out, 1..m in the given order: places within range partitions, and the rows before each.

    The partitions are written to the checkpoint folder first, so that both passes see the same ones.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    before, offsets = 0, []
    for r in sorted(placed.groupBy("_part").count().collect()):  # a row per partition
        offsets.append((r["_part"], before))
        before += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before long"))
    at = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    return placed.join(starts, "_part").withColumn(out, at + F.col("_before") + 1).drop("_part", "_at", "_before")


#: Export headers of the internal columns that go by another name.
_EXPORT_NAMES = {
    "event_start (s)": "event_start", "event_end (s)": "event_end", "Base (V)": "optical_base", "Step (V)": "optical_rise",
    "RefBase (V)": "opticalre_base", "RefStep (V)": "opticalre_rise", "entry Base (pA)": "entry_base", "entry Peak (pA)": "entry_peak",
    "exit Peak (pA)": "exit_peak", "exit Base (pA)": "exit_base", "event_plateau_t": "event_plateau",
}


def _exported(events: DataFrame, recordings: DataFrame, order: list[str], formula: Column | str, layout: list[str]) -> DataFrame:
    lacking = [c for c in INTERNAL if c not in events.columns]
    whole = events.withColumns({c: F.lit(None).cast("string" if c in TEXTS else "double") for c in lacking})
    both = whole.where("event_id is not null").unionByName(numbered(whole.where("event_id is null"), order))
    named = both.join(recordings.select("rec_id", F.col("file_name").alias("_f")), "rec_id", "left")
    named = named.withColumn("file_name", F.coalesce("file_name", "_f", F.lit("")))
    named = named.withColumns({c: F.coalesce(c, F.lit("")) for c in TEXTS if c != "file_name"})
    full = derived_measures(named, formula, "derived" if "derived" in events.columns else None)
    return full.select(*[F.col(f"`{_EXPORT_NAMES.get(c, c)}`").alias(c) for c in layout])


def to_legacy(events: DataFrame, recordings: DataFrame, order: list[str], formula: Column | str = "tagger") -> DataFrame:
    """The 28-column export: missing file names from the recording, missing texts blank, missing ids 1..m.

    events: internal columns (those that are not there are null), rec_id and, if values were stored, the
    map derived. Derived values are the stored ones, else made by the formula. Ids are given over the
    missing rows only (in the given order), as the file format has it; they can meet ids that are there.
    """
    return _exported(events, recordings, order, formula, LEGACY)


def to_predicted(events: DataFrame, recordings: DataFrame, order: list[str]) -> DataFrame:
    """The 27-column predicted form: absolute step changes, the plateau time twice, no window."""
    return _exported(events, recordings, order, "nn", PREDICTED)


def shift_times(events: DataFrame, offsets: DataFrame, times: list[str]) -> DataFrame:
    """File times to experiment times by each recording's offset."""
    joined = events.join(offsets.select("rec_id", "t_offset"), "rec_id")
    return joined.withColumns({c: F.col(c) + F.col("t_offset") for c in times}).drop("t_offset")
