"""Landmark times and what the signals are at them: assembled, moved and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.signal import uniform_lookup

#: The amplitudes that are read at each landmark time, with the role of their channel.
AMPLITUDES_AT = {
    "event_start": [("optical", "optical_base"), ("reference", "opticalre_base")],
    "event_plateau": [("optical", "optical_rise"), ("reference", "opticalre_rise")],
    "event_end": [("optical", "optical_end"), ("reference", "opticalre_end")],
    "entry_base_t": [("electrical", "entry_base")],
    "entry_peak_t": [("electrical", "entry_peak")],
    "exit_peak_t": [("electrical", "exit_peak")],
    "exit_base_t": [("electrical", "exit_base")],
}
ROLES = ["electrical", "optical", "reference"]


def read_amplitudes(events: DataFrame, samples: DataFrame, roles: DataFrame, times: list[str] | None = None) -> DataFrame:
    """events with the amplitudes of these landmark times (all that events has), by linear interpolation.

    events: event, recording and times in seconds from the recording's begin; samples: recording,
    channel, i, v; roles: recording, fs and a channel for each role. A time outside the samples, or a null
    one, has null amplitudes. Looked up by index, in two equi-joins for all times and channels together.
    """
    times = [t for t in AMPLITUDES_AT if t in events.columns] if times is None else times
    marks = [F.struct(F.lit(a).alias("amplitude"), F.col(r).alias("channel"), F.col(t).alias("time")) for t in times for r, a in AMPLITUDES_AT[t]]
    points = events.select("event", "recording", *times).join(roles, "recording").select("event", "recording", "fs", F.explode(F.array(*marks)).alias("m")).where("m.time is not null")
    # Times in samples, so that recordings of any rate go together.
    points = points.select(F.struct("recording", F.col("m.channel").cast("long").alias("channel")).alias("key"), F.struct("event", "m.amplitude").alias("point"), (F.col("m.time") * F.col("fs")).alias("t"))
    keyed = samples.select(F.struct("recording", F.col("channel").cast("long").alias("channel")).alias("key"), "i", "v")
    found = uniform_lookup(points, keyed, 1.0).select("point.event", "point.amplitude", "v")
    names = [a for t in times for _, a in AMPLITUDES_AT[t]]
    wide = found.groupBy("event").agg(*[F.max(F.when(F.col("amplitude") == a, F.col("v"))).alias(a) for a in names])
    return events.drop(*names).join(wide, "event", "left")


def move_landmarks(events: DataFrame, edits: DataFrame, samples: DataFrame, roles: DataFrame) -> DataFrame:
    """events with moved landmark times, and the amplitudes at the moved ones read again.

    edits: event and, for any landmarks, their new times (null: not moved); one row an event. Amplitudes
    at other landmarks stay as they are. samples and roles as in read_amplitudes.
    """
    times = [t for t in AMPLITUDES_AT if t in edits.columns]
    new = edits.select("event", *[F.col(t).alias(f"_{t}") for t in times])
    moved = events.join(new, "event", "left")
    asked = moved.select("event", "recording", *[F.col(f"_{t}").alias(t) for t in times]).where(F.coalesce(*[F.col(t) for t in times]).isNotNull())
    names = [a for t in times for _, a in AMPLITUDES_AT[t]]
    read = read_amplitudes(asked, samples, roles, times).select("event", *[F.col(a).alias(f"_{a}") for a in names])
    both = moved.join(read, "event", "left")
    changed = {a: F.when(F.col(f"_{t}").isNotNull(), F.col(f"_{a}")).otherwise(F.col(a) if a in events.columns else F.lit(None)) for t in times for _, a in AMPLITUDES_AT[t]}
    changed |= {t: F.coalesce(f"_{t}", t) for t in times}
    extra = [a for a in names if a not in events.columns]
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in [*events.columns, *extra]])


def cut_roles(windows: DataFrame, samples: DataFrame, roles: DataFrame, width: float) -> DataFrame:
    """(event, recording, t, electrical, optical, reference): the samples of each window in all three
    roles, arrays of equal length in order; samples that a role lacks are left out of all.

    windows: event, recording, t0, t1; samples: recording, channel, i, t, v; roles: recording and a channel
    for each role (one channel may have several). width: seconds of the time blocks that are joined.
    """
    block = lambda t: F.floor(t / width).cast("long")
    each = roles.select("recording", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("channel")) for r in ROLES])).alias("r")).select("recording", "r.*")
    asked = windows.withColumn("_b", F.explode(F.sequence(block(F.col("t0")), block(F.col("t1"))))).join(each, "recording")
    near = samples.withColumn("_b", block(F.col("t"))).join(asked, ["recording", "channel", "_b"]).where(F.col("t").between(F.col("t0"), F.col("t1")))
    one = near.groupBy("event", "recording", "i").agg(F.min("t").alias("t"), F.count_distinct("role").alias("n"), *[F.max(F.when(F.col("role") == r, F.col("v"))).alias(r) for r in ROLES]).where(F.col("n") == len(ROLES))
    rows = one.groupBy("event", "recording").agg(F.array_sort(F.collect_list(F.struct("i", "t", *ROLES))).alias("s"))  # bounded by the longest window
    return rows.select("event", "recording", F.col("s.t").alias("t"), *[F.col(f"s.{r}").alias(r) for r in ROLES])
