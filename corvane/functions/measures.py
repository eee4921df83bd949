"""Measures of an event from its landmarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.columns import numeric


def step_signed(base: Column, step: Column) -> Column:
    """Step change in percent of the mean level; null when the mean is zero."""
    return (step - base) / F.nullif((step + base) / 2, F.lit(0.0)) * 100


def step_absolute(base: Column, step: Column) -> Column:
    """The size of the step change in percent; 0 when the mean level is zero."""
    total = (step + base) / 2
    return F.when(total == 0, 0.0).otherwise(F.abs((step - base) / F.nullif(total, F.lit(0.0)) * 100))


def spike(base: Column, peak: Column) -> Column:
    return peak - base


def derived_measures(df: DataFrame, formula: Column | str, stored: str | None = None) -> DataFrame:
    """Add duration, OSC, RefOSC, entry spike and exit spike to internal events.

    A value in the stored map comes first, column by column; else end less start, the step changes
    by the formula (nn: absolute, anything else: signed), and peak less base. Nulls give nulls.
    """
    kind = F.lit(formula) if isinstance(formula, str) else formula
    made = {
        "duration": F.col("event_end") - F.col("event_start"),
        "OSC": derived(kind, F.lit(None).cast("double"), F.col("optical_base"), F.col("optical_rise")),
        "RefOSC": derived(kind, F.lit(None).cast("double"), F.col("opticalre_base"), F.col("opticalre_rise")),
        "entry spike": spike(F.col("entry_base"), F.col("entry_peak")),
        "exit spike": spike(F.col("exit_base"), F.col("exit_peak")),
    }
    return df.withColumns({c: F.coalesce(F.col(stored)[c], v) if stored else v for c, v in made.items()})


def filled_spike(base: Column, peak: Column) -> Column:
    """Peak less base where both are numbers, whatever their types; null otherwise."""
    return numeric(peak) - numeric(base)


def derived(formula: Column, stored: Column, base: Column, step: Column) -> Column:
    """A stored value first, else by the set's formula: nn is absolute, anything else signed."""
    return F.coalesce(stored, F.when(formula == "nn", step_absolute(base, step)).otherwise(step_signed(base, step)))


def spike_amplitude(df: DataFrame, group: str, base: str, peak: str, given: str, out: str, least: int = 2) -> DataFrame:
    """abs(peak - base) in groups with enough of them, else abs(given) with enough, else null."""
    made = F.abs(F.col(peak) - F.col(base))
    counts = df.groupBy(group).agg(F.count(made).alias("_made"), F.count(given).alias("_given"))
    pick = F.when(F.col("_made") >= least, made).when(F.col("_given") >= least, F.abs(F.col(given)))
    return df.join(counts, group).withColumn(out, pick).drop("_made", "_given")


def _known(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


def event_status(optical: list[str], electrical: list[str], window: list[str]) -> Column:
    """tagged, partial, window only or empty, from which landmarks there are."""
    all_electrical = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in electrical])
    return (
        F.when(_known(optical) & all_electrical, "tagged")
        .when(_known(optical) | _known(electrical), "partial")
        .when(_known(window), "window only")
        .otherwise("empty")
    )


def event_span(start: Column, stop: Column, times: list[Column]) -> tuple[Column, Column]:
    """The window if both its ends are set, else from the first to the last time."""
    both = start.isNotNull() & stop.isNotNull()
    return F.when(both, start).otherwise(F.least(*times)), F.when(both, stop).otherwise(F.greatest(*times))


def view_window(start: Column, stop: Column, length: Column, pad: float = 0.07, least: float = 0.1, most: float = 30.0) -> tuple[Column, Column]:
    """A span with padding on both sides, at least and at most so wide, inside 0..length."""
    span = F.least(F.greatest((stop - start) * (1 + 2 * pad), F.lit(least)), F.lit(most))
    middle = (start + stop) / 2
    return F.round(F.greatest(middle - span / 2, F.lit(0.0)), 6), F.round(F.least(middle + span / 2, length), 6)


def ordered(base: Column, plateau: Column, end: Column, gap: float = 0.0) -> tuple[Column, Column, Column]:
    """Three landmarks with plateau not before base and end not before plateau, by at least gap."""
    second = F.greatest(plateau, base + gap)
    return base, second, F.greatest(end, second + gap)


def standardize(df: DataFrame, columns: list[str], log_columns: tuple[str, ...] = ()) -> DataFrame:
    """log1p of the log columns (negatives as 0), then every column less its mean over its population deviation."""
    logged = df.withColumns({c: F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0)))) for c in log_columns})
    stats = logged.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    joined = logged.join(F.broadcast(stats))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in columns}
    return joined.withColumns(scaled).drop(*stats.columns)


#: Decimals of times, measures and percents in tables.
TIME_DIGITS, MEASURE_DIGITS, PERCENT_DIGITS = 4, 3, 2


def rounded(df: DataFrame, times: list[str] = (), measures: list[str] = (), percents: list[str] = ()) -> DataFrame:
    """The columns rounded for a table, halves to the even digit; nulls stay."""
    digits = {**dict.fromkeys(times, TIME_DIGITS), **dict.fromkeys(measures, MEASURE_DIGITS), **dict.fromkeys(percents, PERCENT_DIGITS)}
    return df.withColumns({c: F.bround(c, n) for c, n in digits.items()})
