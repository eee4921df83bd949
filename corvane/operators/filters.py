"""Row filters and usability rules for feature tables and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duration_filter(df: DataFrame, least: float = 0.0, most: float = 0.0, column: str = "duration") -> DataFrame:
    """Above least and up to most; 0 turns a bound off; missing durations go when one is on."""
    if least > 0:
        df = df.where(F.col(column) > least)
    if most > 0:
        df = df.where(F.col(column) <= most)
    return df


def drop_missing(df: DataFrame, features: list[str], complete: bool = False) -> DataFrame:
    """Rows with some value in the features, or with all of them."""
    return df.na.drop(how="any" if complete else "all", subset=features)


def feature_usability(df: DataFrame, group: str, features: list[str], least: int = 2) -> DataFrame:
    """For each group and feature: usable, or the reason why not."""
    stats = df.groupBy(group).agg(*[F.struct(F.count(c).alias("n"), (F.min(c) < F.max(c)).alias("varies")).alias(c) for c in features])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in features]))
    reason = F.when(F.col("_f.s.n") < least, "too few values").when(~F.coalesce(F.col("_f.s.varies"), F.lit(False)), "constant").otherwise("usable")
    return stats.select(group, rows.alias("_f")).select(group, F.col("_f.feature").alias("feature"), F.col("_f.s.n").alias("n"), reason.alias("reason"))


def pooled_features(df: DataFrame, features: list[str]) -> list[str]:
    """Features with at least two different values in the pooled rows (one aggregate row)."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in features]).first()
    return [c for c in features if row[c]]


def condition_filter(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows whose condition is wanted; blank and missing count as other."""
    return df.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("other"))).where(F.col(column).isin(wanted))


def any_in_range(df: DataFrame, times: list[str], low, high) -> DataFrame:
    """Rows with any of the times within low..high, both included."""
    return df.where(F.exists(F.array(*times), lambda t: F.coalesce(t.between(low, high), F.lit(False))))


def within_limits(limits: dict[str, tuple[float | None, float | None]]) -> Column:
    """Condition that holds all given bounds, inclusive."""
    parts = [F.lit(True)]
    for c, (low, high) in limits.items():
        parts += [F.col(c) >= low] if low is not None else []
        parts += [F.col(c) <= high] if high is not None else []
    return reduce(lambda a, b: a & b, parts)


def axis_limits(df: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """kept and total: how many rows are within the limits."""
    return df.agg(F.count_if(within_limits(limits)).alias("kept"), F.count(F.lit(1)).alias("total"))


def author_filter(df: DataFrame, column: str, listed: DataFrame, ticked: DataFrame) -> DataFrame:
    """Hide authors that are listed but not ticked; a missing author is '?'."""
    hidden = listed.select(column).subtract(ticked.select(column))
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("?"))).join(hidden, column, "left_anti")


def failure_note(found: Column, start: Column, stop: Column, n_samples: Column, longest: float = 60.0, fewest: int = 32, open_error: Column | None = None, model_error: Column | None = None) -> Column:
    """Why an event cannot be measured, or null; open_error and model_error are texts of errors, null for none."""
    none = F.lit(None).cast("string")
    opened, model = (none if e is None else e for e in (open_error, model_error))
    return (
        F.when(~found, "recording not found")
        .when(opened.isNotNull(), F.concat(F.lit("open failed: "), opened))
        .when(start.isNull() | stop.isNull() | (stop <= start), "no window")
        .when(stop - start > longest, "window too long")
        .when(n_samples < fewest, "too few samples")
        .when(model.isNotNull(), F.concat(F.lit("model failure: "), model))
    )


def inspect_event(df: DataFrame, excluded: DataFrame, key: dict) -> DataFrame:
    """The pooled event with this key and whether it is excluded."""
    one = df.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in key.items()]))
    marks = excluded.select(*key, F.lit(True).alias("excluded")).distinct()
    return one.join(marks, list(key), "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
