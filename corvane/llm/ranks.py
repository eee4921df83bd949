"""Places of rows within groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.shared import cut

_ROW_BITS = (1 << 33) - 1


def with_runs(rows: DataFrame, runs: DataFrame, group: list[str]) -> DataFrame:
    """rows with the other columns of their run; groups and parts meet at most a partition's rows."""
    keys = [*group, "part"]
    named = runs.select(*[F.col(c).alias(f"_run{i}") for i, c in enumerate(keys)], *[c for c in runs.columns if c not in keys])
    on = F.col(keys[0]).eqNullSafe(F.col("_run0"))
    for i, c in enumerate(keys[1:], 1):
        on &= F.col(c).eqNullSafe(F.col(f"_run{i}"))
    return rows.join(named, on).drop(*[f"_run{i}" for i in range(len(keys))])


def runs_of(df: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): the rows dealt by range of group and order, and each partition's run of each group.

    rows: the rows with part and at, the place within the partition. runs: (group, part, first, rows).
    The range partitions are written to the checkpoint folder, so all that is read later agrees; a
    large group is spread over as many partitions as its rows need.
    """
    placed = cut(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order))
    rows = placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    return rows, rows.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add pos (from 0, in order within the group, nulls first) and total (the group's rows).

    Only runs are put in order by a window: a group has at most one for each partition.
    """
    rows, runs = runs_of(df, group, order)
    ordered = Window.partitionBy(*group).orderBy("part")
    before = F.coalesce(F.sum("rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*group, "part", "first", before.alias("before"), F.sum("rows").over(Window.partitionBy(*group)).alias("total"))
    found = with_runs(rows, runs, group)
    return found.select(*df.columns, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "total")
