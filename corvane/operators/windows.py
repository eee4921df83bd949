"""Event windows through the numpy helpers, in Arrow batches, and filters over chunked signals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import dsp


def map_windows(windows: DataFrame, helper: Callable[[np.ndarray], np.ndarray], column: str, out: str) -> DataFrame:
    """Add array<double> out = helper(column) for each window; a failing helper gives null."""
    schema = windows.select("*", F.array(F.lit(0.0)).alias(out)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for x in batch[column]:
                try:
                    made.append(np.asarray(helper(np.asarray(x, np.float64)), np.float64).ravel())
                except (ValueError, ArithmeticError):
                    made.append(None)
            yield batch.assign(**{out: made})

    return windows.mapInPandas(run, schema)


#: Windows that go to a helper together.
WINDOWS = 1024


def arrays_of(table: pa.Table, column: str) -> list[np.ndarray]:
    """The arrays of numbers of a column, missing ones as NaN."""
    lists = table.column(column).combine_chunks()
    values, at = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def map_columns(windows: DataFrame, helper: Callable[[pa.Table], list], names: list[str], kind: str = "double") -> DataFrame:
    """Add columns: helper(table of some windows) gives the values of each; rows stay where they are."""
    schema = windows.select("*", *[F.lit(None).cast(kind).alias(c) for c in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, WINDOWS):
                table = pa.Table.from_batches([batch.slice(start, WINDOWS)])
                for name, made in zip(names, helper(table), strict=True):
                    table = table.append_column(name, pa.array(made, pa.list_(pa.float64()) if kind.startswith("array") else pa.float64()))
                yield from table.combine_chunks().to_batches()

    return windows.mapInArrow(run, schema)


def causal_chunks(chunks: DataFrame, order: int = 8, cutoff: float = 100.0, halo_s: float = 0.25) -> DataFrame:
    """Causal low-pass of signal chunks (file, channel, chunk_idx, i0, fs, values).

    A chunk needs only the end of the one before it, as long as the filter remembers: that tail is
    sent over by a join of neighbours, so recordings of any length are filtered chunk by chunk. The
    filter starts from zero at a recording's begin.
    """
    keep = F.ceil(F.col("fs") * halo_s).cast("int")
    tails = chunks.select("file", "channel", (F.col("chunk_idx") + 1).alias("chunk_idx"), F.slice("values", F.greatest(F.size("values") - keep + 1, F.lit(1)), keep).alias("tail"))
    joined = chunks.join(tails, ["file", "channel", "chunk_idx"], "left")
    schema = chunks.select("file", "channel", "chunk_idx", "i0", "fs", F.col("values").cast("array<double>").alias("values")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for fs, values, tail in zip(batch["fs"], batch["values"], batch["tail"], strict=True):
                before = np.zeros(0) if tail is None else np.asarray(tail, np.float64)
                x = np.r_[before, np.asarray(values, np.float64)]
                made.append(dsp.causal_filter(x, dsp.bessel_sections(order, min(cutoff, fs / 2.5), fs), fs, halo_s)[len(before) :])
            yield batch[["file", "channel", "chunk_idx", "i0", "fs"]].assign(values=made)

    return joined.mapInPandas(run, schema)
