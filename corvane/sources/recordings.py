"""Recordings in byte ranges: written, read and digested without a file ever being a row.

Spark lists the files; tasks open them by their URI and read the ranges that their rows name. A format
says where the samples of a range lie; the one here is a header and gap-free samples of one width.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.quantiles import join_groups

#: The header's size in bytes.
HEADER = 12 * 512
#: Bytes that a digest reads at a time.
READ_BYTES = 8 << 20


def open_uri(uri: str, mode: str = "rb"):
    """A random-access input ("rb") or an output stream ("wb") on any file system that pyarrow knows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri("file://" + uri.split(":", 1)[1].replace("//", "") if uri.startswith("file:") else uri)
    return system.open_input_file(path) if mode == "rb" else system.open_output_stream(path)


@dataclass
class Header:
    """n samples of each channel, over all sweeps; fs a second; sweeps of equal length, the last takes the rest;
    width: bytes of a sample."""

    n: int
    channels: int
    fs: float
    sweeps: int
    scales: list[float]
    offsets: list[float]
    width: int = 2

    def sweep_length(self) -> int:
        return max(1, self.n // max(1, self.sweeps))


class Int16Format:
    """Header of float64 numbers (n, channels, fs, scales, offsets, sweeps, width), then interleaved samples, sweep after sweep.

    Samples are counted in steps of their scale from their offset: as int16 (width 2, or none in the header), or
    as float64 (width 8) in recordings with a value that int16 does not hold, or a missing one (NaN).
    """

    TYPES = {2: "<i2", 8: "<f8"}

    def header(self, file) -> Header:
        head = np.frombuffer(file.read_at(HEADER, 0), np.float64)
        c = int(head[1])
        return Header(int(head[0]), c, float(head[2]), max(1, int(head[3 + 2 * c])), head[3 : 3 + c].tolist(), head[3 + c : 3 + 2 * c].tolist(), int(head[4 + 2 * c]) or 2)

    def samples(self, file, h: Header, start: int, stop: int) -> np.ndarray:
        """(stop - start, channels) samples in their units, of the sweeps joined end to end."""
        width = h.width * h.channels
        raw = np.frombuffer(file.read_at((stop - start) * width, HEADER + start * width), self.TYPES[h.width]).reshape(-1, h.channels)
        return raw * np.asarray(h.scales) + np.asarray(h.offsets)

    def packed_header(self, h: Header) -> bytes:
        head = np.zeros(HEADER // 8)
        values = [h.n, h.channels, h.fs, *h.scales, *h.offsets, h.sweeps, h.width]
        head[: len(values)] = values
        return head.tobytes()

    def packed(self, h: Header, samples: np.ndarray) -> bytes:
        steps = np.round((samples - np.asarray(h.offsets)) / np.asarray(h.scales))
        if h.width == 2 and not ((steps >= -32768) & (steps <= 32767)).all():
            raise ValueError("a sample is missing or beyond int16: give the header a width of 8")
        return steps.astype(self.TYPES[h.width]).tobytes()


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name and size of the files under a folder (Spark leaves out empty ones); their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def file_digests(spark: SparkSession, root: str, pattern: str = "*", opener: Callable = open_uri) -> DataFrame:
    """name, size and SHA-256 of each file, read block by block: files of any size, a few megabytes in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                with opener(path) as file:
                    while block := file.read(READ_BYTES):
                        digest.update(block)
                made.append(digest.hexdigest())
            yield batch[["name", "size"]].assign(sha256=made)

    return listed(spark, root, pattern).repartition("path").mapInPandas(run, "name string, size long, sha256 string")


HEADERS = "file string, n long, channels int, fs double, sweeps int, duration double, scales array<double>, offsets array<double>, width int"


def recording_headers(spark: SparkSession, root: str, pattern: str = "*.rec", layout=None, opener: Callable = open_uri) -> DataFrame:
    """HEADERS of each recording, without its samples."""
    layout = layout or Int16Format()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                with opener(path) as file:
                    h = layout.header(file)
                rows.append((path, h.n, h.channels, h.fs, h.sweeps, h.n / h.fs, h.scales, h.offsets, h.width))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADERS.split(", ")])

    return listed(spark, root, pattern).repartition("path").mapInPandas(run, HEADERS)


CHUNKS = "file string, channel int, chunk_idx long, i0 long, fs double, sweep0 int, values array<float>"


def decode_recordings(spark: SparkSession, root: str, pattern: str = "*.rec", chunk: int = 131_072, layout=None, opener: Callable = open_uri) -> DataFrame:
    """CHUNKS of all recordings under a folder: each range of a file is a row of its own and is read in its task.

    Sweeps are joined end to end: i0 counts the samples of all sweeps, sweep0 is the sweep in which the
    chunk begins (see sweeps_of for their times).
    """
    layout = layout or Int16Format()
    heads = recording_headers(spark, root, pattern, layout, opener).where("n > 0")
    last = F.floor((F.col("n") - 1) / chunk).cast("long")
    ranges = heads.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("file", "chunk_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                h = Header(int(r.n), int(r.channels), r.fs, int(r.sweeps), list(r.scales), list(r.offsets), int(r.width))
                i0 = int(r.chunk_idx) * chunk
                with opener(r.file) as file:
                    values = layout.samples(file, h, i0, min(h.n, i0 + chunk)).astype(np.float32)
                sweep = min(i0 // h.sweep_length(), h.sweeps - 1)
                yield pd.DataFrame({"file": r.file, "channel": range(h.channels), "chunk_idx": r.chunk_idx, "i0": i0, "fs": h.fs, "sweep0": sweep, "values": list(values.T)})

    return ranges.mapInPandas(run, CHUNKS)


def sweeps_of(headers: DataFrame) -> DataFrame:
    """(file, sweep, s0, s1): each sweep's place in seconds from the file's begin, laid end to end."""
    each = headers.withColumn("sweep", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)))
    length = F.greatest(F.lit(1), F.floor(F.col("n") / F.col("sweeps")))
    stop = F.when(F.col("sweep") == F.col("sweeps") - 1, F.col("n")).otherwise((F.col("sweep") + 1) * length)
    return each.select("file", "sweep", (F.col("sweep") * length / F.col("fs")).alias("s0"), (stop / F.col("fs")).alias("s1"))


def write_recordings(samples: DataFrame, root: str, fs: float, scale: float, offset: float, sweeps: int = 1, layout=None, opener: Callable = open_uri) -> DataFrame:
    """Write {root}/{key}.rec of each key's samples (key, i, v), one channel; gives (key, file, n).

    Samples pass through sorted, so a file of any length is written as it comes. The folder must be there.
    A recording has the width that holds all of its values.
    """
    layout = layout or Int16Format()
    holds = F.coalesce(F.rint((F.col("v") - offset) / scale).between(-32768, 32767), F.lit(False))
    sizes = samples.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.when(F.min(holds), 2).otherwise(8).alias("width"))
    sized = join_groups(samples.select("key", "i", "v"), sizes, ["key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, out, done = None, None, []
        for batch in batches:
            for k, part in batch.groupby("key", sort=False):
                h = Header(int(part["n"].iloc[0]), 1, fs, sweeps, [scale], [offset], int(part["width"].iloc[0]))
                if k != key:
                    if out:
                        out.close()
                    key, out = k, opener(f"{root}/{k}.rec", "wb")
                    out.write(layout.packed_header(h))
                    done.append((k, f"{root}/{k}.rec", h.n))
                out.write(layout.packed(h, part["v"].to_numpy(float)[:, None]))
        if out:
            out.close()
        yield pd.DataFrame(done, columns=["key", "file", "n"])

    return sized.repartition("key").sortWithinPartitions("key", "i").mapInPandas(run, "key long, file string, n long")
