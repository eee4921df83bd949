"""Sharding by histogram sort.

Rows are ordered by a key that spreads evenly (hash of the text, then of the row). Boundaries between
shards are found by counting, over all partitions, the exact bytes below candidate keys and
refining the candidates between the best ones, until every boundary is within tolerance of an
equal share. Only counts travel meanwhile; the rows are exchanged once, at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.llm.shared import col, cut, put_back, set_apart

_HALF, _ROW = 1 << 63, 1 << 64


def _split(key: int) -> tuple[int, int]:
    return key // _ROW - _HALF, key % _ROW - _HALF


def _part_of(first: np.ndarray, second: np.ndarray, bounds_first: np.ndarray, bounds_second: np.ndarray) -> np.ndarray:
    """How many boundaries are at or below each (first, second)."""
    low = np.searchsorted(bounds_first, first, "left")
    high = np.searchsorted(bounds_first, first, "right")
    tied = np.flatnonzero(high > low)
    for value in np.unique(first[tied]):  # at most one a boundary
        rows = tied[first[tied] == value]
        a, b = low[rows[0]], high[rows[0]]
        low[rows] = a + np.searchsorted(bounds_second[a:b], second[rows], "right")
    return low


def _arrays(bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [_split(b) for b in bounds]
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def _histogram(keys: DataFrame, bounds: list[int]) -> list[tuple[int, int, int, int]]:
    """For each part between boundaries: bytes, rows, lowest and highest first key (exact)."""
    first, second = _arrays(bounds)

    def count(batches):
        n = len(first) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = np.full(n, _HALF - 1, np.int64), np.full(n, -_HALF, np.int64)
        for b in batches:
            a = np.asarray(b.column("_a"))
            part = _part_of(a, np.asarray(b.column("_b")), first, second)
            np.add.at(size, part, np.asarray(b.column("_bytes")))
            np.add.at(rows, part, 1)
            np.minimum.at(low, part, a)
            np.maximum.at(high, part, a)
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, size[at], rows[at], low[at], high[at])], names=["part", "bytes", "n", "low", "high"])

    found = keys.mapInArrow(count, "part long, bytes long, n long, low long, high long").groupBy("part").agg(F.sum("bytes"), F.sum("n"), F.min("low"), F.max("high"))
    out = [(0, 0, 0, -1)] * (len(bounds) + 1)
    for part, *values in found.collect():  # one row per part: bounded by the number of probes
        out[part] = tuple(values)
    return out


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float, probes: int = 12, rounds: int = 60) -> list[int]:
    """Boundaries of n_shards shards of about equal bytes, as 128-bit keys.

    keys: _a, _b, _bytes. Each boundary is off an equal share by the tolerance (a fraction of a
    shard) at most, unless one row alone is larger than that. Only the histograms' counts, a row for
    each of probes * (n_shards - 1) candidates a round, come to the driver, at any size of the data.
    """
    n = n_shards
    total = keys.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    if not total:
        return [(i * _ROW * _ROW) // n for i in range(1, n)]
    allowed = max(1, int(total / n * tolerance))
    wanted = [total * i // n for i in range(1, n)]
    ranges = [(0, _ROW * _ROW)] * (n - 1)
    best: list[int | None] = [None] * (n - 1)
    for _ in range(rounds):
        tried = {low + (high - low) * j // (probes + 1) for i, (low, high) in enumerate(ranges) if best[i] is None for j in range(1, probes + 1)}
        if not tried:
            break
        bounds = sorted(tried)
        parts = _histogram(keys, bounds)
        edges = [0, *bounds, _ROW * _ROW]
        below = np.concatenate([[0], np.cumsum([size for size, *_ in parts], dtype=np.int64)])
        for i in range(n - 1):
            if best[i] is None:
                at = max(1, int(np.searchsorted(below, wanted[i])))
                near = min((abs(int(below[k]) - wanted[i]), edges[k]) for k in (at - 1, at))
                low, high = max(edges[at - 1], ranges[i][0]), min(edges[at], ranges[i][1])
                _, _, first, last = parts[at - 1]
                ranges[i] = max(low, (first + _HALF) * _ROW), min(high, (last + _HALF + 1) * _ROW)
                if near[0] <= allowed or ranges[i][1] - ranges[i][0] <= 1:
                    best[i] = near[1]
    return sorted(b if b is not None else ranges[i][1] for i, b in enumerate(best))


def histogram_shards(df: DataFrame, first: str, second: str, size: str, n_shards: int = 8, rows_per_part: int = 1_000_000, tolerance: float = 0.005, max_broadcast_parts: int = 1_000_000) -> DataFrame:
    """Add shard (0 to n_shards - 1, near equal sums of size) and slot (gapless from 0 in a shard).

    first: a long that spreads evenly, such as a hash of the text; second: a long that spreads rows
    of equal firsts evenly, such as a hash of the id and a row number (null in either: lowest). Rows of
    one first stay in a shard wherever the sizes allow it, but a boundary may fall inside, so repeated
    rows do not upset the law. The rows are exchanged once, to parts of a shard: ranges of first, each
    divided by second as its count of rows asks, so no task holds a whole shard or a whole group of
    equal firsts. An empty table gives an empty one. Input columns named shard or slot are replaced;
    others may have any names.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    low = F.lit(-_HALF).cast("long")
    keyed = df.select(*set_apart(kept), F.coalesce(col(first), low).alias("_a"), F.coalesce(col(second), low).alias("_b"), F.coalesce(col(size).cast("long"), F.lit(0).cast("long")).alias("_bytes"))
    keys = keyed.select("_a", "_b", "_bytes")
    bounds = find_splitters(keys, n_shards, tolerance)
    a, b = _arrays(bounds)
    n_rows = keys.count()
    ranges = max(8, -(-n_rows // rows_per_part))
    names = keyed.columns

    def assign(batches):
        for batch in batches:
            at = np.asarray(batch.column("_a"))
            shard = _part_of(at, np.asarray(batch.column("_b")), a, b)
            part = shard * ranges + (((at >> 32) + (1 << 31)) * ranges >> 32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(part)], names=[*names, "_shard", "_range"])

    extra = [T.StructField("_shard", T.IntegerType()), T.StructField("_range", T.LongType())]
    ranged = keyed.mapInArrow(assign, T.StructType([*keyed.schema.fields, *extra]))
    filled = cut(ranged.groupBy("_shard", "_range").agg(F.count(F.lit(1)).alias("n")))
    pieces = filled.select("_range", F.ceil(F.col("n") / rows_per_part).alias("_pieces"))
    few = filled.count() <= max_broadcast_parts
    light = F.broadcast if few else (lambda x: x)
    dealt = ranged.join(light(pieces), "_range").withColumn("_piece", F.pmod(F.xxhash64("_b", F.lit(3)), F.col("_pieces")))
    sizes = cut(dealt.groupBy("_shard", "_range", "_piece").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("_shard").orderBy("_range", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", "_piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range", "_piece").orderBy("_a", "_b"))
    placed = dealt.withColumn("_n", place).join(light(starts), ["_range", "_piece"])
    return placed.select(*put_back(kept), F.col("_shard").alias("shard"), (F.col("_start") + F.col("_n") - 1).alias("slot"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document; size is UTF-8 bytes plus 1.

    A null text has no bytes, a null id is an id; empty and very long texts count by their bytes, and
    other columns are not read. Equal texts stay in one shard wherever sizes allow it.
    """
    data = F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8")
    spread = F.xxhash64(data)
    light = cut(docs.select(col(id_col).alias("doc_id"), (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"), spread.alias("spread"), F.xxhash64(col(id_col), F.monotonically_increasing_id()).alias("tie")))
    return histogram_shards(light, "spread", "tie", "size", n_shards).drop("spread", "tie")
