"""Removal of byte strings that occur more than once, by induced sorting.

Suffixes that cannot share `length` bytes with another one are left out first. Every window of
`length` bytes belongs to the stretch of windows around it with the same least hash of their
inner strings (sampled suffixes); equal windows have equal least hashes, wherever they stand, so
only stretches whose least hash occurs at two places go on. Equal stretches become one, with a
weight. The distinct ones are dealt to shards by their least hash through Spark's external sort,
which is the disk-backed queue here: tuples of (key, stretch) beyond a task's memory are spilled.

In a shard the sampled suffixes are sorted by their bytes, with the length of the prefix that each
has in common with the one before. The suffixes to their left are induced from that order: one
byte further left, a stable sort by the byte before puts them in order, and their common prefix
is one more than the least one between them (none after unlike bytes). Windows with `length` common
bytes are equal; bytes are compared, not hashes. Where very many stretches share a key, their
suffixes are divided by distance from the sampled one, which gives longer and so rarer keys; this
recurs until keys are whole windows, so that no shard grows without bound.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import shingles as S
from corvane.llm.shared import col, cut, stored

LONGEST_RUN = 1024
#: Windows of a shard, and distinct stretches of one key that still go to one shard.
SHARD_WINDOWS, HOT = 1_500_000, 5_000
#: How many windows keep one key at each level at which a frequent key is divided.
WIDTHS = (32, 8, 1)
#: Bits of the broadcast filter of repeated least hashes at most. A full filter lets more stretches
#: pass to the exact join behind it; it neither loses any nor needs another scan.
MOST_BITS = 1 << 29
#: Stretches that a task remembers to have sent.
SEEN = 500_000


def _rolling(sums: np.ndarray, n: int, length: int) -> np.ndarray:
    """Hashes of all strings of this length."""
    return S.mix((sums[length:] - sums[: n - length + 1]) * S.powers(S._INVERSE, n)[: n - length + 1])


def _gram(length: int) -> int:
    """Inner strings: long enough to be rarely alike by chance, short enough for long stretches."""
    return max(8, 2 * length // 5)


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(S._BYTE[data] * S.powers(S._BASE, len(data)), out=sums[1:])
    return sums


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i, by running minima of blocks from both sides."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, ~np.uint64(0))
    full[: len(x)] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _inside(ends: np.ndarray, n: int, length: int) -> np.ndarray:
    """Starts of the windows that lie within one text."""
    limit = np.repeat(ends[1:], np.diff(ends))
    at = np.arange(max(0, n - length + 1))
    return at[at + length <= limit[: len(at)]]


def stretches(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows, numbers of windows and least hashes of the stretches of all texts."""
    n = len(data)
    at = _inside(ends, n, length)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    gram = _gram(length)
    least = _sliding_min(_rolling(_sums(data), n, gram), length - gram + 1)[at]
    new = np.r_[True, (least[1:] != least[:-1]) | (np.diff(at) > 1)]
    began = np.flatnonzero(new)
    run = np.arange(len(at)) - np.repeat(began, np.diff(np.r_[began, len(at)]))
    first = np.flatnonzero(run % LONGEST_RUN == 0)
    return at[first], np.diff(np.r_[first, len(at)]), least[first]


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The hash at each place that gives some window its least hash.

    A place does so if, among the windows around it, the greatest of the least hashes is its own.
    """
    n, gram = len(data), _gram(length)
    w = length - gram + 1
    at = _inside(ends, n, length)
    if not len(at):
        return np.zeros(0, np.uint64)
    grams = _rolling(_sums(data), n, gram)
    least = np.zeros(len(grams) + w - 1, np.uint64)
    least[at + w - 1] = _sliding_min(grams, w)[at]
    return grams[~_sliding_min(~least, w) == grams]


def _least_hashes(source: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for batch in S.text_slices(whole, 0):
                least = anchors(*S.raw_texts(batch.column(0)), length)
                values, counts = np.unique(least, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["least", "n"])

    return source.select("_text").mapInArrow(run, "least long, n long").groupBy("least").agg(F.sum("n").alias("n")).where("n > 1").select("least")


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places in the filter. Least hashes are small numbers, so they are mixed once more."""
    return S.mix(hashes) >> np.uint64(64 - bits)


def _filter_bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the hashes' slots; its size is bounded, whatever the data."""
    block = min(1 << 13, (1 << bits) // 8)

    def run(batches):
        values = [_slots(b.column(0).to_numpy().view(np.uint64), bits) for b in batches]
        slot = np.unique(np.concatenate(values)) if values else np.zeros(0, np.uint64)
        mask = (np.uint8(128) >> (slot & np.uint64(7)).astype(np.uint8)).astype(np.uint8)
        at = (slot >> np.uint64(3)).astype(np.int64)
        for a, b in zip(*_runs(at // block), strict=True):
            out = np.zeros(block, np.uint8)
            np.bitwise_or.at(out, at[a:b] % block, mask[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([at[a] // block]), pa.array([out.tobytes()], pa.binary())], names=["block", "bits"])

    def join(key, table):
        merged = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"block": [key[0].as_py()], "bits": pa.array([merged.tobytes()], pa.binary())})

    schema = "block long, bits binary"
    rows = hashes.mapInArrow(run, schema).groupBy("block").applyInArrow(lambda k, t: join(k, t), schema)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.toLocalIterator():  # at most the bitmap
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["bits"], np.uint8)
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal values."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return first, np.r_[first[1:], len(x)] if len(x) else first


def _bits_for(n: int) -> int:
    return max(16, min(MOST_BITS.bit_length() - 1, int(n * 32).bit_length()))


COUNTED = "sid binary, least long, windows long"
PLACED = "sid binary, doc_id long, text_hash long, at long"
WITH_BYTES = "sid binary, least long, part binary"
SPANS = "id binary, first long, stop long"
PIECES = "id binary, key binary, ref binary, at long, weight long, ahead long, part binary"


def _digest(*parts: bytes) -> bytes:
    """A 128-bit cryptographic name for equal bytes."""
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _repeated_stretches(source: DataFrame, marks, bits: int, length: int, what: str) -> DataFrame:
    """Stretches whose least hash passes a broadcast filter of hashes: COUNTED, PLACED or WITH_BYTES."""
    names = [x.split()[0] for x in what.split(", ")]

    def run(batches):
        known, seen = marks.value, set()
        for whole in batches:
            for batch in S.text_slices(whole, 2):
                data, ends = S.raw_texts(batch.column(2))
                first, n, least = stretches(data, ends, length)
                slot = _slots(least, bits)
                hit = (known[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1
                first, n, least = first[hit], n[hit], least[hit]
                raw = data.tobytes()
                parts = [raw[a : a + k + length - 1] for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                columns = {"sid": pa.array([_digest(p) for p in parts], pa.binary()), "least": pa.array(least.view(np.int64)), "windows": pa.array(n)}
                if what == WITH_BYTES:  # a stretch's bytes are needed once; a task sends few of its repeats
                    columns["part"] = pa.array(parts, pa.binary())
                    fresh = [i for i, x in enumerate(columns["sid"].to_pylist()) if x not in seen and not seen.add(x)]
                    columns = {c: x.take(pa.array(fresh, pa.int64())) for c, x in columns.items()}
                    if len(seen) > SEEN:
                        seen.clear()
                if what == PLACED:
                    row = np.searchsorted(ends, first, "right") - 1
                    columns |= {"doc_id": batch.column(0).take(pa.array(row)), "text_hash": batch.column(1).take(pa.array(row)), "at": pa.array(first - ends[row])}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return source.select("doc_id", "text_hash", "_text").mapInArrow(run, what)


def _thin(order: np.ndarray, common: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted list without some entries: the common prefix of two is the least of those between."""
    at = np.flatnonzero(keep)
    if not len(at):
        return order[:0], common[:0]
    low = np.minimum.reduceat(common[: at[-1] + 1], np.r_[0, at[:-1] + 1])
    low[0] = 0
    return order[at], low


def _right_order(padded: np.ndarray, pos: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of length bytes from each pos (cut at stop), and what each has in common with the one before."""
    there = np.minimum(stop - pos, length)
    order = np.argsort(there, kind="stable")
    for j in range(length - 1, -1, -1):
        byte = np.where(j < there, padded[pos + j], 0).astype(np.uint8)
        order = order[np.argsort(byte[order], kind="stable")]
    common = np.zeros(len(pos), np.int64)
    alike = np.ones(max(0, len(pos) - 1), bool)
    for j in range(length):
        byte = padded[pos + j][order]
        alike &= byte[1:] == byte[:-1]
        if not alike.any():
            break
        common[1:] += alike
    there = there[order]
    common[1:] = np.minimum(common[1:], np.minimum(there[1:], there[:-1]))
    return order, common


def repeated_windows(data: np.ndarray, pos: np.ndarray, stop: np.ndarray, least: np.ndarray, most: np.ndarray, weight: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix number, distance) of windows equal to another one, or of a weight over 1.

    pos: sampled suffixes, each in a string that ends at stop; its windows begin least to most bytes before it.
    """
    order, common = _right_order(np.concatenate([data, np.zeros(length, np.uint8)]), pos, stop, length)
    found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(int(most.max(initial=-1)) + 1):
        if d:
            byte = data[pos[order] - d]
            into = np.argsort(byte, kind="stable")
            same = np.flatnonzero(byte[into][1:] == byte[into][:-1])
            between = np.stack([into[same] + 1, into[same + 1] + 1], 1).ravel()
            low = np.minimum.reduceat(np.r_[common, 0], between)[::2] if len(same) else common[:0]
            common = np.zeros(len(order), np.int64)
            common[same + 1] = low + 1
            order = order[into]
        some, prefix = _thin(order, common, least[order] <= d)
        if len(some):
            first = np.flatnonzero(prefix < length)
            again = np.repeat(np.add.reduceat(weight[some], first) > 1, np.diff(np.r_[first, len(some)]))
            found[0].append(some[again])
            found[1].append(np.full(again.sum(), d))
        # What needs more bytes in common than are left on the way can be equal to nothing any more.
        best = np.maximum(common, np.r_[common[1:], 0])
        order, common = _thin(order, common, (most[order] > d) & ((best + most[order] - d >= length) | (weight[order] > 1)))
        if not len(order):
            break
    return np.concatenate(found[0]), np.concatenate(found[1])


def _spans(part: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive offsets within a part: part, first, one after the last."""
    order = np.lexsort([offset, part])
    part, offset = part[order], offset[order]
    first = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(offset) != 1)]) if len(part) else part
    last = np.r_[first[1:], len(part)] - 1
    return part[first], offset[first], offset[last] + 1


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all parts, and where each begins and ends."""
    parts = table.column("part").to_pylist()
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


def _sampled(data: np.ndarray, ends: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of stretches: part, place, least and greatest distance of its windows.

    A window's is the first place in it of the stretch's least hash.
    """
    grams = _rolling(_sums(data), len(data), _gram(length))
    places = np.flatnonzero(grams == np.repeat(least, np.diff(ends))[: len(grams)])
    at = _inside(ends, len(data), length)
    part = np.repeat(np.arange(len(least)), np.diff(ends))[at]
    pos = places[np.searchsorted(places, at)]
    first = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (part[1:] != part[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    return part[first], pos[first], pos[first] - at[last], pos[first] - at[first]


def _found(table: pa.Table, data, ends, suffixes, length: int) -> pa.Table:
    """SPANS of the windows that occur again, by induced sorting."""
    part, pos, least, most = suffixes
    weight = table.column("weight").to_numpy()
    number, d = repeated_windows(data, pos, ends[part + 1], least, most, weight[part], length)
    owner, first, stop = _spans(part[number], pos[number] - d - ends[part[number]])
    return pa.table({"id": table.column("id").combine_chunks().take(pa.array(owner)), "first": pa.array(first, pa.int64()), "stop": pa.array(stop, pa.int64())})


def _sort_stretches(table: pa.Table, length: int) -> pa.Table:
    data, ends = _joined(table)
    return _found(table, data, ends, _sampled(data, ends, table.column("least").to_numpy().view(np.uint64), length), length)


def _sort_pieces(table: pa.Table, length: int) -> pa.Table:
    data, ends = _joined(table)
    most = table.column("ahead").to_numpy()
    suffixes = np.arange(len(most)), ends[:-1] + most, most - (np.diff(ends) - length), most
    return _found(table, data, ends, suffixes, length)


def _first_pieces(segments: DataFrame, length: int) -> DataFrame:
    """Stretches cut so that each piece has one sampled suffix, `ahead` bytes after its begin."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                some = pa.table(batch.slice(a, 2000))
                data, ends = _joined(some)
                part, pos, least, most = _sampled(data, ends, some.column("least").to_numpy().view(np.uint64), length)
                raw, take = data.tobytes(), pa.array(part)
                begin, stop = pos - most, pos - least + length
                pieces = pa.array([raw[x:y] for x, y in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary())
                refs, weights = some.column("id").combine_chunks().take(take), some.column("weight").combine_chunks().take(take)
                yield pa.RecordBatch.from_arrays([refs, pa.array(begin - ends[part]), weights, pa.array(most), pieces], names=["ref", "at", "weight", "ahead", "part"])

    return segments.select("id", "weight", "part", "least").mapInArrow(run, "ref binary, at long, weight long, ahead long, part binary")


def _divided(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """PIECES whose windows are at most `width` apart, with all that these have in common as the key."""

    def run(batches):
        for batch in batches:
            rows = []
            for ref, at, weight, ahead, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n = len(part) - length + 1
                begin = 0  # the first window is `ahead` bytes before the sampled suffix
                while begin < n:
                    cell = (ahead - begin) // width
                    stop = min(n, ahead - cell * width + 1)
                    own = part[begin : stop + length - 1]
                    low = ahead - (cell * width + width - 1)  # where the cell's farthest window would begin
                    key = part[max(0, low + width - 1) : low + length]
                    rows.append((_digest(b"%d " % (ahead - begin), own), _digest(b"%d " % cell, key), ref, at + begin, weight, ahead - begin, own))
                    begin = stop
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return pieces.select("ref", "at", "weight", "ahead", "part").mapInArrow(run, PIECES)


def _in_shards(rows: DataFrame, key: str, sort, length: int) -> DataFrame:
    """SPANS of rows (id, weight, part, ...), dealt to shards of bounded size by their key."""
    windows = rows.agg(F.coalesce(F.sum(F.octet_length("part") - (length - 1)), F.lit(0))).first()[0]
    shards = max(1, -(-windows // SHARD_WINDOWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(lambda t: sort(t, length), SPANS)


def _hot_spans(segments: DataFrame, length: int) -> DataFrame:
    """SPANS for stretches of very frequent keys, divided until no key is frequent."""
    pieces, levels = _first_pieces(segments, length), []
    for width in WIDTHS:
        rows = stored(_divided(pieces, width, length))
        kinds = stored(rows.groupBy("id").agg(F.first("key").alias("key"), F.sum("weight").alias("weight"), F.first("ahead").alias("ahead"), F.first("part").alias("part")))
        hot = cut(kinds.groupBy("key").count().where(F.col("count") > HOT).select("key"))
        last = width == 1 or hot.isEmpty()
        cold = kinds if last else kinds.join(hot, "key", "left_anti")
        levels.append((rows.select("id", "ref", "at"), _in_shards(cold, "key", _sort_pieces, length)))
        if last:
            break
        pieces = kinds.join(hot, "key", "left_semi").select(F.col("id").alias("ref"), F.lit(0).cast("long").alias("at"), "weight", "ahead", "part")
    spans = None
    for places, found in reversed(levels):
        found = found if spans is None else found.unionByName(spans)
        spans = places.join(found, "id").select(F.col("ref").alias("id"), (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("stop")).alias("stop"))
    return spans


def repeated_spans(source: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, first, stop): bytes of each text within repeated strings."""
    context = source.sparkSession.sparkContext
    repeated = cut(_least_hashes(source, length))
    bits = _bits_for(repeated.count())
    counted = _repeated_stretches(source, context.broadcast(_filter_bits(repeated, bits)), bits, length, COUNTED)
    kinds = cut(counted.groupBy("sid", "least", "windows").agg(F.count(F.lit(1)).alias("weight")).join(repeated, "least", "left_semi"))
    # A stretch that is the only kind with its least hash is repeated whole, or not at all;
    # one that occurs once may repeat itself.
    by_least = cut(kinds.groupBy("least").agg(F.count(F.lit(1)).alias("kinds"), F.sum("weight").alias("weight")))
    several = by_least.where("kinds > 1 or weight = 1").select("least")
    whole = kinds.join(by_least.where("kinds = 1 and weight > 1").select("least"), "least", "left_semi").select(F.col("sid").alias("id"), F.lit(0).cast("long").alias("first"), F.col("windows").alias("stop"))
    some_bits = _bits_for(several.count())
    parts = _repeated_stretches(source, context.broadcast(_filter_bits(several, some_bits)), some_bits, length, WITH_BYTES)
    weights = kinds.select("sid", "weight")
    hot = cut(by_least.where(F.col("kinds") > HOT).select("least"))
    segments = stored(parts.groupBy("sid").agg(F.first("least").alias("least"), F.first("part").alias("part")).join(weights, "sid").withColumnRenamed("sid", "id"))
    if hot.isEmpty():
        spans = whole.unionByName(_in_shards(segments, "least", _sort_stretches, length))
    else:
        cold = segments.join(hot, "least", "left_anti")
        spans = whole.unionByName(_in_shards(cold, "least", _sort_stretches, length)).unionByName(_hot_spans(segments.join(hot, "least", "left_semi"), length))
    by_sid = spans.groupBy("id").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))  # a stretch has at most LONGEST_RUN windows
    marks = kinds.select("least").distinct()
    places = _repeated_stretches(source, context.broadcast(_filter_bits(marks, bits)), bits, length, PLACED)
    found = places.join(by_sid, places["sid"] == by_sid["id"]).select("doc_id", "text_hash", "at", F.explode("spans").alias("s"))
    return found.select("doc_id", "text_hash", (F.col("at") + F.col("s.first")).alias("first"), (F.col("at") + F.col("s.stop") + length - 1).alias("stop"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): each text's spans in order, overlapping and touching ones as one."""
    listed = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("first", "stop"))).alias("spans"))
    schema = "doc_id long, text_hash long, spans array<struct<first: long, stop: long>>"

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())) << 40
            first, stop = (np.asarray(x) + row for x in lists.flatten().flatten())
            reach = np.maximum.accumulate(stop)
            new = np.flatnonzero(np.r_[True, first[1:] > reach[:-1]]) if len(first) else first
            end = reach[np.r_[new[1:], len(first)] - 1] if len(first) else first
            ends = np.searchsorted(first[new], np.arange(len(lists) + 1) << 40)
            low = first[new] >> 40 << 40
            pairs = pa.StructArray.from_arrays([pa.array(first[new] - low), pa.array(end - low)], names=["first", "stop"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)], names=["doc_id", "text_hash", "spans"])

    return listed.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, max_broadcast_spans: int = 500_000) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans and kept (binary).

    Removed is every byte of a string of `length` bytes that also starts anywhere else in the
    table (overlaps, the same document and repeated rows included). A null text has no bytes and
    keeps none; a null or repeated id is an id, and each of its texts is judged by itself. Windows are
    compared by their bytes; only equal stretches are told by a 128-bit cryptographic digest. Spans are
    joined back by broadcast up to max_broadcast_spans, by shuffle beyond. Other columns are not read.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    source = docs.select(col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("_text"))
    of = cut(merged_spans(repeated_spans(source, length)))
    if of.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0] <= max_broadcast_spans:
        of = F.broadcast(of)
    of = of.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "spans")
    joined = source.join(of, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left").select("doc_id", "_text", "spans")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])

    def run(batches):
        for whole in batches:
            for batch in S.text_slices(whole, 1, 4 << 20):
                rows = []
                for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    data, kept, removed, end = text.encode(), [], 0, 0
                    for s in found or ():
                        kept.append(data[end : s["first"]])
                        end = s["stop"]
                        removed += end - s["first"]
                    kept.append(data[end:])
                    rows.append((len(data), removed, len(found or ()), b"".join(kept)))
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, schema)
