"""Language-model scores of documents: word counts of the whole corpus and a recurrent model.

Words are counted over all training documents. The most frequent ones are the model's words; the
next ones are gathered in bins of about equal counts, each a word of the model whose probability is
shared out by their counts, and what is rarer still is its unknown word, shared out likewise. So the
model gives every text a probability. Documents are dealt to partitions by hash and sorted there, so
that results do not depend on how the table is laid out. Each partition trains a copy on its whole
documents and the copies are averaged by their tokens, in rounds that together use each training
document once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import gru
from corvane.llm import shingles as S
from corvane.llm.shared import col, cut

#: Words of the model (with end, unknown and bins), bins of counts, and words whose counts every worker holds.
VOCAB, BINS, FREQUENT = 1024, 30, 1 << 18
OWN = VOCAB - 2 - BINS
END, UNKNOWN = 0, 1
#: The end token's hash; word hashes are mixed, so it is as good as any.
END_HASH = np.int64(0x0E0D)
ROUNDS, RATE, BLOCKS, SALTS = 2, 0.02, 32, 64
#: Tokens of a partition, in a small corpus and in a large one.
PART_TOKENS, MOST_PART_TOKENS = 4_000_000, 16_000_000
_TOKENS = 8_000_000  # packed into lanes at once


def _hash_column(batch: pa.RecordBatch, column: int):
    data, ends = S.raw_texts(batch.column(column))
    words, first, last = S.word_hashes(data, ends)
    return words.view(np.int64), first, last


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): the count of each word, by hash, and of the end token, in all rows' _text."""

    def run(batches):
        held, n = [], 0
        ends = 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["h", "n"])

        for whole in batches:
            for batch in S.text_slices(whole, 0):
                words, _, _ = _hash_column(batch, 0)
                held.append(words)
                n, ends = n + len(words), ends + batch.num_rows
                if n > 4_000_000:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([int(END_HASH)]), pa.array([ends])], names=["h", "n"])

    return docs.select("_text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def _frequent(counts: DataFrame) -> DataFrame:
    """The words above a count that at most FREQUENT words reach, and the end token.

    The count is read off a histogram of the counts' logarithms, so no task or driver sorts words.
    """
    bin_ = F.floor(F.log2("c") * 16).cast("int").alias("bin")
    bins = counts.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()  # 16 a doubling
    least, held = None, 0
    for b in sorted(bins, key=lambda b: -b["bin"]):
        held += b["n"]
        if held > FREQUENT:
            break
        least = b["least"]
    enough = F.col("c") >= least if least is not None else F.lit(False)
    return counts.where(enough | (F.col("h") == int(END_HASH)))


def _numbers(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The model's word of each frequent word, by falling counts, and the unknown word at the end."""
    number = np.full(len(hashes) + 1, UNKNOWN, np.int16)
    number[:-1] = 2 + np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int16), BINS - 1)
    k = min(len(hashes), OWN)
    number[:k] = np.arange(2 + BINS, 2 + BINS + k)
    number[:-1][hashes == END_HASH] = END
    return number


class _Lookup:
    """Positions of hashes in a list; -1 where absent."""

    def __init__(self, hashes: np.ndarray):
        self.place = np.argsort(hashes)
        self.sorted = hashes[self.place]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.place[at], -1)


ENCODED = "doc_id long, held_out boolean, text_hash long, ids array<short>, n_tokens long, n_unknown long, n_known long, logs double, shares double, rare array<long>"


def _encode(docs: DataFrame, frequent) -> DataFrame:
    """Word numbers, sums over the frequent words and the hashes of the rare ones."""

    def run(batches):
        hashes, counts = frequent.value
        find = _Lookup(hashes)
        logs = np.log10(counts + 0.5)
        number = _numbers(hashes, counts)
        bin_totals = np.bincount(number[:-1], counts + 0.5, VOCAB)
        in_bin = (number[:-1] >= 2) & (number[:-1] < 2 + BINS)
        shares = np.append(np.where(in_bin, logs - np.log10(np.maximum(bin_totals[number[:-1]], 0.5)), 0), 0)
        logs = np.append(logs, 0)
        for whole in batches:
            for batch in S.text_slices(whole, 3):
                words, first, last = _hash_column(batch, 3)
                n = last - first
                ends = np.concatenate([[0], np.cumsum(n + 1)])
                h = np.full(ends[-1], END_HASH)
                h[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
                at = find(h)
                ids = number[at]
                ids[ends[1:] - 1] = END
                rare = at < 0
                total = lambda x: np.add.reduceat(x, ends[:-1])  # noqa: E731  every text has its end token
                rare_ends = np.concatenate([[0], np.cumsum(total(rare.astype(np.int64)))]).astype(np.int32)
                columns = [
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                    pa.array(n + 1),
                    pa.array(total((ids == UNKNOWN).astype(np.int64))),
                    pa.array(total((~rare).astype(np.int64))),
                    pa.array(total(np.where(rare, 0, logs[at]))),
                    pa.array(total(np.where(rare, 0, shares[at]))),
                    pa.ListArray.from_arrays(pa.array(rare_ends), pa.array(h[rare])),
                ]
                names = [x.split()[0] for x in ENCODED.split(", ")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=names)

    return docs.select("doc_id", "held_out", "text_hash", "_text").mapInArrow(run, ENCODED)


def _packs(batches, column: int):
    """Batches joined until they hold enough tokens for the lanes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(column).flatten())
        if n >= _TOKENS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _documents(lists: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for part in lists.chunks:
        values = part.flatten().to_numpy()
        ends = part.offsets.to_numpy() - part.offsets[0].as_py()
        out += [values[a:b].astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def train_round(encoded: DataFrame, flat: np.ndarray) -> np.ndarray:
    """Every partition goes on from flat with its documents; the token-weighted mean of all."""
    shared = encoded.sparkSession.sparkContext.broadcast(flat)

    def run(batches):
        mine, tokens = shared.value.copy(), 0
        step = gru.Adam(mine, RATE)
        for pack in _packs(batches, 0):
            docs = _documents(pack.column(0))
            gru.run_lanes(mine, VOCAB, docs, END, step)
            tokens += sum(map(len, docs))
        if tokens:
            step.flush()
            blocks = np.array_split(mine.astype(np.float64) * tokens, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS)), pa.array([tokens] * BLOCKS), pa.array([b.tolist() for b in blocks])], names=["block", "tokens", "sums"])

    def add(key, rows):
        order = np.argsort(rows.column("part").to_numpy())  # the same sum whichever task was first
        sums = np.stack(rows.column("sums").to_numpy())[order]
        return pa.table({"block": [key[0].as_py()], "tokens": [sum(rows.column("tokens").to_pylist())], "sums": [sums.sum(0).tolist()], "part": pa.array([rows.column("part").to_numpy().min()], pa.int32())})

    schema = "block long, tokens long, sums array<double>"
    parts = encoded.select("ids").mapInArrow(run, schema).withColumn("part", F.spark_partition_id())
    schema += ", part int"
    some = parts.withColumn("salt", F.pmod("part", F.lit(SALTS))).groupBy("block", "salt").applyInArrow(lambda key, t: add(key, t), schema)
    rows = some.groupBy("block").applyInArrow(lambda key, t: add(key, t), schema).collect()  # the model: BLOCKS rows
    if not rows:
        return flat
    return np.concatenate([np.array(r["sums"]) / r["tokens"] for r in sorted(rows, key=lambda r: r["block"])]).astype(np.float32)


def _model_scores(encoded: DataFrame, flat: np.ndarray) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(flat)
    names = [c for c in encoded.columns if c not in ("ids", "rare")]
    types = dict(x.split() for x in ENCODED.split(", "))

    def run(batches):
        model = shared.value
        for pack in _packs(batches, len(names)):
            score = gru.run_lanes(model, VOCAB, _documents(pack.column(len(names))), END)
            table = pa.table({**{c: pack.column(c) for c in names}, "model": score / gru.LN10})
            yield from table.to_batches()

    return encoded.select(*names, "ids").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names) + ", model double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document.

    Tokens are A-Z-lower-cased words and one end; null counts as the empty text, whose only token
    is the end. A document is held out, and not learned from, if the CRC-32 of its id as text
    leaves 1 when divided by 5 (a null id is not). base_score: log10 probability by counts with
    half a count added; score: by the model, whose state is carried through the whole document, in
    training too. Counts and the training cover all training documents; words are told apart by
    64-bit hashes. Repeated rows each get a row, a null id is one id; an empty table gives an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(col(text_col), F.lit(""))
    held = F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    source = docs.select(col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.xxhash64(text).alias("text_hash"), text.alias("_text"))
    counts = cut(word_counts(source.where("not held_out")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = sorted(_frequent(counts).collect(), key=lambda r: (-r["c"], r["h"]))  # bounded by FREQUENT
    hashes, c = np.array([r["h"] for r in top], np.int64), np.array([r["c"] for r in top], np.float64)
    parts = max(1, -(-total // MOST_PART_TOKENS), min(64, -(-total // PART_TOKENS)))
    dealt = _encode(source, spark.sparkContext.broadcast((hashes, c))).repartition(parts, F.xxhash64("text_hash", "doc_id"))
    encoded = cut(dealt.sortWithinPartitions("text_hash", "doc_id"))

    first = np.bincount(_numbers(hashes, c)[:-1], c, VOCAB)
    unknown, unknown_kinds = total - first.sum(), distinct - len(hashes)
    first[UNKNOWN] = unknown
    flat = gru.start(VOCAB, first)
    training = encoded.where("not held_out")
    for turn in range(ROUNDS):
        flat = train_round(training.where(F.pmod("text_hash", F.lit(ROUNDS)) == turn), flat)
    scored = _model_scores(encoded, flat)

    rare = encoded.select("doc_id", "text_hash", F.explode("rare").alias("h")).join(counts, "h", "left")
    rare = rare.groupBy("doc_id", "text_hash").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs"), F.count("c").alias("rare_known"))
    both = scored.unionByName(rare, allowMissingColumns=True)
    sums = both.groupBy("doc_id", "text_hash").agg(
        F.count("n_tokens").alias("copies"),
        *[F.max(x).alias(x) for x in ("held_out", "n_tokens", "n_unknown", "n_known", "logs", "shares", "model")],
        F.coalesce(F.sum("rare_logs"), F.lit(0.0)).alias("rare_logs"),
        F.coalesce(F.sum("rare_known"), F.lit(0)).alias("rare_known"),
    )
    per_copy = F.col("rare_logs") / F.col("copies")
    base = F.col("logs") + per_copy - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))
    model = F.col("model") + F.col("shares") + per_copy - F.col("n_unknown") * float(np.log10(unknown + 0.5 * (unknown_kinds + 1)))
    known = F.col("n_known") + (F.col("rare_known") / F.col("copies")).cast("long")
    out = sums.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score"), "copies")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_copy", "copies")
