"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary has a white-space marker after another character, so no merge crosses a
marked word's begin: words are encoded apart. Documents are read in blocks of bounded text. Each block
sends its distinct marked words, by hash, to the task that segments each distinct word once, and gets
their ids back; the documents, as places in their block's list of words, take the ids by position.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.caching import Memo
from corvane.llm.shared import col, put_back, set_apart

#: Characters of text after which a block is closed, and of a long text that are split at a time.
BLOCK_CHARS, SLICE_CHARS = 16_000_000, 1_000_000
#: Words of a task's table; a fuller one forgets the least recent ones, which are segmented again.
TABLE_WORDS = 2_000_000
#: Longest word whose pairs are simply searched; longer ones go through a queue.
SHORT_WORD = 24
#: Fixed values of the model format: the marker, kinds of pieces, the surface of an unknown piece.
MARKER, NORMAL, UNKNOWN, CONTROL, BYTE, UNKNOWN_TEXT = "▁", 1, 2, 3, 6, " ⁇ "
_NEVER = (float("inf"), -1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


class PieceBpe:
    """A byte-fallback BPE model without normalisation whose pieces do not cross markers."""

    def __init__(self, model: bytes):
        self.names: list[str] = []
        scores, self.kinds = [], []
        flags = {3: 1, 4: 1, 5: 1, 2: b""}  # of the normaliser: dummy prefix, extra white space removed, escaped; its table
        kind_of_model = 1
        for number, value in _fields(model):
            if number == 1:
                piece = {1: b"", 2: bytes(4), 3: NORMAL} | dict(_fields(value))
                self.names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                flags |= dict(_fields(value))
        plain = [n.replace(MARKER, " ") for n in self.names]
        crossing = [p for p, k in zip(plain, self.kinds, strict=True) if k == NORMAL and " " in p.lstrip(" ")]
        if kind_of_model != 2 or flags[2] or not flags[3] or flags[4] or crossing or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the table of distinct chunks needs a BPE model without normalisation whose pieces begin with the markers they have")
        self.ranked = {p: (-s, i) for i, (p, s, k) in enumerate(zip(plain, scores, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == BYTE}
        self.begin, self.end = self.names.index("<s>"), self.names.index("</s>")
        surface = {NORMAL: lambda i: plain[i].encode(), UNKNOWN: lambda i: UNKNOWN_TEXT.encode(), CONTROL: lambda i: b"", BYTE: lambda i: bytes([int(self.names[i][3:5], 16)])}
        self.surface = [surface[k](i) for i, k in enumerate(self.kinds)]
        # A line end that is in no piece is a border as well.
        lines = all("\n" not in p for p in self.ranked)
        self.words = re.compile(r" +[^ \n]*|\n+[^ \n]*" if lines else r" +[^ ]*").findall

    def split(self, text: str) -> Iterator[list[str]]:
        """Lists of the marked words of a text (a blank stands for the marker)."""
        if text:
            text = " " + text.replace(MARKER, " ")
        at = 0
        while at < len(text):
            cut = text.find(" ", at + SLICE_CHARS)
            while 0 < cut < len(text) and text[cut - 1] == " ":
                cut = text.find(" ", cut + 1)
            cut = len(text) if cut < 0 else cut
            yield self.words(text, at, cut)
            at = cut

    def encode_word(self, word: str) -> list[int]:
        """Ids of a marked word: the best-scored pair is joined first, the left one of equals."""
        parts = list(word)
        parts = self._search(parts) if len(parts) <= SHORT_WORD else self._queue(parts)
        ids = []
        for p in parts:
            found = self.ranked.get(p)
            ids += [self.bytes[b] for b in p.encode()] if found is None else [found[1]]
        return ids

    def _search(self, parts: list[str]) -> list[str]:
        get = self.ranked.get
        turns = [get(a + b, _NEVER)[0] for a, b in zip(parts, parts[1:])]
        while turns:
            best = min(turns)
            if best == _NEVER[0]:
                break
            i = turns.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del turns[i]
            if i:
                turns[i - 1] = get(parts[i - 1] + parts[i], _NEVER)[0]
            if i < len(turns):
                turns[i] = get(parts[i] + parts[i + 1], _NEVER)[0]
        return parts

    def _queue(self, parts: list[str]) -> list[str]:
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = []

        def offer(i):
            j = right[i]
            if i >= 0 and j < n:
                found = self.ranked.get(parts[i] + parts[j])
                if found is not None:
                    heapq.heappush(waiting, (found[0], i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = right[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in parts if p]

    def decode(self, ids) -> str:
        """The text of ids: control pieces vanish, the first marker of the text goes, bytes that are no character are U+FFFD each."""
        ids = list(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "corvane-each")
        return text[1:] if first is not None and self.kinds[first] == NORMAL and text.startswith(" ") else text


def _each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


def _loaded(model: bytes) -> PieceBpe:
    import codecs

    codecs.register_error("corvane-each", _each)
    return PieceBpe(model)


def _pack(numbers) -> bytes:
    planes = np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Block:
    """The distinct words of the documents of a block, each named by its place."""

    def __init__(self, bpe: PieceBpe):
        self.bpe, self.number, self.chars = bpe, TaskContext.get().partitionId() << 32, 0
        self.index: dict[str, int] = {}

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS

    def next(self) -> None:
        self.number, self.chars, self.index = self.number + 1, 0, {}

    def add(self, text: str) -> array:
        """The places of the text's words."""
        self.chars += len(text)
        index, out = self.index, array("I")
        for words in self.bpe.split(text):
            out.extend([index.setdefault(w, len(index)) for w in words])
        return out


def _words_of(model, n_buckets: int):
    """Rows (block, bucket, places, sizes, words) of each block's distinct words."""

    def rows(block: _Block) -> pa.RecordBatch:
        raw = [w.encode() for w in block.index]
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in raw), np.int64, len(raw))
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        out = []
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            places = order[start:end]
            out.append((block.number, int(bucket[places[0]]), _pack(np.diff(places, prepend=0)), _pack([len(raw[i]) for i in places]), zstandard.compress(b"".join([raw[i] for i in places]), 3)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "bucket", "places", "sizes", "words"])

    def run(batches):
        block = _Block(_loaded(model.value))
        for batch in batches:
            for text in batch.column(0):
                if block.full():
                    yield rows(block)
                    block.next()
                block.add(text.as_py() or "")
        if block.index:
            yield rows(block)

    return run


def _places_of(model):
    """Each document's row with its block, the places of its words and a checksum of its text."""

    def run(batches):
        block = _Block(_loaded(model.value))
        for batch in batches:
            made = []
            for value in batch.column("_text"):
                text = value.as_py() or ""
                if block.full():
                    block.next()
                made.append((block.number, _pack(block.add(text)), zlib.crc32(text.replace(MARKER, " ").encode())))
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "block", "places", "crc"])

    return run


def _segment(model):
    """(block, places, sizes, ids) for rows of words; each distinct word of the task is segmented once."""

    def run(batches):
        table = Memo(_loaded(model.value).encode_word, TABLE_WORDS)
        for batch in batches:
            sizes, ids = [], []
            for n, words in zip(batch.column("sizes").to_pylist(), batch.column("words").to_pylist(), strict=True):
                ends = np.cumsum(_unpack(n)).tolist()
                text = zstandard.decompress(words)
                found = [table[text[a:b].decode()] for a, b in zip([0, *ends], ends)]
                sizes.append(_pack([len(f) for f in found]))
                ids.append(_pack([i for f in found for i in f]))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("places"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["block", "places", "sizes", "ids"])

    return run


def _assemble(model, names: list[str], holder: list):
    """ids and decoded text of a block's documents from the ids of its words."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not holder:
            holder.append(_loaded(model.value))
        bpe = holder[0]
        rows = [[_unpack(x) for x in r] for r in zip(*[words.column(c).to_pylist() for c in ("places", "sizes", "ids")], strict=True)]
        places = np.concatenate([np.cumsum(r[0]) for r in rows]) if rows else np.zeros(0, np.int64)
        sizes = np.concatenate([r[1] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        flat = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.uint32)
        count, start = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        count[places], start[places] = sizes, np.cumsum(sizes) - sizes
        ids, texts = [], []
        for packed, crc in zip(docs.column("places").to_pylist(), docs.column("crc").to_pylist(), strict=True):
            at = _unpack(packed).astype(np.int64)
            n = count[at]
            total = int(n.sum())
            inner = flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(total)]
            found = np.concatenate([[bpe.begin], inner, [bpe.end]]).astype("<u4")
            ids.append(found.tobytes())
            texts.append(bpe.decode(found.tolist()))
            if zlib.crc32(texts[-1].encode()) != crc:
                raise ValueError("the documents came in another order when they were read again; store them first")
        kept = [docs.column(c) for c in names]
        return pa.Table.from_arrays([*kept, pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=[*names, "ids", "decoded"])

    return run


def piece_model(path: str | None = None) -> bytes:
    """The model file; by default the public one that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


def piece_encode(docs: DataFrame, model: bytes | None = None, text_col: str = "text", keep: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Encode and decode each whole text: adds ids (little-endian unsigned 32-bit, with begin and end
    ids) and decoded, the text of these ids.

    keep: the columns to carry along (by default all but the text); input columns named ids or decoded
    are replaced, others may have any names. A null text counts as empty and has the begin and end ids
    only. Repeated rows stay; an empty table gives no row. A text of any length is split in slices.

    docs are read twice and must come in the same order both times, as stored tables do; the decoded
    texts are compared with the texts by checksum and a difference is an error. buckets: the tasks over
    which the words are dealt (by default the session's shuffle partitions), each with a table of
    bounded size. What is shuffled is compressed, about the size of the compressed input.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model if model is not None else piece_model())
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("ids", "decoded") and (keep is not None or c != text_col)]
    source = docs.select(*set_apart(kept), col(text_col).alias("_text"))
    fields = source.schema.fields[:-1]
    words = source.select("_text").mapInArrow(_words_of(shared, n), "block long, bucket int, places binary, sizes binary, words binary")
    answers = words.repartition(n, "bucket").mapInArrow(_segment(shared), "block long, places binary, sizes binary, ids binary")
    placed = source.mapInArrow(_places_of(shared), T.StructType([*fields, *[T.StructField(c, t) for c, t in (("block", T.LongType()), ("places", T.BinaryType()), ("crc", T.LongType()))]]))
    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    made = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_assemble(shared, [f.name for f in fields], []), schema)
    return made.select(*put_back(kept), "ids", "decoded")


def piece_decode(coded: DataFrame, model: bytes | None = None, ids_col: str = "ids") -> DataFrame:
    """Replace or add decoded: the text of packed ids (null ids: empty text)."""
    shared = coded.sparkSession.sparkContext.broadcast(model if model is not None else piece_model())
    kept = [c for c in coded.columns if c.lower() != "decoded"]
    source = coded.select(*set_apart(kept), col(ids_col).alias("_ids"))

    def run(batches):
        bpe = _loaded(shared.value)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "decoded"])

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("decoded", T.StringType())])
    return source.mapInArrow(run, schema).select(*put_back(kept), "decoded")


def token_total(ids: str) -> Column:
    """How many ids a packed column holds."""
    return (F.octet_length(ids) / 4).cast("long")
