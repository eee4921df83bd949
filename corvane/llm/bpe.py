"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one vocabulary token can be the last one of the prefix's
encoding. An automaton over the vocabulary gives the tokens that end at each position; the one
whose predecessor (the last token of the remaining prefix) is compatible with it is stored, and
following these back-pointers from the word's end gives the exact ids in linear time, however
long the word is.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.llm.caching import Memo
from corvane.llm.shared import col, put_back, set_apart
from corvane.llm.wordsplit import chunks, words

#: Bounds of a worker's caches, in entries.
CHUNK_CACHE, WORD_CACHE, PAIR_CACHE = 400_000, 200_000, 500_000
_NEVER = 1 << 60
_FINAL = 0x100  # added to a word's last byte


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A byte-level vocabulary whose words end in a marked symbol."""

    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        model = spec["model"]
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        spelled: dict[int, str] = {}
        for byte, letter in enumerate(byte_letters()):
            spelled[vocab[letter]] = chr(byte)
            spelled[vocab[letter + end]] = chr(byte + _FINAL)
        self.rank: dict[tuple[int, int], int] = {}
        born = dict.fromkeys(spelled, -1)
        halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            token, a, b = vocab[left + right], vocab[left], vocab[right]
            self.rank[a, b] = rank
            spelled[token], born[token], halves[token] = spelled[a] + spelled[b], rank, (a, b)
        # The parts of a token at its border, each with the rank of the merge that uses it up.
        self.right_edge = {t: self._edge(t, 1, halves, born) for t in spelled}
        self.left_edge = {t: self._edge(t, 0, halves, born) for t in spelled}
        self._automaton(spelled)
        self.compatible: list[dict[int, bool]] = [{} for _ in range(max(spelled) + 1)]
        self.n_pairs = 0
        self.word = Memo(self.encode_word, WORD_CACHE)
        self.chunk = Memo(self._chunk, CHUNK_CACHE)

    @staticmethod
    def _edge(token, side, halves, born):
        parts, used = [(token, _NEVER)], token
        while used in halves:
            parts.append((halves[used][side], born[used]))
            used = halves[used][side]
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the border between two tokens survives all merges.

        A merge across it happens when both of its parts stand there at its turn: before the
        left part is used up, and not after the right part is (of equal merges the left is first).
        """
        rank, rights, known = self.rank, self.left_edge[b], True
        for left, left_end in self.right_edge[a]:
            for right, right_end in rights:
                turn = rank.get((left, right))
                if turn is not None and turn < left_end and turn <= right_end:
                    known = False
        self.n_pairs += 1
        if self.n_pairs > PAIR_CACHE:
            for row in self.compatible:
                row.clear()
            self.n_pairs = 1
        self.compatible[a][b] = known
        return known

    def _automaton(self, spelled: dict[int, str]) -> None:
        """States for all vocabulary prefixes; ends: the tokens that end there, longest first."""
        self.step: list[dict[str, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for token, symbols in spelled.items():
            node = 0
            for c in symbols:
                child = self.step[node].get(c)
                if child is None:
                    child = self.step[node][c] = len(self.step)
                    self.step.append({})
                    own.append(None)
                node = child
            own[node] = (token, len(symbols))
        self.link = [0] * len(self.step)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.step)
        level = list(self.step[0].values())
        for node in level:
            self.ends[node] = (own[node],) if own[node] else ()
        while level:
            below = []
            for parent in level:
                for c, node in self.step[parent].items():
                    at = self.link[parent]
                    while at and c not in self.step[at]:
                        at = self.link[at]
                    self.link[node] = at = self.step[at].get(c, 0)
                    self.ends[node] = ((own[node],) if own[node] else ()) + self.ends[at]
                    below.append(node)
            level = below
        self.spare = PAIR_CACHE  # transitions that may still be remembered

    def _jump(self, node: int, c: str) -> int:
        at = node
        while at and c not in self.step[at]:
            at = self.link[at]
        found = self.step[at].get(c, 0)
        if self.spare:
            self.spare -= 1
            self.step[node][c] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word."""
        data = word.encode("utf-8", "surrogatepass").decode("latin-1")
        symbols = data[:-1] + chr(ord(data[-1]) + _FINAL)
        step, ends, compatible = self.step, self.ends, self.compatible
        last, back, state, step_from, at = [], [], 0, 0, -1
        for c in symbols:
            at += 1
            state = step[state].get(c)
            if state is None:
                state = self._jump(step_from, c)
            step_from = state
            for token, length in ends[state]:
                if length > at:
                    break
                known = compatible[last[at - length]].get(token)
                if known is None:
                    known = self._compatible(last[at - length], token)
                if known:
                    break
            last.append(token)
            back.append(length)
        ids = []
        while at >= 0:
            ids.append(last[at])
            at -= back[at]
        ids.reverse()
        return ids

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        ids = [i for w in words(chunk) for i in self.word[w]]
        return array("i", ids).tobytes(), " ".join([self.names[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids (as int32 bytes) and decoded text of a whole text."""
        found = []
        for is_special, part in self._segments(text):
            if is_special:
                found.append((array("i", [self.special[part]]).tobytes(), part))
            else:
                found += map(self.chunk.__getitem__, chunks(part))
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[1]])

    def _segments(self, text: str) -> list[tuple[bool, str]]:
        """The text's stretches, cut at the strings of special tokens."""
        if not any(s in text for s in self.special):
            return [(False, text)]
        parts = self.cut.split(text)
        return [(i % 2 == 1, part) for i, part in enumerate(parts)]

    def decode(self, ids) -> str:
        """Token strings joined by blanks: the vocabulary declares no decoder."""
        return " ".join([self.names[int(i)] for i in ids])


def _rows(batch: pa.RecordBatch, most_chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded sum of text, so that results stay small as well."""
    lengths = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most_chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield batch.slice(start)


def tokenizer_bytes(path: str | None = None) -> bytes:
    """The vocabulary file; by default the public word-end vocabulary that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as file:
        return file.read()


def bpe_encode(docs: DataFrame, tokenizer: bytes | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode and decode the whole text of each row: adds ids array<int> and decoded string.

    keep: the columns to carry along (by default all but the text). A null text counts as empty
    and gives no ids and an empty decoded text. Input columns named ids or decoded are replaced;
    others may have any names.
    Rows are independent: no shuffle, repeated rows stay, an empty table gives an empty result.
    The vocabulary (about 2 MB, whatever the data's size) is broadcast.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(tokenizer if tokenizer is not None else tokenizer_bytes())
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("ids", "decoded") and (keep is not None or c != text_col)]
    source = docs.select(*set_apart(kept), col(text_col).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = WordBpe(model.value)
        for whole in batches:
            for batch in _rows(whole):
                coded = [bpe.encode(t or "") for t in batch.column("_text").to_pylist()]
                flat = np.frombuffer(b"".join([x[0] for x in coded]), np.int32)
                ends = np.cumsum([0] + [len(x[0]) // 4 for x in coded]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, pa.array([x[1] for x in coded], pa.string())], names=[*batch.schema.names[:-1], "ids", "decoded"])

    return source.mapInArrow(run, schema).select(*put_back(kept), "ids", "decoded")


def bpe_decode(coded: DataFrame, tokenizer: bytes | None = None, ids_col: str = "ids") -> DataFrame:
    """Replace or add decoded: the text of an id array (null ids: empty text)."""
    model = coded.sparkSession.sparkContext.broadcast(tokenizer if tokenizer is not None else tokenizer_bytes())
    kept = [c for c in coded.columns if c.lower() != "decoded"]
    source = coded.select(*[col(c) for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = WordBpe(model.value)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return source.mapInArrow(run, schema)
