"""Token counts by greedy longest match in linear time.

A vocabulary trie with failure links. A node's link goes to where matching goes on after the
longest pieces of the node's string are cut off, and its popped-token count says how many pieces
these are, so that a word is counted in one walk and no piece is ever built.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.llm.bpe import byte_letters, tokenizer_bytes
from corvane.llm.caching import Memo
from corvane.llm.shared import col, put_back, set_apart
from corvane.llm.wordsplit import chunks, words

CHUNK_CACHE = 400_000
_FINAL = 0x100


class LongestMatch:
    """Counts greedy pieces; a word that the pieces cannot spell counts as one unknown token."""

    def __init__(self, pieces):
        self.step: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                child = self.step[node].get(c)
                if child is None:
                    child = self.step[node][c] = len(self.step)
                    self.step.append({})
                    whole.append(False)
                node = child
            whole[node] = node > 0
        self.link, self.pops = [-1] * len(self.step), [0] * len(self.step)
        level = [0]
        while level:
            below = []
            for parent in level:
                for c, node in self.step[parent].items():
                    below.append(node)
                    if whole[node]:
                        self.link[node], self.pops[node] = 0, 1
                        continue
                    at, popped = self.link[parent], self.pops[parent]
                    while at >= 0 and c not in self.step[at]:
                        popped += self.pops[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.pops[node] = self.step[at][c], popped
            level = below

    def count(self, word: str) -> int:
        step, link, pops = self.step, self.link, self.pops
        node = total = 0
        for c in word:
            while c not in step[node]:
                total += pops[node]
                node = link[node]
                if node < 0:
                    return 1
            node = step[node][c]
        while node:
            total += pops[node]
            node = link[node]
            if node < 0:
                return 1
        return total


def word_end_pieces(definition: bytes) -> list[str]:
    """The vocabulary's pieces as byte strings whose word-final byte is marked."""
    model = json.loads(definition)["model"]
    end = model["end_of_word_suffix"]
    byte_of = {letter: i for i, letter in enumerate(byte_letters())}
    out = []
    for token in model["vocab"]:
        body = token.removesuffix(end)
        codes = [byte_of[c] for c in body]
        if body != token:
            codes[-1] += _FINAL
        out.append("".join(map(chr, codes)))
    return out


def _spelling(word: str) -> str:
    data = word.encode("utf-8", "surrogatepass").decode("latin-1")
    return data[:-1] + chr(ord(data[-1]) + _FINAL)


def token_counts(docs: DataFrame, tokenizer: bytes | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Count words and greedy word pieces of each whole text: adds n_words and n_tokens (long).

    A null or empty text has none. keep as in bpe_encode; input columns named n_words or n_tokens
    are replaced, others may have any names. Rows are independent: no shuffle, repeated rows stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(tokenizer if tokenizer is not None else tokenizer_bytes())
    new = ("n_words", "n_tokens")
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in new and (keep is not None or c != text_col)]
    source = docs.select(*set_apart(kept), col(text_col).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in new]])

    def run(batches):
        matcher = LongestMatch(word_end_pieces(model.value))

        def counted(chunk):
            parts = words(chunk)
            return len(parts), sum([matcher.count(_spelling(w)) for w in parts])

        memo = Memo(counted, CHUNK_CACHE)

        for batch in batches:
            n_words, n_tokens = [], []
            for i in range(batch.num_rows):
                text = batch.column(batch.num_columns - 1)[i].as_py() or ""
                got = [memo[c] for c in chunks(text)]
                n_words.append(sum([x[0] for x in got]))
                n_tokens.append(sum([x[1] for x in got]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*batch.schema.names[:-1], *new])

    return source.mapInArrow(run, schema).select(*put_back(kept), *new)
