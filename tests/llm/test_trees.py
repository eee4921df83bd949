"""Merkle manifests, prefix tries and SentencePiece ids against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import digests, merkle, prefix_trie, ranks, sentence_pieces

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, digest string, m string, part int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def merkle_want(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r, leaf(r[:5])))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for n in names:
        trees[n].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        made[n] = levels([x[1] for x in trees[n]])
    top = levels([made[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, (r, own) in enumerate(trees[n]):
            path = []
            for tree, j in ((made[n], i), (top, k)):
                for nodes in tree[:-1]:
                    a = j - j % 3
                    path.append(("".join(nodes[a:j]), "".join(nodes[j + 1 : a + 3])))
                    j //= 3
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            x = leaf((*r[:4], text))
            for a, b in path:
                x = sha(a, x, b)
            out.append((r[0], own, made[n][-1][0], top[-1][0], sha(*[a + b for a, b in path]), x, x == top[-1][0]))
    return Counter(out)


def merkle_rows(n, seed=2):
    rng = random.Random(seed)
    source = lambda: rng.choice(["hot"] * 6 + ["", "é", "z", "Z", None])
    text = lambda: rng.choice([None, "", "a\nb", "\n", "ünd\nx", "plain", "w" * 500])
    rows = [(i, source(), rng.choice(["en", None]), rng.choice([3, None]), text(), "t", 1, "d", "m", 2) for i in range(n)]
    return rows + [rows[3], rows[3], (None, "hot", None, None, None, "t", 1, "d", "m", 2), (4, "hot", "xx", 1, "other\n", "t", 1, "d", "m", 2), (9, "alone", "en", 1, "x\n", "t", 1, "d", "m", 2)]


@pytest.mark.parametrize("n", [0, 20, 300])
def test_merkle(spark, n):
    rows = merkle_rows(n) if n else [(7, None, "en", 1, "one\n", "t", 1, "d", "m", 2)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert Counter(map(tuple, digests.merkle_digests(docs).collect())) == merkle_want(rows)


def test_merkle_of_nothing_and_levels(spark):
    assert digests.merkle_digests(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame(merkle_rows(300), DOCS)
    leaves = docs.select(F.lit("one").alias("tree"), F.col("doc_id").alias("row_order"), merkle.leaf_digest([F.col("doc_id")]).alias("digest"))
    manifest = merkle._grow(leaves, ["row_order", "digest"])
    assert [df.agg(F.sum(F.size("members"))).first()[0] for df in manifest.levels] == [305, 12]  # levels 1, 2, 4 and 5 are not kept
    assert manifest.levels[0].agg(F.max(F.size("members"))).first()[0] == merkle.BLOCK


def test_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([None, *range(50)])) for _ in range(500)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, v long").repartition(7), ["g"], ["v"]).collect()
    for g in {"a", "b", None}:
        mine = sorted((r["pos"], r["v"]) for r in got if r["g"] == g and r["v"] is not None)
        values = [r[1] for r in rows if r[0] == g]
        assert sorted(r["pos"] for r in got if r["g"] == g) == list(range(len(values))) and {r["total"] for r in got if r["g"] == g} == {len(values)}
        assert [v for _, v in mine] == sorted(v for v in values if v is not None)
        assert {r["pos"] for r in got if r["g"] == g and r["v"] is None} == set(range(values.count(None)))


TURNS = "conv_id long, turn long, role string, text string, node string, comp string, depth int, parent string"


def trie_want(rows):
    convs = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    made = {}
    for c in convs:
        convs[c].sort()
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = [x[2:] for x in convs.get(c - c % 100, [])[:h]] + [x[2:] for x in convs[c][h:]]
    nodes, below = defaultdict(list), defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    for k in nodes:
        if k:
            below[k[:-1]].append(k)
    out = {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves = sum(out[x][5] for x in below[k]) if below[k] else 1
        saved = sum(out[x][6] for x in below[k]) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[k] if len(made[c]) == len(k))))
        out[k] = (min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below[k]), leaves, saved, sha(ends))
    return Counter(out.values())


def trie_rows():
    rng = random.Random(6)
    rows = []
    for c in [*range(100, 140), *range(1000, 1010), 205, 777]:
        for t in range(rng.choice([1, 2, 4, 7, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "nö 🙂", "", None]), "n", "c", 1, "p"))
    rows += [(101, None, "user", "before all"), (102, 1, "user", "same turn again"), (None, 1, "user", "no conversation")]
    rows += [(150, t, "user", f"long {t}") for t in range(60)] + [(151, t, "user", f"long {t}") for t in range(40)]
    rows.append(rows[5])
    return [(*r, "n", "c", 1, "p")[:8] for r in rows]


@pytest.mark.parametrize("task_nodes", [5000, 20])
def test_prefix_trie(spark, monkeypatch, task_nodes):
    rows = trie_rows()
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    found = prefix_trie.prefix_trie(turns, task_nodes=task_nodes).withColumn("ends", F.coalesce("ends", F.sha2(F.lit(""), 256)))
    assert Counter(map(tuple, found.collect())) == trie_want(rows)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert digests.trie_digests(spark.createDataFrame([(None, 1, "a", "b", "n", "c", 1, "p")], TURNS)).count() == 0


def test_totals_by_centroids():
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 400):
        for shape in (lambda i: i - 1, lambda i: 0, lambda i: rng.randrange(i)):
            parents = [-1] + [shape(i) for i in range(1, n)]
            order = sorted(range(n), key=lambda i: i)
            own = [[rng.randint(0, 9), i] for i in order]
            want = [list(x) for x in own]
            for v in reversed(range(1, n)):
                want[parents[v]] = [a + b for a, b in zip(want[parents[v]], want[v], strict=True)]
            assert prefix_trie.settle(parents, own) == want


@pytest.fixture(scope="module")
def pieces():
    library = pytest.importorskip("sentencepiece")
    return library.SentencePieceProcessor(model_proto=sentence_pieces.piece_model())


def test_pieces_of_words_and_ids(pieces):
    own = sentence_pieces._loaded(sentence_pieces.piece_model())
    rng = random.Random(3)
    for _ in range(2500):
        text = "".join(rng.choice("aeinst thor de\n\n  é1▁2,.'́日本\t\x00🙂") for _ in range(rng.choice([0, 3, 10, 60]))) + rng.choice(["", "   ", " <s> ", "the quick"])
        ids = [own.begin, *[i for words in own.split(text) for w in words for i in own.encode_word(w)], own.end]
        assert ids == pieces.encode(text, add_bos=True, add_eos=True), text
        some = [rng.randrange(32000) if rng.random() < 0.4 else rng.randrange(262) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == pieces.decode(ids) and own.decode(some) == pieces.decode(some), some
    with pytest.raises(ValueError, match="BPE"):
        sentence_pieces.PieceBpe(b"\x12\x02\x18\x01")


@pytest.mark.parametrize("block", [None, 700])
def test_piece_encode(spark, pieces, monkeypatch, block):
    if block:
        monkeypatch.setattr(sentence_pieces, "BLOCK_CHARS", block)
        monkeypatch.setattr(sentence_pieces, "SLICE_CHARS", 40)
        monkeypatch.setattr(sentence_pieces, "TABLE_WORDS", 30)
    rng = random.Random(9)
    pool = ["the", "été", "Wörter", "1234", "x" * 90, "日本語", "<s>", "▁", "a\n\nb", "", "  "]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 200))) for _ in range(40)]
    texts += [None, "", " ", "\n", "▁", texts[3], "ab" * 20000, " " * 500 + "x" + " " * 33]
    rows = [(i, t, "i", "d", 4, "k") for i, t in enumerate(texts)] + [(5, texts[5], "i", "d", 4, "k"), (None, texts[6], "i", "d", 4, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string, block int, places string").repartition(3).cache()

    def want(i, t):
        ids = pieces.encode(t or "", add_bos=True, add_eos=True)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(pieces.decode(ids))

    assert Counter(map(tuple, digests.piece_digests(docs).collect())) == Counter(want(r[0], r[1]) for r in rows)
    coded = sentence_pieces.piece_encode(docs)
    assert coded.columns == ["doc_id", "block", "places", "ids", "decoded"]
    again = sentence_pieces.piece_decode(coded.withColumn("was", F.col("decoded")))
    assert again.where("decoded <> was").count() == 0 and again.count() == len(rows)
    assert sentence_pieces.piece_encode(docs.limit(0)).count() == 0
    assert [r["decoded"] for r in sentence_pieces.piece_decode(spark.createDataFrame([(None,)], "ids binary")).collect()] == [""]
