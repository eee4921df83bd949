"""The pipeline's stages over awkward tables, and links that a bridge alone holds together."""

import random
from collections import Counter

from corvane.llm import near_dedup

ODD = "doc_id long, text string, lang string, source string, n_chars long, _id long, _hash string, _k0 int, text_hash long, drop_id long, kept boolean, component string"


def test_near_dedup_keeps_bridges(spark):
    """Five texts in two groups that one pair at 87 of 113 shingles joins."""
    rng, rows = random.Random(1), []
    for g in range(1000):
        base = [f"g{g}w{i}" for i in range(104)]
        other = base[:91] + [f"g{g}x{i}" for i in range(13)]
        head = lambda w, tag: [f"g{g}{tag}{i}" for i in range(3)] + w[3:]  # noqa: E731, B023
        rows += [(5 * g + k, " ".join(w)) for k, w in enumerate((base, head(base, "a"), head(base, "b"), other, head(other, "c")))]
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert [r["doc_id"] for r in got if r["component_id"] != r["doc_id"] // 5 * 5] == []


def near_copies(n, words, changed, seed):
    """Copies of one text, of which every one has up to this many words changed."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = [f"w{k}" for k in range(words)]
        for k in rng.sample(range(words), rng.randint(0, changed)):
            w[k] = f"c{i}x{k}"
        rows.append((i, " ".join(w)))
    return rows


def components_of(rows):
    """The lowest id of each text's component, from all pairs."""
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    least = list(range(len(rows)))

    def find(a):
        while least[a] != a:
            a = least[a]
        return a

    for a, one in enumerate(sets):
        for b in range(a):
            common = len(one & sets[b])
            if 100 * common >= 75 * (len(one) + len(sets[b]) - common):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(rows))}


def test_near_dedup_of_a_large_group_has_a_row_for_each_band(spark, monkeypatch):
    """Buckets and blocks of a group of near copies have few rows for each text, not one for each of 400 tables."""
    made, groups = [], near_copies(500, 140, 14, 3)
    blocks, buckets = near_dedup._blocks, near_dedup.buckets
    monkeypatch.setattr(near_dedup, "_blocks", lambda *a: made.append(blocks(*a)) or made[-1])
    monkeypatch.setattr(near_dedup, "buckets", lambda *a: made.append(buckets(*a)) or made[-1])
    got = near_dedup.near_duplicates(spark.createDataFrame(groups, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components_of(groups)
    counts = [df.count() for df in made]
    assert len(counts) == 3 and 1000 < counts[0] and max(counts) <= near_dedup.BANDS * len(groups)


def test_near_dedup_with_divided_buckets(spark, monkeypatch):
    """Whole buckets, buckets that the second bands divide, and blocks of them give what all pairs give."""
    rows = near_copies(240, 140, 14, 4)
    rows += [(240 + i, t.replace("w", "v")) for i, t in near_copies(160, 90, 5, 5)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), components_of(rows)
    for whole, block in ((60, 25), (4096, 25)):
        monkeypatch.setattr(near_dedup, "WHOLE_ROWS", whole)
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
        got = near_dedup.near_duplicates(docs).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want, (whole, block)


def odd_rows():
    rng = random.Random(8)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    a, b, leak = prose(), prose(), prose()
    texts = [(1, a), (2, a + " tail"), (3, b), (4, leak + " " + prose()), (5, prose() + " password=abcdefgh12345678"), (None, prose()), (6, None), (7, ""), (8, "few words")]
    rows = [(i, t, "en", "s", len(t or ""), 100 + k, "h", k, 7, 3, False, "c") for k, (i, t) in enumerate(texts)]
    return leak, [*rows, (3, b, "de", "s", len(b), 99, "h", 1, 7, 3, True, "c")]


def test_stages_with_columns_of_any_names(spark, tmp_path):
    import corpus_pipeline

    leak, rows = odd_rows()
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, ODD)
    stages = dict(corpus_pipeline.STAGES)
    left = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert all(df.columns == docs.columns for df in left.values())
    text = {name: Counter((r["doc_id"], r["_id"]) for r in df.collect()) for name, df in left.items()}
    every = Counter((r[0], r[5]) for r in rows)
    assert text["quality rules"] == every - Counter([(6, 106), (7, 107), (8, 108)])
    assert text["near-dedup"] == every - Counter([(2, 101), (3, 102)])  # of the two with id 3 the one whose columns come first
    assert text["decontamination"] == every - Counter([(4, 103)])
    assert text["secret scan"] == every
    marked = {r["_id"]: r for r in left["secret scan"].collect()}
    assert marked[104]["text"].endswith(" [SECRET]") and marked[104]["n_chars"] == len(marked[104]["text"]) and marked[106]["text"] is None
    assert stages["bpe encoding"](spark, docs, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
