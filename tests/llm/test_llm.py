"""The training-text operators against brute force, with nulls, repeats, ties and empty tables."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, decontaminate, digests, gru, lm_score, near_dedup, quality, secrets, sharding, substring_dedup, url_filter, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, ids string, shard string"


def text_of(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, empties, nulls, long and repeated rows; extra columns with clashing names."""
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)] + ["The", "été", "Ünd,", "x.y"]
    texts = [text_of(rng, rng.randint(1, 300), pool) for _ in range(60)]
    texts += [texts[3], texts[3], texts[4] + " tail", texts[5] + "\n" + text_of(rng, 9, pool), None, "", " \n ", "one", "two words"]
    texts += [text_of(rng, 4000, pool), "line a b c\n" * 90, "a" * 900, texts[7][:40] + texts[8]]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [out[7], out[7], (None, texts[9])]
    return [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), "h", "x", "y") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))

    def want(i, x):
        e = t.encode(x or "", add_special_tokens=False)
        return i, len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(map(tuple, digests.bpe_digests(docs).collect())) == Counter(want(r[0], r[1]) for r in rows)
    assert digests.bpe_digests(empty).count() == 0
    again = bpe.bpe_decode(bpe.bpe_encode(docs)).where("decoded <> ''").count()
    assert again == sum(bool((r[1] or "").strip()) for r in rows)
    coder = bpe.WordBpe(bpe.tokenizer_bytes())
    rng = random.Random(1)
    for _ in range(3000):
        x = "".join(rng.choice("aeinst' éΣ1.,́<|endoftext|>\x1c\n") for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", "'s don't"])
        e = t.encode(x, add_special_tokens=False)
        ids, decoded = coder.encode(x)
        assert memoryview(ids).cast("i").tolist() == e.ids and decoded == t.decode(e.ids, skip_special_tokens=False), x


def test_token_counts(docs, rows, empty):
    pieces = wordpiece.word_end_pieces(bpe.tokenizer_bytes())
    have, longest = set(pieces), max(map(len, pieces))

    def greedy(word):
        n = at = 0
        while at < len(word):
            size = next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in have)
            n, at = n + 1, at + size
        return n

    matcher = wordpiece.LongestMatch(pieces)
    words = {wordpiece._spelling(w) for r in rows for c in wordpiece.chunks(r[1] or "") for w in wordpiece.words(c)}
    assert all(matcher.count(w) == greedy(w) for w in words)
    want = Counter((r[0], sum(len(wordpiece.words(c)) for c in wordpiece.chunks(r[1] or "")), sum(greedy(wordpiece._spelling(w)) for c in wordpiece.chunks(r[1] or "") for w in wordpiece.words(c))) for r in rows)
    assert Counter(map(tuple, wordpiece.token_counts(docs, keep=["doc_id"]).collect())) == want
    found = wordpiece.token_counts(docs)
    assert found.count() == len(rows) and "text" not in found.columns
    assert found.where("n_tokens < n_words").count() == 0 and wordpiece.token_counts(empty).count() == 0
    small = wordpiece.LongestMatch(["a", "ab", "bc", "bcd", "c"])
    assert [small.count(w) for w in ("abc", "abcd", "bcd", "cab", "ax")] == [2, 1, 1, 2, 1]


def test_decontamination(spark, docs, rows, empty):
    items = [(1, rows[3][1]), (2, " ".join(rows[4][1].split()[20:25])), (3, None), (4, "..."), (None, rows[5][1]), (12, rows[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(x):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")) if w]

    windows = []
    for i, x in items:
        w = words(x)
        n = min(10, len(w))
        windows += [(tuple(w[k : k + n]), i) for k in range(len(w) - n + 1)] if w else []

    def want(i, x):
        w, hit, seen = words(x), set(), set()
        for win, item in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    seen.add(item)
        names = sorted(str(s) for s in seen if s is not None)
        return i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)

    got = digests.contamination_digests(decontaminate.find_contamination(docs, bench)).collect()
    assert Counter(map(tuple, got)) == Counter(want(r[0], r[1]) for r in rows)
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    unhinted = decontaminate.find_contamination(docs, bench, max_broadcast_rows=0)
    assert Counter(map(tuple, digests.contamination_digests(unhinted).collect())) == Counter(map(tuple, got))


@pytest.mark.parametrize("hot", [5000, 0])
def test_substring_dedup(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    counts = Counter(b[k : k + 60] for _, b in data for k in range(len(b) - 59))

    def want(i, b):
        gone = bytearray(len(b))
        for k in range(len(b) - 59):
            if counts[b[k : k + 60]] > 1:
                gone[k : k + 60] = b"\1" * 60
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        return i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept

    got = substring_dedup.remove_repeats(docs, length=60).collect()
    assert Counter((*r[:4], bytes(r[4])) for r in got) == Counter(want(*d) for d in data)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_urls(spark):
    urls = ["http://a.com/x?q", "https://WWW.Example.com/en/1#f", "http://blog.example.com/en/", "ftp://spam.net/p/", "http://spam.net/p?x", "spam.net/p", None, "", "http://spam.net", "http://b.net/es/1"]
    pages = spark.createDataFrame([(i, u, "old", "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string, html string")
    listed = spark.createDataFrame([("spam.net/p",), ("spam.net/p",), (None,)], "u string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    want = ["allow", "allow", "block", "block", "block", "allow", "allow", "allow", "allow", "block"]
    for settings in ({}, {"max_filter_bytes": 0, "max_listed_rows": 0}):
        got = {r["page_id"]: r for r in url_filter.filter_urls(pages, listed, rules, **settings).collect()}
        assert [got[i]["verdict"] for i in range(len(urls))] == want
        assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("www.example.com", "/en/1", "www.example.com/en/")
        assert (got[5]["host"], got[5]["path"], got[5]["rule"]) == ("", "", None)
    assert url_filter.filter_urls(pages, listed.limit(0), rules).where("verdict = 'block'").count() == 2
    assert url_filter.filter_urls(pages.limit(0), listed, rules).count() == 0


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def test_secrets(spark, docs, rows, empty):
    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1] + [7 * i % 256] * 40)) for i in range(8)))
    coded = base64.b64encode(key).decode()
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    token = f"{head}.{base64.urlsafe_b64encode(b'{}').decode().rstrip('=')}.abc"
    kinds = lambda t: [s[0] for s in secrets.find_secrets(t)]
    assert kinds(f"é {coded} x") == ["key"] and secrets.find_secrets(f"é {coded} x")[0][1:] == (2, 2 + len(coded))
    assert kinds(token) == ["jwt"] and kinds(token.replace(head, "eyJhYmMi")) == []
    assert "key" in kinds(key.hex()) and kinds(base64.b64encode(key[:-3]).decode()) == []
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{coded[:64]}\n{coded[64:]}\n-----END RSA PRIVATE KEY-----")[0] == "pem"
    assert kinds("token=secret: abcdefghijklmnop") == [] and kinds("Password = 'abcdefghijkl'") == ["assign"]
    assert kinds("AKIA" + "A" * 14) == ["access"] and kinds("AKIA" + "A" * 13) == [] and kinds("x0123456789abcdefg") == ["hex"]
    assert secrets.redact("a KEY b", [("x", 2, 5), ("y", 3, 4)], "*") == "a * b"
    body = f"{coded[:64]}\\n{coded[64:]}"
    assert kinds(f'"-----BEGIN PRIVATE KEY-----\\n{body}\\n-----END PRIVATE KEY-----"')[0] == "pem"
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\nX-Note: a, b\n\n{coded}\n-----END RSA PRIVATE KEY-----")[0] == "pem"
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{coded[:-40]}\n-----END RSA PRIVATE KEY-----") == []
    assert ("key", 1, 1 + 2 * len(key)) in secrets.find_secrets("a" + key.hex() + "5")
    lines = "\n".join(coded[k : k + 64] for k in range(0, len(coded), 64))
    assert ("key", 3, 3 + len(lines)) in secrets.find_secrets(f"x: {lines}\n")
    begun = time.time()
    for long in ("eyJ" * 100_000, "3082" * 100_000, "MIIE" * 100_000, "-----BEGIN PRIVATE KEY-----" * 20_000, "password " * 50_000, "A" * 400_000):
        assert "jwt" not in kinds(long) and "key" not in kinds(long)
    assert time.time() - begun < 20

    def base(text):
        """The base kinds letter by letter."""
        out, at = [], 0
        while at < len(text):  # hex runs
            end = at
            while end < len(text) and text[end] in "0123456789abcdef":
                end += 1
            if end - at >= 16:
                out.append((at, 2, f"hex:{at}:{end}"))
            at = max(end, at + 1)
        at = 0
        while at < len(text):
            end = at + 4
            while text.startswith("AKIA", at) and end < len(text) and text[end] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
                end += 1
            hit = text.startswith("AKIA", at) and end > at + 4
            if hit and end - at >= 18:
                out.append((at, 1, f"access:{at}:{end}"))
            at = end if hit else at + 1
        at = 0
        while at < len(text):
            name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[at : at + len(n)].lower() == n and text[at : at + len(n)].isascii()), None)
            end = at + len(name or "")
            if name:
                end += text[end : end + 1] in ('"', "'") and bool(text[end : end + 1])
                while text[end : end + 1] == " ":
                    end += 1
                if text[end : end + 1] in (":", "=") and text[end : end + 1]:
                    end += 1
                    while text[end : end + 1] == " ":
                        end += 1
                    end += text[end : end + 1] in ('"', "'") and bool(text[end : end + 1])
                    begin = end
                    while end < len(text) and (text[end].isascii() and text[end].isalnum() or text[end] in "+/_.=-"):
                        end += 1
                    if end > begin:
                        if end - begin >= 12:
                            out.append((at, 0, f"assign:{at}:{end}"))
                        at = end
                        continue
            at += 1
        return [x[2] for x in sorted(out)]

    rng = random.Random(4)
    parts = ["password", "Token", "API_KEY", "apikey", "sécret", "secret", ": ", "=", '"', "'", " ", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "dead", "x", "é", "Zz9+/_.=-", "abcdefghijkl", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in digests.secret_digests(df).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
    got = digests.secret_digests(docs)
    assert got.count() == len(rows) and digests.secret_digests(empty).count() == 0
    marked = secrets.scan_secrets(docs, mark="*")
    assert marked.where("text is null").count() == sum(r[1] is None for r in rows)


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["text_crc32"]) for r in got} == {(r[0], zlib.crc32((r[1] or "").encode())) for r in rows}
    for k in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    many = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sizes = sharding.shard_documents(many.withColumnRenamed("id", "doc_id")).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    mean = sum(r["s"] for r in sizes) / 8
    assert len(sizes) == 8 and all(abs(r["s"] - mean) < 0.02 * mean for r in sizes)
    half = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 1, F.lit("same text" * 3)).otherwise(F.concat(F.lit("t" * 20), "id")).alias("text"))
    placed = sharding.shard_documents(half).cache()
    sizes = placed.groupBy("shard").agg(F.sum("size").alias("s"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("n")).collect()
    mean = sum(r["s"] for r in sizes) / 8
    assert len(sizes) == 8 and all(abs(r["s"] - mean) < 0.02 * mean and (r["a"], r["b"]) == (0, r["n"] - 1) for r in sizes) and placed.count() == 40_000
    assert sharding.shard_documents(empty).count() == 0


def near_want(rows, size=5):
    sets, ids = [], []
    for r in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")) if x]
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
        ids.append(r[0])
    group = list(range(len(rows)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    low = {}
    for a, i in enumerate(ids):
        low.setdefault(find(a), []).append(i)
    out = []
    for a, i in enumerate(ids):
        lowest = min([x for x in low[find(a)] if x is not None], default=None)
        out.append((i, len(sets[a]), lowest, lowest is None or i == lowest))
    return Counter(out)


def test_near_dedup(spark, docs, rows, empty):
    assert Counter(map(tuple, near_dedup.near_duplicates(docs).collect())) == near_want(rows)
    assert near_dedup.near_duplicates(empty).count() == 0
    rng = random.Random(8)
    base = [f"v{rng.randint(0, 999)}" for _ in range(220)]
    many = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**6)}"
        many.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == near_want(many)


def test_quality(spark, docs, rows, empty):
    def want(i, x):
        x = x or ""
        w = [v for v in re.split(r"[\x20\x09-\x0D]+", x) if v]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [v for v in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", v)]
        return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)

    weak = quality.text_counts(docs, window_hash="(xxhash64({0}) & 7)")  # unlike windows share a hash
    exact = quality.text_counts(docs)
    assert Counter(map(tuple, weak.select("doc_id", "n_repeat_words").collect())) == Counter(map(tuple, exact.select("doc_id", "n_repeat_words").collect()))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    for reread in (False, True):
        got = quality.quality_filter(docs, labels, keep=["doc_id"], reread=reread).collect()
        assert Counter(tuple(r)[:7] for r in got) == Counter(want(r[0], r[1]) for r in rows)
        assert all(r["kept"] != r["base_failed"] for r in got)  # too few labels prove nothing
    assert quality.quality_filter(empty, labels).count() == 0
    good = spark.createDataFrame([("en", 100, 500, 0, 10, 0, 0)] * 3000, "_stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    cut = quality.proven_cutoffs(good).first()
    assert cut["cut_symbols"] == 0.05 and cut["cut_word_length"] == 6.0
    assert quality.proven_cutoffs(good.limit(500)).count() == 0


def test_quality_small_strata(spark):
    """300 good labels of a language prove a rule; a language without labels takes the pooled one."""
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(60))
    rows = [(i, prose(), lang) for k, lang in enumerate("abcd") for i in range(400 * k, 400 * k + 300)]
    rows += [(9000 + k, prose() + " $$$ ### $$$ ### $$$ ### $$$ ###", lang) for k, lang in enumerate("abcdz")]
    rows += [(9100, prose(), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1) for r in rows[:1200]], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_filter(docs, labels, keep=["doc_id"]).collect()}
    assert not any(kept[9000 + k] for k in range(5))
    assert all(kept[r[0]] for r in rows[:1200]) and kept[9100]
    assert sorted(quality.ORDER) == sorted((s, j) for s in quality.SIGNALS for j in range(quality.CUTOFFS))


def test_names_that_clash(spark):
    """Columns named as the operators' own helpers go through unharmed."""
    names = ["_text", "_k0", "_id", "_stratum", "segment", "words", "_word", "_maybe", "_key", "_a", "_bytes", "_shard", "_hash", "n_lines"]
    rows = [(1, "a b", "http://a.com/x", 5, *names), (2, None, None, 6, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string, spread long, " + ", ".join(f"`{c}` string" for c in names))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    listed = spark.createDataFrame([("a.com/x",)], "u string")
    outs = [
        secrets.scan_secrets(docs), secrets.scan_secrets(docs, mark="*"), wordpiece.token_counts(docs), url_filter.filter_urls(docs, listed, []),
        quality.quality_filter(docs, labels, stratum_col="_text"), sharding.histogram_shards(docs, "spread", "doc_id", "spread"),
    ]
    for out in outs:
        assert [r.asDict() | dict(zip(names, names, strict=True)) for r in out.collect()] == [r.asDict() for r in out.collect()] and out.count() == 2


def test_null_stratum_is_not_the_blank_one(spark):
    prose = lambda k: " ".join(f"w{k}x{j}abc" for j in range(60))
    rows = [(k, prose(k), None if k % 2 else "") for k in range(500)] + [(900, prose(900) + " $$$$ ####" * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(500)], "doc_id long, quality int")
    got = quality.quality_filter(docs, labels, keep=["doc_id", "lang"]).where("not kept").collect()
    assert [r["doc_id"] for r in got] == [900]


def test_binomial_tail(spark):
    cases = [(k, n) for n in (10, 300, 5000) for k in (0, 1, n // 100)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.03).alias("p")).collect()
    for r in got:
        k, n = r["k"], r["n"]
        want = 1.0 if k >= n * 0.03 else math.fsum(math.comb(n, i) * 0.03**i * 0.97 ** (n - i) for i in range(k + 1))
        assert math.isclose(r["p"], want, rel_tol=1e-9)


def test_lm_score(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 120)  # so that rare words take their own way
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in rows]
    counts = Counter(t for i, ts in tokens if not held(i) for t in ts)
    total, kinds = sum(counts.values()), len(counts)

    def want(i, ts):
        return i, held(i), len(ts), sum(counts[t] > 0 for t in ts), total, round(sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in ts), 5)

    got = lm_score.score_documents(docs).collect()
    assert Counter((*r[:5], round(r[5], 5)) for r in got) == Counter(want(*t) for t in tokens)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm_score.score_documents(empty).count() == 0


def test_lm_learns_and_does_not_depend_on_the_layout(spark):
    """Held-out texts score better than by counts alone, the same however the table is dealt out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()
    got = lm_score.score_documents(docs.repartition(7)).cache()
    held = got.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] > held[1] + 0.05 * held[2], held  # log10 per token
    other = {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs.coalesce(1)).collect()}
    assert all(math.isclose(r["score"], other[r["doc_id"]], rel_tol=1e-6) for r in got.collect())


def test_lm_without_training_documents(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    got = lm_score.score_documents(docs).collect()
    assert got and all(r["n_known"] == r["train_tokens"] == 0 and math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)


def test_lm_training_uses_every_token(spark):
    """A partition of fewer tokens than a step is learned from; a stretch begins without a state."""
    size = lm_score.VOCAB
    flat = gru.start(size, np.ones(size))
    encoded = spark.createDataFrame([([3, 4, 5, 0],)], "ids array<short>")
    assert np.abs(lm_score.train_round(encoded, flat) - flat).max() > 0.001
    first, second = np.array([3, 4, 5], np.int32), np.array([6, 7, 0], np.int32)
    monkey = pytest.MonkeyPatch()
    monkey.setattr(gru, "lanes_of", lambda docs, most=512: [list(range(len(docs)))])
    together, alone = gru.run_lanes(flat, size, [first, second], 0), gru.run_lanes(flat, size, [second], 0)
    monkey.undo()
    assert math.isclose(together[1], alone[0], rel_tol=1e-5)


def test_pipeline_null_and_repeated_ids(spark, tmp_path):
    """Texts under no id or one id are judged one by one."""
    import corpus_pipeline

    rng = random.Random(8)
    new = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    a, b, c, d, e, near, leak = (new() for _ in range(7))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (1, d), (2, e), (2, e + " tail"), (None, near), (None, near + " tail"), (3, near + " tail end")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    out = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    pair = [x for x in out if x[0] == 2]
    assert len(pair) == 1 and pair[0][1].startswith(e)
    assert out == Counter([(None, a), (None, b), (1, c), (1, d), pair[0], (3, near + " tail end")])

    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, leak), (None, a), (4, leak), (4, b), (5, c)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(None, a), (4, b), (5, c)])


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0.5 * len(docs) < out.count() <= len(docs)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == table.columns and kept.count() <= before
    import public_tokenizers
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in kept.select("doc_id", "text").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert Counter(map(tuple, out.collect())) == Counter(want)
    assert sum(bool(secrets.find_secrets(r["text"])) for r in kept.collect()) == 0


def test_bpe_of_characters_that_unicode_versions_differ_in():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    coder = bpe.WordBpe(bpe.tokenizer_bytes())
    points = [*range(0x80, 0x3000, 3), *range(0xA000, 0xD800, 11), *range(0xE000, 0x10000, 7), *range(0x10000, 0x20000, 5), *range(0x20000, 0x110000, 499)]
    points += [0x558, 0x58B, 0x88F, 0x1C89, 0xA7CB, 0xA7CE, 0xA7CF, 0xA7DC, 0x10D50, 0x10D65, 0x16EA0, 0x16EBB, 0x12475, 0x33479, 0x3D000]
    for c in points:
        x = f"a{chr(c)}b {chr(c)}{chr(c)}"
        assert memoryview(coder.encode(x)[0]).cast("i").tolist() == t.encode(x, add_special_tokens=False).ids, hex(c)


def test_lm_lanes_of_very_unlike_lengths():
    """A text of 60,000 words beside many short ones: memory goes with the words there are."""
    import tracemalloc

    docs = [np.full(60_000, 3, np.int32), *[np.array([1, 2, 63], np.int32)] * 511]
    flat = gru.start(64, np.ones(64))
    tracemalloc.start()
    scores = gru.run_lanes(flat, 64, docs, 63)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30_000_000 and np.allclose(scores[1:], scores[1])
