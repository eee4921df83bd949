"""The registered queries of the training-text operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.llm import decontaminate, digests, lm_score, near_dedup, quality, sharding, substring_dedup, url_filter, wordpiece

QUERIES, ORACLES = {}, {}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name, oracle=None):
    def add(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return add


@_query("op1_bpe")
def op1_bpe(spark, sf_dir):
    return digests.bpe_digests(_table(spark, sf_dir, "documents"))


@_query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), keep=["doc_id"])


#: The URL rules of the query (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Host labels that put a page's canonical URL on the list; one in sixteen of the others is on it as well, by its digest.
LISTED_LABELS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


@_query(
    "op5_url_filter",
    r"""
    WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canonical,
                 CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p),
    listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)(\.|$)') OR (canonical <> '' AND md5(canonical) LIKE '0%'))
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
    FROM c
    """,
)
def op5_url_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    host, path = url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))
    on_list = host.rlike(r"(^|\.)(" + "|".join(LISTED_LABELS) + r")(\.|$)")
    canonical = url_filter.canonical_url(host, path)
    some = (canonical != "") & F.md5(canonical.cast("binary")).startswith("0")
    listed = pages.where(on_list | some).select(canonical.alias("canonical"))
    return url_filter.filter_urls(pages, listed, URL_RULES, keep=["page_id"])


@_query("op9_quality")
def op9_quality(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.quality_filter(docs, labels, keep=["doc_id"])


@_query("op6_secrets")
def op6_secrets(spark, sf_dir):
    return digests.secret_digests(_table(spark, sf_dir, "documents"))


@_query("op7_sharding")
def op7_sharding(spark, sf_dir):
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query(
    "op2_decontamination",
    r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM bw),
    dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
           FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
    occ AS (SELECT doc_id, item_id, i, dw.size AS size FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op2_decontamination(spark, sf_dir):
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return digests.contamination_digests(decontaminate.find_contamination(docs, items))


@_query("op8_near_dedup")
def op8_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op10_lm_score")
def op10_lm_score(spark, sf_dir):
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


@_query("op4_substring_dedup")
def op4_substring_dedup(spark, sf_dir):
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op11_merkle")
def op11_merkle(spark, sf_dir):
    return digests.merkle_digests(_table(spark, sf_dir, "documents"))


@_query("op12_prefix_trie")
def op12_prefix_trie(spark, sf_dir):
    return digests.trie_digests(_table(spark, sf_dir, "conversations"))


@_query("op13_pieces")
def op13_pieces(spark, sf_dir):
    return digests.piece_digests(_table(spark, sf_dir, "documents"))
