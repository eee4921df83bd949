"""URL filter: a blocked Bloom filter of listed URLs in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import ascii_lower, col, cut, put_back, set_apart

#: Words of 64 bits in a row of the filter table, and bits set for a key in its one word.
SEGMENT, PROBES = 4096, 5


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without a leading www. and path without closing slashes; query and fragment are gone."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], field: int) -> Column:
    """The name (field 0) or verdict (field 1) of the longest rule that fits, else null.

    rules: (verdict, host, path). A rule fits its host and the subdomains if the path starts with
    the rule's. Rules are a short hand-kept list, one branch each; long lists are listed URLs.
    """
    found = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.lit((rule_host + rule_path, verdict)[field])).otherwise(found)
    return found


def _word_and_mask(key: Column, n_words: int) -> tuple[Column, Column]:
    """The filter word of a key and its bits there."""
    h, bits = F.xxhash64(key), F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(h, F.lit(n_words)), mask


def bloom_table(keys: DataFrame, key: str, n_words: int) -> DataFrame:
    """Rows (segment, words array<bigint>) of a blocked Bloom filter over one string column.

    Each key sets bits in one 64-bit word only. The bits are gathered by a grouped bit_or with
    partial aggregation; a row holds 4,096 consecutive words.
    """
    word, mask = _word_and_mask(col(key), n_words)
    spark = keys.sparkSession
    empty = spark.range(-(-n_words // SEGMENT) * SEGMENT).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    filled = keys.select(word.alias("word"), mask.alias("mask")).unionByName(empty)
    by_word = filled.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    rows = by_word.groupBy(F.floor(F.col("word") / SEGMENT).cast("long").alias("segment"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("w")).select("segment", F.col("w.mask").alias("words"))


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str, str]],
    url_col: str = "url",
    keep: list[str] | None = None,
    bits_per_key: int = 16,
    max_filter_bytes: int = 64 << 20,
    max_listed_rows: int = 100_000,
) -> DataFrame:
    """Judge each URL: adds host, path, rule and verdict (allow or block).

    listed has one column with canonical URLs to block (repeats and nulls do not matter). The
    longest rule decides; without a rule, a listed URL is blocked and any other allowed. A null
    URL, or one without ://, has empty host and path, no rule, and is allowed.

    The Bloom filter's size follows the listed URLs. Up to max_filter_bytes it is broadcast; beyond
    that its rows stay partitioned, and each URL meets its own row by a join. Only possible hits reach
    the exact join, whose listed side is broadcast up to max_listed_rows. Repeated rows and null ids
    stay; input columns named host, path, rule or verdict are replaced, others may have any names.
    """
    new = ["host", "path", "rule", "verdict"]
    kept = [c for c in (keep if keep is not None else pages.columns) if c.lower() not in new]
    key = listed.columns[0]
    listed = cut(listed.select(col(key).alias("_listed")).where("_listed is not null").distinct())
    n = listed.count()
    host, path = url_host(col(url_col)), url_path(col(url_col))
    parts = pages.select(*set_apart(kept), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules, 0)).withColumn("_ruled", fitting_rule(F.col("host"), F.col("path"), rules, 1))
    n_words = max(SEGMENT, -(-n * bits_per_key // 64))
    parts = parts.withColumn("_canonical", canonical_url(F.col("host"), F.col("path")))
    word, mask = _word_and_mask(F.col("_canonical"), n_words)
    table = bloom_table(listed, "_listed", n_words)
    held = F.broadcast(table) if n_words * 8 <= max_filter_bytes else table
    at = parts.withColumn("_word", word).withColumn("segment", F.floor(F.col("_word") / SEGMENT).cast("long"))
    got = F.get("words", (F.col("_word") % SEGMENT).cast("int"))
    parts = at.join(held, "segment").withColumn("_maybe", got.bitwiseAND(mask) == mask).drop("segment", "_word", "words")
    if n <= max_listed_rows:  # what misses the filter has a null key and meets nothing
        judged = parts.withColumn("_key", F.when(F.col("_maybe"), F.col("_canonical"))).join(F.broadcast(listed), F.col("_key") == F.col("_listed"), "left").withColumn("_hit", F.col("_listed").isNotNull())
    else:
        hits = parts.where("_maybe").join(listed, F.col("_canonical") == F.col("_listed"), "left").withColumn("_hit", F.col("_listed").isNotNull()).drop("_listed")
        judged = hits.unionByName(parts.where("not _maybe").withColumn("_hit", F.lit(False)))
    verdict = F.coalesce("_ruled", F.when(F.col("_hit"), "block").otherwise("allow"))
    return judged.select(*put_back(kept), "host", "path", "rule", verdict.alias("verdict"))
