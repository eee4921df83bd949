"""Benchmark decontamination as a prefix-filtered set join of shingles.

Items are cut into windows of consecutive words. A window can only occur where all of its
shingles occur, so one of them, the rarest in the documents, is a sufficient prefix: documents
and windows are joined on it alone, places that leave the window no room are dropped, and what
is left is verified word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import ascii_lower, col, cut

#: Runs of what separates words (after lower-casing).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Key of the one row that each document sends along besides its matches.
_PRESENT = 0x5EED


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingles(words: str, size: int) -> Column:
    """For each place the hash of the size words from there (at the end, of what is left)."""
    parts = ", ".join(["w", *[f"get({words}, i + {k})" for k in range(1, size)]])
    return F.expr(f"transform({words}, (w, i) -> xxhash64({size}, {parts}))")


def _windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: words, size and the ids of the items that have them."""
    words = items.select(col(item_col).alias("item"), words_of(col(text_col)).alias("w")).where("size(w) > 0")
    starts = words.withColumn("size", F.least(F.size("w"), F.lit(window))).select("item", "w", "size", F.explode(F.expr("sequence(1, size(w) - size + 1)")).alias("i"))
    cut_out = starts.select("item", "size", F.slice("w", F.col("i"), F.col("size")).alias("words"))
    return cut_out.groupBy("words", "size").agg(F.collect_set("item").alias("items"))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 5,
    max_broadcast_rows: int = 2_000_000,
    row_key: bool = False,
) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit and items (ids of items with windows in it).

    Words are runs of characters other than ASCII ones that are no letter or digit, A-Z
    lower-cased. An item of fewer words than a window is one window; null and wordless items have
    none, and a null item id is not listed. A null or wordless document has zeros. Repeated
    documents each get their row. Texts are read once: what leaves a document is one row and its
    places with a benchmark shingle, each with the words around it. The benchmark's shingles and
    windows are broadcast up to max_broadcast_rows, and joined by shuffle beyond. With row_key there
    is also text_hash, which tells rows with one id or none apart.
    """
    windows = cut(_windows(items, item_col, item_text_col, window).withColumn("window", F.xxhash64("words", "size")))
    sizes = sorted(r[0] for r in windows.select(F.least("size", F.lit(shingle)).alias("s")).distinct().collect())  # at most `shingle` numbers
    parts = [windows.where(F.least("size", F.lit(shingle)) == s).select("*", F.posexplode(F.slice(_shingles("words", s), 1, F.col("size") - s + 1)).alias("offset", "h")) for s in sizes]
    spark = docs.sparkSession
    if parts:
        keyed = cut(reduce(DataFrame.unionByName, parts).select("window", "words", "size", "items", "offset", "h"))
    else:
        keyed = windows.select("window", "words", "size", "items", F.lit(0).alias("offset"), F.lit(0).cast("long").alias("h"))
    small = keyed.count() <= max_broadcast_rows
    light = F.broadcast if small else (lambda df: df)
    wanted = light(keyed.select("h").distinct().unionByName(spark.range(1).select(F.lit(_PRESENT).cast("long").alias("h"))))

    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("_text"))
    worded = source.select("doc_id", F.xxhash64("_text").alias("_text_hash"), words_of(F.col("_text")).alias("_w"))
    worded = worded.withColumn("n_words", F.size("_w").cast("long"))
    hashes = F.concat(*[_shingles("_w", s) for s in sizes], F.array(F.lit(_PRESENT).cast("long")))
    places = worded.select("doc_id", "_text_hash", "n_words", "_w", F.posexplode(hashes).alias("_p", "h"))
    matched = places.join(wanted, "h")
    at = F.when(F.col("n_words") > 0, F.col("_p") % F.col("n_words")).otherwise(0).cast("int")
    first = F.greatest(F.col("_at") - window, F.lit(0))
    around = F.when(F.col("h") == _PRESENT, F.array().cast("array<string>")).otherwise(F.slice("_w", F.col("_from") + 1, F.lit(2 * window)))
    matched = cut(matched.withColumn("_at", at).withColumn("_from", first).select("doc_id", "_text_hash", "n_words", "h", "_at", "_from", around.alias("_near")))

    counts = matched.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    prefix = keyed.join(counts, "h").groupBy("window").agg(F.min_by(F.struct("h", "offset", "words", "size", "items"), F.struct("n", "h", "offset")).alias("p")).select("window", "p.*")
    found = matched.where(F.col("h") != _PRESENT).join(light(prefix), "h")
    start = F.col("_at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.slice("_near", F.greatest(start - F.col("_from"), F.lit(0)) + 1, F.col("size")) == F.col("words")
    hits = found.where(fits).where(same).select("doc_id", "_text_hash", start.alias("start"), "size", "items")
    present = matched.where(F.col("h") == _PRESENT).select("doc_id", "_text_hash", "n_words")
    both = present.withColumn("_hit", F.lit(None).cast("struct<start:int,stop:int>")).withColumn("items", F.lit(None).cast(hits.schema["items"].dataType)).unionByName(
        hits.select("doc_id", "_text_hash", F.lit(None).cast("long").alias("n_words"), F.struct("start", (F.col("start") + F.col("size")).alias("stop")).alias("_hit"), "items")
    )
    by_doc = both.groupBy("doc_id", "_text_hash").agg(F.count("n_words").alias("_copies"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("_hit")).alias("_hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.aggregate(
        "_hits",
        F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(F.greatest(a["end"], h["stop"]).alias("end"), (a["n"] + F.greatest(h["stop"] - F.greatest(a["end"], h["start"]), F.lit(0))).cast("long").alias("n")),
        lambda a: a["n"],
    )
    key = ["text_hash"] if row_key else []
    counted = by_doc.withColumnRenamed("_text_hash", "text_hash").select("doc_id", "n_words", covered.alias("n_hit"), "items", *key, "_copies")
    return counted.select("doc_id", "n_words", "n_hit", "items", *key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_c")).drop("_c")
