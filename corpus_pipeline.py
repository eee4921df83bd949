"""The corpus pipeline: five stages, each over all that the one before it kept.

Quality rules drop what they reject, near-dedup leaves one document of each group, decontamination
drops documents with benchmark windows, secrets are replaced by a mark, and the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, digests, near_dedup, quality, secrets
from corvane.llm.shared import cut, put_back, set_apart, stored

#: Ids of dropped documents that are broadcast at most; beyond, they are joined by shuffle.
MAX_BROADCAST_IDS = 2_000_000
SECRET_MARK = "[SECRET]"


def _apart(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """docs with columns under names of their own, its id and the hash of its text."""
    at = {c: F.col(f"_k{i}") for i, c in enumerate(docs.columns)}
    return docs.select(*set_apart(docs.columns)), at["doc_id"], F.xxhash64(F.coalesce(at["text"], F.lit("")))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less the rows whose (doc_id, text_hash) is in dropped; a null id is an id."""
    ids = cut(dropped.select(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash")).distinct())
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    apart, doc_id, text_hash = _apart(docs)
    left = apart.join(ids, (text_hash == F.col("drop_hash")) & doc_id.eqNullSafe(F.col("drop_id")), "left_anti")
    return left.select(*put_back(docs.columns))


def _one_of_each(docs: DataFrame) -> DataFrame:
    """Of rows with equal id and text the one whose other columns come first, as JSON."""
    apart, doc_id, text_hash = _apart(docs)
    rest = F.to_json(F.struct(*[F.col(c) for c, name in zip(apart.columns, docs.columns, strict=True) if name != "text"]))
    one = apart.groupBy(doc_id.alias("one_id"), text_hash.alias("one_hash")).agg(F.min_by(F.struct(*apart.columns), rest).alias("one"))
    return one.select("one.*").select(*put_back(docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text has no words and goes; a null language is a stratum of its own. Here and in all
    stages: repeated rows are judged alike, an empty table gives an empty one, and further columns may
    have any names and stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    named = docs.select(*[F.col(f"`{c}`").alias(f"doc_{c}") for c in docs.columns])
    judged = quality.quality_filter(named, labels, id_col="doc_doc_id", text_col="doc_text", stratum_col="doc_lang", reread=True, keep=named.columns)
    return judged.where("kept").select(*[F.col(f"`doc_{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the lowest id (then hash) of each group; of rows with equal id and text one stays.

    A null id comes after all others and joins no rows together; texts without words are in no group and
    stay. Of rows with equal id and text the one whose other columns come first, as JSON text, stays.
    """
    found = cut(near_dedup.near_duplicates(docs, row_key=True))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = found.where("component is not null").groupBy("component").agg(F.min(row).alias("first"))
    left = _without(docs, found.join(first, "component").where(row != F.col("first")))
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    return left if repeated.isEmpty() else _one_of_each(left)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; null and wordless texts have none and stay, under any id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.find_contamination(docs, items, row_key=True).where("n_hit > 0"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each found secret replaced by the mark; n_chars follows the new text.

    A null text stays null; a document without secrets keeps its n_chars.
    """
    named = docs.select(*[F.col(f"`{c}`").alias(f"doc_{c}") for c in docs.columns])
    marked = secrets.scan_secrets(named, text_col="doc_text", keep=[c for c in named.columns if c != "doc_text"], mark=SECRET_MARK)
    n_chars = F.when(F.size("secrets") > 0, F.length("doc_text").cast("long")).otherwise(F.col("doc_n_chars"))
    marked = marked.withColumn("doc_n_chars", n_chars)
    return marked.select(*[F.col(f"`doc_{c}`").alias(c) for c in docs.columns])


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document; a null text counts as empty."""
    return digests.bpe_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("bpe encoding", bpe_encoding),
]

#: SQL cannot express MinHash groups or BPE; tests/llm has a brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
