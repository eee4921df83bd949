"""The digest columns that queries derive from the operators' outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.llm import bpe, merkle, prefix_trie, secrets, sentence_pieces


def bpe_digests(docs):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    coded = bpe.bpe_encode(docs, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def secret_digests(docs):
    """Counts, the base digest and all spans of each document."""
    found = secrets.scan_secrets(docs, keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"].isin(secrets.BASE_KINDS))
    counts = [F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("secrets")).alias("spans"))


def contamination_digests(found):
    """The columns of the contract from the operator's words, hits and items."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def merkle_digests(docs):
    """Leaves, roots and proofs of all documents; half of them are checked with their line ends deleted."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    bent = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    seen = merkle.leaf_digest([*[F.col(c) for c in fields[:-1]], F.when(bent, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))])
    proofs = merkle.prove(docs, fields, "source", "doc_id", {"seen": seen})
    folded = merkle.fold(F.col("seen"), F.col("path"))
    found = proofs.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def trie_digests(turns):
    """The nodes of the trie; a node at which nothing ends has the digest of the empty text."""
    found = prefix_trie.prefix_trie(turns)
    return found.select(*[c for c in found.columns if c != "ends"], F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def piece_digests(docs):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    coded = sentence_pieces.piece_encode(docs, keep=["doc_id"])
    return coded.select("doc_id", sentence_pieces.token_total("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
