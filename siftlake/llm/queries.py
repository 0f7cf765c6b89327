"""The queries of this subpackage: name -> function of (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import decontaminate as dc
from siftlake.llm import jaccard, langid, licenses, multiset, ppm, preference, tokenpack, unigram, warc
from siftlake.llm.shared import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dc.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), dc.digest(F.col("items")).alias("items_sha256"), dc.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = ppm.score(docs, docs.where(langid.fold(docs["doc_id"], 5) != 1))
    return found.select(F.col("id").alias("doc_id"), (langid.fold(F.col("id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multiset.with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", F.expr(multiset.edited("text", "next_text")))
    rows = rows.select("id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", F.expr(multiset.fingerprint("edited")).alias("edited_fp"))
    like = multiset.likenesses("fp", {"near_edited": "edited_fp", "near_next": "next_fp"})
    rows = rows.select("id", "n_chars", "edited_sha256", F.expr(multiset.printed("fp")).alias("fingerprint"), F.expr(multiset.printed("edited_fp")).alias("edited_fingerprint"), F.expr(like).alias("like"))
    return rows.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "like.near_edited", "like.near_next")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))


def op5_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = unigram.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], digest=True)
    return coded.select("row.doc_id", "n_tokens", "ids_crc32", "n_fallback", "score", F.coalesce("same", F.lit(True)).alias("round_trip"))


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = preference.format_pairs(turns, *preference.halves(turns["conv_id"]))
    return rows.select(F.col("pair").alias("pair_id"), "n_prompt_turns", "prompt", "chosen", "rejected", preference.printed("chosen_mask").alias("chosen_mask"), preference.printed("rejected_mask").alias("rejected_mask"))


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenpack.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenpack.read_ids(spark, files)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.normalise_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return warc.read_archives(archives).drop("url")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, keep=["doc_id"])
    return found.select("row.doc_id", (langid.fold(F.col("row.doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_ppm": op2_ppm, "op3_multiset_hash": op3_multiset_hash, "op4_licenses": op4_licenses, "op5_unigram": op5_unigram, "op6_preference": op6_preference, "op7_packed_ids": op7_packed_ids, "op8_warc": op8_warc, "op9_language": op9_language, "op10_jaccard_join": op10_jaccard_join}
