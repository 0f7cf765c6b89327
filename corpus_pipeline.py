"""The corpus pipeline: four stages over documents, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import decontaminate, jaccard, langid, unigram
from siftlake.llm.shared import discard, table, written

VOCABULARY = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no learned language fits, go."""
    return langid.known(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words inside benchmark windows go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.is_contaminated(F.col("n_words"), F.col("n_hit"))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip): piece ids, and whether decoding them gives the text back."""
    coded = unigram.encode_texts(docs, public_tokenizers.path(VOCABULARY), keep=["doc_id"])
    return coded.select("row.doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col("ids").alias("token_ids"), F.col("same").alias("round_trip"))


STAGES = [("language ID", language), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontaminated), ("SentencePiece encoding and decoding", tokenize)]

#: The language network can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again as the next one's input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
            if before is not None:
                discard(before)
            before = docs
    return docs
