"""The corpus pipeline: five stages, each over all that the one before it kept.

run(spark, sf_dir) writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratum.llm import minhash, packing, quality, secrets, suffix_dedup
from stratum.llm.common import cut
from stratum.llm.queries import table, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null or empty text is scored as one empty passage; repeated rows are scored alike; an empty table stays empty."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: its smallest doc_id (one row of it). Null and empty texts are near nothing and stay, as do rows with a null id."""
    return minhash.distinct(docs)


#: Passages that leave: of over so many words, or of so many bytes. A passage of 51 words of three letters has 203 bytes.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_SPAN = 50, 400, 200


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words (or of 400 bytes, where words aren't parted by spaces) that occur twice leave the texts, in every place; every document stays. Null and empty texts stay as they are; repeated rows are places of their own."""
    return counted(suffix_dedup.remove(docs, span=PASSAGE_SPAN, words=PASSAGE_WORDS, size=PASSAGE_BYTES))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null and empty texts as they are."""
    return counted(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens. A null or empty text is the end id alone; repeated rows are packed each for itself."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    from pyspark.sql import functions as F

    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("quality", good_quality), ("minhash", no_near_copies), ("suffix", no_repeated_passages), ("secrets", no_secrets), ("packing", packed)]

ORACLE_SQL = None  # a learned classifier, tokens and a genetic algorithm are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
