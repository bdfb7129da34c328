"""The corpus pipeline: each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, mixing, near_copies, quality_rules, token_file
from lattica.llm.common import materialize, table
from lattica.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject; lines above a host's limit leave the texts of the others."""
    columns = docs.columns
    judged = quality_rules.judge_quality(docs, max_share=None, with_text=True, carry=[c for c in columns if c != "text"]).where("kept")
    own = {"text": F.col("clean_text"), "n_chars": F.when(F.col("changed"), F.char_length("clean_text").cast("long")).otherwise(F.col("_c_n_chars"))}
    return judged.select(*(own.get(c, F.col(f"_c_{c}")).alias(c) for c in columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' epochs that the target weights ask for; a document taken twice is two rows."""
    return mixing.mix(docs, rows=True)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what is read back from them for each document."""
    return token_file.write_and_read(docs, vocabulary_path(), end_id=1)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID output", token_output),
]

#: Fingerprints (XXH64) and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
