"""A corpus pipeline of five stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from effectlake.llm import decontam, mixing, ngram_join, quality, token_planes
from effectlake.llm.common import stored, table, work_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier accepts.  Null and empty texts are scored like any other; repeated rows fare alike; no rows give none."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at a Jaccard similarity of 0.8.  Null and wordless texts are linked with nothing and stay; rows of one id stay or go together, and those without an id stay."""
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item.  Null and wordless texts stay; repeated rows fare alike; a benchmark without words drops nothing."""
    return decontam.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.  Null and wordless texts have no size and are not taken; a null source is one of its own; repeated rows have copies of their own."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token planes and returns doc_id, start, n_tokens and ids_crc32 as read back.  A null text has the end id alone; null ids come first; copies of a row each have their tokens."""
    return token_planes.encode_and_read(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]
#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's rows written as Parquet and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), work_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"{scratch}/{k}-{name}")
    return docs
