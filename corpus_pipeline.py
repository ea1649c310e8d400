"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs.
All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import bpe, jaccard, mixing, pii, quality
from scanloom.llm.words import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts fail them; repeated rows stay repeated; null ids are as good as others."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Of rows that are equal in all columns one stays; rows with one id and other texts are
    one document of the join and stay together; documents without an id aren't joined.
    """
    groups = jaccard.jaccard_join(docs).where("component_id <> doc_id").select("doc_id").distinct()
    # Equal rows have equal ids, so the second step needs no shuffle of its own.
    known = docs.where("doc_id is not null").join(groups, "doc_id", "left_anti").select(docs.columns).dropDuplicates(docs.columns)
    return known.unionByName(docs.where("doc_id is null").dropDuplicates(docs.columns))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data. Null texts stay null; equal rows stay equal; no row is added or lost."""
    out = pii.replace_pii(docs, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents as often as they are taken, cut where a part of one is taken. Texts without a word are taken 0 times;
    rows are mixed one by one, whatever their ids; an empty table gives an empty mix."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix, and digests of them and of what they decode to. A null text encodes as an empty one."""
    return bpe.digests(bpe.encode_documents(docs, bpe.public_vocabulary()), "ids_le")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Near copies, keyed surrogates and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
