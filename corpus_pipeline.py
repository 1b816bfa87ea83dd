"""The corpus pipeline: five stages from raw documents to token files.

Each stage takes ``(spark, docs, sf_dir)``, works on everything the stage before
it kept, and returns a DataFrame that is written as Parquet and read back as the
next stage's ``docs``. All but the last keep the columns of ``documents``; the
last returns one row per remaining document, and per copy that the mix made of
it, from the token files. Null ids and
texts, repeated rows and empty tables are treated as each operator's docstring
says: blank text scores 0 for quality and goes, rows equal in id and text count
as one document.

No SQL expresses the trained classifier and the group search, so there is no
oracle; tests compare every stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermesh.llm import crf, decontam, minhash, raking, rans
from ledgermesh.llm.common import discard, load, tidied
from ledgermesh.llm.queries import tokenizer_path

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the line-labelling classifier scores below 0.3."""
    return crf.drop_low_quality(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked at similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth of the words or more come from a
    benchmark window."""
    return decontam.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents at rates raked to source, language and topic targets;
    documents of cells wanted more than once are repeated."""
    return raking.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what reading them back yields."""
    return rans.encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. What a stage writes on its way, and its input
    once it has been read, is deleted."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, tidied(f"pipeline-{name}", lambda: stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return docs
