"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again.
All stages but the last return the columns of documents.

Null and empty texts, and texts without a letter, go at the first stage. Rows with a null id are linked with nothing, share one
draw in the mix and come first in the token files. Rows that repeat an id are one document to the second stage, which keeps one of them; ties
of equal rows in the mix are taken one by one. Columns that bear the names of a stage's own results travel through it unchanged. Texts of any
length are read whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesseral.llm import decontaminate, langid, mixing, ngram_join, token_store
from tesseral.llm.queries import piece_file, tokenizer_file
from tesseral.llm.work import Scratch

#: Least posterior of a language that a document must have to stay.
LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no certain language, go."""
    taken = docs.withColumnsRenamed({"lang_pred": "_own_pred", "lang_score": "_own_score"})
    found = langid.classify(taken, langid.train(docs, piece_file()))
    found = found.filter((found.lang_pred != langid.UNKNOWN) & (found.lang_score >= LANGUAGE_SCORE))
    return found.drop("lang_pred", "lang_score").withColumnsRenamed({"_own_pred": "lang_pred", "_own_score": "lang_score"}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays."""
    return ngram_join.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a hit word go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_copies(mixing.mix(docs), docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in the file format, read back."""
    return token_store.tokens_of(docs, tokenizer_file(), literal=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
    ("token_ids", token_ids),
]

#: Language ID and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table is dropped when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if before is not None:
            scratch.drop(before)
        before = f"{i}-{name}"
    return docs
