"""The queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm import ann, decontaminate, html_blocks, langid, mixing, ngram_join, quality_rules, secrets, token_store, url_rules
from tesseral.llm.sql import ORACLES
from tesseral.llm.work import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_spans(docs, _table(spark, sf_dir, "benchmark"))
    items = F.col("items")
    n_hit = decontaminate.hit_words(F.col("spans")).cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.link(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), html_blocks.train()).select("page_id", "url", "text", "n_chars")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    columns = "candidate string, before string, after string, path string, kind string, label int"
    labelled = spark.createDataFrame(secrets.labelled_findings(), columns)  # no table of the driver's has labelled findings
    found = secrets.scan(docs, secrets.train(secrets.Lexicon.from_pieces(piece_file()), labelled))
    return found.select("doc_id", F.inline("findings"))


#: The contract's rules.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_rules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    indexed = ann.index(points, Scratch(spark, "ann").path("index"))
    return ann.search(indexed, points.filter(F.col("vec_id") % 20 == 0))


def tokenizer_file() -> str:
    """The public vocabulary that the token queries use; the operator takes any tokenizer file with this pre-tokenization."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.classify(docs.select("doc_id", "text"), langid.train(docs, piece_file()))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, _table(spark, sf_dir, "labels"), ~langid.held_out(F.col("doc_id")))
    scored = quality_rules.score(docs, model)
    return scored.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality").alias("predicted"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.tokens_of(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(), literal=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mixing, op2_decontamination, op3_ngram_jaccard, op4_html_blocks, op5_secrets, op6_url_filter, op7_ann, op8_language, op9_quality, op10_token_ids]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
