"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import balance, bpe, decontaminate, edit_fingerprints, hard_negatives, media, paragraphs, pii, simhash, token_alignment, token_files, toxicity, warc
from ._shared import table


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; the files aren't part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.shard_documents(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.negatives_report(table(spark, sf_dir, "embeddings"))


def op13_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


QUERIES = {"op1_warc": op1_warc, "op2_media": op2_media, "op3_token_files": op3_token_files, "op4_toxicity": op4_toxicity, "op5_paragraphs": op5_paragraphs, "op6_simhash": op6_simhash, "op7_sharding": op7_sharding, "op8_bpe": op8_bpe, "op9_decontamination": op9_decontamination, "op10_pii": op10_pii, "op11_token_alignment": op11_token_alignment, "op12_hard_negatives": op12_hard_negatives, "op13_edit_fingerprints": op13_edit_fingerprints}
#: The other operators train, hash or merge in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL = {"op1_warc": warc.ORACLE_SQL, "op9_decontamination": decontaminate.ORACLE_SQL, "op10_pii": pii.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL}
