"""Queries of the operators of this package over the whole tables, as (spark, folder) -> DataFrame."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, divergence, hnsw, html_extract, langid, license_scan, line_dedup, lloyd, mixing, secret_scan, simhash,
               substring, toxicity)
from .common import crc_mod, read_table
from .oracles import ORACLES  # noqa: F401  (SQL of those results that SQL can express)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the sources' token targets."""
    return (mixing.mix(read_table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken", "copies"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find secrets in every document."""
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for toxicity."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("evidence.id").alias("evidence"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap."""
    return decontam.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.Model(langid.sample_texts(langid.learnable(docs)))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, freed of repeated lines."""
    return line_dedup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every document for license statements."""
    return license_scan.scan(read_table(spark, sf_dir, "documents")).drop("detections")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings with the same label."""
    d = hnsw.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.93)
    return d.select("vec_id", "n_links", F.col("component").alias("component_id"),
                    (F.col("vec_id") == F.col("component")).alias("kept"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_extract.extract(pages, html_extract.fit(pages), text_col="text")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate components of all documents."""
    d = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("component").alias("component_id"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of the sources of each language over all documents."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, freed of repeated runs of 20 words."""
    out = substring.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings."""
    return lloyd.cluster(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_secrets": op2_secrets,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_language": op5_language,
    "op6_line_dedup": op6_line_dedup,
    "op7_licenses": op7_licenses,
    "op8_hnsw": op8_hnsw,
    "op9_html": op9_html,
    "op10_simhash": op10_simhash,
    "op11_divergence": op11_divergence,
    "op12_substring": op12_substring,
    "op13_lloyd": op13_lloyd,
}
