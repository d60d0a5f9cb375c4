"""Corpus pipeline: documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontam, langid, line_dedup, mixing, simhash
from ledgerlens.llm.common import read_table
from ledgerlens.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language: those without a letter (``und``) go."""
    model = langid.Model(langid.sample_texts(langid.learnable(docs)))
    return (langid.identify(docs, model).filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each group of like lines stays once; documents that are left without a word go."""
    out = line_dedup.dedup(docs, drop_emptied=True)
    n_chars = F.length("text").cast("long").alias("n_chars")
    return out.select(*[n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id. Groups are of
    texts: rows that share an id only are no copies, and rows without an id take part."""
    return simhash.one_of_each_group(docs, shingle=4, max_bits=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item overlaps."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document it takes, ``copy`` from 1, with
    its source's ``target`` (words) and the document's ``size`` (these three in place of
    columns of the same names). Rows alike in all columns are one document that may be
    taken as often as all of them together."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.xxhash64(F.lit(1), *columns).alias("a"), F.xxhash64(F.lit(2), *columns).alias("b"))
    plan = mixing.mix(docs.select(key.alias("key"), "source", "text"), id_col="key")
    copies = plan.groupBy("key").agg(F.sum("copies").alias("copies"), F.min("size").alias("size"), F.min("target").alias("target")).filter("copies > 0")
    one = docs.select(key.alias("key"), F.struct(*columns).alias("row")).groupBy("key").agg(F.first("row").alias("row"))
    taken = one.join(copies, "key").select("row", "size", "target", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return taken.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("size", "target", "copy")], "size", "target", "copy")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies),
          ("decontaminate", decontaminate), ("mix", mix)]

#: SQL can express neither the fitted language model nor the fingerprints; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``; each result is a
    Parquet table in the shared folder of ``spark.checkpoint.dir``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
