"""A training-data pipeline over documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintra.llm import decontamination, line_dedup, mixing, simhash, toxicity
from vintra.llm.common import WORD, Scratch, free


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled ones rejects go.

    Null and empty texts have the severity of no words, and rows with a null doc_id or one that repeats are graded each for itself; a
    severity at the bound is rejected. Without labels none goes.
    """
    model = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.graded(docs, model).where(F.col("toxic") < toxicity.REJECT).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier document's go, and documents that had nothing else."""
    out = line_dedup.drop_repeated_lines(docs)
    left = out.where((F.size("dropped") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles at least 0.8 similar."""
    return simhash.drop_near_duplicates(docs, shingle=5, least=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited ones too, go.

    Null and empty texts and rows with a null doc_id stay; rows that repeat a doc_id go together. No items: none goes.
    """
    found = decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    id_ = free("gone_id", docs)
    gone = Scratch(spark).save(found.select(F.col("doc_id").alias(id_)).distinct(), "leaks")
    return docs.join(gone, docs["doc_id"].cast("long") == gone[id_], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken beside them.

    A document's column of such a name keeps it, and the mix's gets an underscore. Null and empty texts have no words and are taken or not like others; a
    null source is a source. Rows that repeat a doc_id within a source are taken together, a null doc_id is one.
    """
    made = [c for c in ("size", "source_size", "target", "copies", "taken")]
    names = {c: free(c, docs) for c in made} | {c: free(f"mix_{c}", docs) for c in ("doc_id", "source")}
    shares = mixing.mix_sources(docs).where("copies > 0").select("doc_id", "source", *made).withColumnsRenamed(names).dropDuplicates([names["doc_id"], names["source"]])
    at = docs["doc_id"].cast("long").eqNullSafe(shares[names["doc_id"]].cast("long")) & docs["source"].eqNullSafe(shares[names["source"]])
    return docs.join(shares, at).drop(names["doc_id"], names["source"])


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix)]

#: The models and alignments of these stages can't be said in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
