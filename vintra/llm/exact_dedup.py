"""Exact deduplication against a persistent digest index that is bucketed and sorted by the digest.

The index is a Parquet table at a path of its own: one row per digest, clustered into a fixed number of buckets and
sorted inside each. New data is reduced to one row per digest first (partial aggregation before the shuffle, so a text
that fills a third of the table costs one row per task), sort-merge anti-joined against the index, and appended. The
bucketed side isn't shuffled. A batch that is run again finds its own digests and gives the same answer.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintra.llm.common import SPACES, Scratch


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


class DigestIndex:
    """A persistent set of SHA-256 digests with the document that each came from."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """Opens the index at path, or makes an empty one. buckets is fixed when the index is made, and kept beside it; an index
        that has another number is refused."""
        made = f"{path.rstrip('/')}-buckets"
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("ignore").parquet(made)
        if (has := spark.read.parquet(made).first()["buckets"]) != buckets:
            raise ValueError(f"the index at {path} has {has} buckets, not {buckets}")
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digests_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, keep_chars BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds (doc_id, text) rows; returns doc_id, keep_id, group_size, kept, text_sha256 for each of them.

        keep_id: what the index holds for an equal text, else the row with the most code points, then the smallest
        doc_id (null last) of these rows. group_size: equal rows in this batch. kept: true for one row per new digest;
        of repeated rows with one doc_id any one. Empty and null texts are equal to each other. An empty table adds nothing.
        Other columns of docs are ignored, whatever their names.
        """
        scratch = Scratch(self.spark)
        rows = scratch.save(
            docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row")), "rows"
        )
        order = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        groups = scratch.save(rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("best")), "groups")
        fresh = groups.join(self.entries().hint("merge"), "digest", "left_anti").select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"))
        scratch.save(fresh, "fresh").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        known = scratch.save(groups.join(self.entries().hint("merge"), "digest").select("digest", "keep_id", "group_size", F.col("best.row").alias("best_row")), "known")
        scratch.drop(groups)
        return rows.join(known, "digest").select(
            "doc_id", "keep_id", "group_size", ((F.col("row") == F.col("best_row")) & F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )

    def compact(self) -> None:
        """Rewrites the index with one sorted file per bucket, as many appends leave several."""
        rows = Scratch(self.spark).save(self.entries(), "index")
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table, overwrite=True)
        self.spark.catalog.refreshTable(self.table)


def drop_exact_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs whose text the index didn't have before, one for each text, with all their columns.

    Of rows with one doc_id and different texts each is its own; of rows with one doc_id and equal texts a longest one stays. Null and empty
    texts are equal. No rows: no rows.
    """
    kept = index.add(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))
    own = docs.select(F.struct(*docs.columns).alias("r"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("own"))
    found = own.join(kept, F.col("r.doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")), "left_semi")
    return found.groupBy("own").agg(F.max_by("r", F.coalesce(F.length("r.text"), F.lit(0))).alias("r")).select("r.*")
