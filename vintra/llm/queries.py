"""One query for each operator of this subpackage, over whole tables, with the SQL that DuckDB runs where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintra.llm import conversations, decontamination, exact_dedup, html_text, line_dedup, merkle, mixing, packing, quality, recurrent_lm, simhash, surrogates, toxicity
from vintra.llm.common import Scratch, lower_ascii, partitions, shared_dir


#: Stands for the key that a deployment keeps secret.
KEY = b"replace this key"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(documents(spark, sf_dir), KEY).select("doc_id", "text", "n_entities", "kinds")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo divisor."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(5) != 0)
    docs = documents(spark, sf_dir)
    trees = quality.learn(docs, labels, "quality")
    return quality.score(docs, trees).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.learn(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.graded(documents(spark, sf_dir), model).select("doc_id", "severity", "toxic", (F.col("toxic") >= toxicity.REJECT).alias("rejected"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_lines", F.size("dropped").alias("n_dropped"), F.size(F.filter("dropped", lambda x: x["near"])).alias("n_near"), F.col("dropped.line_no").alias("dropped_lines"), F.col("dropped.keep_doc").alias("keep_ids"), F.length("text").alias("chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recurrent_lm.log_likelihoods(documents(spark, sf_dir), remainder(7) != 2)
    return out.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}", max(16, partitions(spark)))
    return index.add(documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if not vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(spark)
    pieces = packing.pack(documents(spark, sf_dir), vocabulary).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    out = packing.with_steps(scratch.save(pieces, "pieces"), scratch)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("window").cast("long").alias("window"), "step")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.digest_of(*columns[:4], lower_ascii(F.col("text"))))
    out = merkle.verified(documents(spark, sf_dir), "lang", "doc_id", merkle.digest_of(*columns), claim)
    text = lambda c: F.lower(F.hex(c))
    return out.select(F.col("key").alias("doc_id"), *[text(c).alias(c) for c in ("leaf", "subroot", "root")], text("proof").alias("proof_sha256"), text("folded_root").alias("folded_root"), "verified")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = conversations.damaged(given)
    found = Scratch(spark).save(conversations.audits(turns), "audits")
    digests = conversations.repaired_digests(turns, found)
    both = found.join(digests.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id"))).drop("id").withColumnRenamed("conv_id", "id")
    out = given.select("conv_id").distinct().join(both, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

OP7_SQL = rf"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_CLASS}'))::BIGINT AS size,
         (('0x' || substr(md5('7:' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
limits AS (
  SELECT source, source_size, source_size * 3.0::DOUBLE AS most,
         (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight
  FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER w, 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM limits WINDOW w AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(most, weight * (SELECT arg_min(level, most / weight) FROM levels WHERE most / weight >= level)) AS target FROM levels),
ranked AS (
  SELECT r.*, source_size, target, floor(least(target / source_size, 3.0)) AS whole, least(target / source_size, 3.0) - floor(least(target / source_size, 3.0)) AS p
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
odds AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1.0 - u)) * (1.0 - p) / p ELSE NULL END AS o, target - sum(size * whole) OVER (PARTITION BY source) AS need FROM ranked),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY o / (1.0 + o), doc_id ROWS UNBOUNDED PRECEDING) AS up_to FROM odds)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN p > 0 AND up_to - size / 2 <= need THEN 1 ELSE 0 END))::BIGINT AS taken FROM summed
"""

OP10_SQL = rf"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY digest)::BIGINT AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, digest AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '{SPACE_CLASS}', '', 'g')) AS digest FROM documents)
WINDOW w AS (PARTITION BY digest ORDER BY chars DESC, doc_id)
"""

QUERIES = {"op1_surrogates": op1_surrogates, "op2_html_text": op2_html_text, "op3_quality": op3_quality, "op4_toxicity": op4_toxicity, "op5_decontamination": op5_decontamination, "op6_line_dedup": op6_line_dedup, "op7_mixing": op7_mixing, "op8_recurrent_lm": op8_recurrent_lm, "op9_simhash": op9_simhash, "op10_exact_dedup": op10_exact_dedup, "op11_packing": op11_packing, "op12_merkle": op12_merkle, "op13_conversations": op13_conversations}
ORACLE = {"op7_mixing": OP7_SQL, "op10_exact_dedup": OP10_SQL}
