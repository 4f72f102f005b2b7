"""Near-duplicate lines by a deletion-neighbourhood join.

The unit is the word and the bound is one edit: two lines link if one word inserted, deleted or replaced turns one into
the other. Equal lines are first reduced to one row each. A line then emits the hash of itself and of every variant with
one word left out; replacing a word leaves both lines with the same variant at the same place, inserting one leaves the
longer line with a variant that is the shorter line. Equal variants are joined, each group only to its earliest line, so
that a group of a million lines which differ in one word gives a million pairs and not all pairs. Pairs are verified word
by word, and a line goes if any earlier line is within the bound.

Most lines have no such partner. As one edit leaves a line's first or last half as it is, a line whose halves no other
line has (as a prefix or suffix of the same number of words) emits no variants; this loses no pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintra.llm.common import LOWER_BYTES, Scratch, free

#: Odd multiplier of the rolling hash over word hashes, modulo 2**64 (a fixed value).
BASE = 0x9E3779B97F4A7C15
LAST = 2**63 - 1


def words_of(line: bytes) -> list[bytes]:
    return line.translate(LOWER_BYTES).split()


def half_keys(words: list[bytes]) -> list[int]:
    """Hashes of the prefixes and suffixes of half the words; also of half of one word fewer, for a partner without one."""
    n, keys = len(words), []
    for h in {n // 2, (n - 1) // 2}:
        for side, part in ((b"<", words[:h]), (b">", words[n - h :])):
            keys.append(xxhash.xxh64_intdigest(side + b" ".join(part), h))
    return keys


def variant_keys(words: list[bytes]) -> np.ndarray:
    """The hash of the whole line, then of the line without word 0, 1, ...: linear in the words by two running sums."""
    n = len(words)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]), dtype=np.uint64)
    whole = h * power[n - 1 :: -1][:n]
    before = np.zeros(n, np.uint64)
    if n > 1:
        before[1:] = np.cumsum(h[:-1] * power[n - 2 :: -1][: n - 1], dtype=np.uint64)
    total = np.add.reduce(whole, dtype=np.uint64)
    without = before + (total - np.cumsum(whole, dtype=np.uint64))
    return np.concatenate([[total + np.uint64(n) * np.uint64(31)], without + np.uint64(n - 1) * np.uint64(31)])


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one word inserted, deleted or replaced turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    return head + tail >= max(len(a), len(b)) - 1


def read_lines(docs: DataFrame, min_words: int, fuzzy_words: int) -> DataFrame:
    """(doc_id, line_no, digest, keys): lines of at least min_words; keys only of those that may be within an edit of fuzzy_words."""
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, digests, keys = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                for k, line in enumerate((text.as_py() or b"").split(b"\n")):
                    words = words_of(line)
                    if len(words) >= min_words:
                        ids.append(doc_id)
                        numbers.append(k)
                        digests.append(hashlib.md5(b" ".join(words)).digest())
                        keys.append([x - (1 << 64) if x >> 63 else x for x in half_keys(words)] if len(words) >= fuzzy_words - 1 else [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, numbers, digests, keys), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line_no int, digest binary, keys array<long>")


def emit_variants(candidates: DataFrame) -> DataFrame:
    """(line_id, line) -> (key, pos, line_id, fresh): pos -1 for the line itself, else the word left out. Leaving out any word of
    a run of equal words gives the same variant; it is fresh at the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line_id, line in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = line.as_py().split()
                keys = variant_keys(words).view(np.int64)
                fresh = [True, True, *(a != b for a, b in zip(words, words[1:], strict=False))]
                columns = [pa.array(keys), pa.array(np.arange(-1, len(keys) - 1, dtype=np.int32)), pa.array(np.full(len(keys), line_id, np.int64)), pa.array(fresh)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "pos", "line_id", "fresh"])

    return candidates.select("line_id", "line").mapInArrow(in_blocks(run), "key long, pos int, line_id long, fresh boolean")


def in_blocks(run, rows: int = 1 << 16):
    """Joins small record batches into larger ones."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def candidate_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, line_no, digest) of wanted, with the normalised text as line."""
    at = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "digest")).alias("at"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, digests, lines = [], [], [], []
            for doc_id, text, places in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                split = text.as_py().split(b"\n")
                for p in places:
                    # rows that repeat a doc_id with another text have other lines at that place
                    if p["line_no"] < len(split) and hashlib.md5(line := b" ".join(words_of(split[p["line_no"]]))).digest() == p["digest"]:
                        ids.append(doc_id)
                        numbers.append(p["line_no"])
                        digests.append(p["digest"])
                        lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary()), pa.array(lines, pa.binary())], names=["doc_id", "line_no", "digest", "line"])

    joined = texts.join(at, texts["id"].eqNullSafe(at["doc_id"])).select("doc_id", "text", "at")
    return joined.mapInArrow(run, "doc_id long, line_no int, digest binary, line binary").dropDuplicates(["digest"])


def verified(pairs: DataFrame, fuzzy_words: int) -> DataFrame:
    """Those of (later, earlier, later_line, earlier_line) within one edit, the longer of which has fuzzy_words."""

    def near(a: list[bytes], b: list[bytes]) -> bool:
        return max(len(a), len(b)) >= fuzzy_words and one_edit(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            keep = pa.array([near(x.split(), y.split()) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["later", "earlier"]).filter(keep)

    return pairs.mapInArrow(run, "later long, earlier long")


def near_lines(docs: DataFrame, distinct: DataFrame, fuzzy_words: int, scratch: Scratch) -> DataFrame:
    """(digest, keep_doc, keep_line): distinct lines with an earlier line within one edit, and the earliest such line."""
    halves = distinct.select("digest", F.explode("keys").alias("key"))
    shared = scratch.save(halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    digests = scratch.save(halves.join(shared, "key", "left_semi").select("digest").distinct(), "wanted")
    wanted = distinct.join(digests, "digest").select("first.doc_id", "first.line_no", "digest")
    # sorted by place, so that a smaller line_id is an earlier line
    placed = candidate_lines(docs, wanted).orderBy(F.col("doc_id").asc_nulls_last(), "line_no")
    lines = scratch.save(placed.withColumn("line_id", F.monotonically_increasing_id()), "candidates")
    variants = scratch.save(emit_variants(lines), "variants")
    replaced = scratch.save(variants.where("pos >= 0").groupBy("key", "pos").agg(F.min("line_id").alias("earlier"), F.max("line_id").alias("last")).where("earlier < last").drop("last"), "replaced")
    one = variants.join(replaced, ["key", "pos"]).where("line_id > earlier").select(F.col("line_id").alias("later"), "earlier")
    longer = variants.where("pos >= 0 and fresh").select("key", F.col("line_id").alias("long_id"))
    other = variants.where("pos = -1").select("key", "line_id").join(longer, "key").where("line_id <> long_id").select(F.greatest("line_id", "long_id").alias("later"), F.least("line_id", "long_id").alias("earlier"))
    pairs = scratch.save(one.unionAll(other).distinct(), "pairs")
    texts = lines.select("line_id", "line")
    with_lines = pairs.join(texts.select(F.col("line_id").alias("later"), F.col("line").alias("later_line")), "later").join(texts.select(F.col("line_id").alias("earlier"), F.col("line").alias("earlier_line")), "earlier").select("later", "earlier", "later_line", "earlier_line")
    first = scratch.save(verified(with_lines, fuzzy_words).groupBy("later").agg(F.min("earlier").alias("earlier")), "near")
    at = lines.select("line_id", "doc_id", "line_no", "digest")
    out = first.join(at.select(F.col("line_id").alias("later"), "digest"), "later").join(at.select(F.col("line_id").alias("earlier"), F.col("doc_id").alias("keep_doc"), F.col("line_no").alias("keep_line")), "earlier")
    out = scratch.save(out.select("digest", "keep_doc", "keep_line"), "near-lines")
    scratch.drop(variants, pairs, replaced, lines)
    return out


def repeated_lines(docs: DataFrame, min_words: int = 1, fuzzy_words: int = 8) -> DataFrame:
    """doc_id, line_no, keep_doc, keep_line, near: each line of docs (doc_id, text) that repeats an earlier one.

    Lines end at \\n and compare by their words, A-Z lower-cased. Earlier: smaller doc_id (null last), then line_no. A line
    of at least min_words, one by default, that an equal line precedes repeats the first of these. One that a line within one
    edit precedes repeats the earliest such line (near), and so does each line equal to it; the bound is one edit in fuzzy_words
    words, so the longer of the two has that many: of lines of one or two words every two would be within an edit.
    Lines without words never repeat anything. Null texts have no lines.
    Rows that repeat a doc_id count as one document. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    lines = scratch.save(read_lines(docs, min_words, fuzzy_words), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    distinct = scratch.save(lines.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first("keys").alias("keys")), "distinct")
    near = near_lines(docs, distinct, fuzzy_words, scratch)
    verdict = scratch.save(
        distinct.join(near, "digest", "left").where("keep_line is not null or first <> last").select("digest", F.coalesce("keep_doc", "first.doc_id").alias("keep_doc"), F.coalesce("keep_line", "first.line_no").alias("keep_line"), F.col("keep_line").isNotNull().alias("near")), "verdict"
    )
    return lines.select("doc_id", "line_no", "digest").join(verdict, "digest").where("near or not (doc_id <=> keep_doc and line_no = keep_line)").select("doc_id", "line_no", "keep_doc", "keep_line", "near")


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with text as it stays without its repeated lines, and n_lines, dropped (line_no, keep_doc, near) beside it; all rows stay.

    A document that only repeats others has an empty text then. Columns of docs called n_lines or dropped give way.
    """
    scratch = Scratch(docs.sparkSession)
    by_doc = scratch.save(repeated_lines(docs, **options).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("line_no", "keep_doc", "near"))).alias("dropped")), "by-document")
    rest = docs.drop("n_lines", "dropped")
    id_ = free("dropped_id", rest)
    by_doc = by_doc.withColumnRenamed("doc_id", id_)
    joined = rest.join(by_doc, rest["doc_id"].cast("long").eqNullSafe(by_doc[id_]), "left").drop(id_)
    lines, n = F.split("text", "\n"), F.size(F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), "dropped.line_no")
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return joined.withColumn("n_lines", F.coalesce(n, F.lit(0))).withColumn("text", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept)).withColumn("dropped", F.coalesce("dropped", F.array().cast("array<struct<line_no:int,keep_doc:bigint,near:boolean>>")))
