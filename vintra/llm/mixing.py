"""Mixing sources to target weights by Pareto order sampling, in words.

A document's wanted copies are target / source size, times its own weight if it has one. Their whole part is certain;
the fraction is its inclusion probability p for one more. With a hashed uniform u, documents of a source rank by
(u / (1 - u)) / (p / (1 - p)), and the first of them are taken until the words reach what the whole copies leave of the
target. The cut is found from sums over two levels of rank cells, so no source is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintra.llm.common import Scratch, word_count

CELLS = 1024
#: Above so many sources their targets are joined instead of broadcast.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size) -> with target: weights repeat over the sources by code point, null last; what a target has above
    `most` times its source goes to the others by weight until none is above.

    With sources in order of most * size / weight, those before the first that its level (rest of the sum / rest of the
    weights) doesn't fill are at their limit; all others get their weight times that level. One row a source: a small table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    limits = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most))
    total = Window.partitionBy()
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(total) * F.lit(float(share)) - F.coalesce(F.sum("most").over(filled), F.lit(0.0))
    left = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    levels = limits.withColumn("level", rest / left)
    level = F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct(F.col("most") / F.col("weight"), "level"))).over(total)["level"]
    return levels.withColumn("at", F.coalesce(level, F.lit(float("inf")))).select("source", "source_size", F.least(F.col("most"), F.col("weight") * F.col("at")).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from 48 bits of an MD5; the same in every run."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 7, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, text, source).

    size: words of the text, 0 for null or empty; such rows are taken or not like others, with taken 0. copies: times the
    mix takes the document, at most `most`. Rows that repeat a doc_id within a source are taken together. A null source is a
    source like any other, the last one. weight: wanted copies relative to other documents of the source, 0 or more, 1 if
    not given; whole copies stay under `most`. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("wish"), uniform(F.col("doc_id"), seed).alias("u")), "sizes")
    sums = scratch.save(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("wish")).alias("wished"), F.count("*").alias("n")), "sums")
    plan = scratch.save(targets(sums.select("source", "source_size"), weights, share, most).alias("t").join(sums.select(F.col("source").alias("s"), "wished"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    side = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    ratio = F.least(F.col("wish") * F.coalesce(F.try_divide("target", "wished"), F.lit(0.0)), F.lit(float(most)))
    ranked = rows.join(side.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("ratio", ratio).drop("s", "wished", "wish").withColumn("whole", F.floor("ratio")).withColumn("p", F.col("ratio") - F.col("whole"))
    # odds in (0, inf) as rank in (0, 1): 0 is taken first, 1 never
    odds = (F.col("u") / (1.0 - F.col("u"))) * (1.0 - F.col("p")) / F.col("p")
    ranked = scratch.save(ranked.withColumn("rank", F.when(F.col("p") > 0, odds / (1.0 + odds)).otherwise(1.0)), "ranked")
    taken = cut(ranked, scratch)
    copies = F.col("whole").cast("long") + F.when((F.col("p") > 0) & ((F.col("rank") < F.col("cut")) | ((F.col("rank") == F.col("cut")) & (F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)) <= F.col("cut_id")))), 1).otherwise(0)
    side = F.broadcast(taken) if plan.count() <= BROADCAST_SOURCES else taken
    out = ranked.join(side, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("copies", F.coalesce(copies, F.col("whole").cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def cut(ranked: DataFrame, scratch: Scratch) -> DataFrame:
    """(s, cut, cut_id): the last rank and doc_id that each source takes besides whole copies."""
    left = ranked.where("p > 0")
    need = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("need")).withColumnRenamed("source", "s")
    cell = F.least(F.floor(F.col("rank") * CELLS), F.lit(CELLS - 1)).cast("int")
    fine = F.least(F.floor((F.col("rank") * CELLS - cell) * CELLS), F.lit(CELLS - 1)).cast("int")
    left = left.select("source", "doc_id", "size", "rank", cell.alias("cell"), fine.alias("fine"))
    found = scratch.save(need.select("s", "need", F.lit(0).cast("double").alias("before")), "need")
    for level, keys in (("cell", []), ("fine", ["cell"])):
        at = [F.col("source").eqNullSafe(F.col("s")), *[F.col(f"f_{k}") == F.col(k) for k in keys]]
        inside = left.join(F.broadcast(found) if found.count() <= BROADCAST_SOURCES else found, at)
        sums = inside.groupBy("s", "need", "before", *keys, level).agg(F.sum("size").alias("words"))
        up_to = F.col("before") + F.sum("words").over(Window.partitionBy("s").orderBy(level))
        # the first cell that reaches the need, else the last one
        found = scratch.save(
            sums.withColumn("up_to", up_to).withColumn("short", F.col("up_to") < F.col("need")).withColumn("top", F.max(level).over(Window.partitionBy("s"))).where(f"not short or {level} = top")
            .groupBy("s", "need").agg(F.min(F.struct(level, *[F.col(k) for k in keys], (F.col("up_to") - F.col("words")).alias("before"))).alias("x"))
            .select("s", "need", "x.before", *[F.col(f"x.{k}").alias(f"f_{k}") for k in [level, *keys]]), f"found-{level}",
        )
    at = [F.col("source").eqNullSafe(F.col("s")), F.col("cell") == F.col("f_cell"), F.col("fine") == F.col("f_fine")]
    last = left.join(F.broadcast(found) if found.count() <= BROADCAST_SOURCES else found, at).groupBy("s", "need", "before", "rank", F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("id")).agg(F.sum("size").alias("words"))
    up_to = F.col("before") + F.sum("words").over(Window.partitionBy("s").orderBy("rank", "id"))
    # a document is in if the words up to it are nearer to the need with it than without
    nearer = last.withColumn("up_to", up_to).where("up_to - words / 2 <= need")
    edge = found.select("s", (F.col("f_cell") / F.lit(float(CELLS)) + F.col("f_fine") / F.lit(float(CELLS * CELLS))).alias("edge"))
    picked = nearer.groupBy("s").agg(F.max(F.struct("rank", "id")).alias("x")).select("s", "x.rank", "x.id")
    # none in the cell is in: all below the cell are
    return scratch.save(edge.alias("e").join(picked.alias("q"), F.col("e.s").eqNullSafe(F.col("q.s")), "left").select("e.s", F.coalesce("q.rank", "edge").alias("cut"), F.coalesce("q.id", F.lit(-(2**63))).alias("cut_id")), "cut")
