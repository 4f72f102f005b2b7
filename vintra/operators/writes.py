"""Insert, upsert and scoring semantics as joins that return the new rows or the new table. Tables stay append-only or are
rewritten as a whole (or by partition); nothing is updated in place."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintra.sources.scratch import Scratch


def _matches(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    """Null-safe equality of keys: a null key value is a value."""
    out = F.lit(True)
    for k in key:
        out = out & a[k].eqNullSafe(b[k])
    return out


def last_wins(incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, the one with the largest order."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return incoming.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def insert_absent(table: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The incoming rows whose key the table lacks: what an idempotent append writes. Running it again writes nothing."""
    return incoming.join(table, _matches(incoming, table, key), "left_anti")


def upsert(table: DataFrame, incoming: DataFrame, key: list[str], keep: Column | None = None) -> DataFrame:
    """The whole table afterwards. keep: a condition on the old row `o` and the new row `n` under which the old one stays."""
    columns = table.columns
    old = table.select(F.struct(*columns).alias("o"), *[F.col(k).alias(f"o_{k}") for k in key])
    new = incoming.select(F.struct(*columns).alias("n"), *[F.col(k).alias(f"n_{k}") for k in key])
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}"))
    both = old.join(new, on, "full")
    winner = F.when(F.col("n").isNull(), F.col("o"))
    if keep is not None:
        winner = winner.when(F.col("o").isNotNull() & keep, F.col("o"))
    return both.select(winner.otherwise(F.col("n")).alias("r")).select("r.*")


def upsert_status(table: DataFrame, incoming: DataFrame, key: list[str], values: list[str], order: str | None = None) -> DataFrame:
    """incoming with status inserted, updated or unchanged, by null-safe comparison of values. order: of rows with one key the last one counts."""
    incoming = incoming if order is None else last_wins(incoming, key, order)
    seen = table.select(*[F.col(k).alias(f"o_{k}") for k in key], F.struct(*values).alias("_old"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_old.{v}"))
    status = F.when(F.col("_old").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return incoming.join(seen, on, "left").withColumn("status", status).drop("_old", *[f"o_{k}" for k in key])


def guarded_upsert(table: DataFrame, incoming: DataFrame, key: list[str], by: str = "classified_by") -> DataFrame:
    """upsert() in which an automatic row never replaces a manual one."""
    return upsert(table, incoming, key, keep=(F.col(f"o.{by}") != "auto") & (F.col(f"n.{by}") == "auto"))


def numbered_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' numbers from 1 in an order: ranges are sorted and written, and each range's numbers follow the sizes of those before it."""
    scratch = Scratch(df.sparkSession)
    at = F.monotonically_increasing_id()
    rows = scratch.save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranges")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # a row for each range
    starts = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return rows.join(starts, part == F.col("_part")).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_first", "_before")


def get_or_create(table: DataFrame, wanted: DataFrame, key: list[str], id_column: str) -> tuple[DataFrame, DataFrame]:
    """(wanted rows with their ids, the rows to append). New ids follow the largest one, in the order of the key."""
    fresh = insert_absent(table, wanted.dropDuplicates(key), key)
    top = table.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("top"))
    numbered = numbered_rows(fresh, [F.col(k).asc_nulls_first() for k in key], "_no").crossJoin(F.broadcast(top)).withColumn(id_column, F.col("top") + F.col("_no")).drop("top", "_no")
    all_ids = table.select(id_column, *key).unionByName(numbered.select(id_column, *key))
    out = wanted.join(all_ids.select(id_column, *[F.col(k).alias(f"i_{k}") for k in key]), _renamed(key))
    return out.drop(*[f"i_{k}" for k in key]), numbered


def _renamed(key: list[str]) -> Column:
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"i_{k}"))
    return on


def gapless_through(days: DataFrame, keys: list[str], day: str, marks: DataFrame | None = None) -> DataFrame:
    """(keys, through): the last day up to which a key's days follow each other without a gap, from its first day on, or from its mark.

    marks (keys, through): how far a key had come; days after it extend the mark as long as the next one is there, and a key without new days keeps
    its mark. Days that repeat count once and null days don't count. A key's distinct days are ordered in one window: a calendar's length at most.
    """
    seen = days.where(F.col(day).isNotNull()).select(*keys, F.col(day).cast("date").alias("_day")).distinct()
    if marks is not None:
        old = marks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("through").alias("_through"))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        later = seen.join(old, on, "left").where(F.col("_through").isNull() | (F.col("_day") > F.col("_through"))).select(*keys, "_day")
        seen = later.unionByName(marks.select(*keys, F.col("through").alias("_day")))
    w = Window.partitionBy(*keys).orderBy("_day")
    island = F.date_sub("_day", F.row_number().over(w))
    runs = seen.withColumn("_island", island).groupBy(*keys, "_island").agg(F.max("_day").alias("_last"))
    return runs.groupBy(*keys).agg(F.min_by("_last", "_island").alias("through"))


def live_rows(pulled: DataFrame, stored: DataFrame) -> DataFrame:
    """Of pulled (series_id, observed_at, as_of, value, reconstructed) what is worth storing: values above zero that are a
    backfill of an unknown period, or a live row that is new, changed, or confirms what was only reconstructed."""
    w = Window.partitionBy("series_id", "observed_at").orderBy(F.desc("as_of"))
    last = stored.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select("series_id", "observed_at", F.col("value").alias("old"), F.col("reconstructed").alias("old_reconstructed"))
    joined = pulled.where("value > 0").join(last, ["series_id", "observed_at"], "left")
    new = F.col("old_reconstructed").isNull()
    live = ~F.col("reconstructed") & (new | ~F.col("value").eqNullSafe(F.col("old")) | F.col("old_reconstructed"))
    return joined.where((F.col("reconstructed") & new) | live).drop("old", "old_reconstructed")
