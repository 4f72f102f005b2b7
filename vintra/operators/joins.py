"""Joins that Spark has no single operator for: backward as-of, theta on a calendar, one-to-one merge."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, value: str, strict: bool = False, within_days: int | None = None) -> DataFrame:
    """left with `value` and `right_at` of the last right row of the same key on or before (strict: before) its day.

    Both sides are united and ordered once by key and day; the last right row seen so far is carried on. Nothing is
    broadcast, and no pair but the wanted one is made. Null if there is none, or it is older than within_days.
    """
    extra = [c for c in left.columns if c not in by]
    one = left.select(*by, F.col(at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.schema[right_at].dataType).alias("_when"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.struct(*extra).alias("_row"))
    other = right.select(*by, F.col(right_at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.col(right_at).alias("_when"), F.col(value).alias("_value"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*by).orderBy("_at", "_side", F.col("_value").asc_nulls_first())
    seen = F.last(F.when(F.col("_when").isNotNull(), F.struct("_when", "_value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = one.unionAll(other).withColumn("_seen", seen).where("_row is not null")
    fresh = F.lit(True) if within_days is None else F.datediff(F.col("_at"), F.col("_seen._when")) <= within_days
    return out.select(*by, "_row.*", F.when(fresh, F.col("_seen._when")).alias(right_at if right_at not in left.columns else f"{right_at}_right"), F.when(fresh, F.col("_seen._value")).alias(value))


def merge_one_to_one(left: DataFrame, right: DataFrame, on: list[str], suffix: str) -> DataFrame:
    """Inner join that fails if a key occurs twice on a side; right's other columns get the suffix."""
    for side in (left, right):
        if side.groupBy(*on).count().where("count > 1").limit(1).count():
            raise ValueError(f"keys {on} aren't unique")
    return left.join(right.select(*on, *[F.col(c).alias(f"{c}{suffix}") for c in right.columns if c not in on]), on)


def spliced(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Both frames' rows; where a key is in both, the second's."""
    both = first.withColumn("_rank", F.lit(0)).unionByName(second.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("_rank"))
    return both.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_rank", "_nth")


def last_day_before(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Theta join of each left cutoff with all right rows published by then (right: published); for a left side that is a calendar."""
    return left.join(right, [*[left[c] == right[c] for c in by], right["published"] <= left["cutoff"]]) if by else left.join(right, right["published"] <= left["cutoff"])
