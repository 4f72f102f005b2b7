"""Questions asked, thresholds, outcomes and base rates."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintra.functions.calendar import months_after
from vintra.functions.scalar import significant
from vintra.operators.asof import first_live, first_releases, known, until

TOLERANCE = 1e-9


def planned(series: DataFrame, horizons: list[int], first: str, last: str) -> DataFrame:
    """Every series, month and horizon: a small product made by exploding, with its target date and key."""
    months = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("ask_date")
    out = series.select("series_id", "kind", months).select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_months"))
    return out.withColumn("target_date", months_after(F.col("ask_date"), F.col("horizon_months")))


def threshold(base: Column, kind: Column, step: Column) -> Column:
    """The level that a step above the base means: a factor for counts, points for percents, tenths of a power for logs."""
    return F.when(kind == "count", significant(base * (1 + step))).when(kind == "percent", F.least(F.round(base + 100 * step, 1), F.lit(100.0))).otherwise(F.round(base + step, 2))


def relative_step(base: Column, level: Column, kind: Column) -> Column:
    """The inverse of threshold(), up to its rounding."""
    return F.when(kind == "count", F.try_divide(level, base) - 1).when(kind == "percent", (level - base) / 100).otherwise(level - base)


def cleared(base: Column, later: Column, level: Column, base_now: Column, kind: Column) -> Column:
    """Whether a past move from base to later was as large, relatively, as base_now to level; equality within 1e-9 counts."""
    return relative_step(base, later, kind) >= relative_step(base_now, level, kind) - TOLERANCE


def log_step(base: Column, level: Column) -> Column:
    """A count's threshold as the logarithm of its ratio to the base."""
    return F.log(F.try_divide(level, base))


def expanded(obs: DataFrame, cutoff: Column, horizons: list[int], multiples: list[float]) -> DataFrame:
    """Past months as threshold questions with known answers: every month known at the cutoff, with a value above zero, times each horizon whose month is known too,
    times each multiple of its value.

    Returns series_id, base_month, as_of (the month's first release: what could be seen when it was asked), horizon_months, step, base, later, cleared (later reaches the
    level within a relative 1e-9: 1 or 0) and published (the later month's first release). Values are those known at the cutoff. One join by series and
    month; the products are exploded.
    """
    seen = until(obs, cutoff)
    first = first_releases(seen).select("series_id", "observed_at", "first_as_of")
    values = known(obs, cutoff).where("value is not null").join(first, ["series_id", "observed_at"])
    later = values.select("series_id", F.col("observed_at").alias("later_month"), F.col("value").alias("later"), F.col("first_as_of").alias("published"))
    base = values.where("value > 0").select("series_id", F.col("observed_at").alias("base_month"), F.col("value").alias("base"), F.col("first_as_of").alias("as_of"), F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_months"))
    pairs = base.withColumn("later_month", months_after(F.col("base_month"), F.col("horizon_months") + 1)).join(later, ["series_id", "later_month"])
    level = F.col("base") * F.col("multiple")
    out = pairs.withColumn("multiple", F.explode(F.array(*[F.lit(float(m)) for m in multiples])))
    return out.select("series_id", "base_month", "as_of", "horizon_months", log_step(F.col("base"), level).alias("step"), "base", "later", (F.col("later") >= level * (1 - TOLERANCE)).cast("int").alias("cleared"), "published")


def outcomes(questions: DataFrame, obs: DataFrame, as_of: Column) -> DataFrame:
    """questions (series_id, target_date, threshold) with outcome yes or no from the first live value, null until there is one."""
    live = first_live(obs, as_of).select("series_id", F.col("observed_at").alias("target_date"), "first_value", "first_as_of")
    return questions.join(live, ["series_id", "target_date"], "left").withColumn("outcome", F.when(F.col("first_value") >= F.col("threshold"), "yes").when(F.col("first_value").isNotNull(), "no"))


def laplace(yes: Column, n: Column) -> Column:
    return (yes + 1) / (n + 2)


def open_questions(questions: DataFrame, resolutions: DataFrame, today: Column) -> DataFrame:
    """Due and without a resolution."""
    return questions.where(F.col("target_date") <= today).join(resolutions.select("question_id"), "question_id", "left_anti")


def transition_rates(events: DataFrame, by: list[str], order: str, state: str, states: list[str]) -> DataFrame:
    """Smoothed P(next state | state) from adjacent pairs: (n + 1) / (total + states)."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(order))
    counts = events.withColumn("before", before).where("before is not null").groupBy(*by, "before").pivot(state, states).count().na.fill(0)
    total = sum((F.col(s) for s in states[1:]), F.col(states[0])) + len(states)
    return counts.select(*by, "before", *[((F.col(s) + 1) / total).alias(s) for s in states])


def token_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with cost: tokens at each model's price for a million, null for a model without one."""
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6
    return calls.join(prices, "model", "left").withColumn("cost", cost)


def first_calls(calls: DataFrame, context: str, order: list[str]) -> DataFrame:
    """calls with `paid`: true for the first one of each context in `order`, whose columns name a call. One row a context meets its calls, however many share it."""
    first = calls.groupBy(F.col(context).alias("_context")).agg(F.min(F.struct(*order)).alias("_first"))
    return calls.join(first, F.col(context).eqNullSafe(F.col("_context"))).withColumn("paid", F.struct(*order).eqNullSafe(F.col("_first"))).drop("_context", "_first")


def spent_before(calls: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """calls with the cost of all earlier ones of the group: what a budget stop compares with its limit."""
    return calls.withColumn("spent", F.coalesce(F.sum("cost").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
