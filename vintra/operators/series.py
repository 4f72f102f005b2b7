"""Time-series windows that know about gaps: they go by month or day numbers and never by row counts."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vintra.functions.calendar import month_index, month_of


def by_month(*keys: str, period: str = "observed_at") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(month_index(F.col(period)))


def by_day(*keys: str, day: str = "day") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.unix_date(day))


def shifted(value: str, months: int, w: WindowSpec) -> Column:
    """The value so many months before (negative: after); null if that month has no row."""
    return F.first(value).over(w.rangeBetween(-months, -months))


def pct_change(value: str, months: int, w: WindowSpec) -> Column:
    """Percent on the value so many months before; null without it or on zero."""
    return (F.try_divide(F.col(value), shifted(value, months, w)) - 1) * 100


def difference(value: str, months: int, w: WindowSpec) -> Column:
    return F.col(value) - shifted(value, months, w)


def full_mean(value: str, periods: int, w: WindowSpec, step: int = 1) -> Column:
    """Mean of the last so many periods (step apart in the window's order), null unless all are there."""
    frame = w.rangeBetween(-(periods * step - 1), 0)
    return F.when(F.count(value).over(frame) == periods, F.avg(value).over(frame))


def lagged_mean(value: str, periods: int, back: int, w: WindowSpec, step: int = 1) -> Column:
    """full_mean() of a stretch that ended `back` units ago."""
    frame = w.rangeBetween(-(back + periods * step - 1), -back)
    return F.when(F.count(value).over(frame) == periods, F.avg(value).over(frame))


def carried(value: str, limit: int, w: WindowSpec) -> Column:
    """The last value at most `limit` units old; the window's index must be dense."""
    return F.last(value, ignorenulls=True).over(w.rangeBetween(-limit, 0))


def densified(df: DataFrame, keys: list[str], period: str = "observed_at") -> DataFrame:
    """A row for every month between a key's first and last; new rows have nulls."""
    span = df.groupBy(*keys).agg(F.min(month_index(F.col(period))).alias("a"), F.max(month_index(F.col(period))).alias("b"))
    months = span.select(*keys, F.explode(F.sequence("a", "b")).alias("m")).withColumn(period, month_of(F.col("m"))).drop("m")
    return months.join(df, [*keys, period], "left")


def interpolated(value: str, w: WindowSpec, index: Column) -> Column:
    """Linear between the known neighbours of an inner gap; outer gaps stay null."""
    at = F.when(F.col(value).isNotNull(), F.struct(index.alias("i"), F.col(value).alias("v")))
    a, b = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    inner = a["v"] + (b["v"] - a["v"]) * (index - a["i"]) / (b["i"] - a["i"])
    return F.when(F.col(value).isNotNull(), F.col(value)).when(a.isNotNull() & b.isNotNull(), inner)


def running_max(value: str, w: WindowSpec) -> Column:
    return F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))


def last_change(value: str, w: WindowSpec, index: Column) -> tuple[Column, Column]:
    """(periods since the value last changed, the size of that change); without any change, periods since the start and null."""
    step = F.col(value) - F.lag(value).over(w)
    at = F.last(F.when(step != 0, F.struct(index.alias("i"), step.alias("d"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    start = F.first(index).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return index - F.coalesce(at["i"], start), at["d"]


def rises(step: str, periods: int, w: WindowSpec) -> Column:
    """How many of the last `periods` steps are above zero; null unless all are known."""
    frame = w.rangeBetween(-(periods - 1), 0)
    return F.when(F.count(step).over(frame) == periods, F.sum((F.col(step) > 0).cast("int")).over(frame))


def trailing(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def monthly_mean(daily: DataFrame, keys: list[str], day: str, value: str, as_of: Column | None = None) -> DataFrame:
    """Means by month; with as_of only months that had ended by then."""
    out = daily.groupBy(*keys, F.trunc(day, "month").cast("date").alias("month")).agg(F.avg(value).alias(value))
    return out if as_of is None else out.where(F.last_day("month") <= as_of)


def quarterly_mean(monthly: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """Means by quarter, complete quarters only."""
    out = monthly.where(F.col(value).isNotNull()).groupBy(*keys, F.trunc(month, "quarter").cast("date").alias("quarter")).agg(F.avg(value).alias(value), F.count("*").alias("n"))
    return out.where("n = 3").drop("n")


def change_points(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """First and last rows and those that differ from the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_nth", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).withColumn("_new", ~F.col(value).eqNullSafe(F.lag(value).over(w)))
    return marked.where("_nth = 1 or _nth = _n or _new").drop("_nth", "_n", "_new")


def fresh(value: Column, last: Column, as_of: Column, months: int | None = None, days: int | None = None) -> Column:
    """The value unless its period is too old on that day."""
    old = month_index(as_of) - month_index(last) > months if months is not None else F.datediff(as_of, last) > days
    return F.when(~old, value)


def log_change_correlation(x: str, y: str, periods: int, w: WindowSpec) -> Column:
    """Correlation of two columns of changes over the last periods; null unless all are there and both vary."""
    frame = w.rangeBetween(-(periods - 1), 0)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    good = (F.count(a).over(frame) == periods) & (F.stddev_samp(a).over(frame) > 0) & (F.stddev_samp(b).over(frame) > 0)
    return F.when(good, F.corr(a, b).over(frame))


def without_sparse(df: DataFrame, columns: list[str], most_missing: float = 0.5) -> tuple[DataFrame, list[str]]:
    """Without columns missing in more than that share of rows, and their names; one pass for all of them."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    dropped = [c for c in columns if row[c] is not None and row[c] > most_missing]
    return df.drop(*dropped), dropped
