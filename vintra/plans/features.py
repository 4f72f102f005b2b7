"""Feature matrices over all as-of dates: monthly series known at each date, as wide rows of nullable doubles."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintra.functions.calendar import cutoff_of, month_index, months_between, one_hot
from vintra.operators.series import difference, full_mean, last_change, pct_change, rises, shifted

AT = ("series_id", "forecast_date")


def monthly_features(history: DataFrame, lags: list[int], changes: list[int], max_stale: int = 3) -> DataFrame:
    """One row for each (series_id, forecast_date) of history (…, observed_at, value): level, log, lags, percent changes and
    differences, three-month mean, months since the last change and its size, rises in a year, months behind, calendar.

    Windows run over each date's own history, so nothing later is seen; the row of the latest month is kept, and its values
    are null if it is more than max_stale months old.
    """
    w = Window.partitionBy(*AT).orderBy(month_index(F.col("observed_at")))
    index = month_index(F.col("observed_at"))
    since, jump = last_change("value", w, index)
    made = history.withColumn("step", difference("value", 1, w))
    columns = {"level": F.col("value"), "log": F.when(F.col("value") > 0, F.log("value")), "mean3": full_mean("value", 3, w), "months_since_change": since.cast("double"), "last_jump": jump, "rises12": rises("step", 12, w).cast("double")}
    columns |= {f"lag{k}": shifted("value", k, w) for k in lags}
    columns |= {f"growth{k}": pct_change("value", k, w) for k in changes}
    columns |= {f"chg{k}": difference("value", k, w) for k in changes}
    made = made.select(*AT, "observed_at", *[c.alias(n) for n, c in columns.items()])
    latest = made.groupBy(*AT).agg(F.max_by(F.struct("observed_at", *columns), "observed_at").alias("x"))
    day = cutoff_of(F.col("forecast_date"))
    behind = months_between(F.col("x.observed_at"), day)
    out = latest.withColumn("behind", behind)
    fresh = F.col("behind") <= max_stale
    return out.select(*AT, *[F.when(fresh, F.col(f"x.{n}")).alias(n) for n in columns], F.when(fresh, F.col("behind").cast("double")).alias("months_behind"), *one_hot(F.month(day), range(1, 13), "month"), *one_hot(F.quarter(day), range(1, 5), "quarter"), (month_index(day) - 1990 * 12).cast("double").alias("trend_months"))


def with_target(wide: DataFrame, prefix: str) -> DataFrame:
    """wide with a target_* alias for each of a series' columns."""
    return wide.select("*", *[F.col(c).alias("target" + c[len(prefix) :]) for c in wide.columns if c == prefix or c.startswith(f"{prefix}_")])


def pivoted(features: DataFrame, series: list[str], names: list[str]) -> DataFrame:
    """One row a forecast date, with <series>_<name> columns of the listed series."""
    return features.where(F.col("series_id").isin(series)).groupBy("forecast_date").pivot("series_id", series).agg(*[F.first(n).alias(n) for n in names])
