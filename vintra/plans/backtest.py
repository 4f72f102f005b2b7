"""Walk-forward backtests over all forecast dates at once.

A forecast of the first of a month sees what had been published by the day before. History at every date comes from
validity intervals in one pass; models are aggregates and windows over (series, forecast date).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintra.functions.calendar import cutoff_of, month_index, months_after, months_between
from vintra.functions.scalar import z_of
from vintra.operators.asof import actuals, known_monthly, year_on_year
from vintra.operators.metrics import scored

AT = ("series_id", "forecast_date")


def histories(obs: DataFrame, first: str, last: str, yoy: bool = False) -> DataFrame:
    """(series_id, forecast_date, observed_at, value, max_as_of_seen): non-null values known at each date."""
    seen = known_monthly(obs, first, last).withColumn("max_as_of_seen", F.max("as_of").over(Window.partitionBy(*AT)))
    seen = year_on_year(seen, list(AT)) if yoy else seen
    return seen.where("value is not null").select(*AT, "observed_at", "value", "max_as_of_seen")


def _last(history: DataFrame) -> DataFrame:
    return history.groupBy(*AT).agg(F.max(F.struct("observed_at", "value")).alias("x"), F.max("max_as_of_seen").alias("max_as_of_seen")).select(*AT, "max_as_of_seen", F.col("x.observed_at").alias("last_period"), F.col("x.value").alias("last_value"))


def _planned(last: DataFrame, horizons: list[int]) -> DataFrame:
    h = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_months")
    out = last.select("*", h).withColumn("target_period", months_after(F.col("forecast_date"), F.col("horizon_months")))
    return out.withColumn("steps", months_between(F.col("last_period"), F.col("target_period")))


def random_walk(history: DataFrame, horizons: list[int], coverage: float = 0.8) -> DataFrame:
    """The last value, with quantiles of past changes over as many months as lie between it and the target."""
    plan = _planned(_last(history), horizons)
    steps = plan.select(*AT, "steps").distinct()
    now = history.select(*AT, month_index(F.col("observed_at")).alias("m"), "value").join(steps, list(AT))
    before = history.select(*AT, month_index(F.col("observed_at")).alias("m0"), F.col("value").alias("base"))
    tail = (1 - coverage) / 2
    changes = now.withColumn("m0", F.col("m") - F.col("steps")).join(before, [*AT, "m0"])
    quantiles = changes.groupBy(*AT, "steps").agg(F.percentile(F.col("value") - F.col("base"), F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    out = plan.join(quantiles, [*AT, "steps"], "left")
    return out.withColumn("model", F.lit("random_walk")).withColumn("prediction", F.col("last_value")).withColumn("lower", F.col("last_value") + F.col("q")[0]).withColumn("upper", F.col("last_value") + F.col("q")[1])


def historical_mean(history: DataFrame, horizons: list[int], coverage: float = 0.8, months: int | None = None, log: bool = False, digits: int | None = None) -> DataFrame:
    """The mean of all values, or of the last so many, with a normal interval; geometric on the log scale. Needs two values.

    digits: of values with so many decimals; they are then summed as decimals, so that the mean doesn't depend on the order of rows.
    """
    rows = history
    if months is not None:
        w = Window.partitionBy(*AT).orderBy(F.desc("observed_at"))
        rows = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= months)
    v = F.log("value") if log else F.col("value")
    mean = F.avg(v) if log or digits is None else F.sum(F.col("value").cast(f"decimal(28,{digits})")).cast("double") / F.count("value")
    fit = rows.groupBy(*AT).agg(mean.alias("mu"), F.stddev_samp(v).alias("sd"), F.count("*").alias("n")).where("n >= 2")
    back = F.exp if log else (lambda x: x)
    half = F.lit(z_of(coverage)) * F.col("sd")
    out = _planned(_last(history), horizons).join(fit, list(AT))
    return out.withColumn("model", F.lit("historical_mean")).withColumn("prediction", back(F.col("mu"))).withColumn("lower", back(F.col("mu") - half)).withColumn("upper", back(F.col("mu") + half))


def linear_trend(history: DataFrame, horizons: list[int], coverage: float = 0.8, months: int = 12, least: int = 3) -> DataFrame:
    """An OLS line through the last values, with its prediction interval; only the last value with too few of them."""
    w = Window.partitionBy(*AT).orderBy(F.desc("observed_at"))
    rows = history.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= months).withColumn("x", month_index(F.col("observed_at")).cast("double"))
    fit = rows.groupBy(*AT).agg(F.regr_slope("value", "x").alias("slope"), F.avg("x").alias("mx"), F.avg("value").alias("my"), F.count("*").alias("n"), F.regr_sxx("value", "x").alias("sxx"), F.regr_syy("value", "x").alias("syy"), F.regr_sxy("value", "x").alias("sxy"))
    out = _planned(_last(history), horizons).join(fit, list(AT))
    dx = month_index(F.col("target_period")) - F.col("mx")
    rest = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), "sxx"), F.lit(0.0))
    se = F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2))).otherwise(0.0) * F.sqrt(1 + F.lit(1.0) / F.col("n") + F.try_divide(dx * dx, "sxx"))
    enough = F.col("n") >= least
    point = F.when(enough, F.col("my") + F.col("slope") * dx).otherwise(F.col("last_value"))
    half = F.when(enough, F.lit(z_of(coverage)) * se)
    return out.withColumn("model", F.lit("linear_trend")).withColumn("prediction", point).withColumn("lower", point - half).withColumn("upper", point + half)


def training_window(history: DataFrame, months: int | None) -> DataFrame:
    """The history of the last so many months before each date's cutoff; all of it (an expanding window) if None."""
    return history if months is None else history.where(month_index(F.col("observed_at")) > month_index(cutoff_of(F.col("forecast_date"))) - months)


MODELS = {"random_walk": random_walk, "historical_mean": historical_mean, "linear_trend": linear_trend}


def resolved(forecasts: DataFrame, obs: DataFrame, yoy: bool = False, resolve_with: str = "first_release") -> DataFrame:
    """Forecasts with their actual, its vintage and scores, in the declared backtest schema."""
    truth = actuals(obs, yoy, resolve_with).withColumnRenamed("observed_at", "target_period")
    rows = forecasts.withColumn("data_as_of", cutoff_of(F.col("forecast_date"))).join(truth, ["series_id", "target_period"], "left")
    return scored(rows).select("series_id", "model", "forecast_date", "data_as_of", "max_as_of_seen", "target_period", "horizon_months", "prediction", "lower", "upper", "actual", "actual_as_of", "error", "abs_error", "squared_error", "in_interval")


def walk_forward(obs: DataFrame, first: str, last: str, horizons: list[int], models: list[str], yoy: bool = False, coverage: float = 0.8, resolve_with: str = "first_release", window_months: int | None = None, model_cutoff: str | None = None, digits: int | None = None) -> DataFrame:
    """The backtest of models over monthly forecast dates. digits: of historical_mean(). window_months: a rolling history. model_cutoff: no earlier date is asked,
    as the model may know what came before."""
    history = training_window(histories(obs, max(first, model_cutoff or first), last, yoy), window_months)
    out = None
    for name in models:
        made = MODELS[name](history, horizons, coverage, **({"digits": digits} if name == "historical_mean" else {})).select(*AT, "max_as_of_seen", "target_period", "horizon_months", "model", "prediction", "lower", "upper")
        out = made if out is None else out.unionByName(made)
    return resolved(out, obs, yoy, resolve_with)


def fold_starts(forecast_date: Column, every: int, w: str = "series_id") -> Column:
    """The forecast date at which the model in use was fitted, with a refit every so many dates."""
    nth = F.dense_rank().over(Window.partitionBy(w).orderBy(forecast_date)) - 1
    return F.min(forecast_date).over(Window.partitionBy(w, F.floor(nth / every)))
