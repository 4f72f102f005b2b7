"""Boosted models: changes with intervals, decisions, threshold questions, and explanations of their trees."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintra.functions import scalar
from vintra.functions.calendar import month_start
from vintra.functions.scalar import quantised
from vintra.plans import backtest, boosting, features, questions as plans, statespace
from vintra.plans.boosting import Spec
from vintra.queries.base import FIRST, LAST, OBS, day, obs, q, query, table
from vintra.queries.scoring import decisions, results
from vintra.sources.scratch import Scratch

SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
MONTHLY = ["level", "lag1", "lag2", "lag3", "lag12", "growth1", "growth3", "growth12", "chg1", "chg3", "chg12", "mean3", "months_since_change", "last_jump", "rises12", "months_behind", "trend_months"]


def pooled(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with an indicator column for each series, and their names."""
    names = [f"is_{k}" for k in range(len(SERIES))]
    return df.select("*", *[(F.col("series_id") == s).cast("double").alias(n) for s, n in zip(SERIES, names, strict=True)]), names


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return features.monthly_features(backtest.histories(obs(spark, d), FIRST, LAST), lags=[1, 2, 3, 12], changes=[1, 3, 12], max_stale=60)


def training(spark: SparkSession, d: str) -> DataFrame:
    """Monthly features with the change to the actual of three months on, and the day that came out."""
    truth = results(spark, d).where("model = 'random_walk' and horizon_months = 3").select("series_id", "forecast_date", (F.col("actual") - F.col("prediction")).alias("change"), "actual_as_of")
    return monthly(spark, d).join(truth, ["series_id", "forecast_date"])


@query()
def p6_statistical_models(spark: SparkSession, d: str) -> DataFrame:
    """Smoothing and ARIMA forecasts three months after the last known one, at every forecast date with two years behind its refit; refits every twelve dates."""
    h = Scratch(spark).save(backtest.histories(obs(spark, d), FIRST, LAST).select("series_id", "forecast_date", "observed_at", "value"), "histories")
    refit = backtest.fold_starts(F.col("forecast_date"), 12)
    both = [statespace.forecasts(h, refit, F.lit("count"), family, 3).withColumn("model", F.lit(family)) for family in ("ets", "arima")]
    return both[0].unionByName(both[1])


@query()
def p7_boosted_changes(spark: SparkSession, d: str) -> DataFrame:
    """Three-month changes: grid and folds with a gap of the horizon, interval from the out-of-fold errors, for the dates after training."""
    rows, indicators = pooled(training(spark, d))
    scratch = Scratch(spark)
    rows = scratch.save(rows, "training")
    names, start = [*MONTHLY, *indicators], day("2000-01-01")
    base = Spec((F.col("forecast_date") < start) & (F.col("actual_as_of") < start), rounds=16, patience=4, least=4)
    model, _, held = boosting.cross_validated(rows, names, "change", "forecast_date", base, {"depth": [2, 3], "rate": [0.15, 0.3]}, 3, 3, scratch, published="actual_as_of")
    bounds = held.agg(F.percentile(F.col("change") - F.col("prediction"), F.array(F.lit(0.1), F.lit(0.9))).alias("b"))
    ask = boosting.predicted(rows.where(F.col("forecast_date") >= start).drop("change"), model, "change")
    return ask.crossJoin(F.broadcast(bounds)).select("series_id", "forecast_date", "change", (F.col("change") + F.col("b")[0]).alias("lower"), (F.col("change") + F.col("b")[1]).alias("upper"))


def meetings(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with what was known before each: the level and how often and when it had moved. A calendar of a few hundred rows, ordered in one task."""
    w = Window.orderBy("meeting")
    t = decisions(spark, d).withColumn("nth", F.row_number().over(w))
    before = lambda k: F.lag("target", k).over(w)
    moved = F.last(F.when(F.col("outcome") != "hold", F.col("nth")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    past = w.rowsBetween(-24, -1)
    columns = {"level": before(1), "move1": before(1) - before(2), "move2": before(2) - before(3), "off_mean": before(1) - F.avg("target").over(past), "since_change": F.col("nth") - moved, "hikes": F.count(F.when(F.col("outcome") == "hike", 1)).over(past), "cuts": F.count(F.when(F.col("outcome") == "cut", 1)).over(past)}
    label = F.array_position(F.array(*[F.lit(c) for c in ("cut", "hold", "hike")]), F.col("outcome")) - 1
    return t.select("meeting", "outcome", label.cast("double").alias("label"), *[c.cast("double").alias(n) for n, c in columns.items()])


@query()
def p8_decision_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of cut, hold and hike for the last third of the meetings, from a softmax model of the first two."""
    rows = Scratch(spark).save(meetings(spark, d), "meetings")
    start = rows.agg(F.percentile_approx("meeting", 0.67, 10_000).alias("s")).first()["s"]
    names = ["level", "move1", "move2", "off_mean", "since_change", "hikes", "cuts"]
    spec = Spec(F.col("meeting") < F.lit(start), loss="softmax", classes=3, rounds=20, rate=0.2, depth=2, l2=3.0)
    model = boosting.fit(rows, names, "label", [spec], Scratch(spark))[0]
    p = boosting.predicted(rows.where(F.col("meeting") >= F.lit(start)), model, "p")
    return p.select("meeting", "outcome", *[F.col("p")[k].alias(c) for k, c in enumerate(("cut", "hold", "hike"))])


@query()
def p8_p9_probability_models(spark: SparkSession, d: str) -> DataFrame:
    """Of each month of 2000: whether the value rises in three months, and by which class of move, learnt from months whose actual had come out."""
    move = F.when(F.col("change") > 5e4, 2.0).when(F.col("change") < -5e4, 0.0).otherwise(1.0)
    scratch = Scratch(spark)
    rows = scratch.save(training(spark, d).withColumn("up", (F.col("change") > 0).cast("double")).withColumn("move", F.when(F.col("change").isNotNull(), move)), "rows")
    start, names = day("2000-01-01"), ["level", "lag1", "growth1", "chg1"]
    train = (F.col("forecast_date") < start) & (F.col("actual_as_of") < start)
    up = boosting.fit(rows, names, "up", [Spec(train, loss="logistic", rounds=8, rate=0.3)], scratch)[0]
    moves = boosting.fit(rows, names, "move", [Spec(train, loss="softmax", classes=3, rounds=8, rate=0.3)], scratch)[0]
    out = boosting.predicted(boosting.predicted(rows.where(F.col("forecast_date") >= start), up, "p"), moves, "_p")
    shares = F.map_from_arrays(F.array(*[F.lit(c) for c in ("cut", "hold", "hike")]), F.col("_p"))
    return out.select("series_id", "forecast_date", scalar.clip(F.col("p"), 0.01, 0.99).alias("p"), shares.alias("probabilities"))


MULTIPLES = (1.1, 1.25, 1.5)
CUTOFF = "1999-12-31"


@query(f"""WITH {OBS}, seen AS (SELECT * FROM obs WHERE as_of <= DATE '{CUTOFF}'), f AS (SELECT series_id, observed_at, min(as_of) AS first_as_of FROM seen WHERE value IS NOT NULL GROUP BY ALL),
v AS (SELECT s.series_id, s.observed_at, arg_max(coalesce(value, -1), as_of) AS value FROM seen s GROUP BY ALL), k AS (SELECT v.*, first_as_of FROM v JOIN f USING (series_id, observed_at) WHERE value >= 0)
SELECT b.series_id, b.observed_at AS base_month, b.first_as_of AS as_of, h AS horizon_months, {q('ln(m)', 8)} AS step, (l.value >= b.value * m * (1 - 1e-9::DOUBLE))::INT AS cleared, l.first_as_of AS published
FROM k b CROSS JOIN (VALUES (1), (3), (6)) x(h) JOIN k l ON l.series_id = b.series_id AND l.observed_at = (b.observed_at + to_months(h + 1))::DATE CROSS JOIN (VALUES {', '.join(f'({m!r}::DOUBLE)' for m in MULTIPLES)}) y(m) WHERE b.value > 0""")
def p9_threshold_expansion(spark: SparkSession, d: str) -> DataFrame:
    rows = plans.expanded(obs(spark, d), day(CUTOFF), [1, 3, 6], list(MULTIPLES))
    return rows.select("series_id", "base_month", "as_of", "horizon_months", quantised(F.col("step"), 8).alias("step"), "cleared", "published")


@query()
def p9_threshold_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """One classifier over the expanded history, with folds purged by publication; p of each step and horizon asked at every later month. It can't rise with the step."""
    scratch = Scratch(spark)
    m, indicators = pooled(monthly(spark, d))
    m = scratch.save(m, "features")
    history = plans.expanded(obs(spark, d), day(CUTOFF), [1, 3, 6], list(MULTIPLES))
    # features of the month in which the base came out: known on the eve of its first day
    rows = history.withColumn("forecast_date", month_start(F.col("as_of"))).join(m, ["series_id", "forecast_date"])
    rows = scratch.save(rows.withColumn("horizon", F.col("horizon_months").cast("double")), "rows")
    names = [n for n in MONTHLY if not scalar.drifting(n, [])] + [*indicators, "step", "horizon"]
    base = Spec(F.lit(True), loss="logistic", rounds=20, rate=0.3, depth=3, patience=5, monotone={"step": -1})
    model, _, _ = boosting.cross_validated(rows, names, "cleared", "as_of", base, {"depth": [2, 3]}, 3, 0, scratch, published="published")
    asked = m.where(F.col("forecast_date") > day(CUTOFF)).select("*", F.explode(F.array(F.lit(1.0), F.lit(3.0), F.lit(6.0))).alias("horizon")).withColumn("step", F.explode(F.array(*[F.log(F.lit(x)) for x in MULTIPLES])))
    return boosting.predicted(asked, model, "p").select("series_id", "forecast_date", F.col("horizon").cast("int").alias("horizon_months"), "step", scalar.clip(F.col("p"), 0.01, 0.99).alias("p"))


@query()
def p10_explained_prices(spark: SparkSession, d: str) -> DataFrame:
    """Every line's price as a model over all lines explains it: prediction = expected + the contributions; the five largest, and the sum of all."""
    items = table(spark, d, "lineitem")
    names = ["quantity", "discount", "tax", "line", "shipped"]
    rows = items.select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line_no"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"), F.col("l_linenumber").cast("double").alias("line"),
        F.datediff("l_shipdate", day("1992-01-01")).cast("double").alias("shipped"),
    )
    model = boosting.fit(rows, names, "price", [Spec(F.lit(True), rounds=6, rate=0.5, depth=3)], Scratch(spark))[0]
    out = boosting.explained(boosting.predicted(rows, model), model)
    total = F.aggregate(F.map_values("contributions"), F.lit(0.0), lambda a, x: a + x)
    return out.select("key", "line_no", "prediction", "expected", total.alias("explained"), scalar.top_entries(F.col("contributions"), 5).alias("drivers"))
