"""Recurring jobs as whole-table steps: answering and scoring questions, refreshes, event backtests, snapshots, ingests, context."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintra.functions.calendar import month_index, month_start
from vintra.operators.asof import actuals, first_live, first_releases, latest_vintage, until
from vintra.operators.writes import insert_absent

OUTCOMES = ("cut", "hold", "hike")


def required(asked: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The table's row for every asked key; the job fails on a key that the table lacks. table's key is unique."""
    found = asked.select(key).join(table.withColumn("_found", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no row with {key} "), F.col(key).cast("string")))
    return found.where(F.when(F.col("_found"), True).otherwise(missing.cast("boolean"))).drop("_found")


def versions_as_of(versions: DataFrame, asked: DataFrame, key: str, at: str, version: str) -> DataFrame:
    """asked (key, when) with the last version at or before `when`, null if there was none. Both sides meet in one sorted
    window a key; of versions at the same time the largest counts."""
    v = versions.select(key, F.col(at).alias("when"), F.col(version).alias("_v"), F.lit(0).alias("_side"))
    a = asked.select(key, "when", F.lit(None).cast(versions.schema[version].dataType).alias("_v"), F.lit(1).alias("_side"))
    seen = Window.partitionBy(key).orderBy("when", "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return v.unionByName(a).withColumn(version, F.last("_v", ignorenulls=True).over(seen)).where("_side = 1").select(key, "when", version)


def refreshed(resolved: DataFrame, obs: DataFrame) -> DataFrame:
    """resolved (question_id, series_id, target_date, latest_as_of) that have a newer vintage than the stored one, with the value
    and date of the series' latest vintage; those without a value there are left out."""
    newest = latest_vintage(obs).withColumnRenamed("latest_as_of", "newest")
    due = resolved.join(newest, "series_id").where(~F.col("newest").eqNullSafe(F.col("latest_as_of"))).drop("newest")
    now = actuals(obs, resolve_with="latest").withColumnRenamed("observed_at", "target_date")
    return due.join(now, ["series_id", "target_date"]).select("question_id", F.col("actual").alias("latest_value"), F.col("actual_as_of").alias("latest_as_of"))


def answers(numeric: DataFrame, decided: DataFrame, obs: DataFrame, as_of: Column) -> DataFrame:
    """What has been published by as_of: the first release for numeric questions (question_id, series_id, target_date), the
    outcome on the day after for decisions (question_id, meeting, outcome)."""
    first = first_releases(until(obs, as_of)).withColumnRenamed("observed_at", "target_date")
    values = numeric.join(first, ["series_id", "target_date"]).select("question_id", F.col("first_value").alias("value"), F.lit(None).cast("string").alias("outcome"), F.col("first_as_of").alias("actual_as_of"))
    after = F.date_add("meeting", 1)
    outcomes = decided.where(F.col("outcome").isNotNull() & (after <= as_of)).select("question_id", F.lit(None).cast("double").alias("value"), "outcome", after.alias("actual_as_of"))
    return values.unionByName(outcomes)


def resolve_and_score(questions: DataFrame, resolved: DataFrame, forecasts: DataFrame, obs: DataFrame, as_of: Column) -> DataFrame:
    """questions (question_id, series_id, target_date, threshold) due by as_of and not resolved yet, with outcome (null: still
    open), actual_as_of, and each of their forecasts (forecast_id, question_id, p) with its Brier score."""
    due = questions.where(F.col("target_date") <= as_of).join(resolved.select("question_id"), "question_id", "left_anti")
    live = first_live(obs, as_of).select("series_id", F.col("observed_at").alias("target_date"), "first_value", "first_as_of")
    outcome = F.when(F.col("first_value").isNotNull(), F.when(F.col("first_value") >= F.col("threshold"), "yes").otherwise("no"))
    answered = due.join(live, ["series_id", "target_date"], "left").select("question_id", "series_id", outcome.alias("outcome"), F.col("first_as_of").alias("actual_as_of"))
    brier = F.when(F.col("outcome").isNotNull(), F.pow(F.col("p") - (F.col("outcome") == "yes").cast("double"), 2))
    return answered.join(forecasts.select("forecast_id", "question_id", "p"), "question_id", "left").withColumn("brier", brier)


def event_cutoff(meeting: Column, lead_days: int) -> Column:
    """The last day whose data a forecast so many days ahead of a meeting may use."""
    return F.date_sub(meeting, lead_days + 1)


def origin_month(cutoff: Column) -> Column:
    """The month in which a forecast is made on the day after its cutoff."""
    return month_start(F.date_add(cutoff, 1))


def fitted_dates(events: DataFrame, lead_days: int, every_months: int) -> DataFrame:
    """(series_id, meeting, data_as_of, trained_as_of): refits follow one another, the next at the first cutoff so many calendar
    months after the last one. The fold runs over one series' calendar of meetings."""
    cut = events.select("series_id", "meeting").distinct().groupBy("series_id").agg(F.array_sort(F.collect_list("meeting")).alias("meetings"))

    def fold(done: Column, meeting: Column) -> Column:
        cutoff, last = event_cutoff(meeting, lead_days), F.try_element_at(done, F.lit(-1))["trained_as_of"]
        keeps = last.isNotNull() & (month_index(cutoff) - month_index(last) < every_months)
        return F.concat(done, F.array(F.struct(meeting.alias("meeting"), cutoff.alias("data_as_of"), F.when(keeps, last).otherwise(cutoff).alias("trained_as_of"))))

    start = F.array().cast("array<struct<meeting:date,data_as_of:date,trained_as_of:date>>")
    return cut.select("series_id", F.inline(F.aggregate("meetings", start, fold)))


def event_backtest(events: DataFrame, lead_days: int, every_months: int) -> DataFrame:
    """Climatology of outcomes over meetings, walked forward: events (series_id, meeting, published, outcome) give one row a
    meeting with p_<outcome>, smoothed by one each and counted over what was published when the model was last fitted, and the
    Brier score, null while the outcome isn't known. Outcomes are counted by the day they came out, and fits read the running
    count: a row a series and day, not a row a fit and event."""
    dated = fitted_dates(events, lead_days, every_months)
    fits = dated.select("series_id", "trained_as_of").distinct()
    past = events.where("outcome is not null").select("series_id", "published", F.col("outcome").alias("past"))
    daily = past.groupBy("series_id", F.col("published").alias("day")).agg(*[F.count(F.when(F.col("past") == o, 1)).alias(f"n_{o}") for o in OUTCOMES])
    both = daily.withColumn("fit", F.lit(False)).unionByName(fits.select("series_id", F.col("trained_as_of").alias("day"), F.lit(True).alias("fit")), allowMissingColumns=True)
    upto = Window.partitionBy("series_id").orderBy("day", "fit").rowsBetween(Window.unboundedPreceding, 0)
    counts = both.select("series_id", F.col("day").alias("trained_as_of"), "fit", *[F.sum(f"n_{o}").over(upto).alias(f"n_{o}") for o in OUTCOMES]).where("fit").drop("fit")
    rows = dated.join(counts, ["series_id", "trained_as_of"], "left").join(events.select("series_id", "meeting", "outcome"), ["series_id", "meeting"])
    n = {o: F.coalesce(f"n_{o}", F.lit(0)) for o in OUTCOMES}
    p = {o: (n[o] + 1) / (sum(n.values()) + len(OUTCOMES)) for o in OUTCOMES}
    rows = rows.select("series_id", "meeting", "data_as_of", "trained_as_of", *[p[o].alias(f"p_{o}") for o in OUTCOMES], "outcome")
    squares = [F.pow(F.col(f"p_{o}") - (F.col("outcome") == o).cast("double"), 2) for o in OUTCOMES]
    return rows.withColumn("brier", sum(squares[1:], squares[0]))


def event_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean Brier score, hit rate of the likeliest outcome (the first on ties), changes and the score on them."""
    top = F.greatest(*[F.col(f"p_{o}") for o in OUTCOMES])
    likeliest = F.coalesce(*[F.when(F.col(f"p_{o}") == top, o) for o in OUTCOMES])
    change = F.col("outcome") != "hold"
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_forecasts"), F.count("outcome").alias("n_resolved"), F.avg("brier").alias("brier"),
        F.avg((likeliest == F.col("outcome")).cast("double")).alias("accuracy"), F.count(F.when(change, 1)).alias("n_changes"), F.avg(F.when(change, F.col("brier"))).alias("brier_on_changes"),
    )


def month_snapshots(stored: DataFrame, taken: DataFrame) -> DataFrame:
    """Of taken (series_id, day, value) the first snapshot above zero of every month that stored (series_id, month) lacks."""
    first = taken.where("value > 0").groupBy("series_id", month_start(F.col("day")).alias("month")).agg(F.min(F.struct("day", "value")).alias("x"))
    return insert_absent(stored, first.select("series_id", "month", F.col("x.day").alias("as_of"), F.col("x.value").alias("value")), ["series_id", "month"])


def ingest_report(stored: DataFrame, pulled: DataFrame, key: list[str], series: str, bad: Column) -> DataFrame:
    """What an ingest of many series stores: a bad row fails its own series only, and stored keys aren't written again."""
    per = pulled.groupBy(series).agg(F.count("*").alias("fetched"), F.bool_or(F.coalesce(bad, F.lit(True))).alias("failed"))
    fresh = insert_absent(stored, pulled.dropDuplicates(key), key).groupBy(series).agg(F.count("*").alias("new"))
    return per.join(fresh, series, "left").select(series, "fetched", "failed", F.when(F.col("failed"), 0).otherwise(F.coalesce("new", F.lit(0))).cast("long").alias("inserted"))


def context(history: DataFrame, docs: DataFrame, recent: int = 12, n_docs: int = 3) -> DataFrame:
    """What a forecaster is told at each (series_id, forecast_date): the last values in order, their number, the mean of all, and
    the ids of the last documents (doc_id, published) before that month. Each month keeps its own last documents first, so that
    dates meet months and not documents."""
    at = ["series_id", "forecast_date"]
    nth = F.row_number().over(Window.partitionBy(*at).orderBy(F.desc("observed_at")))
    marked = history.withColumn("nth", nth)
    values = F.array_sort(F.collect_list(F.when(F.col("nth") <= recent, F.struct("observed_at", "value"))))
    known = marked.groupBy(*at).agg(values.alias("recent"), F.avg("value").alias("baseline"), F.max("max_as_of_seen").alias("max_as_of_seen"))
    latest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("published"), "doc_id"))
    months = docs.withColumn("month", month_start(F.col("published"))).withColumn("nth", latest("month")).where(F.col("nth") <= n_docs).drop("nth")
    # documents and dates in one order, a few rows a month: a date reads how many documents lie before it, and meets the last ones by their number
    oldest = Window.orderBy("published", F.desc("doc_id"))
    numbered = months.select("doc_id", F.row_number().over(oldest).alias("no"))
    counted = months.groupBy(F.col("month").alias("day")).agg(F.count("*").alias("k")).withColumn("is_date", F.lit(False)).unionByName(history.select(F.col("forecast_date").alias("day"), F.lit(0).cast("long").alias("k"), F.lit(True).alias("is_date")).distinct())
    upto = F.sum("k").over(Window.orderBy("day", F.desc("is_date")).rowsBetween(Window.unboundedPreceding, 0))
    asked = counted.withColumn("upto", upto).where("is_date").select(F.col("day").alias("forecast_date"), "upto")
    told = asked.where("upto > 0").select("forecast_date", "upto", F.explode(F.sequence(F.greatest(F.lit(1), F.col("upto") - n_docs + 1), F.col("upto"))).alias("no")).join(numbered, "no").withColumn("nth", F.col("upto") - F.col("no") + 1)
    ids = told.groupBy("forecast_date").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    return known.join(ids, "forecast_date", "left")
