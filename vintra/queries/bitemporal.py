"""As-of reads, writes and validation over the derived vintages."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintra.functions.scalar import quantised
from vintra.operators import asof, joins, validate, writes
from vintra.queries.base import DAILY, FIRST, KNOWN, LAST, MONTHLY, OBS, QUESTIONS, RESOLUTIONS, daily, day, obs, q, query, questions, resolutions, table
from vintra.sources.merge import MergedTable
from vintra.sources.scratch import shared_dir


def cut() -> Column:
    """The day of the as-of reads; made when called, as it needs a session."""
    return day("1998-06-30")


SERIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
KEYS = ["series_id", "observed_at"]


@query(f"WITH {OBS}, keys AS (SELECT DISTINCT series_id, observed_at, cutoff FROM obs CROSS JOIN (VALUES (DATE '1997-03-15'), (DATE '1999-01-01')) c(cutoff)) SELECT k.series_id, k.observed_at, k.cutoff, (SELECT arg_max(CASE WHEN value IS NULL THEN -1 ELSE value END, as_of) FROM obs o WHERE o.series_id = k.series_id AND o.observed_at = k.observed_at AND as_of <= cutoff) AS value FROM keys k")
def a1_scalar_as_of(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d)
    keys = o.select("series_id", "observed_at").distinct().select("*", F.explode(F.array(day("1997-03-15"), day("1999-01-01"))).alias("cutoff"))
    # a null latest value shows as -1, to tell it from no vintage at all
    return asof.scalar(o.withColumn("value", F.coalesce("value", F.lit(-1.0))), keys)


@query(f"WITH {OBS}, {KNOWN} SELECT observed_at, " + ", ".join(f"max(CASE WHEN series_id = '{s}' THEN value END) AS \"{s}\"" for s in SERIES) + " FROM known GROUP BY observed_at")
def a2_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return asof.snapshot(obs(spark, d), cut(), SERIES)


@query(f"WITH {OBS}, {KNOWN} SELECT observed_at, as_of, value FROM known WHERE series_id = '2-HIGH'")
def a3_series_as_of(spark: SparkSession, d: str) -> DataFrame:
    return asof.known(obs(spark, d).where("series_id = '2-HIGH'"), cut()).select("observed_at", "as_of", "value")


@query(f"WITH {OBS} SELECT observed_at, as_of, value FROM obs WHERE series_id = '1-URGENT' AND observed_at BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def a4_vintage_history(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).where("series_id = '1-URGENT' and observed_at between date '1996-01-01' and date '1996-12-31'").select("observed_at", "as_of", "value").orderBy("observed_at", "as_of")


@query(f"WITH {OBS}, {MONTHLY} SELECT series_id, forecast_date, count(*)::BIGINT AS periods, count(value)::BIGINT AS filled, max(as_of) AS newest FROM monthly GROUP BY ALL")
def a5_known_at_every_month(spark: SparkSession, d: str) -> DataFrame:
    rows = asof.known_monthly(obs(spark, d), FIRST, LAST)
    return rows.groupBy("series_id", "forecast_date").agg(F.count("*").alias("periods"), F.count("value").alias("filled"), F.max("as_of").alias("newest"))


@query(f"WITH {OBS}, c(cutoff) AS (VALUES (DATE '1996-05-17'), (DATE '1998-06-30'), (DATE '2000-02-29')) SELECT cutoff, series_id, observed_at, max(as_of) AS as_of, arg_max(coalesce(value, -1), as_of) AS value FROM obs JOIN c ON as_of <= cutoff GROUP BY ALL")
def a5_known_at_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    cuts = spark.createDataFrame([("1996-05-17",), ("1998-06-30",), ("2000-02-29",)], "c string").select(F.col("c").cast("date").alias("cutoff"))
    return asof.known_at(obs(spark, d), cuts).select("cutoff", "series_id", "observed_at", "as_of", F.coalesce("value", F.lit(-1.0)).alias("value"))


@query(f"WITH {OBS} SELECT series_id, observed_at, min(as_of) AS first_as_of, arg_min(value, as_of) AS first_value FROM obs WHERE value IS NOT NULL GROUP BY ALL")
def a6_first_release(spark: SparkSession, d: str) -> DataFrame:
    return asof.first_releases(obs(spark, d))


@query(f"WITH {OBS} SELECT series_id, max(as_of) AS latest_as_of, count(*)::BIGINT AS vintages FROM obs WHERE as_of <= DATE '1998-06-30' GROUP BY ALL")
def a7_a8_clip_and_latest_vintage(spark: SparkSession, d: str) -> DataFrame:
    clipped = asof.until(obs(spark, d), cut())
    return asof.latest_vintage(clipped).join(clipped.groupBy("series_id").agg(F.count("*").alias("vintages")), "series_id")


LAGS = """starts AS (SELECT series_id, min(as_of) AS start FROM obs GROUP BY ALL),
newest AS (SELECT o.series_id, max(observed_at) AS newest FROM obs o JOIN starts s ON o.series_id = s.series_id AND as_of = start GROUP BY ALL),
firsts AS (SELECT series_id, observed_at, min(as_of) AS first_as_of FROM obs WHERE value IS NOT NULL GROUP BY ALL),
lags AS (SELECT f.series_id, ceil(quantile_cont((first_as_of - observed_at)::DOUBLE, 0.9))::INT AS lag FROM firsts f JOIN newest n ON f.series_id = n.series_id AND observed_at > newest GROUP BY ALL)"""


@query(f"WITH {OBS}, {LAGS} SELECT series_id, lag FROM starts LEFT JOIN lags USING (series_id)")
def a9_release_lag(spark: SparkSession, d: str) -> DataFrame:
    return asof.release_lags(obs(spark, d))


@query(f"WITH {OBS}, {LAGS} SELECT o.series_id, observed_at, value, CASE WHEN as_of = start AND observed_at + lag < start THEN observed_at + lag ELSE as_of END AS as_of FROM obs o JOIN starts USING (series_id) LEFT JOIN lags USING (series_id)")
def a10_backfill(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d)
    return asof.backfill_first(o, asof.release_lags(o)).select("series_id", "observed_at", "value", "as_of")


@query(f"WITH {OBS}, {KNOWN} SELECT a.series_id, a.observed_at, {q('(a.value / b.value - 1) * 100', 4)} AS value FROM known a JOIN known b ON a.series_id = b.series_id AND a.observed_at = b.observed_at + INTERVAL 1 YEAR WHERE a.value IS NOT NULL AND b.value IS NOT NULL AND a.observed_at >= DATE '1997-01-01'")
def a11_point_in_time_view(spark: SparkSession, d: str) -> DataFrame:
    view = asof.year_on_year(asof.known(obs(spark, d), cut()), ["series_id"])
    return view.where("value is not null and observed_at >= date '1997-01-01'").select(*KEYS, quantised(F.col("value"), 4).alias("value"))


@query(f"""WITH {OBS}, firsts AS (SELECT series_id, observed_at, min(as_of) AS v, arg_min(value, as_of) AS value FROM obs WHERE value IS NOT NULL GROUP BY ALL),
bases AS (SELECT f.series_id, f.observed_at, f.v, f.value, arg_max(coalesce(o.value, -1), o.as_of) AS base FROM firsts f JOIN obs o ON o.series_id = f.series_id AND o.observed_at + INTERVAL 1 YEAR = f.observed_at AND o.as_of <= f.v GROUP BY ALL)
SELECT series_id, observed_at, v AS actual_as_of, {q('(value / base - 1) * 100', 4)} AS actual FROM bases WHERE base <> -1""")
def a12_resolve_first_release_yoy(spark: SparkSession, d: str) -> DataFrame:
    return asof.actuals(obs(spark, d), yoy=True).select(*KEYS, "actual_as_of", quantised(F.col("actual"), 4).alias("actual"))


@query(f"WITH {OBS}, last AS (SELECT series_id, observed_at, arg_max(coalesce(value, -1), as_of) AS actual, count(value) AS n FROM obs GROUP BY ALL), top AS (SELECT series_id, max(as_of) AS actual_as_of FROM obs GROUP BY ALL) SELECT series_id, observed_at, actual, actual_as_of FROM last JOIN top USING (series_id) WHERE actual <> -1 AND n > 0")
def a12_resolve_latest(spark: SparkSession, d: str) -> DataFrame:
    return asof.actuals(obs(spark, d), resolve_with="latest")


@query(f"WITH {OBS} SELECT series_id, observed_at, min(as_of) AS first_as_of, arg_min(value, as_of) AS first_value FROM obs WHERE NOT reconstructed AND value IS NOT NULL AND as_of <= DATE '1998-06-30' GROUP BY ALL")
def a13_first_live(spark: SparkSession, d: str) -> DataFrame:
    return asof.first_live(obs(spark, d), cut())


@query(f"WITH {OBS} SELECT series_id, observed_at, max(as_of) AS as_of, arg_max(value, as_of) AS value FROM obs WHERE value IS NOT NULL AND as_of <= DATE '1998-06-30' GROUP BY ALL")
def a14_latest_known(spark: SparkSession, d: str) -> DataFrame:
    return asof.latest_known(obs(spark, d), cut())


@query(f"WITH {OBS} SELECT series_id, observed_at, max(as_of) AS as_of, arg_max(coalesce(value, -1), as_of) AS value FROM obs GROUP BY ALL")
def a15_latest_stored(spark: SparkSession, d: str) -> DataFrame:
    return asof.known(obs(spark, d), day("9999-12-31")).withColumn("value", F.coalesce("value", F.lit(-1.0)))


@query(f"""WITH {OBS}, rounded AS (SELECT series_id, observed_at, as_of, floor(value / 50000) AS value FROM obs),
prior AS (SELECT series_id, observed_at, 1.0::DOUBLE AS prior FROM rounded WHERE month(observed_at) = 6 GROUP BY ALL),
marked AS (SELECT r.*, row_number() OVER w AS nth, lag(value) OVER w AS before FROM rounded r WINDOW w AS (PARTITION BY series_id, observed_at ORDER BY as_of))
SELECT m.series_id, m.observed_at, as_of, value FROM marked m LEFT JOIN prior p ON m.series_id = p.series_id AND m.observed_at = p.observed_at
WHERE CASE WHEN nth > 1 THEN value IS DISTINCT FROM before ELSE p.series_id IS NULL OR value IS DISTINCT FROM prior END""")
def a16_collapse_unchanged(spark: SparkSession, d: str) -> DataFrame:
    rounded = obs(spark, d).select(*KEYS, "as_of", F.floor(F.col("value") / 50000).cast("double").alias("value"))
    prior = rounded.where(F.month("observed_at") == 6).select(*KEYS, F.lit(1.0).alias("value")).distinct()
    return asof.collapse_unchanged(rounded, prior)


@query(f"WITH {DAILY}, asks AS (SELECT DISTINCT event_type AS series_id, ts::DATE + 3 AS asked FROM events) SELECT series_id, asked, (SELECT max(day) FROM daily x WHERE x.series_id = a.series_id AND day <= asked AND day % 2 = 0) AS day, (SELECT arg_max(value, day) FROM daily x WHERE x.series_id = a.series_id AND day <= asked AND day % 2 = 0) AS value FROM asks a".replace("day % 2", "day(day) % 2"))
def a17_j7_value_at(spark: SparkSession, d: str) -> DataFrame:
    asks = table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.date_add(F.col("ts").cast("date"), 3).alias("asked")).distinct()
    return joins.asof_join(asks, daily(spark, d).where(F.dayofmonth("day") % 2 == 0), ["series_id"], "asked", "day", "value")


@query("SELECT user_id, max(ts) AS seen, arg_max(value, struct_pack(ts := ts, e := event_id)) AS price FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id")
def a18_price_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("ts < timestamp '2024-01-16'")
    return e.groupBy("user_id").agg(F.max("ts").alias("seen"), F.max_by("value", F.struct("ts", "event_id")).alias("price"))


@query(f"WITH {OBS}, recent AS (SELECT * FROM obs WHERE observed_at >= DATE '1999-01-01'), a AS (SELECT series_id, observed_at, arg_max(value, as_of) AS value FROM recent WHERE value IS NOT NULL GROUP BY ALL), b AS (SELECT series_id, observed_at, arg_max(coalesce(value, -1), as_of) AS value FROM recent GROUP BY ALL) SELECT 'falls back' AS rule, series_id, observed_at, value FROM a UNION ALL SELECT 'drops', series_id, observed_at, value FROM b WHERE value <> -1")
def a21_latest_values_two_rules(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d)
    both = [asof.latest_per_period(o, day("1999-01-01"), skip).withColumn("rule", F.lit(name)) for name, skip in (("falls back", True), ("drops", False))]
    return both[0].unionByName(both[1]).select("rule", *KEYS, "value")


@query(f"WITH {OBS}, s AS (SELECT series_id, observed_at AS survey, min(as_of) AS released FROM obs WHERE month(observed_at) % 3 = 1 GROUP BY ALL), a AS (SELECT DISTINCT series_id, forecast_date FROM s CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '1996-06-01', TIMESTAMP '1999-06-01', INTERVAL 6 MONTH))::DATE AS forecast_date)) SELECT a.series_id, forecast_date, max(survey) AS survey FROM a JOIN s ON a.series_id = s.series_id AND released <= forecast_date GROUP BY ALL")
def a22_survey_as_of(spark: SparkSession, d: str) -> DataFrame:
    surveys = obs(spark, d).where(F.month("observed_at") % 3 == 1).groupBy("series_id", F.col("observed_at").alias("survey")).agg(F.min("as_of").alias("released"))
    dates = spark.range(1).select(F.explode(F.sequence(day("1996-06-01"), day("1999-06-01"), F.expr("interval 6 months"))).alias("forecast_date"))
    # a few calendar days: the theta join broadcasts them
    return surveys.join(F.broadcast(dates), surveys["released"] <= dates["forecast_date"]).groupBy("series_id", "forecast_date").agg(F.max("survey").alias("survey"))


@query(f"WITH {OBS}, {KNOWN}, newest AS (SELECT series_id, max(observed_at) AS top FROM known WHERE value IS NOT NULL GROUP BY ALL) SELECT n.series_id, coalesce(a.observed_at, b.observed_at) AS month, coalesce(a.value, b.value) AS nowcast FROM newest n LEFT JOIN known a ON a.series_id = n.series_id AND a.observed_at = DATE '1998-04-01' JOIN known b ON b.series_id = n.series_id AND b.observed_at = top")
def a23_nowcast_as_of(spark: SparkSession, d: str) -> DataFrame:
    return asof.nowcast(asof.known(obs(spark, d), cut()), day("1998-04-01"))


INCOMING = "old AS (SELECT c_custkey AS k, c_name AS v, c_acctbal AS w FROM customer WHERE c_custkey % 3 <> 0), incoming AS (SELECT c_custkey AS k, c_name AS v, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS w FROM customer WHERE c_custkey % 2 = 0)"


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.col("c_acctbal").alias("w"))
    return c.where("k % 3 <> 0"), c.where("k % 2 = 0").withColumn("w", F.when(F.col("k") % 4 != 0, F.col("w")))


@query(f"WITH {INCOMING} SELECT * FROM incoming WHERE k NOT IN (SELECT k FROM old)")
def k1_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    old, new = _tables(spark, d)
    return writes.insert_absent(old, new, ["k"])


@query(f"WITH {INCOMING} SELECT coalesce(i.k, o.k) AS k, coalesce(i.v, o.v) AS v, CASE WHEN i.k IS NULL THEN o.w ELSE i.w END AS w FROM old o FULL JOIN incoming i ON o.k = i.k")
def k2_upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = _tables(spark, d)
    return writes.upsert(old, new, ["k"])


@query(f"WITH {INCOMING} SELECT CASE WHEN o.k IS NULL THEN 'inserted' WHEN o.v IS NOT DISTINCT FROM i.v AND o.w IS NOT DISTINCT FROM i.w THEN 'unchanged' ELSE 'updated' END AS status, count(*)::BIGINT AS n FROM incoming i LEFT JOIN old o ON o.k = i.k GROUP BY 1")
def k3_upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    old, new = _tables(spark, d)
    return writes.upsert_status(old, new, ["k"], ["v", "w"]).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH old AS (SELECT o_orderkey AS forecast_id, 'old' AS category, CASE WHEN o_orderkey % 7 = 0 THEN 'manual' ELSE 'auto' END AS classified_by FROM orders WHERE o_orderkey % 2 = 0),
incoming AS (SELECT o_orderkey AS forecast_id, 'new' AS category, CASE WHEN o_orderkey % 5 = 0 THEN 'manual' ELSE 'auto' END AS classified_by FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(o.forecast_id, i.forecast_id) AS forecast_id, CASE WHEN i.forecast_id IS NULL OR (o.classified_by = 'manual' AND i.classified_by = 'auto') THEN o.category ELSE i.category END AS category,
       CASE WHEN i.forecast_id IS NULL OR (o.classified_by = 'manual' AND i.classified_by = 'auto') THEN o.classified_by ELSE i.classified_by END AS classified_by
FROM old o FULL JOIN incoming i ON o.forecast_id = i.forecast_id""")
def k4_guarded_upsert(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    side = lambda name, keep, manual: table(spark, d, "orders").where(k % keep == 0).select(k.alias("forecast_id"), F.lit(name).alias("category"), F.when(k % manual == 0, "manual").otherwise("auto").alias("classified_by"))
    return writes.guarded_upsert(side("old", 2, 7), side("new", 3, 5), ["forecast_id"])


@query("WITH old AS (SELECT row_number() OVER (ORDER BY c_mktsegment, n) AS id, c_mktsegment AS target, n AS horizon FROM (SELECT DISTINCT c_mktsegment, c_nationkey % 3 AS n FROM customer WHERE c_nationkey % 3 < 2)), wanted AS (SELECT DISTINCT c_mktsegment AS target, CASE WHEN c_nationkey % 4 < 3 THEN c_nationkey % 4 END AS horizon FROM customer), fresh AS (SELECT w.* FROM wanted w LEFT JOIN old o ON o.target = w.target AND o.horizon IS NOT DISTINCT FROM w.horizon WHERE o.id IS NULL), made AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY target NULLS FIRST, horizon NULLS FIRST) AS id, * FROM fresh) SELECT a.id::BIGINT AS id, w.target, w.horizon FROM wanted w JOIN (SELECT * FROM old UNION ALL SELECT * FROM made) a ON a.target = w.target AND a.horizon IS NOT DISTINCT FROM w.horizon")
def k5_get_or_create(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("target"), F.col("c_nationkey").alias("n"))
    old = c.where("n % 3 < 2").select("target", (F.col("n") % 3).alias("horizon")).distinct().withColumn("id", F.row_number().over(Window.orderBy("target", "horizon")).cast("long"))
    wanted = c.select("target", F.when(F.col("n") % 4 < 3, F.col("n") % 4).alias("horizon")).distinct()
    return writes.get_or_create(old, wanted, ["target", "horizon"], "id")[0].select("id", "target", "horizon")


@query(f"WITH {QUESTIONS}, {RESOLUTIONS} SELECT question_id, actual_value, actual_outcome, CASE WHEN actual_value IS NOT NULL THEN coalesce(latest_value, actual_value) END AS latest_value FROM resolutions JOIN questions USING (question_id) WHERE domain = 'economy'")
def k6_r12_refresh_latest(spark: SparkSession, d: str) -> DataFrame:
    q_, r = questions(spark, d), resolutions(spark, d)
    return r.join(q_.where("domain = 'economy'"), "question_id", "left_semi").select("question_id", "actual_value", "actual_outcome", F.when(F.col("actual_value").isNotNull(), F.coalesce("latest_value", "actual_value")).alias("latest_value"))


@query("SELECT event_type, max(ts) AS newest, max(ts) - INTERVAL 2 DAY AS resume_from, count(*) FILTER (WHERE ts >= m - INTERVAL 2 DAY)::BIGINT AS again FROM (SELECT *, max(ts) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type")
def k9_incremental_cursor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    top = e.groupBy("event_type").agg(F.max("ts").alias("newest")).withColumn("resume_from", F.col("newest") - F.expr("interval 2 days"))
    again = e.join(top, "event_type").where("ts >= resume_from").groupBy("event_type").agg(F.count("*").alias("again"))
    return top.join(again, "event_type")


MARKS = """days AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE ts IS NOT NULL), {name} AS (SELECT user_id, arg_min(last, island) AS through FROM (
  SELECT user_id, island, max(day) AS last FROM (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island FROM {of}) GROUP BY ALL) GROUP BY user_id)"""


@query(f"WITH {MARKS.format(name='marks', of='days')} SELECT d.user_id, through, count(*) FILTER (WHERE day > through)::BIGINT AS days_after, max(day) AS newest FROM days d JOIN marks USING (user_id) GROUP BY ALL")
def k9_gapless_mark(spark: SparkSession, d: str) -> DataFrame:
    """Up to which day each user's days are complete, and how many lie behind a gap."""
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    marks = writes.gapless_through(days, ["user_id"], "day")
    rest = days.where("day is not null").distinct().join(marks, "user_id").groupBy("user_id", "through").agg(F.count(F.when(F.col("day") > F.col("through"), 1)).alias("days_after"), F.max("day").alias("newest"))
    return rest.select("user_id", "through", "days_after", "newest")


@query(f"WITH {MARKS.format(name='whole', of='days')} SELECT user_id, through FROM whole WHERE user_id IN (SELECT user_id FROM days WHERE day <= DATE '2024-01-15')")
def k9_extended_mark(spark: SparkSession, d: str) -> DataFrame:
    """Marks of the days until mid-month, moved on by the later ones: only where nothing lies between."""
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    marks = writes.gapless_through(days.where(F.col("day") <= day("2024-01-15")), ["user_id"], "day")
    moved = writes.gapless_through(days.where(F.col("day") > day("2024-01-15")), ["user_id"], "day", marks)
    return moved.join(marks.select("user_id"), "user_id", "left_semi").select("user_id", "through")


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*)::BIGINT AS n, sum(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS versions FROM orders GROUP BY ALL")
def k1_k2_partition_merge(spark: SparkSession, d: str) -> DataFrame:
    """Orders merged into a table by month in three steps: most of them, then all (new ones alone are written), then changed ones."""
    o = table(spark, d, "orders").select("o_orderkey", F.trunc("o_orderdate", "month").cast("date").alias("month"), F.lit(1).alias("version"))
    merged = MergedTable(spark, f"{shared_dir(spark)}/merge-{uuid.uuid4().hex}", ["month", "o_orderkey"], "month")
    merged.insert(o.where("o_orderkey % 5 <> 0"))
    merged.insert(o)
    merged.upsert(o.where("o_orderkey % 3 = 0").withColumn("version", F.lit(2)), ["version"])
    return merged.read().groupBy("month").agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


@query(f"""WITH {OBS}, stored AS (SELECT series_id, observed_at, arg_max(coalesce(value, -1), as_of) AS old, arg_max(reconstructed, as_of) AS oldr FROM obs WHERE as_of <= DATE '1998-06-30' GROUP BY ALL),
pulled AS (SELECT series_id, observed_at, as_of, value, reconstructed FROM obs WHERE as_of > DATE '1998-06-30' AND as_of <= DATE '1998-09-30')
SELECT p.series_id, p.observed_at, p.as_of, p.value, p.reconstructed FROM pulled p LEFT JOIN stored s ON s.series_id = p.series_id AND s.observed_at = p.observed_at
WHERE p.value > 0 AND ((p.reconstructed AND s.oldr IS NULL) OR (NOT p.reconstructed AND (s.oldr IS NULL OR p.value <> s.old OR s.oldr)))""")
def k10_live_row_rules(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d)
    return writes.live_rows(o.where("as_of > date '1998-06-30' and as_of <= date '1998-09-30'"), asof.until(o, cut())).select(*KEYS, "as_of", "value", "reconstructed")


@query(f"WITH {OBS}, {MONTHLY} SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE as_of >= forecast_date)::BIGINT AS leaks FROM monthly")
def v1_no_lookahead(spark: SparkSession, d: str) -> DataFrame:
    seen = asof.known_monthly(obs(spark, d), FIRST, LAST)
    validate.assert_no_lookahead(seen.withColumn("data_as_of", F.date_sub("forecast_date", 1)), "as_of", "data_as_of")
    return seen.agg(F.count("*").alias("n"), F.count(F.when(F.col("as_of") >= F.col("forecast_date"), 1)).alias("leaks"))


@query(f"WITH {QUESTIONS} SELECT target, target_date, horizon_months, lead_days, question_key, count(*)::BIGINT AS n FROM questions GROUP BY ALL HAVING count(*) > 1")
def v2_unique_questions(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(questions(spark, d), ["target", "target_date", "horizon_months", "lead_days", "question_key"])


@query(f"WITH {QUESTIONS}, broken AS (SELECT question_id, question_type, CASE WHEN question_id % 50 = 0 THEN NULL ELSE horizon_months END AS horizon_months, CASE WHEN question_id % 7 = 0 THEN 5 ELSE lead_days END AS lead_days, CASE WHEN question_id % 11 = 0 THEN NULL ELSE question_key END AS question_key FROM questions), t AS (SELECT *, CASE question_type WHEN 'numeric_interval' THEN horizon_months IS NOT NULL WHEN 'probability' THEN lead_days IS NOT NULL ELSE question_key IS NOT NULL END AS fits FROM broken), p AS (SELECT question_id, CASE WHEN NOT fits THEN 'type' WHEN (horizon_months IS NOT NULL)::INT + (lead_days IS NOT NULL)::INT <> 1 THEN 'horizon' END AS problem FROM t) SELECT * FROM p WHERE problem IS NOT NULL")
def v3_question_consistency(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("question_id")
    broken = questions(spark, d).withColumn("horizon_months", F.when(k % 50 != 0, F.col("horizon_months"))).withColumn("lead_days", F.when(k % 7 == 0, 5).otherwise(F.col("lead_days"))).withColumn("question_key", F.when(k % 11 != 0, F.col("question_key")))
    return validate.question_violations(broken).select("question_id", "problem")


@query(f"WITH {QUESTIONS}, {RESOLUTIONS}, broken AS (SELECT question_id, actual_value, CASE WHEN question_id % 13 = 0 THEN NULL ELSE actual_outcome END AS actual_outcome FROM resolutions) SELECT question_id FROM broken JOIN questions USING (question_id) WHERE CASE WHEN question_type = 'numeric_interval' THEN actual_value IS NULL OR actual_outcome IS NOT NULL ELSE actual_outcome IS NULL OR actual_value IS NOT NULL END")
def v4_answer_fits(spark: SparkSession, d: str) -> DataFrame:
    broken = resolutions(spark, d).withColumn("actual_outcome", F.when(F.col("question_id") % 13 != 0, F.col("actual_outcome")))
    return validate.answer_violations(questions(spark, d), broken).select("question_id")


@query("SELECT o_orderkey AS forecast_id FROM orders WHERE (o_orderkey % 103)::DOUBLE / 100 > 1 OR o_totalprice * 0.9::DOUBLE > CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice * 0.5::DOUBLE ELSE o_totalprice END")
def v5_probability_and_interval(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    f = table(spark, d, "orders").select(k.alias("forecast_id"), ((k % 103).cast("double") / 100).alias("p"), (v * 0.9).alias("lower"), F.when(k % 17 == 0, v * 0.5).otherwise(v).alias("upper"))
    return validate.probability_violations(f, "p", "lower", "upper").select("forecast_id")
