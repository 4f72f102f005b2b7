"""Projections, joins, aggregates, windows, sorts and set operations."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintra.functions import calendar, scalar
from vintra.functions.scalar import quantised
from vintra.operators import asof, joins, series
from vintra.queries.base import BINARY, DAILY, FORECASTS, FIRST, KNOWN, LAST, MONTHLY, OBS, POSTMORTEMS, QUESTIONS, RESOLUTIONS, binary, daily, day, forecasts, obs, postmortems, q, query, questions, resolutions, table

CUT = "1998-06-30"
MI = "(year(observed_at) * 12 + month(observed_at) - 1)"
#: The known series at one cutoff without nulls, with month numbers.
K = f"{OBS}, {KNOWN}, k AS (SELECT *, {MI} AS m FROM known WHERE value IS NOT NULL)"


def known(spark: SparkSession, d: str) -> DataFrame:
    return asof.known(obs(spark, d), day(CUT)).where("value is not null")


# ---- projections and predicates


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') AND ts >= TIMESTAMP '2024-01-10' AND user_id % 3 = 0")
def f1_f2_f3_optional_predicates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    start, end, types, everyone = "2024-01-10", None, ["click", "view", "purchase"], False
    for wanted, condition in ((start, F.col("ts") >= F.lit(start).cast("timestamp")), (end, F.col("ts") < F.lit(end).cast("timestamp")), (types, F.col("event_type").isin(types)), (not everyone, F.col("user_id") % 3 == 0)):
        e = e.where(condition) if wanted else e
    return e.select("event_id", "user_id")


@query(f"WITH {QUESTIONS} SELECT a.question_id, b.question_id AS other_id FROM questions a JOIN questions b ON a.target = b.target AND a.target_date = b.target_date AND a.horizon_months IS NOT DISTINCT FROM b.horizon_months AND a.lead_days IS NOT DISTINCT FROM b.lead_days WHERE a.question_id < b.question_id")
def f4_null_safe_equality(spark: SparkSession, d: str) -> DataFrame:
    a, b = questions(spark, d).alias("a"), questions(spark, d).alias("b")
    same = (F.col("a.target") == F.col("b.target")) & (F.col("a.target_date") == F.col("b.target_date")) & F.col("a.horizon_months").eqNullSafe(F.col("b.horizon_months")) & F.col("a.lead_days").eqNullSafe(F.col("b.lead_days"))
    return a.join(b, same & (F.col("a.question_id") < F.col("b.question_id"))).select(F.col("a.question_id"), F.col("b.question_id").alias("other_id"))


@query(f"WITH {QUESTIONS} SELECT CASE WHEN question_type = 'numeric_interval' THEN 'numeric' WHEN starts_with(question_key, 'BUILDING') THEN 'curated' WHEN question_key IS NOT NULL THEN 'threshold' ELSE 'other' END AS kind, split_part(question_key, '>=', 2) AS level, count(*)::BIGINT AS n FROM questions GROUP BY ALL")
def f5_f6_prefix_and_kind(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("question_key")
    kind = F.when(F.col("question_type") == "numeric_interval", "numeric").when(key.startswith("BUILDING"), "curated").when(key.isNotNull(), "threshold").otherwise("other")
    return questions(spark, d).groupBy(kind.alias("kind"), F.split_part(key, F.lit(">="), F.lit(2)).alias("level")).agg(F.count("*").alias("n"))


@query("SELECT event_type, (props ->> '$.k')::INT AS k, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def f7_json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE)::VARCHAR AS local_day, count(*)::BIGINT AS n FROM events GROUP BY 1")
def f8_time_zone_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(calendar.local_day(F.col("ts")).cast("string").alias("local_day")).agg(F.count("*").alias("n"))


@query(f"WITH {DAILY}, r AS (SELECT series_id, day, floor(value / 10) AS level FROM daily), m AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY series_id) AS n, lag(level) OVER w AS before FROM r WINDOW w AS (PARTITION BY series_id ORDER BY day)) SELECT series_id, day, level FROM m WHERE nth = 1 OR nth = n OR level IS DISTINCT FROM before")
def f9_change_points(spark: SparkSession, d: str) -> DataFrame:
    r = daily(spark, d).select("series_id", "day", F.floor(F.col("value") / 10).cast("double").alias("level"))
    return series.change_points(r, ["series_id"], "day", "level")


SPARSE = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS half, CASE WHEN doc_id % 4 = 0 THEN n_chars END AS quarter, CASE WHEN doc_id % 10 <> 0 THEN n_chars END AS most FROM documents"


@query(f"SELECT doc_id, half, most FROM ({SPARSE})")
def f10_drop_sparse_columns(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("n_chars"), F.col("doc_id")
    wide = table(spark, d, "documents").select("doc_id", F.when(k % 2 == 0, n).alias("half"), F.when(k % 4 == 0, n).alias("quarter"), F.when(k % 10 != 0, n).alias("most"))
    return series.without_sparse(wide, ["half", "quarter", "most"])[0]


@query(f"WITH {OBS}, {MONTHLY}, last AS (SELECT series_id, forecast_date, max(observed_at) AS newest, arg_max(value, observed_at) AS value FROM history GROUP BY ALL) SELECT series_id, forecast_date, CASE WHEN (year(forecast_date - 1) * 12 + month(forecast_date - 1)) - (year(newest) * 12 + month(newest)) <= 0 THEN value END AS fresh FROM last")
def f11_w18_staleness(spark: SparkSession, d: str) -> DataFrame:
    h = asof.known_monthly(obs(spark, d), FIRST, LAST).where("value is not null")
    last = h.groupBy("series_id", "forecast_date").agg(F.max(F.struct("observed_at", "value")).alias("x"))
    return last.select("series_id", "forecast_date", series.fresh(F.col("x.value"), F.col("x.observed_at"), calendar.cutoff_of(F.col("forecast_date")), months=0).alias("fresh"))


@query(f"WITH {QUESTIONS}, {RESOLUTIONS} SELECT q.question_id, CASE WHEN DATE '1998-06-30' - (q.target_date - 30) > 3 THEN 'backtest' ELSE 'live' END AS mode FROM questions q LEFT JOIN resolutions r USING (question_id) WHERE q.target_date - 30 <= DATE '1998-06-30' AND q.target_date > DATE '1998-06-30' AND (r.question_id IS NULL OR r.actual_as_of > q.target_date - 30)")
def f13_due_questions(spark: SparkSession, d: str) -> DataFrame:
    asked = F.date_sub("target_date", 30)
    rows = questions(spark, d).join(resolutions(spark, d).select("question_id", "actual_as_of"), "question_id", "left").where((asked <= day(CUT)) & (F.col("target_date") > day(CUT)) & (F.col("actual_as_of").isNull() | (F.col("actual_as_of") > asked)))
    return rows.select("question_id", F.when(F.datediff(day(CUT), asked) > 3, "backtest").otherwise("live").alias("mode"))


@query(f"WITH {BINARY} SELECT question_id, lead, ask_date - lead AS ask_on FROM (SELECT DISTINCT question_id, ask_date, outcome, lang FROM binary_frame) CROSS JOIN (VALUES (7), (30), (90)) l(lead) WHERE lang IN ('en', 'fr') AND outcome IS NOT NULL AND ask_date - lead >= DATE '2023-01-15'")
def f14_j11_curated_eligibility(spark: SparkSession, d: str) -> DataFrame:
    rows = binary(spark, d).select("question_id", "ask_date", "outcome", "lang").distinct().where(F.col("lang").isin("en", "fr") & F.col("outcome").isNotNull())
    asked = rows.select("question_id", "ask_date", F.explode(F.array(F.lit(7), F.lit(30), F.lit(90))).alias("lead")).withColumn("ask_on", F.date_sub("ask_date", F.col("lead")))
    return asked.where(F.col("ask_on") >= day("2023-01-15")).drop("ask_date")


# ---- joins

STAR = f"{QUESTIONS}, {RESOLUTIONS}, {FORECASTS}"


def star(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).join(questions(spark, d), "question_id").join(resolutions(spark, d), "question_id")


@query(f"WITH {STAR} SELECT forecast_id, question_id, target, model_type, {q('prediction - actual_value', 2)} AS error FROM forecasts JOIN questions USING (question_id) JOIN resolutions USING (question_id) WHERE question_type = 'numeric_interval'")
def j1_star(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d).where("question_type = 'numeric_interval'").select("forecast_id", "question_id", "target", "model_type", quantised(F.col("prediction") - F.col("actual_value"), 2).alias("error"))


@query(f"WITH {QUESTIONS}, {RESOLUTIONS} SELECT question_id, target_date FROM questions WHERE target_date <= DATE '1998-06-30' AND question_id NOT IN (SELECT question_id FROM resolutions)")
def j2_open_questions(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).where(F.col("target_date") <= day(CUT)).join(resolutions(spark, d), "question_id", "left_anti").select("question_id", "target_date")


@query(f"WITH {FORECASTS}, {POSTMORTEMS} SELECT f.forecast_id FROM forecasts f LEFT JOIN postmortems p USING (forecast_id) WHERE is_backtest AND (p.forecast_id IS NULL OR p.classified_by = 'auto')")
def j3_anti_or_auto(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).where("is_backtest").join(postmortems(spark, d), "forecast_id", "left")
    return f.where("classified_by is null or classified_by = 'auto'").select("forecast_id")


@query(f"WITH {QUESTIONS}, {RESOLUTIONS}, {FORECASTS}, {POSTMORTEMS} SELECT f.forecast_id, q.target, r.actual_outcome, p.category FROM forecasts f JOIN questions q USING (question_id) LEFT JOIN resolutions r USING (question_id) LEFT JOIN postmortems p ON p.forecast_id = f.forecast_id WHERE q.domain = 'ai'")
def j4_left_enrichment(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).join(questions(spark, d).where("domain = 'ai'"), "question_id").join(resolutions(spark, d), "question_id", "left")
    return f.join(postmortems(spark, d), "forecast_id", "left").select("forecast_id", "target", "actual_outcome", "category")


@query(f"WITH {BINARY} SELECT a.question_id, a.ask_date, a.p AS model_p, b.p AS market_p FROM binary_frame a JOIN binary_frame b ON a.question_id = b.question_id AND a.ask_date = b.ask_date WHERE a.component = 'llm' AND b.component = 'market'")
def j5_model_against_market(spark: SparkSession, d: str) -> DataFrame:
    b = binary(spark, d)
    side = lambda c, name: b.where(F.col("component") == c).select("question_id", "ask_date", F.col("p").alias(name))
    return side("llm", "model_p").join(side("market", "market_p"), ["question_id", "ask_date"])


@query(f"WITH {BINARY} SELECT a.question_id, a.p, b.p AS p_base FROM binary_frame a JOIN binary_frame b USING (question_id) WHERE a.component = 'market' AND b.component = 'base_rate'")
def j6_one_to_one_merge(spark: SparkSession, d: str) -> DataFrame:
    b = binary(spark, d)
    side = lambda c: b.where(F.col("component") == c).select("question_id", "p")
    return joins.merge_one_to_one(side("market"), side("base_rate"), ["question_id"], "_base")


@query(f"WITH {OBS}, c(cutoff) AS (VALUES (DATE '1996-12-31'), (DATE '1997-12-31'), (DATE '1998-12-31')) SELECT cutoff, series_id, count(*)::BIGINT AS n, max(as_of) AS newest FROM c JOIN obs ON as_of <= cutoff GROUP BY ALL")
def j8_theta_join(spark: SparkSession, d: str) -> DataFrame:
    cuts = spark.range(1).select(F.explode(F.array(day("1996-12-31"), day("1997-12-31"), day("1998-12-31"))).alias("cutoff"))
    rows = joins.last_day_before(F.broadcast(cuts), obs(spark, d).withColumnRenamed("as_of", "published"), [])
    return rows.groupBy("cutoff", "series_id").agg(F.count("*").alias("n"), F.max("published").alias("newest"))


@query(f"WITH {QUESTIONS}, {FORECASTS} SELECT question_id FROM questions q WHERE EXISTS (SELECT 1 FROM forecasts f WHERE f.question_id = q.question_id AND NOT is_backtest)")
def j9_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).join(forecasts(spark, d).where("not is_backtest"), "question_id", "left_semi").select("question_id")


PROBE = ["rights", "license", "password", "the", "that"]


@query(f"WITH probe AS (SELECT unnest({PROBE}) AS term), t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS term FROM documents) SELECT doc_id, count(*)::BIGINT AS n FROM t JOIN probe USING (term) GROUP BY doc_id")
def j10_lateral_probe(spark: SparkSession, d: str) -> DataFrame:
    """One query, its terms beside every document: an equi-join on the documents' terms."""
    probe = spark.createDataFrame([(t,) for t in PROBE], "term string")
    terms = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("term"))
    return terms.join(probe, "term").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type AS next_type, before, count(*)::BIGINT AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY ALL")
def j13_adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("before", F.lag("event_type").over(w)).where("before is not null")
    return e.groupBy("user_id", F.col("event_type").alias("next_type"), "before").agg(F.count("*").alias("n"))


# ---- aggregates


@query(f"WITH {OBS} SELECT p.p AS series_id, count(o.series_id)::BIGINT AS n, count(DISTINCT observed_at)::BIGINT AS periods, min(as_of) AS first_day, max(as_of) AS last_day, count(*) FILTER (WHERE o.series_id IS NOT NULL AND value IS NULL)::BIGINT AS holes FROM (SELECT DISTINCT o_orderpriority AS p FROM orders UNION ALL SELECT 'none') p LEFT JOIN obs o ON o.series_id = p.p GROUP BY 1")
def g1_g2_coverage_report(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series_id")).distinct().unionAll(spark.range(1).select(F.lit("none").alias("series_id")))
    stats = obs(spark, d).groupBy("series_id").agg(F.count("*").alias("n"), F.countDistinct("observed_at").alias("periods"), F.min("as_of").alias("first_day"), F.max("as_of").alias("last_day"), F.count(F.when(F.col("value").isNull(), 1)).alias("holes"))
    return names.join(stats, "series_id", "left").na.fill(0, ["n", "periods", "holes"])


E_ = "prediction - actual_value"


@query(f"WITH {STAR}, t AS (SELECT *, {E_} AS e, CASE WHEN lower IS NOT NULL THEN actual_value BETWEEN lower AND upper END AS hit FROM forecasts JOIN questions USING (question_id) JOIN resolutions USING (question_id) WHERE actual_value IS NOT NULL) SELECT target, model_type, count(*)::BIGINT AS n, {q('sqrt(avg(e * e))', 2)} AS rmse, {q('avg(abs(e))', 2)} AS mae, {q('avg(e)', 2)} AS bias, {q('avg(hit::INT)')} AS coverage, {q('sqrt(avg((e / nullif(actual_value, 0)) * (e / nullif(actual_value, 0))))', 3)} AS relative_rmse FROM t GROUP BY ALL")
def g3_g4_m15_numeric_scorecard(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("prediction") - F.col("actual_value")
    share = F.try_divide(e, "actual_value")
    hit = F.when(F.col("lower").isNotNull(), F.col("actual_value").between(F.col("lower"), F.col("upper")))
    rows = star(spark, d).where("actual_value is not null")
    return rows.groupBy("target", "model_type").agg(
        F.count("*").alias("n"), quantised(F.sqrt(F.avg(e * e)), 2).alias("rmse"), quantised(F.avg(F.abs(e)), 2).alias("mae"), quantised(F.avg(e), 2).alias("bias"), quantised(F.avg(hit.cast("int"))).alias("coverage"), quantised(F.sqrt(F.avg(share * share)), 3).alias("relative_rmse"),
    )


@query(f"WITH {STAR} SELECT target, category, count(*)::BIGINT AS n FROM forecasts JOIN questions USING (question_id) JOIN (SELECT o_orderkey AS forecast_id, CASE o_orderkey % 4 WHEN 0 THEN 'expected_variance' WHEN 1 THEN 'bad_data' WHEN 2 THEN 'bad_model' ELSE 'regime_change' END AS category FROM orders WHERE o_orderkey % 5 = 0) USING (forecast_id) GROUP BY ALL")
def g8_category_histogram(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).join(postmortems(spark, d), "forecast_id").join(questions(spark, d), "question_id").groupBy("target", "category").agg(F.count("*").alias("n"))


CALLS = "calls AS (SELECT conv_id, turn, role AS model, length(text) // 4 AS tokens, CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 15 END AS price FROM conversations)"


@query(f"WITH {CALLS} SELECT model, count(*)::BIGINT AS n, coalesce(sum(tokens), 0)::BIGINT AS tokens, {q('coalesce(sum(tokens * price)::DOUBLE / 1e6, 0)')} AS cost, (CASE WHEN count(price) < count(*) THEN 1 ELSE 0 END)::INT AS unpriced FROM calls GROUP BY model ORDER BY cost DESC")
def g9_m27_cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("role").alias("model"), F.floor(F.length("text") / 4).alias("tokens"), F.when(F.col("role") == "user", 3).when(F.col("role") == "assistant", 15).alias("price"))
    cost = F.coalesce(F.sum(F.col("tokens") * F.col("price")).cast("double") / 1e6, F.lit(0.0))
    return c.groupBy("model").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), quantised(cost).alias("cost"), (F.count("price") < F.count("*")).cast("int").alias("unpriced")).orderBy(F.desc("cost"))


@query(f"WITH {BINARY} SELECT question_id, max(CASE WHEN component = 'base_rate' THEN p END) AS base_rate, max(CASE WHEN component = 'llm' THEN p END) AS llm, max(CASE WHEN component = 'market' THEN p END) AS market FROM binary_frame GROUP BY question_id HAVING count(*) = 3")
def g10_g11_u5_common_set(spark: SparkSession, d: str) -> DataFrame:
    wide = binary(spark, d).groupBy("question_id").pivot("component", ["base_rate", "llm", "market"]).agg(F.max("p"))
    return wide.dropna()


@query(f"WITH {DAILY}, m AS (SELECT series_id, date_trunc('week', day)::DATE AS week, sum(value) AS s, count(*) AS n FROM daily GROUP BY ALL) SELECT series_id, week, {q('s / n', 4)} AS value FROM m WHERE n = 7 AND week + 6 <= DATE '2024-01-25'")
def g12_ended_periods_only(spark: SparkSession, d: str) -> DataFrame:
    m = daily(spark, d).groupBy("series_id", F.date_trunc("week", "day").cast("date").alias("week")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return m.where((F.col("n") == 7) & (F.date_add("week", 6) <= day("2024-01-25"))).select("series_id", "week", quantised(F.col("value"), 4).alias("value"))


@query(f"WITH {K} SELECT series_id, date_trunc('quarter', observed_at)::DATE AS quarter, {q('avg(value)', 2)} AS value FROM k GROUP BY ALL HAVING count(*) = 3")
def g13_complete_quarters(spark: SparkSession, d: str) -> DataFrame:
    return series.quarterly_mean(known(spark, d), ["series_id"], "observed_at", "value").select("series_id", "quarter", quantised(F.col("value"), 2).alias("value"))


@query(f"WITH {FORECASTS}, t AS (SELECT model_type, year(forecast_date) AS y, prediction BETWEEN 50000 AND 300000 AS hit FROM forecasts) SELECT model_type, " + ", ".join(f"{q(f'avg(CASE WHEN y = {y} THEN hit::INT END)')} AS \"{y}\"" for y in range(1996, 2000)) + " FROM t GROUP BY model_type")
def g14_coverage_by_year(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).withColumn("y", F.year("forecast_date")).withColumn("hit", F.col("prediction").between(50000, 300000).cast("int"))
    return f.groupBy("model_type").pivot("y", list(range(1996, 2000))).agg(quantised(F.avg("hit")))


@query(f"SELECT name, {q('avg(abs(v))', 3)} AS importance FROM (SELECT unnest(['quantity', 'discount', 'tax']) AS name, unnest([l_quantity - 25, l_discount * 100 - 5, l_tax * 100 - 4]) AS v FROM lineitem) GROUP BY name ORDER BY importance DESC, name LIMIT 2")
def g15_mean_absolute_contribution(spark: SparkSession, d: str) -> DataFrame:
    shap = F.create_map(F.lit("quantity"), F.col("l_quantity") - 25, F.lit("discount"), F.col("l_discount") * 100 - 5, F.lit("tax"), F.col("l_tax") * 100 - 4)
    rows = table(spark, d, "lineitem").select(F.explode(shap).alias("name", "v"))
    return rows.groupBy("name").agg(quantised(F.avg(F.abs("v")), 3).alias("importance")).orderBy(F.desc("importance"), "name").limit(2)


@query(f"SELECT o_orderpriority AS priority, {q('quantile_cont(o_totalprice, 0.1)', 3)} AS p10, {q('quantile_cont(o_totalprice, 0.5)', 3)} AS p50, {q('quantile_cont(o_totalprice, 0.9)', 3)} AS p90 FROM orders GROUP BY 1")
def g16_exact_quantiles(spark: SparkSession, d: str) -> DataFrame:
    p = F.percentile("o_totalprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(p.alias("p")).select("priority", *[quantised(F.col("p")[i], 3).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query("WITH t AS (SELECT c_mktsegment AS segment, abs(c_acctbal) AS e, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal)) AS nth, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT segment, n::BIGINT AS n, max(CASE WHEN nth = ceil((n + 1) * 0.8::DOUBLE - 1e-9) THEN e END) AS quantile FROM t GROUP BY ALL")
def g17_conformal_quantile(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.abs("c_acctbal").alias("e"))
    n = c.groupBy("segment").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("segment").orderBy("e"))
    # the order statistic by rank, for groups that don't fit an array
    return c.withColumn("nth", nth).join(n, "segment").where(F.col("nth") == F.ceil((F.col("n") + 1) * F.lit(0.8) - F.lit(1e-9))).select("segment", "n", F.col("e").alias("quantile"))


@query(f"WITH {BINARY} SELECT source, count(*)::BIGINT AS n, {q("(count(*) FILTER (WHERE outcome = 'yes') + 1)::DOUBLE / (count(*) + 2)")} AS rate FROM (SELECT DISTINCT question_id, source, outcome FROM binary_frame WHERE outcome IS NOT NULL) GROUP BY source")
def g18_laplace_rate(spark: SparkSession, d: str) -> DataFrame:
    b = binary(spark, d).where("outcome is not null").select("question_id", "source", "outcome").distinct()
    return b.groupBy("source").agg(F.count("*").alias("n"), quantised((F.count(F.when(F.col("outcome") == "yes", 1)) + 1) / (F.count("*") + 2)).alias("rate"))


@query(f"WITH {DAILY}, w AS (SELECT day, max(CASE WHEN series_id = 'click' THEN value END) AS x, max(CASE WHEN series_id = 'view' THEN value END) AS y FROM daily GROUP BY day), s AS (SELECT day, x - lag(x) OVER (ORDER BY day) AS dx, y - lag(y) OVER (ORDER BY day) AS dy FROM w) SELECT a.day, {q('corr(b.dx, b.dy)', 4)} AS correlation FROM s a JOIN s b ON b.day > a.day - 12 AND b.day <= a.day AND b.dx IS NOT NULL AND b.dy IS NOT NULL GROUP BY a.day HAVING count(*) = 12 AND stddev_samp(b.dx) > 0 AND stddev_samp(b.dy) > 0")
def g19_rolling_correlation(spark: SparkSession, d: str) -> DataFrame:
    wide = daily(spark, d).groupBy("day").pivot("series_id", ["click", "view"]).agg(F.first("value"))
    # the calendar of days is one small series
    w = Window.orderBy(F.unix_date("day"))
    steps = wide.withColumn("dx", F.col("click") - F.lag("click").over(w)).withColumn("dy", F.col("view") - F.lag("view").over(w))
    return steps.withColumn("correlation", quantised(series.log_change_correlation("dx", "dy", 12, w), 4)).where("correlation is not null").select("day", "correlation")


@query(f"WITH {K}, t AS (SELECT *, m::DOUBLE AS x, value / 1e6 AS y FROM k WHERE observed_at >= DATE '1996-01-01') SELECT series_id, count(*)::BIGINT AS n, {q('regr_slope(y, x)', 5)} AS slope, {q('sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2))', 5)} AS deviation, {q('avg(y)', 5)} AS mean, {q('stddev_samp(y)', 5)} AS spread FROM t GROUP BY series_id")
def g20_g21_least_squares(spark: SparkSession, d: str) -> DataFrame:
    t = known(spark, d).where("observed_at >= date '1996-01-01'").withColumn("x", calendar.month_index(F.col("observed_at")).cast("double")).withColumn("y", F.col("value") / 1e6)
    rest = F.regr_syy("y", "x") - F.regr_sxy("y", "x") * F.regr_sxy("y", "x") / F.regr_sxx("y", "x")
    return t.groupBy("series_id").agg(F.count("*").alias("n"), quantised(F.regr_slope("y", "x"), 5).alias("slope"), quantised(F.sqrt(rest / (F.count("*") - 2)), 5).alias("deviation"), quantised(F.avg("y"), 5).alias("mean"), quantised(F.stddev_samp("y"), 5).alias("spread"))


@query("SELECT (SELECT max(o_orderdate) FROM orders) AS last_order, (SELECT count(*) FROM customer)::BIGINT AS customers, (SELECT count(*) FROM events)::BIGINT AS events")
def g23_dashboard_header(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, "orders").agg(F.max("o_orderdate").alias("last_order")), table(spark, d, "customer").agg(F.count("*").alias("customers")), table(spark, d, "events").agg(F.count("*").alias("events"))]
    # one row each
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


@query(f"WITH {QUESTIONS}, {RESOLUTIONS}, {FORECASTS} SELECT domain, count(DISTINCT q.question_id)::BIGINT AS open, count(f.forecast_id)::BIGINT AS forecasts, min(target_date) AS next_date FROM questions q LEFT JOIN forecasts f USING (question_id) WHERE q.question_id NOT IN (SELECT question_id FROM resolutions) GROUP BY domain")
def g24_open_counts(spark: SparkSession, d: str) -> DataFrame:
    open_ = questions(spark, d).join(resolutions(spark, d), "question_id", "left_anti")
    n = forecasts(spark, d).groupBy("question_id").agg(F.count("*").alias("n"))
    return open_.join(n, "question_id", "left").groupBy("domain").agg(F.count("*").alias("open"), F.coalesce(F.sum("n"), F.lit(0)).alias("forecasts"), F.min("target_date").alias("next_date"))


# ---- windows


@query(f"WITH {QUESTIONS} SELECT question_id, target_date, total FROM (SELECT *, count(*) OVER ()::BIGINT AS total FROM questions WHERE domain = 'ai') ORDER BY target_date DESC, question_id LIMIT 20")
def w1_t2_page_with_total(spark: SparkSession, d: str) -> DataFrame:
    ai = questions(spark, d).where("domain = 'ai'")
    total = ai.agg(F.count("*").alias("total"))
    # the page is cut first and gets the total beside it: no window over the whole table
    return ai.orderBy(F.desc("target_date"), "question_id").limit(20).crossJoin(total).select("question_id", "target_date", "total")


@query(f"WITH {FORECASTS}, t AS (SELECT *, max(forecast_date) OVER (PARTITION BY question_id) AS top, max(forecast_date) OVER (PARTITION BY question_id, model_type) AS own FROM forecasts) SELECT question_id, count(*) FILTER (WHERE forecast_date = top)::BIGINT AS newest_run, count(*) FILTER (WHERE forecast_date = own)::BIGINT AS newest_by_model FROM t GROUP BY question_id")
def w2_w3_latest_runs(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d)
    by_question = f.groupBy("question_id").agg(F.max("forecast_date").alias("top"))
    by_model = f.groupBy("question_id", "model_type").agg(F.max("forecast_date").alias("own"))
    t = f.join(by_question, "question_id").join(by_model, ["question_id", "model_type"])
    return t.groupBy("question_id").agg(F.count(F.when(F.col("forecast_date") == F.col("top"), 1)).alias("newest_run"), F.count(F.when(F.col("forecast_date") == F.col("own"), 1)).alias("newest_by_model"))


@query(f"WITH {K}, g AS (SELECT * FROM k WHERE month(observed_at) <> 5) SELECT a.series_id, a.observed_at, b.value AS lag1, c.value AS lead2, {q('(a.value / b.value - 1) * 100', 4)} AS growth, {q('a.value - d.value', 2)} AS diff3 FROM g a LEFT JOIN g b ON a.series_id = b.series_id AND b.m = a.m - 1 LEFT JOIN g c ON a.series_id = c.series_id AND c.m = a.m + 2 LEFT JOIN g d ON a.series_id = d.series_id AND d.m = a.m - 3")
def w4_w5_w6_w15_gap_safe_shifts(spark: SparkSession, d: str) -> DataFrame:
    w = series.by_month("series_id")
    g = known(spark, d).where(F.month("observed_at") != 5)
    return g.select("series_id", "observed_at", series.shifted("value", 1, w).alias("lag1"), series.shifted("value", -2, w).alias("lead2"), quantised(series.pct_change("value", 1, w), 4).alias("growth"), quantised(series.difference("value", 3, w), 2).alias("diff3"))


@query(f"WITH {K}, g AS (SELECT * FROM k WHERE month(observed_at) <> 5) SELECT a.series_id, a.observed_at, {q('avg(b.value)', 2)} AS mean3 FROM g a JOIN g b ON a.series_id = b.series_id AND b.m BETWEEN a.m - 2 AND a.m GROUP BY ALL HAVING count(*) = 3")
def w7_full_rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    g = known(spark, d).where(F.month("observed_at") != 5)
    return g.select("series_id", "observed_at", quantised(series.full_mean("value", 3, series.by_month("series_id")), 2).alias("mean3")).where("mean3 is not null")


@query(f"WITH {DAILY}, wk AS (SELECT * FROM daily WHERE dayofweek(day) = 1 OR day(day) % 9 = 0) SELECT a.series_id, a.day, (SELECT CASE WHEN count(*) = 2 THEN {q('avg(b.value)', 4)} END FROM wk b WHERE b.series_id = a.series_id AND b.day > a.day - 14 AND b.day <= a.day) AS recent, (SELECT CASE WHEN count(*) = 2 THEN {q('avg(b.value)', 4)} END FROM wk b WHERE b.series_id = a.series_id AND b.day > a.day - 21 AND b.day <= a.day - 7) AS before FROM wk a")
def w8_exact_weeks_mean(spark: SparkSession, d: str) -> DataFrame:
    weekly = daily(spark, d).where((F.dayofweek("day") == 2) | (F.dayofmonth("day") % 9 == 0))
    w = series.by_day("series_id")
    return weekly.select("series_id", "day", quantised(series.full_mean("value", 2, w, step=7), 4).alias("recent"), quantised(series.lagged_mean("value", 2, 7, w, step=7), 4).alias("before"))


GRID = f"{K}, g AS (SELECT series_id, m, value FROM k WHERE m % 7 NOT IN (2, 3)), span AS (SELECT series_id, min(m) AS a, max(m) AS b FROM g GROUP BY ALL), dense AS (SELECT s.series_id, t.m FROM span s, LATERAL (SELECT unnest(generate_series(a, b)) AS m) t)"


@query(f"WITH {GRID} SELECT d.series_id, (d.m // 12)::INT AS year, (d.m % 12 + 1)::INT AS month, (SELECT arg_max(value, m) FROM g WHERE g.series_id = d.series_id AND g.m BETWEEN d.m - 1 AND d.m) AS filled, {q('CASE WHEN g.value IS NOT NULL THEN g.value ELSE (SELECT arg_max(value, m) FROM g WHERE g.series_id = d.series_id AND g.m < d.m) + ((SELECT arg_min(value, m) FROM g WHERE g.series_id = d.series_id AND g.m > d.m) - (SELECT arg_max(value, m) FROM g WHERE g.series_id = d.series_id AND g.m < d.m)) * (d.m - (SELECT max(m) FROM g WHERE g.series_id = d.series_id AND g.m < d.m)) / ((SELECT min(m) FROM g WHERE g.series_id = d.series_id AND g.m > d.m) - (SELECT max(m) FROM g WHERE g.series_id = d.series_id AND g.m < d.m)) END', 2)} AS line FROM dense d LEFT JOIN g ON g.series_id = d.series_id AND g.m = d.m")
def w9_w10_fill_and_interpolate(spark: SparkSession, d: str) -> DataFrame:
    index = calendar.month_index(F.col("observed_at"))
    dense = series.densified(known(spark, d).where(~(index % 7).isin(2, 3)).select("series_id", "observed_at", "value"), ["series_id"])
    w = series.by_month("series_id")
    return dense.select("series_id", F.year("observed_at").alias("year"), F.month("observed_at").alias("month"), series.carried("value", 1, w).alias("filled"), quantised(series.interpolated("value", w, index), 2).alias("line"))


@query(f"WITH {DAILY}, r AS (SELECT series_id, day, floor(value / 10) AS level FROM daily), s AS (SELECT *, max(level) OVER w AS top, level - lag(level) OVER w AS step, min(day) OVER (PARTITION BY series_id) AS start FROM r WINDOW w AS (PARTITION BY series_id ORDER BY day)) SELECT a.series_id, a.day, a.top, (a.day - coalesce((SELECT max(day) FROM s b WHERE b.series_id = a.series_id AND b.day <= a.day AND step <> 0), a.start))::INT AS since, (SELECT arg_max(step, day) FROM s b WHERE b.series_id = a.series_id AND b.day <= a.day AND step <> 0) AS jump, (SELECT CASE WHEN count(step) = 5 THEN count(*) FILTER (WHERE step > 0) END FROM s b WHERE b.series_id = a.series_id AND b.day > a.day - 5 AND b.day <= a.day)::BIGINT AS rises FROM s a")
def w11_w12_w13_steps(spark: SparkSession, d: str) -> DataFrame:
    w = series.by_day("series_id")
    r = daily(spark, d).select("series_id", "day", F.floor(F.col("value") / 10).cast("double").alias("level"))
    since, jump = series.last_change("level", w, F.unix_date("day"))
    s = r.withColumn("top", series.running_max("level", w)).withColumn("since", since).withColumn("jump", jump).withColumn("step", F.col("level") - F.lag("level").over(w))
    return s.select("series_id", "day", "top", "since", "jump", series.rises("step", 5, w).alias("rises"))


@query(f"WITH {K} SELECT series_id, observed_at, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY observed_at DESC) AS nth FROM k) WHERE nth <= 12")
def w14_trailing_values(spark: SparkSession, d: str) -> DataFrame:
    return series.trailing(known(spark, d), ["series_id"], "observed_at", 12).select("series_id", "observed_at", "value")


@query(f"WITH {K}, c AS (SELECT a.series_id, a.value - b.value AS move FROM k a JOIN k b ON a.series_id = b.series_id AND b.m = a.m - 3) SELECT series_id, count(*)::BIGINT AS n, {q('quantile_cont(abs(move), 0.99)', 2)} AS q99 FROM c GROUP BY series_id")
def w16_past_moves(spark: SparkSession, d: str) -> DataFrame:
    w = series.by_month("series_id")
    moves = known(spark, d).select("series_id", series.difference("value", 3, w).alias("move")).where("move is not null")
    return moves.groupBy("series_id").agg(F.count("*").alias("n"), quantised(F.percentile(F.abs("move"), F.lit(0.99)), 2).alias("q99"))


@query("WITH t AS (SELECT user_id, ts, event_id, event_type, row_number() OVER w AS nth, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, (nth - max(CASE WHEN event_type IS DISTINCT FROM before THEN nth END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS since_change FROM t")
def w17_events_since_change(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").withColumn("nth", F.row_number().over(w)).withColumn("new", ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)))
    return t.select("event_id", (F.col("nth") - F.max(F.when(F.col("new"), F.col("nth"))).over(w)).cast("long").alias("since_change"))


# ---- sorts and sets


@query(f"WITH {QUESTIONS} SELECT question_id, lead_days, row_number() OVER (ORDER BY lead_days ASC NULLS LAST, target_date DESC, question_id)::INT AS nth FROM questions WHERE domain = 'economy' QUALIFY nth <= 50")
def t1_null_ordering(spark: SparkSession, d: str) -> DataFrame:
    top = questions(spark, d).where("domain = 'economy'").orderBy(F.asc_nulls_last("lead_days"), F.desc("target_date"), "question_id").limit(50)
    return top.withColumn("nth", F.row_number().over(Window.orderBy(F.asc_nulls_last("lead_days"), F.desc("target_date"), "question_id"))).select("question_id", "lead_days", "nth")


@query(f"WITH {BINARY}, t AS (SELECT question_id, outcome, p, row_number() OVER (PARTITION BY outcome ORDER BY p DESC, question_id) AS nth FROM binary_frame WHERE component = 'llm' AND outcome IS NOT NULL) SELECT question_id, outcome, p FROM t WHERE nth <= 5")
def t3_top_k_by_class(spark: SparkSession, d: str) -> DataFrame:
    b = binary(spark, d).where("component = 'llm' and outcome is not null")
    return b.withColumn("nth", F.row_number().over(Window.partitionBy("outcome").orderBy(F.desc("p"), "question_id"))).where("nth <= 5").select("question_id", "outcome", "p")


@query("WITH l AS (SELECT *, row_number() OVER () AS id FROM lineitem), e AS (SELECT id, l_orderkey, l_linenumber, unnest(['discount', 'quantity', 'tax']) AS name, unnest([l_discount * 100 - 5, l_quantity - 25, l_tax * 100 - 4]) AS v FROM l), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC, name) AS nth FROM e) SELECT l_orderkey, l_linenumber, max(CASE WHEN nth = 1 THEN name END) AS driver, max(CASE WHEN nth = 2 THEN name END) AS second FROM t GROUP BY id, l_orderkey, l_linenumber")
def t4_t5_top_drivers(spark: SparkSession, d: str) -> DataFrame:
    shap = F.create_map(F.lit("quantity"), F.col("l_quantity") - 25, F.lit("discount"), F.col("l_discount") * 100 - 5, F.lit("tax"), F.col("l_tax") * 100 - 4)
    top = scalar.top_entries(shap, 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.likeliest(shap).alias("driver"), F.element_at(top, 2)["name"].alias("second"))


@query("SELECT o_orderkey AS id, 'order' AS kind, o_totalprice AS amount, NULL::DOUBLE AS balance FROM orders UNION ALL SELECT c_custkey, 'customer', NULL, c_acctbal FROM customer")
def u1_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("amount"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    return o.unionByName(c, allowMissingColumns=True)


@query(f"WITH {DAILY}, a AS (SELECT day, value FROM daily WHERE series_id = 'view' AND day <= DATE '2024-01-20'), b AS (SELECT day + 1 AS day, value FROM daily WHERE series_id = 'click' AND day >= DATE '2024-01-10') SELECT coalesce(a.day, b.day) AS day, coalesce(b.value, a.value) AS value FROM a FULL JOIN b ON a.day = b.day")
def u2_spliced_series(spark: SparkSession, d: str) -> DataFrame:
    v = daily(spark, d)
    a = v.where("series_id = 'view' and day <= date '2024-01-20'").select("day", "value")
    b = v.where("series_id = 'click' and day >= date '2024-01-10'").select(F.date_add("day", 1).alias("day"), "value")
    return joins.spliced(a, b, ["day"])


@query(f"WITH {OBS} SELECT day FROM (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY))::DATE AS day EXCEPT SELECT as_of FROM obs WHERE series_id = '5-LOW')")
def u3_u4_missing_days(spark: SparkSession, d: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(day("1996-01-01"), day("1996-12-31"))).alias("day"))
    return days.join(obs(spark, d).where("series_id = '5-LOW'").select(F.col("as_of").alias("day")).distinct(), "day", "left_anti")
