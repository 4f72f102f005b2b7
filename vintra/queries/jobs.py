"""Recurring jobs, lookups, reports and scalar families."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintra.functions import scalar
from vintra.functions.calendar import month_start
from vintra.functions.scalar import quantised, z_of
from vintra.operators.asof import first_releases
from vintra.operators.series import shifted
from vintra.plans import backtest, jobs, questions as plans
from vintra.queries.base import BINARY, COMPONENTS, FIRST, FORECASTS, LAST, MONTHLY, OBS, POSTMORTEMS, QUESTIONS, RESOLUTIONS, binary, day, forecasts, obs, postmortems, q, query, questions, resolutions, table
from vintra.queries.scoring import DECISIONS, RESULTS, decisions, results


def mi(x: str) -> str:
    return f"(year({x}) * 12 + month({x}) - 1)"


#: Documents as versions of their source's card, one every nine hours or so.
CARDS = "cards AS (SELECT source AS model, doc_id AS sha, TIMESTAMP '2023-01-01' + to_hours((doc_id * 9 % 8000)::INT) AS made_at FROM documents)"


@query(f"WITH {CARDS}, asked AS (SELECT model, unnest(generate_series(TIMESTAMP '2022-12-01', TIMESTAMP '2023-12-01', INTERVAL 1 MONTH)) AS \"when\" FROM (SELECT DISTINCT model FROM cards)) SELECT model, \"when\"::DATE AS asked, (SELECT sha FROM cards c WHERE c.model IS NOT DISTINCT FROM a.model AND c.made_at <= a.when ORDER BY made_at DESC, sha DESC LIMIT 1) AS sha FROM asked a")
def a20_card_as_of(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    cards = docs.select(F.col("source").alias("model"), F.col("doc_id").alias("sha"), F.expr("timestamp '2023-01-01' + make_dt_interval(0, cast(doc_id * 9 % 8000 as int))").cast("timestamp").alias("made_at"))
    when = F.explode(F.expr("sequence(timestamp '2022-12-01', timestamp '2023-12-01', interval 1 month)")).alias("when")
    out = jobs.versions_as_of(cards, cards.select("model").distinct().select("model", when), "model", "made_at", "sha")
    return out.select("model", F.col("when").cast("date").alias("asked"), "sha")


@query("SELECT l_orderkey AS key, l_linenumber AS line, l_discount AS target_gap FROM lineitem")
def f12_without_drifting_features(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("flops"), F.col("l_tax").alias("flops_lag3"), F.col("l_extendedprice").alias("log_ratio_a_b"), F.col("l_suppkey").alias("trend_months"), F.col("l_discount").alias("target_gap"))
    return f.select(*[c for c in f.columns if not scalar.drifting(c, ["flops", "target"])])


@query("SELECT o_orderkey AS id, o_orderdate::DATE - 8 AS cutoff, date_trunc('month', o_orderdate::DATE - 7)::DATE AS origin FROM orders")
def h8_event_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), jobs.event_cutoff(F.col("o_orderdate").cast("date"), 7).alias("cutoff"))
    return o.select("id", "cutoff", jobs.origin_month(F.col("cutoff")).alias("origin"))


@query("SELECT n_nationkey AS nationkey, n_name AS name, coalesce(n, 0)::BIGINT AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) ON s_nationkey = n_nationkey")
def j12_aligned_to_index(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n"))
    index = table(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))
    return index.join(counts, "nationkey", "left").na.fill(0, ["n"])


@query(f"WITH {RESULTS} SELECT series_id, forecast_date, h AS horizon_months, prediction, {q('lower', 3)} AS lower, {q('upper', 3)} AS upper FROM walk")
def p1_random_walk(spark: SparkSession, d: str) -> DataFrame:
    r = backtest.random_walk(backtest.histories(obs(spark, d), FIRST, LAST), [1, 3, 6])
    return r.select("series_id", "forecast_date", "horizon_months", "prediction", quantised(F.col("lower"), 3).alias("lower"), quantised(F.col("upper"), 3).alias("upper"))


@query(f"WITH {OBS}, {MONTHLY} SELECT series_id, forecast_date, count(*)::BIGINT AS n, min(observed_at) AS since FROM history WHERE m > {mi('forecast_date - 1')} - 24 GROUP BY ALL")
def w19_rolling_training_window(spark: SparkSession, d: str) -> DataFrame:
    h = backtest.training_window(backtest.histories(obs(spark, d), FIRST, LAST), 24)
    return h.groupBy("series_id", "forecast_date").agg(F.count("*").alias("n"), F.min("observed_at").alias("since"))


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, asked ORDER BY ts DESC, event_id DESC) AS nth FROM events, (VALUES (DATE '2024-01-10'), (DATE '2024-01-20'), (DATE '2024-01-30')) v(asked) WHERE ts::DATE <= asked) SELECT user_id, asked, CASE WHEN asked - ts::DATE <= 2 THEN value END AS value FROM e WHERE nth = 1")
def w18_latest_within_days(spark: SparkSession, d: str) -> DataFrame:
    asked = F.explode(F.array(*[day(x) for x in ("2024-01-10", "2024-01-20", "2024-01-30")])).alias("asked")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value", asked).where(F.col("ts").cast("date") <= F.col("asked"))
    last = e.groupBy("user_id", "asked").agg(F.max(F.struct("ts", "event_id", "value")).alias("x"))
    return last.select("user_id", "asked", F.when(F.datediff("asked", F.col("x.ts").cast("date")) <= 2, F.col("x.value")).alias("value"))


EVENTS = f"""{OBS},
firsts AS (SELECT series_id, observed_at, min(as_of) AS published, arg_min(value, as_of) AS value, {mi('observed_at')} AS m FROM obs WHERE value IS NOT NULL GROUP BY ALL),
meetings AS (SELECT a.series_id, a.observed_at + 14 AS meeting, a.published, CASE WHEN a.value > b.value * 1.05::DOUBLE THEN 'hike' WHEN a.value < b.value * 0.95::DOUBLE THEN 'cut' WHEN b.value IS NOT NULL THEN 'hold' END AS outcome
  FROM firsts a LEFT JOIN firsts b ON b.series_id = a.series_id AND b.m = a.m - 1),
ordered AS (SELECT series_id, meeting, meeting - 8 AS cutoff, row_number() OVER (PARTITION BY series_id ORDER BY meeting) AS k FROM meetings),
fitted AS (SELECT *, cutoff AS trained FROM ordered WHERE k = 1 UNION ALL
  SELECT c.*, CASE WHEN {mi('c.cutoff')} - {mi('g.trained')} >= 12 THEN c.cutoff ELSE g.trained END FROM fitted g JOIN ordered c ON c.series_id = g.series_id AND c.k = g.k + 1),
counts AS (SELECT f.series_id, f.trained, {', '.join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o}" for o in jobs.OUTCOMES)} FROM (SELECT DISTINCT series_id, trained FROM fitted) f LEFT JOIN meetings e ON e.series_id = f.series_id AND e.published <= f.trained GROUP BY ALL),
probs AS (SELECT series_id, f.meeting, f.cutoff AS data_as_of, f.trained AS trained_as_of, {', '.join(f'(n_{o} + 1)::DOUBLE / (n_cut + n_hold + n_hike + 3) AS p_{o}' for o in jobs.OUTCOMES)}, outcome
  FROM fitted f JOIN counts USING (series_id, trained) JOIN meetings USING (series_id, meeting)),
tested AS (SELECT *, CASE WHEN outcome IS NOT NULL THEN {' + '.join(f"pow(p_{o} - (outcome = '{o}')::INT, 2)" for o in jobs.OUTCOMES)} END AS brier FROM probs)"""


def events_of(spark: SparkSession, d: str) -> DataFrame:
    """A meeting in the middle of each month, labelled by the move of first releases."""
    first = first_releases(obs(spark, d))
    before = shifted("first_value", 1, Window.partitionBy("series_id").orderBy(F.year("observed_at") * 12 + F.month("observed_at")))
    v = first.withColumn("before", before)
    outcome = F.when(F.col("first_value") > F.col("before") * 1.05, "hike").when(F.col("first_value") < F.col("before") * 0.95, "cut").when(F.col("before").isNotNull(), "hold")
    return v.select("series_id", F.date_add("observed_at", 14).alias("meeting"), F.col("first_as_of").alias("published"), outcome.alias("outcome"))


@query(f"WITH RECURSIVE {EVENTS} SELECT series_id, meeting, data_as_of, trained_as_of, {', '.join(f'{q(f"p_{o}")} AS p_{o}' for o in jobs.OUTCOMES)}, outcome, {q('brier', 5)} AS brier FROM tested")
def p15_event_backtest(spark: SparkSession, d: str) -> DataFrame:
    r = jobs.event_backtest(events_of(spark, d), 7, 12)
    return r.select("series_id", "meeting", "data_as_of", "trained_as_of", *[quantised(F.col(f"p_{o}")).alias(f"p_{o}") for o in jobs.OUTCOMES], "outcome", quantised(F.col("brier"), 5).alias("brier"))


@query(f"WITH RECURSIVE {EVENTS}, s AS (SELECT *, CASE greatest(p_cut, p_hold, p_hike) WHEN p_cut THEN 'cut' WHEN p_hold THEN 'hold' ELSE 'hike' END AS likeliest FROM tested) SELECT series_id, count(*)::BIGINT AS n_forecasts, count(outcome)::BIGINT AS n_resolved, {q('avg(brier)', 5)} AS brier, {q('avg((likeliest = outcome)::INT)', 5)} AS accuracy, count(*) FILTER (WHERE outcome <> 'hold')::BIGINT AS n_changes, {q("avg(brier) FILTER (WHERE outcome <> 'hold')", 5)} AS brier_on_changes FROM s GROUP BY series_id")
def r17_event_table(spark: SparkSession, d: str) -> DataFrame:
    s = jobs.event_summary(jobs.event_backtest(events_of(spark, d), 7, 12), ["series_id"])
    return s.select("series_id", "n_forecasts", "n_resolved", "n_changes", *[quantised(F.col(c), 5).alias(c) for c in ("brier", "accuracy", "brier_on_changes")])


LEVELS = (0.5, 0.8, 0.9)


@query(f"WITH {RESULTS}, l AS (SELECT nominal, z, t.actual BETWEEN mu - z * sd AND mu + z * sd AS inside FROM plan p JOIN fit f ON f.series_id = p.series_id AND f.forecast_date = p.forecast_date AND h = 3 JOIN truth t ON t.series_id = p.series_id AND t.observed_at = p.target_period, (VALUES {', '.join(f'({c}::DOUBLE, {z_of(c)!r}::DOUBLE)' for c in LEVELS)}) v(nominal, z)) SELECT nominal, count(*)::BIGINT AS n, {q('avg(inside::INT)')} AS empirical FROM l GROUP BY nominal")
def r17_calibration_table(spark: SparkSession, d: str) -> DataFrame:
    h, o, out = backtest.histories(obs(spark, d), FIRST, LAST), obs(spark, d), None
    for c in LEVELS:
        part = backtest.resolved(backtest.historical_mean(h, [3], c), o).where("actual is not null").select(F.lit(c).alias("nominal"), "in_interval")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("nominal").agg(F.count("*").alias("n"), quantised(F.avg(F.col("in_interval").cast("double"))).alias("empirical"))


@query(f"SELECT l_orderkey AS key, l_linenumber AS line, CASE WHEN l_extendedprice = 0 THEN 0 ELSE floor(l_extendedprice / pow(10, floor(log10(l_extendedprice)) - 2) + 0.5) * pow(10, floor(log10(l_extendedprice)) - 2) END AS three, {q('greatest(l_discount * 100, l_tax * 100)', 6)} AS log_floor, {q('least(greatest(l_quantity * 3, l_tax), 100)', 6)} AS percent_cap, {q('l_quantity * 3', 6)} AS as_is FROM lineitem")
def s_significant_and_bounded(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_quantity") * 3
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), scalar.significant(F.col("l_extendedprice")).alias("three"), quantised(scalar.bounded(F.col("l_discount") * 100, F.lit("log10"), F.col("l_tax") * 100)).alias("log_floor"),
        quantised(scalar.bounded(x, F.lit("percent"), F.col("l_tax"))).alias("percent_cap"), quantised(scalar.bounded(x, F.lit("count"), F.col("l_tax"))).alias("as_is"),
    )


MARKDOWN = "'---' || chr(10) || 'tags: x' || chr(10) || '---' || chr(10) || '![pic](u.png)  <b>' || text || '</b> [a link](http://x)' || chr(10) || ' ' || chr(10) || chr(10) || 'end'"


@query(rf"WITH m AS (SELECT doc_id, regexp_replace(regexp_replace({MARKDOWN}, '\A---\n(?s:.*?)\n---\n', ''), '!\[[^\]]*\]\([^)]*\)', '', 'g') AS t FROM documents), n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g') AS t FROM m) SELECT doc_id, md5(trim(t)) AS digest, length(trim(t))::BIGINT AS n FROM n")
def s_clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.lit("---\ntags: x\n---\n![pic](u.png)  <b>"), "text", F.lit("</b> [a link](http://x)\n \n\nend"))
    clean = scalar.clean_markdown(source)
    return table(spark, d, "documents").select("doc_id", F.md5(clean.cast("binary")).alias("digest"), F.length(clean).cast("long").alias("n"))


TOLD = "told AS (SELECT doc_id, DATE '1996-01-01' + (doc_id % 1700)::INT AS published FROM documents)"


@query(f"WITH {OBS}, {MONTHLY}, {TOLD}, h AS (SELECT *, row_number() OVER (PARTITION BY series_id, forecast_date ORDER BY observed_at DESC) AS nth FROM history), k AS (SELECT series_id, forecast_date, count(*) FILTER (WHERE nth <= 12)::BIGINT AS n_recent, min(observed_at) FILTER (WHERE nth <= 12) AS since, arg_max(value, observed_at) AS last_value, avg(value) AS baseline FROM h GROUP BY ALL), t AS (SELECT forecast_date, doc_id, row_number() OVER (PARTITION BY forecast_date ORDER BY published DESC, doc_id) AS nth FROM cuts JOIN told ON published < forecast_date), i AS (SELECT forecast_date, string_agg(doc_id::VARCHAR, ',' ORDER BY nth) AS doc_ids FROM t WHERE nth <= 3 GROUP BY ALL) SELECT series_id, k.forecast_date, n_recent, since, last_value, {q('baseline', 2)} AS baseline, doc_ids FROM k LEFT JOIN i ON i.forecast_date = k.forecast_date")
def p17_context(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.date_add(day("1996-01-01"), (F.col("doc_id") % 1700).cast("int")).alias("published"))
    c = jobs.context(backtest.histories(obs(spark, d), FIRST, LAST), docs)
    last = F.try_element_at("recent", F.lit(-1))["value"]
    return c.select("series_id", "forecast_date", F.size("recent").cast("long").alias("n_recent"), F.get("recent", 0)["observed_at"].alias("since"), last.alias("last_value"), quantised(F.col("baseline"), 2).alias("baseline"), F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


@query(f"WITH {POSTMORTEMS} SELECT forecast_id, category, classified_by = 'manual' AS confirmed FROM postmortems")
def r4_drafts_unconfirmed_first(spark: SparkSession, d: str) -> DataFrame:
    p = postmortems(spark, d).select("forecast_id", "category", (F.col("classified_by") == "manual").alias("confirmed"))
    return p.orderBy("confirmed", F.desc("forecast_id"))


@query(f"WITH {FORECASTS}, {RESOLUTIONS}, {POSTMORTEMS} SELECT forecast_id, question_id, prediction - actual_value AS error FROM forecasts JOIN resolutions USING (question_id) ANTI JOIN postmortems USING (forecast_id) WHERE NOT actual_value BETWEEN lower AND upper")
def r5_misses_without_draft(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).join(resolutions(spark, d), "question_id").where("actual_value not between lower and upper")
    return f.join(postmortems(spark, d), "forecast_id", "left_anti").select("forecast_id", "question_id", (F.col("prediction") - F.col("actual_value")).alias("error"))


@query("SELECT doc_id AS external_id, split_part(text, '.', 1) AS title, lang FROM documents WHERE source = 'src1'")
def r6_platform_markets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source = 'src1'").select(F.col("doc_id").alias("external_id"), F.split_part("text", F.lit("."), F.lit(1)).alias("title"), "lang")


@query(f"WITH {FORECASTS}, {QUESTIONS} SELECT question_id, target, question_type, target_date FROM questions WHERE question_id IN (SELECT question_id FROM forecasts)")
def r9_required_questions(spark: SparkSession, d: str) -> DataFrame:
    asked = forecasts(spark, d).select("question_id").distinct()
    return jobs.required(asked, questions(spark, d).select("question_id", "target", "question_type", "target_date"), "question_id")


@query(f"WITH {FORECASTS}, {QUESTIONS}, {RESOLUTIONS} SELECT forecast_id, question_id, p AS p_yes, {q('pow(p - (actual_outcome = ' + chr(39) + 'yes' + chr(39) + ')::INT, 2)')} AS brier FROM forecasts JOIN questions USING (question_id) JOIN resolutions USING (question_id) WHERE domain = 'ai' AND actual_outcome IS NOT NULL")
def r10_scored_with_p_yes(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).withColumn("probabilities", F.create_map(F.lit("yes"), F.col("p"), F.lit("no"), 1 - F.col("p")))
    s = f.join(questions(spark, d).where("domain = 'ai'"), "question_id").join(resolutions(spark, d).where("actual_outcome is not null"), "question_id")
    s = s.withColumn("p_yes", F.try_element_at("probabilities", F.lit("yes")))
    return s.select("forecast_id", "question_id", "p_yes", quantised(scalar.brier_binary(F.col("p_yes"), F.col("actual_outcome"))).alias("brier"))


@query(f"WITH {FORECASTS}, {QUESTIONS}, {RESOLUTIONS} SELECT question_type, model_type, count(*)::BIGINT AS n, {q('avg(pow(p - (actual_outcome = ' + chr(39) + 'yes' + chr(39) + ')::INT, 2))', 5)} AS brier, {q('sqrt(avg(pow(prediction - actual_value, 2)))', 2)} AS rmse, {q('avg((actual_value BETWEEN lower AND upper)::INT)', 5)} AS coverage FROM forecasts JOIN questions USING (question_id) JOIN resolutions USING (question_id) WHERE domain = 'ai' GROUP BY ALL")
def m15_domain_scorecard(spark: SparkSession, d: str) -> DataFrame:
    s = forecasts(spark, d).join(questions(spark, d).where("domain = 'ai'"), "question_id").join(resolutions(spark, d), "question_id")
    brier = F.avg(scalar.brier_binary(F.col("p"), F.col("actual_outcome")))
    rmse = F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("actual_value"), 2)))
    inside = F.avg(F.expr("cast(actual_value between lower and upper as double)"))
    return s.groupBy("question_type", "model_type").agg(F.count("*").alias("n"), quantised(brier, 5).alias("brier"), quantised(rmse, 2).alias("rmse"), quantised(inside, 5).alias("coverage"))


#: Orders as numeric questions about a month at or after their own; every fifth is as new as its series.
ASKED = f"""{OBS}, newest AS (SELECT series_id, max(as_of) AS newest FROM obs GROUP BY ALL),
asked AS (SELECT o_orderkey AS question_id, o_orderpriority AS series_id, (date_trunc('month', o_orderdate) + to_months((o_orderkey % 4)::INT))::DATE AS target_date,
  CASE WHEN o_orderkey % 5 = 0 THEN newest WHEN o_orderkey % 5 < 3 THEN DATE '1998-01-01' + (o_orderkey % 300)::INT END AS latest_as_of, o_totalprice AS threshold, (o_orderkey * 37 % 101)::DOUBLE / 100 AS p FROM orders LEFT JOIN newest ON series_id = o_orderpriority)"""


def asked_of(spark: SparkSession, d: str) -> DataFrame:
    newest = obs(spark, d).groupBy("series_id").agg(F.max("as_of").alias("newest"))
    o = table(spark, d, "orders").withColumn("series_id", F.col("o_orderpriority")).join(newest, "series_id", "left")
    k = F.col("o_orderkey")
    target = F.add_months(month_start(F.col("o_orderdate")), (k % 4).cast("int"))
    stored = F.when(k % 5 == 0, F.col("newest")).when(k % 5 < 3, F.date_add(day("1998-01-01"), (k % 300).cast("int")))
    return o.select(k.alias("question_id"), "series_id", target.alias("target_date"), stored.alias("latest_as_of"), F.col("o_totalprice").alias("threshold"), ((k * 37 % 101).cast("double") / 100).alias("p"))


@query(f"WITH {ASKED}, now AS (SELECT series_id, observed_at, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, observed_at ORDER BY as_of DESC) AS nth FROM obs) WHERE nth = 1 AND value IS NOT NULL) SELECT question_id, value AS latest_value, newest AS latest_as_of FROM asked JOIN newest USING (series_id) JOIN now ON now.series_id = asked.series_id AND observed_at = target_date WHERE newest IS DISTINCT FROM latest_as_of")
def r12_refresh_by_vintage(spark: SparkSession, d: str) -> DataFrame:
    return jobs.refreshed(asked_of(spark, d), obs(spark, d))


@query(f"WITH {ASKED}, {DECISIONS}, f AS (SELECT series_id, observed_at, min(as_of) AS published, arg_min(value, as_of) AS value FROM obs WHERE value IS NOT NULL AND as_of <= DATE '1998-06-30' GROUP BY ALL) SELECT question_id, value, NULL::VARCHAR AS outcome, published AS actual_as_of FROM asked JOIN f ON f.series_id = asked.series_id AND observed_at = target_date UNION ALL SELECT (meeting - DATE '1970-01-01')::BIGINT, NULL, outcome, meeting + 1 FROM labelled WHERE meeting + 1 <= DATE '1998-06-30'")
def r13_answers(spark: SparkSession, d: str) -> DataFrame:
    meetings = decisions(spark, d).withColumn("question_id", F.unix_date("meeting").cast("long"))
    return jobs.answers(asked_of(spark, d), meetings, obs(spark, d), day("1998-06-30"))


@query(f"WITH {ASKED}, f AS (SELECT series_id, observed_at, min(as_of) AS published, arg_min(value, as_of) AS value FROM obs WHERE value IS NOT NULL AND NOT reconstructed AND as_of <= DATE '1998-06-30' GROUP BY ALL) SELECT question_id, asked.series_id, CASE WHEN value >= threshold THEN 'yes' WHEN value IS NOT NULL THEN 'no' END AS outcome, published AS actual_as_of, question_id AS forecast_id, p, CASE WHEN value IS NOT NULL THEN {q('pow(p - (value >= threshold)::INT, 2)')} END AS brier FROM asked LEFT JOIN f ON f.series_id = asked.series_id AND observed_at = target_date WHERE target_date <= DATE '1998-06-30' AND question_id % 4 <> 0")
def r14_resolve_and_score(spark: SparkSession, d: str) -> DataFrame:
    a = asked_of(spark, d)
    out = jobs.resolve_and_score(a, a.where("question_id % 4 = 0"), a.withColumn("forecast_id", F.col("question_id")), obs(spark, d), day("1998-06-30"))
    return out.withColumn("brier", quantised(F.col("brier")))


@query(f"WITH c AS (SELECT role AS model, length(text) // 4 AS tokens, CASE role WHEN 'user' THEN 3.0::DOUBLE WHEN 'assistant' THEN 15.0::DOUBLE END AS price FROM conversations) SELECT model, count(*)::BIGINT AS n, floor(avg(tokens) + 0.5)::BIGINT AS mean_tokens, {q('(avg(tokens) * max(price) + 300 * 2 * max(price)) / 1e6')} AS usd_per_forecast, {q('(avg(tokens) * max(price) + 300 * 2 * max(price)) / 1e6 * count(*)', 4)} AS usd_total FROM c GROUP BY model")
def r19_cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("role") == "user", 3.0).when(F.col("role") == "assistant", 15.0)
    c = table(spark, d, "conversations").select(F.col("role").alias("model"), F.floor(F.length("text") / 4).alias("tokens"), price.alias("price"))
    s = c.groupBy("model").agg(F.count("*").alias("n"), F.avg("tokens").alias("mean"), F.max("price").alias("price"))
    each = (F.col("mean") * F.col("price") + 300 * 2 * F.col("price")) / 1e6
    return s.select("model", "n", F.floor(F.col("mean") + 0.5).alias("mean_tokens"), quantised(each).alias("usd_per_forecast"), quantised(each * F.col("n"), 4).alias("usd_total"))


@query(f"WITH {BINARY}, {RESULTS} SELECT 'binary' AS kind, component, question_id::VARCHAR AS item, ask_date AS day, {q('p')} AS forecast, (outcome = 'yes')::INT::DOUBLE AS actual FROM binary_frame UNION ALL SELECT 'numeric', model, series_id, forecast_date, {q('prediction', 3)}, actual FROM results WHERE h = 3")
def r21_component_rows(spark: SparkSession, d: str) -> DataFrame:
    b = binary(spark, d).select(F.lit("binary").alias("kind"), "component", F.col("question_id").cast("string").alias("item"), F.col("ask_date").alias("day"), quantised(F.col("p")).alias("forecast"), (F.col("outcome") == "yes").cast("double").alias("actual"))
    n = results(spark, d).where("horizon_months = 3").select(F.lit("numeric").alias("kind"), F.col("model").alias("component"), F.col("series_id").alias("item"), F.col("forecast_date").alias("day"), quantised(F.col("prediction"), 3).alias("forecast"), "actual")
    return b.unionByName(n)


@query("WITH t AS (SELECT o_custkey AS series_id, date_trunc('month', o_orderdate)::DATE AS month, o_orderdate::DATE AS as_of, o_totalprice - 50000 AS value FROM orders), f AS (SELECT series_id, month, as_of, value, row_number() OVER (PARTITION BY series_id, month ORDER BY as_of, value) AS nth FROM t WHERE value > 0) SELECT series_id, month, as_of, value FROM f WHERE nth = 1 AND NOT (series_id % 3 = 0 AND month < DATE '1995-01-01')")
def r22_month_snapshots(spark: SparkSession, d: str) -> DataFrame:
    taken = table(spark, d, "orders").select(F.col("o_custkey").alias("series_id"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_totalprice") - 50000).alias("value"))
    stored = taken.where("series_id % 3 = 0 and day < date '1995-01-01'").select("series_id", month_start(F.col("day")).alias("month")).distinct()
    return jobs.month_snapshots(stored, taken)


@query("SELECT source || '_question' AS document_type, doc_id AS source_id, CASE WHEN lang = 'en' THEN split_part(text, '.', 1) ELSE split_part(text, '.', 1) || chr(10) || chr(10) || text END AS content, coalesce(CASE WHEN doc_id % 4 <> 0 THEN DATE '2023-01-01' + (doc_id % 700)::INT END, DATE '2023-06-01') + CASE WHEN source = 'src0' THEN 3 ELSE 30 END AS published FROM documents")
def r23_question_documents(spark: SparkSession, d: str) -> DataFrame:
    k, title = F.col("doc_id"), F.split_part("text", F.lit("."), F.lit(1))
    opened = F.when(k % 4 != 0, F.date_add(day("2023-01-01"), (k % 700).cast("int")))
    content = F.when(F.col("lang") == "en", title).otherwise(F.concat(title, F.lit("\n\n"), "text"))
    lag = F.when(F.col("source") == "src0", 3).otherwise(30)
    return table(spark, d, "documents").select(F.concat("source", F.lit("_question")).alias("document_type"), k.alias("source_id"), content.alias("content"), F.date_add(F.coalesce(opened, day("2023-06-01")), lag).alias("published"))


@query("SELECT user_id, count(*)::BIGINT AS fetched, bool_or(coalesce(value < 0.3, true)) AS failed, CASE WHEN bool_or(coalesce(value < 0.3, true)) THEN 0 ELSE count(*) FILTER (WHERE event_type <> 'click') END::BIGINT AS inserted FROM events GROUP BY user_id")
def r24_ingest_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    return jobs.ingest_report(e.where("event_type = 'click'").select("user_id", "event_id"), e, ["user_id", "event_id"], "user_id", F.col("value") < 0.3)


@query("SELECT user_id AS id, count(DISTINCT event_type)::BIGINT AS topics, floor(max(value) * 100 + 0.5)::BIGINT AS stars FROM events GROUP BY user_id ORDER BY stars DESC, id LIMIT 20")
def s5_top_across_topics(spark: SparkSession, d: str) -> DataFrame:
    merged = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.countDistinct("event_type").alias("topics"), F.floor(F.max("value") * 100 + 0.5).alias("stars"))
    return merged.orderBy(F.desc("stars"), "id").limit(20)


@query(f"SELECT l_orderkey AS key, l_linenumber AS line, {q('l_extendedprice / (l_extendedprice - 100) - 1')} AS count_step, {q('l_discount - l_tax', 8)} AS log_step, {q('(l_discount - l_tax) / 100', 8)} AS percent_step FROM lineitem")
def h5_relative_steps(spark: SparkSession, d: str) -> DataFrame:
    x, a, b = F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), quantised(plans.relative_step(x - 100, x, F.lit("count"))).alias("count_step"),
        quantised(plans.relative_step(a, b, F.lit("log10")), 8).alias("log_step"), quantised(plans.relative_step(a, b, F.lit("percent")), 8).alias("percent_step"),
    )


@query(f"SELECT p_partkey AS id, {q('ln(p_retailprice + 1)', 8)} AS count_scale, {q('ln(100.1::DOUBLE - p_size)', 8)} AS percent_scale, {q('p_retailprice', 4)} AS back, {q('ln(least(greatest(p_size / 50.0::DOUBLE, 1e-6), 1 - 1e-6) / (1 - least(greatest(p_size / 50.0::DOUBLE, 1e-6), 1 - 1e-6)))', 5)} AS logit FROM part")
def h6_scaled_view(spark: SparkSession, d: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    count = scalar.scaled(price, F.lit("count"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), quantised(count, 8).alias("count_scale"), quantised(scalar.scaled(size, F.lit("percent")), 8).alias("percent_scale"), quantised(scalar.unscaled(count, F.lit("count")), 4).alias("back"), quantised(scalar.logit(size / 50), 5).alias("logit"))


@query("SELECT o_orderkey AS id, format('{:.2f}', o_totalprice / 8)::DOUBLE + 0.0 AS eighth, format('{:.1f}', o_totalprice / 3 - 40000)::DOUBLE + 0.0 AS third, format('{:.0f}', floor(o_totalprice) / 2)::DOUBLE AS half FROM orders")
def s_rounding_of_binary_values(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scalar.rounded(x / 8, 2).alias("eighth"), scalar.rounded(x / 3 - 40000, 1).alias("third"), scalar.rounded(F.floor(x).cast("double") / 2, 0).alias("half"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS a, o_custkey AS b FROM orders")
def s_json_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = F.when(k % 5 == 0, F.lit("NaN").cast("double")).otherwise(k.cast("double"))
    text = scalar.json_numbers(F.create_map(F.lit("a"), a, F.lit("b"), F.col("o_custkey").cast("double")))
    back = F.from_json(text, "a double, b double")
    return table(spark, d, "orders").select(k.alias("id"), back.alias("x")).select("id", F.col("x.a").cast("long").alias("a"), F.col("x.b").cast("long").alias("b"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'rights|licen[cs]ed') THEN 'legal' WHEN regexp_matches(lower(text), 'password') THEN 'account' ELSE 'other' END AS rule FROM documents")
def s_string_first_rule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(scalar.first_rule(F.col("text"), {"legal": "rights|licen[cs]ed", "account": "password"}, "other"), F.lit("other")).alias("rule"))
