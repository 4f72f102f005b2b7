"""Backtests, scores, calibration, blending, post-mortems and question operators."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintra.functions import calendar, scalar
from vintra.functions.scalar import quantised, z_of
from vintra.operators import calibration, metrics, postmortem
from vintra.plans import backtest, features, questions as plans
from vintra.queries.base import BINARY, COMPONENTS, FIRST, FORECASTS, LAST, MONTHLY, OBS, QUESTIONS, RESOLUTIONS, binary, day, forecasts, obs, q, query, questions, resolutions, table

Z80 = repr(z_of(0.8))

#: The walk-forward results of the random walk and the historical mean, in SQL.
RESULTS = f"""{OBS}, {MONTHLY},
last AS (SELECT series_id, forecast_date, max(observed_at) AS last_period, arg_max(value, observed_at) AS last_value, max(max_as_of_seen) AS max_as_of_seen, max(m) AS last_m FROM history GROUP BY ALL),
plan AS (SELECT *, (forecast_date + to_months(h))::DATE AS target_period, year(forecast_date) * 12 + month(forecast_date) - 1 + h - last_m AS steps FROM last CROSS JOIN (VALUES (1), (3), (6)) v(h)),
moves AS (SELECT p.series_id, p.forecast_date, p.h, quantile_cont(a.value - b.value, 0.1) AS low, quantile_cont(a.value - b.value, 0.9) AS high FROM plan p JOIN history a ON a.series_id = p.series_id AND a.forecast_date = p.forecast_date
  JOIN history b ON b.series_id = p.series_id AND b.forecast_date = p.forecast_date AND b.m = a.m - p.steps GROUP BY ALL),
walk AS (SELECT p.series_id, 'random_walk' AS model, p.forecast_date, max_as_of_seen, target_period, p.h, last_value AS prediction, last_value + low AS lower, last_value + high AS upper FROM plan p LEFT JOIN moves v ON v.series_id = p.series_id AND v.forecast_date = p.forecast_date AND v.h = p.h),
fit AS (SELECT series_id, forecast_date, sum(round(value * 100)::BIGINT)::BIGINT::DOUBLE / 100 / count(*) AS mu, stddev_samp(value) AS sd FROM history GROUP BY ALL HAVING count(*) >= 2),
mean AS (SELECT p.series_id, 'historical_mean' AS model, p.forecast_date, max_as_of_seen, target_period, p.h, mu AS prediction, mu - {Z80}::DOUBLE * sd AS lower, mu + {Z80}::DOUBLE * sd AS upper FROM plan p JOIN fit f ON f.series_id = p.series_id AND f.forecast_date = p.forecast_date),
truth AS (SELECT series_id, observed_at, min(as_of) AS actual_as_of, arg_min(value, as_of) AS actual FROM obs WHERE value IS NOT NULL GROUP BY ALL),
results AS (SELECT r.*, forecast_date - 1 AS data_as_of, actual, actual_as_of, prediction - actual AS error FROM (SELECT * FROM walk UNION ALL SELECT * FROM mean) r LEFT JOIN truth t ON t.series_id = r.series_id AND t.observed_at = r.target_period)"""


def results(spark: SparkSession, d: str) -> DataFrame:
    return backtest.walk_forward(obs(spark, d), FIRST, LAST, [1, 3, 6], ["random_walk", "historical_mean"], digits=2)


@query(f"WITH {RESULTS} SELECT series_id, model, forecast_date, data_as_of, max_as_of_seen, target_period, h AS horizon_months, {q('prediction', 3)} AS prediction, {q('lower', 3)} AS lower, {q('upper', 3)} AS upper, actual, actual_as_of, {q('error', 3)} AS error, CASE WHEN actual IS NOT NULL THEN actual BETWEEN lower AND upper END AS in_interval FROM results")
def p14_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    return r.select("series_id", "model", "forecast_date", "data_as_of", "max_as_of_seen", "target_period", "horizon_months", *[quantised(F.col(c), 3).alias(c) for c in ("prediction", "lower", "upper")], "actual", "actual_as_of", quantised(F.col("error"), 3).alias("error"), "in_interval")


@query(f"WITH {RESULTS}, s AS (SELECT series_id, model, h AS horizon_months, count(*)::BIGINT AS n_forecasts, count(actual)::BIGINT AS n_resolved, sqrt(avg(error * error)) AS rmse, avg(abs(error)) AS mae, avg(error) AS bias, avg(CASE WHEN actual IS NOT NULL THEN (actual BETWEEN lower AND upper)::INT END) AS coverage, avg(CASE WHEN actual IS NOT NULL THEN upper - lower + {2 / (1 - 0.8)!r}::DOUBLE * greatest(lower - actual, actual - upper, 0) END) AS score FROM results GROUP BY ALL) SELECT s.series_id, s.model, s.horizon_months, s.n_forecasts, s.n_resolved, {q('s.rmse', 2)} AS rmse, {q('s.mae', 2)} AS mae, {q('s.bias', 2)} AS bias, {q('s.coverage')} AS interval_coverage, {q('s.score', 1)} AS interval_score, {q('s.rmse / b.rmse', 5)} AS rmse_ratio FROM s JOIN s b ON b.series_id = s.series_id AND b.horizon_months = s.horizon_months AND b.model = 'random_walk'")
def m1_m2_m3_m14_r17_summary(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.against_baseline(metrics.numeric_summary(results(spark, d), ["series_id", "model", "horizon_months"]), ["series_id", "horizon_months"], "model", "random_walk")
    digits = {"rmse": 2, "mae": 2, "bias": 2, "interval_coverage": 6, "interval_score": 1, "rmse_ratio": 5}
    return s.select("series_id", "model", "horizon_months", "n_forecasts", "n_resolved", *[quantised(F.col(c), n).alias(c) for c, n in digits.items()])


@query(f"WITH {RESULTS}, p AS (SELECT a.series_id, a.forecast_date, a.error * a.error / 1e12 - b.error * b.error / 1e12 AS d FROM results a JOIN results b ON a.series_id = b.series_id AND a.forecast_date = b.forecast_date AND a.h = 3 AND b.h = 3 AND a.model = 'historical_mean' AND b.model = 'random_walk' WHERE a.actual IS NOT NULL), c AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, avg(d) OVER (PARTITION BY series_id) AS mean FROM p), l AS (SELECT *, d - mean AS c, (d - mean) * lag(d - mean, 1) OVER w AS l1, (d - mean) * lag(d - mean, 2) OVER w AS l2 FROM c WINDOW w AS (PARTITION BY series_id ORDER BY forecast_date)), v AS (SELECT series_id, max(n) AS n, max(mean) AS mean, avg(c * c) + 2 * avg(l1) + 2 * avg(l2) AS variance FROM l GROUP BY series_id) SELECT series_id, n::BIGINT AS n, CASE WHEN n >= 6 AND variance > 0 THEN {q('mean / sqrt(variance / n) * sqrt((n + 1 - 6 + 6.0::DOUBLE / n) / n)', 5)} END AS statistic FROM v")
def m4_diebold_mariano(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).where("horizon_months = 3 and actual is not null").select("series_id", "forecast_date", "model", (F.col("error") / 1e6).alias("e"))
    wide = r.groupBy("series_id", "forecast_date").pivot("model", ["historical_mean", "random_walk"]).agg(F.first("e"))
    return metrics.diebold_mariano(wide, ["series_id"], "forecast_date", "historical_mean", "random_walk", 3).withColumn("statistic", quantised(F.col("statistic"), 5))


CATEGORICAL = "cat AS (SELECT o_orderkey AS id, o_orderpriority AS model, o_orderstatus AS outcome, 0.2::DOUBLE + (o_orderkey % 7)::DOUBLE / 20 AS f, 0.1::DOUBLE + (o_orderkey % 3)::DOUBLE / 20 AS o FROM orders), probs AS (SELECT id, model, outcome, unnest(['F', 'O', 'P']) AS category, unnest([f, o, 1 - f - o]) AS p FROM cat)"


def categorical(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    f, o = F.lit(0.2) + (k % 7).cast("double") / 20, F.lit(0.1) + (k % 3).cast("double") / 20
    return table(spark, d, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("outcome"), F.create_map(F.lit("F"), f, F.lit("O"), o, F.lit("P"), 1 - f - o).alias("probabilities"))


@query(f"WITH {CATEGORICAL}, s AS (SELECT id, model, sum((p - (category = outcome)::INT) * (p - (category = outcome)::INT)) AS brier, max(p) AS top, max(CASE WHEN category = outcome THEN p END) AS own, arg_max(category, p) AS likeliest FROM probs GROUP BY ALL) SELECT model, {q('avg(brier)', 5)} AS brier, {q('avg((own >= top)::INT)')} AS hit_rate, count(*) FILTER (WHERE likeliest = 'P')::BIGINT AS third FROM s GROUP BY model")
def m5_g7_categorical_brier(spark: SparkSession, d: str) -> DataFrame:
    c = categorical(spark, d)
    own, top = F.try_element_at("probabilities", "outcome"), F.array_max(F.map_values("probabilities"))
    return c.groupBy("model").agg(quantised(F.avg(scalar.brier_categories(F.col("probabilities"), F.col("outcome"))), 5).alias("brier"), quantised(F.avg((own >= top).cast("int"))).alias("hit_rate"), F.count(F.when(scalar.likeliest(F.col("probabilities")) == "P", 1)).alias("third"))


@query(f"WITH {BINARY}, t AS (SELECT *, (outcome = 'yes')::INT AS y, least(greatest(p, 1e-15), 1 - 1e-15) AS c FROM binary_frame WHERE outcome IS NOT NULL), s AS (SELECT component, count(*)::BIGINT AS n, avg((p - y) * (p - y)) AS brier, avg(CASE WHEN y = 1 THEN -ln(c) ELSE -ln(1 - c) END) AS loss, avg(y) AS rate FROM t GROUP BY component) SELECT s.component, s.n, {q('s.brier')} AS brier, {q('s.loss', 5)} AS log_loss, {q('s.rate')} AS base_rate, {q('1 - s.brier / b.brier', 5)} AS skill FROM s JOIN s b ON b.component = 'base_rate'")
def m6_m7_m11_binary_scores(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.binary_summary(binary(spark, d).where("outcome is not null"), ["component"])
    base = s.where("component = 'base_rate'").select(F.col("brier").alias("reference"))
    return s.crossJoin(F.broadcast(base)).select("component", "n", quantised(F.col("brier")).alias("brier"), quantised(F.col("log_loss"), 5).alias("log_loss"), quantised(F.col("base_rate")).alias("base_rate"), quantised(metrics.skill(F.col("brier"), F.col("reference")), 5).alias("skill"))


CURVE = f"{BINARY}, curve AS (SELECT component, least(floor(p * 10), 9)::INT AS bin, avg(p) AS mean_predicted, avg((outcome = 'yes')::INT) AS observed, count(*) AS n FROM binary_frame WHERE outcome IS NOT NULL GROUP BY ALL)"


@query(f"WITH {CURVE} SELECT component, bin, {q('mean_predicted')} AS mean_predicted, {q('observed')} AS observed, n::BIGINT AS n FROM curve")
def g5_g6_m8_calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.calibration_curve(binary(spark, d), ["component"])
    return c.select("component", "bin", quantised(F.col("mean_predicted")).alias("mean_predicted"), quantised(F.col("observed")).alias("observed"), "n")


EDGES = [k * 0.1 for k in range(1, 10)]


@query(f"WITH {BINARY} SELECT component, ({' + '.join(f'(p >= {e!r}::DOUBLE)::INT' for e in EDGES)})::INT AS bin, count(*)::BIGINT AS n FROM binary_frame WHERE outcome IS NOT NULL GROUP BY ALL")
def m8_curve_with_linspace_edges(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_curve(binary(spark, d), ["component"], bin_of=scalar.probability_bin_linspace(F.col("p"))).select("component", "bin", "n")


@query(f"WITH {CURVE}, t AS (SELECT *, n / sum(n) OVER w AS share, sum(n * observed) OVER w / sum(n) OVER w AS base FROM curve WINDOW w AS (PARTITION BY component)) SELECT component, {q('sum(share * abs(mean_predicted - observed))')} AS ece, {q('sum(share * (mean_predicted - observed) * (mean_predicted - observed))')} AS reliability, {q('sum(share * (observed - base) * (observed - base))')} AS resolution, {q('max(base) * (1 - max(base))')} AS uncertainty FROM t GROUP BY component")
def m9_m10_decomposition(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.decomposition(binary(spark, d), ["component"])
    return m.select("component", *[quantised(F.col(c)).alias(c) for c in ("ece", "reliability", "resolution", "uncertainty")])


@query(f"WITH {CATEGORICAL} SELECT model, category, count(*)::BIGINT AS n, {q('avg(p)', 5)} AS mean_predicted, {q('avg((category = outcome)::INT)')} AS observed FROM probs GROUP BY ALL")
def m12_one_vs_rest(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.one_vs_rest(categorical(spark, d))
    return r.groupBy("model", "category").agg(F.count("*").alias("n"), quantised(F.avg("p"), 5).alias("mean_predicted"), quantised(F.avg((F.col("outcome") == "yes").cast("int"))).alias("observed"))


@query(f"WITH {FORECASTS}, {QUESTIONS}, {RESOLUTIONS} SELECT forecast_id, {q('prediction - actual_value', 2)} AS error, {q('abs(prediction - actual_value)', 2)} AS abs_error, CASE WHEN actual_value IS NOT NULL AND lower IS NOT NULL THEN actual_value BETWEEN lower AND upper END AS in_interval FROM forecasts LEFT JOIN resolutions USING (question_id)")
def m13_r1_score_forecasts(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).join(resolutions(spark, d), "question_id", "left").withColumnRenamed("actual_value", "actual")
    return metrics.scored(f).select("forecast_id", quantised(F.col("error"), 2).alias("error"), quantised(F.col("abs_error"), 2).alias("abs_error"), "in_interval")


@query()
def m16_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    b = binary(spark, d).where("outcome is not null").withColumn("brier", scalar.brier_binary(F.col("p"), F.col("outcome")))
    return metrics.cluster_bootstrap(b, ["component"], "source", "brier")


FOLDS = "folds AS (SELECT *, min(forecast_date) OVER (PARTITION BY series_id, model, h, (nth - 1) // 12) - 1 AS trained_as_of FROM (SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY forecast_date) AS nth FROM results))"


@query(f"WITH {RESULTS}, {FOLDS}, e AS (SELECT f.series_id, f.model, f.h, f.trained_as_of, abs(r.actual - r.prediction) AS e FROM (SELECT DISTINCT series_id, model, h, trained_as_of FROM folds) f JOIN folds r ON r.series_id = f.series_id AND r.model = f.model AND r.h = f.h AND r.actual IS NOT NULL AND r.actual_as_of <= f.trained_as_of), o AS (SELECT *, row_number() OVER (PARTITION BY series_id, model, h, trained_as_of ORDER BY e) AS nth, count(*) OVER (PARTITION BY series_id, model, h, trained_as_of) AS n FROM e), z AS (SELECT series_id, model, h, trained_as_of, max(n) AS n, max(CASE WHEN nth = ceil((n + 1) * 0.8::DOUBLE - 1e-9) THEN e END) AS width FROM o GROUP BY ALL HAVING max(n) >= 4) SELECT f.series_id, f.model, f.h AS horizon_months, f.forecast_date, {q('prediction - width', 1)} AS lower, {q('prediction + width', 1)} AS upper, coalesce(n, 0)::INT AS n_calibration FROM folds f LEFT JOIN z ON z.series_id = f.series_id AND z.model = f.model AND z.h = f.h AND z.trained_as_of = f.trained_as_of")
def m17_m18_walk_forward_recalibration(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).withColumn("trained_as_of", F.date_sub(backtest.fold_starts(F.col("forecast_date"), 12), 1))
    out = calibration.recalibrated(r, ["series_id", "model", "horizon_months"])
    return out.select("series_id", "model", "horizon_months", "forecast_date", quantised(F.col("lower"), 1).alias("lower"), quantised(F.col("upper"), 1).alias("upper"), "n_calibration")


@query()
def m19_isotonic_and_platt(spark: SparkSession, d: str) -> DataFrame:
    """All components: fitted on questions resolved before mid-2023, asked from then on."""
    b, start = binary(spark, d), day("2023-07-01")
    train, ask = b.where(F.col("outcome").isNotNull() & (F.col("resolved_at") < start)), b.where(F.col("ask_date") >= start).select("component", "question_id", "p")
    out = calibration.isotonic(train, ask, ["component"]).select("component", "question_id", F.col("p"), F.col("calibrated").alias("isotonic"))
    for c in COMPONENTS:
        one = calibration.platt(train.where(F.col("component") == c), ask.where(F.col("component") == c)).select("component", "question_id", F.col("calibrated").alias("platt"))
        both = one if c == COMPONENTS[0] else both.unionByName(one)
    return out.join(both, ["component", "question_id"]).select("component", "question_id", "isotonic", "platt")


def folded(spark: SparkSession, d: str) -> DataFrame:
    """Categorical forecasts of orders in folds by year; the outcome is out 40 days after the forecast."""
    rows = categorical(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("asked")), "id")
    return rows.withColumns({"fold": F.year("asked"), "starts": F.trunc("asked", "year").cast("date"), "published": F.date_add("asked", 40)})


FOLDED = f"""{CATEGORICAL}, dated AS (SELECT p.*, year(o_orderdate) AS fold, date_trunc('year', o_orderdate)::DATE AS starts, o_orderdate::DATE + 40 AS published FROM probs p JOIN orders ON o_orderkey = id),
seen AS (SELECT f.model, f.fold, p.p AS x, sum((p.category = p.outcome)::INT)::BIGINT AS hits, count(*)::BIGINT AS n FROM (SELECT DISTINCT model, fold, starts FROM dated) f JOIN dated p ON p.model = f.model AND p.published < f.starts GROUP BY ALL),
upto AS (SELECT *, sum(hits) OVER w AS ch, sum(n) OVER w AS cn FROM seen WINDOW w AS (PARTITION BY model, fold ORDER BY x)),
runs AS (SELECT a.model, a.fold, a.x AS low, b.x AS high, (b.ch - a.ch + a.hits)::DOUBLE / (b.cn - a.cn + a.n) AS mean FROM upto a JOIN upto b ON a.model = b.model AND a.fold = b.fold AND b.x >= a.x),
worst AS (SELECT model, fold, high, low, min(mean) OVER (PARTITION BY model, fold, low ORDER BY high DESC) AS least FROM runs),
fit AS (SELECT u.model, u.fold, u.x, max(w.least) AS y FROM upto u JOIN worst w ON w.model = u.model AND w.fold = u.fold AND w.low <= u.x AND w.high = u.x GROUP BY ALL)"""


@query(f"WITH {FOLDED} SELECT model, fold::INT AS fold, x, {q('y', 8)} AS y FROM fit")
def m19_fold_steps(spark: SparkSession, d: str) -> DataFrame:
    """The rising function of each model and fold at the probabilities it was fitted on, against the min-max formula."""
    flat = metrics.one_vs_rest(folded(spark, d)).select("model", "fold", "starts", "published", "p", "outcome")
    past = flat.select(F.col("model").alias("m"), F.col("published").alias("out"), "p", "outcome")
    train = flat.select("model", "fold", "starts").distinct().join(past, (F.col("model") == F.col("m")) & (F.col("out") < F.col("starts"))).select("model", "fold", "p", "outcome")
    points = train.select("model", "fold", "p").distinct()
    return calibration.isotonic(train, points, ["model", "fold"]).select("model", "fold", F.col("p").alias("x"), quantised(F.col("calibrated"), 8).alias("y"))


@query()
def m19_fold_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Every categorical forecast under its fold's function, renormalised."""
    out = calibration.fold_isotonic(folded(spark, d), ["model"], "fold", "starts", "published", ["id"])
    return out.select("id", "model", "fold", *[F.col("calibrated")[c].alias(c) for c in ("F", "O", "P")])


WIDE = f"{BINARY}, wide AS (SELECT question_id, ask_date, max(CASE outcome WHEN 'yes' THEN 1.0::DOUBLE WHEN 'no' THEN 0.0::DOUBLE END) AS y, max(resolved_at) AS resolved_at, max(CASE WHEN component = 'base_rate' THEN p END) AS base_rate, max(CASE WHEN component = 'llm' THEN p END) AS llm, max(CASE WHEN component = 'market' THEN p END) AS market FROM binary_frame GROUP BY ALL)"


def wide(spark: SparkSession, d: str) -> DataFrame:
    b = binary(spark, d)
    meta = b.groupBy("question_id", "ask_date").agg(F.max(F.when(F.col("outcome") == "yes", 1.0).when(F.col("outcome") == "no", 0.0)).alias("y"), F.max("resolved_at").alias("resolved_at"))
    return b.groupBy("question_id", "ask_date").pivot("component", list(COMPONENTS)).agg(F.max("p")).join(meta, ["question_id", "ask_date"])


def _inverse(c: str) -> str:
    return f"1 / greatest(avg((p.{c} - p.y) * (p.{c} - p.y)), 1e-12)"


@query(f"""WITH {WIDE}, w AS (SELECT a.ask_date, count(p.question_id) AS n, {_inverse('base_rate')} AS ib, {_inverse('llm')} AS il, {_inverse('market')} AS im FROM (SELECT DISTINCT ask_date FROM wide) a LEFT JOIN wide p ON p.resolved_at < a.ask_date AND p.y IS NOT NULL AND p.base_rate IS NOT NULL AND p.llm IS NOT NULL AND p.market IS NOT NULL GROUP BY a.ask_date),
v AS (SELECT ask_date, n, CASE WHEN n >= 10 THEN ib / (ib + il + im) ELSE 1 / 3.0::DOUBLE END AS wb, CASE WHEN n >= 10 THEN il / (ib + il + im) ELSE 1 / 3.0::DOUBLE END AS wl, CASE WHEN n >= 10 THEN im / (ib + il + im) ELSE 1 / 3.0::DOUBLE END AS wm FROM w)
SELECT question_id, n::BIGINT AS n_history, {q('(base_rate * wb + coalesce(llm * wl, 0) + market * wm) / (wb + CASE WHEN llm IS NULL THEN 0 ELSE wl END + wm)', 5)} AS blended FROM wide JOIN v USING (ask_date)""")
def m20_m21_walk_forward_blend(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.walk_forward_blend(wide(spark, d), list(COMPONENTS), "y", "resolved_at", "ask_date", True, "inverse_variance")
    return out.select("question_id", "n_history", quantised(F.col("blended"), 5).alias("blended"))


GRID = ", ".join(f"({n}, {w[0]!r}::DOUBLE, {w[1]!r}::DOUBLE, {w[2]!r}::DOUBLE)" for n, w in enumerate(calibration.simplex(3)))


@query(f"""WITH {WIDE}, grid AS (SELECT * FROM (VALUES {GRID}) g(nth, wb, wl, wm)),
h AS (SELECT a.ask_date, p.base_rate AS b, p.llm AS l, p.market AS m, p.y FROM (SELECT DISTINCT ask_date FROM wide) a JOIN wide p ON p.resolved_at < a.ask_date AND p.y IS NOT NULL AND p.base_rate IS NOT NULL AND p.llm IS NOT NULL AND p.market IS NOT NULL),
mo AS (SELECT ask_date, count(*) AS n, sum(b * b) AS bb, sum(l * l) AS ll, sum(m * m) AS mm, sum(b * l) AS bl, sum(b * m) AS bm, sum(l * m) AS lm, sum(b * y) AS yb, sum(l * y) AS yl, sum(m * y) AS ym, sum(y * y) AS yy FROM h GROUP BY ask_date),
lo AS (SELECT ask_date, n, nth, wb, wl, wm, floor((yy - 2 * (wb * yb + wl * yl + wm * ym) + wb * wb * bb + wl * wl * ll + wm * wm * mm + 2 * (wb * wl * bl + wb * wm * bm + wl * wm * lm)) / n * 1e9 + 0.5) AS loss FROM mo CROSS JOIN grid),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask_date ORDER BY loss, nth) AS r FROM lo) WHERE r = 1),
v AS (SELECT w.ask_date, coalesce(n, 0) AS n, CASE WHEN n >= 10 THEN wb ELSE 1 / 3.0::DOUBLE END AS wb, CASE WHEN n >= 10 THEN wl ELSE 1 / 3.0::DOUBLE END AS wl, CASE WHEN n >= 10 THEN wm ELSE 1 / 3.0::DOUBLE END AS wm FROM (SELECT DISTINCT ask_date FROM wide) w LEFT JOIN best USING (ask_date)),
s AS (SELECT question_id, n, base_rate, llm, market, wb, CASE WHEN llm IS NULL THEN 0 ELSE wl END AS wl, wm FROM wide JOIN v USING (ask_date))
SELECT question_id, n::BIGINT AS n_history, {q('CASE WHEN wb + wl + wm > 0 THEN (base_rate * wb + coalesce(llm, 0) * wl + market * wm) / (wb + wl + wm) ELSE (base_rate + coalesce(llm, 0) + market) / (2 + (llm IS NOT NULL)::INT) END', 5)} AS blended FROM s""")
def m20_m21_learned_blend(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.walk_forward_blend(wide(spark, d), list(COMPONENTS), "y", "resolved_at", "ask_date", True, "learned")
    return out.select("question_id", "n_history", quantised(F.col("blended"), 5).alias("blended"))


@query(f"""WITH {RESULTS}, w AS (SELECT series_id, forecast_date, target_period, data_as_of, actual, actual_as_of, max(CASE WHEN model = 'random_walk' THEN prediction END) AS p0, max(CASE WHEN model = 'historical_mean' THEN prediction END) AS p1,
  max(CASE WHEN model = 'random_walk' THEN lower END) AS l0, max(CASE WHEN model = 'historical_mean' THEN lower END) AS l1 FROM results GROUP BY ALL),
m AS (SELECT a.data_as_of, count(p.actual) AS n, 1 / greatest(avg((p.p0 / p.actual - 1) * (p.p0 / p.actual - 1)), 1e-12) AS i0, 1 / greatest(avg((p.p1 / p.actual - 1) * (p.p1 / p.actual - 1)), 1e-12) AS i1
  FROM (SELECT DISTINCT data_as_of FROM w) a LEFT JOIN w p ON p.actual_as_of <= a.data_as_of AND p.p0 IS NOT NULL AND p.p1 IS NOT NULL AND p.actual IS NOT NULL AND p.actual <> 0 GROUP BY a.data_as_of),
v AS (SELECT data_as_of, n, CASE WHEN n >= 10 THEN i0 / (i0 + i1) ELSE 0.5::DOUBLE END AS w0, CASE WHEN n >= 10 THEN i1 / (i0 + i1) ELSE 0.5::DOUBLE END AS w1 FROM m)
SELECT series_id, forecast_date, target_period, n::BIGINT AS n_history, {q('CASE WHEN p0 IS NULL THEN p1 WHEN p1 IS NULL THEN p0 ELSE (p0 * w0 + p1 * w1) / (w0 + w1) END', 2)} AS prediction, {q('CASE WHEN l0 IS NULL THEN l1 WHEN l1 IS NULL THEN l0 ELSE (l0 * w0 + l1 * w1) / (w0 + w1) END', 1)} AS lower FROM w JOIN v USING (data_as_of)""")
def m21_numeric_blend(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    key = ["series_id", "forecast_date", "target_period", "data_as_of", "actual", "actual_as_of"]
    models = ["random_walk", "historical_mean"]
    rows = r.groupBy(*key).agg(*[F.first(F.when(F.col("model") == m, F.struct("prediction", "lower", "upper")), ignorenulls=True).alias(m) for m in models])
    out = calibration.numeric_blend(rows, models, "inverse_variance")
    return out.select("series_id", "forecast_date", "target_period", "n_history", quantised(F.col("prediction"), 2).alias("prediction"), quantised(F.col("lower"), 1).alias("lower"))


@query(f"""WITH {FORECASTS}, {RESOLUTIONS}, t AS (SELECT forecast_id, abs(prediction - actual_value) AS e, abs(prediction - coalesce(latest_value, actual_value)) AS r, 1.5::DOUBLE * (upper - lower) / 2 AS band, actual_value AS first, coalesce(latest_value, actual_value) AS latest, (forecast_id % 80) AS moves, actual_value * 0.5::DOUBLE AS last_known FROM forecasts JOIN resolutions USING (question_id) WHERE actual_value IS NOT NULL)
SELECT forecast_id, CASE WHEN e <= band THEN 'expected_variance' WHEN latest <> first AND CASE WHEN band IS NOT NULL THEN r <= band AND e - r >= 0.25::DOUBLE * e ELSE e - r >= e / 2 END THEN 'bad_data' WHEN moves >= 36 AND abs(first - last_known) > 60000 THEN 'regime_change' ELSE 'bad_model' END AS category FROM t""")
def m22_classify_numeric(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).join(resolutions(spark, d), "question_id").where("actual_value is not null")
    c = postmortem.classify_numeric(F.col("prediction"), F.col("lower"), F.col("upper"), F.col("actual_value"), F.col("latest_value"), F.col("actual_value") * 0.5, F.lit(60000.0), F.col("forecast_id") % 80)
    return f.select("forecast_id", c.alias("category"))


@query(f"WITH {WIDE}, t AS (SELECT question_id, CASE WHEN y = 1 THEN llm ELSE 1 - llm END AS own, CASE WHEN y = 1 THEN base_rate ELSE 1 - base_rate END AS ref FROM wide WHERE y IS NOT NULL AND llm IS NOT NULL) SELECT question_id, CASE WHEN own >= 0.2::DOUBLE - 1e-9 THEN 'expected_variance' WHEN ref >= 0.2::DOUBLE - 1e-9 THEN 'bad_model' ELSE 'regime_change' END AS category FROM t")
def m23_classify_binary(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d).where("y is not null and llm is not null").withColumn("outcome", F.when(F.col("y") == 1, "yes").otherwise("no"))
    return w.select("question_id", postmortem.classify_binary(F.col("llm"), F.col("outcome"), F.col("base_rate")).alias("category"))


@query(f"WITH {FORECASTS}, t AS (SELECT forecast_id, p, CASE forecast_id % 3 WHEN 0 THEN 'hike' WHEN 1 THEN 'cut' ELSE 'hold' END AS outcome, CASE WHEN forecast_id % 13 > 0 THEN (forecast_id % 9 - 4)::DOUBLE / 20 END AS spread FROM forecasts) SELECT forecast_id, CASE WHEN p >= 0.2::DOUBLE THEN 'expected_variance' WHEN spread IS NULL OR CASE outcome WHEN 'hike' THEN spread >= 0.1::DOUBLE WHEN 'cut' THEN spread <= -0.1::DOUBLE ELSE abs(spread) < 0.1::DOUBLE END THEN 'bad_model' ELSE 'regime_change' END AS category FROM t")
def m23_classify_decision(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("forecast_id")
    outcome = F.when(k % 3 == 0, "hike").when(k % 3 == 1, "cut").otherwise("hold")
    spread = F.when(k % 13 > 0, (k % 9 - 4).cast("double") / 20)
    return forecasts(spark, d).select("forecast_id", postmortem.classify_decision(F.col("p"), outcome, spread).alias("category"))


DECISIONS = "rates AS (SELECT date_trunc('week', o_orderdate)::DATE AS meeting, floor(sum(floor(o_totalprice)::BIGINT) / count(*) / 20000)::BIGINT AS target FROM orders GROUP BY ALL), decisions AS (SELECT meeting, target, lag(target) OVER (ORDER BY meeting) AS before FROM rates), labelled AS (SELECT meeting, target, CASE WHEN target > before THEN 'hike' WHEN target < before THEN 'cut' ELSE 'hold' END AS outcome FROM decisions WHERE before IS NOT NULL)"


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Weekly levels labelled by their move: a calendar of a few hundred rows, so its window is one small partition."""
    rates = table(spark, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("meeting")).agg(F.floor(F.sum(F.floor("o_totalprice")) / F.count("*") / 20000).alias("target"))
    before = F.lag("target").over(Window.orderBy("meeting"))
    out = rates.withColumn("before", before).where("before is not null")
    return out.select("meeting", "target", F.when(F.col("target") > F.col("before"), "hike").when(F.col("target") < F.col("before"), "cut").otherwise("hold").alias("outcome"))


@query(f"WITH {DECISIONS} SELECT * FROM labelled")
def m24_decision_labels(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d)


@query(f"WITH {DECISIONS}, t AS (SELECT outcome, lag(outcome) OVER (ORDER BY meeting) AS before FROM labelled) SELECT before, {', '.join(f'{q(f"(count(*) FILTER (WHERE outcome = '{o}') + 1)::DOUBLE / (count(*) + 3)")} AS {o}' for o in ('cut', 'hold', 'hike'))} FROM t WHERE before IS NOT NULL GROUP BY before")
def p5_transition_rates(spark: SparkSession, d: str) -> DataFrame:
    states = ["cut", "hold", "hike"]
    out = plans.transition_rates(decisions(spark, d).withColumn("one", F.lit(1)), ["one"], "meeting", "outcome", states)
    return out.select("before", *[quantised(F.col(s)).alias(s) for s in states])


@query(f"WITH {DECISIONS}, t AS (SELECT *, row_number() OVER (ORDER BY meeting) AS nth FROM labelled) SELECT meeting, (nth - coalesce(max(CASE WHEN outcome <> 'hold' THEN nth END) OVER (ORDER BY meeting), 1))::INT AS since_change, count(*) OVER (ORDER BY meeting ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)::BIGINT AS n_past, count(*) FILTER (WHERE outcome = 'hike') OVER (ORDER BY meeting ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)::BIGINT AS past_hikes, meeting - 8 AS cutoff FROM t")
def p13_r15_rate_features(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy("meeting")
    past = w.rowsBetween(-24, -1)
    t = decisions(spark, d).withColumn("nth", F.row_number().over(w))
    moved = F.last(F.when(F.col("outcome") != "hold", F.col("nth")), ignorenulls=True).over(w)
    return t.select("meeting", (F.col("nth") - F.coalesce(moved, F.lit(1))).alias("since_change"), F.count("*").over(past).alias("n_past"), F.count(F.when(F.col("outcome") == "hike", 1)).over(past).alias("past_hikes"), F.date_sub("meeting", 8).alias("cutoff"))


@query(f"WITH {OBS}, {MONTHLY}, last AS (SELECT series_id, forecast_date, arg_max(value, observed_at) / 1e4 AS base FROM history GROUP BY ALL), t AS (SELECT *, least(floor((base / 10 + 100 * step) * 10 + 0.5) / 10, 100) AS points, base * (1 + step) AS level FROM last CROSS JOIN (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE)) s(step)) SELECT series_id, forecast_date, step, {q('level', 4)} AS level, (level / base - 1 >= step - 1e-9) AS cleared FROM t")
def m25_threshold_steps(spark: SparkSession, d: str) -> DataFrame:
    h = backtest.histories(obs(spark, d), FIRST, LAST)
    last = h.groupBy("series_id", "forecast_date").agg((F.max_by("value", "observed_at") / 1e4).alias("base"))
    t = last.select("*", F.explode(F.array(F.lit(0.05), F.lit(0.1), F.lit(0.25))).alias("step")).withColumn("level", F.col("base") * (1 + F.col("step")))
    ok = plans.cleared(F.col("base"), F.col("level"), F.col("base") * (1 + F.col("step")), F.col("base"), F.lit("count"))
    return t.select("series_id", "forecast_date", "step", quantised(F.col("level"), 4).alias("level"), ok.alias("cleared"))


@query(f"WITH {OBS}, live AS (SELECT series_id, observed_at, min(as_of) AS v, arg_min(value, as_of) AS value FROM obs WHERE NOT reconstructed AND value IS NOT NULL AND as_of <= DATE '1998-06-30' GROUP BY ALL), asked AS (SELECT DISTINCT series_id, observed_at AS target_date FROM obs) SELECT a.series_id, a.target_date, CASE WHEN value >= 60000 THEN 'yes' WHEN value IS NOT NULL THEN 'no' END AS outcome FROM asked a LEFT JOIN live l ON l.series_id = a.series_id AND l.observed_at = a.target_date")
def m26_threshold_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d)
    asked = o.select("series_id", F.col("observed_at").alias("target_date")).distinct().withColumn("threshold", F.lit(60000.0))
    return plans.outcomes(asked, o, day("1998-06-30")).select("series_id", "target_date", "outcome")


@query(f"WITH {WIDE}, t AS (SELECT count(*) AS n, avg((llm - y) * (llm - y) - (base_rate - y) * (base_rate - y)) AS diff FROM wide WHERE y IS NOT NULL AND llm IS NOT NULL) SELECT n::BIGINT AS n, {q('diff')} AS diff, diff < 0 AS better FROM t")
def m28_verdict(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d).where("y is not null and llm is not null")
    diff = F.avg(F.pow(F.col("llm") - F.col("y"), 2) - F.pow(F.col("base_rate") - F.col("y"), 2))
    return w.agg(F.count("*").alias("n"), diff.alias("d")).select("n", quantised(F.col("d")).alias("diff"), (F.col("d") < 0).alias("better"))


@query(f"WITH {RESULTS}, s AS (SELECT series_id, h AS horizon_months, model, sqrt(avg(error * error)) AS rmse FROM results GROUP BY ALL) SELECT series_id, horizon_months, arg_min(model, rmse) AS best FROM s GROUP BY ALL")
def m29_best_model(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.numeric_summary(results(spark, d), ["series_id", "horizon_months", "model"])
    return s.groupBy("series_id", "horizon_months").agg(F.min_by("model", F.struct("rmse", "model")).alias("best"))


@query(f"WITH {FORECASTS} SELECT model_type, count(*) FILTER (WHERE forecast_date >= DATE '1997-01-01' + (length(model_type) * 30)::INT)::BIGINT AS kept, count(*) FILTER (WHERE forecast_date < DATE '1997-01-01' + (length(model_type) * 30)::INT)::BIGINT AS dropped FROM forecasts GROUP BY model_type")
def m30_training_cutoff_rule(spark: SparkSession, d: str) -> DataFrame:
    cutoff = F.date_add(day("1997-01-01"), (F.length("model_type") * 30).cast("int"))
    f = forecasts(spark, d).withColumn("after", F.col("forecast_date") >= cutoff)
    return f.groupBy("model_type").agg(F.count(F.when(F.col("after"), 1)).alias("kept"), F.count(F.when(~F.col("after"), 1)).alias("dropped"))


# ---- models and features

AT = "series_id, forecast_date"


@query(f"WITH {OBS}, {MONTHLY}, r AS (SELECT *, row_number() OVER (PARTITION BY {AT} ORDER BY observed_at DESC) AS nth FROM history), f AS (SELECT {AT}, avg(ln(value)) AS mu, stddev_samp(ln(value)) AS sd FROM r WHERE nth <= 12 GROUP BY ALL HAVING count(*) >= 2) SELECT {AT}, {q('exp(mu)', 3)} AS prediction, {q(f'exp(mu - {Z80}::DOUBLE * sd)', 3)} AS lower, {q(f'exp(mu + {Z80}::DOUBLE * sd)', 3)} AS upper FROM f")
def p2_geometric_mean(spark: SparkSession, d: str) -> DataFrame:
    h = backtest.histories(obs(spark, d), FIRST, LAST)
    out = backtest.historical_mean(h, [1], months=12, log=True)
    return out.select("series_id", "forecast_date", *[quantised(F.col(c), 3).alias(c) for c in ("prediction", "lower", "upper")])


@query(f"""WITH {OBS}, {MONTHLY}, r AS (SELECT *, m::DOUBLE AS x, value / 1e6 AS y, row_number() OVER (PARTITION BY {AT} ORDER BY observed_at DESC) AS nth FROM history),
f AS (SELECT {AT}, regr_slope(y, x) AS slope, avg(x) AS mx, avg(y) AS my, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM r WHERE nth <= 12 GROUP BY ALL HAVING count(*) >= 3),
t AS (SELECT *, year(forecast_date) * 12 + month(forecast_date) - 1 + 3 - mx AS dx, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) AS s FROM f)
SELECT {AT}, {q('my + slope * dx', 4)} AS prediction, {q(f'my + slope * dx - {Z80}::DOUBLE * s * sqrt(1 + 1.0::DOUBLE / n + dx * dx / sxx)', 4)} AS lower FROM t""")
def p3_linear_trend(spark: SparkSession, d: str) -> DataFrame:
    h = backtest.histories(obs(spark, d), FIRST, LAST).withColumn("value", F.col("value") / 1e6)
    out = backtest.linear_trend(h, [3]).where("n >= 3")
    return out.select("series_id", "forecast_date", quantised(F.col("prediction"), 4).alias("prediction"), quantised(F.col("lower"), 4).alias("lower"))


@query(f"WITH {OBS}, {MONTHLY}, last AS (SELECT {AT}, arg_max(value, observed_at) AS base FROM history GROUP BY ALL), moves AS (SELECT l.series_id, l.forecast_date, count(*) AS n, count(*) FILTER (WHERE a.value / b.value - 1 >= 0.1::DOUBLE - 1e-9) AS yes FROM last l JOIN history a ON a.series_id = l.series_id AND a.forecast_date = l.forecast_date JOIN history b ON b.series_id = a.series_id AND b.forecast_date = a.forecast_date AND b.m = a.m - 3 GROUP BY ALL) SELECT {AT}, n::BIGINT AS n, {q('(yes + 1)::DOUBLE / (n + 2)')} AS p FROM moves")
def p4_threshold_base_rate(spark: SparkSession, d: str) -> DataFrame:
    from vintra.operators.series import shifted

    w = Window.partitionBy("series_id", "forecast_date").orderBy(calendar.month_index(F.col("observed_at")))
    h = backtest.histories(obs(spark, d), FIRST, LAST).withColumn("before", shifted("value", 3, w)).where("before is not null")
    yes = F.count(F.when(plans.relative_step(F.col("before"), F.col("value"), F.lit("count")) >= 0.1 - plans.TOLERANCE, 1))
    return h.groupBy("series_id", "forecast_date").agg(F.count("*").alias("n"), quantised(plans.laplace(yes, F.count("*"))).alias("p"))


TARGETS = ("1-URGENT", "5-LOW")


@query(f"WITH {OBS}, {MONTHLY}, last AS (SELECT {AT}, max(m) AS lm FROM history GROUP BY ALL), v AS (SELECT {AT}, max(CASE WHEN m = lm THEN value END) AS level, max(CASE WHEN m = lm - 12 THEN value END) AS lag12 FROM last JOIN history USING (series_id, forecast_date) GROUP BY ALL) SELECT forecast_date, {', '.join(f"max(CASE WHEN series_id = '{s}' THEN {c} END) AS {n}_{c}" for n, s in zip(('urgent', 'low'), TARGETS) for c in ('level', 'lag12'))}, max(CASE WHEN series_id = '{TARGETS[0]}' THEN level END) AS target_level, max(CASE WHEN series_id = '{TARGETS[0]}' THEN lag12 END) AS target_lag12 FROM v WHERE series_id IN {TARGETS} GROUP BY forecast_date")
def p12_target_features(spark: SparkSession, d: str) -> DataFrame:
    """Two series' features side by side, the first one's again as the target's."""
    m = features.monthly_features(backtest.histories(obs(spark, d), FIRST, LAST), lags=[12], changes=[], max_stale=600)
    wide = features.pivoted(m, list(TARGETS), ["level", "lag12"])
    named = wide.withColumnsRenamed({f"{s}_{c}": f"{n}_{c}" for n, s in zip(("urgent", "low"), TARGETS, strict=True) for c in ("level", "lag12")})
    return features.with_target(named, "urgent")


@query(f"WITH {OBS}, {MONTHLY}, last AS (SELECT {AT}, max(m) AS lm FROM history GROUP BY ALL), j AS (SELECT l.series_id, l.forecast_date, lm, h.m, h.value FROM last l JOIN history h ON h.series_id = l.series_id AND h.forecast_date = l.forecast_date), v AS (SELECT {AT}, lm, max(CASE WHEN m = lm THEN value END) AS level, max(CASE WHEN m = lm - 1 THEN value END) AS l1, max(CASE WHEN m = lm - 2 THEN value END) AS l2, max(CASE WHEN m = lm - 12 THEN value END) AS l12 FROM j GROUP BY ALL), b AS (SELECT *, year(forecast_date - 1) * 12 + month(forecast_date - 1) - 1 - lm AS behind FROM v) SELECT {AT}, level, l1 AS lag1, l12 AS lag12, {q('(level / l1 - 1) * 100', 4)} AS growth1, {q('(level / l12 - 1) * 100', 4)} AS growth12, {q('level - l1', 2)} AS chg1, {q('(level + l1 + l2) / 3', 2)} AS mean3, behind::DOUBLE AS months_behind, (month(forecast_date - 1) = 3)::INT::DOUBLE AS month_3, (quarter(forecast_date - 1) = 2)::INT::DOUBLE AS quarter_2 FROM b")
def p11_p12_feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = features.monthly_features(backtest.histories(obs(spark, d), FIRST, LAST), lags=[1, 12], changes=[1, 12], max_stale=60)
    digits = {"growth1": 4, "growth12": 4, "chg1": 2, "mean3": 2}
    return m.select("series_id", "forecast_date", "level", "lag1", "lag12", *[quantised(F.col(c), n).alias(c) for c, n in digits.items()], "months_behind", "month_3", "quarter_2")


@query(f"WITH {QUESTIONS}, p AS (SELECT target AS series_id, d::DATE AS ask_date, h AS horizon_months, (d + to_months(h))::DATE AS target_date FROM (SELECT DISTINCT target FROM questions) CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-01', INTERVAL 1 MONTH)) AS d) CROSS JOIN (VALUES (1), (3), (6)) v(h)) SELECT * FROM p")
def p16_planned_questions(spark: SparkSession, d: str) -> DataFrame:
    s = questions(spark, d).select(F.col("target").alias("series_id"), F.lit("count").alias("kind")).distinct()
    return plans.planned(s, [1, 3, 6], "1998-01-01", "1998-12-01").select("series_id", "ask_date", "horizon_months", "target_date")


@query(f"WITH c AS (SELECT conv_id, turn, role, length(text) // 4 AS cost, sha256(text) AS context FROM conversations) SELECT conv_id, turn, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent, context = min(context) OVER (PARTITION BY conv_id) AS lowest FROM c")
def p18_cache_and_budget(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).alias("cost"), F.sha2("text", 256).alias("context"))
    least = F.min("context").over(Window.partitionBy("conv_id"))
    return plans.spent_before(c, ["conv_id"], ["turn"]).select("conv_id", "turn", F.col("spent").cast("long").alias("spent"), (F.col("context") == least).alias("lowest"))


@query("WITH c AS (SELECT conv_id, turn, length(text) // 4 AS cost, sha256(text) AS context FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY conv_id, turn) = 1 AS paid FROM c) SELECT conv_id, count(*) FILTER (WHERE paid)::BIGINT AS calls, count(*) FILTER (WHERE NOT paid)::BIGINT AS cached, sum(CASE WHEN paid THEN cost ELSE 0 END)::BIGINT AS cost FROM f GROUP BY conv_id")
def p18_cached_calls(spark: SparkSession, d: str) -> DataFrame:
    """The first call with a context is paid, later ones with the same hash are read from the cache."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).alias("cost"), F.sha2("text", 256).alias("context"))
    paid = plans.first_calls(c, "context", ["conv_id", "turn"])
    return paid.groupBy("conv_id").agg(F.count(F.when(F.col("paid"), 1)).alias("calls"), F.count(F.when(~F.col("paid"), 1)).alias("cached"), F.sum(F.when(F.col("paid"), F.col("cost")).otherwise(0)).cast("long").alias("cost"))


@query(f"WITH q AS (SELECT o_orderpriority AS series_id, date_trunc('quarter', o_orderdate)::DATE AS quarter, (count(*) % 17)::DOUBLE / 4 AS rate FROM orders GROUP BY ALL) SELECT series_id, quarter, {q('exp(sum(0.25::DOUBLE * ln(1 + rate / 100)) OVER (PARTITION BY series_id ORDER BY quarter)) * 100')} AS level FROM q")
def p19_chained_levels(spark: SparkSession, d: str) -> DataFrame:
    rates = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("quarter")).agg(((F.count("*") % 17).cast("double") / 4).alias("rate"))
    w = Window.partitionBy("series_id").orderBy("quarter")
    return rates.select("series_id", "quarter", quantised(F.exp(F.sum(0.25 * F.log(1 + F.col("rate") / 100)).over(w)) * 100).alias("level"))


# ---- remaining reads


@query(f"WITH {FORECASTS}, {QUESTIONS}, {RESOLUTIONS} SELECT forecast_id, question_id, domain FROM forecasts JOIN questions USING (question_id) JOIN resolutions USING (question_id) WHERE domain = 'ai' AND forecast_id % 3 <> 0")
def r1_r2_unscored(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).withColumn("scored_at", F.when(F.col("forecast_id") % 3 == 0, F.col("forecast_date")))
    return f.where("scored_at is null").join(questions(spark, d).where("domain = 'ai'"), "question_id").join(resolutions(spark, d).select("question_id"), "question_id").select("forecast_id", "question_id", "domain")


@query(f"WITH {FORECASTS}, p AS (SELECT o_orderkey AS forecast_id, o_orderkey % 7 = 0 AS confirmed, o_orderkey % 10 = 0 AS drafted FROM orders WHERE o_orderkey % 5 = 0) SELECT forecast_id, confirmed, row_number() OVER (ORDER BY confirmed, forecast_date DESC, forecast_id)::INT AS nth FROM p JOIN forecasts USING (forecast_id) WHERE drafted QUALIFY nth <= 30")
def r3_r4_r5_review_queue(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("forecast_id")
    p = forecasts(spark, d).where((k % 5 == 0) & (k % 10 == 0)).withColumn("confirmed", k % 7 == 0)
    order = [F.col("confirmed"), F.desc("forecast_date"), F.col("forecast_id")]
    return p.orderBy(*order).limit(30).withColumn("nth", F.row_number().over(Window.orderBy(*order))).select("forecast_id", "confirmed", "nth")


@query(f"WITH {OBS} SELECT DISTINCT series_id, observed_at FROM obs WHERE NOT reconstructed")
def r7_live_months(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).where(~F.col("reconstructed")).select("series_id", "observed_at").distinct()


@query(f"WITH {FORECASTS}, {QUESTIONS} SELECT domain, date_trunc('month', forecast_date)::DATE AS month, min(forecast_date) AS first_day FROM forecasts JOIN questions USING (question_id) WHERE NOT is_backtest AND horizon_months IS NOT NULL GROUP BY ALL")
def r8_month_forecast_date(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).where("not is_backtest").join(questions(spark, d).where("horizon_months is not null"), "question_id")
    return f.groupBy("domain", F.trunc("forecast_date", "month").cast("date").alias("month")).agg(F.min("forecast_date").alias("first_day"))


@query("SELECT user_id AS market_id, ts::DATE AS day, arg_max(value, ts) AS price FROM events WHERE ts::DATE < DATE '2024-01-29' GROUP BY ALL")
def r11_daily_prices(spark: SparkSession, d: str) -> DataFrame:
    from vintra.sources.readers import daily_prices

    ticks = table(spark, d, "events").select(F.col("user_id").alias("market_id"), F.col("ts").alias("at"), F.col("value").alias("price"))
    return daily_prices(ticks, day("2024-01-29"))


@query(f"WITH {DECISIONS} SELECT DISTINCT meeting, asked FROM labelled CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-03-31', INTERVAL 1 DAY))::DATE AS asked) WHERE asked >= meeting - 7 AND asked < meeting")
def r16_pre_meeting_due(spark: SparkSession, d: str) -> DataFrame:
    m = decisions(spark, d).select("meeting")
    asked = m.select("meeting", F.explode(F.sequence(F.date_sub("meeting", 7), F.date_sub("meeting", 1))).alias("asked"))
    return asked.where("asked between date '1998-01-01' and date '1998-03-31'")


@query(f"WITH {WIDE}, common AS (SELECT * FROM wide w JOIN (SELECT DISTINCT question_id, source FROM binary_frame) USING (question_id) WHERE y IS NOT NULL AND llm IS NOT NULL), long AS (SELECT source, y, unnest(['base_rate', 'llm', 'market']) AS component, unnest([base_rate, llm, market]) AS p FROM common) SELECT source, component, count(*)::BIGINT AS n, {q('sum(floor((p - y) * (p - y) * 1e9 + 0.5)::BIGINT)::DOUBLE / count(*) / 1e9')} AS brier FROM long GROUP BY ALL")
def r18_brier_on_common_set(spark: SparkSession, d: str) -> DataFrame:
    sources = binary(spark, d).select("question_id", "source").distinct()
    common = wide(spark, d).where("y is not null and llm is not null").join(sources, "question_id")
    long = common.selectExpr("source", "y", "stack(3, 'base_rate', base_rate, 'llm', llm, 'market', market) as (component, p)")
    # whole numbers add up alike in any order
    squares = F.floor((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")) * 1e9 + 0.5)
    return long.groupBy("source", "component").agg(F.count("*").alias("n"), quantised(F.sum(squares).cast("double") / F.count("*") / 1e9).alias("brier"))


@query(f"WITH {QUESTIONS}, {FORECASTS}, f AS (SELECT question_id, arg_max(p, struct_pack(a := forecast_date, b := forecast_id)) AS p FROM forecasts WHERE model_type = '1-URGENT' GROUP BY question_id) SELECT q.question_id, f.p FROM questions q LEFT JOIN f USING (question_id) WHERE question_type = 'binary'")
def r20_one_row_per_question(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).where("model_type = '1-URGENT'").groupBy("question_id").agg(F.max_by("p", F.struct("forecast_date", "forecast_id")).alias("p"))
    return questions(spark, d).where("question_type = 'binary'").join(f, "question_id", "left").select("question_id", "p")


# ---- helpers of pooled models


@query(f"WITH {RESULTS}, ranks AS (SELECT *, dense_rank() OVER (ORDER BY forecast_date) AS r FROM results WHERE h = 1 AND model = 'random_walk'), t AS (SELECT *, max(r) OVER () AS most FROM ranks) SELECT series_id, forecast_date, CASE WHEN r > most / 6.0::DOUBLE THEN least(ceil(r / (most / 6.0::DOUBLE)) - 1, 5)::BIGINT END AS fold FROM t")
def h1_time_folds(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).where("horizon_months = 1 and model = 'random_walk'").select("series_id", "forecast_date")
    # folds go by distinct dates, of which there are few; rows of one date stay together
    dates = r.select("forecast_date").distinct().withColumn("r", F.dense_rank().over(Window.orderBy("forecast_date")))
    most = dates.agg(F.max("r").alias("most"))
    folds = dates.crossJoin(most).select("forecast_date", F.when(F.col("r") > F.col("most") / 6.0, F.least(F.ceil(F.col("r") / (F.col("most") / 6.0)) - 1, F.lit(5))).alias("fold"))
    return r.join(folds, "forecast_date").select("series_id", "forecast_date", "fold")


@query(f"WITH {RESULTS}, starts AS (SELECT fold, DATE '1996-06-01' + to_months(12 * fold) AS starts FROM (VALUES (0), (1), (2)) f(fold)) SELECT fold, count(*) FILTER (WHERE forecast_date < starts)::BIGINT AS before, count(*) FILTER (WHERE forecast_date < starts AND actual_as_of < starts)::BIGINT AS kept FROM results CROSS JOIN starts WHERE actual IS NOT NULL GROUP BY fold")
def h2_fold_purge(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).where("actual is not null").select("forecast_date", "actual_as_of", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fold"))
    starts = F.add_months(day("1996-06-01"), F.col("fold") * 12)
    r = r.withColumn("starts", starts).where("forecast_date < starts")
    return r.groupBy("fold").agg(F.count("*").alias("before"), F.count(F.when(F.col("actual_as_of") < F.col("starts"), 1)).alias("kept"))


@query(f"WITH {FORECASTS} SELECT forecast_id, least(day(forecast_date) - 1, 27)::INT AS offset_days, (model_type = '1-URGENT')::INT::DOUBLE AS is_urgent, (model_type = '5-LOW')::INT::DOUBLE AS is_low, greatest(0.01::DOUBLE, least(p, 0.99::DOUBLE)) AS p FROM forecasts")
def h3_h4_h7_row_helpers(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).select("forecast_id", F.least(F.dayofmonth("forecast_date") - 1, F.lit(27)).alias("offset_days"), (F.col("model_type") == "1-URGENT").cast("double").alias("is_urgent"), (F.col("model_type") == "5-LOW").cast("double").alias("is_low"), scalar.clip(F.col("p"), 0.01, 0.99).alias("p"))
