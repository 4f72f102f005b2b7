"""The data model derived from the supplied tables, once for Spark and once as SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with the SQL that DuckDB answers alike."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of each order month by priority, revised with every later ship day; some vintages are null, some reconstructed."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5)
    sold = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).where("l_shipdate > o_orderdate")
    sold = sold.groupBy(F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").cast("date").alias("observed_at"), F.col("l_shipdate").cast("date").alias("as_of")).agg(F.sum(cents).alias("cents"), F.min(F.col("l_orderkey") % 97).alias("hole"))
    so_far = F.sum("cents").over(Window.partitionBy("series_id", "observed_at").orderBy("as_of")).cast("double") / 100
    return sold.select("series_id", "observed_at", "as_of", F.when(F.col("hole") != 0, so_far).alias("value"), (F.dayofmonth("as_of") % 5 == 0).alias("reconstructed"))


OBS = """sold AS (
  SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS observed_at, l_shipdate::DATE AS as_of,
         sum(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5)::BIGINT)::BIGINT AS cents, min(l_orderkey % 97) AS hole
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate GROUP BY ALL),
obs AS (
  SELECT series_id, observed_at, as_of, CASE WHEN hole <> 0 THEN (sum(cents) OVER (PARTITION BY series_id, observed_at ORDER BY as_of))::DOUBLE / 100 END AS value,
         day(as_of) % 5 = 0 AS reconstructed FROM sold)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, day, value): mean event value by type and day, from exact cents."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("day")).agg((F.sum(F.floor(F.col("value") * 100 + 0.5)).cast("double") / 100 / F.count("*")).alias("value"))


DAILY = "daily AS (SELECT event_type AS series_id, ts::DATE AS day, sum(floor(value * 100 + 0.5)::BIGINT)::DOUBLE / 100 / count(*) AS value FROM events GROUP BY ALL)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("question_id"), F.col("c_mktsegment").alias("target"), F.when(k % 3 == 0, "numeric_interval").when(k % 3 == 1, "probability").otherwise("binary").alias("question_type"), F.when(F.col("c_nationkey") % 2 == 0, "economy").otherwise("ai").alias("domain"),
        F.date_add(day("1996-01-01"), (k % 1500).cast("int")).alias("target_date"), F.when(k % 3 == 0, (k % 6 + 1).cast("int")).alias("horizon_months"), F.when(k % 3 != 0, (k % 30).cast("int")).alias("lead_days"), F.when(k % 3 == 2, F.concat(F.col("c_mktsegment"), F.lit(">="), (k % 10).cast("string"))).alias("question_key"),
    )


QUESTIONS = """questions AS (
  SELECT c_custkey AS question_id, c_mktsegment AS target, CASE c_custkey % 3 WHEN 0 THEN 'numeric_interval' WHEN 1 THEN 'probability' ELSE 'binary' END AS question_type,
         CASE WHEN c_nationkey % 2 = 0 THEN 'economy' ELSE 'ai' END AS domain, DATE '1996-01-01' + (c_custkey % 1500)::INT AS target_date,
         CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 6 + 1)::INT END AS horizon_months, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 30)::INT END AS lead_days,
         CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment || '>=' || (c_custkey % 10) END AS question_key FROM customer)"""


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("question_id")
    numeric = k % 3 == 0
    acct = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal")
    q = questions(spark, sf_dir).join(acct, F.col("question_id") == F.col("key")).where(k % 4 != 0)
    return q.select("question_id", F.when(numeric, F.abs("c_acctbal") * 20).alias("actual_value"), F.when(~numeric, F.when(k % 5 < 2, "yes").otherwise("no")).alias("actual_outcome"), F.date_add("target_date", 15).alias("actual_as_of"), F.when(numeric & (k % 2 == 0), F.abs("c_acctbal") * 22).alias("latest_value"))


RESOLUTIONS = """resolutions AS (
  SELECT c_custkey AS question_id, CASE WHEN c_custkey % 3 = 0 THEN abs(c_acctbal) * 20 END AS actual_value, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 5 < 2 THEN 'yes' ELSE 'no' END END AS actual_outcome,
         DATE '1996-01-01' + (c_custkey % 1500)::INT + 15 AS actual_as_of, CASE WHEN c_custkey % 6 = 0 THEN abs(c_acctbal) * 22 END AS latest_value FROM customer WHERE c_custkey % 4 <> 0)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    return o.select(
        k.alias("forecast_id"), F.col("o_custkey").alias("question_id"), F.col("o_orderpriority").alias("model_type"), F.col("o_orderdate").cast("date").alias("forecast_date"), (F.col("o_orderstatus") == "F").alias("is_backtest"), v.alias("prediction"),
        F.when(k % 11 != 0, v * 0.8).alias("lower"), F.when(k % 11 != 0, v * 1.2).alias("upper"), ((k * 37 % 101).cast("double") / 100).alias("p"),
    )


FORECASTS = """forecasts AS (
  SELECT o_orderkey AS forecast_id, o_custkey AS question_id, o_orderpriority AS model_type, o_orderdate::DATE AS forecast_date, o_orderstatus = 'F' AS is_backtest, o_totalprice AS prediction,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice * 0.8::DOUBLE END AS lower, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice * 1.2::DOUBLE END AS upper, (o_orderkey * 37 % 101)::DOUBLE / 100 AS p FROM orders)"""


def postmortems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(c) for c in ("expected_variance", "bad_data", "bad_model", "regime_change")])
    return table(spark, sf_dir, "orders").where(k % 5 == 0).select(k.alias("forecast_id"), F.get(names, (k % 4).cast("int")).alias("category"), F.when(k % 7 == 0, "manual").otherwise("auto").alias("classified_by"))


POSTMORTEMS = """postmortems AS (
  SELECT o_orderkey AS forecast_id, CASE o_orderkey % 4 WHEN 0 THEN 'expected_variance' WHEN 1 THEN 'bad_data' WHEN 2 THEN 'bad_model' ELSE 'regime_change' END AS category,
         CASE WHEN o_orderkey % 7 = 0 THEN 'manual' ELSE 'auto' END AS classified_by FROM orders WHERE o_orderkey % 5 = 0)"""

COMPONENTS = ("base_rate", "llm", "market")


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a labelled document and component: probabilities, outcome, cluster, dates."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    k, n = F.col("doc_id"), F.col("n_chars")
    p = {"base_rate": (k * 53 % 89).cast("double") / 88, "llm": F.when(k % 13 != 0, ((n * 7 + k) % 97).cast("double") / 96), "market": (k * 37 % 101).cast("double") / 100}
    rows = docs.select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id")
    wide = rows.select(
        k.alias("question_id"), "source", "lang", F.date_add(day("2023-01-01"), (k % 400).cast("int")).alias("ask_date"), F.when(k % 9 != 0, F.when(F.col("quality") == 1, "yes").otherwise("no")).alias("outcome"),
        F.when(k % 9 != 0, F.date_add(day("2023-02-01"), (k % 400 + k % 60).cast("int"))).alias("resolved_at"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in COMPONENTS]), F.array(*[p[c] for c in COMPONENTS]))).alias("component", "p"),
    )
    return wide.where("p is not null")


BINARY = """binary_rows AS (
  SELECT d.doc_id AS question_id, source, lang, DATE '2023-01-01' + (d.doc_id % 400)::INT AS ask_date, CASE WHEN d.doc_id % 9 <> 0 THEN CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END END AS outcome,
         CASE WHEN d.doc_id % 9 <> 0 THEN DATE '2023-02-01' + (d.doc_id % 400 + d.doc_id % 60)::INT END AS resolved_at, component,
         CASE component WHEN 'base_rate' THEN (d.doc_id * 53 % 89)::DOUBLE / 88 WHEN 'llm' THEN CASE WHEN d.doc_id % 13 <> 0 THEN ((n_chars * 7 + d.doc_id) % 97)::DOUBLE / 96 END ELSE (d.doc_id * 37 % 101)::DOUBLE / 100 END AS p
  FROM documents d JOIN labels USING (doc_id) CROSS JOIN (VALUES ('base_rate'), ('llm'), ('market')) c(component)),
binary_frame AS (SELECT * FROM binary_rows WHERE p IS NOT NULL)"""

KNOWN = """known AS (SELECT * EXCLUDE nth FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, observed_at ORDER BY as_of DESC) AS nth FROM obs WHERE as_of <= DATE '1998-06-30') WHERE nth = 1)"""

#: Every period as known on the eve of each month's first day, 1996-02 to 2000-12.
MONTHLY = """cuts AS (SELECT unnest(generate_series(TIMESTAMP '1996-02-01', TIMESTAMP '2000-12-01', INTERVAL 1 MONTH))::DATE AS forecast_date),
monthly AS (SELECT * EXCLUDE nth FROM (
  SELECT o.*, forecast_date, row_number() OVER (PARTITION BY series_id, observed_at, forecast_date ORDER BY as_of DESC) AS nth FROM obs o JOIN cuts ON as_of < forecast_date) WHERE nth = 1),
history AS (SELECT * FROM (SELECT *, max(as_of) OVER (PARTITION BY series_id, forecast_date) AS max_as_of_seen, year(observed_at) * 12 + month(observed_at) - 1 AS m FROM monthly) WHERE value IS NOT NULL)"""
FIRST, LAST = "1996-02-01", "2000-12-01"


def q(sql: str, digits: int = 6) -> str:
    """The SQL of functions.scalar.quantised."""
    return f"floor(({sql}) * 1e{digits} + 0.5) / 1e{digits}"
