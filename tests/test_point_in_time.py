"""Hand-checked values of the as-of reads, scores and writes."""

import datetime

import pytest
from pyspark.sql import functions as F

from vintra.operators import asof, retrieval, writes

D = datetime.date.fromisoformat


@pytest.fixture(scope="module")
def obs(spark):
    """January is revised once, February's first print is null and then filled, March comes once."""
    rows = [("U", "2024-01-01", "2024-02-02", 3.7), ("U", "2024-01-01", "2024-03-08", 3.8), ("U", "2024-02-01", "2024-03-08", None), ("U", "2024-02-01", "2024-04-05", 3.9), ("U", "2024-03-01", "2024-04-05", 3.8), ("V", "2024-01-01", "2024-02-10", 1.0)]
    return spark.createDataFrame([(s, D(o), D(a), v, False) for s, o, a, v in rows], "series_id string, observed_at date, as_of date, value double, reconstructed boolean")


def test_scalar_as_of(spark, obs):
    asked = ["2024-02-01", "2024-02-02", "2024-03-07", "2024-03-08", "2025-01-01"]
    keys = spark.createDataFrame([("U", D("2024-01-01"), D(x)) for x in asked], "series_id string, observed_at date, cutoff date")
    got = {str(r["cutoff"]): r["value"] for r in asof.scalar(obs, keys).collect()}
    assert [got[x] for x in asked] == [None, 3.7, 3.7, 3.8, 3.8]


def test_series_as_of_does_not_skip_null_vintages(obs):
    series = lambda cutoff: [r["value"] for r in asof.known(obs.where("series_id = 'U'"), F.lit(cutoff).cast("date")).orderBy("observed_at").collect()]
    assert series("2024-03-20") == [3.8, None] and series("2024-12-31") == [3.8, 3.9, 3.8] and series("2024-02-01") == []


def test_nowcast_of_a_month_that_is_known_as_null(spark, obs):
    k = asof.known(obs.unionByName(obs.where("value is null").withColumn("series_id", F.lit("W"))), F.lit("2024-03-20").cast("date"))
    got = lambda x: {r["series_id"]: (str(r["month"])[:7], r["nowcast"]) for r in asof.nowcast(k, F.lit(x).cast("date")).collect()}
    assert got("2024-02-01") == {"U": ("2024-02", 3.8), "V": ("2024-01", 1.0)} and got("2024-03-01") == {"U": ("2024-01", 3.8), "V": ("2024-01", 1.0)}


def test_known_at_needs_no_cartesian_product(spark, obs):
    cutoffs = spark.createDataFrame([(D(x),) for x in ("2024-02-01", "2024-03-07", "2024-03-08", "2030-01-01")], "cutoff date")
    found = asof.known_at(obs, cutoffs)
    got = sorted((str(r["cutoff"]), r["series_id"], str(r["observed_at"])[:7], r["value"] or 0.0) for r in found.collect())
    u = [x for x in got if x[1] == "U"]
    assert u == [("2024-03-07", "U", "2024-01", 3.7), ("2024-03-08", "U", "2024-01", 3.8), ("2024-03-08", "U", "2024-02", 0.0), ("2030-01-01", "U", "2024-01", 3.8), ("2030-01-01", "U", "2024-02", 3.9), ("2030-01-01", "U", "2024-03", 3.8)]
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_upsert_counts(spark):
    schema = "id long, v string"
    four = spark.createDataFrame([(k, "a") for k in range(4)], schema)
    counts = lambda table, rows: {r["status"]: r["count"] for r in writes.upsert_status(table, rows, ["id"], ["v"]).groupBy("status").count().collect()}
    edited = spark.createDataFrame([(0, "b"), (1, "a")], schema)
    assert counts(four.limit(0), four) == {"inserted": 4} and counts(four, edited) == {"updated": 1, "unchanged": 1}
    assert sorted(r["v"] for r in writes.upsert(four, edited, ["id"]).collect()) == ["a", "a", "a", "b"]


def test_dated_retrieval(spark):
    rows = [("speech", "s1", "Policy rates", "rates were held", "2024-02-10 10:00:00"), ("minutes", "m1", "Minutes", "the policy of rates", "2024-02-28 18:00:00"), ("speech", "s2", "Labor", "wages and hiring policy", "2024-02-29 23:00:00"), ("speech", "s3", "Policy rates again", "rates were cut", "2024-03-01 00:30:00")]
    docs = retrieval.indexed(spark.createDataFrame(rows, "document_type string, source_id string, title string, content string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp")))
    day = lambda x: F.lit(x).cast("date")
    found = lambda text, x: {r["source_id"] for r in retrieval.match_any(retrieval.published_by(docs, day(x)), text).collect()}
    assert found("policy", "2024-02-29") == {"s1", "m1", "s2"} and len(found("policy", "2024-03-01")) == 4
    assert len(found("of the and", "2024-03-01")) == 4 and found("wage", "2024-03-01") == {"s2"}
    assert retrieval.retrieve(docs, "policy rates", day("2024-03-01"), 1).first()["source_id"] == "s3"  # as long as s1, as "again" is a stop word, and newer
    web = lambda text: {r["source_id"] for r in docs.where(retrieval.websearch(text)).collect()}
    assert web('"policy rates" -cut -minutes') == {"s1"} and web("hiring or minutes") == {"s2", "m1"}
