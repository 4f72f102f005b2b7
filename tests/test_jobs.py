"""Hand-checked cases of the job operators and scalar helpers."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vintra.functions import scalar
from vintra.plans import jobs

D = datetime.date


def test_lookup_fails_on_a_missing_key(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    asked = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    assert jobs.required(asked(2), table, "id").collect() == [(2, "b")]
    with pytest.raises(PySparkException, match="no row with id 3"):
        jobs.required(asked(1, 3), table, "id").collect()


def test_rounding_goes_by_the_binary_value(spark):
    values = [2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 2.5, 3.5, 0.0, 1234567.885, 99.995, 1e-9]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", scalar.rounded(F.col("x"), 2).alias("two"), scalar.rounded(F.col("x"), 0).alias("none")).collect()
    for x, two, none in rows:
        assert (two, none) == (round(x, 2), round(x, 0))


def test_refits_follow_one_another(spark):
    meetings = [D(2020, 1, 20), D(2020, 6, 20), D(2020, 12, 20), D(2021, 1, 20), D(2021, 12, 31), D(2022, 1, 15)]
    events = spark.createDataFrame([("s", m) for m in meetings], "series_id string, meeting date")
    got = {r["meeting"]: (r["data_as_of"], r["trained_as_of"]) for r in jobs.fitted_dates(events, 7, 12).collect()}
    first, second, third = D(2020, 1, 12), D(2021, 1, 12), D(2022, 1, 7)
    assert [got[m][1] for m in meetings] == [first, first, first, second, second, third]
    assert got[meetings[1]][0] == D(2020, 6, 12)


def test_event_probabilities_see_only_what_was_published(spark):
    events = [("s", D(2020, 1, 20), D(2020, 2, 1), "hike"), ("s", D(2020, 3, 20), D(2021, 6, 1), "cut"), ("s", D(2021, 2, 20), D(2021, 3, 1), None)]
    frame = spark.createDataFrame(events, "series_id string, meeting date, published date, outcome string")
    rows = jobs.event_backtest(frame, 7, 12).orderBy("meeting").collect()
    assert [r["p_hike"] for r in rows] == pytest.approx([1 / 3, 1 / 3, 1 / 2])
    assert rows[0]["brier"] == pytest.approx(2 / 3) and rows[2]["brier"] is None
    summary = jobs.event_summary(jobs.event_backtest(frame, 7, 12), ["series_id"]).first()
    assert (summary["n_forecasts"], summary["n_resolved"], summary["n_changes"]) == (3, 2, 2)


def test_a_bad_row_fails_its_own_series(spark):
    pulled = spark.createDataFrame([("a", 1, 1.0), ("a", 2, -1.0), ("b", 1, 1.0), ("b", 2, 2.0), ("b", 2, 2.0)], "s string, k int, v double")
    stored = spark.createDataFrame([("b", 1)], "s string, k int")
    got = {r["s"]: (r["fetched"], r["failed"], r["inserted"]) for r in jobs.ingest_report(stored, pulled, ["s", "k"], "s", F.col("v") < 0).collect()}
    assert got == {"a": (2, True, 0), "b": (3, False, 1)}


def test_versions_before_the_first_are_null(spark):
    at = lambda day: datetime.datetime(2023, 1, day)
    versions = spark.createDataFrame([("m", at(2), 7), ("m", at(5), 8)], "model string, made timestamp, sha int")
    asked = spark.createDataFrame([("m", at(1)), ("m", at(2)), ("m", at(9))], "model string, when timestamp")
    assert [r["sha"] for r in jobs.versions_as_of(versions, asked, "model", "made", "sha").orderBy("when").collect()] == [None, 7, 8]


def test_drifting_names():
    names = ["trend_months", "log_ratio_a_b", "flops", "flops_log", "flops_lag12", "flops_growth1", "level"]
    assert [scalar.drifting(n, ["flops"]) for n in names] == [True] * 5 + [False] * 2


def test_json_of_what_is_no_number(spark):
    nan = F.lit("NaN").cast("double")
    assert spark.range(1).select(scalar.json_numbers(F.create_map(F.lit("a"), nan, F.lit("b"), F.lit(1.5)))).first()[0] == '{"a":null,"b":1.5}'
