"""Values of the model queries, which no SQL can say."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintra.queries import QUERIES, models
from vintra.queries.scoring import decisions


def test_changes_have_out_of_fold_intervals(spark, small):
    got = QUERIES["p7_boosted_changes"](spark, small).toPandas()
    assert len(got) and (got.lower < got.change).all() and (got.change < got.upper).all()
    width = (got.upper - got.lower).to_numpy()
    assert np.allclose(width, width[0])  # the same order statistics of all errors
    truth = models.training(spark, small).select("series_id", "forecast_date", F.col("change").alias("actual")).toPandas().merge(got, on=["series_id", "forecast_date"]).dropna()
    inside = ((truth.lower <= truth.actual) & (truth.actual <= truth.upper)).mean()
    assert 0.4 < inside <= 1


def test_decisions_beat_persistence_and_climatology(spark, medium):
    got = QUERIES["p8_decision_probabilities"](spark, medium).toPandas()
    names = ["cut", "hold", "hike"]
    p, hot = got[names].to_numpy(), np.stack([got.outcome == n for n in names], 1).astype(float)
    assert np.allclose(p.sum(1), 1)
    past = decisions(spark, medium).toPandas().sort_values("meeting")
    first = past[past.meeting < got.meeting.min()]
    climate = np.array([(first.outcome == n).mean() for n in names])
    before = past.assign(last=past.outcome.shift())[["meeting", "last"]].merge(got, on="meeting", how="right")["last"]
    persist = np.stack([before == n for n in names], 1).astype(float)
    brier = lambda q: ((q - hot) ** 2).sum(1).mean()
    assert brier(p) < brier(np.tile(climate, (len(got), 1))) and brier(p) < brier(persist)


def test_probabilities_fall_with_the_step(spark, medium):
    got = QUERIES["p9_threshold_probabilities"](spark, medium).toPandas().sort_values("step")
    assert got.p.between(0.01, 0.99).all() and len(got)
    assert got.groupby(["series_id", "forecast_date", "horizon_months"]).p.apply(lambda p: (np.diff(p) <= 1e-12).all()).all()
    wide = got.pivot_table(index=["series_id", "forecast_date", "horizon_months"], columns="step", values="p")
    assert (wide.iloc[:, 0] > wide.iloc[:, -1]).any()


def test_expansion_sees_nothing_after_the_cutoff(spark, small):
    got = QUERIES["p9_threshold_expansion"](spark, small).toPandas()
    assert str(got.published.max()) <= models.CUTOFF and str(got.as_of.max()) <= models.CUTOFF and set(got.cleared) == {0, 1}


def test_explanations_add_up(spark, small):
    rows = QUERIES["p10_explained_prices"](spark, small).collect()
    items = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert len(rows) == items
    for r in rows:
        assert r["prediction"] == pytest.approx(r["expected"] + r["explained"], abs=1e-9 * max(1, abs(r["prediction"])))
        sizes = [abs(x["value"]) for x in r["drivers"]]
        assert sizes == sorted(sizes, reverse=True) and math.fsum(x["value"] for x in r["drivers"]) == pytest.approx(r["explained"], rel=1e-9, abs=1e-6)
    assert {x["name"] for r in rows for x in r["drivers"]} == {"quantity", "discount", "tax", "line", "shipped"}


def test_statistical_models_cover_every_date(spark, small):
    got = QUERIES["p6_statistical_models"](spark, small).toPandas()
    assert set(got.model) == {"ets", "arima"} and set(got.series_id) == set(models.SERIES)
    late = got[got.forecast_date.astype(str) >= "1998-02-01"]
    assert late.groupby(["model", "series_id"]).forecast_date.nunique().eq(35).all()  # refits from the first one with two years of history
    assert (got.lower < got.prediction).all() and (got.prediction < got.upper).all() and (got.prediction > 0).all()
