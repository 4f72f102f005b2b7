"""Exponential smoothing and ARIMA: simulated forms, closed forms, whole runs."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintra.plans import statespace as ss


def chosen(family, y):
    forms, fit, _ = ss.FAMILIES[family]
    return min((fit(y, f)[0], f) for f in forms)[1]


def ets_series(form, n, seed, a=0.3, beta=0.1, gamma=0.2, sigma=1.0, level=100.0, slope=1.0, season=20.0):
    s = np.sin(np.arange(12) * math.pi / 6)
    p = {"a": np.array([a]), "l": np.array([level]), "b": np.array([slope if form[1] != "N" else 0.0]), "beta": np.array([beta if form[1] != "N" else 0.0]), "gamma": np.array([gamma]), "phi": np.array([0.9 if form[1] == "D" else 1.0]), "s": (1 + 0.3 * s if form[2] == "M" else season * s if form[2] == "A" else 0 * s)[None, :]}
    noise = sigma * np.random.default_rng(seed).standard_normal((1, n))
    return ss.ets_run(form, p, np.zeros(0), n, noise)[2][0]


@pytest.mark.parametrize(("form", "family"), [("ANN", "N"), ("AAN", "AD"), ("ANA", "N"), ("AAA", "AD")])
def test_forms_of_simulated_series(form, family):
    hits = 0
    for seed in range(4):
        got = chosen("ets", ets_series(form, 120, seed))
        hits += got[1] in family and (got[2] != "N") == (form[2] != "N")
    assert hits >= 3


def test_multiplicative_season():
    got = chosen("ets", ets_series("MAM", 96, 1, beta=0.01, sigma=0.02))
    assert got[0] == "M" and got[2] == "M"


def test_state_variance_is_that_of_paths():
    for form in ("ANN", "AAN", "ADN", "AAA"):
        y = ets_series(form, 80, 3)
        point = ss.ets_fit(y, form)[1]
        _, sd = ss.ets_forecast(y, form, point, 14, len(y))
        p = ss.ets_parameters(form, np.array([point]), y)
        e, _, _ = ss.ets_run(form, p, y)
        sigma = math.sqrt((e**2).sum() / (len(y) - ss.ets_size(form)[0]))
        many = {k: np.repeat(v, 20_000, 0) for k, v in p.items()}
        paths = ss.ets_run(form, many, y, 14, sigma * np.random.default_rng(1).standard_normal((20_000, 14)))[2]
        assert sd == pytest.approx(paths[:, -1].std(), rel=0.03)


def test_exact_likelihood():
    """The filter's innovations give the density of the joint normal distribution."""
    ar, ma, n = np.array([[0.5, -0.3]]), np.array([[0.4]]), 25
    w = np.random.default_rng(2).standard_normal((1, n))
    v, f, _ = ss.filtered(w, ar, ma)
    psi = [1.0]
    for j in range(1, 400):
        psi.append((ma[0, j - 1] if j <= 1 else 0.0) + sum(ar[0, k] * psi[j - 1 - k] for k in range(min(j, 2))))
    psi = np.array(psi)
    gamma = [float(psi[: 400 - k] @ psi[k:]) for k in range(n)]
    cov = np.array([[gamma[abs(i - j)] for j in range(n)] for i in range(n)])
    assert np.log(f).sum() == pytest.approx(np.linalg.slogdet(cov)[1], abs=1e-8)
    assert (v**2 / f).sum() == pytest.approx(float(w[0] @ np.linalg.solve(cov, w[0])), abs=1e-8)


def test_seasonal_polynomials():
    got = ss.product(np.array([[0.5]]), np.array([[0.4]]), -1)[0]
    assert got[0] == 0.5 and got[11] == 0.4 and got[12] == pytest.approx(-0.2) and len(got) == 13
    assert np.allclose(ss.lags_of(np.array([[0.5, 0.2]])), [[0.5 - 0.2 * 0.5, 0.2]])


def arma(ar, ma, n, seed):
    e = np.random.default_rng(seed).standard_normal(n + 100)
    x = np.zeros(n + 100)
    for t in range(3, n + 100):
        x[t] = sum(a * x[t - k - 1] for k, a in enumerate(ar)) + e[t] + sum(m * e[t - k - 1] for k, m in enumerate(ma))
    return x[100:]


def test_orders_of_simulated_series():
    assert ss.differences(arma([0.5], [], 200, 1)) == (0, 0) and ss.differences(np.cumsum(arma([], [], 200, 1)))[0] == 1
    season = np.tile(np.arange(12.0) * 3, 10)
    assert ss.differences(season + arma([], [], 120, 1))[1] == 1
    ar = chosen("arima", arma([0.6, 0.3], [], 300, 5))
    assert ar[0] in "23" and int(ar[0]) + int(ar[1]) <= 4
    assert chosen("arima", arma([], [0.8], 300, 2))[1] != "0"
    fitted = ss.arima_fit(arma([0.7], [], 400, 3), "10000")[1]
    assert ss.arma_of("10000", np.array([fitted[2:]]))[0][0, 0] == pytest.approx(0.7, abs=0.1)


def test_forecasts_against_closed_forms():
    walk = np.cumsum(np.random.default_rng(1).standard_normal(120)) + 50
    sigma = math.sqrt((np.diff(walk) ** 2).sum() / 119)
    assert ss.arima_forecast(walk, "00000", [1.0, 0.0], 4, 120) == pytest.approx((walk[-1], sigma * 2), rel=1e-6)
    y = arma([0.7], [], 200, 3)
    fitted = ss.arima_fit(y, "10000")[1]
    a = ss.arma_of("10000", np.array([fitted[2:]]))[0][0, 0]
    mean, sd = ss.arima_forecast(y, "10000", [0.0, 0.0, *fitted[2:]], 3, 200)
    assert mean == pytest.approx(y[-1] * a**3, abs=1e-9) and sd / ss.arima_forecast(y, "10000", [0.0, 0.0, *fitted[2:]], 1, 200)[1] == pytest.approx(math.sqrt(1 + a**2 + a**4))
    line = 10 + 2.0 * np.arange(60) + 0.01 * np.random.default_rng(1).standard_normal(60)
    for family in ("ets", "arima"):
        forms, fit, ahead = ss.FAMILIES[family]
        best = min((*fit(line, f), f) for f in forms)
        assert ahead(line, best[2], best[1], 5, 60)[0] == pytest.approx(10 + 2 * 64, abs=0.2)


@pytest.mark.parametrize("family", ["ets", "arima"])
def test_whole_runs(spark, family):
    """A line with a missing month, a short series, a level shift after the refit."""
    month = lambda k: datetime.date(2000 + k // 12, k % 12 + 1, 1)
    walk = np.cumsum(np.random.default_rng(8).standard_normal(60))
    rows = []
    for date_no in (40, 41, 50):
        for k in range(date_no):
            if k != 20:
                rows.append(("line", month(date_no), month(k), float(100 + 2 * k + (30 if k >= 44 else 0) + walk[k])))
            if k < 10:
                rows.append(("short", month(date_no), month(k), 5.0 + k))
    history = spark.createDataFrame(rows, "series_id string, forecast_date date, observed_at date, value double")
    out = ss.forecasts(history, F.lit(month(40)), F.lit("level"), family, 3).toPandas().sort_values("forecast_date")
    assert set(out.series_id) == {"line"} and len(out) == 3 and out.form.nunique() == 1
    assert out.prediction.iloc[0] == pytest.approx(100 + 2 * 42 + walk[39], abs=5) and out.prediction.iloc[2] > 100 + 2 * 52 + walk[49] + 10  # moves to the shifted level without a refit
    assert (out.lower <= out.prediction).all() and (out.prediction <= out.upper).all()
    wide = ss.forecasts(history, F.lit(month(40)), F.lit("level"), family, 3, 0.95).toPandas().sort_values("forecast_date")
    assert ((wide.upper - wide.lower).to_numpy() > (out.upper - out.lower).to_numpy()).all()
    percent = ss.forecasts(history.withColumn("value", F.col("value") / 3), F.lit(month(40)), F.lit("percent"), family, 3).toPandas()
    assert (percent.upper <= 100).all() and (percent.lower <= percent.upper).all()
