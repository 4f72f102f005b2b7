"""Exponential smoothing and ARIMA in state-space form, chosen by AICc.

Every candidate form of every series at every refit is a row, fitted on its own; the best row of a refit is an aggregate. Between refits a model runs over the
history known at each date. A candidate's task holds one series' months. Parameters are found by the cross-entropy method, whose sample of points
goes through the recursions as one array; it starts from a fixed seed, so fits repeat.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintra.functions.calendar import month_index
from vintra.functions.scalar import bounded, scaled, unscaled, z_of

SEASON, LEAST = 12, 24
#: Fixed value: the 5 % point of the level-stationarity statistic.
KPSS_LIMIT = 0.463
ETS_FORMS = [e + t + s for e in "AM" for t in ("N", "A", "D") for s in "NAM" if e + s != "AM"]


def minimised(loss: Callable[[np.ndarray], np.ndarray], size: int, samples: int = 48, rounds: int = 16, elite: int = 8) -> tuple[np.ndarray, float]:
    """The point of the unit cube with the least loss that was seen. loss takes points as rows."""
    if size == 0:
        at = np.zeros((1, 0))
        return at[0], float(loss(at)[0])
    rng = np.random.default_rng(7)
    mean, sd, best = np.full(size, 0.5), np.full(size, 0.35), (np.full(size, 0.5), np.inf)
    for _ in range(rounds):
        at = np.clip(mean + sd * rng.standard_normal((samples, size)), 1e-4, 1 - 1e-4)
        at[0], at[1] = best[0], mean
        found = np.nan_to_num(loss(at), nan=np.inf, posinf=np.inf)
        order = np.argsort(found, kind="stable")[:elite]
        if found[order[0]] < best[1]:
            best = (at[order[0]].copy(), float(found[order[0]]))
        mean, sd = 0.3 * mean + 0.7 * at[order].mean(0), 0.3 * sd + 0.7 * at[order].std(0) + 1e-4
    return best


def aicc(twice_negative: float, k: int, n: int) -> float:
    return twice_negative + 2 * k + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf


# --- exponential smoothing ---


def ets_start(y: np.ndarray, season: str) -> tuple[float, float, np.ndarray]:
    """Level, trend and seasonal states before the first value: a line through the first ones, and what is left of two years."""
    s = np.ones(SEASON) if season == "M" else np.zeros(SEASON)
    if season != "N":
        # more than one whole year, so that each place of the year has a centred mean somewhere
        trend = np.convolve(y, np.r_[0.5, np.ones(SEASON - 1), 0.5] / SEASON, "valid")
        inner = y[SEASON // 2 : SEASON // 2 + len(trend)]
        rest = inner / trend if season == "M" else inner - trend
        at = (np.arange(len(trend)) + SEASON // 2) % SEASON
        s = np.array([rest[at == k][:2].mean() for k in range(SEASON)])
        s = s / s.mean() if season == "M" else s - s.mean()
    clean = y[:SEASON] / s[np.arange(min(len(y), SEASON))] if season == "M" else y[:SEASON] - s[np.arange(min(len(y), SEASON))]
    slope, level = np.polyfit(np.arange(1, len(clean) + 1), clean, 1)
    return float(level), float(slope), s


def ets_parameters(form: str, points: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Smoothing weights in their usual region and initial states from points of the unit cube."""
    _, trend, season = form
    level, slope, s = ets_start(y, season)
    spread = max(float(np.std(np.diff(y))), 1e-12)
    columns = iter(points.T)
    a = next(columns)
    out = {"a": a, "l": level + (next(columns) - 0.5) * 4 * spread, "s": np.tile(s, (len(points), 1)), "b": np.zeros(len(points)), "beta": 0 * a, "gamma": 0 * a, "phi": 0 * a + 1}
    if trend != "N":
        out["beta"], out["b"] = a * next(columns), slope + (next(columns) - 0.5) * 2 * spread
    if trend == "D":
        out["phi"] = 0.8 + 0.18 * next(columns)
    if season != "N":
        out["gamma"] = (1 - a) * next(columns)
    return out


def ets_size(form: str) -> tuple[int, int]:
    """(searched parameters, all parameters with states and variance)."""
    n = 2 + 2 * (form[1] != "N") + (form[1] == "D") + (form[2] != "N")
    return n, n + 1 + (SEASON - 1) * (form[2] != "N")


def ets_run(form: str, p: dict[str, np.ndarray], y: np.ndarray, steps: int = 0, noise: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(errors, means, forecasts) by row; errors are relative for multiplicative ones. noise (rows, steps): errors of the forecast steps."""
    error, trend, season = form
    level, b, s = p["l"].copy(), p["b"].copy(), p["s"].copy()
    errors, means, ahead = [], [], []
    for t in range(len(y) + steps):
        base = level if trend == "N" else level + p["phi"] * b
        old = s[:, t % SEASON]
        mean = base if season == "N" else base + old if season == "A" else base * old
        if t < len(y):
            e = y[t] - mean if error == "A" else (y[t] - mean) / mean
            errors.append(e)
            means.append(mean)
        else:
            e = np.zeros_like(mean) if noise is None else noise[:, t - len(y)]
            ahead.append(mean + (e if error == "A" else e * mean))
        if season == "M":
            level, b = base * (1 + p["a"] * e), p["phi"] * b + p["beta"] * base * e
            s[:, t % SEASON] = old * (1 + p["gamma"] * e)
        else:
            gap = e if error == "A" else e * mean
            level, b = base + p["a"] * gap, p["phi"] * b + p["beta"] * gap
            if season == "A":
                s[:, t % SEASON] = old + p["gamma"] * gap
    return np.array(errors).T, np.array(means).T, np.array(ahead).T


def ets_fit(y: np.ndarray, form: str) -> tuple[float, list[float]]:
    """(AICc, point of the unit cube); infinite where the form can't be fitted: too short, or values that aren't positive."""
    size, k = ets_size(form)
    if len(y) < LEAST or len(y) <= k + 1 or (form[2] != "N" and len(y) < 2 * SEASON) or ("M" in form and y.min() <= 0):
        return math.inf, []

    def loss(points: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            e, mean, _ = ets_run(form, ets_parameters(form, points, y), y)
            out = len(y) * np.log(np.maximum((e**2).sum(1), 1e-300))
            return out + 2 * np.log(np.abs(mean)).sum(1) if form[0] == "M" else out

    at, least = minimised(loss, size)
    return aicc(least, k, len(y)), at.tolist()


def ets_forecast(y: np.ndarray, form: str, point: list[float], steps: int, fitted_on: int) -> tuple[float, float]:
    """(mean, standard deviation) `steps` ahead of y, of which the first `fitted_on` values were fitted.

    Additive errors without a multiplicative season: the state variance in closed form; others: the variance of 4,000 paths from a fixed seed.
    """
    p = ets_parameters(form, np.array([point]), y[:fitted_on])
    e, _, ahead = ets_run(form, p, y, steps)
    sigma = math.sqrt(float((e[0, :fitted_on] ** 2).sum()) / max(1, fitted_on - ets_size(form)[0]))
    if form[0] == "A":
        phi, a, beta, gamma = (float(p[c][0]) for c in ("phi", "a", "beta", "gamma"))
        damp = np.cumsum(phi ** np.arange(1, steps)) if form[1] != "N" else np.zeros(steps - 1)
        c = a + beta * damp + gamma * (np.arange(1, steps) % SEASON == 0)
        return float(ahead[0, -1]), sigma * math.sqrt(1 + float((c**2).sum()))
    many = {k: np.repeat(v, 4000, 0) for k, v in p.items()}
    paths = ets_run(form, many, y, steps, sigma * np.random.default_rng(7).standard_normal((4000, steps)))[2]
    return float(ahead[0, -1]), float(paths[:, -1].std())


# --- ARIMA ---


def kpss(y: np.ndarray) -> float:
    """The level-stationarity statistic, with Bartlett weights up to the usual lag."""
    e = y - y.mean()
    lag = int(4 * (len(y) / 100) ** 0.25)
    variance = (e @ e + 2 * sum((1 - k / (lag + 1)) * (e[k:] @ e[:-k]) for k in range(1, lag + 1))) / len(y)
    return float((np.cumsum(e) ** 2).sum() / len(y) ** 2 / variance) if variance > 0 else 0.0


def differences(y: np.ndarray) -> tuple[int, int]:
    """(d, D): a seasonal difference if the season explains more than 0.64 of what a trend leaves, then differences until the level is stationary."""
    seasonal = 0
    if len(y) >= 3 * SEASON:
        trend = np.convolve(y, np.r_[0.5, np.ones(SEASON - 1), 0.5] / SEASON, "valid")
        rest = y[SEASON // 2 : SEASON // 2 + len(trend)] - trend
        at = np.arange(len(rest)) % SEASON
        means = np.array([rest[at == k].mean() for k in range(SEASON)])
        seasonal = int(1 - np.var(rest - means[at]) / max(np.var(rest), 1e-300) > 0.64)
    w = y[SEASON:] - y[:-SEASON] if seasonal else y
    d = 0
    while d < 2 and len(w) > 10 and kpss(w) > KPSS_LIMIT:
        w, d = np.diff(w), d + 1
    return d, seasonal


def arima_forms() -> list[str]:
    """Orders p, q up to 3, seasonal P, Q up to 1, with and without a constant: `pqPQc`."""
    return ["".join(map(str, x)) for x in itertools.product(range(4), range(4), range(2), range(2), range(2)) if sum(x[:4]) <= 4]


def lags_of(partial: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from partial autocorrelations in (-1, 1), by row."""
    out = np.zeros((len(partial), 0))
    for k in range(partial.shape[1]):
        r = partial[:, k : k + 1]
        out = np.hstack([out - r * out[:, ::-1], r])
    return out


def product(short: np.ndarray, long: np.ndarray, sign: int) -> np.ndarray:
    """Coefficients (without the leading 1) of (1 + sign * short(B)) (1 + sign * long(B^season))."""
    out = np.zeros((len(short), short.shape[1] + SEASON * long.shape[1]))
    out[:, : short.shape[1]] += short
    for k in range(long.shape[1]):
        out[:, SEASON * (k + 1) - 1] += long[:, k]
        out[:, SEASON * (k + 1) : SEASON * (k + 1) + short.shape[1]] += sign * short * long[:, k : k + 1]
    return out


def arma_of(form: str, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(autoregressive, moving-average coefficients, place of the mean) from points of the unit cube."""
    p, q, sp, sq, c = map(int, form)
    x = 0.98 * (2 * points - 1)
    parts = np.split(x[:, : p + q + sp + sq], np.cumsum([p, q, sp]), axis=1)
    ar = product(lags_of(parts[0]), lags_of(parts[2]), -1)
    ma = product(-lags_of(parts[1]), -lags_of(parts[3]), 1)
    return ar, ma, x[:, -1] if c else np.zeros(len(x))


def filtered(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kalman filter of each row's ARMA over w (rows, n): (innovations, their variances over the noise's, last state), exact from the stationary start."""
    rows, r = len(ar), max(ar.shape[1], ma.shape[1] + 1)
    t = np.zeros((rows, r, r))
    t[:, : ar.shape[1], 0] = ar
    t[:, np.arange(r - 1), np.arange(1, r)] = 1
    load = np.zeros((rows, r))
    load[:, 0], load[:, 1 : ma.shape[1] + 1] = 1, ma
    q = load[:, :, None] * load[:, None, :]
    cov, power = q.copy(), t.copy()
    for _ in range(12):  # the sum of T^k Q T'^k by doubling
        cov = cov + power @ cov @ power.transpose(0, 2, 1)
        power = power @ power
    state, v, f = np.zeros((rows, r)), np.empty_like(w), np.empty_like(w)
    for k in range(w.shape[1]):
        f[:, k] = cov[:, 0, 0]
        v[:, k] = w[:, k] - state[:, 0]
        gain = cov[:, :, 0] / f[:, k : k + 1]
        state = state + gain * v[:, k : k + 1]
        cov = cov - gain[:, :, None] * cov[:, :1, :]
        state = (t @ state[:, :, None])[:, :, 0]
        cov = t @ cov @ t.transpose(0, 2, 1) + q
    return v, f, state


def differenced(y: np.ndarray, d: int, seasonal: int) -> np.ndarray:
    w = y[SEASON:] - y[:-SEASON] if seasonal else y
    return np.diff(w, n=d)


def arima_fit(y: np.ndarray, form: str) -> tuple[float, list[float]]:
    """(AICc, [d, D, point of the unit cube ...]). The AICc of forms compares as d and D are the series' own; seasonal orders need three years."""
    orders = list(map(int, form))
    if len(y) < LEAST:
        return math.inf, []
    d, seasonal = differences(y)
    w = differenced(y, d, seasonal)
    k = sum(orders) + 1
    varies = float(np.std(w))
    lagged = len(w) > 2 * SEASON and varies > 0 and abs(float(np.corrcoef(w[SEASON:], w[:-SEASON])[0, 1])) > 2 / math.sqrt(len(w))
    if (orders[2] or orders[3]) and not (len(y) >= 3 * SEASON and (seasonal or lagged)) or (orders[4] and d + seasonal > 1) or len(w) <= k + 1:
        return math.inf, []

    def loss(points: np.ndarray) -> np.ndarray:
        ar, ma, shift = arma_of(form, points)
        v, f, _ = filtered(w[None, :] - mean_of(w, shift, orders[4])[:, None], ar, ma)
        return len(w) * np.log(np.maximum((v**2 / f).mean(1), 1e-300)) + np.log(f).sum(1)

    at, least = minimised(loss, sum(orders))
    return aicc(least, k, len(w)), [float(d), float(seasonal), *at.tolist()]


def mean_of(w: np.ndarray, shift: np.ndarray, constant: int) -> np.ndarray:
    return w.mean() + shift * 2 * np.std(w) / math.sqrt(len(w)) if constant else np.zeros(len(shift))


def arima_forecast(y: np.ndarray, form: str, fitted: list[float], steps: int, fitted_on: int) -> tuple[float, float]:
    """(mean, standard deviation) `steps` ahead of y, of which the first `fitted_on` values were fitted."""
    d, seasonal, point = int(fitted[0]), int(fitted[1]), np.array([fitted[2:]])
    ar, ma, shift = arma_of(form, point)
    trained = differenced(y[:fitted_on], d, seasonal)
    mean = mean_of(trained, shift, int(form[4]))
    w = differenced(y, d, seasonal)
    v, f, state = filtered(w[None, :] - mean[:, None], ar, ma)
    sigma = math.sqrt(float((v[0, : len(trained)] ** 2 / f[0, : len(trained)]).sum()) / max(1, len(trained) - len(fitted) + 2))
    ahead, a, m = [], ar[0], ma[0]
    now = state[0].copy()
    for _ in range(steps):
        ahead.append(now[0] + mean[0])
        now = np.r_[now[1:], 0.0] + np.r_[a, np.zeros(len(now) - len(a))] * now[0]
    # differences are undone on the polynomials: 1 = phi(B) (1 - B)^d (1 - B^12)^D
    whole = np.r_[1.0, np.zeros(SEASON - 1), -1.0] if seasonal else np.ones(1)
    for _ in range(d):
        whole = np.convolve(whole, [1.0, -1.0])
    values = list(y)
    for x in ahead:
        values.append(x - sum(whole[k] * values[-k] for k in range(1, len(whole))))
    full, psi = np.convolve(np.r_[1.0, -a], whole), [1.0]
    for j in range(1, steps):
        psi.append((m[j - 1] if j <= len(m) else 0.0) - sum(full[k] * psi[j - k] for k in range(1, min(j, len(full) - 1) + 1)))
    return float(values[-1]), sigma * math.sqrt(float(np.square(psi).sum()))


FAMILIES = {"ets": (ETS_FORMS, ets_fit, ets_forecast), "arima": (arima_forms(), arima_fit, arima_forecast)}


# --- over all series and dates ---


def month_arrays(history: DataFrame, by: list[str], kind: Column) -> DataFrame:
    """(by, months, values): each group's values on the scale of their kind in order; values outside its domain are missing."""
    rows = history.withColumn("_v", scaled(F.col("value"), kind)).where(F.col("_v").isNotNull())
    pairs = F.array_sort(F.collect_list(F.struct(month_index(F.col("observed_at")).alias("m"), F.col("_v").alias("v"))))
    return rows.groupBy(*by).agg(pairs.alias("x")).select(*by, F.col("x.m").alias("months"), F.col("x.v").alias("values"))


def filled(months, values) -> np.ndarray:
    """A value for every month from the first to the last, inner gaps on a line."""
    m = np.asarray(months)
    return np.interp(np.arange(m[0], m[-1] + 1), m, np.asarray(values, float))


def forecasts(history: DataFrame, refit: Column, kind: Column, family: str, steps: int, coverage: float = 0.8) -> DataFrame:
    """(series_id, forecast_date, form, prediction, lower, upper) `steps` months after the last known one, for each forecast date of history (series_id, forecast_date,
    observed_at, value).

    refit: the forecast date at which the model in use was fitted. A model is the form with the least AICc at its refit; on later dates it runs over the history known
    then. Forecasts are made on the scale of the kind and bounded as it is. Fewer than LEAST months at a refit: no rows until the next.
    """
    forms, fit, ahead = FAMILIES[family]
    by = ["series_id", "forecast_date"]
    arrays = month_arrays(history, by, kind)
    dates = history.select(*by).distinct().withColumn("refit_date", refit)
    starts = dates.select("series_id", "refit_date").distinct().join(arrays.withColumnRenamed("forecast_date", "refit_date"), ["series_id", "refit_date"])
    candidates = starts.withColumn("form", F.explode(F.array(*[F.lit(x) for x in forms]))).repartition("series_id", "refit_date", "form")

    def fitting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [fit(filled(m, v), f) for m, v, f in zip(b["months"], b["values"], b["form"], strict=True)]
            yield pd.DataFrame({"series_id": b["series_id"], "refit_date": b["refit_date"], "form": b["form"], "aicc": [x[0] for x in found], "point": [x[1] for x in found]})

    made = candidates.select("series_id", "refit_date", "form", "months", "values").mapInPandas(fitting, "series_id string, refit_date date, form string, aicc double, point array<double>")
    best = made.where(F.col("aicc") < math.inf).groupBy("series_id", "refit_date").agg(F.min_by(F.struct("form", "point"), F.struct("aicc", "form")).alias("b"))
    models = best.join(starts.select("series_id", "refit_date", F.size("values").alias("given"), F.col("months").alias("fit_months")), ["series_id", "refit_date"])
    asked = dates.join(arrays, by).join(models, ["series_id", "refit_date"]).select(*by, "months", "values", "fit_months", F.col("b.form").alias("form"), F.col("b.point").alias("point"))

    def predicting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [ahead(filled(m, v), f, list(p), steps, g[-1] - g[0] + 1) for m, v, g, f, p in zip(b["months"], b["values"], b["fit_months"], b["form"], b["point"], strict=True)]
            yield pd.DataFrame({"series_id": b["series_id"], "forecast_date": b["forecast_date"], "form": b["form"], "mean": [x[0] for x in out], "sd": [x[1] for x in out], "last": [v[-1] for v in b["values"]]})

    rows = asked.mapInPandas(predicting, "series_id string, forecast_date date, form string, mean double, sd double, last double")
    z = F.lit(z_of(coverage))
    last = unscaled(F.col("last"), kind)
    ends = [bounded(unscaled(x, kind), kind, last) for x in (F.col("mean"), F.col("mean") - z * F.col("sd"), F.col("mean") + z * F.col("sd"))]
    # the percent scale falls as percents rise
    return rows.select(*by, "form", ends[0].alias("prediction"), F.least(ends[1], ends[2]).alias("lower"), F.greatest(ends[1], ends[2]).alias("upper"))
