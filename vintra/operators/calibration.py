"""Conformal intervals, walk-forward recalibration, probability calibration and forecast blending."""

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintra.functions.scalar import logit

SLACK = 1e-9


def rank_of(n: Column, level: float) -> Column:
    """Of n values the one (from 1) that bounds a share `level` of new ones; the slack absorbs float error."""
    return F.ceil((n + 1) * F.lit(level) - F.lit(SLACK)).cast("int")


def least_residuals(coverage: float, signed: bool = False) -> int:
    """Fewest residuals with a finite interval."""
    tail = (1 - coverage) / 2 if signed else 1 - coverage
    return math.ceil(1 / tail - SLACK) - 1


def conformal(values: Column, level: float) -> Column:
    """The order statistic, not interpolated, of an array of residuals; null if there are too few."""
    n = F.size(values)
    return F.get(F.sort_array(values), rank_of(n, level) - 1)


def offsets(errors: Column, coverage: float, signed: bool) -> tuple[Column, Column]:
    """Lower and upper offsets from an array of actual - prediction."""
    if not signed:
        q = conformal(F.transform(errors, F.abs), coverage)
        return -q, q
    level = 1 - (1 - coverage) / 2
    return -conformal(F.transform(errors, lambda e: -e), level), conformal(errors, level)


def recalibrated(results: DataFrame, by: list[str], coverage: float = 0.8, signed: bool = False, most: int | None = None) -> DataFrame:
    """Intervals of each fold (rows that share trained_as_of) from the errors whose actual had been published by then.

    raw_lower and raw_upper keep the model's own; a fold with too few errors has none. The history that a fold sees is
    joined per group and fold; a group is one model's forecasts of one series, a few hundred rows.
    """
    errors = results.where("actual is not null").select(*by, "forecast_date", "actual_as_of", (F.col("actual") - F.col("prediction")).alias("e"))
    folds = results.select(*by, "trained_as_of").where("trained_as_of is not null").distinct()
    seen = folds.join(errors, by).where("actual_as_of <= trained_as_of")
    if most is not None:
        w = Window.partitionBy(*by, "trained_as_of").orderBy(F.desc("forecast_date"))
        seen = seen.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most)
    low, high = offsets(F.col("es"), coverage, signed)
    fitted = seen.groupBy(*by, "trained_as_of").agg(F.collect_list("e").alias("es")).where(F.size("es") >= least_residuals(coverage, signed))
    fitted = fitted.select(*by, "trained_as_of", low.alias("_low"), high.alias("_high"), F.size("es").alias("_n"))
    out = results.withColumnsRenamed({"lower": "raw_lower", "upper": "raw_upper"}).drop("in_interval").join(fitted, [*by, "trained_as_of"], "left")
    out = out.withColumn("lower", F.col("prediction") + F.col("_low")).withColumn("upper", F.col("prediction") + F.col("_high")).withColumn("n_calibration", F.coalesce("_n", F.lit(0)))
    return out.withColumn("in_interval", F.when(F.col("actual").isNotNull(), (F.col("lower") <= F.col("actual")) & (F.col("actual") <= F.col("upper")))).drop("_low", "_high", "_n")


def pooled_steps(sorted_rows, keys: list[str]):
    """The least-squares rising fit of each group's points (x, hits, n): neighbours that violate the order are pooled until none does. numpy, on one group's distinct x."""
    import pandas as pd

    xs, hits, n = sorted_rows["x"].to_numpy(float), sorted_rows["hits"].to_numpy(float), sorted_rows["n"].to_numpy(float)
    blocks: list[list[float]] = []
    for x, h, m in zip(xs, hits, n, strict=True):
        blocks.append([x, x, h, m])
        # products of counts are exact: no quotient is compared
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low, high, h, m = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + h, blocks[-1][3] + m]
    head = {k: sorted_rows[k].iloc[0] for k in keys}
    return pd.DataFrame([head | {"low": b[0], "high": b[1], "y": b[2] / b[3]} for b in blocks])


def isotonic_steps(train: DataFrame, keys: list[str], p: str = "p", outcome: str = "outcome") -> DataFrame:
    """(keys, low, high, y): the rising step function of each group's outcomes (yes or no) over p.

    Equal probabilities are summed first, so what a group's task sees is its distinct probabilities: it grows with their number, not with the forecasts. Groups
    whose outcomes agree have no steps.
    """
    rows = train.where(F.col(outcome).isin("yes", "no") & F.col(p).isNotNull())
    points = rows.groupBy(*keys, F.col(p).cast("double").alias("x")).agg(F.sum((F.col(outcome) == "yes").cast("long")).alias("hits"), F.count("*").alias("n"))
    shape = ", ".join(f"{k} {train.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf):
        pdf = pdf.sort_values("x")
        out = pooled_steps(pdf, keys)
        return out if 0 < pdf["hits"].sum() < pdf["n"].sum() else out.iloc[:0]

    return points.groupBy(*keys).applyInPandas(run, f"{shape}, low double, high double, y double")


def isotonic(train: DataFrame, asked: DataFrame, keys: list[str], p: str = "p", outcome: str = "outcome") -> DataFrame:
    """asked with `calibrated`: its group's step at p, linear between steps, constant beyond the ends; p itself without a fit."""
    steps = isotonic_steps(train, keys, p, outcome)
    arrays = steps.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.array_sort(F.collect_list(F.struct("low", "high", "y"))).alias("_s"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    x = F.col(p).cast("double")
    below = F.try_element_at(F.filter("_s", lambda s: s["low"] <= x), F.lit(-1))
    above = F.get(F.filter("_s", lambda s: s["low"] > x), F.lit(0))
    between = below["y"] + (above["y"] - below["y"]) * (x - below["high"]) / (above["low"] - below["high"])
    first = F.get("_s", F.lit(0))
    value = F.when(F.col("_s").isNull(), x).when(x < first["low"], first["y"]).when((x <= below["high"]) | above.isNull(), below["y"]).otherwise(between)
    return asked.join(arrays, on, "left").withColumn("calibrated", value).drop("_s", *[f"_{k}" for k in keys])


def fold_isotonic(forecasts: DataFrame, keys: list[str], fold: str, starts: str, published: str, key: list[str]) -> DataFrame:
    """Categorical forecasts (key, keys, fold, starts, published, outcome, probabilities: a map by category) with `calibrated`, a map that sums to one.

    A fold's function is fitted, for each group of keys, on all categories of the forecasts whose outcome had been published before the fold starts, as forecasts of their own.
    starts: the fold's first day, the same for all its rows. A fold is met by the groups' earlier forecasts: rows times later folds, folds being few.
    """
    flat = forecasts.select(*key, *keys, fold, starts, published, "outcome", F.explode("probabilities").alias("category", "p")).withColumn("_hit", F.when(F.col("outcome").isNotNull(), F.when(F.col("category") == F.col("outcome"), "yes").otherwise("no")))
    folds = forecasts.select(*keys, fold, starts).distinct()
    past = flat.where(F.col("_hit").isNotNull()).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(published).alias("_out"), "p", F.col("_hit").alias("hit"))
    on = F.col("_out") < F.col(starts)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    train = folds.join(past, on).select(*keys, fold, "p", "hit")
    mapped = isotonic(train, flat.drop("_hit"), [*keys, fold], "p", "hit")
    raw = F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "p"))))
    fitted = F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "calibrated"))))
    total = F.aggregate(F.map_values("_f"), F.lit(0.0), lambda a, x: a + x)
    out = mapped.groupBy(*key, *keys, fold).agg(raw.alias("_r"), fitted.alias("_f"))
    return out.select(*key, *keys, fold, F.when(total > 0, renormalised(F.col("_f"))).otherwise(F.col("_r")).alias("calibrated"))


def platt(train: DataFrame, df: DataFrame, p: str = "p", outcome: str = "outcome") -> DataFrame:
    """df with p mapped by a logistic curve of its log-odds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vector = VectorAssembler(inputCols=["_l"], outputCol="_x")
    ready = vector.transform(train.where(F.col(outcome).isin("yes", "no")).withColumn("_y", (F.col(outcome) == "yes").cast("double")).withColumn("_l", logit(F.col(p))))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1e-6).fit(ready)
    out = model.transform(vector.transform(df.withColumn("_l", logit(F.col(p)))))
    return out.withColumn("calibrated", vector_to_array("probability")[1]).drop("_x", "_l", "rawPrediction", "probability", "prediction")


def renormalised(probabilities: Column) -> Column:
    """A map of calibrated category probabilities made to sum to one; equal shares if they sum to none."""
    total = F.aggregate(F.map_values(probabilities), F.lit(0.0), lambda a, x: a + x)
    return F.transform_values(probabilities, lambda k, v: F.when(total > 0, v / total).otherwise(1.0 / F.size(probabilities)))


def simplex(k: int, step: float = 0.05) -> list[list[float]]:
    """Every weight vector of length k on the grid, in order."""
    n = round(1 / step)
    return [[*(c / n for c in parts), (n - sum(parts)) / n] for parts in itertools.product(range(n + 1), repeat=k - 1) if sum(parts) <= n]


def blend(values: list[Column], weights: list[Column]) -> Column:
    """Weighted mean of the values present, weights renormalised; their plain mean if their weights sum to none; null if none."""
    present = [F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(values, weights, strict=True)]
    total, weighted = sum(present, F.lit(0.0)), sum((F.coalesce(v, F.lit(0.0)) * w for v, w in zip(values, present, strict=True)), F.lit(0.0))
    count = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    plain = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return F.when(count == 0, None).when(total > 0, weighted / total).otherwise(plain / count)


def moments_as_of(wide: DataFrame, columns: list[str], published: str, asked: str, strict: bool) -> DataFrame:
    """For each day of `asked`: n_history and the sums m_i_j of products of columns i <= j, over the rows with all columns that had been published
    by then (strict: before that day).

    Rows are summed by the day of their publication; days and asks then form one running sum. That is a row or two for each day of a calendar, ordered
    in one task, however many rows there are.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.count("*").alias("n_history"), *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"m_{i}_{j}") for i, j in pairs]]
    daily = wide.where(F.col(published).isNotNull()).dropna(subset=columns).groupBy(F.col(published).cast("date").alias("_day")).agg(*sums).withColumn("_ask", F.lit(False))
    asks = wide.where(F.col(asked).isNotNull()).select(F.col(asked).cast("date").alias("_day")).distinct().withColumn("_ask", F.lit(True))
    names = ["n_history", *[f"m_{i}_{j}" for i, j in pairs]]
    both = daily.unionByName(asks, allowMissingColumns=True)
    before = Window.orderBy("_day", F.desc("_ask") if strict else F.asc("_ask")).rowsBetween(Window.unboundedPreceding, 0)
    running = both.select("_day", "_ask", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in names])
    return running.where("_ask").drop("_ask").withColumnRenamed("_day", asked)


def blend_weights(moments: DataFrame, k: int, method: str, least: int, step: float) -> DataFrame:
    """moments_as_of() of k components and their target with weights: of the least squared error on a grid (first best), by inverse mean squared error, or
    equal; equal too with fewer than `least` rows. The grid is laid out for days alone."""
    m = lambda i, j: F.col(f"m_{min(i, j)}_{max(i, j)}")
    equal = F.array(*[F.lit(1.0 / k)] * k)
    if method == "inverse_variance":
        inverse = [1 / F.greatest(F.try_divide(m(i, i) - 2 * m(i, k) + m(k, k), F.col("n_history")), F.lit(1e-12)) for i in range(k)]
        fitted = moments.withColumn("weights", F.array(*[x / sum(inverse[1:], inverse[0]) for x in inverse]))
    elif method == "learned":
        grid = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[F.lit(x) for x in w]).alias("w")) for n, w in enumerate(simplex(k, step))]))
        w = lambda i: F.col("g.w")[i]
        loss = m(k, k)
        for i in range(k):
            loss = loss - 2 * w(i) * m(i, k)
            for j in range(k):
                loss = loss + w(i) * w(j) * m(i, j)
        key = [c for c in moments.columns if not c.startswith("m_")]
        # losses that agree to nine digits are the same, and the first of the grid counts
        fitted = moments.withColumn("g", grid).groupBy(*key).agg(F.min_by("g.w", F.struct(F.round(F.try_divide(loss, F.col("n_history")), 9).alias("loss"), F.col("g.n").alias("n"))).alias("weights"))
    elif method == "equal":
        fitted = moments.withColumn("weights", equal)
    else:
        raise ValueError(f"unknown method {method}")
    return fitted.select(*[c for c in fitted.columns if not c.startswith("m_") and c != "weights"], F.when(F.col("n_history") >= least, F.col("weights")).otherwise(equal).alias("weights"))


def walk_forward_blend(wide: DataFrame, components: list[str], target: str, published: str, asked: str, strict: bool = True, method: str = "learned", least: int = 10, step: float = 0.05) -> DataFrame:
    """wide with n_history, weights and `blended`: each row's components under weights from the rows whose target had been published before its
    `asked` day (strict), or by it.

    wide: one row a question; a component is null where it made no forecast, and the weights of the others are then scaled up. Rows without an `asked` day have no blend.
    """
    k = len(components)
    fitted = blend_weights(moments_as_of(wide, [*components, target], published, asked, strict), k, method, least, step)
    return wide.join(fitted.withColumnRenamed(asked, "_asked"), F.col(asked).cast("date") == F.col("_asked"), "left").drop("_asked").withColumn("blended", blend([F.col(c) for c in components], [F.col("weights")[i] for i in range(k)]))


def numeric_blend(rows: DataFrame, components: list[str], method: str = "learned", least: int = 10) -> DataFrame:
    """Numeric forecasts (series_id, forecast_date, target_period, data_as_of, actual, actual_as_of and structs (prediction, lower, upper) named as the components)
    with the blended prediction, lower and upper: weights from relative errors of all series' forecasts whose actual had been published by data_as_of."""
    errors = {f"_e{i}": F.try_divide(F.col(f"{c}.prediction"), "actual") - 1 for i, c in enumerate(components)}
    wide = rows.withColumns(errors).withColumn("_zero", F.when(F.col("actual").isNotNull(), F.lit(0.0)))
    out = walk_forward_blend(wide, list(errors), "_zero", "actual_as_of", "data_as_of", False, method, least).drop(*errors, "_zero", "blended")
    weights = [F.col("weights")[i] for i in range(len(components))]
    return out.withColumns({v: blend([F.col(f"{c}.{v}") for c in components], weights) for v in ("prediction", "lower", "upper")}).drop(*components)
