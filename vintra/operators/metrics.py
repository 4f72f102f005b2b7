"""Forecast scores as aggregates: every function takes the grouping columns and one row a forecast."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintra.functions.scalar import brier_binary, interval_score, log_loss, probability_bin, student_t_tail
from vintra.sources.scratch import Scratch


def scored(df: DataFrame) -> DataFrame:
    """prediction, lower, upper, actual -> error, abs_error, squared_error, in_interval; null without an actual, or bounds."""
    error = F.col("prediction") - F.col("actual")
    inside = F.when(F.col("actual").isNotNull(), (F.col("lower") <= F.col("actual")) & (F.col("actual") <= F.col("upper")))
    return df.withColumn("error", error).withColumn("abs_error", F.abs(error)).withColumn("squared_error", error * error).withColumn("in_interval", inside)


def numeric_summary(df: DataFrame, by: list[str], coverage: float = 0.8) -> DataFrame:
    """n_forecasts, n_resolved, rmse, mae, bias, interval_coverage and interval_score over the resolved forecasts."""
    width = interval_score(F.col("lower"), F.col("upper"), F.col("actual"), coverage)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_forecasts"), F.count("actual").alias("n_resolved"), F.sqrt(F.avg("squared_error")).alias("rmse"), F.avg("abs_error").alias("mae"), F.avg("error").alias("bias"),
        F.avg(F.col("in_interval").cast("double")).alias("interval_coverage"), F.avg(F.when(F.col("actual").isNotNull(), width)).alias("interval_score"),
    )


def relative_rmse(df: DataFrame, by: list[str]) -> DataFrame:
    """Root of the mean squared error relative to the actual; zero actuals don't count."""
    share = F.try_divide("error", "actual")
    return df.groupBy(*by).agg(F.sqrt(F.avg(share * share)).alias("relative_rmse"))


def against_baseline(table: DataFrame, by: list[str], model: str, baseline: str, value: str = "rmse") -> DataFrame:
    """table with the ratio of a score to the baseline model's in the same group."""
    base = table.where(F.col(model) == baseline).select(*by, F.col(value).alias("_base"))
    return table.join(base, by, "left").withColumn(f"{value}_ratio", F.try_divide(value, "_base")).drop("_base")


def binary_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """n, brier, log_loss, base_rate of (p, outcome yes or no)."""
    done = df.where(F.col("outcome").isin("yes", "no"))
    return done.groupBy(*by).agg(F.count("*").alias("n"), F.avg(brier_binary(F.col("p"), F.col("outcome"))).alias("brier"), F.avg(log_loss(F.col("p"), F.col("outcome"))).alias("log_loss"), F.avg((F.col("outcome") == "yes").cast("double")).alias("base_rate"))


def calibration_curve(df: DataFrame, by: list[str], bins: int = 10, bin_of: Column | None = None) -> DataFrame:
    """One row for each bin that has forecasts: mean_predicted, observed, n."""
    b = bin_of if bin_of is not None else probability_bin(F.col("p"), bins)
    return df.where(F.col("outcome").isin("yes", "no")).groupBy(*by, b.alias("bin")).agg(F.avg("p").alias("mean_predicted"), F.avg((F.col("outcome") == "yes").cast("double")).alias("observed"), F.count("*").alias("n"))


def decomposition(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """ece, reliability, resolution and uncertainty from the curve: a second small aggregate over at most `bins` rows a group."""
    curve = calibration_curve(df, by, bins)
    total = Window.partitionBy(*by)
    share = F.col("n") / F.sum("n").over(total)
    base = F.sum(F.col("n") * F.col("observed")).over(total) / F.sum("n").over(total)
    gap = F.col("mean_predicted") - F.col("observed")
    rows = curve.withColumn("share", share).withColumn("base", base).withColumn("gap", gap)
    return rows.groupBy(*by).agg(
        F.sum(F.col("share") * F.abs("gap")).alias("ece"), F.sum(F.col("share") * F.col("gap") * F.col("gap")).alias("reliability"), F.sum(F.col("share") * F.pow(F.col("observed") - F.col("base"), 2)).alias("resolution"), (F.first("base") * (1 - F.first("base"))).alias("uncertainty"),
    )


def one_vs_rest(df: DataFrame, probabilities: str = "probabilities", outcome: str = "outcome") -> DataFrame:
    """Each category of a forecast as a forecast of its own: category, p, outcome yes or no."""
    rest = [c for c in df.columns if c not in (probabilities, outcome)]
    return df.select(*rest, F.col(outcome).alias("_o"), F.explode(probabilities).alias("category", "p")).select(*rest, "category", "p", F.when(F.col("category") == F.col("_o"), "yes").otherwise("no").alias("outcome"))


def skill(brier: Column, reference: Column) -> Column:
    """1 - brier / reference; null unless the reference is above zero."""
    return F.when(reference > 0, 1 - brier / reference)


def diebold_mariano(df: DataFrame, by: list[str], order: str, a: str, b: str, horizon: int = 1) -> DataFrame:
    """Statistic of equal squared errors of a and b, with autocovariances up to horizon - 1 and the small-sample correction;
    null without 2 * horizon forecasts or variance. Means first, then lagged products in the forecasts' order."""
    d = F.col(a) * F.col(a) - F.col(b) * F.col(b)
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", d)
    whole, ordered = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_n", F.count("*").over(whole)).withColumn("_mean", F.avg("_d").over(whole)).withColumn("_c", F.col("_d") - F.col("_mean"))
    for k in range(1, horizon):
        rows = rows.withColumn(f"_l{k}", F.col("_c") * F.lag("_c", k).over(ordered))
    variance = F.avg(F.col("_c") * F.col("_c"))
    for k in range(1, horizon):
        variance = variance + 2 * F.avg(f"_l{k}")
    n, h = F.first("_n"), horizon
    out = rows.groupBy(*by).agg(F.first("_n").alias("n"), F.first("_mean").alias("_m"), variance.alias("_v"), F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n).alias("_k"))
    ok = (F.col("n") >= 2 * h) & (F.col("_v") > 0)
    return out.select(*by, "n", F.when(ok, F.col("_m") / F.sqrt(F.col("_v") / F.col("n")) * F.col("_k")).alias("statistic"))


def p_value(statistic: float, n: int) -> float:
    """Two-sided, of diebold_mariano(): t with n - 1 degrees of freedom; on the driver, for a report's few rows."""
    return 2 * student_t_tail(abs(statistic), n - 1) if not math.isnan(statistic) else math.nan


def cluster_bootstrap(df: DataFrame, by: list[str], cluster: str, value: str, draws: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """low and high of the mean when whole clusters are drawn with replacement; null for fewer than two clusters.

    Clusters are first summed, which is all that a draw needs. A group's sums, one pair a cluster, go to as many tasks as there are blocks of
    draws, and the draws' means are met by an exact percentile. Draw k has the seed (seed, k).
    """
    import numpy as np
    import pandas as pd

    sums = df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))

    pairs = F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("s").cast("double").alias("s"), F.col("n").alias("n"))))
    groups = sums.groupBy(*by).agg(pairs.alias("x")).select(*by, F.col("x.s").alias("s"), F.col("x.n").alias("n"))
    block = 100
    blocks = groups.where(F.size("s") > 1).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // block)))).repartition(*by, "_block")

    def run(batches):
        for b in batches:
            means = []
            for s, n, k in zip(b["s"], b["n"], b["_block"], strict=True):
                s, n = np.asarray(s, float), np.asarray(n, float)
                at = [np.random.default_rng((seed, d)).integers(0, len(s), len(s)) for d in range(k * block, min(draws, (k + 1) * block))]
                means.append([s[i].sum() / n[i].sum() for i in at])
            yield pd.DataFrame({**{c: b[c] for c in by}, "m": means})

    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    tail = (1 - level) / 2
    ends = blocks.mapInPandas(run, f"{fields}, m array<double>").select(*by, F.explode("m").alias("m")).groupBy(*by).agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    out = groups.select(*by).join(ends.select(*[F.col(c).alias(f"_{c}") for c in by], "q"), on, "left")
    return out.select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def top_words(df: DataFrame, by: list[str], text: str, n: int, stop: list[str]) -> DataFrame:
    """The n most frequent words and word pairs of each group: pairs that occur more than once take half of the places, rounded up."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9-]+)"), F.lit(1))
    for x in stop:
        words = F.array_remove(words, x)
    # each word with the next one, null after a text's last: one pass counts the pairs, and words are sums over theirs
    found = df.select(*by, words.alias("_w")).select(*by, F.explode(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", F.lit(2), F.size("_w")).alias("b"))).alias("_p"))
    pairs = Scratch(df.sparkSession).save(found.groupBy(*by, F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b")).agg(F.count("*").alias("n")), "pairs")
    counted = {"pair": pairs.where("_b is not null").select(*by, F.concat_ws(" ", "_a", "_b").alias("term"), "n"), "word": pairs.groupBy(*by, F.col("_a").alias("term")).agg(F.sum("n").alias("n"))}
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "term")
    two = counted["pair"].where("n > 1").withColumn("kind", F.lit("pair")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= math.ceil(n / 2))
    taken = two.groupBy(*by).agg(F.count("*").alias("taken"))
    one = counted["word"].withColumn("kind", F.lit("word")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).join(taken, by, "left").where(F.col("nth") <= n - F.coalesce("taken", F.lit(0))).drop("taken")
    return two.unionByName(one)
