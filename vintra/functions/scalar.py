"""Scalar expressions: rounding, scaling by kind, interval and probability scores, text cleaning."""

import math
import re
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised(x: Column, digits: int = 6) -> Column:
    """Half up by the same floating-point steps in any engine: floor(x * 10^d + 0.5) / 10^d."""
    unit = F.lit(10.0**digits)
    return F.floor(x * unit + 0.5).cast("double") / unit


def rounded(x: Column, digits: int) -> Column:
    """x to at most seven digits by its exact binary value, ties to even: 2.675 lies below the tie and gives 2.67. The product
    with the power of ten is split into its double and the rest that the double leaves out (Dekker)."""
    k = F.lit(10.0**digits)
    p, c = x * k, x * F.lit(134217729.0)
    high = c - (c - x)
    rest = (high * k - p) + (x - high) * k
    low = F.floor(p).cast("double")
    over = p - low - 0.5
    odd = F.pmod(low, F.lit(2.0)) == 1
    up = (over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & odd)))
    return (low + up.cast("double")) / k


def json_numbers(values: Column) -> Column:
    """A map of numbers as JSON text; what isn't a number becomes null."""
    return F.to_json(F.transform_values(values, lambda _, v: F.when(~F.isnan(v), v)))


def drifting(name: str, series: list[str]) -> bool:
    """Whether a feature follows time rather than the moment: levels, logs and lags of the series, log ratios, the month count."""
    own = "|".join(re.escape(s) for s in series)
    return name == "trend_months" or name.startswith("log_ratio_") or bool(re.fullmatch(rf"({own})(_log|_lag\d+)?", name))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def significant(x: Column, figures: int = 3) -> Column:
    """Rounded to so many significant figures."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (figures - 1))
    return F.when(x == 0, 0.0).otherwise(F.round(x / unit) * unit)


def logit(p: Column, edge: float = 1e-6) -> Column:
    c = clip(p, edge, 1 - edge)
    return F.log(c / (1 - c))


def z_of(coverage: float) -> float:
    """Half-width of a central normal interval in standard deviations."""
    if not 0 < coverage < 1:
        raise ValueError("coverage must lie between 0 and 1")
    return NormalDist().inv_cdf(0.5 + coverage / 2)


def scaled(value: Column, kind: Column, offset: float = 1.0, ceiling: float = 100.1) -> Column:
    """Counts on a log scale, percents by the log of what is left to the ceiling, others as they are; null outside the domain."""
    return F.when(kind == "count", F.when(value + offset > 0, F.log(value + offset))).when(kind == "percent", F.when(value < ceiling, F.log(F.lit(ceiling) - value))).otherwise(value)


def unscaled(value: Column, kind: Column, offset: float = 1.0, ceiling: float = 100.1) -> Column:
    return F.when(kind == "count", F.exp(value) - offset).when(kind == "percent", F.lit(ceiling) - F.exp(value)).otherwise(value)


def bounded(value: Column, kind: Column, last: Column) -> Column:
    """Running maxima never fall below their last value, percents never rise above 100."""
    floor = F.when(kind.isin("percent", "log10"), F.greatest(value, last)).otherwise(value)
    return F.when(kind == "percent", F.least(floor, F.lit(100.0))).otherwise(floor)


def interval_score(lower: Column, upper: Column, actual: Column, coverage: float) -> Column:
    """Width plus 2 / (1 - coverage) times the distance outside."""
    return upper - lower + F.lit(2 / (1 - coverage)) * F.greatest(lower - actual, actual - upper, F.lit(0.0))


def brier_binary(p: Column, outcome: Column) -> Column:
    """0 to 1; null while there is no outcome."""
    return F.when(outcome.isin("yes", "no"), F.pow(p - (outcome == "yes").cast("double"), 2))


def brier_categories(probabilities: Column, outcome: Column) -> Column:
    """0 to 2, over a map of category probabilities; null if the outcome isn't one of them."""
    parts = F.transform(F.map_entries(probabilities), lambda e: F.pow(e["value"] - (e["key"] == outcome).cast("double"), 2))
    return F.when(F.map_contains_key(probabilities, outcome), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def log_loss(p: Column, outcome: Column, edge: float = 1e-15) -> Column:
    c = clip(p, edge, 1 - edge)
    return F.when(outcome == "yes", -F.log(c)).when(outcome == "no", -F.log(1 - c))


def probability_bin(p: Column, bins: int = 10) -> Column:
    """Equal-width bin; an edge belongs to the higher bin and 1 to the last."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def probability_bin_linspace(p: Column, bins: int = 10) -> Column:
    """The same with the edges k * (1 / bins) as floating point has them: 0.3, 0.6 and 0.7 fall one bin lower."""
    edges = [k * (1.0 / bins) for k in range(1, bins)]
    return sum(((p >= F.lit(e)).cast("int") for e in edges), F.lit(0))


def top_entries(values: Column, n: int) -> Column:
    """The n entries of a map with the largest absolute values, ties by key."""
    ordered = F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct((-F.abs(e["value"])).alias("less"), e["key"].alias("name"), e["value"].alias("value"))))
    return F.transform(F.slice(ordered, 1, n), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))


def likeliest(probabilities: Column) -> Column:
    """The category of the largest probability, the first by name on ties."""
    return F.element_at(top_entries(probabilities, 1), 1)["name"]


def clean_markdown(text: Column, most: int | None = None) -> Column:
    """Without front matter, images, tags and link targets; blank runs collapse; cut at a word if longer than most."""
    out = F.regexp_replace(text, r"\A---\n(?s:.*?)\n---\n", "")
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"<[^>]+>", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[ \t]+", " "), (r"\n\s*\n+", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    out = F.trim(out)
    return out if most is None else F.when(F.length(out) > most, F.trim(F.regexp_replace(F.substring(out, 1, most), r"\S*$", ""))).otherwise(out)


def first_rule(text: Column, rules: dict[str, str], otherwise: str | None = None) -> Column:
    """The name of the first pattern that text contains, whatever the case."""
    out = F.lit(otherwise).cast("string")
    for name, pattern in reversed(list(rules.items())):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def student_t_tail(t: float, df: int) -> float:
    """P(T > t) of Student's t, by Simpson's rule on the angle form of its density; on the driver, for one statistic."""
    if t < 0:
        return 1 - student_t_tail(-t, df)
    # with T = sqrt(df) tan(a): the density of a is cos(a)^(df-1) over its integral on (-pi/2, pi/2)
    a, n = math.atan(t / math.sqrt(df)), 2000

    def area(x: float, y: float) -> float:
        h = (y - x) / n
        return h / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * math.cos(x + k * h) ** (df - 1) for k in range(n + 1))

    half = math.pi / 2
    return area(a, half) / (2 * area(0.0, half)) if df > 1 else 0.5 - a / math.pi
